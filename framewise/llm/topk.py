"""Exact top-k search by integer inner product, with MaxScore.

The terms of a query are its components; a component's postings are its values in all vectors of a shard. The shard's extremes bound what each
term can add. Terms are taken by the width of that range, widest first: those that come last, as long as they alone can't lift a vector to the
current k-th score, are non-essential. The essential terms' postings are traversed for all vectors; the others are probed, some at a time, only
for vectors that can still compete. Shards' results are merged by score, then smaller id, so the search is exact.

Queries are a stated set of rows; they meet all rows block by block. The number of blocks and shards follows the number of rows and their width, so what a task
holds is bounded by bytes.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with zeros; a query is
never its own result, but other rows with its vector are; rows that repeat an id are results each; a null id takes no part; with fewer than k others, all are returned;
ties go to the smaller id; very long vectors make shards of fewer rows; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, saved

#: Bytes of vectors in a shard, and in a block of queries.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 1 << 18
#: Non-essential terms that are probed between two looks at the bounds.
PROBE = 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``vec_id, terms`` (little-endian 32-bit ``floor(scale * x)``) of the vectors that take part; a component beyond 32 bits is an error, since
    scores would then leave 64 bits."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = None if x is None or None in x else np.array(x, np.float64)
                if v is not None and i is not None and np.isfinite(v).all():
                    ids.append(i)
                    whole = np.floor(scale * v)
                    if len(v) and np.abs(whole).max() >= 1 << 31:
                        raise ValueError(f"a component of vector {i} is too large: {np.abs(v).max()}")
                    rows.append(whole.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["vec_id", "terms"])

    return in_arrow(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), packed, "vec_id long, terms binary")


def _matrix(terms: list[bytes], width: int) -> np.ndarray:
    """Postings: one row for each term."""
    out = np.zeros((width, len(terms)), np.int64)
    for j, t in enumerate(terms):
        v = np.frombuffer(t, "<i4")
        out[: len(v), j] = v
    return out


def max_score(postings: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a shard: places and scores, best first; ``ids`` ascend, so earlier places win ties."""
    ends = query[:, None] * np.stack([postings.max(axis=1), postings.min(axis=1)], axis=1)
    most, least = ends.max(axis=1), ends.min(axis=1)
    order = np.argsort(least - most, kind="stable")
    others = np.flatnonzero(ids != query_id)
    few = others[:: max(1, len(others) // (8 * k))]
    if not len(few):
        return others, np.zeros(0, postings.dtype)
    score = query @ postings[:, few]
    bar = np.partition(score, -k)[-k] if len(few) >= k else -np.inf
    # what the terms from a place on can add at most, and those before it at least
    rest = np.append(most[order][::-1].cumsum()[::-1], 0)
    floor = np.append(0, least[order].cumsum())
    essential = max(1, int(np.argmax(floor + rest < bar)) if (floor + rest < bar).any() else len(order))
    take = order[:essential]
    partial = query[take] @ postings[take]
    live = others[partial[others] + rest[essential] >= bar]
    partial = partial[live]
    for i in range(essential, len(order), PROBE):
        take = order[i : i + PROBE]
        partial = partial + query[take] @ postings[np.ix_(take, live)]
        after = rest[min(i + PROBE, len(order))]
        if len(live) > k:
            sure = floor[-1] - floor[min(i + PROBE, len(order))]
            bar = max(bar, np.partition(partial, -k)[-k] + sure)
        keep = partial + after >= bar
        live, partial = live[keep], partial[keep]
    best = np.lexsort((live, -partial))[:k]
    return live[best], partial[best]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard: int | None = None, block: int | None = None) -> DataFrame:
    """For each row that ``queries`` (a condition on ``vec_id``) holds for: ``query_id, rank, vec_id, score`` of its k best others. Shards of ``shard`` vectors meet
    blocks of ``block`` queries; both follow the vectors' width unless given."""
    rows = saved(quantised(vectors, id_col, vector_col, scale), "vectors")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("q"), F.max(F.octet_length("terms")).alias("w")).first()
    width = max(1, (shape["w"] or 4) // 4)
    shard, block = shard or max(256, SHARD_BYTES // (4 * width)), block or max(16, BLOCK_BYTES // (4 * width))
    shards, blocks = -(-shape["n"] // shard) or 1, -(-shape["q"] // block) or 1
    mix = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    gathered = F.collect_list(F.struct("vec_id", "terms"))
    held = rows.groupBy(mix(shards, 1).alias("shard")).agg(gathered.alias("rows"))
    asked = rows.filter(queries).groupBy(mix(blocks, 2).alias("block")).agg(gathered.alias("asked"))
    meet = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(held, "shard")
    # a pair of a shard and a block is much work and few bytes, so pairs are dealt out one by one
    spread = max(1, min(shards * blocks, 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    meet = meet.repartition(spread, F.col("shard") * blocks + F.col("block")).select("rows", "asked")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array(rows.values.field(0))
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                postings = _matrix([rows.values.field(1)[int(i)].as_py() for i in order], width)
                terms = _matrix(asked.values.field(1).to_pylist(), width).T
                high = max(1, int(np.abs(postings).max(initial=0))), max(1, int(np.abs(terms).max(initial=0)))
                if high[0] * high[1] * width < 1 << 52:  # sums are then exact in floating point, which is faster
                    postings, terms = postings.astype(np.float64), terms.astype(np.float64)
                out: list[list[np.ndarray]] = [[], [], []]
                for query_id, query in zip(asked.values.field(0).to_pylist(), terms, strict=True):
                    at, score = max_score(postings, ids, query, query_id, k)
                    for col, x in zip(out, (np.full(len(at), query_id), ids[at], score.astype(np.int64)), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "vec_id", "score"])

    found = in_arrow(meet, searched, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
