"""Exact deduplication by an extendible-hash index kept in shared files (DataFrame functions only).

The key of a text is its 64-bit hash. Its leading bits select a cell of the directory, and the cell tells the bucket. The directory begins with one bucket; while a
bucket holds more than ``bucket_keys`` keys it is split by one more bit, and the directory doubles where that takes it deeper. As many doublings as the number of keys asks for are
decided on at once, from the counts of their cells; buckets that are still overfull go on to the next round, down to ``DEEPEST`` bits. A bucket is a range of keys, and
the index is written in ranges of (bucket, key), each by its owner task. Under a key the different texts form a chain: they are told apart by grouping on their
bytes, so a hash collision never joins two texts. Copies are combined before the shuffle, so a text that is a third of all rows sends one row per task. A row
finds its entry by bucket, key and the text's SHA-256, which names the link of the chain.

Defined cases: null text counts as empty; empty texts are equal to each other; very long texts are hashed and compared whole; rows that repeat a doc_id with the
same text are each reported, count towards ``group_size`` and are all marked kept if theirs is the largest id, but ``keep_one`` returns one of them; a null doc_id
never wins over another, and where all ids of a text are null, none is marked kept, but ``keep_one`` returns one row; an empty table gives an empty result; extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

BUCKET_KEYS = 1 << 20
#: Bits of a key that a bucket's number can hold; doublings that a round decides on at most; rows of a round's directory that may be broadcast.
DEEPEST, ROUND, BROADCAST_ROWS = 62, 20, 1 << 20

Directory = list[tuple[DataFrame, int]]


def _cell(depth: int):
    return F.shiftrightunsigned("key", 64 - depth)


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, most: int = ROUND) -> Directory:
    """Rounds of ``(cell, bucket, depth)`` with the bits of their cells; ``keys`` has one row per distinct ``key``. A bucket is numbered ``2**depth +
    prefix``; it is null where the next round tells it. There are at most some 16 cells for each ``bucket_keys`` keys."""
    rounds: Directory = []
    base, live = 0, keys.select("key")
    while True:
        held = live.count()
        doublings = max(0, math.ceil(math.log2(max(1, held) / bucket_keys))) + 2
        deep = min(base + min(doublings, most), DEEPEST)
        cells = live.groupBy(_cell(deep).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth"))
        levels = levels.withColumn("bucket", F.expr(f"shiftleft(1L, depth) + shiftright(cell, {deep} - depth)"))
        room = levels.groupBy("bucket").agg(F.sum("n").alias("held"))
        fits = F.expr(f"held <= {bucket_keys} OR depth = {DEEPEST}")
        found = levels.join(room, "bucket").groupBy("cell").agg(F.min(F.when(fits, F.struct("depth", "bucket"))).alias("b"))
        found = saved(found.select("cell", "b.bucket", "b.depth"), "directory")
        rounds.append((found, deep))
        open_ = found.filter("bucket IS NULL").select("cell")
        if deep == DEEPEST or open_.isEmpty():
            return rounds
        base, live = deep, live.join(open_, _cell(deep) == F.col("cell"), "left_semi")


def placed(rows: DataFrame, rounds: Directory) -> DataFrame:
    """``rows`` (with ``key``) with the ``bucket`` that the directory gives."""
    out = rows.withColumn("bucket", F.lit(None).cast("long"))
    for cells, deep in rounds:
        told = cells.filter("bucket IS NOT NULL").select("cell", F.col("bucket").alias("told"))
        told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told
        out = out.withColumn("cell", _cell(deep)).join(told, "cell", "left").withColumn("bucket", F.coalesce("bucket", "told")).drop("cell", "told")
    return out


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, Directory]:
    """Write the index: ``bucket, key, text_sha256, keep_id, group_size``, one row per distinct text, in ranges of (bucket, key); and its directory."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    rounds = directory(saved(rows.select("key").distinct(), "keys"), bucket_keys)
    chains = placed(rows, rounds).groupBy("bucket", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    owned = chains.select("bucket", "key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    return saved(owned.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index"), rounds


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    index, rounds = build_index(docs, id_col, text_col, bucket_keys)
    text = text_or_empty(text_col)
    rows = placed(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256")), rounds)
    return rows.join(index, ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with the columns of ``docs``: the one with the largest id; of rows that repeat it, any."""
    index, rounds = build_index(docs, id_col, text_col)
    text = text_or_empty(text_col)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = placed(docs.select(whole.alias("whole"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("text_sha256")), rounds)
    winners = index.select("bucket", "key", "text_sha256", "keep_id")
    chosen = rows.join(winners, ["bucket", "key", "text_sha256"]).filter(F.col("own_id").eqNullSafe(F.col("keep_id")))
    return chosen.groupBy("bucket", "key", "text_sha256").agg(F.first("whole").alias("whole")).select("whole.*")
