"""Near-duplicate detection by an LSH forest of MinHash signatures, confirmed on full shingle sets.

Documents with the same set form a class, and one member stands for it. A tree of the forest orders the representatives by ``DEPTH`` MinHash
values, then id; near copies share long prefixes there. Documents that share at least ``LEAST`` leading values of an order form a region, and all
pairs of a region are candidates. In each order every document first meets its ``REACH`` predecessors of its region. Orders are made by range
partitioning, so a region of any size is spread over tasks, and pairs that straddle two partitions are found from the partitions' edges.

These candidates are confirmed on the documents' full sets, in rounds: the first two take, for every document, the pair that shares most of those
that still join two components; the third takes every pair that still does. What then is left are regions with more documents than predecessors
reach and more than one component: there every pair of documents of different components is compared on full sets, block against block, so a
region of any size is spread over tasks, and each task returns only links that join. Regions of different orders that hold much the same documents are
compared as one, and blocks whose sets' sizes rule a link out don't meet. So no candidate that could change a component is left out.
Components are found by repeated contraction of the links to the smallest neighbour; no task and no driver sees all links.

Defined cases: null text, and text without words, has the empty set (0 shingles) and is linked with nothing; a text of fewer words than a
shingle is one shingle; a text of any length is compared whole; repeated rows share a class, and rows that share an id with different texts are compared each; a component's name is its smallest id; a null id is
never the smallest, and a component of null ids has a null name and no row marked kept, though ``keep_one`` keeps one of it; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBERED, identified, in_arrow, per_process, saved

TREES, DEPTH, LEAST, REACH = 20, 6, 3, 2
#: Documents of a region's block, on average.
BLOCK = 128
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles; words' hashes are kept while the table is below its limit."""

    def __init__(self, width: int, limit: int = 500_000):
        import xxhash

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                h = xxhash.xxh3_64_intdigest(word)
                if len(self) >= limit:
                    self.clear()
                self[word] = h
                return h

        self.width, self.words = width, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct 64-bit shingle hashes."""
        words = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(self.width, len(h))):
            out = _mixed((out + h[i : i + n]) * _MIX + np.uint64(i + 1))
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signatures(docs: DataFrame, width: int, trees: int = TREES, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set_id`` (128 bits of the whole set) and ``sig`` (``trees * depth`` 32-bit MinHash values)."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingles = per_process(("shingler", width), lambda: Shingler(width))
        for batch in batches:
            n, names, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig, low = np.full(len(a), np.uint32(0xFFFFFFFF)), s.astype(np.uint32)
                for i in range(0, len(s), 512):  # blocks stay in the cache
                    sig = np.minimum(sig, (low[i : i + 512, None] * a).min(axis=0))
                sigs.append(sig.astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "sig"],
            )

    schema = "doc_id long, n_shingles long, set_id binary, sig binary"
    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), signed, schema)


def neighbours(reps: DataFrame, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """Candidate pairs ``a < b`` with ``shared``, the values their prefixes share in all orders together; ``reps`` has ``doc_id, sig``."""
    size, head = 4 * depth, 4 * least
    rows = reps.select("doc_id", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(sig, 1 + {size} * tree, {size})").alias("key"), "doc_id")
    order = rows.repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs inside a partition, and the partition's first and last rows (their tree and key, with ``b`` null)."""
        names, kinds = ["a", "b", "shared", "tree", "key"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

        def batch_of(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        ids, tree, keys, first = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, depth), np.uint32), True
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(ids)
            fresh = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, depth)
            ids = np.concatenate([ids, batch.column(2).to_numpy()])
            tree = np.concatenate([tree, batch.column(0).to_numpy()])
            keys = np.concatenate([keys, fresh])
            edge = [slice(0, reach)] * first
            a, b, shared = [], [], []
            for k in range(1, min(reach, len(ids) - 1) + 1):
                same = np.logical_and.accumulate(keys[k:] == keys[:-k], axis=1).sum(axis=1, dtype=np.int32)
                near = (tree[k:] == tree[:-k]) & (same >= least) & (np.arange(k, len(ids)) >= old)
                x, y = ids[:-k][near], ids[k:][near]
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                shared.append(same[near])
            for e in edge:
                yield batch_of(ids[e], [None] * len(ids[e]), [0] * len(ids[e]), tree[e], [x.tobytes() for x in keys[e]])
            if a:
                a, b, shared = map(np.concatenate, (a, b, shared))
                yield batch_of(a, b, shared, [None] * len(a), [None] * len(a))
            first = False
            ids, tree, keys = ids[-reach:], tree[-reach:], keys[-reach:]
        yield batch_of(ids, [None] * len(ids), [0] * len(ids), tree, [x.tobytes() for x in keys])

    held = saved(in_arrow(order, found, "a long, b long, shared int, tree int, key binary"), "orders")
    # partitions' ends meet: a few rows of each partition, by tree
    ends, w = held.filter("b is null").select("tree", "key", F.col("a").alias("doc_id")).distinct(), "over (partition by tree order by key, doc_id)"
    met = ends.select("doc_id", "key", *(F.expr(f"lag(struct(doc_id, key), {k}) {w}").alias(f"p{k}") for k in range(1, reach + 1)))
    met = met.select("doc_id", "key", F.explode(F.array(*(f"p{k}" for k in range(1, reach + 1)))).alias("p")).filter(
        F.expr(f"substring(p.key, 1, {head}) = substring(key, 1, {head}) and p.doc_id <> doc_id")
    )
    met = met.select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"), F.lit(least).alias("shared"))
    return held.filter("b is not null").select("a", "b", "shared").unionByName(met).groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have ``100 * intersection >= percent * union``; ``texts`` has ``doc_id, text``."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = per_process(("shingler", width), lambda: Shingler(width))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = shingles(x), shingles(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return in_arrow(rows, checked, "a long, b long")


def components(links: DataFrame, levels: int | None = None) -> DataFrame:
    """``node, comp`` for every node of ``links`` (``a, b``): the smallest node that it reaches; after ``levels`` contractions if given, one at
    least as small as its neighbours, which may not be the smallest yet."""
    edges, labels, level = saved(links.select("a", "b"), "links"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "up")
        top = up.join(up.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", "top")
        step = top.join(top.select(F.col("a").alias("top"), F.col("top").alias("root")), "top").select("a", "root")
        step = saved(step, "step")
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("root").alias("comp"))
        else:
            found = labels.join(step.select(F.col("a").alias("comp"), "root"), "comp", "left")
            labels = saved(found.select("node", F.coalesce("root", "comp").alias("comp")), "labels")
        level += 1
        if level == levels:
            return labels
        to = lambda k: step.select(F.col("a").alias(k), F.col("root").alias(f"r{k}"))  # noqa: E731,B023
        rest = edges.join(to("a"), "a").join(to("b"), "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = saved(rest, "links")
        if edges.isEmpty():
            return labels


def _best(pairs: DataFrame) -> DataFrame:
    """Each document's pair that shares most."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), F.struct("shared", "a", "b").alias("pair"))
    return sides.groupBy("doc_id").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def joining(ids: list[int], comps: list[int], blocks: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of one block, or of two blocks' documents, that are alike enough and of different components; of those only what joins more."""
    blocks = np.array(blocks)
    left = np.flatnonzero(blocks == blocks.min())
    right = np.flatnonzero(blocks == blocks.max())
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1  # what only one document has is in no intersection
    shared = times[at] > 1
    at, row = place[at[shared]], row[shared]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    both = np.zeros((len(left), len(right)), np.int64)
    step = 1 << 15  # bits of a document at once
    for lo in range(0, int((times > 1).sum()), step):
        i, j = np.searchsorted(at, (lo, lo + step))
        has = np.zeros((len(sets), min(step, -(-int(at[-1] + 1 - lo) // 64) * 64)), bool)
        has[row[i:j], at[i:j] - lo] = True
        bits = np.packbits(has, axis=1).view(np.uint64)
        ours = bits[right]
        for k, n in enumerate(left.tolist()):
            both[k] += np.bitwise_count(ours & bits[n]).sum(axis=1, dtype=np.int64)
    comp = np.array(comps)
    alike = (100 * both >= percent * (size[left][:, None] + size[right] - both)) & (comp[left][:, None] != comp[right])
    x, y = (k[n] for k, n in zip((left, right), np.nonzero(alike), strict=True))
    _, first = np.unique(np.stack([np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])]), axis=1, return_index=True)
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    out = []
    for k in first.tolist():
        a, b = top(comps[x[k]]), top(comps[y[k]])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((min(ids[x[k]], ids[y[k]]), max(ids[x[k]], ids[y[k]])))
    return out


def meetings(reps: DataFrame, labels: DataFrame, percent: int, broadcast_ids: int, reach: int = REACH) -> DataFrame:
    """``region, i, j, block, doc_id, comp``: the documents of blocks ``i`` and ``j`` that meet, inside the regions that predecessors don't cover;
    ``reps`` has ``doc_id, n_shingles, sig``, ``labels`` has ``node, comp``."""
    size, head = 4 * DEPTH, 4 * LEAST
    own = reps.select("doc_id", "n_shingles", "sig").join(labels.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left")
    own = own.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("comp"), "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = saved(own.select(F.expr(f"xxhash64(tree, substring(sig, 1 + {size} * tree, {head}))").alias("region"), "doc_id", "n_shingles", "comp"), "regions")
    # regions of the same documents are one: two 64-bit sums without carry tell their members apart
    hold = [F.count(F.lit(1)).alias("n"), *(F.expr(f"bit_xor(xxhash64(doc_id, {k}))").alias(f"x{k}") for k in (0, 1)), F.expr("min(xxhash64(doc_id, 3))").alias("first")]
    open_ = rows.groupBy("region").agg(*hold, F.min("comp").alias("low"), F.max("comp").alias("high")).filter((F.col("n") > reach + 1) & (F.col("low") < F.col("high")))
    open_ = saved(open_.groupBy("n", "x0", "x1", "first").agg(F.min("region").alias("region")).select("region", "first", "n"), "open")
    small = (lambda t: F.broadcast(t)) if open_.count() <= broadcast_ids else (lambda t: t)
    members = saved(rows.join(small(open_), "region"), "members")
    # orders put much the same documents into a region; such regions have their first document in common and are one where that makes fewer pairs
    one = members.groupBy("first").agg(F.count_distinct("doc_id").alias("u")).join(open_.groupBy("first").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")), "first")
    one = saved(one.filter("u * u < pairs").select("first", F.lit(True).alias("one")), "merged")
    members = members.join(small(one), "first", "left").select(F.expr("if(one, first, region)").alias("region"), "doc_id", "n_shingles", "comp").distinct()
    members = saved(members, "members")
    # sets whose sizes differ too much can't be alike: regions of several blocks are dealt by size, and blocks meet where sizes allow a link
    wide = members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("region", F.lit(True).alias("wide"))
    cell = F.when(F.col("wide"), F.floor(F.log("n_shingles") / math.log(100 / min(percent, 99)))).otherwise(0).alias("cell")
    members = saved(members.join(small(wide), "region", "left").select("region", "doc_id", "n_shingles", "comp", cell), "celled")
    # a large component of a region has blocks of its own, which needn't meet each other; the others are dealt out by component
    sizes = saved(members.groupBy("region", "cell", "comp").agg(F.count(F.lit(1)).alias("m")), "sizes")
    large = sizes.filter(F.col("m") > BLOCK).select("region", "cell", "comp", F.ceil(F.col("m") / BLOCK).alias("own"))
    others = sizes.filter(F.col("m") <= BLOCK).groupBy("region", "cell").agg(F.ceil(F.sum("m") / BLOCK).alias("blocks"))
    dealt = members.join(small(large), ["region", "cell", "comp"], "left").join(small(others), ["region", "cell"], "left")
    block = "if(own IS NULL, xxhash64(cell, pmod(xxhash64(comp, 2), blocks)), xxhash64(comp, cell, pmod(xxhash64(doc_id, 2), own)))"
    dealt = saved(dealt.select("region", "doc_id", "n_shingles", "comp", F.expr(block).alias("block"), F.expr("if(own IS NULL, NULL, comp)").alias("alone")), "dealt")
    blocks = saved(dealt.groupBy("region", "block", "alone").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high")), "blocks")
    left, right = (blocks.select("region", F.col("block").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("alone", "low", "high"))) for k in "ij")
    met = left.join(right, "region").filter("i <= j AND NOT coalesce(alone_i = alone_j, false)")
    met = met.filter(f"100 * high_i >= {percent} * low_j AND 100 * high_j >= {percent} * low_i").select("region", "i", "j")
    sides = met.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return dealt.join(small(sides), ["region", "block"]).select("region", "i", "j", "block", "doc_id", "comp")


def crowded(reps: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int, broadcast_ids: int, reach: int = REACH) -> DataFrame:
    """Links ``a, b`` that join components (``labels``: ``node, comp``) inside the regions that predecessors don't cover; ``docs`` has ``doc_id, text``."""
    met = meetings(reps, labels, percent, broadcast_ids, reach)
    rows = met.join(docs.select("doc_id", "text"), "doc_id").select("region", "i", "j", "block", "doc_id", "comp", "text")

    def compared(group: pa.Table) -> pa.Table:
        shingles = per_process(("shingler", width), lambda: Shingler(width))
        i, j, block, ids, comps = (group.column(k).to_pylist() for k in ("i", "j", "block", "doc_id", "comp"))
        found = []
        if len(set(comps)) > 1 and (i[0] == j[0] or len(set(block)) > 1):
            found = joining(ids, comps, block, [shingles(t) for t in group.column("text").to_pylist()], percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("region", "i", "j").applyInArrow(compared, "a long, b long")


def labelled(rows: DataFrame, width: int, percent: int, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``doc_id, n_shingles, component``; ``rows`` has ``doc_id, text``, and no id twice."""
    sigs = saved(signatures(rows, width), "signatures")
    sets = sigs.filter("set_id is not null")
    reps = saved(sets.groupBy("set_id").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("rep")).select("set_id", "rep.*"), "sets")
    pairs = saved(neighbours(reps), "pairs")
    # only texts of candidates are needed again; their ids are broadcast where they are few enough
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    few = ids.count() <= broadcast_ids
    texts = saved(rows.join(F.broadcast(ids) if few else ids, "doc_id"), "texts")
    links = saved(confirmed(_best(pairs), texts, width, percent), "confirmed")
    for last in (False, True):
        labels = components(links, 2)
        of = lambda k: labels.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}"))  # noqa: E731,B023
        live = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        live = live.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "shared")
        asked = live if last else _best(live)
        links = saved(links.unionByName(confirmed(asked, texts, width, percent)), "confirmed")
    labels = components(links)
    joined = saved(crowded(reps, labels, rows, width, percent, broadcast_ids), "joined")
    if not joined.isEmpty():
        labels = components(links.unionByName(joined))
    named = reps.select("set_id", F.col("doc_id").alias("node")).join(labels, "node", "left")
    named = saved(named.select("set_id", F.coalesce("comp", "node").alias("component")), "named")
    out = sigs.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def _own_ids(found: DataFrame, shared: DataFrame) -> DataFrame:
    """``found`` (``doc_id, n_shingles, component``) with rows' own ids as ``own_id``, and of its component the smallest as ``name`` and the row that has it as ``stays``."""
    own = found.join(shared.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("shared_id")), "doc_id", "left")
    own = saved(own.withColumn("own_id", F.when(F.col("doc_id") < NUMBERED, F.col("doc_id")).otherwise(F.col("shared_id"))), "own")
    first = F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "doc_id")).alias("first")
    names = own.groupBy("component").agg(first).select("component", F.col("first.own_id").alias("name"), F.col("first.doc_id").alias("stays"))
    return own.join(names, "component")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    rows, shared = identified(docs, id_col, text_col)
    found = labelled(rows, width, percent, broadcast_ids).withColumnRenamed("component", "component_id")
    if shared is not None:
        found = _own_ids(found.withColumnRenamed("component_id", "component"), shared)
        found = found.select(F.col("own_id").alias("doc_id"), "n_shingles", F.col("name").alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with its columns; needs ``doc_id`` and ``text``."""
    rows, shared = identified(docs)
    found = labelled(rows, width, percent)
    if shared is None:
        return docs.join(found.filter("doc_id = component").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    stay = saved(_own_ids(found, shared).filter("doc_id = stays").select("doc_id"), "stay")
    plain = docs.join(stay, "doc_id", "left_semi").select(*docs.columns)
    # rows without an id of their own are found again by id and text; equal ones are in one component, of which one stays
    chosen = shared.join(stay.select(F.col("doc_id").alias("number")), "number").select("number", F.col("doc_id").alias("shared_id"), F.col("text").alias("shared_text"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    again = docs.select(whole, F.col("doc_id").cast("long").alias("own_id"), F.col("text").alias("own_text"))
    again = again.join(chosen, F.col("own_id").eqNullSafe(F.col("shared_id")) & F.col("own_text").eqNullSafe(F.col("shared_text")))
    return plain.unionByName(again.groupBy("number").agg(F.first("whole").alias("whole")).select("whole.*"))
