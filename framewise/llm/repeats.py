"""Removal of repeated substrings by merged, sampled suffix arrays.

Every string of ``LENGTH`` bytes that starts at two places or more is to be found. Suffixes are sampled at anchors: of the ``GRAM``-byte grams of
each string, the one with the smallest hash (the leftmost of equals) is its anchor, so equal strings have their anchor at the same offset, and
the strings of a document fall into runs with one anchor. A run's bytes, with the anchor's place in them, are a block.

Only anchors whose gram occurs twice can matter; a bit map of a fixed number of bits tells nearly all others apart, and never loses one. Equal
blocks are counted together, so a passage that a third of all documents share is a few blocks. Blocks with one gram are compared as anchored
suffixes: each shard sorts its suffixes, and keeps what stands before each of them, as a Burrows-Wheeler transform does; shards are then merged
by refining their interleave eight bytes at a time, in which only intervals that still hold several suffixes take part and no shard is sorted
again. Common prefixes of neighbours in the merged order give, for each offset of the anchor, the intervals of suffixes that agree on the
rest of the string; those that also agree on the bytes before the anchor are repeats. Grams with very many different blocks go another way to
the same result: what the strings of twenty neighbouring offsets have in common is dealt out and counted by a 128-bit hash, and then, where that
repeats, the strings themselves.

The plain method, all suffixes of all shards with one pass over the interleave per byte of the longest repeat, needs about 200 passes over the
corpus; sampling makes that passes over what repeats, with the same result.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` have no such string; a text of any length is read whole; rows without an id of their own (null, or one that
another row has too) are documents of their own, and rows that repeat a row are its copies; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, in_arrow, saved

LENGTH, GRAM = 200, 40
OFFSETS = LENGTH - GRAM + 1
PIECE = 1 << 19
PLACE = 20
#: Bits of the map of grams, in segments of 32 KB.
MAP_BITS, SEGMENT_BITS = 27, 18
SHARD, BLOCKS = 4096, 32_768
#: Blocks of one gram beyond which its strings are dealt out, and bytes of spans that may be broadcast.
CROWDED, BROADCAST = 2000, 32 << 20
#: Offsets of the anchor that are told apart together before single strings are.
STRATUM = 20
HELD = 150_000
_TABLE = np.random.default_rng(40).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place where they fit (40 = 32 + 8)."""
    h = _TABLE[data]
    eight = None
    for i in range(5):
        step = 1 << i
        h = h[:-step] * _ODD[i] + h[step:]
        if step == 4:
            eight = h
    h = h[: len(h) - 8] * _ODD[5] + eight[32:]
    h ^= h >> np.uint64(29)
    h *= _ODD[4]
    h ^= h >> np.uint64(32)
    return h


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of strings with one anchor in many texts: (text, first start, last start, anchor) and the anchors' hashes, all places in the text."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                held.append((i, at, part))
                size += len(part)
                if size >= PIECE // 2:
                    yield _runs(held)
                    held, size = [], 0
    if held:
        yield _runs(held)


def _runs(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in held), np.uint8)
    h = gram_hashes(data)
    best = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= OFFSETS:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[: len(best) - (OFFSETS - width)], best[OFFSETS - width :])
    anchor = (best & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in held])
    starts = sizes.cumsum() - sizes
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + sizes - LENGTH + 1, -1)
    at = np.flatnonzero(valid[: len(anchor)].cumsum())
    a = anchor[at]
    opens = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last, a = at[opens], at[np.concatenate([opens[1:], [len(at)]]) - 1], a[opens]
    piece = np.searchsorted(starts, first, "right") - 1
    shift = np.array([p[1] for p in held])[piece] - starts[piece]
    return np.array([p[0] for p in held])[piece], first + shift, last + shift, a + shift, h[a]


def _bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(x or "").encode("utf-8", "replace") for x in batch.column(column).to_pylist()]


def gram_map(docs: DataFrame) -> DataFrame:
    """``segment, bits``: a bit for the hash of every gram that anchors two runs or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for *_, h in _pieces(_bytes(batch, 0))]
            if found:
                grams, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["gram", "n"])

    twice = in_arrow(docs.select("text"), counted, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    low = (1 << MAP_BITS) - 1
    places = twice.select(F.col("gram").bitwiseAND(low).alias("place"))
    places = places.select(F.shiftright("place", SEGMENT_BITS).alias("segment"), F.col("place").bitwiseAND((1 << SEGMENT_BITS) - 1).alias("bit"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One map of the task's bits for each of its segments; there are ``2 ** (MAP_BITS - SEGMENT_BITS)`` segments in all."""
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in np.unique(segment).tolist():
                maps.setdefault(s, np.zeros(1 << SEGMENT_BITS, bool))[bit[segment == s]] = True
        packed = [np.packbits(m).tobytes() for m in maps.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int64()), pa.array(packed, pa.binary())], names=["segment", "bits"])

    return in_arrow(places.repartition("segment"), mapped, "segment long, bits binary")


def blocks_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """Blocks whose gram is in the map: rows with ``block`` (bytes; ``gram, lead, n`` too), combined in the task, and rows with ``doc_id, start,
    strings`` for each place; and for every document one with ``n_bytes, sha256``. ``name`` is a block's 128-bit hash."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["name", "gram", "lead", "n", "block", "doc_id", "start", "strings", "n_bytes", "sha256"]
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())

    def rows(size: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: dict[bytes, list] = {}

        def blocks() -> pa.RecordBatch:
            keys = list(held)
            out = rows(len(keys), name=[held[b][0] for b in keys], gram=[held[b][1] for b in keys], lead=[held[b][2] for b in keys], n=[held[b][3] for b in keys], block=keys)
            held.clear()
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _bytes(batch, 1)
            yield rows(len(ids), doc_id=ids, n_bytes=[len(t) for t in texts], sha256=[hashlib.sha256(t).hexdigest() for t in texts])
            out: list[list] = [[], [], [], []]
            for text, first, last, anchor, gram in _pieces(texts):
                place = gram & np.uint64((1 << MAP_BITS) - 1)
                live = (bits[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
                for t, a, z, p, g in zip(*(x[live].tolist() for x in (text, first, last, anchor, gram.view(np.int64))), strict=True):
                    block = texts[t][a : z + LENGTH]
                    known = held.get(block)
                    if known is None:
                        known = held[block] = [xxhash.xxh3_128_digest(block), g, p - a, 0]
                    known[3] += 1
                    out[0].append(known[0])
                    out[1].append(ids[t])
                    out[2].append(a)
                    out[3].append(z - a + 1)
            yield rows(len(out[0]), name=out[0], doc_id=out[1], start=out[2], strings=out[3])
            if len(held) >= HELD:
                yield blocks()
        yield blocks()

    return in_arrow(docs, cut, ", ".join(f"{c} {t}" for c, t in zip(names, "binary long int long binary long long int long string".split(), strict=True)))


def merged_order(gram: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The order of suffixes by (gram, words): shards' own orders, merged by refining their interleave word by word.

    ``at`` lists the suffixes interleaved so far, ``interval`` the interval of each place. A pass orders the places of the intervals that still
    hold several suffixes by the next word; sorts are stable, so runs that the shards have in order are merged, not sorted again.
    """
    n = len(gram)
    shards = []
    for i in range(0, n, SHARD):
        part = np.arange(i, min(i + SHARD, n))
        shards.append(part[np.lexsort(tuple(words[part, j] for j in range(words.shape[1] - 1, -1, -1)))])
    at = np.concatenate(shards) if shards else np.zeros(0, np.int64)
    at = at[np.argsort(gram[at], kind="stable")]
    fresh = np.concatenate([[True], gram[at[1:]] != gram[at[:-1]]]) if n else np.zeros(0, bool)
    for j in range(words.shape[1]):
        interval = fresh.cumsum()
        several = np.flatnonzero(np.bincount(interval)[interval] > 1)
        if not len(several):
            break
        order = np.lexsort((words[at[several], j], interval[several]))
        at[several] = at[several[order]]
        word, own = words[at[several], j], interval[several]
        split = np.concatenate([[False], (word[1:] != word[:-1]) & (own[1:] == own[:-1])])
        fresh[several[split]] = True
    return at


def repeated_offsets(gram: np.ndarray, lead: np.ndarray, blocks: list[bytes], n: np.ndarray) -> np.ndarray:
    """(blocks, OFFSETS) flags: whether the block's string with its anchor at that offset starts elsewhere too."""
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    right = np.frombuffer(b"".join(b[k:].ljust(LENGTH, b"\0")[:LENGTH] for b, k in zip(blocks, lead.tolist(), strict=True)), ">u8").reshape(len(blocks), -1)
    left = np.frombuffer(b"".join(b[:k][::-1].ljust(OFFSETS, b"\0") for b, k in zip(blocks, lead.tolist(), strict=True)), np.uint8).reshape(len(blocks), OFFSETS)
    at = merged_order(gram, right.astype(np.uint64))
    lead, size, n, left, gram, words = lead[at], size[at], n[at], left[at], gram[at], right[at].astype(np.uint64)
    # bytes that neighbours have in common from the anchor on
    other = words[1:] != words[:-1]
    word = other.argmax(axis=1)
    x = (words[1:] ^ words[:-1])[np.arange(len(word)), word]
    common = np.where(other.any(axis=1), 8 * word + _leading_zero_bytes(x), LENGTH)
    common = np.concatenate([[0], np.where(gram[1:] == gram[:-1], common, 0)]) if len(at) else np.zeros(0, np.int64)
    low = lead - (size - LENGTH)
    flags = np.zeros((len(at), OFFSETS), bool)
    before = np.zeros(len(at), np.uint64)
    for o in range(OFFSETS):
        if o:
            before = before * _ODD[0] + left[:, o - 1].astype(np.uint64) + np.uint64(1)
        valid = np.flatnonzero((low <= o) & (o <= lead))
        if len(valid) > 1:
            key = (common < LENGTH - o).cumsum().astype(np.uint64)[valid] * _ODD[1] + before[valid] * _ODD[2]
            key ^= key >> np.uint64(31)
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            hit = np.zeros(len(valid), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            flags[valid[hit], o] = True
        flags[valid, o] |= n[valid] > 1
    out = np.empty_like(flags)
    out[at] = flags
    return out


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    return (x[:, None] >> np.arange(56, -8, -8, dtype=np.uint64)[None] & np.uint64(255) != 0).argmax(axis=1)


def resolved(blocks: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``name, flags`` of the blocks with a repeated string; ``blocks``: name, gram, lead, block, n (written, one row each).

    ``flags`` are packed bits by offset of the anchor, from the largest on, so in the order of the strings' starts; null where all repeat.
    """
    many = saved(blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "grams")
    whole = blocks.filter("n > 1").select("name", F.lit(None).cast("binary").alias("flags"))
    open_ = blocks.join(many, "gram")
    narrow, wide = open_.filter(F.col("k") <= crowded), saved(open_.filter(F.col("k") > crowded), "crowded")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            if held.num_rows >= BLOCKS:
                grams = held.column(1).to_numpy()
                done = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on in the next batch
                yield from _flagged(held.slice(0, done))
                held = held.slice(done)
        if held is not None:
            yield from _flagged(held)

    columns = ["name", "gram", "lead", "n", "block"]
    dealt = narrow.select(*columns).repartition("gram").sortWithinPartitions("gram")
    found = in_arrow(dealt, compared, "name binary, flags binary")

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stratum of offsets that a block has, the bytes that all strings of that stratum contain."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, lead, n, block in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                for k in range((lead - len(block) + LENGTH) // STRATUM, lead // STRATUM + 1):
                    at = lead - k * STRATUM
                    core = xxhash.xxh3_128_digest(block[at : at + LENGTH - STRATUM + 1])
                    for col, x in zip(out, (core, name, k, n), strict=True):
                        col.append(x)
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["core", "name", "k", "n"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of the strata ``ks`` of each block."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, lead, n, block, ks in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                for k in ks:
                    for i in range(max(0, lead - k * STRATUM - STRATUM + 1), min(len(block) - LENGTH, lead - k * STRATUM) + 1):
                        for col, x in zip(out, (xxhash.xxh3_128_digest(block[i : i + LENGTH]), name, i, n), strict=True):
                            col.append(x)
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["string", "name", "i", "n"])

    # a string can only repeat where its stratum's core does
    held = saved(in_arrow(wide.select(*columns), cores, "core binary, name binary, k int, n long"), "cores")
    shared = saved(held.groupBy("core").agg(F.sum("n").alias("c")).filter("c > 1").select("core"), "shared-cores")
    strata = saved(held.join(shared, "core").groupBy("name").agg(F.collect_list("k").alias("ks")), "strata")
    dealt = wide.select(*columns).join(strata, "name").select(*columns, "ks")
    dealt = saved(in_arrow(dealt, strings, "string binary, name binary, i int, n long"), "strings")
    twice = saved(dealt.groupBy("string").agg(F.sum("n").alias("c")).filter("c > 1").select("string"), "repeated")
    listed = dealt.filter("n = 1").join(twice, "string").groupBy("name").agg(F.collect_list("i").alias("at"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for at in batch.column(1).to_pylist():
                row = np.zeros(OFFSETS, bool)
                row[at] = True
                flags.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.binary())], names=["name", "flags"])

    return whole.unionByName(found).unionByName(in_arrow(listed, packed, "name binary, flags binary"))


def _flagged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    gram, lead, n = rows.column(1).to_numpy(), rows.column(2).to_numpy().astype(np.int64), rows.column(3).to_numpy()
    flags = repeated_offsets(gram, lead, rows.column(4).to_pylist(), n)
    hit = np.flatnonzero(flags.any(axis=1) & (n == 1))
    # the string that starts first has its anchor at the largest offset
    ordered = np.zeros((len(hit), OFFSETS), bool)
    for k, r in enumerate(hit.tolist()):
        ordered[k, : lead[r] + 1] = flags[r, lead[r] :: -1]
    packed = [np.packbits(x).tobytes() for x in ordered]
    yield pa.RecordBatch.from_arrays([pa.array(rows.column(0).take(pa.array(hit)).to_pylist(), pa.binary()), pa.array(packed, pa.binary())], names=["name", "flags"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of half-open intervals, joined where they overlap or touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    opens = np.concatenate([[True], spans[1:, 0] > ends[:-1]])
    return np.stack([spans[opens, 0], ends[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(spans) - 1]])]], axis=1)


def repeat_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, spans``: the removed bytes as little-endian 64-bit pairs, half-open, for documents that have any; ``doc_id, n_bytes, sha256``)."""
    rows = docs.select("doc_id", "text")
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in gram_map(rows).toLocalIterator():  # 16 MB in all
        at = r["segment"] << (SEGMENT_BITS - 3)
        bits[at : at + (1 << (SEGMENT_BITS - 3))] |= np.frombuffer(r["bits"], np.uint8)
    cut = saved(blocks_of(rows, bits), "blocks")
    blocks = cut.filter("block is not null").groupBy("name", "gram", "lead", "block").agg(F.sum("n").alias("n"))
    flags = saved(resolved(saved(blocks, "distinct")), "flags")
    places = cut.filter("start is not null").select("name", "doc_id", "start", "strings").join(flags, "name").select("doc_id", "start", "strings", "flags")

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, a, b = [], [], []
            for doc, start, k, flags in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if flags is None:
                    runs = [(0, k)]
                else:
                    on = np.concatenate([[0], np.unpackbits(np.frombuffer(flags, np.uint8))[:k].astype(np.int8), [0]])
                    edge = np.flatnonzero(on[1:] != on[:-1])
                    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                for x, y in runs:
                    ids.append(doc)
                    a.append(start + x)
                    b.append(start + y - 1 + LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, a, b)], names=["doc_id", "a", "b"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1):
                pairs = np.stack([spans.values.field(i).to_numpy() for i in (0, 1)], axis=1)
                out.append(merged(pairs).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "spans"])

    listed = in_arrow(places, covered, "doc_id long, a long, b long").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("s"))
    spans = saved(in_arrow(listed, joined, "doc_id long, spans binary"), "spans")
    return spans, cut.filter("n_bytes is not null").select("doc_id", "n_bytes", "sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``."""
    rows, shared = identified(docs)
    spans, whole = repeat_spans(rows)
    size = spans.agg(F.coalesce(F.sum(F.octet_length("spans") + 24), F.lit(0))).first()[0]
    hit = rows.join(F.broadcast(spans) if size <= BROADCAST else spans, "doc_id")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch, 1)
            n, runs, shas = [], [], []
            for text, packed in zip(texts, batch.column(2).to_pylist(), strict=True):
                cut, kept, at = np.frombuffer(packed, "<i8").reshape(-1, 2), hashlib.sha256(), 0
                for a, b in cut.tolist():
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                n.append(int((cut[:, 1] - cut[:, 0]).sum()))
                runs.append(len(cut))
                shas.append(kept.hexdigest())
            arrays = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    found = in_arrow(hit, removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary")
    ids = spans.select("doc_id")
    rest = whole.join(F.broadcast(ids) if size <= BROADCAST else ids, "doc_id", "left_anti")
    zero = F.lit(0).cast("long")
    out = found.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast("binary").alias("spans")))
    if shared is None:
        return out
    own = shared.select(F.col("number").alias("doc_id"), F.lit(True).alias("numbered"), F.col("doc_id").alias("shared_id"))
    own = out.join(own, "doc_id", "left")
    return own.select(F.when(F.col("numbered"), F.col("shared_id")).otherwise(F.col("doc_id")).alias("doc_id"), *out.columns[1:])
