"""Byte-level BPE by a fold of ranked merges in Spark's higher-order functions; each distinct word of the corpus is folded once.

A text is split by the tokenizer's pattern; each match (a word here) is encoded by itself: an array of one-byte binaries is folded, every step
joining the leftmost neighbouring pair of the lowest rank, until no pair has a rank. Ranks come from a literal map; Spark searches a map
literal from its start, so the literal is an array of small maps that the pair's hash selects from. A word of over ``SHORT`` bytes takes steps that
join all places of the lowest pair at once, which gives the same as long as a longer piece has a higher rank than the pieces that it is
made of, as in every vocabulary that merges were learnt for.

Documents are read in chunks of bounded size. A chunk numbers its distinct words and is written as numbers, with its dictionary dealt out by
the words' hash; equal words of all chunks meet in a bucket, byte by byte, are folded there once, and their ids go back to the chunks that asked.
So no word is looked up by hash alone, nothing is brought to the driver, and no table is broadcast; a frequent word is sent once for each chunk.
Decoding concatenates the ids' binary pieces.

Defined cases: null texts count as empty and have no ids; null ids stay null; an empty table gives an empty result; repeated rows are encoded
each; extra columns are ignored, whatever their names. A lone surrogate can't be stored in Spark, so every text has UTF-8 bytes. A run of letters of any length
is one word, and is folded whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bounded_batches, bucketed, in_arrow, ragged, release

#: Bytes of texts in a chunk (a longer text is a chunk of its own) and words in a block of its documents.
CHUNK, BLOCK = 12 << 20, 1 << 16
#: Distinct words that are folded in one row.
SLICE = 4096
#: Bytes of the estimated input for each bucket of words, and the least and most buckets.
BUCKET_BYTES, BUCKETS = 4 << 20, (256, 1 << 17)
CELLS = 32768
SHORT = 64
_BLANK = regex.compile(r"(?<=\S)(?= \S)")
#: White space other than single blanks and single line feeds between other characters; such texts are split with the pattern itself.
_ODD = r"^[ \n]|[ \n][ \n]|[ \n]$|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A blank, letters and then signs; whatever the letters, the pattern matches both parts by themselves.
_PLAIN = r'^(?P<w> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<s>[.,;:!?|#&*%$()"/-]*)$'


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Splitter:
    """Splits texts into the pattern's matches. A blank between two other characters always begins a match, and a single line feed between two
    others is one, so texts are first cut there."""

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)

    def parts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
        """The order in which rows are taken, where each one's parts begin (and the last ends), the parts' numbers, and the distinct parts."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", "\0 "), "\n", "\0\n\0")
        lists = [pc.split_pattern(marked, "\0")]
        if len(rest):
            lists.append(pa.array([_BLANK.split(t) for t in texts.take(pa.array(rest)).to_pylist()], pa.list_(pa.string())))
        lists = pa.concat_arrays(lists)
        coded = lists.flatten().dictionary_encode()
        return np.concatenate([plain, rest]), lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy(), coded.dictionary

    def words(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
        """How many words each part has, their numbers, and the distinct words."""
        found = pc.extract_regex(parts, _PLAIN)
        is_plain = found.is_valid().to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        word, signs = (found.field(k).take(pa.array(plain)) for k in ("w", "s"))
        signed = pc.not_equal(signs, "").to_numpy(zero_copy_only=False)
        others = [self.pattern.findall(p) for p in parts.take(pa.array(rest)).to_pylist()]
        sizes = np.zeros(len(parts), np.int64)
        sizes[plain] = 1 + signed
        sizes[rest] = np.fromiter(map(len, others), np.int64, len(others))
        starts = sizes.cumsum() - sizes
        coded = pa.concat_arrays([word, signs.filter(pa.array(signed)), pa.array([w for ws in others for w in ws], pa.string())]).dictionary_encode()
        code, out = coded.indices.to_numpy(), np.zeros(int(sizes.sum()), np.int64)
        out[starts[plain]] = code[: len(plain)]
        out[starts[plain[signed]] + 1] = code[len(plain) : len(plain) + int(signed.sum())]
        out[ragged(starts[rest], sizes[rest])] = code[len(plain) + int(signed.sum()) :]
        return sizes, out, coded.dictionary


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, first all their lowest bytes, and so on; small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def rank_literal(ranks: dict[bytes, int]) -> str:
    """SQL that Spark folds into a literal: an array of ``CELLS`` maps from a piece in hex to its rank, in the order of ``crc32(piece) % CELLS``."""
    cells: list[dict[str, int]] = [{} for _ in range(CELLS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        cells[zlib.crc32(name.encode()) % CELLS][name] = rank
    return f"from_json('{json.dumps(cells)}', 'array<map<string,int>>')"


def with_ids(words: DataFrame, word_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """``words`` with ``ids``: for each string of the array column ``word_col``, the array of its ids."""
    fold = fold_sql("w", "ranks")
    return words.withColumn("ids", F.expr(f"transform(array({rank_literal(ranks)}), ranks -> transform(`{word_col}`, w -> {fold}))[0]"))


def _rank(piece: str, ranks: str) -> str:
    return f"{ranks}[cast(crc32({piece}) % {CELLS} as int)][{piece}]"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def fold_sql(word: str, ranks: str) -> str:
    """SQL for the ids of one word: its own id where it is a piece, else by the fold."""
    folded = f"if(octet_length({word}) <= {SHORT}, {_short(word, ranks)}, {_long(word, ranks)})"
    return _let(_rank(f"hex({word})", ranks), "own", f"if(own IS NOT NULL, array(own), {folded})")


def _short(word: str, ranks: str) -> str:
    """The word's bytes are an array of pieces written in hex, which joins as the bytes do, between two marks that have no rank with anything.
    Each step of the fold joins the leftmost pair of the lowest rank and ranks the two pairs that this makes."""
    none = 2147483647
    ranked = lambda piece: f"coalesce({_rank(piece, ranks)}, {none})"
    chars = f"concat(array('-'), regexp_extract_all(hex({word}), '..', 0), array('-'))"
    start = _let(chars, "cs", f"named_struct('acc', cs, 'rs', transform(slice(cs, 2, size(cs) - 1), (b, i) -> {ranked('concat(cs[i], b)')}))")
    acc = "concat(slice(st.acc, 1, p - 1), array(m), slice(st.acc, p + 2, size(st.acc)))"
    rs = f"concat(slice(st.rs, 1, p - 2), array({ranked('concat(st.acc[p - 2], m)')}, {ranked('concat(m, st.acc[p + 1])')}), slice(st.rs, p + 2, size(st.rs)))"
    joined = _let("cast(array_position(st.rs, low) as int)", "p", _let("concat(st.acc[p - 1], st.acc[p])", "m", f"named_struct('acc', {acc}, 'rs', {rs})"))
    step = _let("array_min(st.rs)", "low", f"if(low = {none}, st, {joined})")
    # each step joins one pair, so there are at most as many as bytes
    folded = f"aggregate(sequence(1, greatest(1, octet_length({word}))), {start}, (st, n) -> {step}, st -> slice(st.acc, 2, size(st.acc) - 2))"
    return f"transform({folded}, p -> {_rank('p', ranks)})"


def _long(word: str, ranks: str) -> str:
    """The word is one string of pieces in hex, each in angle brackets, with blanks between. Each step finds the lowest rank among the distinct
    pairs and replaces that pair everywhere, from left to right; once no pair has a rank, steps do nothing."""
    bare = lambda piece: f"substring({piece}, 2, length({piece}) - 2)"
    pairs = "array_distinct(transform(slice(ps, 2, size(ps) - 1), (b, i) -> concat(ps[i], ' ', b)))"
    named = "replace(p, '> <', '')"
    best = f"array_min(filter(transform({pairs}, p -> named_struct('r', {_rank(bare(named), ranks)}, 'p', p)), x -> x.r IS NOT NULL))"
    replaced = f"if(x IS NULL, named_struct('s', st.s, 'on', false), named_struct('s', replace(st.s, x.p, {named.replace('(p,', '(x.p,')}), 'on', true))"
    step = f"if(st.on, {_let("split(st.s, ' ')", 'ps', _let(best, 'x', replaced))}, st)"
    # at most as many steps as bytes; a step copies the state, so those that do nothing are passed over by thousands
    turns = f"sequence(1, 1 + cast(cbrt(octet_length({word})) as int))"
    for _ in range(2):
        step = f"if(st.on, aggregate({turns}, st, (st, n) -> {step}), st)"
    start = f"named_struct('s', concat('<', array_join(regexp_extract_all(hex({word}), '..', 0), '> <'), '>'), 'on', true)"
    folded = f"aggregate({turns}, {start}, (st, n) -> {step}, st -> split(st.s, ' '))"
    return f"transform({folded}, p -> {_rank(bare('p'), ranks)})"


def chunks(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """Documents as numbers of words, and the words. Rows of documents have ``chunk, ids, sizes`` (words of each) and ``block`` (their numbers);
    rows of words have ``chunk, bucket`` and ``block`` (words with their numbers). ``docs`` has ``doc_id, text``."""
    names = ["chunk", "bucket", "ids", "sizes", "block"]
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pack = Splitter(pattern), zstandard.ZstdCompressor(level=3)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
            ids, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
            order, offsets, at, parts = split.parts(texts)
            sizes, flat, words = split.words(parts)
            ids = ids.take(pa.array(order)).to_pylist()
            flat = flat[ragged((sizes.cumsum() - sizes)[at], sizes[at])]
            offsets = np.concatenate([[0], sizes[at].cumsum()])[offsets]
            # frequent words get small numbers
            frequent = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[frequent] = np.arange(len(words))
            flat, words = rank[flat], words.take(pa.array(frequent))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(offsets[:-1], np.arange(BLOCK, offsets[-1], BLOCK)), [len(ids)]])).tolist()
            for i, j in zip(cuts, cuts[1:]):  # noqa: B905
                block = pack.compress(_planes(flat[offsets[i] : offsets[j]]))
                yield rows(1, chunk=[number], ids=[ids[i:j]], sizes=[np.diff(offsets[i : j + 1]).astype(np.int32)], block=[block])
            if len(words):
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % buckets for w in words.to_pylist()), np.int32, len(words))
                order = pc.sort_indices(pa.table({"bucket": bucket, "word": words}), [("bucket", "ascending"), ("word", "ascending")])
                dealt, local = bucket[order.to_numpy()], order.to_numpy().astype(np.int64)
                data, lengths = pc.cast(words.take(order), pa.binary()), pc.binary_length(words.take(order)).to_numpy()
                ends, data = np.concatenate([[0], lengths.cumsum()]), b"".join(data.to_pylist())
                cuts = [0, *(np.flatnonzero(np.diff(dealt)) + 1).tolist(), len(dealt)]
                blocks = [pack.compress(np.array([j - i], "<u4").tobytes() + _planes(lengths[i:j]) + _planes(local[i:j]) + data[ends[i] : ends[j]]) for i, j in zip(cuts, cuts[1:])]  # noqa: B905
                yield rows(len(blocks), chunk=[number] * len(blocks), bucket=dealt[cuts[:-1]], block=blocks)

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= CHUNK:
                yield from chunk(held, number)
                number, held, size = number + 1, [], 0
        if size or held:
            yield from chunk(held, number)

    return in_arrow(docs, read, "chunk long, bucket int, ids array<long>, sizes array<int>, block binary")


def _met(group: pa.Table) -> pa.Table:
    """The distinct words of a bucket, ``SLICE`` a row, and who asked for them: number in the row, chunk, number in the chunk."""
    open_, words, chunk, local = zstandard.ZstdDecompressor(), [], [], []
    for number, block in zip(group.column("chunk").to_pylist(), group.column("block").to_pylist(), strict=True):
        data = open_.decompress(block)
        n = int(np.frombuffer(data, "<u4", 1)[0])
        ends = np.concatenate([[0], _numbers(data[4 : 4 + 4 * n]).cumsum()]).astype(np.int32)
        words.append(pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data[4 + 8 * n :])))
        local.append(_numbers(data[4 + 4 * n : 4 + 8 * n]))
        chunk.append(np.full(n, number))
    coded = pa.concat_arrays(words).dictionary_encode()
    code, chunk, local = coded.indices.to_numpy(), np.concatenate(chunk), np.concatenate(local)
    order = np.argsort(code, kind="stable")
    code, chunk, local = code[order], chunk[order], local[order]
    first = list(range(0, len(coded.dictionary), SLICE))
    cuts = [*np.searchsorted(code, first).tolist(), len(code)]
    refs = [(code[i:j] - k).astype("<u4").tobytes() + chunk[i:j].astype("<i8").tobytes() + local[i:j].astype("<u4").tobytes() for k, i, j in zip(first, cuts, cuts[1:])]  # noqa: B905
    out = pa.table({"words": pa.ListArray.from_arrays(pa.array([*first, len(coded.dictionary)], pa.int32()), coded.dictionary), "refs": pa.array(refs, pa.binary())})
    release()
    return out


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk that asked, ``chunk, block``: numbers in the chunk, how many ids each word has, and the ids."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        numbers, blocks = [], []
        for ids, refs in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            n = len(refs) // 16
            code, chunk, local = (np.frombuffer(refs, t, n, at) for t, at in (("<u4", 0), ("<i8", 4 * n), ("<u4", 12 * n)))
            ends, flat = ids.values.offsets.to_numpy().astype(np.int64), ids.values.values.to_numpy()
            order = np.argsort(chunk, kind="stable")
            code, chunk, local = code[order], chunk[order], local[order]
            sizes = (ends[1:] - ends[:-1])[code]
            flat, at = flat[ragged(ends[:-1][code], sizes)], np.concatenate([[0], sizes.cumsum()])
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), n]
            for i, j in zip(cuts, cuts[1:]):  # noqa: B905
                numbers.append(int(chunk[i]))
                blocks.append(pack.compress(np.array([j - i], "<u4").tobytes() + _planes(local[i:j]) + _planes(sizes[i:j]) + _planes(flat[at[i] : at[j]])))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blocks, pa.binary())], names=["chunk", "block"])


def _placed(docs: pa.Table, words: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """The documents of a chunk with their ids."""
    open_ = zstandard.ZstdDecompressor()
    local, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
    for block in words.column("block").to_pylist():
        data = open_.decompress(block)
        n = int(np.frombuffer(data, "<u4", 1)[0])
        local.append(_numbers(data[4 : 4 + 4 * n]))
        sizes.append(_numbers(data[4 + 4 * n : 4 + 8 * n]))
        flat.append(_numbers(data[4 + 8 * n :]).astype("<u4"))
    local, size, flat = np.concatenate(local), np.concatenate(sizes), np.concatenate(flat)
    sizes, starts = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
    sizes[local], starts[local] = size, size.cumsum() - size
    doc_ids, out = [], []
    for ids, counts, block in zip(docs.column("ids").to_pylist(), docs.column("sizes").to_pylist(), docs.column("block").to_pylist(), strict=True):
        word = _numbers(open_.decompress(block))
        found = flat[ragged(starts[word], sizes[word])].tobytes()
        ends = 4 * np.concatenate([[0], sizes[word].cumsum()])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        doc_ids += ids
        out += [found[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]  # noqa: B905
    return doc_ids, out


Finish = Callable[[list[bytes]], list[pa.Array]]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", finish: tuple[Finish, str] | None = None) -> DataFrame:
    """Per row: ``doc_id, ids`` (little-endian unsigned 32-bit, as binary), or what ``finish`` (a function of those and its schema) makes of them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    estimate = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    buckets = min(max(estimate // BUCKET_BYTES, BUCKETS[0]), BUCKETS[1])
    held = bucketed(chunks(rows, pattern, buckets), "chunks", "chunk")  # so that documents needn't be dealt out again
    dealt = held.filter("bucket is not null").select("chunk", "bucket", "block").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    folded = with_ids(dealt.groupBy("bucket").applyInArrow(_met, "words array<string>, refs binary"), "words", ranks).select("ids", "refs")
    asked = in_arrow(folded, _sent, "chunk long, block binary")
    schema = finish[1] if finish else "ids binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def placed(docs: pa.Table, words: pa.Table) -> pa.Table:
        doc_ids, ids = _placed(docs, words)
        out = pa.Table.from_arrays([pa.array(doc_ids, pa.int64()), *(finish[0](ids) if finish else [pa.array(ids, pa.binary())])], names=["doc_id", *names])
        release()
        return out

    texts = held.filter("ids is not null").select("chunk", "ids", "sizes", "block")
    return texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(placed, f"doc_id long, {schema}")


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: ``doc_id, bytes``, the ids' pieces one after another; an id outside the vocabulary is an error."""
    shared = Shared(encoded.sparkSession, _pieces(ranks))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(map(shared.value.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return in_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), ids_col), joined, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode, then decode the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    shared = Shared(docs.sparkSession, (_pieces(ranks), [str(i) for i in range(max(ranks.values()) + 1)]))

    def finish(encoded: list[bytes]) -> list[pa.Array]:
        pieces, names = shared.value
        size, shown, decoded = [], [], []
        for x in encoded:
            ids = np.frombuffer(x, "<u4").tolist()
            size.append(len(ids))
            shown.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest())
        return [pa.array(size, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())]

    return encode(docs, ranks, pattern, finish=(finish, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
