"""Language-model scores from a hierarchical Pitman-Yor model whose seating is sampled by Gibbs, in two forms.

``score_by_word_contexts``: every word is a context with a restaurant of its own, over all words, and all share one parent over a uniform distribution of
the known words and "unknown". ``score_documents``, bounded in its contexts, is as follows.

Outcomes are the ``FREQUENT`` most frequent words (the end of a text always among them) and "another word". Each outcome, and the start of a text
with the end's, is a context and has a restaurant: its customers are the tokens that follow it. All context restaurants share one parent, whose customers are
their tables, over a uniform distribution of outcomes. Which other word it is comes from one more restaurant, whose customers are all tokens of other words,
over a uniform distribution of the known other words and "unknown". So P(word | word before) is that of the outcome in the context,
times, for another word, that of the word among the others; over all known words and "unknown" it adds up to one. The two parts have independent posteriors, so each
one's predictive probabilities are averaged over the samples by themselves.

A Gibbs step takes a block (the customers of one dish) from its restaurant, with its tables, and seats them again one after another given
everybody else's seats: a customer opens a table with the Chinese-restaurant probability, and then is a customer of the parent. Past ``SINGLE`` customers of a block they
come in runs of a sixteenth of those who sit. Blocks of one dish in all contexts, which are in different restaurants, are drawn together, and then
the parent's block of that dish. Of the other words' restaurant, all blocks are drawn given the last sweep's number of tables less their own.
``BURN`` sweeps go before the ``SAMPLES`` that are averaged. Every draw is a hash of the word or the block, the sweep and the customer, so neither the
partitioning nor a lost task changes a score (but for the rounding of sums).

The corpus is counted by word, over all training rows; words stay distributed, and of their seating only the number of tables comes to the driver. Context counts are at most
``(FREQUENT + 1) ** 2`` numbers. The ``SHARED`` most frequent words of up to ``SHORT`` bytes are given to every task; other words go through a join.

Defined cases: null and empty texts are one end token; with no training row, ``train_tokens`` is 0 and every token has probability 1 in
both scores; repeated rows, and different texts under one id, are scored each; a null id counts as training and stays null; a text of any length is
scored whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, dropped, in_arrow, new_path, ragged, saved

FREQUENT, BURN, SAMPLES = 255, 2, 3
#: Discount and strength: of contexts' restaurants, of their parent, and of the other words' restaurant.
CONTEXT, PARENT, WORDS = (0.6, 100.0), (0.2, 1.0), (0.6, 10.0)
#: Customers of a block that are seated one by one.
SINGLE = 32
SHARED, SHORT = 200_000, 64
HELD = 500_000
#: Tokens of texts that a task takes together; of a longer text, all.
CHUNK = 1 << 21
#: Contexts at most whose pairs are dealt one by one; words at most with numbers of fewer bytes than their names; one in how many rows is looked at to
#: choose both. A context's pairs are dealt one by one if that is of more tokens than a ``SHARE``-th of a place's.
WIDE, SHORTER, LOOK, SHARE = 100_000, 65_535, 64, 8
END = b"\n"  # holds white space, so it is never a word
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text and the end."""
    out = _WORD.findall((text or "").encode("utf-8", "replace").translate(_LOWER))
    out.append(END)
    return out


def uniform(names: np.ndarray, sweep: int, customer: int) -> np.ndarray:
    """A number below 1 for each 64-bit name: a hash of it, the sweep and the customer."""
    x = names + np.uint64((sweep * 0x9E3779B97F4A7C15 + customer * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def seat(names: np.ndarray, n: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, s: float, sweep: int) -> np.ndarray:
    """Tables of blocks of ``n`` customers; ``others``: tables in their restaurants without theirs; ``parent``: their dish's probability there."""
    tables = np.minimum(n, 1).astype(np.int64)
    live, sat = np.flatnonzero(n > 1), 1
    while len(live):
        t = tables[live]
        new = (s + d * (others[live] + t)) * parent[live]
        p = new / (new + sat - d * t)
        u = uniform(names[live], sweep, 2 * sat)
        if sat < SINGLE:
            tables[live] += u < p
            sat += 1
        else:
            come = np.minimum(sat // 16, n[live] - sat)
            normal = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * uniform(names[live], sweep, 2 * sat + 1))
            tables[live] += np.clip(np.rint(come * p + np.sqrt(come * p * (1 - p)) * normal), 0, come).astype(np.int64)
            sat += sat // 16
        live = live[n[live] > sat]
    return tables


class Contexts:
    """Context restaurants and their parent; ``counts[context, outcome]`` are the customers."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64)
        self.tables = np.minimum(self.n, 1)
        self.up = np.minimum(self.tables.sum(axis=0), 1)

    def parent(self) -> np.ndarray:
        (d, s), held = PARENT, self.tables.sum(axis=0)
        return (held - d * self.up + (s + d * self.up.sum()) / len(held)) / (s + held.sum())

    def predictive(self) -> np.ndarray:
        d, s = CONTEXT
        spare = (s + d * self.tables.sum(axis=1)) / (s + self.n.sum(axis=1))
        return (self.n - d * self.tables) / (s + self.n.sum(axis=1))[:, None] + spare[:, None] * self.parent()

    def sweep(self, number: int) -> None:
        c = len(self.n)
        block = lambda k: np.uint64(0xA0761D6478BD642F) * np.arange(k * c + 1, k * c + c + 1, dtype=np.uint64)
        (d, s), (pd, ps) = CONTEXT, PARENT
        rooms = self.tables.sum(axis=1)
        for o in range(c):
            mine = self.tables[:, o]
            held = self.tables.sum(axis=0)
            # the dish's probability in the parent without the block's own tables
            guests, up = held[o] - mine, np.minimum(self.up[o], held[o] - mine)
            base = (ps + pd * (self.up.sum() - self.up[o] + up)) / c
            parent = (np.maximum(guests - pd * up, 0) + base) / (ps + held.sum() - mine)
            fresh = seat(block(o), self.n[:, o], rooms - mine, parent, d, s, number)
            rooms += fresh - mine
            self.tables[:, o] = fresh
            one = np.array([fresh.sum()])
            self.up[o] = seat(block(c)[o : o + 1], one, np.array([self.up.sum() - self.up[o]]), np.array([1 / c]), pd, ps, number)[0]


class Others:
    """The restaurant of the other words: customers, words and, sweep by sweep, tables in all. A word's own tables follow from these and the word."""

    def __init__(self, customers: int, words: int):
        self.customers, self.words, self.totals = customers, words, [words]

    def tables(self, words: list[bytes], n: np.ndarray) -> list[np.ndarray]:
        """The words' tables in every sweep so far."""
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        out, base = [np.minimum(n, 1)], np.full(len(n), 1 / (self.words + 1))
        for k, total in enumerate(self.totals):
            out.append(seat(names, n, total - out[-1], base, *WORDS, k))
        return out

    def probability(self, words: list[bytes], n: np.ndarray) -> np.ndarray:
        """The words' mean predictive probability; ``totals`` has one number for each sweep, the last included."""
        d, s = WORDS
        seats = Others.tables(self._before(), words, n)[-SAMPLES:]
        shares = [(n - d * t + (s + d * total) / (self.words + 1)) / (s + self.customers) for t, total in zip(seats, self.totals[-SAMPLES:], strict=True)]
        return np.mean(shares, axis=0)

    def unknown(self) -> float:
        d, s = WORDS
        return float(np.mean([(s + d * t) / (self.words + 1) / (s + self.customers) for t in self.totals[-SAMPLES:]]))

    def _before(self) -> Others:
        out = Others(self.customers, self.words)
        out.totals = self.totals[:-1]
        return out


class Model:
    """What is known of the corpus apart from the other words' counts: totals, the frequent words' places and the contexts' log10 probabilities."""

    def __init__(self, total: int, distinct: int, frequent: dict[bytes, int], outcomes: np.ndarray, others: Others):
        self.total, self.distinct, self.frequent, self.outcomes, self.others = total, distinct, frequent, outcomes, others

    def log10_base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def log10_unknown(self) -> float:
        return math.log10(self.others.unknown())


def codes(found: list[bytes], frequent: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and outcomes of a text's tokens; other words have the last place."""
    other = len(frequent)
    out = np.fromiter((frequent.get(w, other) for w in found), np.int64, len(found))
    return np.concatenate([[frequent.get(END, other)], out[:-1]]), out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all rows; counts are combined in the tasks before they are sent."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
                if len(found) >= HELD:
                    yield rows()
        yield rows()

    return in_arrow(docs.select(text_col), counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def context_counts(docs: DataFrame, frequent: dict[bytes, int], text_col: str = "text") -> np.ndarray:
    """Tokens by context and outcome, over all rows: a square of ``len(frequent) + 1``; every task sends its own, row by row."""
    c, shared = len(frequent) + 1, Shared(docs.sparkSession, frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, frequent = np.zeros(c * c, np.int64), shared.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                before, now = codes(tokens(text), frequent)
                held += np.bincount(before * c + now, minlength=c * c) if len(now) > c * c else 0
                if len(now) <= c * c:
                    np.add.at(held, before * c + now, 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["pair", "n"])

    sums = in_arrow(docs.select(text_col), counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(c * c, np.int64)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out.reshape(c, c)


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and ``word, n, base, score``: log10 of its words, ``score`` among the other words (0 for frequent ones)."""
    counts = saved(word_counts(docs, text_col), "counts")
    spark = counts.sparkSession
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    short = counts.filter(F.octet_length("word") <= SHORT)
    top = short.orderBy(F.expr("word <> X'0A'"), F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = {bytes(r["word"]): i for i, r in enumerate(top)}
    contexts = Contexts(context_counts(docs, frequent, text_col))
    others = Others(sizes["n"] - sum(r["n"] for r in top), sizes["v"] - len(top))
    outcomes = []
    for number in range(BURN + SAMPLES):
        contexts.sweep(number)
        outcomes.append(contexts.predictive())
        shared = Shared(spark, (others, frequent))

        def seated(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            others, frequent = shared.value
            total = 0
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                rest = np.fromiter((w not in frequent for w in words), bool, len(words))
                total += int(others.tables(words, n)[-1][rest].sum())
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["t"])

        others.totals.append(in_arrow(counts, seated, "t long").agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0])
    model = Model(sizes["n"], sizes["v"], frequent, np.log10(np.mean(outcomes[-SAMPLES:], axis=0)), others)
    shared = Shared(spark, model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            own = np.fromiter((w in model.frequent for w in words), bool, len(words))
            score = np.where(own, 0.0, np.log10(model.others.probability(words, n)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.log10_base(n)), pa.array(score)], names=["word", "n", "base", "score"])

    words = saved(in_arrow(counts, scored, "word binary, n long, base double, score double"), "words")
    dropped(counts)
    return model, words


def score(docs: DataFrame, model: Model, words: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SHARED) -> DataFrame:
    """Per row: ``doc_id, n_tokens, n_known, base_score, score``."""
    spark = docs.sparkSession
    top = words.filter(F.octet_length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(most).toArrow()
    place = {w: i for i, w in enumerate(top.column(0).to_pylist())}
    shared = Shared(spark, (model, place, np.append(top.column(2).to_numpy(), 0.0), np.append(top.column(3).to_numpy(), 0.0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row its tokens and the sums of its contexts and shared words, and the rest of its words with their numbers."""
        model, place, base, scores = shared.value
        miss, row = len(place), TaskContext.get().partitionId() << 40
        for batch in batches:
            size, known, sums, totals, rest = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                at = np.fromiter((place.get(w, miss) for w in found), np.int64, len(found))
                size.append(len(found))
                known.append(int((at < miss).sum()))
                sums.append(float(base[at].sum()))
                totals.append(float(scores[at].sum() + model.outcomes[codes(found, model.frequent)].sum()))
                rest.append(list(Counter(found[i] for i in np.flatnonzero(at == miss)).items()))
            kind = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())]))
            rows = pa.array([[{"word": w, "k": k} for w, k in r] for r in rest], kind)
            numbers = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            arrays = [numbers, batch.column(0), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(totals, pa.float64()), rows]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])

    schema = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word:binary,k:long>>"
    first = saved(in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), read, schema), "read")
    rare = first.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k")
    rare = rare.join(words.select("word", "n", "base", "score"), "word", "left")
    new, k = F.col("n").isNull(), F.col("k")
    none = float(model.log10_base(np.zeros(1))[0]), model.log10_unknown()
    rest = rare.groupBy("row").agg(
        F.sum(F.when(new, 0).otherwise(k)).alias("_known"), F.sum(k * F.coalesce("base", F.lit(none[0]))).alias("_base"), F.sum(k * F.coalesce("score", F.lit(none[1]))).alias("_score")
    )
    out, zero = first.drop("rest").join(rest, "row", "left"), F.lit(0)
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", zero)).alias("n_known"), (F.col("base_score") + F.coalesce("_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("_score", zero)).alias("score"),
    )


_PAIR = np.uint64(0xA0761D6478BD642F)
MESSAGE = "dst int, src int, kind int, x long, y long, data binary"
#: Kinds of messages: pairs of a chunk, its words, its rows; all pairs of a shard; what it asks and is told of words; its pairs that are drawn; an owner's
#: words, the places of those that shards have, of those they draw; sums of an owner, counts of words, words that share a name; sums by row.
PAIRS, WORD, ROWS, KEPT, ASK, TELL, MANY, DISHES, LIST, DRAWN, HELD_IN_ALL, COUNTS, CLASH, SUMS = range(14)
#: Places for each that owns words.
PLACES = 5


def named(words: Iterable[bytes], count: int, seed: int) -> np.ndarray:
    """64-bit names of words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, count)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays (integers: not negative) in as few bytes as their values need, plane by plane, compressed."""
    parts = []
    for a in arrays:
        kind = a.dtype.str
        if a.dtype.kind in "iu" and len(a):
            a = a.astype(np.min_scalar_type(a.max()))
        parts.append((kind, a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()))
    raw = pickle.dumps(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, narrow, size, planes in pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)):
        wide = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(narrow).itemsize, size).T)
        out.append(wide.view(narrow).reshape(size).astype(kind, copy=False))
    return out


def steps_of(a: np.ndarray) -> np.ndarray:
    """The first of sorted numbers and the steps to the others; ``np.cumsum`` reverses it."""
    return np.diff(a, prepend=a.dtype.type(0))


def place_of(names: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` places has a name; a higher name has no lower place."""
    return ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cut(names: np.ndarray, parts: int) -> list[slice]:
    """Sorted names by place."""
    ends = np.searchsorted(place_of(names, parts), np.arange(parts + 1))
    return [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def owners(parts: int) -> int:
    return -(-parts // PLACES)


def in_rows(messages: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Messages as Arrow batches of bounded bytes."""
    kinds, held, size = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), [], 0
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    for message in messages:
        held.append(message)
        size += 64 + len(message[-1])
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def exchanged(messages: DataFrame, parts: int, step: Callable, schema: str = MESSAGE, out: Callable = in_rows) -> DataFrame:
    """Messages go to the place ``dst``; ``step`` gets it and its messages by kind (``src, x, y, data``, sorted), and yields what is sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inbox: dict[int, dict[int, list]] = {}
        for batch in batches:
            for dst, src, kind, x, y, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inbox.setdefault(dst, {}).setdefault(kind, []).append((src, x, y, data))
        for dst in sorted(inbox):
            box = inbox.pop(dst)
            for found in box.values():
                found.sort(key=lambda m: m[:3])
            yield from out(step(dst, box))

    columns = [c.split()[0] for c in MESSAGE.split(", ")]
    return in_arrow(messages.select(columns).repartitionById(parts, F.col("dst")), run, schema)


def saved_by_kind(messages: DataFrame, tag: str) -> dict[int, DataFrame]:
    """As ``saved``, with a table for each kind of messages there is."""
    spark, path = messages.sparkSession, new_path(messages.sparkSession, tag)
    messages.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    out, every = {}, spark.read.schema(messages.schema).parquet(path)
    for kind in (r["kind"] for r in every.select("kind").distinct().collect()):
        at = f"{path}/kind={kind}"
        out[kind] = spark.read.schema(messages.drop("kind").schema).parquet(at).withColumn("kind", F.lit(kind))
        out[kind].saved_path = at
    return out


def passed(place: int, box: dict[int, list], *kinds: int) -> Iterator[tuple]:
    """Messages of these kinds, to the same place again."""
    for kind in kinds:
        for src, x, y, data in box.get(kind, ()):
            yield place, src, kind, x, y, data


def told(box: dict[int, list], order: np.ndarray, of_words: int) -> list[np.ndarray]:
    """What the owners tell; the first ``of_words`` arrays are of words in this order, and are brought into their own."""
    out = [np.concatenate(c) for c in zip(*(unpacked(data) for *_, data in box[TELL]), strict=True)]
    for k in range(of_words):
        out[k], out[k][order] = np.empty_like(out[k]), out[k]
    return out


class Chunk:
    """Texts of one task, up to ``CHUNK`` tokens or one text."""

    def __init__(self):
        self.number = 0
        self.clear()

    def clear(self) -> None:
        self.found: defaultdict[bytes, int] = defaultdict()
        self.found.default_factory = self.found.__len__
        self.ids, self.held, self.texts, self.size = [], [], [], 0

    def add(self, doc: int | None, held: bool, words: list[bytes]) -> None:
        self.ids.append(doc)
        self.held.append(held)
        self.texts.append(np.fromiter(map(self.found.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def messages(self, task: int, parts: int, top: np.ndarray, wide: np.ndarray, seed: int) -> Iterator[tuple]:
        """The chunk's pairs of words, to their places with the texts that have them; its words, to their owners; its rows, to one place."""
        if not self.ids:
            return
        words, sizes = list(self.found), np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        names, chunk, home = named(words, len(words), seed), task << 32 | self.number, (task + self.number) % owners(parts)
        none, held = np.array([i is None for i in self.ids], np.uint8), np.array(self.held, np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64).view(np.uint64)
        yield home, 0, ROWS, chunk, 0, packed(ids, none, held, sizes)
        order = np.argsort(names)
        length = np.fromiter(map(len, words), np.int64, len(words))[order]
        names = names[order]
        for dst, s in enumerate(cut(names, owners(parts))):
            if s.stop > s.start:
                text = b"".join([words[i] for i in order[s].tolist()])
                yield dst, 0, WORD, chunk, 0, packed(steps_of(names[s]), length[s], np.frombuffer(text, np.uint8))
        del words
        # words are numbered anew by their labels: their place in ``top``, or else their name
        often = np.isin(names, top)
        by, rare = np.argsort(~often, kind="stable"), int(often.sum())
        labels = np.concatenate([np.searchsorted(top, names[by[:rare]]).astype(np.uint64), names[by[rare:]]])
        if len(labels) > rare and labels[rare] < len(top):
            yield home, 0, CLASH, 1, 0, b""
        names, new = names[by], np.empty(len(by), np.int64)
        new[order[by]] = np.arange(len(by))
        # each text ends with the end, which comes before the next one's first word
        w = new[np.concatenate(self.texts)]
        u, doc = np.concatenate([w[-1:], w[:-1]]), np.repeat(np.arange(len(sizes)), sizes)
        vb, db = len(names).bit_length(), (len(sizes) - 1).bit_length()
        self.clear()
        key = (u << vb | w) << db | doc
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        k, key = np.diff(first, append=len(key)), key[first]
        doc, key = key & ((1 << db) - 1), key >> db
        first = np.flatnonzero(np.diff(key, prepend=-1))
        c, n, key = np.diff(first, append=len(key)), np.add.reduceat(np.where(held[doc], 0, k), first), key[first]
        u, w = key >> vb, key & ((1 << vb) - 1)
        dst = place_of(names, parts)[u]
        apart = np.isin(names, wide)[u]
        dst[apart] = place_of(names[u[apart]] * _PAIR + names[w[apart]], parts)
        order = np.argsort(dst.astype(np.min_scalar_type(parts)), kind="stable")
        ends = np.searchsorted(dst[order], np.arange(parts + 1)).tolist()
        table = np.empty(len(names), np.int64)
        for at in range(parts):
            mine = order[ends[at] : ends[at + 1]]
            if not len(mine):
                continue
            us, ws = u[mine], w[mine]
            begun = np.flatnonzero(np.diff(us, prepend=-1))
            which = np.unique(ws)
            table[which] = np.arange(len(which))
            code = np.repeat(np.arange(len(begun)), np.diff(begun, append=len(us))) * len(which) + table[ws]
            rows, lists = ragged(first[mine], c[mine]), []
            for x in (us[begun], which):
                i = int(np.searchsorted(x, rare))
                lists += steps_of(labels[x[:i]]), steps_of(labels[x[i:]])
            yield at, 0, PAIRS, chunk, 0, pickle.dumps((packed(*lists, steps_of(code), n[mine]), packed(c[mine], doc[rows], k[rows])))
        self.number += 1


def read_chunks(rows: DataFrame, parts: int, top: Shared, wide: np.ndarray, seed: int) -> DataFrame:
    """Messages of all chunks of ``rows`` (``doc_id, text, held``)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chunk, task = Chunk(), TaskContext.get().partitionId()
        for batch in batches:
            for doc, text, held in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = tokens(text)
                if chunk.size + len(words) > CHUNK:
                    yield from chunk.messages(task, parts, top.value, wide, seed)
                chunk.add(doc, held, words)
        yield from chunk.messages(task, parts, top.value, wide, seed)

    return in_arrow(rows.select("doc_id", "text", "held"), lambda batches: in_rows(read(batches)), MESSAGE)


def frequent_words(rows: DataFrame, parts: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of frequent words, as estimated from one row in ``LOOK``: those with numbers of fewer bytes, and of these the ones whose pairs are dealt
    one by one, ``most`` at most. They change how much is sent, and where; no result depends on them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens(text))
        found[b""] = found.total()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    few = in_arrow(rows.filter(F.rand(0) * LOOK < 1).select("text"), counted, "word binary, n long")
    top = few.filter(F.octet_length("word") <= SHORT).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1 OR word = X''")
    top = top.orderBy(F.desc("n"), F.desc(F.expr("word = X''")), "word").limit(SHORTER + 1).toArrow()
    words, n = top.column(0).to_pylist()[1:], top.column(1).to_pylist()
    wide = [w for w, x in zip(words, n[1:], strict=True) if SHARE * parts * x > n[0]][: max(0, most)]
    return np.unique(named(words, len(words), seed)), np.unique(named(wide, len(wide), seed))


def names_of(labels: np.ndarray, top: np.ndarray) -> np.ndarray:
    out, i = labels.copy(), int(np.searchsorted(labels, len(top)))
    out[:i] = top[labels[:i].astype(np.int64)]
    return out


def merged(box: dict[int, list]) -> tuple:
    """Of a shard's pairs: labels of their first and second words, sorted; for every pair both words' places, as one number, and its customers; chunk by
    chunk the pairs' places, and the rows that have them."""
    blobs = []
    for _, chunk, _, data in box[PAIRS]:
        pairs, rows = pickle.loads(data)
        *lists, steps, n = unpacked(pairs)
        u, w = (np.concatenate([np.cumsum(x) for x in lists[i : i + 2]]) for i in (0, 2))
        blobs.append((chunk, u, w, steps, n, rows))
    us, ws = (np.unique(np.concatenate([b[k] for b in blobs])) for k in (1, 2))
    codes = []
    for _, u, w, steps, *_ in blobs:
        a, b = np.divmod(np.cumsum(steps), len(w))
        codes.append(np.searchsorted(us, u)[a] * len(ws) + np.searchsorted(ws, w)[b])
    pairs = np.unique(np.concatenate(codes))
    count, chunks = np.zeros(len(pairs), np.int64), []
    for code, (chunk, _, _, _, n, rows) in zip(codes, blobs, strict=True):
        at = np.searchsorted(pairs, code)
        count[at] += n
        chunks.append((chunk, packed(steps_of(at)), rows))
    return us, ws, pairs, count, chunks


def found_in(us: np.ndarray, top: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wide words among sorted labels, and which of them are there."""
    label = np.searchsorted(top, wide).astype(np.uint64)
    at = np.searchsorted(us, label)
    at[at == len(us)] = 0
    return at, us[at] == label


def gathered(place: int, box: dict[int, list], parts: int, top: np.ndarray, wide: np.ndarray) -> Iterator[tuple]:
    """A shard keeps its chunks, holds the pairs of several customers with a table each, and asks for its words; an owner sees if two words share a name."""
    yield from passed(place, box, ROWS, CLASH)
    if WORD in box:
        names, length, text = zip(*(unpacked(data) for *_, data in box[WORD]), strict=True)
        names, text = np.concatenate([np.cumsum(x) for x in names]), np.concatenate(text)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(length))])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
        order = np.argsort(names)
        same = np.flatnonzero(names[order[1:]] == names[order[:-1]])
        clash = pc.sum(pc.not_equal(words.take(pa.array(order[same])), words.take(pa.array(order[same + 1])))).as_py() or 0
        yield place, place, CLASH, clash, 0, b""
    if PAIRS not in box:
        return
    us, ws, pairs, n, chunks = merged(box)
    yield place, place, KEPT, 0, 0, pickle.dumps((packed(us, ws, steps_of(pairs), n), chunks))
    (u, w), many = np.divmod(pairs, len(ws)), np.flatnonzero(n > 1)
    del pairs, chunks
    once, new = (np.bincount(w[x], minlength=len(ws)) for x in (n == 1, many))
    count = np.bincount(w, n, len(ws)).astype(np.int64)
    at, mine = found_in(us, top, wide)
    single = np.bincount(u[n == 1], minlength=len(us))
    customers, rooms = np.bincount(u, n, len(us)).astype(np.int64), single + np.bincount(u[many], minlength=len(us))
    of_wide = lambda x: np.where(mine, x[at], 0)
    us, ws = names_of(us, top), names_of(ws, top)
    order = np.argsort(ws)
    for dst, (s, z) in enumerate(zip(cut(ws[order], owners(parts)), cut(wide, owners(parts)), strict=True)):
        if s.stop > s.start or z.stop > z.start:
            x = order[s]
            yield dst, place, ASK, 0, 0, packed(steps_of(ws[x]), count[x], once[x], new[x], of_wide(customers)[z], of_wide(rooms)[z])
    (mu, u), (mw, w) = (np.unique(x[many], return_inverse=True) for x in (u, w))
    which = np.zeros(len(us), np.int64)
    which[at[mine]] = np.flatnonzero(mine) + 1
    state = us[mu], ws[mw], steps_of(u * len(mw) + w), n[many], single[mu], which[mu], of_wide(single), np.ones(len(many), np.int64)
    yield place, place, MANY, 0, 0, packed(*state)


def answered(place: int, box: dict[int, list]) -> Iterator[tuple]:
    """An owner counts its words, with a table of the parent each, and tells the shards of those they draw."""
    yield from passed(place, box, MANY)
    asked = [(src, *unpacked(data)) for src, _, _, data in box.get(ASK, ())]
    if not asked:
        return
    lists = [np.cumsum(a[1]) for a in asked]
    words = np.unique(np.concatenate(lists))
    at = [np.searchsorted(words, x) for x in lists]
    count, once, new = (np.zeros(len(words), np.int64) for _ in range(3))
    for x, (_, _, *found, _, _) in zip(at, asked, strict=True):
        for total, part in zip((count, once, new), found, strict=True):
            total[x] += part
    customers, rooms = (np.sum([a[k] for a in asked], axis=0) for k in (-2, -1))
    m = once + new
    up = np.minimum(m, 1)
    drawn = [x[a[4] > 0] for x, a in zip(at, asked, strict=True)]
    for kind, lists in ((LIST, at), (DRAWN, drawn)):
        yield place, place, kind, 0, 0, pickle.dumps({a[0]: packed(steps_of(x)) for x, a in zip(lists, asked, strict=True)})
    for x, a in zip(drawn, asked, strict=True):
        yield a[0], place, TELL, 0, 0, packed(m[x], up[x], rooms)
    yield place, place, DISHES, 0, 0, packed(steps_of(words), count, once, m, up, customers, rooms)
    yield place, place, HELD_IN_ALL, int(m.sum()), int(up.sum()), b""
    yield place, place, COUNTS, int((count > 0).sum()), int(count.sum()), b""


def seated_pairs(place: int, box: dict[int, list], parts: int, wide: np.ndarray, totals: tuple[int, int, int], number: int) -> Iterator[tuple]:
    """A shard draws its pairs' tables anew, given those of the last sweep, and tells the words' owners."""
    yield from passed(place, box, DISHES, DRAWN)
    if MANY not in box:
        return
    (d, s), (pd, ps), (words, held, up) = CONTEXT, PARENT, totals
    us, ws, steps, n, single, which, wide_single, t, *kept = unpacked(box[MANY][0][-1])
    u, w = np.divmod(np.cumsum(steps), max(len(ws), 1))
    order = np.argsort(ws)
    m, ups, wide_rooms = told(box, order, 2)
    rooms = single + np.bincount(u, t, len(us)).astype(np.int64)
    rooms[which > 0] = wide_rooms[which[which > 0] - 1]
    guests, ups = m[w] - t, ups[w]
    low = np.minimum(ups, guests)
    parent = (np.maximum(guests - pd * low, 0) + (ps + pd * (up - ups + low)) / (words + 1)) / (ps + held - t)
    t = seat(us[u] * _PAIR + ws[w], n, rooms[u] - t, parent, d, s, number)
    yield place, place, MANY, 0, 0, packed(us, ws, steps, n, single, which, wide_single, t, *kept, *[t] * (number >= BURN))
    new, whole = np.bincount(w, t, len(ws)).astype(np.int64), np.bincount(u, t, len(us)).astype(np.int64)
    wide_new = wide_single.copy()
    wide_new[which[which > 0] - 1] += whole[which > 0]
    for src, (x, z) in enumerate(zip(cut(ws[order], owners(parts)), cut(wide, owners(parts)), strict=True)):
        if x.stop > x.start or z.stop > z.start:
            yield src, place, ASK, 0, 0, packed(new[order[x]], wide_new[z])


def seated_dishes(place: int, box: dict[int, list], totals: tuple[int, int, int], number: int) -> Iterator[tuple]:
    """An owner draws its words' tables in the parent anew, and tells the shards."""
    yield from passed(place, box, MANY, DRAWN)
    if DISHES not in box:
        return
    steps, count, once, m, up, customers, rooms, *kept = unpacked(box[DISHES][0][-1])
    words, _, ups = totals
    m, rooms = once.copy(), np.zeros_like(rooms)
    at = {src: np.cumsum(unpacked(data)[0]) for src, data in pickle.loads(box[DRAWN][0][-1]).items()}
    for src, _, _, data in box.get(ASK, ()):
        new, wide = unpacked(data)
        m[at[src]] += new
        rooms += wide
    up = seat(np.cumsum(steps), m, ups - np.minimum(up, m), np.full(len(m), 1 / (words + 1)), *PARENT, number)
    for dst, x in at.items():
        yield dst, place, TELL, 0, 0, packed(m[x], up[x], rooms)
    yield place, place, DISHES, 0, 0, packed(steps, count, once, m, up, customers, rooms, *kept, *[m, up, rooms] * (number >= BURN))
    yield place, place, HELD_IN_ALL, int(m.sum()), int(up.sum()), b""


def told_all(place: int, box: dict[int, list]) -> Iterator[tuple]:
    """An owner tells the shards of all their words and of the samples."""
    yield from passed(place, box, MANY)
    if DISHES in box:
        _, count, _, _, _, customers, _, *kept = unpacked(box[DISHES][0][-1])
        for dst, data in pickle.loads(box[LIST][0][-1]).items():
            x = np.cumsum(unpacked(data)[0])
            yield dst, place, TELL, 0, 0, packed(count[x], *(a[x] for k, a in enumerate(kept) if k % 3 < 2), customers, *kept[2::3])


def scored_pairs(
    place: int, box: dict[int, list], parts: int, top: np.ndarray, wide: np.ndarray, totals: list[tuple[int, int]], counts: tuple[int, int]
) -> Iterator[tuple]:
    """A shard scores its pairs and adds up each row's."""
    yield from passed(place, box, ROWS)
    if KEPT not in box:
        return
    (d, s), (pd, ps), (distinct, total) = CONTEXT, PARENT, counts
    pairs, chunks = pickle.loads(box.pop(KEPT)[0][-1])
    us, ws, pairs, n = unpacked(pairs)
    u, w = np.divmod(np.cumsum(pairs), len(ws))
    count, *samples = told(box, np.argsort(names_of(ws, top)), 1 + 2 * SAMPLES)
    samples, wide_customers, wide_rooms = samples[: 2 * SAMPLES], samples[2 * SAMPLES], samples[2 * SAMPLES + 1 :]
    tables = unpacked(box[MANY][0][-1])[8:]
    at, mine = found_in(us, top, wide)
    customers, many = np.bincount(u, n, len(us)), np.flatnonzero(n > 1)
    customers[at[mine]] = wide_customers[mine]
    mean = np.zeros(len(n))
    for k, (held, up) in enumerate(totals):
        m, ups = samples[2 * k : 2 * k + 2]
        t = np.minimum(n, 1)
        t[many] = tables[k]
        rooms = np.bincount(u, t, len(us))
        rooms[at[mine]] = wide_rooms[k][mine]
        p = (m - pd * ups + (ps + pd * up) / (distinct + 1)) / (ps + held)
        # a pair that was not seen has no customer and no table, a context that was not seen leaves all to the parent
        mean += n - d * t + (s + d * rooms)[u] * p[w]
    score = np.log10(mean / (len(totals) * (s + customers))[u])
    base, known = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))[w], (count > 0)[w]
    homes: dict[int, list] = {}
    for chunk, at, rows in chunks:
        c, doc, k = unpacked(rows)
        at = np.repeat(np.cumsum(unpacked(at)[0]), c)
        has = np.flatnonzero(np.bincount(doc))
        sums = [np.bincount(doc, x[at] * k)[has] for x in (known, base, score)]
        home = ((chunk >> 32) + (chunk & ((1 << 32) - 1))) % owners(parts)
        homes.setdefault(home, []).append((chunk, packed(steps_of(has), sums[0].astype(np.int64), *sums[1:])))
    for home, found in homes.items():
        yield home, place, SUMS, 0, 0, pickle.dumps(found)


def scored_rows(place: int, box: dict[int, list], total: int) -> Iterator[tuple]:
    """Rows with their sums."""
    sums: dict[int, list] = {}
    for *_, data in box.get(SUMS, ()):
        for chunk, part in pickle.loads(data):
            sums.setdefault(chunk, []).append(part)
    for _, chunk, _, data in box.get(ROWS, ()):
        ids, none, held, sizes = unpacked(data)
        known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for part in sums.pop(chunk, ()):
            has, *found = unpacked(part)
            has = np.cumsum(has)
            for x, y in zip((known, base, score), found, strict=True):
                x[has] += y
        ids = pa.array(ids.view(np.int64), mask=none.astype(bool))
        yield ids, *map(pa.array, (held.astype(bool), sizes, known, np.full(len(ids), total), base, score))


def _forget(spark: SparkSession) -> None:
    """Have Spark delete the shuffled files of plans that are done, which it does after a collection of its driver."""
    gc.collect()
    spark._jvm.System.gc()


def score_by_word_contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = WIDE) -> DataFrame:
    """As ``score_documents``, but every word is a context with a restaurant of its own over all words.

    Pairs of words lie in shards, by their first word, and every word has an owner among the same places; a pair's own place is by both words if the
    first is one of at most ``most`` frequent ones, whose rooms are added up by their owner. All go from place to place as compressed arrays: a task
    sends each pair of a chunk of texts once, with the texts that have it; shards draw the tables of pairs seen twice (a block of one customer has one
    table), owners those of words in the parent, all given the last sweep's tables less their own; then shards score all pairs and add up by text.
    Where two words share a 64-bit name, their bytes tell, and all is named anew.
    """
    spark, own = docs.sparkSession, F.col(id_col).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(own.alias("doc_id"), F.col(text_col).alias("text")).withColumn("held", held_out())
    of = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    added = lambda df, kind: tuple(of(df, kind).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in "xy")).first())
    for seed in range(9):
        top, wide = frequent_words(rows, parts, most, seed)
        top = Shared(spark, top)
        first = read_chunks(rows, parts, top, wide, seed)
        first = saved_by_kind(exchanged(first, parts, lambda place, box: gathered(place, box, parts, top.value, wide)), "pairs")  # noqa: B023
        _forget(spark)
        if CLASH not in first or not added(first[CLASH], CLASH)[0]:
            break
        dropped(*first.values())
    else:
        raise ValueError("different words share a 64-bit name under each of nine seeds")
    none = spark.createDataFrame([], MESSAGE)
    begun = saved(exchanged(first.get(ASK, none).unionByName(first.get(MANY, none)), parts, answered), "words")
    dropped(*(first[kind] for kind in (ASK, MANY) if kind in first))
    counts, held, state, totals = added(begun, COUNTS), added(begun, HELD_IN_ALL), begun, []
    for number in range(BURN + SAMPLES):
        given = (counts[0], *held)
        pairs = exchanged(of(state, MANY, TELL, DISHES, DRAWN), parts, lambda place, box: seated_pairs(place, box, parts, wide, given, number))  # noqa: B023
        old, state = state, saved(exchanged(pairs, parts, lambda place, box: seated_dishes(place, box, given, number)), "sweep")  # noqa: B023
        held = added(state, HELD_IN_ALL)
        totals.append(held)
        if old is not begun:
            dropped(old)
        _forget(spark)
    told_of = saved(exchanged(of(state, MANY, DISHES).unionByName(of(begun, LIST)), parts, told_all), "told")
    dropped(begun, state)
    _forget(spark)
    kept = told_of.unionByName(first.get(KEPT, none)).unionByName(first.get(ROWS, none))
    last = exchanged(kept, parts, lambda place, box: scored_pairs(place, box, parts, top.value, wide, totals[BURN:], counts))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    batches = lambda found: (pa.RecordBatch.from_arrays(list(a), names=names) for a in found)
    return exchanged(last, parts, lambda place, box: scored_rows(place, box, counts[1]), schema, batches)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that aren't held out and score all: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model, words = fit(rows.filter(~held_out()))
    out = score(rows, model, words)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
