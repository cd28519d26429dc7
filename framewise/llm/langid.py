"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one ends at the text's end, so it overlaps its predecessor; a text
shorter than a window is padded). In each window the bytes are embedded, filters of several widths slide over them, each filter's maximum is
kept, and a softmax layer gives probabilities; a text's probabilities are the mean over all of its windows. Everything is trained in numpy on
labelled rows. Training reads windows of at most ``SAMPLE`` rows for each language, chosen by a hash of their id; prediction reads whole texts.

Every language that a training row has is learnt, however rare; the network has one output for each, and the driver holds ``SAMPLE`` rows of each at most.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with a null label never train; with no labelled row
every text is ``und``; ties go to the language that sorts first; null ids and repeated rows are predicted each, and repeated training rows teach once; a text of any length is read whole; an empty table gives an empty result;
only the named columns are read, and other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Shared, in_arrow, unused

WINDOW = 256
#: Rows of each language that training may read, and windows of each of them.
SAMPLE, SAMPLE_WINDOWS = 800, 3
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
PAD = 32
CHUNK = 128


class ByteCnn:
    """Embedding, filters of several widths (kept as one matrix, zero beyond a filter's width), maximum over places, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.span = max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.span * EMBED, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 1, (self.span * EMBED, n)) / np.sqrt(self.span * EMBED)).astype(np.float32) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": (rng.normal(0, 1, (n, len(langs))) / np.sqrt(n)).astype(np.float32),
            "out_bias": np.zeros(len(langs), np.float32),
        }

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        x = self.p["embed"][windows]
        places = windows.shape[1] - self.span + 1
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (len(x), places, self.span * EMBED), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(len(x) * places, -1)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, pooled features, the filters' outputs."""
        y = (self._columns(windows) @ self.p["conv"]).reshape(len(windows), -1, self.p["conv"].shape[1])
        pooled = np.maximum(y.max(axis=1) + self.p["bias"], 0)
        z = pooled @ self.p["out"] + self.p["out_bias"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), pooled, y

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for i in range(0, len(windows), CHUNK):
            out[i : i + CHUNK] = self.forward(windows[i : i + CHUNK])[0]
        return out

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        probs, pooled, y = self.forward(windows)
        n = len(windows)
        dz = probs.copy()
        dz[np.arange(n), labels] -= 1
        dz /= n
        live = (dz @ self.p["out"].T) * (pooled > 0)
        at = y.argmax(axis=1)
        rows = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(self.span)]
        x = self.p["embed"][rows].reshape(n, at.shape[1], -1)
        dx = (live[:, :, None] * self.p["conv"].T[None]).reshape(-1, EMBED)
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, rows.reshape(-1), dx)
        return {
            "embed": embed,
            "conv": np.einsum("nf,nfk->kf", live, x) * self.mask,
            "bias": live.sum(axis=0),
            "out": pooled.T @ dz,
            "out_bias": dz.sum(axis=0),
        }

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteCnn:
        """Adam with a rate that falls to a tenth; every language is drawn equally often."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(labels == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.array([rng.choice(groups[k]) for k in rng.integers(0, len(groups), batch)])
            for k, g in self.gradients(windows[pick], labels[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                step = rate * (1 - 0.9 * t / steps) / (1 - 0.9**t)
                self.p[k] -= (step * m[k] / (np.sqrt(v2[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self


def windows_of(text: bytes) -> np.ndarray:
    """The windows of a non-empty text."""
    data = np.frombuffer(text, np.uint8)
    if len(data) < WINDOW:
        data = np.concatenate([data, np.full(WINDOW - len(data), PAD, np.uint8)])
    whole = len(data) // WINDOW * WINDOW
    out = data[:whole].reshape(-1, WINDOW)
    return out if whole == len(data) else np.concatenate([out, data[None, -WINDOW:]])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> ByteCnn:
    """Fit on the rows of ``docs``, all of which may be used."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return ByteCnn([])
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 0.9 * SAMPLE / n))) for k, n in counts.items()))
    chosen = labelled.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    step = F.greatest(F.lit(1), F.expr(f"(length(text) - {WINDOW}) div {SAMPLE_WINDOWS}"))
    pieces = [F.substr("text", (step * i + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    pieces = chosen.select("lang", *(p.alias(f"p{i}") for i, p in enumerate(pieces))).distinct()  # rows that repeat an id teach once
    rows = pieces.orderBy(F.xxhash64(*pieces.columns), *pieces.columns).limit(SAMPLE * len(langs)).collect()
    windows, labels = [], []
    for r in rows:
        for piece in {r[f"p{i}"] for i in range(SAMPLE_WINDOWS)}:
            if piece and regex.search(r"\p{L}", piece):
                windows.append(windows_of(piece.encode("utf-8", "replace"))[:1])
                labels.append(langs.index(r["lang"]))
    seen = sorted(set(labels))
    if not seen:
        return ByteCnn([])
    net = ByteCnn([langs[i] for i in seen])
    order = np.argsort([w.tobytes() + bytes([k % 256]) for w, k in zip(windows, labels, strict=True)])
    return net.fit(np.concatenate(windows)[order], np.searchsorted(seen, np.array(labels))[order])


def predict(docs: DataFrame, net: ByteCnn, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs``, without ``text_col`` unless asked for, with the predicted language and its probability; columns of these names give way to them."""
    model = Shared(docs.sparkSession, net)
    rest = [c for c in docs.columns if c not in (text_col, lang_col, score_col)]
    at = 0
    if keep_text:
        rest = [c for c in docs.columns if c not in (lang_col, score_col)]
        at = rest.index(text_col)
    letter = regex.compile(r"\p{L}")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            place: list[int] = []
            held: list[np.ndarray] = []

            def flush(place=place, held=held, langs=langs, scores=scores):
                probs = net.predict(np.concatenate(held))
                sizes = np.array([len(w) for w in held])
                mean = np.add.reduceat(probs, sizes.cumsum() - sizes, axis=0, dtype=np.float64) / sizes[:, None]
                for i, k, s in zip(place, mean.argmax(axis=1), mean.max(axis=1), strict=True):
                    langs[i], scores[i] = net.langs[k], min(1.0, float(s))
                place.clear()
                held.clear()

            n = 0
            for i, text in enumerate(batch.column(at).to_pylist()):
                if net.langs and text is not None and letter.search(text):
                    place.append(i)
                    held.append(windows_of(text.encode("utf-8", "replace")))
                    n += len(held[-1])
                    if n > 8192:
                        flush()
                        n = 0
            if held:
                flush()
            held_back = 0 if keep_text else 1
            arrays = [*batch.columns[held_back:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[held_back:], lang_col, score_col])

    source = docs.select(*(F.col(f"`{c}`") for c in ([] if keep_text else [text_col]) + rest))
    schema = StructType([f for f in source.schema.fields if keep_text or f.name != text_col]).add(lang_col, "string").add(score_col, "double")
    return in_arrow(source, scored, schema)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language, with its columns; where ``lang`` is null it becomes the predicted one. Null texts and those without a
    letter go. Learns from ``docs`` itself; where no row is labelled there is nothing to learn, so rows with a letter stay as they are."""
    net = train(docs)
    if not net.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    fresh = unused("lang_pred", docs), unused("score", docs)
    out = predict(docs, net, lang_col=fresh[0], score_col=fresh[1], keep_text=True).filter(F.col(fresh[0]) != "und")
    return out.select(*(F.coalesce("lang", fresh[0]).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
