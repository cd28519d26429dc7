"""Best-fit packing of tokenised documents into sequences of a fixed size, by bin completion.

Only the number of pieces of each length matters to the plan, so it is made from a histogram of at most ``size`` counts, whatever the number
of documents. Best-fit decreasing gives the first incumbent; where it uses more sequences than the total length needs, branch and bound looks for fewer (see
``bin_completion``). Packing is NP-hard, so the search has a budget of fillings; what it leaves is the best plan so far, with every piece in it. A plan is a list of (lengths of one
sequence, how many such sequences), at most one for each length that runs out.

Each piece then finds its place alone: its rank among the pieces of its length selects the sequence and the offset. Ranks come from counts by
(task, length), so no length, however common, gathers in one task, and no text is shuffled.

Defined cases: null texts count as empty and give one piece that holds the end mark; null ids stay null; an empty table gives an empty result;
repeated rows are packed each; a text of any length is cut into pieces; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, per_process, saved

SIZE = 4096
END = 1
#: Words, and pieces, that a worker keeps.
CACHE = 600_000
#: Fillings that the search may try before it keeps its incumbent.
NODES = 6000
#: Sequences back to which other fillings are kept, each some megabytes at most.
BACK = 32

Plan = list[tuple[dict[int, int], int]]


#: A word of plain letters and the signs that follow it, which the tokenizer takes apart in the same place; case is dropped by the tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#&*%$()\"/-]*)")


class WordIds:
    """Ids of a text by a tokenizer whose tokens never hold white space and never cross from letters to signs, and which lower-cases: what
    stands between blanks is encoded once and kept, and shares its letters' ids with the same word in another case or before other signs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def encoded(word: str) -> bytes:
            return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                if len(word) > 64:
                    return encoded(word)
                self[word] = ids = encoded(word)
                return ids

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                plain = _PLAIN.fullmatch(piece)
                ids = words[plain[1].lower()] + (words[plain[2]] if plain[2] else b"") if plain else words[piece]
                if len(self) >= CACHE:
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        words = Words()
        self.known = Pieces()

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, task, rank`` (its rank among the task's pieces of that length)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, seen, task = per_process(("word ids", tokenizer), lambda: WordIds(tokenizer)), defaultdict(int), TaskContext.get().partitionId()
        tail, width = np.array([end], "<u4").tobytes(), 4 * size
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids_of(text or "") + tail
                for k in range(0, len(data), width):
                    part = data[k : k + width]
                    n = len(part) // 4
                    for col, x in zip(out, (doc_id, k // width, k // 4, n, zlib.crc32(part), task, seen[n]), strict=True):
                        col.append(x)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, schema)


def best_fit_decreasing(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Run-length best-fit decreasing: sequences filled alike are handled together."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted((r for r in open_ if r >= length and open_[r])):
            # the tightest sequences first; each takes as many of this length as fit
            groups, open_[room] = open_[room], []
            for held, n in groups:
                fit = room // length
                full = min(n, left // fit)
                if full:
                    open_[room - fit * length].append((held | {length: held.get(length, 0) + fit}, full))
                    left -= full * fit
                    n -= full
                if n and left and left < fit:
                    open_[room - left * length].append((held | {length: held.get(length, 0) + left}, 1))
                    left, n = 0, n - 1
                if n:
                    open_[room].append((held, n))
            if not left:
                break
        fit = size // length
        if left // fit:
            open_[size - fit * length].append(({length: fit}, left // fit))
        if left % fit:
            open_[size - left % fit * length].append(({length: left % fit}, 1))
    return [x for groups in open_.values() for x in groups]


def fillings(room: int, left: np.ndarray, most_waste: int) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` from ``left[length]`` pieces of each length, those with the least waste first, at most ``most_waste``.

    Which sums can be had is found for all of them at once, as bits of one number for the pieces up to each length; so a filling that exists is found. Of
    fillings with one sum, a single piece dominates all others; then come pairs and triples of the most even pieces, which leave small
    pieces for later, and the one with the largest pieces. A filling that leaves room for a piece still at hand is dominated by the one that has it.
    """
    lengths = np.flatnonzero(left[: room + 1])
    sums, bits, limit = [], 1, (1 << (room + 1)) - 1
    for k in lengths.tolist():
        n, part = min(int(left[k]), room // k), 1
        while n:  # as many as 1, 2, 4, ... and the rest at once
            part = min(part, n)
            bits |= (bits << (part * k)) & limit
            n -= part
            part *= 2
        sums.append(bits)
    for waste in range(min(most_waste, room) + 1):
        total = room - waste
        if not bits >> total & 1:
            continue
        if total == 0:
            if not len(lengths) or lengths[0] > room:
                yield []
            continue
        if left[total]:
            found: Iterator[list[int]] = iter([[total]])
        else:
            found = _several(total, left, lengths, sums)
        seen = set()
        for held in found:
            used = np.bincount(held, minlength=len(left))
            if tuple(held) not in seen and not (waste and (left[1 : waste + 1] > used[1 : waste + 1]).any()):
                seen.add(tuple(held))
                yield held


def _several(total: int, left: np.ndarray, lengths: np.ndarray, sums: list[int]) -> Iterator[list[int]]:
    def pairs(of: int, least: int) -> np.ndarray:
        """The lesser pieces, most even pair first, of the pairs with that sum and no piece below ``least``."""
        x = np.arange(of // 2, least - 1, -1)
        x = x[(left[x] > 0) & (left[of - x] > 0)] if len(x) else x
        return x[1:] if len(x) and 2 * x[0] == of and left[x[0]] < 2 else x

    # the largest pieces that leave a sum that can be had
    held, rest = [], total
    for k in range(len(lengths) - 1, -1, -1):
        length, below = int(lengths[k]), sums[k - 1] if k else 1
        n = min(int(left[length]), rest // length)
        while n >= 0 and not below >> (rest - n * length) & 1:
            n -= 1
        held += [length] * n
        rest -= length * n
    yield held
    for a in pairs(total, 1).tolist():
        yield [total - a, a]
    for a in lengths[lengths <= total // 3][::-1].tolist():
        left[a] -= 1
        x = pairs(total - a, a)
        left[a] += 1
        if len(x):
            yield [total - a - int(x[0]), int(x[0]), a]


def bin_completion(counts: dict[int, int], size: int = SIZE, nodes: int = NODES) -> Plan:
    """A plan with as few sequences as branch and bound finds in ``nodes`` fillings; never more than best-fit decreasing uses.

    A node fills one sequence around the largest piece left, and repeats that filling while its pieces last. Depth first, its fillings are tried in their order; one whose waste
    would use up what a better plan may waste in all is pruned, and where none is left the search goes back, to one of the last ``BACK`` fillings. A complete plan, or one that best-fit decreasing completes,
    becomes the incumbent if it uses fewer sequences. The search ends where the incumbent reaches the least possible number.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    best = best_fit_decreasing(counts, size)
    total, bins = sum(k * n for k, n in counts.items()), sum(n for _, n in best)
    least = max(-(-total // size), sum(n for k, n in counts.items() if 2 * k > size))
    left = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    path: list[tuple[dict[int, int], int, Iterator[list[int]]]] = []
    spent, waste, tried = 0, 0, 0

    def open_() -> Iterator[list[int]]:
        first = int(np.flatnonzero(left)[-1])
        left[first] -= 1
        allowed = (bins - 1) * size - total - waste
        found = fillings(size - first, left.copy(), allowed) if allowed >= 0 else iter(())
        left[first] += 1
        return ([first, *x] for x in found)

    choices = open_() if left.any() else iter(())
    while bins > least and tried < nodes:
        held = next(choices, None)
        if held is None:
            if path and tried:
                rest = {int(k): int(left[k]) for k in np.flatnonzero(left)}
                tail = best_fit_decreasing(rest, size)
                if spent + sum(n for _, n in tail) < bins:
                    best = [(h, n) for h, n, _ in path] + tail
                    bins = sum(n for _, n in best)
            if not path:
                break
            used, times, choices = path.pop()
            spent -= times
            waste -= times * (size - sum(k * n for k, n in used.items()))
            for k, n in used.items():
                left[k] += n * times
            continue
        tried += 1
        used = dict(Counter(held))
        lost = size - sum(held)
        allowed = (bins - 1) * size - total - waste
        if lost > allowed:
            continue
        times = min(int(left[k]) // n for k, n in used.items())
        if lost:
            times = min(times, allowed // lost)
        path.append((used, times, choices))
        if len(path) > BACK:  # what is far back isn't come back to
            path[-BACK - 1] = (*path[-BACK - 1][:2], iter(()))
        spent, waste = spent + times, waste + times * lost
        for k, n in used.items():
            left[k] -= n * times
        if left.any():
            choices = open_()
        else:
            best, bins, choices = [(h, n) for h, n, _ in path], spent, iter(())
    if bins > least and path:  # the budget is spent inside a plan: best-fit decreasing completes it
        tail = best_fit_decreasing({int(k): int(left[k]) for k in np.flatnonzero(left)}, size)
        if spent + sum(n for _, n in tail) < bins:
            best = [(h, n) for h, n, _ in path] + tail
    return best


def _slots(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, pieces of that length in each, offset of the first of them)."""
    rows: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for held, n in plan:
        offset = 0
        for length in sorted(held, reverse=True):
            rows[length].append((taken[length], sequence, held[length], offset))
            taken[length] += held[length] * n
            offset += held[length] * length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (written pieces, as ``pieces`` gives them) with ``sequence_id`` and ``offset`` in place of ``task`` and ``rank``."""
    spark = cut.sparkSession
    by_length = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``size`` rows
    slots = spark.sparkContext.broadcast(_slots(bin_completion({r["length"]: r["n"] for r in by_length}, size)))
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    running = "sum(n) over (partition by length order by task rows between unbounded preceding and 1 preceding)"
    before = by_task.select("task", "length", F.coalesce(F.expr(running), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = slots.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(at):
                    k = int(length[at[0]])
                    row = places[k][np.searchsorted(places[k][:, 0], rank[at], "right") - 1]
                    nth = rank[at] - row[:, 0]
                    sequence[at] = row[:, 1] + nth // row[:, 2]
                    offset[at] = row[:, 3] + nth % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return in_arrow(ranked, placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(saved(pieces(docs, tokenizer, size, end), "pieces"), size)
