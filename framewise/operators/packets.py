"""Packets ``media_id, track_id, decode_idx, file_offset, size, duration, cts_offset, is_sync``: clocks, display order, checks, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import as_of, carried, running

KEY = ["media_id"]


def clocks(packets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """With ``dts``, the durations before a packet, and ``cts``, when it is shown."""
    return running(packets, keys or KEY, "decode_idx", dts=("duration", False)).withColumn("cts", F.col("dts") + F.col("cts_offset"))


def display_order(packets: DataFrame) -> DataFrame:
    """With ``dts, cts, display_idx``: the rank of ``cts``, found chunk by chunk of the clock. Ties get consecutive ranks; see ``order_ties``."""
    rows = clocks(packets)
    span = 1 << 26
    rows = rows.withColumn("_bin", F.floor(F.col("cts") / span))
    before = Window.partitionBy(*KEY).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*KEY, "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    here = Window.partitionBy(*KEY, "_bin").orderBy("cts", "decode_idx")
    out = rows.join(bins.drop("_n"), [*KEY, "_bin"]).withColumn("display_idx", F.row_number().over(here) - 1 + F.col("_base"))
    return out.drop("_bin", "_base")


def order_ties(ordered: DataFrame) -> DataFrame:
    """Composition times that several packets share: ``media_id, cts, n, decode_idxs``. Any row here is an error of the input."""
    ties = ordered.groupBy("media_id", "cts").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("decode_idx")).alias("decode_idxs"))
    return ties.filter("n > 1")


def sync_display(ordered: DataFrame) -> DataFrame:
    return ordered.filter("is_sync").select("media_id", "display_idx")


def preceding_sync(packets: DataFrame) -> DataFrame:
    """With ``sync_idx``, the sync packet at or before each packet in decode order."""
    return carried(packets, KEY, "decode_idx", sync_idx=(F.col("is_sync"), "before"))


def index_mismatches(ordered: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of an external index (frame_number, sample_number, random_access_sample, file_offset, dts) that the packets contradict, by the first
    rule each breaks: ``media_id, ord, code, detail``. Their numbers of rows must agree too."""
    derived = preceding_sync(ordered).select(
        "media_id", F.col("display_idx").alias("frame_number"), "decode_idx", "sync_idx", F.col("file_offset").alias("at"), F.col("dts").alias("clock"), F.col("cts").alias("shown")
    )
    rows = index.join(derived, ["media_id", "frame_number"], "full")
    differs = lambda a, b: F.col(a) != F.col(b)
    code = (
        F.when(F.col("decode_idx").isNull() | F.col("sample_number").isNull(), "missing")
        .when(differs("sample_number", "decode_idx"), "sample_number")
        .when(differs("random_access_sample", "sync_idx"), "random_access_sample")
        .when(differs("file_offset", "at"), "file_offset")
    )
    return rows.select("media_id", F.col("frame_number").alias("ord"), code.alias("code"), F.concat_ws(" ", "frame_number", "sample_number", "decode_idx").alias("detail")).filter("code is not null")


def permutation(frames: DataFrame, column: str = "sample_number") -> DataFrame:
    """Per medium, whether ``column`` holds each of 0..n-1 once: ``media_id, n, is_permutation``."""
    sums = frames.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("d"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    return sums.select("media_id", "n", ((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("is_permutation"))


def not_increasing(rows: DataFrame, pos: str, value: str) -> DataFrame:
    """Rows whose value is not above its predecessor's, for dense positions (a join, so that a long medium is spread)."""
    before = rows.select("media_id", (F.col(pos) + 1).alias(pos), F.col(value).alias("before"))
    return rows.join(before, ["media_id", pos]).filter(F.col(value) <= F.col("before")).select("media_id", pos, "before", value)


# -- run lengths -------------------------------------------------------------------------------------------------------------------------


def run_lengths(rows: DataFrame, value: str, keys: list[str] | None = None, pos: str = "decode_idx") -> DataFrame:
    """Runs of equal values in order: ``keys, run, count, value``."""
    keys = keys or KEY
    before = rows.select(*keys, (F.col(pos) + 1).alias(pos), F.col(value).alias("_old"))
    opened = rows.select(*keys, pos, value).join(before, [*keys, pos], "left")
    opened = opened.withColumn("_open", F.when(F.col("_old").eqNullSafe(F.col(value)), 0).otherwise(1))
    runs = running(opened, keys, pos, run=("_open", True))
    return runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("count"), F.min(value).alias(value)).withColumn("run", F.col("run") - 1)


def expand_runs(runs: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The inverse of ``run_lengths``: ``keys, decode_idx, value``."""
    keys = keys or KEY
    placed = running(runs, keys, "run", _base=("count", False)).filter("count > 0")
    return placed.select(*keys, "_base", value, F.explode(F.expr("sequence(0L, cast(count as bigint) - 1)")).alias("_i")).select(
        *keys, (F.col("_base") + F.col("_i")).alias("decode_idx"), value
    )


def run_total_errors(runs: DataFrame, totals: DataFrame, table: str) -> DataFrame:
    """A table whose counts don't add up to the packets: ``media_id, ord, code, detail``."""
    sums = totals.join(runs.groupBy("media_id").agg(F.sum("count").alias("held")), "media_id", "left").fillna(0, ["held"])
    return sums.filter("held <> total").select("media_id", F.lit(1).alias("ord"), F.lit(table).alias("code"), F.concat_ws(" of ", "held", "total").alias("detail"))


def size_errors(sizes: DataFrame, file_length: DataFrame) -> DataFrame:
    """Declared sizes beyond the file's length, found before anything is expanded: ``sizes`` has ``media_id, count, size`` runs."""
    sums = sizes.groupBy("media_id").agg(F.sum(F.col("count").cast("decimal(38,0)") * F.col("size")).alias("bytes"), F.sum("count").alias("n"))
    held = sums.join(file_length, "media_id")
    code = F.when(F.col("bytes") > F.col("file_length"), "sizes_exceed_file").when((F.col("n") > F.col("file_length")) & (F.col("bytes") > 0), "count_exceeds_file")
    return held.select("media_id", F.lit(1).alias("ord"), code.alias("code"), F.concat_ws(" of ", "bytes", "file_length").alias("detail")).filter("code is not null")


def chunk_run_errors(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rules of chunk runs (``media_id, entry, first_chunk, samples_per_chunk``; ``chunks``: media_id, n_chunks), the first broken one by row."""
    w = Window.partitionBy("media_id").orderBy("entry")
    rows = runs.withColumn("before", F.lag("first_chunk").over(w)).join(chunks, "media_id")
    code = (
        F.when(F.col("first_chunk") < 1, "first_chunk_zero")
        .when(F.col("before").isNull() & (F.col("first_chunk") != 1), "first_chunk_not_one")
        .when(F.col("first_chunk") <= F.col("before"), "not_ascending")
        .when(F.col("first_chunk") > F.col("n_chunks"), "beyond_chunks")
        .when(F.col("samples_per_chunk") == 0, "no_samples")
    )
    return rows.select("media_id", F.col("entry").alias("ord"), code.alias("code"), F.col("first_chunk").cast("string").alias("detail")).filter("code is not null")


def packet_offsets(runs: DataFrame, chunk_offsets: DataFrame, sizes: DataFrame) -> DataFrame:
    """File offsets of packets: the chunk's offset and the sizes before the packet in its chunk.

    ``chunk_offsets``: media_id, chunk (1-based), offset; ``sizes``: media_id, decode_idx, size.
    """
    w = Window.partitionBy("media_id").orderBy("entry")
    last = chunk_offsets.groupBy("media_id").agg(F.max("chunk").alias("n_chunks"))
    spans = runs.withColumn("next", F.lead("first_chunk").over(w)).join(last, "media_id")
    spans = spans.withColumn("last", F.coalesce(F.col("next") - 1, F.col("n_chunks"))).filter("last >= first_chunk")
    chunks = spans.select("media_id", "samples_per_chunk", F.explode(F.expr("sequence(first_chunk, last)")).alias("chunk")).join(chunk_offsets, ["media_id", "chunk"])
    firsts = running(chunks, KEY, "chunk", first=("samples_per_chunk", False))
    packets = firsts.select("media_id", "chunk", "offset", F.explode(F.expr("sequence(first, first + samples_per_chunk - 1)")).alias("decode_idx"))
    inside = Window.partitionBy("media_id", "chunk").orderBy("decode_idx").rowsBetween(Window.unboundedPreceding, -1)
    return packets.join(sizes, ["media_id", "decode_idx"]).select(
        "media_id", "decode_idx", "chunk", "size", (F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("file_offset")
    )


def chunk_numbers(packets: DataFrame, timescale: str = "timescale") -> DataFrame:
    """With ``chunk``: a chunk closes with the packet that brings its durations to one second; without a timescale all are one chunk.

    The sum restarts with each chunk, so it is a fold; a fold over a medium's durations in one row is bounded by the medium.
    """
    rows = packets.groupBy("media_id").agg(F.max(timescale).alias("ts"), F.array_sort(F.collect_list(F.struct("decode_idx", "duration"))).alias("ps"))
    closes = "ts > 0 and s.sum + p.duration >= ts"
    step = f"named_struct('out', array_append(s.out, s.chunk), 'chunk', s.chunk + if({closes}, 1, 0), 'sum', if({closes}, 0L, s.sum + p.duration))"
    # a fold by blocks of packets keeps the arrays that are appended to short
    blocks = "transform(sequence(0, (size(ps) - 1) div 512), b -> slice(ps, 1 + b * 512, 512))"
    fold = (
        f"aggregate({blocks}, named_struct('out', cast(array() as array<array<bigint>>), 'chunk', 0L, 'sum', 0L), (t, block) -> "
        f"transform(array(aggregate(block, named_struct('out', cast(array() as array<bigint>), 'chunk', t.chunk, 'sum', t.sum), (s, p) -> {step})), "
        "r -> named_struct('out', array_append(t.out, r.out), 'chunk', r.chunk, 'sum', r.sum))[0], t -> flatten(t.out))"
    )
    return rows.select("media_id", F.expr(f"explode(arrays_zip(transform(ps, p -> p.decode_idx), {fold}))").alias("z")).select(
        "media_id", F.col("z.0").alias("decode_idx"), F.col("z.1").alias("chunk")
    ).join(packets, ["media_id", "decode_idx"])


def chunk_entries(chunks: DataFrame) -> DataFrame:
    """Chunk runs of a chunk list (``media_id, chunk, samples``): only where the number of packets changes, 1-based."""
    w = Window.partitionBy("media_id").orderBy("chunk")
    changed = chunks.withColumn("old", F.lag("samples").over(w)).filter("old is null or old <> samples")
    return changed.select("media_id", (F.col("chunk") + 1).alias("first_chunk"), F.col("samples").alias("samples_per_chunk"))


def interleaved(chunks: DataFrame, base: int) -> DataFrame:
    """Output offsets of chunks of all tracks (``media_id, track, chunk, start_s, bytes``), by start, then track, then chunk."""
    w = Window.partitionBy("media_id").orderBy("start_s", "track", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.lit(base) + F.coalesce(F.sum("bytes").over(w), F.lit(0)))


def resolved(keep: DataFrame, packets: DataFrame) -> DataFrame:
    """The packets of a keep list, in its order; a packet that doesn't exist is an error."""
    rows = keep.join(packets, ["media_id", "decode_idx"], "left")
    return rows.withColumn("size", F.coalesce("size", F.raise_error(F.lit("kept packet doesn't exist")).cast("long")))


def output_times(kept: DataFrame, timescale: int, movie_timescale: int) -> DataFrame:
    """Media and movie durations of an output track, and its sync packets' 1-based numbers."""
    scale = lambda to: F.when(F.lit(timescale) == 0, 0).otherwise(F.expr(f"sum(duration) * {to} div {max(timescale, 1)}"))
    syncs = F.array_sort(F.collect_list(F.when(F.col("is_sync"), F.col("position") + 1)))
    return kept.groupBy("media_id").agg(F.sum("duration").alias("media_duration"), scale(movie_timescale).alias("movie_duration"), syncs.alias("sync_numbers"))


def nearest_by_time(targets: DataFrame, packets: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """``targets`` with ``nearest``: the packet boundary (0..n) whose prefix sum of durations is nearest, the earlier one on a tie."""
    sums = running(packets, keys, "decode_idx", _end=("duration", True))
    marks = sums.groupBy(*keys, F.col("_end").cast("double").alias("_t")).agg(F.min(F.col("decode_idx") + 1).alias("_i"), F.max(F.col("decode_idx") + 1).alias("_j"))
    zero = sums.select(*keys, F.lit(0.0).alias("_t"), F.lit(0).cast("long").alias("_i"), F.lit(0).cast("long").alias("_j")).distinct()
    marks = marks.unionByName(zero).groupBy(*keys, "_t").agg(F.min("_i").alias("_i"), F.max("_j").alias("_j"))
    # the clock, in whole units, is a position; targets fall between them
    near = as_of(targets.withColumn("_at", F.col(target)), marks.withColumn("_at", F.col("_t")), keys, "_at", "_at", _b="below", _a="after")
    # there is a mark for each packet, whatever the planner guesses, so they are never broadcast
    of = lambda k, i: marks.select(*keys, F.col("_t").alias(k), F.col(i).alias(f"{k}{i}")).hint("merge")
    out = near.join(of("_b", "_j"), [*keys, "_b"], "left").join(of("_a", "_i"), [*keys, "_a"], "left")
    early = (F.col(target) - F.col("_b")) <= (F.col("_a") - F.col(target))
    best = F.when(F.col("_b").isNull(), 0).when(F.col("_a").isNull(), F.col("_b_j")).when(early, F.col("_b_j")).otherwise(F.col("_a_i"))
    return out.select(*targets.columns, best.cast("long").alias("nearest"))
