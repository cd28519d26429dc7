"""A second stream on its own clock, cut where the first one is: nearest packets, drift and differences in length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .errors import CheckFailed
from .packets import KEY, nearest_by_time
from .sequence import as_of, running

WARN_MS = 40.0
#: Units of the clock whose packets one task orders.
CELL = 1 << 26


def segment_durations(keep: DataFrame, packets: DataFrame) -> DataFrame:
    """``media_id, range_id, duration`` of the kept packets."""
    rows = keep.join(packets.select("media_id", "decode_idx", "duration"), ["media_id", "decode_idx"])
    return rows.groupBy("media_id", "range_id").agg(F.sum("duration").alias("duration"))


def source_starts(moved: DataFrame, ordered: DataFrame) -> DataFrame:
    """``media_id, range_id, source_start_dts``: the decode time, never the composition time, of the packet shown first."""
    at = ordered.select("media_id", F.col("display_idx").alias("start"), F.col("dts").alias("source_start_dts"))
    return moved.join(at, ["media_id", "start"], "left").select("media_id", "range_id", F.coalesce("source_start_dts", F.raise_error(F.lit("segment starts at no frame")).cast("long")).alias("source_start_dts"))


def independent_source_starts(moved: DataFrame, packets: DataFrame) -> DataFrame:
    """The same from the packets alone, not from a display order: of the packets' composition times, the one that as many others precede as the
    segment's first frame says. Times are counted in cells of the clock, then inside the cells that a segment starts in; no task holds a medium."""
    rows = running(packets, KEY, "decode_idx", dts=("duration", False)).withColumn("cts", F.col("dts") + F.col("cts_offset"))
    cells = rows.groupBy("media_id", F.floor(F.col("cts") / CELL).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = running(cells, KEY, "cell", first=("n", False)).select("media_id", "cell", "first", "n").withColumn("_first", F.col("first"))
    asked = as_of(moved.select("media_id", "range_id", "start"), cells, KEY, "start", "first", _first="before").join(cells.drop("first"), ["media_id", "_first"]).filter("start < _first + n")
    inside = rows.withColumn("cell", F.floor(F.col("cts") / CELL)).join(asked.select("media_id", "cell", "_first").distinct(), ["media_id", "cell"])
    placed = inside.withColumn("start", F.col("_first") + F.rank().over(Window.partitionBy("media_id", "cell").orderBy("cts")) - 1)
    return moved.join(placed.select("media_id", "start", F.col("dts").alias("source_start_dts")), ["media_id", "start"]).select("media_id", "range_id", "source_start_dts")


def audio_segments(segments: DataFrame, audio: DataFrame, video_timescale: int, audio_timescale: int) -> DataFrame:
    """Packets ``[start, end)`` of the second stream for each segment (``media_id, range_id, source_start_dts, duration``), from the segment's
    absolute time in the source; with ``error_packets``, the larger distance of its ends from the ideal, in average packets."""
    if not video_timescale or not audio_timescale:
        raise CheckFailed("timescale", "0")
    ticks = lambda c: F.expr(f"cast({c} as double) * {audio_timescale} / {video_timescale}")
    ends = segments.withColumns({"_s": ticks("source_start_dts"), "_e": ticks("(source_start_dts + duration)")})
    sides = F.array(F.struct(F.lit("s").alias("side"), F.col("_s").alias("target")), F.struct(F.lit("e").alias("side"), F.col("_e").alias("target")))
    found = nearest_by_time(ends.select("media_id", "range_id", F.explode(sides).alias("x")).select("media_id", "range_id", "x.*"), audio, KEY)
    timed = running(audio, KEY, "decode_idx", _t=("duration", True)).select("media_id", (F.col("decode_idx") + 1).alias("nearest"), F.col("_t")).hint("merge")
    found = found.join(timed, ["media_id", "nearest"], "left").withColumn("off", F.abs(F.coalesce("_t", F.lit(0)) - F.col("target")))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    both = found.groupBy("media_id", "range_id").agg(of("s", "nearest").alias("start"), of("e", "nearest").alias("end"), F.max("off").alias("off"))
    average = audio.groupBy("media_id").agg((F.sum("duration") / F.count(F.lit(1))).alias("average"))
    return both.join(average, "media_id").select(
        "media_id", "range_id", "start", F.greatest("start", "end").alias("end"), F.expr("if(average = 0, 0D, off / average)").alias("error_packets")
    )


def av_segments(durations: DataFrame, chosen: DataFrame, audio: DataFrame, video_timescale: int, audio_timescale: int) -> DataFrame:
    """``media_id, range_id, video_s, audio_s, diff_ms`` by segment."""
    sums = running(audio, KEY, "decode_idx", _t=("duration", True)).select("media_id", (F.col("decode_idx") + 1).alias("_i"), "_t")
    at = lambda c, t: sums.select("media_id", F.col("_i").alias(c), F.col("_t").alias(t)).hint("merge")
    rows = durations.join(chosen, ["media_id", "range_id"]).join(at("start", "_t0"), ["media_id", "start"], "left").join(at("end", "_t1"), ["media_id", "end"], "left")
    video, sound = F.col("duration") / float(video_timescale), (F.coalesce("_t1", F.lit(0)) - F.coalesce("_t0", F.lit(0))) / float(audio_timescale)
    return rows.select("media_id", "range_id", video.alias("video_s"), sound.alias("audio_s"), ((sound - video) * 1000).alias("diff_ms"))


def av_summary(segments: DataFrame) -> DataFrame:
    """The largest difference and the first segment that has it, the total, and whether any is above 40 ms."""
    worst = F.max(F.struct(F.abs("diff_ms").alias("ms"), (-F.col("range_id")).alias("first")))
    out = segments.groupBy("media_id").agg(worst.alias("w"), F.sum("diff_ms").alias("total_ms"))
    return out.select("media_id", F.col("w.ms").alias("max_abs_ms"), (-F.col("w.first")).alias("worst_range"), "total_ms", (F.col("w.ms") > WARN_MS).alias("warn"))
