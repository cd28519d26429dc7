"""Distances to sync points, what snapping retains, suspected missed blocks, and the verdict over a medium."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import KEY, boundaries, snapped
from .sequence import as_of, running

TOLERANCE, OCCURRENCES, OFF_GRID = 3, 2, 5


def clock(frames: DataFrame, totals: DataFrame) -> DataFrame:
    """``media_id, at, units``: durations before each frame, and before the end."""
    sums = running(frames.select("media_id", "display_idx", "duration"), KEY, "display_idx", units=("duration", False))
    end = frames.groupBy("media_id").agg(F.sum("duration").alias("units")).join(totals, "media_id").select("media_id", F.col("total_frames").alias("at"), "units")
    return sums.select("media_id", F.col("display_idx").alias("at"), "units").unionByName(end)


def units_between(rows: DataFrame, times: DataFrame, totals: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """With ``name``: duration of the frames ``[start, end)``, both clamped to the medium; 0 where reversed, null where one is null."""
    rows = rows.join(totals, "media_id", "left")
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.least(F.col(c), F.col("total_frames"))))
    at = lambda k: times.select("media_id", F.col("at").alias(f"_{k}"), F.col("units").alias(f"_u{k}"))
    out = rows.withColumns({"_s": clamp(start), "_e": clamp(end)}).join(at("s"), ["media_id", "_s"], "left").join(at("e"), ["media_id", "_e"], "left")
    return out.withColumn(name, F.when(F.col("_us").isNotNull() & F.col("_ue").isNotNull(), F.greatest(F.lit(0), F.col("_ue") - F.col("_us")))).drop("_s", "_e", "_us", "_ue", "total_frames")


def boundary_distances(ranges: DataFrame, frames: DataFrame, totals: DataFrame, num: int = 1, den: int = 1) -> DataFrame:
    """For each boundary the sync frames on both sides and their signed distance in seconds of ``num / den`` a unit."""
    keys = frames.filter("is_key").select("media_id", "display_idx")
    near = as_of(boundaries(ranges), keys, KEY, "boundary", "display_idx", prev="before", next="after")
    times = clock(frames, totals)
    out = units_between(units_between(near, times, totals, "prev", "boundary", "_b"), times, totals, "boundary", "next", "_n")
    seconds = lambda c: F.col(c) * float(num) / float(den)
    return out.select("media_id", "range_id", "kind", "boundary", "prev", "next", (F.lit(0.0) - seconds("_b")).alias("prev_s"), seconds("_n").alias("next_s"))


def snap_summary(ranges: DataFrame, frames: DataFrame, totals: DataFrame, direction: str = "outward", num: int = 1, den: int = 1, fallback: str = "original") -> DataFrame:
    """Frames and seconds that snapping adds (outward) or drops (inward), in all and by boundary, and the output's length."""
    moved = snapped(ranges, frames.filter("is_key").select("media_id", "display_idx"), totals, direction, fallback)
    times = clock(frames, totals)
    low = lambda a, b: F.least(a, b)
    spans = moved.withColumns({
        "_s0": low("start", "start_original"), "_s1": F.greatest("start", "start_original"), "_e0": low("end", "end_original"), "_e1": F.greatest("end", "end_original"),
    })
    for a, b, name in (("_s0", "_s1", "us"), ("_e0", "_e1", "ue"), ("start", "end", "kept")):
        spans = units_between(spans, times, totals, a, b, name)
    second = lambda c: c * float(num) / float(den)
    out = spans.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("ranges"), F.sum(F.col("start_delta") + F.col("end_delta")).alias("extra_frames"), F.sum(F.col("us") + F.col("ue")).alias("u"), F.sum("kept").alias("k")
    )
    return out.select(
        "media_id", "ranges", (F.col("ranges") * 2).alias("boundaries"), "extra_frames", second(F.col("u")).alias("extra_s"),
        (second(F.col("u")) / (F.col("ranges") * 2)).alias("extra_s_per_boundary"), second(F.col("k")).alias("output_s"),
    )


def gap_lengths(ranges: DataFrame) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("range_id")
    return ranges.select("media_id", "range_id", (F.lead("start").over(w) - F.col("end")).alias("gap")).filter("gap is not null")


def known_lengths(gaps: DataFrame) -> DataFrame:
    """``media_id, known``: lengths that recur. Sorted gaps join a group while within the tolerance of its *first*; groups of two or more count
    and are named by their first. Grouping depends on the group's anchor, so it is a fold over a medium's distinct lengths."""
    counted = gaps.groupBy("media_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("gap", "n"))).alias("gs"))
    grow = f"size(a) > 0 and g.gap - element_at(a, -1).first <= {TOLERANCE}"
    more = "concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'n', element_at(a, -1).n + g.n)))"
    fold = f"aggregate(gs, cast(array() as array<struct<first:bigint,n:bigint>>), (a, g) -> if({grow}, {more}, array_append(a, named_struct('first', g.gap, 'n', g.n))))"
    return lists.select("media_id", F.expr(f"transform(filter({fold}, x -> x.n >= {OCCURRENCES}), x -> x.first)").alias("known"))


def matching_length(length: str, known: str = "known") -> Column:
    """The first known length within the tolerance, or null."""
    return F.expr(f"get(filter({known}, k -> abs({length} - k) <= {TOLERANCE}), 0)")


def missed_candidates(ranges: DataFrame, entries: DataFrame) -> DataFrame:
    """Structure entries (inclusive ``start, end``) inside a kept range and as long as a recurring gap, in the order of ranges and entries."""
    known = known_lengths(gap_lengths(ranges)).filter(F.size("known") > 0)
    spans = ranges.select("media_id", "range_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = entries.join(known, "media_id").withColumn("length_frames", F.col("end") - F.col("start") + 1)
    rows = rows.withColumn("matched_gap_length", matching_length("length_frames")).filter("matched_gap_length is not null")
    # ranges don't overlap, so only the last one that has begun can hold an entry
    inside = as_of(rows, ranges, KEY, "start", "start", _s="before").join(spans, ["media_id", "_s"]).filter("end < _e")
    return inside.select("media_id", "range_id", "entry_id", "start", "end", "length_frames", "matched_gap_length")


def verdict(ranges: DataFrame, entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals of unsnapped ranges, grid errors of detected blocks, missed candidates, and whether to stop."""
    kept = ranges.groupBy("media_id").agg(F.count(F.lit(1)).alias("range_count"), F.sum(F.col("end") - F.col("start")).alias("kept_frames"))
    size = F.abs("error_frames")
    grid = entries.filter("label = ':CM'").groupBy("media_id").agg(F.count_if(size > OFF_GRID).alias("off_grid"), F.max(size).alias("max_grid_error"))
    missed = missed_candidates(ranges, entries).groupBy("media_id").agg(F.count(F.lit(1)).alias("missed"))
    out = totals.join(kept, "media_id", "left").join(grid, "media_id", "left").join(missed, "media_id", "left")
    out = out.fillna(0, ["range_count", "kept_frames", "off_grid", "missed"]).withColumn("cut_frames", F.greatest(F.lit(0), F.col("total_frames") - F.col("kept_frames")))
    return out.select(
        "media_id", "range_count", "total_frames", "kept_frames", "cut_frames",
        F.expr("if(total_frames = 0, 0D, kept_frames / cast(total_frames as double))").alias("kept_ratio"), "off_grid", "max_grid_error", "missed",
        (F.col("missed") > 0).alias("stops_for_missed"), (F.col("cut_frames") == 0).alias("stops_for_no_cut"),
    ).withColumn("stop", F.col("stops_for_missed") | F.col("stops_for_no_cut"))
