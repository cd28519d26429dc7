"""Algebra of half-open ranges ``media_id, range_id, start, end`` on the display axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .errors import CheckFailed, raise_first
from .sequence import as_of, running

KEY = ["media_id"]


def boundaries(ranges: DataFrame) -> DataFrame:
    """Two rows per range: ``kind`` start (0) and end (1)."""
    ends = F.array(F.struct(F.lit("start").alias("kind"), F.col("start").alias("boundary")), F.struct(F.lit("end").alias("kind"), F.col("end").alias("boundary")))
    return ranges.select("media_id", "range_id", F.explode(ends).alias("b")).select("media_id", "range_id", "b.kind", "b.boundary")


def snapped(ranges: DataFrame, sync: DataFrame, totals: DataFrame, direction: str = "outward", fallback: str = "total") -> DataFrame:
    """Move boundaries to sync points (``sync``: media_id, display_idx): outward keeps more, inward less.

    A boundary beyond the last sync point goes to the total (``fallback='total'``, as a cut needs) or stays (``'original'``, as the report has
    it); one before the first goes to 0 or stays. ``*_original``, ``*_delta`` tell what moved.
    """
    back, forth = ("before", "after")
    near = as_of(boundaries(ranges), sync, KEY, "boundary", "display_idx", prev=back, next=forth).join(totals, "media_id")
    down = F.coalesce("prev", F.lit(0) if fallback == "total" else F.col("boundary"))
    up = F.coalesce("next", F.col("total_frames") if fallback == "total" else F.col("boundary"))
    to = F.when((F.col("kind") == "start") == F.lit(direction == "outward"), down).otherwise(up)
    rows = near.select("media_id", "range_id", "kind", "boundary", to.alias("at"))
    side = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    out = rows.groupBy("media_id", "range_id").agg(
        side("start", "at").alias("start"), side("end", "at").alias("end"), side("start", "boundary").alias("start_original"), side("end", "boundary").alias("end_original")
    )
    return out.withColumns({"start_delta": F.abs(F.col("start") - F.col("start_original")), "end_delta": F.abs(F.col("end") - F.col("end_original"))})


def snap_conflicts(moved: DataFrame) -> DataFrame:
    """Ranges that became empty or reversed, or that overlap their successor: ``media_id, range_id, ord, code, detail``."""
    w = Window.partitionBy("media_id").orderBy("range_id")
    rows = moved.withColumn("next_start", F.lead("start").over(w))
    code = F.when(F.col("end") <= F.col("start"), "empty_range").when(F.col("next_start") < F.col("end"), "overlap")
    detail = F.concat_ws(" ", "media_id", "range_id", "start", "end")
    return rows.select("media_id", "range_id", F.col("range_id").alias("ord"), code.alias("code"), detail.alias("detail")).filter("code is not null")


def snap(ranges: DataFrame, sync: DataFrame, totals: DataFrame, direction: str = "outward") -> DataFrame:
    """``snapped``, or an error where ranges conflict; they are never merged."""
    moved = snapped(ranges, sync, totals, direction)
    raise_first(snap_conflicts(moved))
    return moved


def complement(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """What the ranges leave of ``[0, total_frames)``, without empty gaps; media without ranges give one range."""
    w = Window.partitionBy("media_id").orderBy("start")
    mine = ranges.select("media_id", "start", "end")
    gaps = mine.withColumn("from", F.lag("end", 1, 0).over(w)).select("media_id", F.col("from").alias("start"), F.col("start").alias("end"))
    last = totals.join(mine.groupBy("media_id").agg(F.max("end").alias("from")), "media_id", "left")
    tails = last.select("media_id", F.coalesce("from", F.lit(0)).cast("long").alias("start"), F.col("total_frames").alias("end"))
    return gaps.unionByName(tails).filter("start < end").withColumn("range_id", F.row_number().over(w) - 1)


def keep_list(moved: DataFrame, order: DataFrame) -> DataFrame:
    """Packets to keep, by count: the ``end - start`` packets in decode order from the one shown at ``start``.

    ``order``: media_id, display_idx, decode_idx. Gives ``media_id, range_id, position, decode_idx``; position counts over the whole output.
    """
    first = order.select("media_id", F.col("display_idx").alias("start"), F.col("decode_idx").alias("first"))
    rows = moved.join(first, ["media_id", "start"], "left").filter("end > start")
    rows = rows.withColumn("first", F.coalesce("first", F.raise_error(F.lit("range starts at no frame")).cast("long")))
    w = Window.partitionBy("media_id").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0)))
    return rows.select("media_id", "range_id", "base", F.posexplode(F.expr("sequence(first, first + end - start - 1)")).alias("i", "decode_idx")).select(
        "media_id", "range_id", (F.col("base") + F.col("i")).alias("position"), "decode_idx"
    )


def exclusivity_errors(keep: DataFrame, other: DataFrame, totals: DataFrame) -> DataFrame:
    """Keep list and complement must be disjoint and cover everything: ``media_id, ord, code, detail``; names the first five in both."""
    both = keep.join(other.select("media_id", "decode_idx"), ["media_id", "decode_idx"], "left_semi")
    shared = both.groupBy("media_id").agg(F.slice(F.array_sort(F.collect_set("decode_idx")), 1, 5).alias("x"))
    shared = shared.select("media_id", F.lit(1).alias("ord"), F.lit("in_both").alias("code"), F.array_join("x", ",").alias("detail"))
    count = lambda df, n: df.groupBy("media_id").agg(F.count(F.lit(1)).alias(n))
    sums = totals.join(count(keep, "a"), "media_id", "left").join(count(other, "b"), "media_id", "left").fillna(0, ["a", "b"])
    wrong = sums.filter("a + b <> total_frames").select("media_id", F.lit(2).alias("ord"), F.lit("incomplete").alias("code"), F.concat_ws("+", "a", "b").alias("detail"))
    return shared.unionByName(wrong)


def segment_map(moved: DataFrame, starts: DataFrame, durations: DataFrame) -> DataFrame:
    """One row per segment with its source frames and DTS and its place on the output's clock."""
    rows = moved.select("media_id", "range_id", F.col("start").alias("source_start_frame"), F.col("end").alias("source_end_frame"))
    rows = rows.join(starts, ["media_id", "range_id"], "left").join(durations, ["media_id", "range_id"], "left")
    missing = F.raise_error(F.lit("segment without a start or a duration")).cast("long")
    rows = rows.withColumns({c: F.coalesce(c, missing) for c in ("source_start_dts", "duration")})
    placed = running(rows, KEY, "range_id", output_start=("duration", False))
    return placed.withColumn("frame_count", F.col("source_end_frame") - F.col("source_start_frame"))


def check_direction(direction: str, with_removed: bool) -> None:
    if direction not in ("outward", "inward"):
        raise CheckFailed("direction", direction)
    if direction == "inward" and with_removed:
        raise CheckFailed("inward_with_removed", "the removed side needs outward snapping")
