"""Events on the source clock mapped to the output clock of kept segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import as_of

KEY = ["media_id"]


def map_events(events: DataFrame, segments: DataFrame) -> DataFrame:
    """``events`` (``media_id, event_id, start, end`` in ticks) with ``fate, out_start, out_end, start_clamped, end_clamped, spans_multiple``.

    ``segments``: ``media_id, range_id, source_start_dts, duration, output_start``, in order and apart. The first segment that an event overlaps
    takes it, cut to that segment; overlap is strict, so an event without length at a segment's start has none. The first overlapped segment
    is the one under the event's start, or the next one: two as-of lookups instead of a range join.
    """
    segs = segments.select("media_id", F.col("source_start_dts").alias("s0"), (F.col("source_start_dts") + F.col("duration")).alias("s1"), "output_start").filter("s1 > s0")
    segs = segs.withColumn("next_start", F.lead("s0").over(Window.partitionBy("media_id").orderBy("s0")))
    near = as_of(events, segs.select("media_id", "s0"), KEY, "start", "s0", _under="before", _after="above")
    of = lambda k: segs.select("media_id", *(F.col(c).alias(f"{k}_{c}") for c in segs.columns if c != "media_id"), F.col("s0").alias(k))
    rows = near.join(of("_under"), ["media_id", "_under"], "left").join(of("_after"), ["media_id", "_after"], "left")
    hits = lambda k: (F.col("start") < F.col(f"{k}_s1")) & (F.col("end") > F.col(f"{k}_s0"))
    under, after = F.coalesce(hits("_under"), F.lit(False)), F.coalesce(hits("_after"), F.lit(False))
    pick = lambda c: F.when(under, F.col(f"_under_{c}")).when(after, F.col(f"_after_{c}"))
    rows = rows.withColumns({k: pick(k) for k in ("s0", "s1", "output_start", "next_start")})
    clamp_start, clamp_end = F.col("start") < F.col("s0"), F.col("end") > F.col("s1")
    fate = F.when(F.col("s0").isNull(), "Discarded").when(clamp_start | clamp_end, "Clipped").otherwise("Shifted")
    flag = lambda c: F.when(F.col("s0").isNotNull(), F.coalesce(c, F.lit(False)))
    shift = F.col("output_start") - F.col("s0")
    return rows.select(
        *events.columns, fate.alias("fate"), (F.greatest("start", "s0") + shift).alias("_os"), (F.least("end", "s1") + shift).alias("_oe"),
        flag(clamp_start).alias("start_clamped"), flag(clamp_end).alias("end_clamped"), flag(F.col("end") > F.col("next_start")).alias("spans_multiple"), F.col("s0").alias("_s0"),
    ).select(
        *events.columns, "fate", F.when(F.col("_s0").isNotNull(), F.col("_os")).alias("out_start"), F.when(F.col("_s0").isNotNull(), F.col("_oe")).alias("out_end"),
        "start_clamped", "end_clamped", "spans_multiple",
    )


def to_units(ticks: Column | str, timescale: int, per_second: int, up: bool = False) -> Column:
    """Ticks in units of a fraction of a second, rounded down, or up; for ticks from 0 on."""
    whole = (F.col(ticks) if isinstance(ticks, str) else ticks).cast("decimal(38,0)") * F.lit(per_second)
    return _div(whole + F.lit(timescale - 1 if up else 0), timescale)


def to_ticks(units: Column | str, timescale: int, per_second: int) -> Column:
    return _div((F.col(units) if isinstance(units, str) else units).cast("decimal(38,0)") * F.lit(timescale), per_second)


def _div(value: Column, by: int) -> Column:
    """Integer division of non-negative decimals: no rounding through a fraction."""
    value = value.cast("decimal(38,0)")
    return ((value - value % F.lit(by)) / F.lit(by)).cast("long")
