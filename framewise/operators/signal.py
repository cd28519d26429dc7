"""Intervals from a score per frame: rolling votes, filling of undecided runs, and refined interval boundaries.

Scores of a medium are in display order, ``media_id, display_idx, raw``. Windows look half a second or a second to both sides, so frames are
windowed in overlapping chunks: each chunk carries copies of the frames around it, and no task holds more than a chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import carried, running

KEY = ["media_id"]
THRESHOLD, PEAK_THRESHOLD = 0.2, 0.5
CHUNK = 16_384
#: Means add up blocks of so many frames, counted from so many frames before the first.
BLOCK, LEAD = 16, 38
HAS, NO, UNKNOWN = "Has", "No", "Unknown"


def half(fps: float, seconds: float) -> int:
    """Frames on each side of a window: the rate is rounded first, halves away from zero."""
    return int(math.floor(fps + 0.5) * seconds / 2 + 0.5)


def raw_score(corr0: str = "corr0", corr1: str = "corr1") -> Column:
    """Presence minus absence, each of them clipped; what isn't a number counts as 0."""
    clip = lambda c, lo, hi: F.least(F.greatest(F.nanvl(c, F.lit(0.0)), F.lit(lo)), F.lit(hi))
    return clip(F.col(corr0), 0.0, 1.0) + clip(F.col(corr1), -1.0, 0.0)


def mean_of(raw: str, reach: int, window) -> tuple[Column, Column, Column]:
    """The values of a frame and ``reach`` frames on both sides (to be named ``_xs``), their mean, and their number (``_n``). The order of additions is
    fixed, so that a mean at a threshold doesn't depend on the plan: the frames before the first whole block one by one, whole blocks as their own sums, and then the frames after them."""
    around = window.rowsBetween(-reach, reach)
    left = f"least(size(_xs), pmod(-(display_idx - {reach} + {LEAD}), {BLOCK}))"
    add = "(s, x) -> s + x"
    fold = (
        f"aggregate(slice(_xs, {left} + 1 + {BLOCK} * ((size(_xs) - {left}) div {BLOCK}), {BLOCK}), "
        f"aggregate(sequence(0, (size(_xs) - {left}) div {BLOCK}), aggregate(slice(_xs, 1, {left}), 0D, {add}), "
        f"(t, k) -> if(k = 0, t, t + aggregate(slice(_xs, {left} + 1 + {BLOCK} * (k - 1), {BLOCK}), 0D, {add}))), {add})"
    )
    return F.collect_list(F.coalesce(raw, F.lit(0.0))).over(around), F.expr(f"try_divide({fold}, _n)"), F.count(raw).over(around)


def judged(scores: DataFrame, fps: float) -> DataFrame:
    """With ``median`` of half a second, and ``vote``: Unknown where two votes differ or both are undecided.

    One is on the mean of a second; the other, with a higher threshold, on the smaller of the largest scores of the half second before and after
    the frame, itself excluded. Beyond the ends, the first and the last score repeat.
    """
    reach, median_half = half(fps, 1.0), half(fps, 0.5)
    pad = max(reach, median_half) + 1
    last = scores.groupBy("media_id").agg(F.max("display_idx").alias("_last"), F.max_by("raw", "display_idx").alias("_tail"), F.min_by("raw", "display_idx").alias("_head"))
    ends = last.select("media_id", F.explode(F.expr(f"concat(sequence(-{pad}, -1), sequence(_last + 1, _last + {pad}))")).alias("display_idx"), "_head", "_tail")
    ends = ends.select("media_id", "display_idx", F.when(F.col("display_idx") < 0, F.col("_head")).otherwise(F.col("_tail")).alias("raw"))
    rows = scores.select("media_id", "display_idx", "raw").unionByName(ends)
    own = F.floor(F.col("display_idx") / CHUNK)
    around = F.array_distinct(F.array(F.floor((F.col("display_idx") - pad) / CHUNK), own, F.floor((F.col("display_idx") + pad) / CHUNK)))
    rows = rows.select("*", own.alias("_own"), F.explode(around).alias("_chunk"))
    w = Window.partitionBy("media_id", "_chunk").orderBy("display_idx")
    reach_out = lambda a, b: w.rowsBetween(a, b)
    xs, mean, n = mean_of("raw", reach, w)
    rows = rows.withColumns({
        "peak": F.least(F.max("raw").over(reach_out(-reach, -1)), F.max("raw").over(reach_out(1, reach))),
        "_xs": xs, "_n": n,
        "median": F.expr(f"percentile(raw, 0.5) over (partition by media_id, _chunk order by display_idx rows between {median_half} preceding and {median_half} following)"),
    })
    rows = rows.filter("_chunk = _own").join(last.select("media_id", "_last"), "media_id").filter("display_idx between 0 and _last")
    rows = rows.withColumn("mean", mean)
    a, b = vote("peak", PEAK_THRESHOLD), vote("mean")
    return rows.select("media_id", "display_idx", "raw", "peak", "mean", "median", F.when(a == b, a).otherwise(UNKNOWN).alias("vote"))


def vote(column: str, threshold: float = THRESHOLD) -> Column:
    return F.when(F.abs(column) < threshold, UNKNOWN).when(F.col(column) > 0, HAS).otherwise(NO)


def filled(votes: DataFrame) -> DataFrame:
    """With ``judgement``: runs of Unknown take their neighbours' vote where both agree; a missing neighbour counts as No."""
    known = F.col("vote") != UNKNOWN
    near = carried(votes, KEY, "display_idx", _b=(known, "below"), _a=(known, "above"))
    at = lambda k: votes.select("media_id", F.col("display_idx").alias(k), F.col("vote").alias(f"{k}v"))
    rows = near.join(at("_b"), ["media_id", "_b"], "left").join(at("_a"), ["media_id", "_a"], "left")
    left, right = (F.coalesce(c, F.lit(NO)) for c in ("_bv", "_av"))
    return rows.select(*votes.columns, F.when(known, F.col("vote")).when(left == right, left).otherwise(UNKNOWN).alias("judgement"))


def intervals(frames: DataFrame, score: str = "median", threshold: float = THRESHOLD) -> DataFrame:
    """Intervals of presence: ``media_id, island, s_left, s_best, s_right, e_left, e_best, e_right`` (inclusive ends, as they are printed).

    Islands are what Has frames there are between two No frames. Each boundary moves to where the score crosses the threshold, zero and minus
    the threshold, which are lookups of the nearest frame before or after another one with a property.
    """
    sizes = frames.groupBy("media_id").agg((F.max("display_idx") + 1).alias("n"))
    s = F.col(score)
    end = sizes.select("media_id", F.col("n").alias("display_idx")).withColumns({score: F.lit(None).cast("double"), "judgement": F.lit(None).cast("string")})
    rows = frames.select("media_id", "display_idx", score, "judgement").unionByName(end.select("media_id", "display_idx", score, "judgement"))
    props = {"lt": s < threshold, "ge": s >= threshold, "le": s <= -threshold, "gt": s > -threshold, "pos": s > 0}
    looked = carried(rows, KEY, "display_idx", **{f"{d}_{k}": (F.coalesce(c, F.lit(False)), side) for k, c in props.items() for d, side in (("prev", "below"), ("next", "after"))})
    looked = looked.join(sizes, "media_id")
    looked = looked.select("media_id", F.col("display_idx").alias("k"), F.col(score).alias("v"), *(F.coalesce(f"prev_{p}", F.lit(-1)).alias(f"prev_{p}") for p in props), *(F.coalesce(f"next_{p}", "n").alias(f"next_{p}") for p in props))
    def look(df: DataFrame, at: str, **want: str) -> DataFrame:
        got = looked.select("media_id", F.col("k").alias(at), *(F.col(c).alias(n) for n, c in want.items()))
        return df.join(got, ["media_id", at], "left")

    groups = running(frames.select("media_id", "display_idx", "judgement"), KEY, "display_idx", g=(F.when(F.col("judgement") == NO, 1).otherwise(0), True))
    opens = groups.groupBy("media_id", "g").agg(F.min(F.when(F.col("judgement") == HAS, F.col("display_idx"))).alias("sr"), F.min("display_idx").alias("first"))
    w = Window.partitionBy("media_id").orderBy("g")
    opens = opens.withColumn("er", F.lead("first").over(w)).join(sizes, "media_id").withColumn("er", F.coalesce("er", "n")).filter("sr is not null")
    isl = opens.withColumns({"it": F.lag("er", 1, 0).over(w), "island": F.row_number().over(w) - 1})
    isl = look(isl, "sr", v_sr="v", a1="prev_lt", a2="next_ge")
    isl = isl.withColumn("s", F.when(F.col("v_sr") >= threshold, F.greatest("it", F.col("a1") + 1)).otherwise(F.col("a2")))
    isl = look(isl, "er", v_er="v", b1="prev_gt", b2="next_le")
    isl = isl.withColumn("e", F.when(F.col("er") == F.col("n"), F.col("er")).when(F.col("v_er") <= -threshold, F.greatest("s", F.col("b1") + 1)).otherwise(F.col("b2")))
    isl = look(look(isl, "s", c1="prev_le"), "e", c2="prev_ge", c3="prev_pos")
    isl = isl.withColumns({"ss": F.greatest("it", F.col("c1") + 1), "es": F.greatest("s", F.col("c2") + 1)})
    isl = look(isl, "ss", d1="next_pos")
    isl = isl.withColumns({"sb": F.least("s", "d1"), "eb": F.greatest("es", F.col("c3") + 1)}).filter("s < e")
    return isl.select(
        "media_id", "island", F.col("ss").alias("s_left"), F.col("sb").alias("s_best"), F.col("s").alias("s_right"),
        (F.col("es") - 1).alias("e_left"), (F.col("eb") - 1).alias("e_best"), (F.col("e") - 1).alias("e_right"),
    )


def presence(frames: DataFrame) -> DataFrame:
    return frames.groupBy("media_id").agg(F.count_if(F.col("judgement") == HAS).alias("logo_frames"), F.count(F.lit(1)).alias("total_frames"))


def interval_text(found: DataFrame) -> DataFrame:
    """``media_id, text``: two lines for each interval."""
    line = lambda k, b, lo, hi: F.format_string(f"%6d {k} 0 ALL %6d %6d\n", b, lo, hi)
    pair = F.concat(line("S", "s_best", "s_left", "s_right"), line("E", "e_best", "e_left", "e_right"))
    lines = found.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("island", pair.alias("t")))).alias("ls"))
    return lines.select("media_id", F.expr("array_join(transform(ls, l -> l.t), '')").alias("text"))
