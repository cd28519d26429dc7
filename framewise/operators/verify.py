"""Checks of a cut. Each gives a frame of faults, ``media_id, ord, code, detail``; an empty one means that the check holds.

Empty inputs never pass: a comparison of nothing with nothing is a fault.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audio import audio_segments, independent_source_starts
from .errors import raise_first
from .packets import clocks, display_order, index_mismatches, not_increasing, order_ties, permutation

FAULT = ["media_id", "ord", "code", "detail"]


def _fault(rows: DataFrame, code: str, ord_: str, *detail: str) -> DataFrame:
    return rows.select("media_id", F.col(ord_).cast("long").alias("ord"), F.lit(code).alias("code"), F.concat_ws(" ", *detail).alias("detail"))


def none(df: DataFrame) -> DataFrame:
    """No fault, in the session of ``df``."""
    return df.sparkSession.createDataFrame([], "media_id string, ord long, code string, detail string")


def ranges_hold(output: DataFrame, moved: DataFrame) -> DataFrame:
    """Every range has ``end - start`` packets, more than none, and starts with a sync packet; ``output``: media_id, range_id, position, is_sync."""
    got = output.groupBy("media_id", "range_id").agg(F.count(F.lit(1)).alias("got"), F.min_by("is_sync", "position").alias("opens"))
    rows = moved.join(got, ["media_id", "range_id"], "left").fillna(0, ["got"])
    count = rows.filter("got = 0 or got <> end - start").withColumn("want", F.col("end") - F.col("start"))
    return _fault(count, "packet_count", "range_id", "want", "got").unionByName(_fault(rows.filter("got > 0 and not opens"), "no_sync_at_start", "range_id", "start"))


def display_contiguous(output: DataFrame) -> DataFrame:
    """Composition times of the output don't tie, decode times rise, and there are frames at all."""
    ordered = display_order(output)
    ties = order_ties(ordered).withColumn("list", F.array_join("decode_idxs", ","))
    rising = not_increasing(clocks(output), "decode_idx", "dts")
    holes = permutation(ordered, "display_idx").filter("not is_permutation").withColumn("ord", F.lit(0))
    return _fault(ties, "display_tie", "cts", "list").unionByName(_fault(rising, "dts_not_rising", "decode_idx", "before", "dts")).unionByName(_fault(holes, "display_holes", "ord", "n"))


def matches_index(packets: DataFrame, index: DataFrame) -> DataFrame:
    return index_mismatches(display_order(packets), index).select(*FAULT)


def audio_positions(moved: DataFrame, durations: DataFrame, packets: DataFrame, audio: DataFrame, chosen: DataFrame, output: DataFrame, video_timescale: int, audio_timescale: int, most: float = 1.5) -> DataFrame:
    """The first audio packet of each segment stands where the source packets alone say, within 1.5 average packets, and has the same bytes.

    ``audio`` and ``output`` carry ``crc`` by decode_idx; segments without packets are skipped. The starts are derived anew, not taken from the cut.
    """
    starts = independent_source_starts(moved, packets)
    want = audio_segments(starts.join(durations, ["media_id", "range_id"]), audio, video_timescale, audio_timescale)
    average = audio.groupBy("media_id").agg((F.sum("duration") / F.count(F.lit(1))).alias("average"))
    timed = clocks(audio.withColumn("cts_offset", F.lit(0))).select("media_id", F.col("decode_idx").alias("start"), "dts", F.col("crc").alias("want_crc"))
    real = chosen.select("media_id", "range_id", F.col("start").alias("s"), F.col("end").alias("e"))
    rows = want.join(real, ["media_id", "range_id"]).filter("e > s and end > start").join(timed, ["media_id", "start"])
    at = clocks(audio.withColumn("cts_offset", F.lit(0))).select("media_id", F.col("decode_idx").alias("s"), F.col("dts").alias("real_dts"))
    first = output.groupBy("media_id", "range_id").agg(F.min_by("crc", "position").alias("got_crc"))
    rows = rows.join(at, ["media_id", "s"]).join(average, "media_id").join(first, ["media_id", "range_id"], "left")
    far = rows.filter(F.abs(F.col("real_dts") - F.col("dts")) > most * F.col("average"))
    other = rows.filter(~F.col("got_crc").eqNullSafe(F.col("want_crc")))
    return _fault(far, "audio_position", "range_id", "dts", "real_dts").unionByName(_fault(other, "audio_bytes", "range_id", "want_crc", "got_crc"))


def same_packets(expected: DataFrame, output: DataFrame) -> DataFrame:
    """Both hold ``media_id, position, crc``: as many rows, more than none, equal at every position."""
    both = expected.select("media_id", "position", F.col("crc").alias("want")).join(output.select("media_id", "position", F.col("crc").alias("got")), ["media_id", "position"], "full")
    wrong = _fault(both.filter("not want <=> got"), "packet_differs", "position", "want", "got")
    return wrong.unionByName(_empty(expected, "no_packets"))


def audio_subset(source: DataFrame, output: DataFrame) -> DataFrame:
    """Every output packet's bytes occur in the source, and decode times rise; names the first five strangers."""
    strange = output.join(source.select("media_id", "crc").distinct(), ["media_id", "crc"], "left_anti")
    strange = strange.groupBy("media_id").agg(F.min("position").alias("ord"), F.array_join(F.slice(F.array_sort(F.collect_set(F.col("crc").cast("string"))), 1, 5), ",").alias("list"))
    late = not_increasing(output, "position", "dts")
    return _fault(strange, "unknown_audio", "ord", "list").unionByName(_fault(late, "dts_not_rising", "position", "before", "dts")).unionByName(_empty(output, "no_audio"))


def _empty(df: DataFrame, code: str) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    return n.select(F.lit("").alias("media_id"), F.lit(-1).cast("long").alias("ord"), F.lit(code).alias("code"), F.lit("").alias("detail"))


def frame_count(luma: DataFrame, headers: DataFrame) -> DataFrame:
    """As many decoded frames as the index header says (``media_id, header_frame_count``)."""
    rows = headers.join(luma.groupBy("media_id").agg(F.count(F.lit(1)).alias("got")), "media_id", "left").fillna(0, ["got"])
    return _fault(rows.filter("got <> header_frame_count"), "frame_count", "got", "header_frame_count", "got")


def check(*faults: DataFrame) -> None:
    """Raise the first fault of the first check that has one."""
    for found in faults:
        raise_first(found)
