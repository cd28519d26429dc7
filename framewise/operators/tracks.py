"""Rules over a container's tracks, ``media_id, track_id, kind, codec, timescale, has_edit_list, stsd_entries, width, height``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEADING

#: Codecs whose tracks count as audio (fixed by the format).
AUDIO_CODECS = ("Opus", "fLaC", "mp4a", "ac-3", "ec-3", "samr", "ipcm", "fpcm", "sowt", "twos", "lpcm", "in24", "in32", "fl32", "fl64", "s16l")
VIDEO_CODECS = ("avc1",)
TEXT_CODECS = ("tx3g", "wvtt")


def with_kind(tracks: DataFrame) -> DataFrame:
    kind = F.when(F.col("codec").isin(*VIDEO_CODECS), "video").when(F.col("codec").isin(*AUDIO_CODECS), "audio").otherwise("other")
    return tracks.withColumn("kind", kind)


def first_of(tracks: DataFrame, kind: str) -> DataFrame:
    """The first track of that kind in each medium."""
    return tracks.filter(F.col("kind") == kind).groupBy("media_id").agg(F.min_by(F.struct(*tracks.columns[1:]), "track_id").alias("t")).select("media_id", "t.*")


def inspected(tracks: DataFrame) -> DataFrame:
    """Numbers of tracks by kind, edit lists, several sample descriptions, and the subtitle format of the first track that is neither."""
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    text = F.min_by(F.when(F.col("codec").isin(*TEXT_CODECS), "srt").otherwise("ass"), F.when(F.col("kind") == "other", F.col("track_id")))
    return tracks.groupBy("media_id").agg(
        of("video"), of("audio"), of("other"), F.bool_or("has_edit_list").alias("edit_list"), F.max("stsd_entries").alias("stsd_entries"),
        F.when(F.count_if(F.col("kind") == "other") > 0, text).alias("subtitle_format"),
    )


def leading_frames(index: DataFrame) -> DataFrame:
    """``media_id, leading``: how many frames carry the flag of a leading sample."""
    return index.groupBy("media_id").agg(F.count_if(F.col("flags").bitwiseAND(LEADING) != 0).alias("leading"))


def open_gops(index: DataFrame) -> DataFrame:
    """``media_id, open_gop``: a leading sample or one that needs an earlier random access point."""
    return index.groupBy("media_id").agg((F.count_if(F.col("flags").bitwiseAND(34) != 0) > 0).alias("open_gop"))


def support(tracks: DataFrame, index: DataFrame) -> DataFrame:
    """``media_id, reason``: the first rule that an input breaks, in the order tracks, edit list, descriptions, groups of pictures; null if none.
    A medium without an index can't be judged, which is a reason too."""
    rows = inspected(tracks).join(open_gops(index), "media_id", "left")
    reason = (
        F.when(F.col("video") != 1, "video_tracks")
        .when(F.col("audio") > 1, "audio_tracks")
        .when(F.col("other") > 0, "other_tracks")
        .when(F.col("edit_list"), "edit_list")
        .when(F.col("stsd_entries") > 1, "sample_descriptions")
        .when(F.col("open_gop").isNull(), "no_index")
        .when(F.col("open_gop"), "open_gop")
    )
    return rows.select("media_id", reason.alias("reason"))


def preparation_fault(tracks: DataFrame) -> DataFrame:
    """Media with several video or audio tracks, which can't be prepared."""
    return inspected(tracks).filter("video >= 2 or audio >= 2").select("media_id", "video", "audio")


def needs_preparation(tracks: DataFrame) -> DataFrame:
    return inspected(tracks).select("media_id", (F.col("edit_list") | (F.col("other") > 0)).alias("needed"), "subtitle_format")
