"""Cutting a medium: snap ranges, pick packets of both streams, write, read again and verify, publish."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audio as second
from ..operators import packets as pk
from ..operators import ranges as rg
from ..operators import tracks as tr
from ..operators import verify as vf
from ..operators.errors import CheckFailed, Unsupported, raise_first
from ..sources import isobmff as bmff
from ..sources.texts import parse_index, parse_trim, segment_map_json
from .runtime import published, reject_dash


@dataclass
class Cut:
    ranges: list[dict]
    segments: list[dict]
    av: dict | None
    packets: int


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _packets(spark: SparkSession, media: str, track: bmff.Track, length: int, path: str | None = None) -> DataFrame:
    every = bmff.samples(track, length)
    crcs = [zlib.crc32(d) for d in bmff.payloads(path, every)] if path else [None] * len(every)
    rows = [(media, i, o, s, d, c, y, h) for i, ((o, s, d, c, y), h) in enumerate(zip(every, crcs, strict=True))]
    return _frame(spark, rows, "media_id string, decode_idx long, file_offset long, size long, duration long, cts_offset long, is_sync boolean, crc long")


def cut(spark: SparkSession, source: Path, trim_text: str, index_text: str | None, output: Path, removed: Path | None = None, direction: str = "outward", video_only: bool = False, verify_bytes: bool = False, map_path: Path | None = None) -> Cut:
    """Write the kept ranges, and with ``removed`` what they leave, each only if every check of it holds."""
    for p, flag in ((output, "--output"), (removed, "--cm-output"), (map_path, "--map")):
        if p:
            reject_dash(p, flag)
    if map_path:
        map_path.unlink(missing_ok=True)
    rg.check_direction(direction, removed is not None)
    media = str(source)
    with source.open("rb") as f:
        moov, _, length = bmff.read_moov(f)
    found = bmff.tracks(moov)
    rows = [(media, t.track_id, t.kind, t.codec, t.timescale, t.has_edit_list, t.stsd_entries, t.width, t.height) for t in found]
    files = _frame(spark, [(media, index_text)] if index_text else [], "media_id string, text string")
    header, index, faults = parse_index(files)
    raise_first(faults)
    reason = tr.support(_frame(spark, rows, bmff.TRACK_SCHEMA), index).first()["reason"]
    if reason:
        raise Unsupported(reason, media)
    video, sound = bmff.first_track(found, "video"), None if video_only else bmff.first_track(found, "audio")
    packets = _packets(spark, media, video, length, media).cache()
    ordered = pk.display_order(packets).cache()
    raise_first(pk.order_ties(ordered).select(F.col("cts").alias("ord"), F.lit("display_tie").alias("code"), F.array_join("decode_idxs", ",").alias("detail")))
    totals = packets.groupBy("media_id").agg(F.count(F.lit(1)).alias("total_frames"))
    wanted, faults = parse_trim(_frame(spark, [(media, trim_text)], "media_id string, text string"))
    raise_first(faults)
    moved = rg.snap(wanted, pk.sync_display(ordered), totals, direction).cache()
    raise_first(vf.matches_index(packets, index))
    sides = {output: moved}
    keep = rg.keep_list(moved, ordered.select("media_id", "display_idx", "decode_idx")).cache()
    if removed:
        other = rg.complement(moved, totals)
        raise_first(rg.exclusivity_errors(keep, rg.keep_list(other, ordered), totals))
        sides[removed] = other
    tone = _packets(spark, media, sound, length, media).cache() if sound else None
    results = []
    with published(*sides) as temps:
        for temp, side in zip(temps, sides.values(), strict=True):
            results.append(_one(spark, source, temp, side, ordered, packets, video, tone, sound, verify_bytes))
    result = results[0]
    if map_path and result.segments:
        head = header.select("header").first()
        get = (head["header"] if head else {}).get
        total = totals.first()["total_frames"]
        map_path.parent.mkdir(parents=True, exist_ok=True)
        map_path.write_text(segment_map_json(video.timescale, int(get("frame_rate_num", 30000)), int(get("frame_rate_den", 1001)), media, total, result.segments))
    return result


def _one(spark, source: Path, temp: Path, moved: DataFrame, ordered: DataFrame, packets: DataFrame, video: bmff.Track, tone: DataFrame | None, sound: bmff.Track | None, verify_bytes: bool) -> Cut:
    keep = rg.keep_list(moved, ordered.select("media_id", "display_idx", "decode_idx")).cache()
    durations = second.segment_durations(keep, packets)
    starts = second.source_starts(moved, ordered)
    segments = rg.segment_map(moved, starts, durations).orderBy("range_id")
    wanted = {video.track_id: [r["decode_idx"] for r in keep.orderBy("position").collect()]}  # one file is written by one writer
    chosen, summary = None, None
    if sound is not None:
        chosen = second.audio_segments(starts.join(durations, ["media_id", "range_id"]), tone, video.timescale, sound.timescale).cache()
        wanted[sound.track_id] = [i for r in chosen.orderBy("range_id").collect() for i in range(r["start"], r["end"])]
    bmff.write_mp4(str(source), str(temp), wanted)
    # what was written is read again; nothing of the plan is taken for granted
    with temp.open("rb") as f:
        moov, _, length = bmff.read_moov(f)
    media, written = str(source), bmff.tracks(moov)
    out = _packets(spark, media, bmff.first_track(written, "video"), length, str(temp))
    placed = out.withColumnRenamed("decode_idx", "position").join(keep.select("position", "range_id"), "position", "left")
    vf.check(vf.ranges_hold(placed, moved), vf.display_contiguous(out))
    if chosen is not None and bmff.first_track(written, "audio"):
        heard = _packets(spark, media, bmff.first_track(written, "audio"), length, str(temp))
        spans = chosen.select("range_id", F.explode(F.expr("if(end > start, sequence(start, end - 1), cast(array() as array<bigint>))")).alias("i"))
        spans = spans.selectExpr("range_id", "row_number() over (order by range_id, i) - 1 as position")
        placed = heard.withColumnRenamed("decode_idx", "position").join(spans, "position", "left")
        vf.check(vf.audio_positions(moved, durations, packets, tone, chosen, placed, video.timescale, sound.timescale))
        summary = second.av_summary(second.av_segments(durations, chosen, tone, video.timescale, sound.timescale)).first()
    if verify_bytes:
        want = keep.join(packets.select("media_id", "decode_idx", "crc"), ["media_id", "decode_idx"])
        vf.check(vf.same_packets(want, out.withColumnRenamed("decode_idx", "position")))
    n = len(wanted[video.track_id])
    if not n:
        raise CheckFailed("nothing_kept")
    return Cut([r.asDict() for r in moved.orderBy("range_id").collect()], [r.asDict() for r in segments.collect()], summary.asDict() if summary else None, n)
