"""The texts of reports and warnings, as column expressions: one row in, one line or one text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import format_mm_ss, frame_time, is_cm

# The formats of the reports.
TOTALS = "保持区間数 %d / カット境界数 %d\n余分に残る量 %.1fs（境界あたり平均 %.2fs）\n出力の長さ %s\n"
BOUNDARY = "境界(%s) %6d : 直前KF=%s  直後KF=%s\n"
START, END, NO_KEYFRAME, KEYFRAME = "開始", "終了", "     -", "%6d (%+.2fs)"
GRID_TITLE, GRID = "CM ブロックの15秒格子誤差:\n", "  %6d-%-6d 誤差 %+d フレーム\n"
GATE = "gate 判定:\n  見逃し候補: %d 件%s\n  保持区間数 %d / 除去フレーム数 %d（総 %d フレーム中）%s\n  保持率 %.1f%%（閾値なし、参考値）\n"
GATE_GRID = "  15秒格子から外れた CM ブロック数 %d（|誤差| > 5 フレーム、閾値なし、参考値）\n  CM ブロックの格子誤差フレーム数の最大値 %s\n  総合判定: %s\n"
STOPS, LARGEST, NO_BLOCK = " → 止める", "%d（閾値なし、参考値）", "-（CM ブロックなし）"
STOP, GO = "疑わしいので止める", "止めない（見逃し候補ヒューリスティックが効かない番組もあるため、「検出が当たっている」保証ではない）"
AV_NONE, AV = "音声同期: 区間 0（対象区間なし）\n", "音声同期: 区間 %d / 最大ずれ %+.0f ms (区間 %d) / 合計 %+.0f ms%s\n"
AV_WARNING, AV_SEGMENT = " [警告: 閾値超過]", "  区間 %d: 映像 %.3fs 音声 %.3fs (%+.0f ms)\n"
MISSED = (
    "CM 検出の見逃し候補: %s〜%s (%d〜%d, %d フレーム, 検出済み CM ブロック長 %d フレームと一致)。trim.avs でこの区間を保持区間から除外する場合、"
    "該当する Trim(a,%d) ++ Trim(%d,b) のように分割することを検討してください。"
)


def _joined(rows: DataFrame, name: str, line: Column, *order: str | Column) -> DataFrame:
    """``media_id`` and the lines of each medium in order, as one text."""
    held = rows.select("media_id", F.struct(*order, line.alias("line")).alias("l"))
    lists = held.groupBy("media_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return lists.select("media_id", F.expr("array_join(transform(ls, l -> l.line), '')").alias(name))


def boundary_report(distances: DataFrame, summary: DataFrame, entries: DataFrame) -> DataFrame:
    """``media_id, text`` from boundaries' distances, what snapping retains, and the grid errors of detected blocks."""
    near = lambda k, s: F.when(F.col(k).isNull() | F.col(s).isNull(), NO_KEYFRAME).otherwise(F.format_string(KEYFRAME, k, s))
    line = F.format_string(BOUNDARY, F.when(F.col("kind") == "start", START).otherwise(END), "boundary", near("prev", "prev_s"), near("next", "next_s"))
    lines = _joined(distances, "lines", line, "range_id", (F.col("kind") == "end").alias("last"))
    grid = _joined(entries.filter(is_cm("label")), "grid", F.format_string(GRID, F.col("start").cast("long"), F.col("end").cast("long"), F.col("error_frames").cast("long")), "entry_id")
    head = F.format_string(TOTALS, "ranges", "boundaries", "extra_s", "extra_s_per_boundary", format_mm_ss("output_s"))
    rows = summary.join(lines, "media_id", "left").join(grid, "media_id", "left")
    tail = F.when(F.col("grid").isNull(), "").otherwise(F.concat(F.lit("\n" + GRID_TITLE), "grid"))
    return rows.select("media_id", F.concat(head, F.lit("\n"), F.coalesce("lines", F.lit("")), tail).alias("text"))


def gate_report(verdicts: DataFrame) -> DataFrame:
    """``media_id, text`` of verdicts."""
    stops = lambda c: F.when(F.col(c), STOPS).otherwise("")
    largest = F.when(F.col("max_grid_error").isNull(), NO_BLOCK).otherwise(F.format_string(LARGEST, F.col("max_grid_error").cast("long")))
    first = F.format_string(GATE, "missed", stops("stops_for_missed"), "range_count", "cut_frames", "total_frames", stops("stops_for_no_cut"), F.col("kept_ratio") * 100)
    second = F.format_string(GATE_GRID, "off_grid", largest, F.when(F.col("stop"), STOP).otherwise(GO))
    return verdicts.select("media_id", F.concat(first, second).alias("text"))


def av_report(media: DataFrame, segments: DataFrame, summary: DataFrame) -> DataFrame:
    """``media_id, text`` for each of ``media``; segments are numbered from 1 in their order, and the largest difference keeps its sign."""
    from pyspark.sql import Window

    numbered = segments.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("range_id")))
    line = F.format_string(AV_SEGMENT, "n", "video_s", "audio_s", "diff_ms")
    lines = _joined(numbered, "lines", line, "n")
    worst = numbered.join(summary.select("media_id", F.col("worst_range").alias("range_id"), "total_ms", "warn"), ["media_id", "range_id"])
    count = numbered.groupBy("media_id").agg(F.count(F.lit(1)).alias("k"))
    head = F.format_string(AV, "k", "diff_ms", "n", "total_ms", F.when(F.col("warn"), AV_WARNING).otherwise(""))
    rows = worst.join(count, "media_id").join(lines, "media_id").select("media_id", F.concat(head, "lines").alias("text"))
    return media.select("media_id").distinct().join(rows, "media_id", "left").select("media_id", F.coalesce("text", F.lit(AV_NONE)).alias("text"))


def missed_warning(fps: Column | float) -> Column:
    """The warning of a suspected block, with the split that would leave it out."""
    fps = F.lit(fps) if isinstance(fps, float) else fps
    at = lambda c: F.col(c).cast("long")
    return F.format_string(MISSED, frame_time("start", fps), frame_time("end", fps), at("start"), at("end"), at("length_frames"), at("matched_gap_length"), F.greatest(F.lit(0), at("start") - 1), at("end") + 1)
