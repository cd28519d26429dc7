"""Text formats. Every parser takes ``media_id, text`` (one file a row) and gives rows and faults, ``media_id, ord, code, detail``; the fault of
the smallest ``ord`` is the one to report. Writers give ``media_id, text``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.errors import ParseError
from ..operators.sequence import CHUNK, running

BOM = "﻿"
MAX_FRAME = (1 << 32) - 1


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``media_id, text``: the path is the id."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("media_id"), F.col("value").alias("text"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("media_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "value"))


def _faults(rows: DataFrame, ord_: str = "line", detail: str = "value") -> DataFrame:
    return rows.filter("code is not null").select("media_id", F.col(ord_).cast("long").alias("ord"), "code", F.col(detail).cast("string").alias("detail"))


# -- ranges --------------------------------------------------------------------------------------------------------------------------------


def parse_trim(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``Trim(a,b) ++ Trim(c,d)``, ends included, to half-open ranges. Ranges ascend; they may touch."""
    tokens = files.select("media_id", F.posexplode(F.split(F.trim("text"), r"\+\+")).alias("range_id", "token")).withColumn("token", F.regexp_replace("token", r"^\s+|\s+$", ""))
    inner = F.regexp_extract("token", r"^Trim\((.*)\)$", 1)
    fields = F.transform(F.split(inner, ","), lambda x: F.trim(x))
    n = lambda i: F.get(fields, F.lit(i)).try_cast("decimal(20,0)")
    rows = tokens.withColumns({"ok": F.col("token").rlike(r"^Trim\(.*\)$") & (F.size(fields) == 2), "s": n(0), "e": n(1)})
    plain = F.forall(fields, lambda f: f.rlike("^[0-9]+$"))
    w = Window.partitionBy("media_id").orderBy("range_id")
    rows = rows.withColumn("before", F.lag("e").over(w))
    code = (
        F.when(F.length("token") == 0, "empty")
        .when(~F.col("ok"), "malformed")
        .when(~plain | F.col("s").isNull() | F.col("e").isNull(), "invalid_number")
        .when((F.col("s") > MAX_FRAME) | (F.col("e") > MAX_FRAME), "invalid_number")
        .when(F.col("e") + 1 > MAX_FRAME, "overflow")
        .when(F.col("s") > F.col("e"), "empty_range")
        .when(F.col("s") <= F.col("before"), "not_ascending_or_overlapping")
    )
    rows = rows.withColumn("code", code)
    good = rows.filter("code is null").select("media_id", F.col("range_id").cast("long").alias("range_id"), F.col("s").cast("long").alias("start"), (F.col("e").cast("long") + 1).alias("end"))
    return good, _faults(rows, "range_id", "token")


def format_trim(ranges: DataFrame) -> DataFrame:
    token = F.format_string("Trim(%d,%d)", "start", F.col("end") - 1)
    listed = ranges.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("range_id", token.alias("t")))).alias("ts"))
    return listed.select("media_id", F.expr("array_join(transform(ts, t -> t.t), ' ++ ')").alias("text"))


# -- structure -----------------------------------------------------------------------------------------------------------------------------


def parse_jls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Six columns after a header line; labels are free."""
    rows = _lines(files).filter("line > 0").withColumn("f", F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")).filter(F.length(F.trim("value")) > 0)
    f = lambda i: F.get("f", F.lit(i))
    whole = lambda i: F.when(f(i).rlike(r"^\+?[0-9]+$"), f(i).try_cast("long"))
    signed = lambda i: F.when(f(i).rlike(r"^[+-]?[0-9]+$"), f(i).try_cast("int"))
    rows = rows.withColumns({"start": whole(0), "end": whole(1), "duration_sec": signed(2), "error_frames": signed(3), "logo_sec": signed(4), "label": f(5)})
    bad = F.lit(False)
    for c in ("start", "end", "duration_sec", "error_frames", "logo_sec"):
        bad = bad | F.col(c).isNull()
    code = F.when(F.size("f") != 6, "columns").when(bad | (F.col("start") > MAX_FRAME) | (F.col("end") > MAX_FRAME), "number")
    rows = rows.withColumn("code", code)
    w = Window.partitionBy("media_id").orderBy("line")
    good = rows.filter("code is null").withColumn("entry_id", (F.row_number().over(w) - 1).cast("long"))
    return good.select("media_id", "entry_id", "start", "end", "duration_sec", "error_frames", "logo_sec", "label"), _faults(rows)


# -- frame index ---------------------------------------------------------------------------------------------------------------------------

INDEX_COLUMNS = ("frame_number", "sample_number", "random_access_sample", "file_offset", "pts", "dts", "duration", "flags")


def parse_index(files: DataFrame, magic: str = "DTVINDEX") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers (``media_id, format_version, header``), frames and faults of tab-separated frame indexes.

    Unknown header keys stay as strings, blank lines are skipped, END is optional. Frame numbers count up from 0.
    """
    head = F.expr("substring_index(text, '\nFRAMES', 1)")
    frames_at = F.expr("instr(text, '\nFRAMES')")
    parts = files.select("media_id", F.regexp_replace("text", "\r\n", "\n").alias("text")).withColumns({"head": head, "at": frames_at})
    first = F.split(F.get(F.split("head", "\n"), F.lit(0)), "\t")
    lines = F.filter(F.slice(F.split("head", "\n"), 2, 1 << 20), lambda x: F.length(F.trim(x)) > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.get(F.split(x, "\t", 2), F.lit(0)).alias("k"), F.coalesce(F.get(F.split(x, "\t", 2), F.lit(1)), F.lit("")).alias("v")))
    once = F.aggregate(pairs, F.array().cast("array<struct<k:string,v:string>>"), lambda a, x: F.array_append(F.filter(a, lambda y: y["k"] != x["k"]), x))
    headers = parts.select("media_id", F.get(first, F.lit(1)).alias("format_version"), F.map_from_entries(once).alias("header"), F.get(first, F.lit(0)).alias("m"), "at")
    code = F.when(F.col("m") != magic, "magic").when(F.col("at") == 0, "no_frames")
    faults = _faults(headers.withColumn("code", code).withColumn("ord", F.lit(-1)), "ord", "m")
    body = parts.filter("at > 0").select("media_id", F.posexplode(F.split(F.expr("substring(text, at + 1)"), "\n")).alias("line", "value")).filter("line > 0")
    ends = body.filter("trim(value) = 'END'").groupBy("media_id").agg(F.min("line").alias("stop"))
    rows = body.join(ends, "media_id", "left").filter("stop is null or line < stop").filter(F.length(F.trim("value")) > 0).withColumn("f", F.split("value", "\t"))
    rows = rows.withColumns({c: F.get("f", F.lit(i)).try_cast("long") for i, c in enumerate(INDEX_COLUMNS)})
    w = Window.partitionBy("media_id").orderBy("line")
    rows = rows.withColumn("want", F.row_number().over(w) - 1)
    missing = F.lit(False)
    for c in INDEX_COLUMNS:
        missing = missing | F.col(c).isNull()
    code = F.when(F.size("f") != len(INDEX_COLUMNS), "columns").when(missing, "number").when(F.col("frame_number") != F.col("want"), "frame_number")
    rows = rows.withColumn("code", code)
    frames = rows.filter("code is null").select("media_id", *INDEX_COLUMNS)
    size = Window.partitionBy("media_id")
    twice = Window.partitionBy("media_id", "sample_number")
    odd = frames.withColumns({"n": F.count(F.lit(1)).over(size), "k": F.count(F.lit(1)).over(twice)}).filter("k > 1 or sample_number < 0 or sample_number >= n")
    odd = odd.withColumn("code", F.lit("not_a_permutation"))
    return headers.drop("m", "at"), frames, faults.unionByName(_faults(rows)).unionByName(_faults(odd, "frame_number", "sample_number"))


# -- segment maps --------------------------------------------------------------------------------------------------------------------------

SEGMENT_FIELDS = ("source_start_frame", "source_end_frame", "source_start_dts", "frame_count", "output_start", "duration")
MAP_FIELDS = ("video_timescale", "frame_rate_num", "frame_rate_den")
MAP_SCHEMA = (
    "struct<video_timescale:bigint,frame_rate_num:bigint,frame_rate_den:bigint,input:string,total_frames:bigint,segments:array<struct<"
    + ",".join(f"{c}:bigint" for c in SEGMENT_FIELDS)
    + ">>>"
)


def parse_segment_map(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``media_id`` and the map's fields; fields come in any order, but each must be there and of its type."""
    rows = files.withColumn("m", F.from_json("text", MAP_SCHEMA, {"mode": "PERMISSIVE"}))
    missing = F.col("m").isNull()
    for c in (*MAP_FIELDS, "input", "total_frames", "segments"):
        missing = missing | F.col(f"m.{c}").isNull()
    missing = missing | F.coalesce(F.exists("m.segments", lambda s: F.array_contains(F.array(*(s[c].isNull() for c in SEGMENT_FIELDS)), True)), F.lit(True))
    rows = rows.withColumn("code", F.when(missing, "segment_map"))
    return rows.filter("code is null").select("media_id", "m.*"), _faults(rows.withColumn("ord", F.lit(0)), "ord", "text")


def segment_map_json(video_timescale: int, frame_rate_num: int, frame_rate_den: int, input_path: str, total_frames: int, segments: list[dict]) -> str:
    """Two blanks of indent, fields in declared order, a line feed at the end."""
    out = {"video_timescale": video_timescale, "frame_rate_num": frame_rate_num, "frame_rate_den": frame_rate_den, "input": input_path, "total_frames": total_frames}
    return json.dumps(out | {"segments": [{k: s[k] for k in SEGMENT_FIELDS} for s in segments]}, indent=2, ensure_ascii=False) + "\n"


def load_segment_map(text: str) -> dict:
    """One map on the driver, with the same rules."""
    try:
        m = json.loads(text)
        whole = all(type(m[k]) is int and m[k] >= 0 for k in (*MAP_FIELDS, "total_frames")) and isinstance(m["input"], str)
        if not whole or not all(type(s[k]) is int and s[k] >= 0 for s in m["segments"] for k in SEGMENT_FIELDS):
            raise ParseError("segment_map", "a field has another type")
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ParseError("segment_map", str(e)) from e
    return m


# -- lines and blocks ----------------------------------------------------------------------------------------------------------------------


def has_bom(text: Column | str) -> Column:
    return F.startswith(F.col(text) if isinstance(text, str) else text, F.lit(BOM))


def split_lines(files: DataFrame) -> DataFrame:
    """``media_id, bom, line, text, terminator``: every line with the terminator it had, so that they join to the file again.

    A large file may come in pieces, rows with a column ``piece`` that gives their order; each but the last ends with a line feed.
    """
    first, base = F.lit(True), F.lit(0)
    if "piece" in files.columns:
        feeds = F.length("text") - F.length(F.replace("text", F.lit("\n")))
        before = running(files.select("media_id", "piece", feeds.cast("long").alias("_n")), ["media_id"], "piece", _base=("_n", False))
        starts = files.groupBy("media_id").agg(F.min("piece").alias("_first"))
        files = files.join(before.drop("_n"), ["media_id", "piece"]).join(starts, "media_id")
        first, base = F.col("piece") == F.col("_first"), F.col("_base")
    bom = has_bom("text") & first
    body = F.when(bom, F.substring("text", 2, (1 << 31) - 1)).otherwise(F.col("text"))
    found = F.regexp_extract_all(body, F.lit("[^\\n]*\\n|[^\\n]+$"), F.lit(0))
    rows = files.select("media_id", bom.alias("bom"), base.alias("_base"), F.posexplode(found).alias("line", "whole"))
    rows = rows.withColumn("line", F.col("_base") + F.col("line")).drop("_base")
    end = F.when(F.endswith("whole", F.lit("\r\n")), "\r\n").when(F.endswith("whole", F.lit("\n")), "\n").otherwise("")
    return rows.select("media_id", "bom", "line", F.substring("whole", F.lit(1), F.length("whole") - F.length(end)).alias("text"), end.alias("terminator"))


def srt_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with ``block``: lines up to and with the blank lines after them."""
    blank = F.length(F.trim("text")) == 0
    # windows inside chunks of lines, and one over a row for each chunk
    inside, chunks = Window.partitionBy("media_id", "_chunk").orderBy("line"), Window.partitionBy("media_id").orderBy("_chunk")
    rows = lines.withColumns({"_blank": blank, "_chunk": F.floor(F.col("line") / CHUNK)})
    rows = rows.withColumn("_opens", F.when(~F.col("_blank") & F.coalesce(F.lag("_blank").over(inside), F.lit(False)), 1).otherwise(0).cast("long"))
    rows = rows.withColumn("_block", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("media_id", "_chunk").agg(F.sum("_opens").alias("_n"), F.min_by("_blank", "line").alias("_first"), F.max_by("_blank", "line").alias("_last"))
    ends = ends.withColumn("_edge", F.when(~F.col("_first") & F.coalesce(F.lag("_last").over(chunks), F.lit(False)), 1).otherwise(0).cast("long"))
    before = F.coalesce(F.sum(F.col("_n") + F.col("_edge")).over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("media_id", "_chunk", (before + F.col("_edge")).alias("_base"))
    return rows.join(ends, ["media_id", "_chunk"]).select(*lines.columns, (F.col("_base") + F.col("_block")).alias("block"))
