"""Subtitle files rewritten to the output clock. What isn't an event passes through unchanged, byte for byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_ass_time, format_srt_time, has_relative_timing, parse_ass_time, parse_srt_time, split_time
from ..operators.remap import map_events, to_ticks, to_units
from ..sources.texts import BOM, split_lines, srt_blocks


#: Lines that one task joins.
STRETCH = 16_384


def _joined(rows: DataFrame) -> DataFrame:
    """Files of their lines: stretches of lines first, so that the row of a file gathers few long texts."""
    lines = rows.select("media_id", F.floor(F.col("line") / STRETCH).alias("stretch"), "line", "bom", F.concat("text", "terminator").alias("t"))
    joined = lines.groupBy("media_id", "stretch").agg(F.expr("listagg(t, '') within group (order by line)").alias("t"), F.bool_or("bom").alias("bom"))
    # the byte order mark goes before the first stretch that has lines left
    marked = joined.groupBy("media_id").agg(F.bool_or("bom").alias("_bom"), F.min("stretch").alias("stretch")).filter("_bom")
    joined = joined.join(marked, ["media_id", "stretch"], "left").withColumn("t", F.when(F.col("_bom"), F.concat(F.lit(BOM), "t")).otherwise(F.col("t")))
    return joined.groupBy("media_id").agg(F.expr("listagg(t, '') within group (order by stretch)").alias("text"))


def remap_ass(files: DataFrame, segments: DataFrame, timescale: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``media_id, text``; events with their fate; faults and warnings with ``severity``).

    Columns are where the section's Format line says; the last one takes the rest of the line, commas included.
    """
    lines = split_lines(files)
    w = Window.partitionBy("media_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = F.regexp_extract("text", r"^\s*\[(.*)\]\s*$", 1)
    rows = lines.withColumn("section", F.last(F.when(F.col("text").rlike(r"^\s*\[.*\]\s*$"), section), ignorenulls=True).over(w))
    events = F.lower(F.coalesce("section", F.lit(""))) == "events"
    rows = rows.withColumn("names", F.when(events & F.col("text").rlike("^Format:"), F.transform(F.split(F.regexp_replace("text", "^Format:", ""), ","), lambda x: F.lower(F.trim(x)))))
    rows = rows.withColumn("format", F.last("names", ignorenulls=True).over(w))
    rows = rows.withColumn("is_event", events & F.col("text").rlike("^(Dialogue|Comment):"))
    rows = rows.withColumns({
        "fields": F.expr("split(substring(text, instr(text, ':') + 1), ',', size(format))"), "si": F.array_position("format", "start").cast("int") - 1,
        "ei": F.array_position("format", "end").cast("int") - 1,
    })
    usable = F.col("is_event") & F.col("format").isNotNull() & (F.col("si") >= 0) & (F.col("ei") >= 0) & (F.size("fields") >= F.size("format"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    times = rows.filter("usable").withColumns({"cs": parse_ass_time(F.get("fields", "si")), "ce": parse_ass_time(F.get("fields", "ei"))})
    bad = times.filter("cs is null or ce is null").select("media_id", F.col("line").cast("long").alias("ord"), F.lit("time").alias("code"), F.col("text").alias("detail"), F.lit("error").alias("severity"))
    passed = rows.filter("is_event and not usable").select("media_id", F.col("line").cast("long").alias("ord"), F.lit("no_format_or_fields").alias("code"), F.col("text").alias("detail"), F.lit("warning").alias("severity"))
    asked = times.filter("cs is not null and ce is not null").select("media_id", F.col("line").alias("event_id"), to_ticks("cs", timescale, 100).alias("start"), to_ticks("ce", timescale, 100).alias("end"))
    found = map_events(asked, segments)
    place = found.select("media_id", F.col("event_id").alias("line"), "fate", "start_clamped", to_units("out_start", timescale, 100).alias("os"), to_units("out_end", timescale, 100, up=True).alias("oe"))
    rows = rows.join(place, ["media_id", "line"], "left").filter("fate is null or fate <> 'Discarded'")
    # a time keeps the blanks around it
    put = lambda f, t: F.concat(F.regexp_extract(f, r"^\s*", 0), t, F.regexp_extract(f, r"\s*$", 0))
    changed = F.transform("fields", lambda f, i: F.when(i == F.col("si"), put(f, format_ass_time("os"))).when(i == F.col("ei"), put(f, format_ass_time("oe"))).otherwise(f))
    text = F.when(F.col("fate").isNotNull(), F.concat(F.expr("substring(text, 1, instr(text, ':'))"), F.array_join(changed, ","))).otherwise(F.col("text"))
    relative = rows.filter(F.coalesce("start_clamped", F.lit(False)) & has_relative_timing("text")).select("media_id", F.col("line").cast("long").alias("ord"), F.lit("relative_timing").alias("code"), F.col("text").alias("detail"), F.lit("warning").alias("severity"))
    return _joined(rows.withColumn("text", text)), found, bad.unionByName(passed).unionByName(relative)


def remap_srt(files: DataFrame, segments: DataFrame, timescale: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for SRT: of a discarded block the blank lines stay; numbers stay as they are."""
    lines = srt_blocks(split_lines(files))
    arrow = F.col("text").contains("-->")
    head = lines.filter(arrow).groupBy("media_id", "block").agg(F.min("line").alias("line"), F.min_by("text", "line").alias("timing"))
    left, right = F.trim(F.substring_index("timing", "-->", 1)), F.ltrim(F.expr("substring(timing, instr(timing, '-->') + 3)"))
    stop, rest = split_time(right)
    head = head.withColumns({"ms": parse_srt_time(left), "me": parse_srt_time(stop), "rest": rest})
    bad = head.filter("ms is null or me is null").select("media_id", F.col("line").cast("long").alias("ord"), F.lit("time").alias("code"), F.col("timing").alias("detail"), F.lit("error").alias("severity"))
    asked = head.filter("ms is not null and me is not null").select("media_id", F.col("block").alias("event_id"), to_ticks("ms", timescale, 1000).alias("start"), to_ticks("me", timescale, 1000).alias("end"))
    found = map_events(asked, segments)
    place = found.select("media_id", F.col("event_id").alias("block"), "fate", to_units("out_start", timescale, 1000).alias("os"), to_units("out_end", timescale, 1000, up=True).alias("oe"))
    # a row for each block, whatever the planner guesses
    rows = lines.join(place.hint("merge"), ["media_id", "block"], "left").join(head.select("media_id", "block", F.col("line").alias("at"), "rest", "timing").hint("merge"), ["media_id", "block"], "left")
    rows = rows.filter("fate is null or fate <> 'Discarded' or length(trim(text)) = 0")
    timed = F.concat(format_srt_time("os"), F.lit(" --> "), format_srt_time("oe"), "rest")
    text = F.when(F.col("fate").isin("Shifted", "Clipped") & (F.col("line") == F.col("at")), timed).otherwise(F.col("text"))
    return _joined(rows.withColumn("text", text)), found, bad


def fates(found: DataFrame) -> DataFrame:
    return found.groupBy("media_id").agg(*(F.count_if(F.col("fate") == k).alias(k.lower()) for k in ("Shifted", "Clipped", "Discarded")))
