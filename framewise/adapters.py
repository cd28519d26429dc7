"""The driver's star-schema and event tables read as frames, packets, ranges, events, scores and planes; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.sequence import islands

#: Packets of the second stream that one row gives.
CELL = 16_384


def media():
    return F.lit("m").alias("media_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hundredths():
    return F.round(F.col("value") * 100).cast("long")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(media(), F.col("event_id").alias("display_idx"), F.lit(1001).cast("long").alias("duration"), (F.col("event_id") % 120 == 0).alias("is_key"))


def frames_vfr(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("event_type") == "signup") | (F.col("event_id") == 0)
    return table(spark, sf_dir, "events").select(media(), F.col("event_id").alias("display_idx"), (900 + F.abs(_hundredths()) % 200).alias("duration"), key.alias("is_key"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("total_frames"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One medium a user; the composition offsets permute each group of four and never tie."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("media_id"), (F.row_number().over(w) - 1).cast("long").alias("decode_idx"), (F.abs(_hundredths()) % 977 + 1).alias("size"))
    m = F.col("decode_idx") % 4
    return rows.withColumns({
        "duration": F.lit(1001).cast("long"), "is_sync": F.col("decode_idx") % 12 == 0,
        "cts_offset": F.when(m == 0, 0).when(m == 1, 2002).otherwise(-1001).cast("long"), "file_offset": F.col("decode_idx") * 1000 + 48,
    })


def coarse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks of 500 frames of every four, shifted so that they don't start on sync frames."""
    n = totals(frames(spark, sf_dir))
    rows = n.select("media_id", "total_frames", F.explode(F.expr("sequence(0L, (total_frames - 38) div 2000)")).alias("range_id"))
    start = F.col("range_id") * 2000 + 37
    return rows.select("media_id", "range_id", start.alias("start"), F.least(start + 1500, "total_frames").alias("end"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of removed (error) and kept frames: ``media_id, removed, start, end``."""
    rows = table(spark, sf_dir, "events").select(media(), F.col("event_id").alias("display_idx"), (F.col("event_type") == "error").alias("removed"))
    return islands(rows, ["media_id"], "display_idx", "removed")


def kept_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("media_id").orderBy("start")
    return runs(spark, sf_dir).filter("not removed").select("media_id", (F.row_number().over(w) - 1).cast("long").alias("range_id"), "start", "end")


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with inclusive ends, one for each run and one for each third of a coarse range."""
    length = F.col("end") - F.col("start")
    mine = runs(spark, sf_dir).select("media_id", F.col("start").alias("entry_id"), "start", (F.col("end") - 1).alias("end"), (length % 31 - 15).alias("error_frames"), F.when(F.col("removed"), ":CM").otherwise(":L").alias("label"))
    return mine


def coarse_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each coarse range one entry as long as a gap between them, give or take two frames, and one that isn't."""
    rows = coarse_ranges(spark, sf_dir)
    parts = F.explode(F.array(F.struct(F.lit(0).alias("k"), (F.lit(497) + F.col("range_id") % 6).alias("n")), F.struct(F.lit(1).alias("k"), F.lit(300).cast("long").alias("n"))))
    rows = rows.select("media_id", "range_id", "start", parts.alias("p"))
    start = F.col("start") + 10 + F.col("p.k") * 600
    return rows.select("media_id", (F.col("range_id") * 2 + F.col("p.k")).alias("entry_id"), start.alias("start"), (start + F.col("p.n") - 1).alias("end"), (F.col("range_id") % 17 - 8).alias("error_frames"), F.when(F.col("p.k") == 0, ":L").otherwise(":CM").alias("label"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second stream over the same clock at 48,000 units a second; the first packet is long."""
    n = totals(frames(spark, sf_dir)).select("media_id", F.expr("total_frames * 1001 * 48000 div 30000 div 960").alias("n"))
    # cells are dealt out before they are filled, so no row and no task holds all numbers
    cells = n.filter("n > 0").select("media_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {CELL})")).alias("cell")).repartition("cell")
    rows = cells.select("media_id", F.explode(F.expr(f"sequence(cell * {CELL}, least(n, (cell + 1) * {CELL}) - 1)")).alias("decode_idx"))
    return rows.withColumn("duration", F.when(F.col("decode_idx") == 0, 3852).otherwise(960).cast("long"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse ranges on the clock of 30,000 units a second, and where they go."""
    rows = coarse_ranges(spark, sf_dir).select("media_id", "range_id", (F.col("start") * 1001).alias("source_start_dts"), ((F.col("end") - F.col("start")) * 1001).alias("duration"))
    w = Window.partitionBy("media_id").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("output_start", F.coalesce(F.sum("duration").over(w), F.lit(0)))


def sub_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.greatest(F.col("event_id") * 1001 - 400, F.lit(0))
    return table(spark, sf_dir, "events").select(media(), "event_id", start.alias("start"), (start + 200 + F.abs(_hundredths()) % 6000).alias("end"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow swings with noise on them."""
    swing = F.when(F.col("event_id") % 900 < 500, 100).otherwise(-100)
    return table(spark, sf_dir, "events").select(media(), F.col("event_id").alias("display_idx"), ((swing + F.abs(_hundredths()) % 161 - 80) / 100.0).alias("raw"))


def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 plane for each vector."""
    plane = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 200 * x.cast("double")).cast("int"))))
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("media_id"), F.col("vec_id").alias("display_idx"), plane.alias("plane"))


_H = "CAST(round(value * 100) AS BIGINT)"

#: The same tables for the SQL that results are held against.
SQL = {
    "frames": "SELECT 'm' AS media_id, event_id AS display_idx, 1001 AS duration, event_id % 120 = 0 AS is_key FROM events",
    "frames_vfr": f"SELECT 'm' AS media_id, event_id AS display_idx, 900 + abs({_H}) % 200 AS duration, event_type = 'signup' OR event_id = 0 AS is_key FROM events",
    "n": "SELECT count(*) AS n FROM events",
    "packets": f"""SELECT *, 1001 AS duration, decode_idx % 12 = 0 AS is_sync, decode_idx * 1000 + 48 AS file_offset, decode_idx * 1001 AS dts,
        CASE decode_idx % 4 WHEN 0 THEN 0 WHEN 1 THEN 2002 ELSE -1001 END AS cts_offset FROM
        (SELECT CAST(user_id AS VARCHAR) AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS decode_idx, abs({_H}) % 977 + 1 AS size FROM events)""",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY dts + cts_offset, decode_idx) - 1 AS display_idx FROM packets",
    "coarse": "SELECT 'm' AS media_id, k AS range_id, k * 2000 + 37 AS \"start\", least(k * 2000 + 1537, n) AS \"end\" FROM n, (SELECT unnest(range(0, 100000)) AS k) WHERE k * 2000 + 37 < n",
    "runs": """SELECT 'm' AS media_id, removed, min(event_id) AS "start", max(event_id) + 1 AS "end" FROM (SELECT event_id, removed, event_id - row_number() OVER (PARTITION BY removed ORDER BY event_id) AS g
        FROM (SELECT event_id, event_type = 'error' AS removed FROM events)) GROUP BY removed, g""",
    "kept": 'SELECT media_id, row_number() OVER (ORDER BY "start") - 1 AS range_id, "start", "end" FROM runs WHERE NOT removed',
    "structure": """SELECT media_id, "start" AS entry_id, "start", "end" - 1 AS "end", ("end" - "start") % 31 - 15 AS error_frames, CASE WHEN removed THEN ':CM' ELSE ':L' END AS label FROM runs""",
    "coarse_structure": """SELECT media_id, range_id * 2 + k AS entry_id, "start" + 10 + k * 600 AS "start", "start" + 10 + k * 600 + CASE k WHEN 0 THEN 497 + range_id % 6 ELSE 300 END - 1 AS "end",
        range_id % 17 - 8 AS error_frames, CASE k WHEN 0 THEN ':L' ELSE ':CM' END AS label FROM coarse, (VALUES (0), (1)) AS t(k)""",
    "audio": "SELECT 'm' AS media_id, unnest(range(0, n * 1001 * 48000 // 30000 // 960)) AS decode_idx FROM n",
    "segments": """SELECT *, coalesce(sum(duration) OVER (ORDER BY range_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS output_start FROM
        (SELECT media_id, range_id, "start" * 1001 AS source_start_dts, ("end" - "start") * 1001 AS duration FROM coarse)""",
    "sub_events": f"""SELECT 'm' AS media_id, event_id, greatest(event_id * 1001 - 400, 0) AS "start", greatest(event_id * 1001 - 400, 0) + 200 + abs({_H}) % 6000 AS "end" FROM events""",
    "scores": f"SELECT 'm' AS media_id, event_id AS display_idx, (CASE WHEN event_id % 900 < 500 THEN 100 ELSE -100 END + abs({_H}) % 161 - 80) / 100.0 AS raw FROM events",
    "luma": "SELECT CAST(label AS VARCHAR) AS media_id, vec_id AS display_idx, list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor(128 + 200 * x::DOUBLE) AS INTEGER)))) AS plane FROM embeddings",
}


def sql(names: str, query: str) -> str:
    """``query`` with the named tables before it; recursive ones may be added by the query's own WITH parts."""
    parts = [f"{n} AS ({SQL[n]})" for n in names.split()]
    return f"WITH RECURSIVE {', '.join(parts)}{', ' if query.startswith('+') else ' '}{query.removeprefix('+')}"
