"""Queries over the driver's tables and the SQL that must give the same rows. Names begin with the operators' numbers in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from .functions import reports, text as tx
from .functions.indices import DisplayIdx
from .operators import audio, logo, packets as pk, ranges as rg, remap, report, signal, tracks as tr, verify as vf
from .operators.sequence import as_of, carried, running
from .plans import subtitles
from .sources import texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def both(names: str, q: str) -> str:
    return ad.sql(names, q)


def _sync(frames: DataFrame) -> DataFrame:
    return frames.filter("is_key").select("media_id", "display_idx")




# -- distances, snapping, range algebra --------------------------------------------------------------------------------------------------

BOUNDARIES = """+b AS (SELECT media_id, range_id, 'start' AS kind, "start" AS boundary FROM coarse UNION ALL SELECT media_id, range_id, 'end', "end" FROM coarse),
k AS (SELECT display_idx AS k FROM {frames} WHERE is_key),
c AS (SELECT display_idx AS at, coalesce(sum(duration) OVER (ORDER BY display_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS units FROM {frames}
      UNION ALL SELECT count(*), sum(duration) FROM {frames}),
p AS (SELECT b.*, k.k AS prev FROM b ASOF LEFT JOIN k ON b.boundary >= k.k),
q AS (SELECT p.*, k.k AS next FROM p ASOF LEFT JOIN k ON p.boundary <= k.k)"""


@query(
    "w13_boundary_distances",
    both("frames n coarse", BOUNDARIES.format(frames="frames") + """
SELECT q.media_id, range_id, kind, boundary, prev, next, round((cp.units - cb.units) / 30000.0, 6) AS prev_s, round((cn.units - cb.units) / 30000.0, 6) AS next_s
FROM q JOIN c cb ON cb.at = boundary LEFT JOIN c cp ON cp.at = prev LEFT JOIN c cn ON cn.at = next"""),
)
def boundary_distances(spark, d):
    frames = ad.frames(spark, d)
    out = report.boundary_distances(ad.coarse_ranges(spark, d), frames, ad.totals(frames), 1, 30000)
    return out.withColumns({"prev_s": F.round("prev_s", 6), "next_s": F.round("next_s", 6)})


@query(
    "w13_boundary_distances_irregular",
    both("frames_vfr n coarse", BOUNDARIES.format(frames="frames_vfr") + """
SELECT q.media_id, range_id, kind, boundary, prev, next, round((cp.units - cb.units) / 30000.0, 6) AS prev_s, round((cn.units - cb.units) / 30000.0, 6) AS next_s
FROM q JOIN c cb ON cb.at = boundary LEFT JOIN c cp ON cp.at = prev LEFT JOIN c cn ON cn.at = next"""),
)
def boundary_distances_irregular(spark, d):
    frames = ad.frames_vfr(spark, d)
    out = report.boundary_distances(ad.coarse_ranges(spark, d), frames, ad.totals(frames), 1, 30000)
    return out.withColumns({"prev_s": F.round("prev_s", 6), "next_s": F.round("next_s", 6)})


@query("j1_j2_keyframe_neighbours", both("frames_vfr n coarse", BOUNDARIES.format(frames="frames_vfr") + " SELECT media_id, range_id, kind, boundary, prev, next FROM q"))
def keyframe_neighbours(spark, d):
    return as_of(rg.boundaries(ad.coarse_ranges(spark, d)), _sync(ad.frames_vfr(spark, d)), ["media_id"], "boundary", "display_idx", prev="before", next="after")


def _snap_sql(direction: str, total: bool, tail: str) -> str:
    low, high = ("0", "n") if total else ("boundary", "boundary")
    pick = f"CASE WHEN (kind = 'start') = {str(direction == 'outward').lower()} THEN coalesce(prev, {low}) ELSE coalesce(next, {high}) END"
    return both("frames n coarse", BOUNDARIES.format(frames="frames") + f""",
m AS (SELECT media_id, range_id, kind, boundary, {pick} AS at FROM q, n),
s AS (SELECT media_id, range_id, max(m.at) FILTER (kind = 'start') AS "start", max(m.at) FILTER (kind = 'end') AS "end", max(boundary) FILTER (kind = 'start') AS start_original,
      max(boundary) FILTER (kind = 'end') AS end_original FROM m GROUP BY ALL), snapped AS (SELECT *, abs("start" - start_original) AS start_delta, abs("end" - end_original) AS end_delta FROM s)
{tail}""")


def _snapped(spark, d, direction):
    frames = ad.frames(spark, d)
    return rg.snapped(ad.coarse_ranges(spark, d), _sync(frames), ad.totals(frames), direction)


@query("w4_snap_outward", _snap_sql("outward", True, "SELECT * FROM snapped"))
def snap_outward(spark, d):
    return _snapped(spark, d, "outward")


@query("w4_snap_inward", _snap_sql("inward", True, "SELECT * FROM snapped"))
def snap_inward(spark, d):
    return _snapped(spark, d, "inward")


@query(
    "w4_snap_conflicts",
    both("frames n runs kept", """+ b AS (SELECT media_id, range_id, "start", "end" FROM kept), k AS (SELECT display_idx AS k FROM frames WHERE is_key),
p AS (SELECT b.*, coalesce(k.k, 0) AS s FROM b ASOF LEFT JOIN k ON b."start" >= k.k), q AS (SELECT p.*, coalesce(k.k, n) AS e FROM (SELECT * FROM p, n) p ASOF LEFT JOIN k ON p."end" <= k.k),
r AS (SELECT *, lead(s) OVER (ORDER BY range_id) AS next FROM q)
SELECT media_id, range_id, range_id AS ord, CASE WHEN e <= s THEN 'empty_range' ELSE 'overlap' END AS code, concat_ws(' ', media_id, range_id, s, e) AS detail FROM r WHERE e <= s OR next < e"""),
)
def snap_conflicts(spark, d):
    frames = ad.frames(spark, d)
    return rg.snap_conflicts(rg.snapped(ad.kept_ranges(spark, d), _sync(frames), ad.totals(frames), "outward"))


def _summary_sql(direction: str) -> str:
    return _snap_sql(direction, False, """, u AS (SELECT snapped.*, abs(c1.units - c0.units) AS us, abs(c3.units - c2.units) AS ue, c2.units - c0.units AS kept
FROM snapped JOIN c c0 ON c0.at = "start" JOIN c c1 ON c1.at = start_original JOIN c c2 ON c2.at = "end" JOIN c c3 ON c3.at = end_original)
SELECT media_id, count(*) AS ranges, 2 * count(*) AS boundaries, CAST(sum(start_delta + end_delta) AS BIGINT) AS extra_frames, round(sum(us + ue) / 30000.0, 6) AS extra_s,
round(sum(us + ue) / 30000.0 / (2 * count(*)), 6) AS extra_s_per_boundary, round(sum(kept) / 30000.0, 6) AS output_s FROM u GROUP BY media_id""")


def _summary(spark, d, direction):
    frames = ad.frames(spark, d)
    out = report.snap_summary(ad.coarse_ranges(spark, d), frames, ad.totals(frames), direction, 1, 30000)
    return out.withColumns({c: F.round(c, 6) for c in ("extra_s", "extra_s_per_boundary", "output_s")})


@query("a7_snap_summary_outward", _summary_sql("outward"))
def snap_summary_outward(spark, d):
    return _summary(spark, d, "outward")


@query("a7_snap_summary_inward", _summary_sql("inward"))
def snap_summary_inward(spark, d):
    return _summary(spark, d, "inward")


@query("x1_kept_and_removed_runs", both("runs", "SELECT * FROM runs"))
def runs(spark, d):
    return ad.runs(spark, d)


@query(
    "x1_complement",
    both("n coarse", """+ g AS (SELECT lag("end", 1, 0) OVER (ORDER BY "start") AS s, "start" AS e FROM coarse UNION ALL SELECT max("end"), any_value(n) FROM coarse, n)
SELECT 'm' AS media_id, s AS "start", e AS "end", row_number() OVER (ORDER BY s) - 1 AS range_id FROM g WHERE s < e"""),
)
def complement(spark, d):
    return rg.complement(ad.coarse_ranges(spark, d), ad.totals(ad.frames(spark, d)))


def _packet_ranges(spark, d):
    """Per medium, every second dozen of display frames, while whole dozens last."""
    n = ad.totals(ad.packets(spark, d))
    rows = n.select("media_id", F.explode(F.expr("sequence(0L, total_frames div 24)")).alias("range_id"), "total_frames")
    return rows.filter("range_id * 24 + 12 <= total_frames").select("media_id", "range_id", (F.col("range_id") * 24).alias("start"), (F.col("range_id") * 24 + 12).alias("end"))


PACKET_RANGES = """pr AS (SELECT media_id, range_id, range_id * 24 AS "start", range_id * 24 + 12 AS "end" FROM (SELECT media_id, count(*) AS t, unnest(range(0, count(*) // 24 + 1)) AS range_id FROM packets GROUP BY media_id)
WHERE range_id * 24 + 12 <= t)"""


@query(
    "x4_keep_list",
    both("packets ordered", f"""+ {PACKET_RANGES}, f AS (SELECT pr.*, decode_idx AS first FROM pr JOIN ordered o ON o.media_id = pr.media_id AND o.display_idx = pr."start"),
x AS (SELECT media_id, range_id, first + i AS decode_idx, i FROM f, (SELECT unnest(range(0, 12)) AS i))
SELECT media_id, range_id, row_number() OVER (PARTITION BY media_id ORDER BY range_id, i) - 1 AS position, decode_idx FROM x"""),
)
def keep_list(spark, d):
    return rg.keep_list(_packet_ranges(spark, d), pk.display_order(ad.packets(spark, d)))


@query("j13_keep_and_complement_meet", both("packets ordered", """, n AS (SELECT media_id, count(*) AS t FROM packets GROUP BY media_id HAVING count(*) >= 12), k AS (SELECT *, 12 * ((t - 12) // 24 + 1) AS a FROM n)
SELECT media_id, 1 AS ord, 'in_both' AS code, concat_ws(',', f, f + 1, f + 2, f + 3, f + 4) AS detail FROM k JOIN (SELECT media_id, decode_idx AS f FROM ordered WHERE display_idx = 0) USING (media_id)
UNION ALL SELECT media_id, 2, 'incomplete', concat_ws('+', a, t - a + 12) FROM k""".replace(", n AS", "+ n AS", 1)))
def keep_meets(spark, d):
    """The removed side also has each medium's first kept range."""
    packets = ad.packets(spark, d)
    order, totals, kept = pk.display_order(packets), ad.totals(packets), _packet_ranges(spark, d)
    keep, other = rg.keep_list(kept, order), rg.keep_list(rg.complement(kept, totals), order)
    return rg.exclusivity_errors(keep, other.unionByName(keep.filter("range_id = 0")), totals)


@query("j13_keep_and_complement_disjoint", both("packets", "SELECT '' AS media_id, 0 AS ord, '' AS code, '' AS detail WHERE false"))
def keep_disjoint(spark, d):
    packets = ad.packets(spark, d)
    order, totals, kept = pk.display_order(packets), ad.totals(packets), _packet_ranges(spark, d)
    return rg.exclusivity_errors(rg.keep_list(kept, order), rg.keep_list(rg.complement(kept, totals), order), totals)


# -- packets -----------------------------------------------------------------------------------------------------------------------------


@query("w1_display_order", both("packets ordered", "SELECT media_id, decode_idx, dts, dts + cts_offset AS cts, display_idx FROM ordered"))
def display_order(spark, d):
    return pk.display_order(ad.packets(spark, d)).select("media_id", "decode_idx", "dts", "cts", "display_idx")


@query("w2_sync_in_display_order", both("packets ordered", "SELECT media_id, display_idx FROM ordered WHERE is_sync"))
def sync_display(spark, d):
    return pk.sync_display(pk.display_order(ad.packets(spark, d)))


@query(
    "w1_order_ties",
    both("packets", """SELECT media_id, cts, count(*) AS n, string_agg(CAST(decode_idx AS VARCHAR), ',' ORDER BY decode_idx) AS decode_idxs FROM
(SELECT media_id, decode_idx, decode_idx * 1001 + CASE WHEN decode_idx % 4 = 1 THEN 3003 ELSE cts_offset END AS cts FROM packets) GROUP BY media_id, cts HAVING count(*) > 1"""),
)
def order_ties(spark, d):
    late = F.when(F.col("decode_idx") % 4 == 1, 3003).otherwise(F.col("cts_offset")).cast("long")
    return pk.order_ties(pk.clocks(ad.packets(spark, d).withColumn("cts_offset", late))).withColumn("decode_idxs", F.array_join("decode_idxs", ","))


@query("j4_preceding_sync", both("packets", "SELECT media_id, decode_idx, decode_idx - decode_idx % 12 AS sync_idx FROM packets"))
def preceding_sync(spark, d):
    return pk.preceding_sync(ad.packets(spark, d)).select("media_id", "decode_idx", "sync_idx")


@query("j6_display_to_decode", both("packets ordered", f"""+ {PACKET_RANGES}, asked AS (SELECT media_id, "start" AS display_idx FROM pr UNION SELECT media_id, "end" FROM pr)
SELECT o.media_id, o.display_idx, o.decode_idx FROM ordered o JOIN asked USING (media_id, display_idx)"""))
def display_to_decode(spark, d):
    """Where every boundary of every medium's ranges stands in decode order."""
    asked = rg.boundaries(_packet_ranges(spark, d)).select("media_id", F.col("boundary").alias("display_idx")).distinct()
    return pk.display_order(ad.packets(spark, d)).join(asked, ["media_id", "display_idx"]).select("media_id", "display_idx", "decode_idx")


@query("j7_decode_to_display", both("packets ordered", "SELECT media_id, decode_idx, display_idx FROM ordered WHERE is_sync"))
def decode_to_display(spark, d):
    packets = ad.packets(spark, d)
    order = pk.display_order(packets).select("media_id", "decode_idx", "display_idx")
    return packets.filter("is_sync").select("media_id", "decode_idx").join(order, ["media_id", "decode_idx"])


def _index(spark, d):
    """An index of the packets in which every 50th frame's offset is wrong."""
    rows = pk.preceding_sync(pk.display_order(ad.packets(spark, d)))
    wrong = F.when(F.col("display_idx") % 50 == 49, 1).otherwise(0)
    return rows.select("media_id", F.col("display_idx").alias("frame_number"), F.col("decode_idx").alias("sample_number"), F.col("sync_idx").alias("random_access_sample"), (F.col("file_offset") + wrong).alias("file_offset"))


@query(
    "j10_index_mismatches",
    both("packets ordered", "SELECT media_id, display_idx AS ord, 'file_offset' AS code, concat_ws(' ', display_idx, decode_idx, decode_idx) AS detail FROM ordered WHERE display_idx % 50 = 49"),
)
def index_mismatches(spark, d):
    return pk.index_mismatches(pk.display_order(ad.packets(spark, d)), _index(spark, d))


@query("s13_permutation", both("packets", "SELECT media_id, count(*) AS n, true AS is_permutation FROM packets GROUP BY media_id"))
def permutation(spark, d):
    return pk.permutation(_index(spark, d))


@query(
    "w14_not_increasing",
    "SELECT 'm' AS media_id, event_id, b AS before, v FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS v, lag(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS b FROM events) WHERE v <= b",
)
def not_increasing(spark, d):
    rows = ad.table(spark, d, "events").select(ad.media(), "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return pk.not_increasing(rows, "event_id", "v")


@query("v2_display_contiguous", both("packets", """SELECT media_id, cts AS ord, 'display_tie' AS code, string_agg(CAST(decode_idx AS VARCHAR), ',' ORDER BY decode_idx) AS detail FROM
(SELECT media_id, decode_idx, decode_idx * 1001 + CASE WHEN decode_idx % 36 = 13 THEN 3003 ELSE cts_offset END AS cts FROM packets) GROUP BY media_id, cts HAVING count(*) > 1"""))
def display_contiguous(spark, d):
    """Three dozen packets in, one is shown late and meets another; media shorter than that are sound."""
    late = F.when(F.col("decode_idx") % 36 == 13, 3003).otherwise(F.col("cts_offset")).cast("long")
    return vf.display_contiguous(ad.packets(spark, d).withColumn("cts_offset", late))


@query("v2_display_contiguous_of_sound_packets", both("packets", "SELECT '' AS media_id, 0 AS ord, '' AS code, '' AS detail WHERE false"))
def display_contiguous_sound(spark, d):
    return vf.display_contiguous(ad.packets(spark, d))


@query(
    "v1_v3_ranges_hold",
    both("packets ordered", f"+ {PACKET_RANGES} SELECT media_id, range_id AS ord, 'packet_count' AS code, '12 11' AS detail FROM pr WHERE range_id % 5 = 3"),
)
def ranges_hold(spark, d):
    packets = ad.packets(spark, d)
    kept = _packet_ranges(spark, d)
    out = rg.keep_list(kept, pk.display_order(packets)).join(packets.select("media_id", "decode_idx", "is_sync"), ["media_id", "decode_idx"])
    return vf.ranges_hold(out.filter("not (range_id % 5 = 3 and position % 12 = 11)"), kept)


@query("k4_run_lengths", both("frames_vfr", """SELECT 'm' AS media_id, row_number() OVER (ORDER BY min(i)) - 1 AS run, count(*) AS count, any_value(v) AS duration FROM
(SELECT i, v, sum(o) OVER (ORDER BY i) AS g FROM (SELECT display_idx AS i, duration % 3 AS v, CASE WHEN lag(duration % 3) OVER (ORDER BY display_idx) = duration % 3 THEN 0 ELSE 1 END AS o FROM frames_vfr)) GROUP BY g"""))
def run_lengths(spark, d):
    return pk.run_lengths(ad.frames_vfr(spark, d).withColumn("duration", F.col("duration") % 3), "duration", pos="display_idx")


@query("k5_cts_run_lengths", both("packets", """SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY min(i)) - 1 AS run, count(*) AS count, any_value(v) AS cts_offset FROM
(SELECT media_id, i, v, sum(o) OVER (PARTITION BY media_id ORDER BY i) AS g FROM (SELECT media_id, decode_idx AS i, cts_offset AS v, CASE WHEN lag(cts_offset) OVER (PARTITION BY media_id ORDER BY decode_idx) = cts_offset THEN 0 ELSE 1 END AS o FROM packets)) GROUP BY media_id, g"""))
def cts_runs(spark, d):
    return pk.run_lengths(ad.packets(spark, d), "cts_offset")


@query("s4_s5_expand_runs", both("packets", "SELECT media_id, decode_idx, cts_offset FROM packets"))
def expand_runs(spark, d):
    return pk.expand_runs(pk.run_lengths(ad.packets(spark, d), "cts_offset"), "cts_offset")


@query("s6_run_total_errors", both("packets", "SELECT media_id, 1 AS ord, 'stts' AS code, concat_ws(' of ', n - 1, n) AS detail FROM (SELECT media_id, count(*) AS n FROM packets GROUP BY media_id) WHERE n % 7 = 0"))
def run_totals(spark, d):
    packets = ad.packets(spark, d)
    totals = packets.groupBy("media_id").agg(F.count(F.lit(1)).alias("total"))
    runs = totals.select("media_id", (F.col("total") - F.when(F.col("total") % 7 == 0, 1).otherwise(0)).alias("count"))
    return pk.run_total_errors(runs, totals, "stts")


@query("s3_size_errors", both("packets", "SELECT media_id, 1 AS ord, 'sizes_exceed_file' AS code, concat_ws(' of ', CAST(b AS BIGINT), CAST(m AS BIGINT)) AS detail FROM (SELECT media_id, sum(size) AS b, count(*) * 500 AS m FROM packets GROUP BY media_id) WHERE b > m"))
def size_errors(spark, d):
    packets = ad.packets(spark, d)
    runs = packets.select("media_id", F.lit(1).cast("long").alias("count"), "size")
    return pk.size_errors(runs, packets.groupBy("media_id").agg((F.count(F.lit(1)) * 500).alias("file_length")))


STSC = "st AS (SELECT media_id, 10 AS n_chunks, k AS entry, CASE WHEN k = 2 AND h % 3 = 0 THEN 3 WHEN k = 2 AND h % 3 = 1 THEN 40 ELSE 1 + 3 * k END AS first_chunk, CASE WHEN k = 1 AND h % 5 = 0 THEN 0 ELSE 1 + k END AS samples_per_chunk FROM (SELECT media_id, count(*) AS h FROM packets GROUP BY media_id), (VALUES (0), (1), (2)) AS t(k))"


def _stsc(spark, d):
    rows = ad.packets(spark, d).groupBy("media_id").agg(F.count(F.lit(1)).alias("h")).select("media_id", "h", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("entry"))
    first = F.when((F.col("entry") == 2) & (F.col("h") % 3 == 0), 3).when((F.col("entry") == 2) & (F.col("h") % 3 == 1), 40).otherwise(1 + 3 * F.col("entry"))
    per = F.when((F.col("entry") == 1) & (F.col("h") % 5 == 0), 0).otherwise(1 + F.col("entry"))
    return rows.select("media_id", "entry", first.alias("first_chunk"), per.alias("samples_per_chunk"))


@query("s7_chunk_run_errors", both("packets", f"""+ {STSC}, x AS (SELECT *, lag(first_chunk) OVER (PARTITION BY media_id ORDER BY entry) AS b FROM st)
SELECT media_id, entry AS ord, CASE WHEN first_chunk <= b THEN 'not_ascending' WHEN first_chunk > n_chunks THEN 'beyond_chunks' ELSE 'no_samples' END AS code, CAST(first_chunk AS VARCHAR) AS detail
FROM x WHERE first_chunk <= b OR first_chunk > n_chunks OR samples_per_chunk = 0"""))
def chunk_run_errors(spark, d):
    rows = _stsc(spark, d)
    return pk.chunk_run_errors(rows, rows.select("media_id", F.lit(10).alias("n_chunks")).distinct())


@query("s7b_packet_offsets", both("packets", """+ c AS (SELECT media_id, decode_idx, size, CASE WHEN decode_idx < 10 THEN decode_idx // 2 + 1 ELSE 5 + (decode_idx - 10) // 5 + 1 END AS chunk FROM packets), m AS (SELECT media_id, count(*) AS t FROM packets GROUP BY media_id)
SELECT media_id, decode_idx, chunk, size, chunk * 100000 + coalesce(sum(size) OVER (PARTITION BY media_id, chunk ORDER BY decode_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS file_offset
FROM c JOIN m USING (media_id) WHERE t >= 15"""))
def packet_offsets(spark, d):
    packets = ad.packets(spark, d)
    big = packets.groupBy("media_id").agg(F.count(F.lit(1)).alias("t")).filter("t >= 15")
    runs = big.select("media_id", F.explode(F.expr("array(named_struct('entry', 0, 'first_chunk', 1, 'samples_per_chunk', 2L), named_struct('entry', 1, 'first_chunk', 6, 'samples_per_chunk', 5L))")).alias("r")).select("media_id", "r.*")
    chunks = big.select("media_id", F.explode(F.expr("sequence(1, 5 + cast(ceil((t - 10) / 5) as int))")).alias("chunk")).withColumn("offset", F.col("chunk") * 100000)
    return pk.packet_offsets(runs, chunks, packets.select("media_id", "decode_idx", "size"))


def _chunked(spark, d):
    return pk.chunk_numbers(ad.packets(spark, d).withColumns({"duration": F.lit(1001).cast("long") + F.col("decode_idx") % 3 * 400, "timescale": F.lit(5000).cast("long")}))


CHUNKS = """p AS (SELECT media_id, decode_idx, 1001 + decode_idx % 3 * 400 AS d FROM packets),
r AS (SELECT media_id, decode_idx, 0 AS chunk, d AS held FROM p WHERE decode_idx = 0
      UNION ALL SELECT p.media_id, p.decode_idx, CASE WHEN r.held >= 5000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.held >= 5000 THEN p.d ELSE r.held + p.d END FROM r JOIN p ON p.media_id = r.media_id AND p.decode_idx = r.decode_idx + 1)"""


@query("k6_chunk_track", both("packets", f"+ {CHUNKS} SELECT media_id, decode_idx, chunk FROM r"))
def chunk_track(spark, d):
    return _chunked(spark, d).select("media_id", "decode_idx", "chunk")


@query("k7_chunk_entries", both("packets", f"""+ {CHUNKS}, c AS (SELECT media_id, chunk, count(*) AS samples FROM r GROUP BY media_id, chunk)
SELECT media_id, chunk + 1 AS first_chunk, samples AS samples_per_chunk FROM (SELECT *, lag(samples) OVER (PARTITION BY media_id ORDER BY chunk) AS o FROM c) WHERE o IS NULL OR o <> samples"""))
def chunk_entries(spark, d):
    return pk.chunk_entries(_chunked(spark, d).groupBy("media_id", "chunk").agg(F.count(F.lit(1)).alias("samples")))


@query("k8b_interleave", both("packets", """+ c AS (SELECT media_id, decode_idx % 2 AS track, decode_idx // 8 AS chunk, sum(size) AS bytes FROM packets GROUP BY ALL)
SELECT media_id, track, chunk, CAST(chunk AS DOUBLE) AS start_s, CAST(bytes AS BIGINT) AS bytes, CAST(48 + coalesce(sum(bytes) OVER (PARTITION BY media_id ORDER BY chunk, track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM c"""))
def interleave(spark, d):
    rows = ad.packets(spark, d).groupBy("media_id", (F.col("decode_idx") % 2).alias("track"), F.expr("decode_idx div 8").alias("chunk")).agg(F.sum("size").alias("bytes"))
    return pk.interleaved(rows.select("media_id", "track", "chunk", F.col("chunk").cast("double").alias("start_s"), "bytes"), 48)


@query("k8_resolved_packets", both("packets ordered", f"""+ {PACKET_RANGES}, f AS (SELECT pr.media_id, range_id, decode_idx AS first FROM pr JOIN ordered o ON o.media_id = pr.media_id AND o.display_idx = pr."start")
SELECT f.media_id, range_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f JOIN packets p ON p.media_id = f.media_id AND decode_idx BETWEEN first AND first + 11 GROUP BY ALL"""))
def resolved(spark, d):
    packets = ad.packets(spark, d)
    rows = pk.resolved(rg.keep_list(_packet_ranges(spark, d), pk.display_order(packets)), packets)
    return rows.groupBy("media_id", "range_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("k8c_output_times", both("packets", """SELECT media_id, CAST(sum(duration) AS BIGINT) AS media_duration, CAST(sum(duration) * 1000 // 30000 AS BIGINT) AS movie_duration, string_agg(CAST(decode_idx + 1 AS VARCHAR), ',' ORDER BY decode_idx) FILTER (is_sync) AS sync_numbers FROM packets GROUP BY media_id"""))
def output_times(spark, d):
    return pk.output_times(ad.packets(spark, d).withColumn("position", F.col("decode_idx")), 30000, 1000).withColumn("sync_numbers", F.array_join("sync_numbers", ","))


BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: CAST((instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 1 AS {1}))"


@query(
    "f30_packet_crc32",
    f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce([4294967295::BIGINT] || {BYTES.format("text", "BIGINT")},
lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) END AS crc FROM documents""",
)
def packet_crc(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


# -- second stream, segment map ------------------------------------------------------------------------------------------------------------


@query("a8_a10_segment_starts", both("packets ordered", f"""+ {PACKET_RANGES} SELECT pr.media_id, range_id, dts AS source_start_dts FROM pr JOIN ordered o ON o.media_id = pr.media_id AND o.display_idx = pr."start\""""))
def segment_starts(spark, d):
    return audio.source_starts(_packet_ranges(spark, d), pk.display_order(ad.packets(spark, d)))


@query("a11_independent_starts", ORACLE_SQL["a8_a10_segment_starts"])
def independent_starts(spark, d):
    return audio.independent_source_starts(_packet_ranges(spark, d), ad.packets(spark, d))


@query("w3_segment_map", both("packets ordered", f"""+ {PACKET_RANGES} SELECT pr.media_id, range_id, "start" AS source_start_frame, "end" AS source_end_frame, dts AS source_start_dts, 12012 AS duration, range_id * 12012 AS output_start, 12 AS frame_count
FROM pr JOIN ordered o ON o.media_id = pr.media_id AND o.display_idx = pr."start\""""))
def segment_map(spark, d):
    packets = ad.packets(spark, d)
    order, kept = pk.display_order(packets), _packet_ranges(spark, d)
    keep = rg.keep_list(kept, order)
    return rg.segment_map(kept, audio.source_starts(kept, order), audio.segment_durations(keep, packets))


AUDIO = """+ e AS (SELECT decode_idx + 1 AS i, CAST(2892 + 960 * (decode_idx + 1) AS DOUBLE) AS t FROM audio UNION ALL SELECT 0, 0),
s AS (SELECT range_id, duration, source_start_dts * 48000::DOUBLE / 30000 AS a, (source_start_dts + duration) * 48000::DOUBLE / 30000 AS b FROM segments),
x AS (SELECT range_id, 0 AS k, a AS t FROM s UNION ALL SELECT range_id, 1, b FROM s),
lo AS (SELECT x.*, e.i AS li, e.t AS lt FROM x ASOF LEFT JOIN e ON x.t > e.t), hi AS (SELECT lo.*, e.i AS hi, e.t AS ht FROM lo ASOF LEFT JOIN e ON lo.t <= e.t),
p AS (SELECT *, CASE WHEN li IS NULL THEN 0 WHEN hi IS NULL THEN li WHEN t - lt <= ht - t THEN li ELSE hi END AS i FROM hi),
g AS (SELECT range_id, max(p.i) FILTER (k = 0) AS "start", max(p.i) FILTER (k = 1) AS "end", max(abs(e.t - p.t)) AS off FROM p JOIN e ON e.i = p.i GROUP BY range_id),
h AS (SELECT 'm' AS media_id, range_id, "start", greatest("start", "end") AS "end", round(off / (SELECT (2892 + 960 * count(*)) / count(*)::DOUBLE FROM audio), 6) AS error_packets FROM g)"""


@query("w5_audio_segments", both("n coarse segments audio", AUDIO + " SELECT * FROM h"))
def audio_segments(spark, d):
    return audio.audio_segments(ad.segments(spark, d), ad.audio(spark, d), 30000, 48000).withColumn("error_packets", F.round("error_packets", 6))


AV = AUDIO + """, v AS (SELECT h.range_id, s.duration / 30000.0 AS video_s, (e1.t - e0.t) / 48000 AS audio_s FROM h JOIN s USING (range_id) JOIN e e0 ON e0.i = h."start" JOIN e e1 ON e1.i = h."end"),
w AS (SELECT range_id, video_s, audio_s, (audio_s - video_s) * 1000 AS diff_ms FROM v)"""


def _av(spark, d):
    segs, tone = ad.segments(spark, d), ad.audio(spark, d)
    return audio.av_segments(segs.select("media_id", "range_id", "duration"), audio.audio_segments(segs, tone, 30000, 48000), tone, 30000, 48000)


@query("a13_av_segments", both("n coarse segments audio", AV + " SELECT 'm' AS media_id, range_id, round(video_s, 6) AS video_s, round(audio_s, 6) AS audio_s, round(diff_ms, 4) AS diff_ms FROM w"))
def av_segments(spark, d):
    return _av(spark, d).withColumns({"video_s": F.round("video_s", 6), "audio_s": F.round("audio_s", 6), "diff_ms": F.round("diff_ms", 4)})


@query("a13_av_summary", both("n coarse segments audio", AV + " SELECT 'm' AS media_id, round(max(abs(diff_ms)), 4) AS max_abs_ms, round(sum(diff_ms), 4) AS total_ms, max(abs(diff_ms)) > 40 AS warn FROM w"))
def av_summary(spark, d):
    return audio.av_summary(_av(spark, d)).select("media_id", F.round("max_abs_ms", 4).alias("max_abs_ms"), F.round("total_ms", 4).alias("total_ms"), "warn")


@query("a12_cumulative_duration", both("frames_vfr", "SELECT media_id, display_idx, CAST(coalesce(sum(duration) OVER (ORDER BY display_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM frames_vfr"))
def cumulative(spark, d):
    return running(ad.frames_vfr(spark, d), ["media_id"], "display_idx", before=("duration", False)).select("media_id", "display_idx", "before")


# -- gaps, missed blocks, verdict ------------------------------------------------------------------------------------------------------------


@query("a15_gap_lengths", both("runs kept", 'SELECT * FROM (SELECT media_id, range_id, lead("start") OVER (ORDER BY range_id) - "end" AS gap FROM kept) WHERE gap IS NOT NULL'))
def gap_lengths(spark, d):
    return report.gap_lengths(ad.kept_ranges(spark, d))


@query("a16_known_lengths", """WITH RECURSIVE g AS (SELECT gap, n, row_number() OVER (ORDER BY gap) AS i FROM (SELECT o_custkey * 13 % 10007 AS gap, count(*) AS n FROM orders GROUP BY 1)),
r AS (SELECT i, gap AS first, n FROM g WHERE i = 1 UNION ALL SELECT g.i, CASE WHEN g.gap - r.first <= 3 THEN r.first ELSE g.gap END, g.n FROM r JOIN g ON g.i = r.i + 1)
SELECT 'm' AS media_id, string_agg(CAST(first AS VARCHAR), ',' ORDER BY first) AS known FROM (SELECT first FROM r GROUP BY first HAVING sum(n) >= 2)""")
def known_lengths(spark, d):
    rows = ad.table(spark, d, "orders").select(ad.media(), (F.col("o_custkey") * 13 % 10007).alias("gap"))
    return report.known_lengths(rows).withColumn("known", F.array_join("known", ","))


#: All gaps between coarse ranges are alike, so the known lengths are those that occur twice.
MISSED = """+ kl AS (SELECT gap FROM (SELECT lead("start") OVER (ORDER BY range_id) - "end" AS gap FROM coarse) WHERE gap IS NOT NULL GROUP BY gap HAVING count(*) >= 2),
m AS (SELECT e.media_id, c.range_id, entry_id, e."start", e."end", e."end" - e."start" + 1 AS length_frames, gap AS matched_gap_length FROM coarse_structure e JOIN coarse c
ON e."start" >= c."start" AND e."end" < c."end" JOIN kl ON abs(e."end" - e."start" + 1 - gap) <= 3)"""


@query("j8_missed_candidates", both("n coarse coarse_structure", MISSED + " SELECT * FROM m"))
def missed(spark, d):
    return report.missed_candidates(ad.coarse_ranges(spark, d), ad.coarse_structure(spark, d))


@query("a3_gate_verdict", both("n coarse coarse_structure", MISSED + """, k AS (SELECT count(*) AS range_count, CAST(sum("end" - "start") AS BIGINT) AS kept_frames FROM coarse), x AS (SELECT count(*) AS missed FROM m),
e AS (SELECT count(*) FILTER (abs(error_frames) > 5) AS off_grid, max(abs(error_frames)) AS max_grid_error FROM coarse_structure WHERE label = ':CM')
SELECT 'm' AS media_id, range_count, n AS total_frames, kept_frames, n - kept_frames AS cut_frames, round(kept_frames / n::DOUBLE, 6) AS kept_ratio, off_grid, max_grid_error, missed, missed > 0 AS stops_for_missed,
n = kept_frames AS stops_for_no_cut, missed > 0 OR n = kept_frames AS stop FROM n, k, x, e"""))
def gate(spark, d):
    return report.verdict(ad.coarse_ranges(spark, d), ad.coarse_structure(spark, d), ad.totals(ad.frames(spark, d))).withColumn("kept_ratio", F.round("kept_ratio", 6))


@query("a2_grid_errors", both("runs structure", "SELECT media_id, entry_id, error_frames FROM structure WHERE label = ':CM'"))
def grid_errors(spark, d):
    return ad.structure(spark, d).filter(tx.is_cm("label")).select("media_id", "entry_id", "error_frames")


# -- events ----------------------------------------------------------------------------------------------------------------------------------

FATE = """+ s AS (SELECT source_start_dts AS s0, source_start_dts + duration AS s1, output_start, lead(source_start_dts) OVER (ORDER BY range_id) AS nx, range_id FROM segments),
h AS (SELECT e.*, s.*, row_number() OVER (PARTITION BY event_id ORDER BY range_id) AS k FROM sub_events e LEFT JOIN s ON e."start" < s1 AND e."end" > s0),
f AS (SELECT media_id, event_id, "start", "end", CASE WHEN s0 IS NULL THEN 'Discarded' WHEN "start" < s0 OR "end" > s1 THEN 'Clipped' ELSE 'Shifted' END AS fate, CAST(greatest("start", s0) + output_start - s0 AS BIGINT) AS os,
CAST(least("end", s1) + output_start - s0 AS BIGINT) AS oe, "start" < s0 AS start_clamped, "end" > s1 AS end_clamped, CASE WHEN s0 IS NOT NULL THEN coalesce("end" > nx, false) END AS spans_multiple, s0 FROM h WHERE k = 1)"""


@query("j9_event_fate", both("n coarse segments sub_events", FATE + """ SELECT media_id, event_id, "start", "end", fate, CASE WHEN s0 IS NOT NULL THEN os END AS out_start, CASE WHEN s0 IS NOT NULL THEN oe END AS out_end, start_clamped, end_clamped, spans_multiple FROM f"""))
def event_fate(spark, d):
    return remap.map_events(ad.sub_events(spark, d), ad.segments(spark, d))


@query("j9_event_fate_counts", both("n coarse segments sub_events", FATE + " SELECT fate, count(*) AS n, CAST(count(*) FILTER (spans_multiple) AS BIGINT) AS spanning FROM f GROUP BY fate"))
def event_fates(spark, d):
    return event_fate(spark, d).groupBy("fate").agg(F.count(F.lit(1)).alias("n"), F.count_if("spans_multiple").alias("spanning"))


@query("f5_f7_ticks", """SELECT event_id, event_id * 7919 * 100 // 30000 AS down, (event_id * 7919 * 100 + 29999) // 30000 AS up, event_id * 30000 // 1000 AS ticks FROM events""")
def ticks(spark, d):
    t = F.col("event_id") * 7919
    return ad.table(spark, d, "events").select("event_id", remap.to_units(t, 30000, 100).alias("down"), remap.to_units(t, 30000, 100, up=True).alias("up"), remap.to_ticks("event_id", 30000, 1000).alias("ticks"))


CLOCK = "SELECT event_id, event_id * 7919 AS v FROM events"


@query("f1_f2_ass_time", f"SELECT event_id, printf('%d:%02d:%02d.%02d', v // 360000, v // 6000 % 60, v // 100 % 60, v % 100) AS shown, v AS parsed FROM ({CLOCK})")
def ass_time(spark, d):
    rows = ad.table(spark, d, "events").select("event_id", tx.format_ass_time(F.col("event_id") * 7919).alias("shown"))
    return rows.withColumn("parsed", tx.parse_ass_time("shown"))


@query("f3_f4_srt_time", f"SELECT event_id, printf('%02d:%02d:%02d,%03d', v // 3600000, v // 60000 % 60, v // 1000 % 60, v % 1000) AS shown, v AS parsed FROM ({CLOCK})")
def srt_time(spark, d):
    rows = ad.table(spark, d, "events").select("event_id", tx.format_srt_time(F.col("event_id") * 7919).alias("shown"))
    return rows.withColumn("parsed", tx.parse_srt_time("shown"))


@query("f9_f10_report_times", "SELECT event_id, printf('%02d:%02d', s // 60, s % 60) AS rounded, printf('%02d:%02d', f // 60, f % 60) AS floored FROM (SELECT event_id, event_id AS s, CAST(floor(event_id / 30.0) AS BIGINT) AS f FROM events)")
def report_times(spark, d):
    return ad.table(spark, d, "events").select("event_id", tx.format_mm_ss(F.col("event_id") + 0.25).alias("rounded"), tx.frame_time("event_id", 30.0).alias("floored"))


# -- signal ------------------------------------------------------------------------------------------------------------------------------------

VOTES = """+ z AS (SELECT arg_min(raw, display_idx) AS head, arg_max(raw, display_idx) AS tail, max(display_idx) AS last FROM scores),
pad AS (SELECT display_idx, raw FROM scores UNION ALL SELECT i, CASE WHEN i < 0 THEN head ELSE tail END FROM z, (SELECT unnest(range(-38, 0)) AS i UNION ALL SELECT unnest(range(last + 1, last + 39)) FROM z)),
d AS (SELECT *, least(max(raw) OVER (ORDER BY display_idx ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), max(raw) OVER (ORDER BY display_idx ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)) AS peak FROM pad),
w AS (SELECT *, avg(raw) OVER (ORDER BY display_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS mean, median(raw) OVER (ORDER BY display_idx ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS median FROM d),
v AS (SELECT display_idx, median, CASE WHEN abs(peak) < 0.5 THEN 'Unknown' WHEN peak > 0 THEN 'Has' ELSE 'No' END AS a, CASE WHEN abs(mean) < 0.2 THEN 'Unknown' WHEN mean > 0 THEN 'Has' ELSE 'No' END AS b FROM w, z WHERE display_idx BETWEEN 0 AND last),
vote AS (SELECT display_idx, median, CASE WHEN a = b THEN a ELSE 'Unknown' END AS vote FROM v),
nb AS (SELECT *, coalesce(last_value(CASE WHEN vote <> 'Unknown' THEN vote END IGNORE NULLS) OVER (ORDER BY display_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'No') AS l,
coalesce(first_value(CASE WHEN vote <> 'Unknown' THEN vote END IGNORE NULLS) OVER (ORDER BY display_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 'No') AS r FROM vote),
j AS (SELECT display_idx, median, vote, CASE WHEN vote <> 'Unknown' THEN vote WHEN l = r THEN l ELSE 'Unknown' END AS judgement FROM nb)"""


def _judged(spark, d):
    return signal.filled(signal.judged(ad.scores(spark, d), 30.0))


@query("w6_w8_rolling_vote", both("scores", VOTES + " SELECT 'm' AS media_id, display_idx, round(median, 6) AS median, vote FROM vote"))
def rolling_vote(spark, d):
    return signal.judged(ad.scores(spark, d), 30.0).select("media_id", "display_idx", F.round("median", 6).alias("median"), "vote")


@query("w7_unknown_fill", both("scores", VOTES + " SELECT 'm' AS media_id, display_idx, vote, judgement FROM j"))
def unknown_fill(spark, d):
    return _judged(spark, d).select("media_id", "display_idx", "vote", "judgement")


@query("w12_presence", both("scores", VOTES + " SELECT 'm' AS media_id, count(*) FILTER (judgement = 'Has') AS logo_frames, count(*) AS total_frames FROM j"))
def presence(spark, d):
    return signal.presence(_judged(spark, d))


INTERVALS = VOTES + """, n AS (SELECT count(*) AS n FROM j), g AS (SELECT *, sum(CASE WHEN judgement = 'No' THEN 1 ELSE 0 END) OVER (ORDER BY display_idx) AS g FROM j),
o AS (SELECT g, min(display_idx) FILTER (judgement = 'Has') AS sr, lead(min(display_idx)) OVER (ORDER BY g) AS nx FROM g GROUP BY g),
i0 AS (SELECT g, sr, coalesce(nx, n) AS er, n FROM o, n WHERE sr IS NOT NULL), i1 AS (SELECT *, lag(er, 1, 0) OVER (ORDER BY g) AS it, row_number() OVER (ORDER BY g) - 1 AS island FROM i0),
i2 AS (SELECT *, (SELECT median FROM j WHERE display_idx = sr) AS vs, (SELECT median FROM j WHERE display_idx = er) AS ve FROM i1),
i3 AS (SELECT *, CASE WHEN vs >= 0.2 THEN greatest(it, coalesce((SELECT max(display_idx) FROM j WHERE display_idx < sr AND median < 0.2), -1) + 1) ELSE coalesce((SELECT min(display_idx) FROM j WHERE display_idx >= sr AND median >= 0.2), n) END AS s FROM i2),
i4 AS (SELECT *, CASE WHEN er = n THEN er WHEN ve <= -0.2 THEN greatest(s, coalesce((SELECT max(display_idx) FROM j WHERE display_idx < er AND median > -0.2), -1) + 1) ELSE coalesce((SELECT min(display_idx) FROM j WHERE display_idx >= er AND median <= -0.2), n) END AS e FROM i3),
i5 AS (SELECT *, greatest(it, coalesce((SELECT max(display_idx) FROM j WHERE display_idx < s AND median <= -0.2), -1) + 1) AS ss, greatest(s, coalesce((SELECT max(display_idx) FROM j WHERE display_idx < e AND median >= 0.2), -1) + 1) AS es FROM i4),
i6 AS (SELECT *, least(s, coalesce((SELECT min(display_idx) FROM j WHERE display_idx >= ss AND median > 0), n)) AS sb, greatest(es, coalesce((SELECT max(display_idx) FROM j WHERE display_idx < e AND median > 0), -1) + 1) AS eb FROM i5)"""


@query("w9_logo_intervals", both("scores", INTERVALS + " SELECT 'm' AS media_id, island, ss AS s_left, sb AS s_best, s AS s_right, es - 1 AS e_left, eb - 1 AS e_best, e - 1 AS e_right FROM i6 WHERE s < e"))
def logo_intervals(spark, d):
    return signal.intervals(_judged(spark, d))


@query("k14_interval_text", both("scores", INTERVALS + " SELECT 'm' AS media_id, string_agg(printf('%6d S 0 ALL %6d %6d', sb, ss, s) || chr(10) || printf('%6d E 0 ALL %6d %6d', eb - 1, es - 1, e - 1) || chr(10), '' ORDER BY island) AS text FROM i6 WHERE s < e"))
def interval_text(spark, d):
    return signal.interval_text(signal.intervals(_judged(spark, d)))


@query("w10_w11_searches", both("scores", """SELECT 'm' AS media_id, display_idx, max(CASE WHEN raw < 0 THEN display_idx END) OVER (ORDER BY display_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back,
min(CASE WHEN raw >= 0.2 THEN display_idx END) OVER (ORDER BY display_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS forth FROM scores"""))
def searches(spark, d):
    rows = carried(ad.scores(spark, d), ["media_id"], "display_idx", back=(F.col("raw") < 0, "below"), forth=(F.col("raw") >= 0.2, "after"))
    return rows.select("media_id", "display_idx", "back", "forth")


# -- logo models ---------------------------------------------------------------------------------------------------------------------------------


@query("a18_border_background", both("luma", """+ b AS (SELECT media_id, display_idx, list_sort(list_transform([0,1,2,3,4,5,6,7,8,15,16,23,24,31,32,39,40,47,48,55,56,57,58,59,60,61,62,63], lambda i: plane[i + 1])) AS b FROM luma)
SELECT media_id, display_idx, round(list_avg(b[8:21]), 6) AS y FROM b WHERE b[28] - b[1] <= 70"""))
def border_background(spark, d):
    return logo.usable_frames(ad.luma(spark, d), 8, 8, 70).select("media_id", "display_idx", F.round("y", 6).alias("y"))


@query("a19_a20_pixel_regression", both("luma", """+ b AS (SELECT media_id, plane, list_sort(list_transform([0,1,2,3,4,5,6,7,8,15,16,23,24,31,32,39,40,47,48,55,56,57,58,59,60,61,62,63], lambda i: plane[i + 1])) AS b FROM luma),
u AS (SELECT media_id, list_avg(b[8:21]) AS x, unnest(plane) AS v, generate_subscripts(plane, 1) - 1 AS pixel FROM b WHERE b[28] - b[1] <= 70),
s AS (SELECT media_id, pixel, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(v) AS sy, sum(v * v) AS syy, sum(x * v) AS sxy FROM u GROUP BY ALL)
SELECT media_id, pixel, n, round(sx, 3) AS sx, round(sxx, 3) AS sxx, CAST(sy AS DOUBLE) AS sy, CAST(syy AS DOUBLE) AS syy, round(sxy, 3) AS sxy FROM s"""))
def pixel_regression(spark, d):
    return logo.regression_sums(logo.usable_frames(ad.luma(spark, d), 8, 8, 70)).withColumns({c: F.round(c, 3) for c in ("sx", "sxx", "sxy")})


@query("o1_topk_variance", both("luma", """+ p AS (SELECT CAST(display_idx AS VARCHAR) AS media_id, plane FROM luma), c AS (SELECT media_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, plane[i] AS v FROM p, (SELECT unnest(range(1, 65)) AS i)),
s AS (SELECT c.media_id, q.y, q.x, 25 * sum(v * v) - sum(v) * sum(v) AS variance FROM c, (SELECT a.i AS y, b.i AS x FROM (SELECT unnest(range(2, 6)) AS i) a, (SELECT unnest(range(2, 6)) AS i) b) q WHERE abs(c.y - q.y) <= 2 AND abs(c.x - q.x) <= 2 GROUP BY ALL),
r AS (SELECT media_id, y, x, CAST(variance AS BIGINT) AS variance, row_number() OVER (PARTITION BY media_id ORDER BY variance DESC, y, x) AS rank FROM s) SELECT * FROM r WHERE rank <= 9"""))
def topk_variance(spark, d):
    planes = ad.luma(spark, d).select(F.col("display_idx").cast("string").alias("media_id"), "plane")
    return logo.top_variance(planes, 8, 8, 0.15)


@query(
    "a24_a25_frame_scores",
    both("luma", """+ al AS (SELECT i, CASE (i % 8 + 2 * (i // 8)) % 5 WHEN 4 THEN 1.25 ELSE (i % 8 + 2 * (i // 8)) % 5 / 10.0 END::DOUBLE AS al FROM (SELECT unnest(range(64)) AS i)),
px AS (SELECT i, 1 / (1 - al) AS a, -al * 100 / (255 * (1 - al)) AS b FROM al), lv AS (SELECT unnest(range(32)) AS c),
wn AS (SELECT cy * 8 + cx AS p, (cy + dy) * 8 + cx + dx AS i FROM (SELECT unnest(range(2, 6)) AS cy), (SELECT unnest(range(2, 6)) AS cx), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
kn AS (SELECT p, i, d - avg(d) OVER (PARTITION BY p) AS k FROM (SELECT p, i, CASE WHEN a > 0 THEN (0 - b * 255) / a ELSE 0 END AS d FROM wn JOIN px USING (i))),
ds AS (SELECT p, c, k, CASE WHEN a > 0 THEN (8 * c - b * 255) / a ELSE 8 * c END AS d FROM kn JOIN px USING (i), lv),
co AS (SELECT p, c, abs(sum(k * (d - m))) AS r FROM (SELECT *, avg(d) OVER (PARTITION BY p, c) AS m FROM ds) GROUP BY p, c),
sc AS (SELECT p, c, CASE WHEN r > 0 THEN 1 / r ELSE 0 END AS s, least(1, r / (0.2 * (SELECT avg(r) FROM co))) AS s2 FROM co),
im AS (SELECT media_id, display_idx, kind, i, CASE kind WHEN 0 THEN v ELSE a * v + b * 255 END AS v FROM (SELECT media_id, display_idx, unnest(plane) AS v, generate_subscripts(plane, 1) - 1 AS i FROM luma) JOIN px USING (i), (VALUES (0), (1)) AS t(kind)
       UNION ALL SELECT NULL, NULL, 2, i, CASE WHEN a > 0 THEN (16 - b * 255) / a ELSE 16 END FROM px),
wm AS (SELECT media_id, display_idx, kind, p, avg(v) AS m, sum(k * v) - avg(v) * sum(k) AS r FROM im JOIN kn USING (i) GROUP BY ALL),
rw AS (SELECT media_id, display_idx, kind, sum(greatest(-1, least(1, r * s)) * s2) AS raw FROM wm JOIN sc ON sc.p = wm.p AND sc.c = floor(greatest(0, least(255, m)) / 8) GROUP BY ALL)
SELECT media_id, display_idx, round(max(raw) FILTER (kind = 0) / (SELECT raw FROM rw WHERE kind = 2), 4) AS corr0, round(max(raw) FILTER (kind = 1) / (SELECT raw FROM rw WHERE kind = 2), 4) AS corr1
FROM rw WHERE kind < 2 GROUP BY ALL"""),
)
def frame_scores(spark, d):
    """A logo of graded strength, with pixels whose ``a`` is negative and correlations of both signs, scored on every plane."""
    import numpy as np

    y, x = np.mgrid[0:8, 0:8]
    step = ((x + 2 * y) % 5).ravel()
    alpha = np.where(step == 4, 1.25, step / 10)
    mask = logo.mask(1 / (1 - alpha), -alpha * 100 / (255 * (1 - alpha)), 8, 8)
    planes = ad.luma(spark, d).select("media_id", "display_idx", F.expr("unhex(array_join(transform(plane, v -> lpad(hex(v), 2, '0')), ''))").alias("plane"))
    return logo.frame_scores(planes, mask).withColumns({"corr0": F.round("corr0", 4), "corr1": F.round("corr1", 4)})


# -- tracks, flags, headers ------------------------------------------------------------------------------------------------------------------------


def _tracks(spark, d):
    """One medium an order, one track a line."""
    codec = F.when(F.col("l_linenumber") == 1, "avc1").when(F.col("l_linenumber") == 2, F.when(F.col("l_suppkey") % 5 == 0, "avc1").otherwise("Opus")).when(F.col("l_linenumber") == 3, F.when(F.col("l_suppkey") % 3 == 0, "tx3g").otherwise("mp4a")).otherwise("text")
    rows = ad.table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("media_id"), F.col("l_linenumber").alias("track_id"), codec.alias("codec"), F.lit(30000).alias("timescale"), (F.col("l_suppkey") % 7 == 0).alias("has_edit_list"), F.when(F.col("l_suppkey") % 11 == 0, 2).otherwise(1).alias("stsd_entries"))
    return tr.with_kind(rows)


TRACKS = """tracks AS (SELECT CAST(l_orderkey AS VARCHAR) AS media_id, l_linenumber AS track_id, s, CASE l_linenumber WHEN 1 THEN 'video' WHEN 2 THEN CASE WHEN s % 5 = 0 THEN 'video' ELSE 'audio' END ELSE CASE WHEN s % 3 = 0 THEN 'other' ELSE 'audio' END END AS kind
FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)),
seen AS (SELECT media_id, count(*) FILTER (kind = 'video') AS video, count(*) FILTER (kind = 'audio') AS audio, count(*) FILTER (kind = 'other') AS other, bool_or(s % 7 = 0) AS edit_list, max(CASE WHEN s % 11 = 0 THEN 2 ELSE 1 END) AS stsd_entries FROM tracks GROUP BY media_id)"""


@query("a17_p23_track_inspection", f"WITH {TRACKS} SELECT *, CASE WHEN other > 0 THEN 'srt' END AS subtitle_format FROM seen")
def track_inspection(spark, d):
    return tr.inspected(_tracks(spark, d))


@query("p22_preparation_fault", f"WITH {TRACKS} SELECT media_id, video, audio FROM seen WHERE video >= 2 OR audio >= 2")
def preparation_fault(spark, d):
    return tr.preparation_fault(_tracks(spark, d))


@query("s10_s11_first_tracks", f"WITH {TRACKS} SELECT media_id, kind, min(track_id) AS track_id FROM tracks WHERE kind <> 'other' GROUP BY ALL")
def first_tracks(spark, d):
    rows = _tracks(spark, d)
    return tr.first_of(rows, "video").unionByName(tr.first_of(rows, "audio")).select("media_id", "kind", "track_id")


@query("p17_p21_support", f"""WITH {TRACKS}, i AS (SELECT CAST(o_orderkey AS VARCHAR) AS media_id, o_custkey % 13 = 0 AS open_gop FROM orders WHERE o_custkey % 17 <> 0)
SELECT seen.media_id, CASE WHEN video <> 1 THEN 'video_tracks' WHEN audio > 1 THEN 'audio_tracks' WHEN other > 0 THEN 'other_tracks' WHEN edit_list THEN 'edit_list' WHEN stsd_entries > 1 THEN 'sample_descriptions'
WHEN open_gop IS NULL THEN 'no_index' WHEN open_gop THEN 'open_gop' END AS reason FROM seen LEFT JOIN i USING (media_id)""")
def support(spark, d):
    index = ad.table(spark, d, "orders").filter("o_custkey % 17 <> 0").select(F.col("o_orderkey").cast("string").alias("media_id"), F.when(F.col("o_custkey") % 13 == 0, 32).otherwise(29).alias("flags"))
    return tr.support(_tracks(spark, d), index)


@query("p1_p6_flag_bits", "SELECT event_id, event_id % 64 & 1 <> 0 AS is_key, event_id % 64 & 2 <> 0 AS leading, event_id % 64 & 4 <> 0 AS pts, event_id % 64 & 8 <> 0 AS dts, event_id % 64 & 16 <> 0 AS at, event_id % 64 & 32 <> 0 AS earlier FROM events")
def flag_bits(spark, d):
    f = (F.col("event_id") % 64).cast("int")
    names = {"is_key": tx.KEY_PACKET, "leading": tx.LEADING, "pts": tx.PTS_VALID, "dts": tx.DTS_VALID, "at": tx.OFFSET_VALID, "earlier": tx.NEEDS_EARLIER}
    return ad.table(spark, d, "events").select("event_id", *(tx.has_flag(f, b).alias(k) for k, b in names.items()))


@query("p13_rect_rules", """SELECT event_id, CASE WHEN x < 0 THEN 'negative' WHEN w <= 0 THEN 'empty' WHEN x + w > 40 THEN 'too_wide' WHEN x + w > 35 THEN 'too_high' END AS fault, x - ((x % 2) + 2) % 2 AS even
FROM (SELECT event_id, event_id % 50 - 5 AS x, event_id % 7 AS w FROM events)""")
def rect_rules(spark, d):
    x, w = F.col("event_id") % 50 - 5, F.col("event_id") % 7
    return ad.table(spark, d, "events").select("event_id", tx.rect_fault(x, x, w, w, F.lit(40), F.lit(35)).alias("fault"), tx.even_down(x).alias("even"))


@query("p15_p16_logo_decision", """SELECT event_id, CASE WHEN s <= 420 THEN 0.03 ELSE 0.1 END AS threshold, CASE WHEN f < CASE WHEN s <= 420 THEN 0.03 ELSE 0.1 END THEN 'below_threshold' WHEN event_id % 5 = 0 THEN 'no_intervals' ELSE 'use' END AS decision
FROM (SELECT event_id, event_id % 800 AS s, event_id % 13 / 100.0 AS f FROM events)""")
def logo_decision(spark, d):
    rows = ad.table(spark, d, "events").select("event_id", tx.presence_threshold(F.col("event_id") % 800).alias("threshold"))
    text = F.when(F.col("event_id") % 5 == 0, "").otherwise("x")
    return rows.withColumn("decision", tx.presence_decision(F.col("event_id") % 13 / 100.0, "threshold", text))


@query("f11_f16_headers", """SELECT o_orderkey, CASE WHEN k = 0 THEN 30000 ELSE k END AS num, CASE WHEN k = 1 THEN 0 WHEN k = 0 THEN 1001 ELSE 2 END AS den, round(CASE WHEN k = 1 THEN 1 WHEN k = 0 THEN 30000 / 1001.0 ELSE k / 2.0 END, 6) AS fps, k + 7 AS frames
FROM (SELECT o_orderkey, o_custkey % 60 AS k FROM orders)""")
def headers(spark, d):
    k = F.col("o_custkey") % 60
    full = F.create_map(F.lit("frame_rate_num"), k.cast("string"), F.lit("frame_rate_den"), F.when(k == 1, "0").otherwise("2"), F.lit("frame_count"), (k + 7).cast("string"))
    header = F.when(k == 0, F.create_map(F.lit("frame_count"), (k + 7).cast("string"))).otherwise(full)
    rows = ad.table(spark, d, "orders").select("o_orderkey", header.alias("header"))
    num, den = tx.frame_rate("header")
    return rows.select("o_orderkey", num.alias("num"), den.alias("den"), F.round(tx.fps("header"), 6).alias("fps"), tx.header_long("header", "frame_count").alias("frames"))


# -- texts ---------------------------------------------------------------------------------------------------------------------------------------------


@query("s16_k9_trim_roundtrip", both("n coarse", """SELECT media_id, string_agg('Trim(' || "start" || ',' || "end" - 1 || ')', ' ++ ' ORDER BY range_id) AS text FROM coarse GROUP BY media_id"""))
def trim_roundtrip(spark, d):
    rows, _ = texts.parse_trim(texts.format_trim(ad.coarse_ranges(spark, d)))
    return texts.format_trim(rows)


@query("s15_jls_parse", both("runs structure", 'SELECT media_id, row_number() OVER (ORDER BY "start") - 1 AS entry_id, "start", "end", 2 AS duration_sec, error_frames, 0 AS logo_sec, label FROM structure'))
def jls_parse(spark, d):
    rows = ad.structure(spark, d)
    line = F.format_string("%6d  %6d   2   %3d   0 %s", "start", "end", "error_frames", "label")
    files = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("start", line.alias("l")))).alias("ls"))
    files = files.select("media_id", F.concat(F.lit("header\n\n"), F.expr("array_join(transform(ls, x -> x.l), '\n')")).alias("text"))
    return texts.parse_jls(files)[0]


@query("s12_index_parse", both("packets ordered", "SELECT media_id, display_idx AS frame_number, decode_idx AS sample_number, dts AS dts, 29 AS flags FROM ordered"))
def index_parse(spark, d):
    rows = pk.display_order(ad.packets(spark, d))
    line = F.concat_ws("\t", "display_idx", "decode_idx", F.lit(0), "file_offset", "cts", "dts", "duration", F.lit(29))
    files = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("display_idx", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("DTVINDEX\t1\nframe_count\t7\n\nFRAMES\n"), F.expr("array_join(transform(ls, x -> x.l), '\n')"), F.lit("\nEND\n"))
    return texts.parse_index(files.select("media_id", text.alias("text")))[1].select("media_id", "frame_number", "sample_number", "dts", "flags")


@query("s23_line_split", """SELECT doc_id, i - 1 AS line, rtrim(x, chr(10)) AS text, CASE WHEN ends_with(x, chr(10)) THEN chr(10) ELSE '' END AS terminator FROM
(SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS l FROM documents))""")
def line_split(spark, d):
    files = ad.table(spark, d, "documents").select(F.col("doc_id").alias("media_id"), "text")
    return texts.split_lines(files).select(F.col("media_id").alias("doc_id"), "line", "text", "terminator")


@query("f18_stem_sanitise", "SELECT page_id, substr(regexp_replace(url, '[[:cntrl:]/\\s]', '_', 'g'), 1, 80) AS stem FROM pages")
def stem_sanitise(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.sanitised("url").alias("stem"))


@query("f17_fnv1a", f"""SELECT page_id, lower(printf('%08x%08x', CAST(h // 4294967296 AS BIGINT), CAST(h % 4294967296 AS BIGINT))) AS hash FROM (SELECT page_id,
list_reduce([14695981039346656037::HUGEINT] || {BYTES.format("url", "HUGEINT")}, lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM pages)""")
def fnv1a(spark, d):
    return ad.table(spark, d, "pages").select("page_id", tx.fnv1a("url").alias("hash"))


@query("f25_subtitle_format", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ass' WHEN 1 THEN 'srt' WHEN 2 THEN 'ass' END AS format FROM pages")
def subtitle_format(spark, d):
    ext = F.element_at(F.array(F.lit(".ASS"), F.lit(".srt"), F.lit(".ssa"), F.lit(".vtt")), (F.col("page_id") % 4 + 1).cast("int"))
    return ad.table(spark, d, "pages").select("page_id", tx.subtitle_format(F.concat("url", ext)).alias("format"))


@query("j12_audio_subset", both("packets", """SELECT media_id, min(i) AS ord, 'unknown_audio' AS code, array_to_string(list_sort(list(CAST(5000000000 + i AS VARCHAR)))[:5], ',') AS detail
FROM (SELECT media_id, decode_idx // 2 AS i FROM packets WHERE decode_idx % 2 = 0) WHERE i % 7 = 5 GROUP BY media_id"""))
def audio_subset(spark, d):
    """Every second packet goes out; of those every seventh has other bytes."""
    rows = ad.packets(spark, d).select("media_id", F.col("decode_idx").alias("position"), F.crc32(F.col("size").cast("string").cast("binary")).alias("crc"), (F.col("decode_idx") * 1001).alias("dts"))
    out = rows.filter("position % 2 = 0").withColumns({"position": F.expr("position div 2")})
    return vf.audio_subset(rows, out.withColumn("crc", F.when(F.col("position") % 7 == 5, F.col("position") + 5000000000).otherwise(F.col("crc"))))


@query("j11_same_packets", both("packets", "SELECT media_id, decode_idx AS ord, 'packet_differs' AS code FROM packets WHERE decode_idx % 40 = 39"))
def same_packets(spark, d):
    rows = ad.packets(spark, d).select("media_id", F.col("decode_idx").alias("position"), F.col("size").alias("crc"))
    return vf.same_packets(rows, rows.withColumn("crc", F.col("crc") + F.when(F.col("position") % 40 == 39, 1).otherwise(0))).select("media_id", "ord", "code")


@query("v9_frame_count", both("packets", "SELECT media_id, n AS ord, 'frame_count' AS code, concat_ws(' ', n + 1, n) AS detail FROM (SELECT media_id, count(*) AS n FROM packets GROUP BY media_id) WHERE n % 6 = 0"))
def frame_count(spark, d):
    rows = ad.packets(spark, d)
    heads = rows.groupBy("media_id").agg((F.count(F.lit(1)) + F.when(F.count(F.lit(1)) % 6 == 0, 1).otherwise(0)).alias("header_frame_count"))
    return vf.frame_count(rows, heads)


# -- reports -------------------------------------------------------------------------------------------------------------------------------------------

SQL_LF = "chr(10)"


def _c(text: str) -> str:
    """SQL for a fixed text that holds line feeds."""
    return "(" + f" || {SQL_LF} || ".join(f"'{x}'" for x in text.split("\n")) + ")"


SNAP = """, d AS (SELECT q.*, round((cp.units - cb.units) / 30000.0, 6) + 0.0 AS ps, round((cn.units - cb.units) / 30000.0, 6) + 0.0 AS ns FROM q JOIN c cb ON cb.at = boundary LEFT JOIN c cp ON cp.at = prev LEFT JOIN c cn ON cn.at = next),
mv AS (SELECT range_id, min(coalesce(prev, boundary)) FILTER (kind = 'start') AS s, max(coalesce(next, boundary)) FILTER (kind = 'end') AS e, min(boundary) FILTER (kind = 'start') AS so, max(boundary) FILTER (kind = 'end') AS eo FROM q GROUP BY range_id),
sm AS (SELECT count(*) AS k, sum((so - s) + (eo * 0 + e - eo)) * 1001 / 30000.0 AS extra, sum(e - s) * 1001 / 30000.0 AS out FROM mv)"""


@query(
    "k15_boundary_report",
    both("frames n coarse coarse_structure", BOUNDARIES.format(frames="frames") + SNAP + f""",
ln AS (SELECT string_agg(printf({_c(reports.BOUNDARY)}, CASE kind WHEN 'start' THEN '{reports.START}' ELSE '{reports.END}' END, boundary, CASE WHEN prev IS NULL THEN '{reports.NO_KEYFRAME}' ELSE printf('{reports.KEYFRAME}', prev, ps) END,
CASE WHEN next IS NULL THEN '{reports.NO_KEYFRAME}' ELSE printf('{reports.KEYFRAME}', next, ns) END), '' ORDER BY range_id, boundary) AS t FROM d),
gr AS (SELECT string_agg(printf({_c(reports.GRID)}, "start", "end", error_frames), '' ORDER BY entry_id) AS t FROM coarse_structure WHERE label = ':CM')
SELECT 'm' AS media_id, printf({_c(reports.TOTALS)}, k, 2 * k, extra, extra / (2 * k), printf('%02d:%02d', CAST(round(out) AS BIGINT) // 60, CAST(round(out) AS BIGINT) % 60)) || chr(10) || ln.t || chr(10) || {_c(reports.GRID_TITLE)} || gr.t AS text FROM sm, ln, gr"""),
)
def boundary_text(spark, d):
    frames, ranges = ad.frames(spark, d), ad.coarse_ranges(spark, d)
    totals = ad.totals(frames)
    near = report.boundary_distances(ranges, frames, totals, 1, 30000).withColumns({"prev_s": F.round("prev_s", 6), "next_s": F.round("next_s", 6)})
    return reports.boundary_report(near, report.snap_summary(ranges, frames, totals, "outward", 1, 30000), ad.coarse_structure(spark, d))


@query("k16_gate_report", both("n coarse coarse_structure", MISSED + f""", k AS (SELECT count(*) AS ranges, CAST(sum("end" - "start") AS BIGINT) AS kept FROM coarse), x AS (SELECT count(*) AS missed FROM m),
e AS (SELECT count(*) FILTER (abs(error_frames) > 5) AS off_grid, max(abs(error_frames)) AS most FROM coarse_structure WHERE label = ':CM')
SELECT 'm' AS media_id, printf({_c(reports.GATE)}, missed, CASE WHEN missed > 0 THEN '{reports.STOPS}' ELSE '' END, ranges, n - kept, n, CASE WHEN n = kept THEN '{reports.STOPS}' ELSE '' END, 100 * kept / n::DOUBLE)
|| printf({_c(reports.GATE_GRID)}, off_grid, printf('{reports.LARGEST}', most), CASE WHEN missed > 0 OR n = kept THEN '{reports.STOP}' ELSE '{reports.GO}' END) AS text FROM n, k, x, e"""))
def gate_text(spark, d):
    return reports.gate_report(report.verdict(ad.coarse_ranges(spark, d), ad.coarse_structure(spark, d), ad.totals(ad.frames(spark, d))))


@query("k17_av_report", both("n coarse segments audio", AV + f""", r AS (SELECT *, row_number() OVER (ORDER BY range_id) AS i FROM w)
SELECT 'm' AS media_id, printf({_c(reports.AV)}, count(*), arg_max(diff_ms, struct_pack(a := abs(diff_ms), b := -i)), arg_max(i, struct_pack(a := abs(diff_ms), b := -i)), sum(diff_ms), CASE WHEN max(abs(diff_ms)) > 40 THEN '{reports.AV_WARNING}' ELSE '' END)
|| string_agg(printf({_c(reports.AV_SEGMENT)}, i, video_s, audio_s, diff_ms), '' ORDER BY i) AS text FROM r"""))
def av_text(spark, d):
    found = _av(spark, d)
    return reports.av_report(ad.totals(ad.frames(spark, d)), found, audio.av_summary(found))


@query("k18_missed_warnings", both("n coarse coarse_structure", MISSED + f""", t AS (SELECT *, CAST(floor("start" / (30000 / 1001.0)) AS BIGINT) AS a, CAST(floor("end" / (30000 / 1001.0)) AS BIGINT) AS b FROM m)
SELECT media_id, range_id, entry_id, printf('{reports.MISSED}', printf('%02d:%02d', a // 60, a % 60), printf('%02d:%02d', b // 60, b % 60), "start", "end", length_frames, matched_gap_length, greatest(0, "start" - 1), "end" + 1) AS text FROM t"""))
def missed_text(spark, d):
    found = report.missed_candidates(ad.coarse_ranges(spark, d), ad.coarse_structure(spark, d))
    return found.select("media_id", "range_id", "entry_id", reports.missed_warning(30000 / 1001).alias("text"))


# -- subtitle files, segment maps ------------------------------------------------------------------------------------------------------------------------


def _file(rows: DataFrame, head: str, *lines) -> DataFrame:
    """One file of all events, in their order."""
    held = rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(*lines).alias("t")))).alias("ts"))
    return held.select("media_id", F.concat(F.lit(head), F.expr("array_join(transform(ts, t -> t.t), '')")).alias("text"))


#: Events of a piece of a file.
PIECE = 1024


def _pieces(rows: DataFrame, *lines) -> DataFrame:
    """The same in pieces of bounded length: ``media_id, piece, text``."""
    held = rows.groupBy("media_id", F.floor(F.col("event_id") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat(*lines).alias("t")))).alias("ts"))
    return held.select("media_id", "piece", F.expr("array_join(transform(ts, t -> t.t), '')").alias("text"))


def _srt(spark, d) -> DataFrame:
    start = F.col("event_id") * 33
    rows = ad.table(spark, d, "events").select(ad.media(), "event_id")
    times = tx.format_srt_time(start), F.lit(" --> "), tx.format_srt_time(start + 500 + F.col("event_id") % 700)
    return _pieces(rows, F.col("event_id").cast("string"), F.lit("\n"), *times, F.lit(" X1:1\nline "), F.col("event_id").cast("string"), F.lit("\n\n"))


def _events_sql(unit: int, start: str, end: str) -> str:
    return f"""+ sub_events AS (SELECT 'm' AS media_id, event_id, {start} * {unit} AS "start", {end} * {unit} AS "end" FROM events), {FATE.removeprefix("+")}"""


SRT_TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
ASS_TIME = "printf('%d:%02d:%02d.%02d', {0} // 360000, {0} // 6000 % 60, {0} // 100 % 60, {0} % 100)"


@query("f29_srt_remap", both("n coarse segments", _events_sql(30, "event_id * 33", "(event_id * 33 + 500 + event_id % 700)") + f""", o AS (SELECT *, os // 30 AS a, (oe + 29) // 30 AS b FROM f)
SELECT 'm' AS media_id, string_agg(CASE WHEN fate = 'Discarded' THEN chr(10) ELSE event_id || chr(10) || {SRT_TIME.format("a")} || ' --> ' || {SRT_TIME.format("b")} || ' X1:1' || chr(10) || 'line ' || event_id || chr(10) || chr(10) END, '' ORDER BY event_id) AS text FROM o"""))
def srt_remap(spark, d):
    return subtitles.remap_srt(_srt(spark, d), ad.segments(spark, d), 30000)[0]


@query("s25_srt_blocks", "SELECT 'm' AS media_id, event_id AS block, 4 AS lines FROM events")
def srt_blocks(spark, d):
    return texts.srt_blocks(texts.split_lines(_srt(spark, d))).groupBy("media_id", "block").agg(F.count(F.lit(1)).alias("lines"))


ASS_HEAD = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"


@query("f28_ass_remap", both("n coarse segments", _events_sql(300, "event_id * 3", "(event_id * 3 + 50 + event_id % 70)") + f""", o AS (SELECT *, os // 300 AS a, (oe + 299) // 300 AS b FROM f)
SELECT 'm' AS media_id, {_c(ASS_HEAD)} || string_agg('Dialogue: 0,' || {ASS_TIME.format("a")} || ',' || {ASS_TIME.format("b")} || ',Default,text, line ' || event_id || chr(10), '' ORDER BY event_id) FILTER (fate <> 'Discarded') AS text FROM o"""))
def ass_remap(spark, d):
    start = F.col("event_id") * 3
    rows = ad.table(spark, d, "events").select(ad.media(), "event_id")
    times = tx.format_ass_time(start), F.lit(","), tx.format_ass_time(start + 50 + F.col("event_id") % 70)
    files = _file(rows, ASS_HEAD, F.lit("Dialogue: 0,"), *times, F.lit(",Default,text, line "), F.col("event_id").cast("string"), F.lit("\n"))
    return subtitles.remap_ass(files, ad.segments(spark, d), 30000)[0]


@query("f8_fixed_time_split", f"SELECT event_id, {SRT_TIME.format('v')} AS time, ' X1:' || v AS rest FROM (SELECT event_id, event_id * 7919 AS v FROM events)")
def fixed_time_split(spark, d):
    v = F.col("event_id") * 7919
    time, rest = tx.split_time(F.concat(tx.format_srt_time(v), F.lit(" X1:"), v.cast("string")))
    return ad.table(spark, d, "events").select("event_id", time.alias("time"), rest.alias("rest"))


@query("p8_p10_text_flags", """SELECT event_id, event_id % 3 = 0 AS cancelled, event_id % 4 = 1 AS relative, event_id % 5 = 2 AS bom FROM events""")
def text_flags(spark, d):
    i = F.col("event_id")
    label = F.concat(F.lit(":CM"), F.when(i % 3 == 0, "(cut-cancel)").otherwise(""))
    tag = F.concat(F.lit("{\\b1"), F.when(i % 4 == 1, tx.RELATIVE_TAGS[0]).otherwise(""), F.lit("}text"))
    text = F.concat(F.when(i % 5 == 2, texts.BOM).otherwise(""), F.lit("1"))
    return ad.table(spark, d, "events").select("event_id", tx.is_cut_cancelled(label).alias("cancelled"), tx.has_relative_timing(tag).alias("relative"), texts.has_bom(text).alias("bom"))


@query("s18_segment_map_parse", both("n coarse segments", 'SELECT s.media_id, s.source_start_dts, s.duration, s.output_start, c."start" AS source_start_frame, n AS total_frames FROM segments s JOIN coarse c USING (range_id), n'))
def segment_map_parse(spark, d):
    rows = ad.segments(spark, d).join(ad.coarse_ranges(spark, d), ["media_id", "range_id"])
    parts = F.struct(F.col("start").alias("source_start_frame"), F.col("end").alias("source_end_frame"), "source_start_dts", (F.col("end") - F.col("start")).alias("frame_count"), "output_start", "duration")
    files = rows.groupBy("media_id").agg(F.collect_list(parts).alias("segments")).join(ad.totals(ad.frames(spark, d)), "media_id")
    whole = F.struct("segments", F.lit(30000).alias("video_timescale"), F.lit(30000).alias("frame_rate_num"), F.lit(1001).alias("frame_rate_den"), F.lit("a.mp4").alias("input"), "total_frames")
    found, _ = texts.parse_segment_map(files.select("media_id", F.to_json(whole).alias("text")))
    return found.select("media_id", F.explode("segments").alias("s"), "total_frames").select("media_id", "s.source_start_dts", "s.duration", "s.output_start", "s.source_start_frame", "total_frames")


@query("a4_leading_frames", "SELECT media_id, CAST(count(*) FILTER (d % 64 & 2 <> 0) AS BIGINT) AS leading FROM (SELECT CAST(user_id AS VARCHAR) AS media_id, event_id AS d FROM events) GROUP BY media_id")
def leading_frames(spark, d):
    rows = ad.table(spark, d, "events").select(F.col("user_id").cast("string").alias("media_id"), (F.col("event_id") % 64).cast("int").alias("flags"))
    return tr.leading_frames(rows)


@query("f27_index_arithmetic", """SELECT event_id, v - event_id AS frames, v + 7 AS later, CASE WHEN v * 5 + 4294960000 <= 4294967295 THEN v * 5 + 4294960000 END AS checked FROM (SELECT event_id, event_id + event_id % 13 AS v FROM events)""")
def index_arithmetic(spark, d):
    at, here = DisplayIdx(F.col("event_id") + F.col("event_id") % 13), DisplayIdx(F.col("event_id"))
    far = DisplayIdx(at.column * 5).checked_add(4294960000)
    return ad.table(spark, d, "events").select("event_id", (at - here).alias("frames"), (at + 7).column.alias("later"), far.alias("checked"))
