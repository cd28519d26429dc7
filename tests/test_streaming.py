from framewise.operators.remap import map_events
from framewise.streaming.events import interval_stream, remap_stream

SEGMENTS = "media_id string, range_id long, source_start_dts long, duration long, output_start long"
EVENTS = "media_id string, event_id long, start long, end long"


def test_events_of_a_stream_are_mapped_as_in_one_batch(spark, tmp_path):
    segs = spark.createDataFrame([("m", 0, 0, 4000, 0), ("m", 1, 5000, 4000, 4000)], SEGMENTS)
    rows = spark.createDataFrame([("m", i, i * 700, i * 700 + 900) for i in range(14)], EVENTS)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    remap_stream(stream, segs, sink, f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, map_events(rows, segs).collect()))


def test_intervals_of_media_that_arrive_whole(spark, tmp_path):
    schema = "media_id string, display_idx long, raw double"
    raw = [-1.0] * 20 + [1.0] * 40 + [-1.0] * 20
    spark.createDataFrame([("m", i, v) for i, v in enumerate(raw)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = []
    interval_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 5.0, lambda df, n: found.extend(df.collect()), f"{tmp_path}/state").awaitTermination()
    assert [(r["s_best"], r["e_best"]) for r in found] == [(20, 59)]
