import pytest

from framewise.operators import audio, packets as pk, ranges as rg, remap, report
from framewise.operators.errors import CheckFailed
from framewise.operators.sequence import as_of, carried, running


def ranges(spark, pairs):
    return spark.createDataFrame([("m", i, a, b) for i, (a, b) in enumerate(pairs)], "media_id string, range_id long, start long, end long")


def sync(spark, points):
    return spark.createDataFrame([("m", p) for p in points], "media_id string, display_idx long")


def total(spark, n):
    return spark.createDataFrame([("m", n)], "media_id string, total_frames long")


@pytest.mark.parametrize(
    ("trim", "direction", "want", "deltas"),
    [
        ((120, 300), "outward", (100, 400), (20, 100)),
        ((120, 250), "outward", (100, 250), (20, 0)),
        ((100, 250), "outward", (100, 250), (0, 0)),
        ((120, 300), "inward", None, None),
        ((100, 250), "inward", (100, 250), (0, 0)),
        ((0, 100), "outward", (0, 100), (0, 0)),
        ((300, 499), "outward", (250, 500), (50, 1)),
        ((250, 500), "outward", (250, 500), (0, 0)),
    ],
)
def test_snap_on_irregular_sync_points(spark, trim, direction, want, deltas):
    args = ranges(spark, [trim]), sync(spark, [0, 100, 250, 400]), total(spark, 500), direction
    if want is None:
        with pytest.raises(CheckFailed, match="empty_range"):
            rg.snap(*args)
        return
    r = rg.snap(*args).first()
    assert (r["start"], r["end"]) == want and (r["start_delta"], r["end_delta"]) == deltas


def test_ranges_that_overlap_after_snapping_are_an_error(spark):
    with pytest.raises(CheckFailed, match="overlap"):
        rg.snap(ranges(spark, [(50, 120), (130, 180)]), sync(spark, [0, 100, 200, 300]), total(spark, 300))


@pytest.mark.parametrize(
    ("kept", "want"),
    [
        ([(360, 480)], [(0, 360), (480, 599)]), ([(0, 599)], []), ([(0, 120)], [(120, 599)]), ([(480, 599)], [(0, 480)]), ([(0, 120), (360, 599)], [(120, 360)]),
        ([(0, 120), (120, 599)], []), ([], [(0, 599)]), ([(0, 100), (200, 300), (400, 500)], [(100, 200), (300, 400), (500, 599)]),
    ],
)
def test_complement(spark, kept, want):
    got = rg.complement(ranges(spark, kept), total(spark, 599)).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == want and [r["range_id"] for r in got] == list(range(len(want)))


def packets(spark, offsets, duration=1000, every=4):
    return spark.createDataFrame([("m", i, 48 + 10 * i, 10, duration, o, i % every == 0) for i, o in enumerate(offsets)], "media_id string, decode_idx long, file_offset long, size long, duration long, cts_offset long, is_sync boolean")


def test_display_order_and_ties(spark):
    got = pk.display_order(packets(spark, [0, 3000, -1000, -1000])).orderBy("decode_idx").collect()
    assert [r["display_idx"] for r in got] == [0, 3, 1, 2] and [r["dts"] for r in got] == [0, 1000, 2000, 3000]
    ties = pk.order_ties(pk.display_order(packets(spark, [0, 3000, -1000, -2000]))).collect()
    assert [r["decode_idxs"] for r in ties] == [[2, 3]]


def test_a_segment_starts_at_its_decode_time(spark):
    p = packets(spark, [0, 3000, -1000, -1000])
    moved = ranges(spark, [(1, 3)])
    assert audio.source_starts(moved, pk.display_order(p)).first()["source_start_dts"] == 2000
    assert audio.independent_source_starts(moved, p).first()["source_start_dts"] == 2000


def test_keep_list_takes_packets_by_number(spark):
    p = pk.display_order(packets(spark, [0, 2000, -1000, -1000] * 3))
    got = rg.keep_list(ranges(spark, [(0, 4), (8, 12)]), p).orderBy("position").collect()
    assert [r["decode_idx"] for r in got] == [0, 1, 2, 3, 8, 9, 10, 11] and [r["position"] for r in got] == list(range(8))


def frames(spark, n=5041, gop=120):
    return spark.range(n).selectExpr("'m' as media_id", "id as display_idx", "1001L as duration", f"id % {gop} = 0 as is_key")


def test_distances_and_summary_of_a_measured_file(spark):
    args = ranges(spark, [(63, 5008)]), frames(spark), total(spark, 5041)
    got = {r["kind"]: r for r in report.boundary_distances(*args, 1, 30000).collect()}
    assert [(got[k]["prev"], got[k]["next"], round(got[k]["prev_s"], 2), round(got[k]["next_s"], 2)) for k in ("start", "end")] == [(0, 120, -2.10, 1.90), (4920, 5040, -2.94, 1.07)]
    out = report.snap_summary(*args, "outward", 1, 30000).first()
    assert out["extra_frames"] == 95 and out["extra_s"] == pytest.approx(95 * 1001 / 30000) and out["output_s"] == pytest.approx(5040 * 1001 / 30000)
    out = report.snap_summary(*args, "inward", 1, 30000).first()
    assert out["extra_frames"] == 145 and out["output_s"] == pytest.approx(4800 * 1001 / 30000)


def test_no_sync_point_on_one_side(spark):
    got = as_of(spark.createDataFrame([("m", p) for p in (0, 63, 100, 230, 400, 999)], "media_id string, p long"), sync(spark, [100, 250, 400]), ["media_id"], "p", "display_idx", a="before", b="after")
    assert {r["p"]: (r["a"], r["b"]) for r in got.collect()} == {0: (None, 100), 63: (None, 100), 100: (100, 100), 230: (100, 250), 400: (400, 400), 999: (400, None)}


TRIM = [(0, 53592), (57189, 70975), (74571, 86859), (90455, 100000)]
ENTRIES = [(0, 34201, ":L"), (34202, 37798, ":L"), (37799, 53591, ":L"), (53592, 57188, ":CM"), (57189, 70974, ":L"), (70975, 74570, ":CM"), (74571, 86858, ":L"), (86859, 90454, ":CM"), (90455, 99999, ":L")]


def entries(spark, rows, error=0):
    return spark.createDataFrame([("m", i, a, b, e, x) for i, (a, b, x, *more) in enumerate(rows) for e in (more or [error])], "media_id string, entry_id long, start long, end long, error_frames int, label string")


def test_a_missed_block_is_found_by_the_length_of_the_gaps(spark):
    got = report.missed_candidates(ranges(spark, TRIM), entries(spark, ENTRIES)).collect()
    assert [(r["start"], r["end"], r["length_frames"], r["matched_gap_length"]) for r in got] == [(34202, 37798, 3597, 3596)]
    assert report.verdict(ranges(spark, TRIM), entries(spark, ENTRIES), total(spark, 100_000)).first()["stop"]
    assert not report.missed_candidates(ranges(spark, TRIM[:2]), entries(spark, ENTRIES)).collect()


def test_verdicts(spark):
    v = report.verdict(ranges(spark, [(0, 1000), (1500, 3000)]), entries(spark, [(1000, 1499, ":CM", 2)]), total(spark, 3000)).first()
    assert (v["stop"], v["kept_frames"], v["cut_frames"], v["off_grid"], v["max_grid_error"]) == (False, 2500, 500, 0, 2) and v["kept_ratio"] == pytest.approx(2500 / 3000)
    v = report.verdict(ranges(spark, [(0, 10_000)]), entries(spark, []), total(spark, 10_000)).first()
    assert v["stop"] and v["stops_for_no_cut"] and v["max_grid_error"] is None
    v = report.verdict(ranges(spark, [(0, 10)]), entries(spark, [(10, 20, ":CM", -14), (30, 40, ":CM", 2)]), total(spark, 100)).first()
    assert (v["off_grid"], v["max_grid_error"]) == (1, 14)


def test_known_lengths_group_by_their_first(spark):
    gaps = spark.createDataFrame([("m", g) for g in (120, 900, 3596, 3596, 3597)] + [("n", g) for g in (10, 12, 14, 16)], "media_id string, gap long")
    assert {r["media_id"]: r["known"] for r in report.known_lengths(gaps).collect()} == {"m": [3596], "n": [10, 14]}


def tone(spark, n, first=960, d=960):
    return spark.createDataFrame([("m", i, first if i == 0 else d) for i in range(n)], "media_id string, decode_idx long, duration long")


def segs(spark, rows):
    return spark.createDataFrame([("m", i, s, d) for i, (s, d) in enumerate(rows)], "media_id string, range_id long, source_start_dts long, duration long")


def test_audio_is_taken_at_the_source_position(spark):
    got = audio.audio_segments(segs(spark, [(0, 120 * 1001), (360 * 1001, 120 * 1001)]), tone(spark, 2000), 30000, 48000).orderBy("range_id").collect()
    assert got[1]["start"] == round(360 * 1001 / 30000 * 48000 / 960) != got[0]["end"]
    assert [r["end"] for r in audio.audio_segments(segs(spark, [(0, 10**9)]), tone(spark, 10), 30000, 48000).collect()] == [10]
    with pytest.raises(CheckFailed):
        audio.audio_segments(segs(spark, [(0, 1)]), tone(spark, 1), 0, 48000)


def test_ten_contiguous_segments_dont_drift(spark):
    got = audio.audio_segments(segs(spark, [(i * 16016, 16016) for i in range(10)]), tone(spark, 400), 30000, 48000).orderBy("range_id").collect()
    assert all(a["end"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and all(r["error_packets"] <= 0.5 for r in got)


def test_difference_in_length_is_a_warning(spark):
    durations = segs(spark, [(0, 10 * 1001)]).select("media_id", "range_id", "duration")
    chosen = spark.createDataFrame([("m", 0, 0, 24)], "media_id string, range_id long, start long, end long")
    s = audio.av_summary(audio.av_segments(durations, chosen, tone(spark, 100), 30000, 48000)).first()
    assert s["warn"] and s["worst_range"] == 0 and s["total_ms"] == pytest.approx((24 * 960 / 48000 - 10010 / 30000) * 1000)


A, B = [(1000, 4000, 0)], [(0, 1000, 0), (2000, 1000, 1000)]


@pytest.mark.parametrize(
    ("on", "event", "fate", "out", "flags"),
    [
        (A, (2000, 3000), "Shifted", (1000, 2000), (False, False, False)), (A, (0, 500), "Discarded", (None, None), (None, None, None)), (B, (1200, 1800), "Discarded", (None, None), (None, None, None)),
        (A, (500, 1500), "Clipped", (0, 500), (True, False, False)), (A, (4500, 5500), "Clipped", (3500, 4000), (False, True, False)), (B, (500, 2500), "Clipped", (500, 1000), (False, True, True)),
        (A, (1000, 1000), "Discarded", (None, None), (None, None, None)), (B, (1500, 2500), "Clipped", (1000, 1500), (True, False, False)),
    ],
)
def test_event_fates(spark, on, event, fate, out, flags):
    s = spark.createDataFrame([("m", i, *x) for i, x in enumerate(on)], "media_id string, range_id long, source_start_dts long, duration long, output_start long")
    r = remap.map_events(spark.createDataFrame([("m", 0, *event)], "media_id string, event_id long, start long, end long"), s).first()
    assert (r["fate"], (r["out_start"], r["out_end"]), (r["start_clamped"], r["end_clamped"], r["spans_multiple"])) == (fate, out, flags)


def test_two_level_windows_equal_plain_ones(spark, monkeypatch):
    import random

    from framewise.operators import sequence

    monkeypatch.setattr(sequence, "CHUNK", 7)
    rng = random.Random(3)
    data = [("m", i, rng.randrange(9), rng.random() < 0.2) for i in range(100)]
    rows = spark.createDataFrame(data, "media_id string, i long, v long, f boolean")
    got = carried(running(rows, ["media_id"], "i", s=("v", True), b=("v", False)), ["media_id"], "i", p=(rows["f"], "below"), n=(rows["f"], "after")).orderBy("i").collect()
    total = 0
    for r, (_, i, v, _) in zip(got, data, strict=True):
        assert r["b"] == total
        total += v
        assert r["s"] == total
        assert r["p"] == max((j for _, j, _, f in data if f and j < i), default=None) and r["n"] == min((j for _, j, _, f in data if f and j >= i), default=None)


def test_chunk_offsets_and_run_lengths(spark):
    p = packets(spark, [0, 0, 5, 5, -3])
    runs = pk.run_lengths(p, "cts_offset").orderBy("run").collect()
    assert [(r["count"], r["cts_offset"]) for r in runs] == [(2, 0), (2, 5), (1, -3)]
    stsc = spark.createDataFrame([("m", 0, 1, 2), ("m", 1, 2, 3)], "media_id string, entry int, first_chunk int, samples_per_chunk long")
    chunks = spark.createDataFrame([("m", 1, 100), ("m", 2, 1000)], "media_id string, chunk int, offset long")
    got = pk.packet_offsets(stsc, chunks, p.select("media_id", "decode_idx", "size")).orderBy("decode_idx").collect()
    assert [r["file_offset"] for r in got] == [100, 110, 1000, 1010, 1020]


def test_report_texts(spark):
    """The layout of reports, with and without key frames around a boundary and detected blocks."""
    from types import SimpleNamespace

    from framewise.plans import analyze

    frames = spark.createDataFrame([("m", i, 1001, i == 30) for i in range(60)], "media_id string, display_idx long, duration long, is_key boolean")
    ranges = spark.createDataFrame([("m", 0, 10, 40)], "media_id string, range_id long, start long, end long")
    totals = spark.createDataFrame([("m", 60)], "media_id string, total_frames long")
    entries = spark.createDataFrame([("m", 0, 0, 9, -2, ":CM"), ("m", 1, 10, 39, 0, ":L")], "media_id string, entry_id long, start long, end long, error_frames long, label string")
    a = SimpleNamespace(ranges=ranges, frames=frames, totals=totals, entries=entries)
    text = analyze.boundary_report(a, 1, 30000)
    assert text.startswith("保持区間数 1 / カット境界数 2\n") and "境界(開始)     10 : 直前KF=     -  直後KF=    30 (+0.67s)\n" in text
    assert "境界(終了)     40 : 直前KF=    30 (-0.33s)  直後KF=     -\n" in text and text.endswith("\nCM ブロックの15秒格子誤差:\n       0-9      誤差 -2 フレーム\n")
    gate = analyze.verdict_report(a)
    assert gate.startswith("gate 判定:\n  見逃し候補: 0 件\n  保持区間数 1 / 除去フレーム数 30（総 60 フレーム中）\n  保持率 50.0%") and gate.endswith("保証ではない）\n")
    assert analyze.warnings(a, 30.0) == []
