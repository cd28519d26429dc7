import io
import random
import struct
from pathlib import Path

import numpy as np
import pytest

from framewise.operators import logo, signal
from framewise.operators.errors import CheckFailed, ParseError, Unsupported
from framewise.plans.cut import cut
from framewise.sources import isobmff as bmff
from framewise.sources import models


def judged(spark, raw, fps):
    rows = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(raw)], "media_id string, display_idx long, raw double")
    return signal.filled(signal.judged(rows, fps))


@pytest.mark.parametrize(
    ("raw", "fps", "text", "seen"),
    [
        ([1] * 1000 + [-1] * 450 + [1] * 1000, 30.0, "     0 S 0 ALL      0      0\n   999 E 0 ALL    999    999\n  1450 S 0 ALL   1450   1450\n  2449 E 0 ALL   2449   2449\n", 1994),
        ([-1, -1, -1, 1, 1, 1, 1, -1, -1, -1], 2.0, "     3 S 0 ALL      3      3\n     6 E 0 ALL      6      6\n", 2),
        ([-1] * 100, 30.0, None, 0),
    ],
)
def test_intervals(spark, raw, fps, text, seen):
    frames = judged(spark, raw, fps).cache()
    got = signal.interval_text(signal.intervals(frames)).first()
    assert (got and got["text"]) == text and signal.presence(frames).first()["logo_frames"] == seen


def test_chunks_dont_show(spark, monkeypatch):
    rng = random.Random(1)
    raw = [rng.choice((-1, -0.1, 0.1, 1)) for _ in range(300)]
    whole = judged(spark, raw, 5.0).orderBy("display_idx").collect()
    monkeypatch.setattr(signal, "CHUNK", 32)
    assert judged(spark, raw, 5.0).orderBy("display_idx").collect() == whole


def test_intervals_are_well_formed(spark):
    rng = random.Random(7)
    rows = [(str(k), i, rng.choice((-1.0, -0.3, 0.0, 0.3, 1.0))) for k in range(20) for i in range(120)]
    frames = signal.filled(signal.judged(spark.createDataFrame(rows, "media_id string, display_idx long, raw double"), 5.0))
    for r in signal.intervals(frames).collect():
        assert r["s_left"] <= r["s_best"] <= r["s_right"] <= r["e_right"] and r["e_left"] <= r["e_best"] <= r["e_right"]


def cross(size=32, alpha=0.5):
    on = np.zeros((size, size), np.float32)
    on[size // 2 - 2 : size // 2 + 2, 4:-4] = on[4:-4, size // 2 - 2 : size // 2 + 2] = alpha
    a = (1 / (1 - on)).ravel().astype(np.float32)
    return a, (-on * 200 / 255 / (1 - on)).ravel().astype(np.float32)


def test_scores_of_a_logo_on_flat_backgrounds():
    a, b = cross()
    mask = logo.mask(a, b, 32, 32)
    assert abs(mask.kernels.sum(axis=1)).max() < 1e-2
    for level in (24, 64, 128):
        corr0, corr1 = mask.scores(logo.drawn(a, b, level)[None])
        assert corr0[0] > 0.5 and abs(corr1[0]) < 0.1
    corr0, corr1 = mask.scores(np.full((1, 32 * 32), 120, np.float32))
    assert abs(corr0[0]) < 1e-3 and corr1[0] < -0.1
    with pytest.raises(CheckFailed):
        logo.mask(np.ones(16, np.float32), np.zeros(16, np.float32), 4, 4)


def test_learning_finds_the_coefficients(spark):
    w, h, a, b = 6, 4, 1.5, 0.02
    inner = {y * w + x for y in range(1, h - 1) for x in range(1, w - 1)}
    rows = []
    for i, level in enumerate(range(60, 211, 30)):
        rows.append(("m", i, [round((level - b * 255) / a) if p in inner else level for p in range(w * h)]))
    luma = spark.createDataFrame(rows, "media_id string, display_idx long, plane array<int>")
    got_a, got_b, used, total = logo.learned(luma, w, h, 12)
    assert used == total == 6 and all(abs(got_a[p] - a) < 0.02 and abs(got_b[p] - b) < 0.01 for p in inner)
    with pytest.raises(CheckFailed, match="too_few_frames"):
        logo.learned(luma.filter("display_idx < 3"), w, h, 12)
    with pytest.raises(CheckFailed, match="no_usable_frames"):
        logo.learned(luma.limit(0), w, h, 12)


def test_model_files():
    a, b = np.arange(24, dtype=np.float32), np.ones(24, np.float32)
    m = models.learned_model(a, b, 6, 4, (640, 360), (10, 20), "ロゴ" * 100, 7)
    back = models.parse_lgd(models.build_lgd(m))
    assert (back.w, back.h, back.x, back.y, back.img_w, back.service_id) == (6, 4, 10, 20, 640, 7) and (back.planes["aY"] == a).all() and back.name == "ロゴ" * 42 + "ロ"
    data = models.build_lgd(m)
    for bad in (data[:40], data[:100], data[:-4], data[:28] + bytes(4) + data[32:]):
        with pytest.raises(ParseError):
            models.parse_lgd(bad)


def test_frames_from_a_stream():
    got = []
    assert models.read_frames(io.BytesIO(b"abcdef"), 3, 2, got.append) == 2 and got == [b"abc", b"def"]
    for data, n in ((b"abcd", 1), (b"abc", 2)):
        with pytest.raises(CheckFailed):
            models.read_frames(io.BytesIO(data), 3, n, got.append)
    assert "-fps_mode" in models.frame_command("ffmpeg", "a", (0, 0, 2, 2))


# -- containers ------------------------------------------------------------------------------------------------------------------------------


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, data, version=0):
    return box(kind, struct.pack(">I", version << 24), data)


def table(kind, form, rows, version=0):
    return full(kind, struct.pack(">I", len(rows)) + b"".join(struct.pack(form, *r) for r in rows), version)


def movie(path: Path, gops=5, edit_list=False, tweak=None):
    """Video of 12-frame groups with reordering, and audio, every payload different."""
    n, tones = gops * 12, gops * 12 * 1001 * 48000 // 30000 // 960
    video = [struct.pack(">I", i) * (5 + i % 7) for i in range(n)]
    sound = [struct.pack(">I", 1 << 20 | i) * 3 for i in range(tones)]
    ftyp = box(b"ftyp", b"isom\0\0\0\1isom")
    at = len(ftyp) + 8
    offsets = []
    for p in video + sound:
        offsets.append(at)
        at += len(p)
    mdat = box(b"mdat", *video, *sound)
    shifts = [0, 2002, -1001, -1001] * (n // 4)

    def trak(number, scale, codec, payload, places, duration, extra):
        entry = box(codec, bytes(24) + struct.pack(">HH", 64, 48) + bytes(50))
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1) + entry), table(b"stts", ">II", [(len(payload), duration)]), *extra, table(b"stsc", ">III", [(1, 1, 1)]), full(b"stsz", struct.pack(">II", 0, len(payload)) + b"".join(struct.pack(">I", len(p)) for p in payload)), table(b"stco", ">I", [(o,) for o in places]))
        mdhd = full(b"mdhd", struct.pack(">IIII", 0, 0, scale, len(payload) * duration) + bytes(4))
        edts = box(b"edts", full(b"elst", struct.pack(">IIiI", 1, 10, 0, 65536))) if edit_list else b""
        return box(b"trak", full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0) + struct.pack(">I", 1) + bytes(60)), edts, box(b"mdia", mdhd, box(b"minf", stbl)))

    sync = table(b"stss", ">I", [(i + 1,) for i in range(0, n, 12)])
    ctts = table(b"ctts", ">Ii", [(1, s) for s in shifts], 1)
    moov = box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, 0) + bytes(80)), trak(1, 30000, b"avc1", video, offsets[:n], 1001, (ctts, sync)), trak(2, 48000, b"Opus", sound, offsets[n:], 960, ()))
    data = ftyp + mdat + moov
    path.write_bytes(tweak(data) if tweak else data)
    dts = [i * 1001 for i in range(n)]
    order = sorted(range(n), key=lambda i: dts[i] + shifts[i])
    index = "DTVINDEX\t1\nframe_count\t%d\nFRAMES\n" % n + "".join(f"{k}\t{i}\t{i - i % 12}\t{offsets[i]}\t{dts[i] + shifts[i]}\t{dts[i]}\t1001\t{29 if i % 12 == 0 else 28}\n" for k, i in enumerate(order)) + "END\n"
    return index, video, sound


def payload(path, kind):
    with open(path, "rb") as f:
        moov, _, length = bmff.read_moov(f)
    track = bmff.first_track(bmff.tracks(moov), kind)
    every = bmff.samples(track, length)
    return list(bmff.payloads(str(path), every)), every


def test_cut_and_its_complement(spark, tmp_path):
    source, out, rest, seg = (tmp_path / n for n in ("a.mp4", "o.mp4", "r.mp4", "m.json"))
    index, video, sound = movie(source)
    done = cut(spark, source, "Trim(14,20) ++ Trim(37,46)", index, out, rest, verify_bytes=True, map_path=seg)
    assert [(r["start"], r["end"]) for r in done.ranges] == [(12, 24), (36, 48)] and done.packets == 24 and done.segments[1]["output_start"] == 12 * 1001
    got, every = payload(out, "video")
    assert got == video[12:24] + video[36:48] and [i for i, p in enumerate(every) if p[4]] == [0, 12]
    assert payload(rest, "video")[0] == video[:12] + video[24:36] + video[48:]
    heard = payload(out, "audio")[0]
    assert set(heard) <= set(sound) and abs(len(heard) * 960 / 48000 - 24 * 1001 / 30000) < 0.04
    assert seg.exists() and sorted(p.name for p in tmp_path.iterdir()) == ["a.mp4", "m.json", "o.mp4", "r.mp4"]


def test_cuts_that_must_fail(spark, tmp_path):
    source, out = tmp_path / "a.mp4", tmp_path / "o.mp4"
    index, *_ = movie(source)
    for trim, text, error in (("Trim(14,20)", index.replace("\t1001\t29", "\t1001\t31"), "open_gop"), ("Trim(14,20)", None, "no_index"), ("Trim(2,3) ++ Trim(5,6)", index, "overlap"), ("Trim(14,20)", index.replace("\t0\t48\t", "\t0\t49\t", 1).replace("0\t0\t0\t24", "0\t0\t0\t25", 1), "file_offset")):
        with pytest.raises(CheckFailed, match=error):
            cut(spark, source, trim, text, out)
        assert not out.exists()
    edited = tmp_path / "e.mp4"
    index, *_ = movie(edited, edit_list=True)
    with pytest.raises(Unsupported, match="edit_list"):
        cut(spark, edited, "Trim(14,20)", index, out)
    with pytest.raises(CheckFailed, match="dash"):
        cut(spark, source, "Trim(1,2)", index, Path("-"))


def test_packets_by_data_source(spark, tmp_path):
    movie(tmp_path / "a.mp4")
    movie(tmp_path / "b.mp4", gops=2)
    spark.dataSource.register(bmff.PacketSource)
    spark.dataSource.register(bmff.TrackSource)
    paths = f"{tmp_path}/a.mp4\n{tmp_path}/b.mp4"
    rows = spark.read.format("isobmff_packets").option("paths", paths).load()
    assert rows.filter("kind = 'video'").count() == 84 and rows.filter("is_sync and kind = 'video'").count() == 7
    assert spark.read.format("isobmff_tracks").option("paths", paths).load().count() == 4


@pytest.mark.parametrize(
    "tweak",
    [
        lambda d: d.replace(b"stsz\0\0\0\0\0\0\0\0", b"stsz\0\0\0\0\x7f\xff\xff\xff", 1),
        lambda d: d[: d.index(b"stts") + 11] + b"\x09" + d[d.index(b"stts") + 12 :],
        lambda d: d.replace(b"stsc\0\0\0\0\0\0\0\1\0\0\0\1", b"stsc\0\0\0\0\0\0\0\1\0\0\0\0", 1),
        lambda d: d.replace(b"stsc\0\0\0\0\0\0\0\1\0\0\0\1\0\0\0\1", b"stsc\0\0\0\0\0\0\0\1\0\0\0\1\0\0\0\0", 1),
        lambda d: d[: d.index(b"stco") + 12] + b"\x7f\xff\xff\xff" + d[d.index(b"stco") + 16 :],
        lambda d: d[:-30],
    ],
)
def test_hostile_files(tmp_path, tweak):
    movie(tmp_path / "a.mp4", tweak=tweak)
    with pytest.raises(ParseError):
        payload(tmp_path / "a.mp4", "video")


def test_layout_beyond_32_bits():
    assert bmff.plan_mdat(24, 1000) == (8, False) and bmff.plan_mdat(24, bmff.LIMIT32 - 8) == (8, True) and bmff.plan_mdat(24, bmff.LIMIT32) == (16, True)
    assert bmff.mdat_header(16, 10) == struct.pack(">I4sQ", 1, b"mdat", 26)
    assert [len(c) for c in bmff.chunked([(0, 1, 400, 0, True)] * 7, 1000)] == [3, 3, 1] and len(bmff.chunked([(0, 1, 4, 0, True)] * 7, 0)) == 1


def test_scores_by_hand_with_negative_coefficients():
    """Coefficients below zero show the background, levels are multiples of eight, and correlations count by their size."""
    size, rng = 8, np.random.default_rng(3)
    alpha = rng.choice([0.0, 0.2, 0.5, 1.25], size * size)
    a, b = 1 / (1 - alpha), -alpha * 100 / (255 * (1 - alpha))
    model = logo.mask(a, b, size, size)

    def shown(level):
        return [(level - y * 255) / x if x > 0 else level for x, y in zip(a, b, strict=True)]

    def window(image, y, x):
        return [image[(y + dy) * size + x + dx] for dy in range(-2, 3) for dx in range(-2, 3)]

    points = [(y, x) for y in range(2, size - 2) for x in range(2, size - 2)]
    kernel, corr = {}, {}
    for p in points:
        near = window(shown(0), *p)
        kernel[p] = [v - sum(near) / 25 for v in near]
        for c in range(32):
            near = window(shown(8 * c), *p)
            corr[p, c] = sum(k * (v - sum(near) / 25) for k, v in zip(kernel[p], near, strict=True))
    assert min(corr.values()) < 0 < max(corr.values()) and (a < 0).any()
    full = 0.2 * sum(map(abs, corr.values())) / len(corr)

    def raw(image):
        total = 0.0
        for p in points:
            near = window(image, *p)
            mean = sum(near) / 25
            c = abs(corr[p, int(min(255, max(0, mean))) >> 3])
            size_ = sum(k * (v - mean) for k, v in zip(kernel[p], near, strict=True)) * (1 / c if c > 0 else 0)
            total += max(-1, min(1, size_)) * min(1, c / full)
        return total

    for plane in rng.integers(0, 256, (5, size * size)).astype(float):
        corr0, corr1 = model.scores(plane[None])
        assert corr0[0] == pytest.approx(raw(plane) / raw(shown(16))) and corr1[0] == pytest.approx(raw(a * plane + b * 255) / raw(shown(16)))


def test_second_stream_comes_in_cells_and_is_never_broadcast(spark, monkeypatch):
    from framewise import adapters as ad
    from framewise.registry import QUERIES

    from .conftest import DATA

    whole = [(r["decode_idx"], r["duration"]) for r in ad.audio(spark, DATA).collect()]
    monkeypatch.setattr(ad, "CELL", 100)
    tone = ad.audio(spark, DATA)
    assert sorted((r["decode_idx"], r["duration"]) for r in tone.collect()) == sorted(whole) == [(i, 960 if i else 3852) for i in range(len(whole))]
    for name in ("a13_av_segments", "w5_audio_segments"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftOuter" in x]


def test_votes_add_up_blocks_of_frames_in_one_order(spark, monkeypatch):
    from framewise.operators import signal

    monkeypatch.setattr(signal, "CHUNK", 64)
    raw = [((i * 7919) % 161 - 60) / 100 for i in range(300)]
    got = {r["display_idx"]: r["mean"] for r in signal.judged(spark.createDataFrame([("m", i, v) for i, v in enumerate(raw)], "media_id string, display_idx long, raw double"), 30.0).collect()}

    def added(xs, start=0.0):
        for x in xs:
            start += x
        return start

    plain = 0
    for i in range(300):
        xs = [raw[min(max(k, 0), 299)] for k in range(i - 15, i + 16)]
        left = -(i - 15 + 38) % 16
        want = added(xs[left + 16 :], added(xs[:left]) + added(xs[left : left + 16])) / 31
        assert got[i] == want
        plain += added(xs) / 31 == want
    assert plain < 300
