import pytest
from pyspark.sql import functions as F

from framewise.functions import text as tx
from framewise.plans import runtime as rt
from framewise.plans.subtitles import remap_ass, remap_srt
from framewise.sources import texts


def files(spark, *bodies):
    return spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "media_id string, text string")


def one(spark, column, **values):
    row = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(column(**row).alias("x")).first()["x"]


def test_trim_text(spark):
    rows, faults = texts.parse_trim(files(spark, "Trim(66,34201) ++ Trim(37798,53591) ++ Trim(57189,70974)\n"))
    assert [(r["start"], r["end"]) for r in rows.orderBy("range_id").collect()] == [(66, 34202), (37798, 53592), (57189, 70975)] and not faults.collect()
    assert texts.format_trim(rows).first()["text"] == "Trim(66,34201) ++ Trim(37798,53591) ++ Trim(57189,70974)"
    assert not texts.parse_trim(files(spark, "Trim(0,9)++Trim(10,19)"))[1].collect()


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("", "empty"), ("Cut(1,2)", "malformed"), ("Trim(1)", "malformed"), ("Trim(a,2)", "invalid_number"), ("Trim(0,4294967295)", "overflow"), ("Trim(5,4)", "empty_range"),
        ("Trim(0,9) ++ Trim(9,20)", "not_ascending_or_overlapping"), ("Trim(-1,2)", "invalid_number"),
    ],
)
def test_trim_faults(spark, body, code):
    assert [r["code"] for r in texts.parse_trim(files(spark, body))[1].collect()] == [code]


def test_structure(spark):
    body = "header\n   0    73    2   14    0 :Nologo\n\n  74  6127   15    0   15 :L\r\n6128  6577   15    -3    0 :CM\n"
    rows, faults = texts.parse_jls(files(spark, body))
    got = rows.orderBy("entry_id").collect()
    assert [(r["start"], r["end"], r["error_frames"], r["label"]) for r in got] == [(0, 73, 14, ":Nologo"), (74, 6127, 0, ":L"), (6128, 6577, -3, ":CM")] and not faults.collect()
    assert [r["code"] for r in texts.parse_jls(files(spark, "h\n1 2 3\n"))[1].collect()] == ["columns"]
    assert [r["code"] for r in texts.parse_jls(files(spark, "h\n-1 2 3 4 5 x\n"))[1].collect()] == ["number"]


INDEX = "DTVINDEX\t1\nframe_count\t599\nodd\tkept\n\nFRAMES\n0\t0\t0\t48\t0\t-2002\t1001\t29\n1\t2\t0\t14016\t1001\t0\t1001\t28\n\n2\t1\t0\t17366\t2002\t1001\t1001\t28\nEND\nrest\n"


def test_frame_index(spark):
    head, frames, faults = texts.parse_index(files(spark, INDEX))
    assert head.first()["header"] == {"frame_count": "599", "odd": "kept"} and head.first()["format_version"] == "1" and not faults.collect()
    assert [(r["sample_number"], r["dts"], r["flags"]) for r in frames.orderBy("frame_number").collect()] == [(0, -2002, 29), (2, 0, 28), (1, 1001, 28)]
    for bad, code in ((INDEX.replace("DTVINDEX", "X"), "magic"), (INDEX.replace("FRAMES", "F"), "no_frames"), (INDEX.replace("\n1\t2", "\n3\t2"), "frame_number"), (INDEX.replace("1\t2\t0", "1\t0\t0"), "not_a_permutation"), (INDEX.replace("\t28\nEND", "\nEND"), "columns")):
        assert code in {r["code"] for r in texts.parse_index(files(spark, bad))[2].collect()}, code


def test_segment_map(spark):
    seg = dict(zip(texts.SEGMENT_FIELDS, range(6), strict=True))
    body = texts.segment_map_json(30000, 30000, 1001, "a.mp4", 599, [seg])
    assert body.startswith('{\n  "video_timescale": 30000,\n') and body.endswith("}\n") and texts.load_segment_map(body)["segments"] == [seg]
    rows, faults = texts.parse_segment_map(files(spark, body, body.replace('"input"', '"in"'), "{"))
    assert [r["segments"][0]["duration"] for r in rows.collect()] == [5] and faults.count() == 2
    with pytest.raises(Exception, match="segment_map"):
        texts.load_segment_map(body.replace("599", '"599"'))


def test_lines_keep_their_terminators(spark):
    got = texts.split_lines(files(spark, "﻿a\r\nb\n\nc")).orderBy("line").collect()
    assert [(r["text"], r["terminator"]) for r in got] == [("a", "\r\n"), ("b", "\n"), ("", "\n"), ("c", "")] and all(r["bom"] for r in got)


@pytest.mark.parametrize(("body", "value"), [("1:02:03.45", 372345), ("0:00:00.5", 5), ("0:60:00.00", None), ("0:00:00.100", None), ("x", None)])
def test_ass_times(spark, body, value):
    assert one(spark, lambda t: tx.parse_ass_time(t), t=body) == value


def test_more_times_and_names(spark):
    assert one(spark, lambda t: tx.parse_srt_time(t), t="01:02:03,456") == 3723456 and one(spark, lambda t: tx.format_srt_time(t), t=3723456) == "01:02:03,456"
    assert one(spark, lambda t: tx.format_ass_time(t), t=372345) == "1:02:03.45" and one(spark, lambda t: tx.format_mm_ss(t), t=-3.0) == "00:00"
    assert one(spark, lambda t: tx.sanitised(t), t="a b/c\td") == "a_b_c_d"
    for s in ("", "a", "foobar", "/home/ü"):
        assert one(spark, lambda t: tx.fnv1a(t), t=s) == rt.name_hash(s.encode())
    assert rt.name_hash(b"foobar") == "85944171f73967e8"


SEGMENTS = [(0, 4000, 0), (5000, 4000, 4000)]


def segments(spark, rows=SEGMENTS):
    return spark.createDataFrame([("0", i, *s) for i, s in enumerate(rows)], "media_id string, range_id long, source_start_dts long, duration long, output_start long")


ASS = "﻿[Script Info]\r\nTitle: x\r\n\r\n[Events]\r\nFormat: Layer, Start, End, Style, Text\r\nDialogue: 0,0:00:06.00,0:00:07.00,D,a, b\r\nComment: 0,0:00:04.10,0:00:04.90,D,gone\r\nDialogue: 0,0:00:03.00,0:00:06.00,D,{\\fad(1,2)}c\r\n"
SRT = "1\n00:00:06,000 --> 00:00:07,000 X1:1\na\n\n2\n00:00:04,100 --> 00:00:04,900\ngone\n\n\n3\n00:00:03,000 --> 00:00:06,000\nc\n"


def test_ass_file(spark):
    text, found, faults = remap_ass(files(spark, ASS), segments(spark), 1000)
    want = ASS.replace("0:00:06.00,0:00:07.00", "0:00:05.00,0:00:06.00").replace("Comment: 0,0:00:04.10,0:00:04.90,D,gone\r\n", "").replace("0:00:03.00,0:00:06.00", "0:00:03.00,0:00:04.00")
    assert text.first()["text"] == want and sorted(r["fate"] for r in found.collect()) == ["Clipped", "Discarded", "Shifted"] and not faults.collect()
    assert remap_ass(files(spark, ASS), segments(spark, [(0, 9000, 0)]), 1000)[0].first()["text"] == ASS
    assert [r["code"] for r in remap_ass(files(spark, ASS.replace("0:00:06.00,0:00:07", "0:00:xx,0:00:07")), segments(spark), 1000)[2].collect()] == ["time"]


def test_srt_file(spark):
    text, found, faults = remap_srt(files(spark, SRT), segments(spark), 1000)
    assert text.first()["text"] == "1\n00:00:05,000 --> 00:00:06,000 X1:1\na\n\n\n\n3\n00:00:03,000 --> 00:00:04,000\nc\n"
    assert sorted(r["fate"] for r in found.collect()) == ["Clipped", "Discarded", "Shifted"] and not faults.collect()
    assert remap_srt(files(spark, SRT), segments(spark, [(0, 9000, 0)]), 1000)[0].first()["text"] == SRT


def test_runtime(tmp_path):
    assert rt.variables((("a", "1"), ("b", "2")), [("b", "3"), ("c", "4")]) == ["-set", "a", "1", "-set", "b", "3", "-set", "c", "4"]
    assert rt.parse_variable("a=b=c") == ("a", "b=c") and rt.parse_rect("1,2,3,4") == (1, 2, 3, 4) and rt.even_rect((1, 2, 3, 4))[0] == (0, 2, 2, 4)
    assert rt.index_enabled("x dtvindex=disabled y") is False and rt.index_enabled("") is None and rt.index_enabled("dtvindex=enabled") is True
    with pytest.raises(rt.ToolFailed, match="ended with 3"):
        rt.run(["sh", "-c", "echo bad >&2; exit 3"], tmp_path)
    with rt.streaming(["printf", "abc"], tmp_path) as out:
        assert out.read() == b"abc"
    out = tmp_path / "o"
    with pytest.raises(ValueError), rt.published(out) as (t,):
        t.write_text("x")
        raise ValueError
    assert not list(tmp_path.iterdir())
    source = tmp_path / "a b.mp4"
    source.write_bytes(b"1")
    first = rt.Cache.of(source, tmp_path / "c").folder
    source.write_bytes(b"22")
    assert rt.Cache.of(source, tmp_path / "c").folder != first and first.name.endswith("-a_b")


def test_index_arithmetic(spark):
    from framewise.functions.indices import DecodeIdx, DisplayIdx

    a, b = DisplayIdx(F.col("a")), DisplayIdx(F.col("b"))
    with pytest.raises(TypeError):
        a - DecodeIdx(F.col("b"))
    with pytest.raises(TypeError):
        a + b
    rows = spark.createDataFrame([(7, 3), (4294967295, 0)], "a long, b long")
    got = rows.select((a - b).alias("n"), a.checked_add(1).alias("c")).collect()
    assert [tuple(r) for r in got] == [(4, 8), (4294967295, None)]
    for bad in (b - a, (a + 1).column):
        with pytest.raises(Exception, match="index"):
            rows.select(bad).collect()


def test_split_time_with_long_hours(spark):
    from pyspark.sql import functions as F

    from framewise.functions.text import split_time

    texts = ["00:00:01,000 X1:1", "100:00:05,659 X1:5", "12345:00:05,659", "short", "99:59:59,9999"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *split_time(F.col("t"))).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [("00:00:01,000", " X1:1"), ("100:00:05,659", " X1:5"), ("12345:00:05,659", ""), ("short", ""), ("99:59:59,999", "9")]


def test_srt_in_pieces(spark, monkeypatch):
    from framewise.plans import subtitles
    from framewise.sources import texts

    blocks = [f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},500\nl\n\n" for i in range(40)]
    whole = spark.createDataFrame([("m", "﻿" + "".join(blocks) + "end")], "media_id string, text string")
    parts = ["﻿" + blocks[0] + "1\n", "00:00:01,000 --> 00:00:01,500\nl\n\n", *blocks[2:39], blocks[39] + "end"]
    pieces = spark.createDataFrame([("m", k, t) for k, t in enumerate(parts)], "media_id string, piece long, text string")
    monkeypatch.setattr(texts, "CHUNK", 7)
    monkeypatch.setattr(subtitles, "STRETCH", 5)
    lines = [sorted(map(tuple, texts.srt_blocks(texts.split_lines(f)).select("line", "bom", "text", "terminator", "block").collect())) for f in (whole, pieces)]
    assert [x[:1] + x[2:] for x in lines[0]] == [x[:1] + x[2:] for x in lines[1]]
    assert [x[4] for x in lines[0]] == [i // 4 for i in range(161)]
    segs = spark.createDataFrame([("m", 0, 0, 30000 * 60, 0)], "media_id string, range_id long, source_start_dts long, duration long, output_start long")
    out = [subtitles.remap_srt(f, segs, 30000)[0].collect()[0]["text"] for f in (whole, pieces)]
    assert out[0] == out[1] == "﻿" + "".join(blocks) + "end"
