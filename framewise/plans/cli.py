"""Command line: analyze, cut, prepare, remap-subs, make-logo, auto. Exit codes: 0 done or skipped, 1 error, 2 usage, 3 stopped by the verdict."""

from __future__ import annotations

import argparse
import signal as signals
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..operators.errors import CheckFailed, MediaError, raise_first
from ..sources import isobmff as bmff
from ..sources.texts import load_segment_map
from . import analyze as an
from . import runtime as rt
from .cut import cut
from .subtitles import remap_ass, remap_srt


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framewise")
    subs = top.add_subparsers(dest="command", required=True)

    def sub(name: str, *inputs: str) -> argparse.ArgumentParser:
        p = subs.add_parser(name)
        for i in inputs or ("input",):
            p.add_argument(i, type=Path, nargs="+" if i == "inputs" else None)
        p.add_argument("--cache-dir", type=Path)
        return p

    for name in ("analyze", "auto"):
        p = sub(name, "inputs") if name == "auto" else sub(name)
        p.add_argument("--jl-file", type=Path, required=True)
        p.add_argument("--jls-set", type=rt.parse_variable, action="append", default=[])
        p.add_argument("--logo", type=Path)
        p.add_argument("--report", action="store_true")
        if name == "auto":
            p.add_argument("--force", action="store_true")
            p.add_argument("--analyze-only", action="store_true")
            p.add_argument("--ignore-verdict", action="store_true")
            p.add_argument("--no-subtitles", action="store_true")
            p.add_argument("--cm-output", action="store_true")
            p.add_argument("--verify", action="store_true")
    p = sub("cut")
    p.add_argument("--trim", default="-")
    p.add_argument("--dtvi", type=Path)
    p.add_argument("-o", "--output", type=Path)
    p.add_argument("--cm-output", type=Path)
    p.add_argument("--snap", choices=("outward", "inward"), default="outward")
    p.add_argument("--video-only", action="store_true")
    p.add_argument("--verify", action="store_true")
    sub("prepare").add_argument("--subs", type=Path)
    p = sub("remap-subs")
    p.add_argument("--subs", type=Path)
    p.add_argument("--map", type=Path)
    p.add_argument("-o", "--output", type=Path)
    p = sub("make-logo")
    p.add_argument("--rect", type=rt.parse_rect, required=True)
    p.add_argument("--threshold", type=int, default=12)
    p.add_argument("--name")
    p.add_argument("-o", "--output", type=Path, required=True)
    return top


def prepare(source: Path, cache: rt.Cache, subs: Path | None = None, runner: rt.Runner = rt.run, tool=rt.find_tool) -> tuple[Path, Path | None]:
    """An input without edit list and subtitle track, and its subtitles; the input itself where nothing is to be done."""
    with source.open("rb") as f:
        found = bmff.tracks(bmff.read_moov(f)[0])
    kinds = [t.kind for t in found]
    if kinds.count("video") >= 2 or kinds.count("audio") >= 2:
        raise CheckFailed("several_tracks", f"{kinds.count('video')} video, {kinds.count('audio')} audio")
    text = next((t for t in found if t.kind == "other"), None)
    cache.make()
    sidecar = subs
    if text and not subs:
        kind = "srt" if text.codec in ("tx3g", "wvtt") else "ass"
        sidecar = getattr(cache, kind)
        runner([tool("ffmpeg"), "-v", "error", "-y", "-i", source.absolute(), "-map", "0:s:0", "-c:s", "subrip" if kind == "srt" else "ass", sidecar], cache.folder)
    if not text and not any(t.has_edit_list for t in found):
        return source, sidecar
    sound = ["-map", "0:a:0"] if "audio" in kinds else []
    with rt.published(cache.prepared) as (temp,):
        runner([tool("ffmpeg"), "-v", "error", "-y", "-i", source.absolute(), "-map", "0:v:0", *sound, "-c", "copy", "-use_editlist", "0", "-f", "mp4", temp], cache.folder)
    return cache.prepared, sidecar


def remap(spark: SparkSession, subs: Path, map_path: Path, output: Path) -> dict:
    m = load_segment_map(map_path.read_text())
    media = str(subs)
    segments = spark.createDataFrame([(media, i, s["source_start_dts"], s["duration"], s["output_start"]) for i, s in enumerate(m["segments"])], "media_id string, range_id long, source_start_dts long, duration long, output_start long")
    files = spark.createDataFrame([(media, subs.read_bytes().decode("utf-8"))], "media_id string, text string")
    kind = {".ass": remap_ass, ".ssa": remap_ass, ".srt": remap_srt}.get(subs.suffix.lower())
    if not kind:
        raise CheckFailed("subtitle_format", subs.suffix)
    text, found, faults = kind(files, segments, m["video_timescale"])
    raise_first(faults.filter("severity = 'error'"))
    with rt.published(output) as (temp,):
        row = text.first()
        temp.write_bytes((row["text"] if row else "").encode("utf-8"))
    return {r["fate"]: r["n"] for r in found.groupBy("fate").agg(F.count(F.lit(1)).alias("n")).collect()}


def verdict_of(a: an.Analysis) -> dict:
    return report.verdict(a.ranges, a.entries, a.totals).first().asDict()


def auto(spark: SparkSession, args, source: Path, runner: rt.Runner = rt.run, tool=rt.find_tool) -> int:
    """Everything for one input: existing outputs are kept unless forced; a missing subtitle file beside an existing cut is made up for."""
    output = rt.cut_name(source, source.suffix)
    removed = output.with_name(output.stem + "_cm" + source.suffix) if args.cm_output else None
    cache = rt.Cache.of(source, args.cache_dir)
    outputs = [p for p in (output, removed) if p]
    with source.open("rb") as f:
        has_text = any(t.kind == "other" for t in bmff.tracks(bmff.read_moov(f)[0]))
    done = all(p.exists() for p in outputs)
    lacks = done and has_text and not args.no_subtitles and not any(output.with_suffix(s).exists() for s in (".ass", ".srt"))
    if any(p.exists() for p in outputs) and not args.force and not args.analyze_only and not lacks:
        print(f"{output} exists; skipped")
        return rt.OK
    work, subs = prepare(source, cache, None, runner, tool)
    a = an.analyze(spark, work, cache, args.jl_file, args.logo, args.jls_set, runner, tool)
    v = verdict_of(a)
    if args.analyze_only:
        return rt.STOPPED if v["stop"] and not args.ignore_verdict else rt.OK
    if v["stop"] and not args.ignore_verdict:
        return rt.STOPPED
    cache.clear("segment_map")
    cut(spark, work, cache.trim.read_text(), cache.index.read_text(), output, removed, verify_bytes=args.verify, map_path=cache.segment_map)
    if subs and not args.no_subtitles:
        remap(spark, subs, cache.segment_map, output.with_suffix(subs.suffix))
    return rt.OK


def main(argv: list[str] | None = None) -> int:
    if hasattr(signals, "SIGPIPE"):
        signals.signal(signals.SIGPIPE, signals.SIG_DFL)
    args = parser().parse_args(argv)
    try:
        if args.command == "auto":
            return max(auto(session(), args, i) for i in args.inputs)
        cache = rt.Cache.of(args.input, args.cache_dir)
        if args.command == "analyze":
            a = an.analyze(session(), args.input, cache, args.jl_file, args.logo, args.jls_set)
            if args.report:
                num, den = (int(a.header.get(f"time_base_{k}", 1)) for k in ("num", "den"))
                sys.stderr.write(an.boundary_report(a, num, den) + "\n".join(an.warnings(a, 30000 / 1001)) + "\n" + an.verdict_report(a))
        elif args.command == "cut":
            trim = sys.stdin.read() if args.trim == "-" else Path(args.trim).read_text()
            index = rt.resolve(args.dtvi, cache.index, "index").read_text()
            cache.make()
            cut(session(), args.input, trim, index, args.output or rt.cut_name(args.input, args.input.suffix), args.cm_output, args.snap, args.video_only, args.verify, cache.segment_map)
        elif args.command == "prepare":
            print(prepare(args.input, cache, args.subs)[0])
        elif args.command == "remap-subs":
            subs = args.subs or cache.subtitles()
            remap(session(), subs, rt.resolve(args.map, cache.segment_map, "segment_map"), args.output or rt.cut_name(args.input, subs.suffix))
        else:
            from ..sources import models

            rect, note = rt.even_rect(args.rect)
            if note:
                print(note, file=sys.stderr)
            with args.input.open("rb") as f:
                moov, _, length = bmff.read_moov(f)
            video = bmff.first_track(bmff.tracks(moov), "video")
            planes: list = []
            command = models.frame_command(str(rt.find_tool("ffmpeg")), str(args.input), rect)
            models.stream_luma(command, rect[2] * rect[3], len(bmff.samples(video, length)), lambda d: planes.append(list(d)))
            luma = session().createDataFrame([(str(args.input), i, p) for i, p in enumerate(planes)], "media_id string, display_idx long, plane array<int>")
            used, total = an.make_logo(session(), luma, rect, (video.width, video.height), args.threshold, args.name or args.input.stem, args.output)
            print(f"{used} of {total} frames used", file=sys.stderr)
    except (MediaError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return rt.ERROR
    return rt.OK


if __name__ == "__main__":
    sys.exit(main())
