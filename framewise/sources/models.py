"""Logo model files and raw luma frames."""

from __future__ import annotations

import struct
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.errors import CheckFailed, ParseError

#: Layout of a model file (fixed by the format).
BASE_TITLE, BASE_HEADER, PIXEL, HEADER, MAGIC, SERVICE_AT, NAME_BYTES = 28, 48, 12, 540, 0x12345, 296, 255
TITLE = b"<logo data file ver0.1>"


@dataclass
class LogoModel:
    w: int
    h: int
    img_w: int
    img_h: int
    x: int
    y: int
    name: str
    service_id: int
    planes: dict[str, np.ndarray]
    log_uv: tuple[int, int] = (1, 1)
    version: int = 1


def parse_lgd(data: bytes) -> LogoModel:
    at = BASE_TITLE + 4
    if len(data) < at + BASE_HEADER:
        raise ParseError("base_header")
    if struct.unpack_from(">I", data, BASE_TITLE)[0] < 1:
        raise ParseError("no_logo")
    _, _, h, w = struct.unpack_from("<4h", data, at + 32)
    if w <= 0 or h <= 0:
        raise ParseError("base_size", f"{w}x{h}")
    at += BASE_HEADER + w * h * PIXEL
    if len(data) < at + HEADER:
        raise ParseError("header")
    magic, version, w, h, lu, lv, img_w, img_h, x, y = struct.unpack_from("<10i", data, at)
    if magic != MAGIC:
        raise ParseError("magic", hex(magic))
    if w <= 0 or h <= 0 or not (0 <= lu < 8 and 0 <= lv < 8):
        raise ParseError("size", f"{w}x{h}")
    name = data[at + 40 : at + 40 + NAME_BYTES].split(b"\0")[0].decode("utf-8", "replace")
    service = struct.unpack_from("<i", data, at + SERVICE_AT)[0]
    at += HEADER
    planes, uv = {}, (w >> lu) * (h >> lv)
    for key, n in (("aY", w * h), ("bY", w * h), ("aU", uv), ("bU", uv), ("aV", uv), ("bV", uv)):
        if len(data) < at + 4 * n:
            raise ParseError("planes", key)
        planes[key] = np.frombuffer(data, "<f4", n, at).copy()
        at += 4 * n
    return LogoModel(w, h, img_w, img_h, x, y, name, service, planes, (lu, lv), version)


def truncated(name: str, most: int = NAME_BYTES) -> bytes:
    """At most that many bytes, never half a character."""
    return name.encode("utf-8")[:most].decode("utf-8", "ignore").encode("utf-8")


def build_lgd(m: LogoModel) -> bytes:
    if not (0 < m.w < 1 << 15 and 0 < m.h < 1 << 15):
        raise CheckFailed("size", f"{m.w}x{m.h}")
    base = TITLE.ljust(BASE_TITLE, b"\0") + struct.pack(">I", 1) + bytes(32) + struct.pack("<8h", 0, 0, m.h, m.w, 0, 0, 0, 0) + bytes(m.w * m.h * PIXEL)
    head = struct.pack("<10i", MAGIC, m.version, m.w, m.h, *m.log_uv, m.img_w, m.img_h, m.x, m.y) + truncated(m.name).ljust(NAME_BYTES + 1, b"\0")
    head += struct.pack("<i", m.service_id)
    return base + head.ljust(HEADER, b"\0") + b"".join(m.planes[k].astype("<f4").tobytes() for k in ("aY", "bY", "aU", "bU", "aV", "bV"))


def learned_model(a: np.ndarray, b: np.ndarray, w: int, h: int, img: tuple[int, int], at: tuple[int, int], name: str, service_id: int = 0) -> LogoModel:
    """A model of brightness only: colour planes change nothing."""
    uv = (w >> 1) * (h >> 1)
    one, none = np.ones(uv, np.float32), np.zeros(uv, np.float32)
    return LogoModel(w, h, *img, *at, name, service_id, {"aY": a, "bY": b, "aU": one, "bU": none, "aV": one, "bV": none})


def models(spark: SparkSession, path: str) -> DataFrame:
    """``media_id, w, h, name, service_id, a_y, b_y, error`` of model files."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    m = parse_lgd(bytes(content))
                    rows.append((path, m.w, m.h, m.name, m.service_id, m.planes["aY"].tolist(), m.planes["bY"].tolist(), None))
                except ParseError as e:
                    rows.append((path, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["media_id", "w", "h", "name", "service_id", "a_y", "b_y", "error"])

    schema = "media_id string, w int, h int, name string, service_id int, a_y array<float>, b_y array<float>, error string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parsed, schema)


def read_frames(reader: BinaryIO, frame_bytes: int, expected: int, on_frame: Callable[[bytes], None]) -> int:
    """Frames of fixed size from a stream, one in memory at a time; a partial one or another number than expected is an error."""
    n = 0
    while True:
        parts, missing = [], frame_bytes
        while missing:
            got = reader.read(missing)
            if not got:
                break
            parts.append(got)
            missing -= len(got)
        if missing == frame_bytes:
            break
        if missing:
            raise CheckFailed("partial_frame", str(n))
        on_frame(b"".join(parts))
        n += 1
    if n != expected:
        raise CheckFailed("frame_count", f"{n} of {expected}")
    return n


def frame_command(ffmpeg: str, source: str, rect: tuple[int, int, int, int]) -> list[str]:
    x, y, w, h = rect
    return [ffmpeg, "-v", "error", "-nostdin", "-i", source, "-map", "0:v:0", "-vf", f"crop={w}:{h}:{x}:{y}", "-fps_mode", "passthrough", "-pix_fmt", "gray", "-f", "rawvideo", "-"]


def stream_luma(command: list[str], frame_bytes: int, expected: int, on_frame: Callable[[bytes], None]) -> int:
    """Frames that a decoder writes to its standard output; it is stopped when a frame can't be used."""
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        try:
            n = read_frames(p.stdout, frame_bytes, expected, on_frame)
        except BaseException:
            p.kill()
            raise
        error = p.stderr.read()
        if p.wait():
            raise CheckFailed("decoder", error.decode("utf-8", "replace")[-2000:])
    return n


def luma_files(spark: SparkSession, path: str, frame_bytes: int) -> DataFrame:
    """``media_id, display_idx, plane`` of raw files, cut into frames by Spark; a file that isn't a whole number of frames is an error."""
    rows = spark.read.format("binaryFile").load(path)
    whole = F.when(F.col("length") % frame_bytes == 0, F.expr(f"length div {frame_bytes}")).otherwise(F.raise_error(F.concat(F.lit("partial frame in "), "path")).cast("long"))
    rows = rows.select(F.col("path").alias("media_id"), "content", whole.alias("n")).filter("n > 0")
    at = F.explode(F.expr("sequence(0L, n - 1)")).alias("display_idx")
    return rows.select("media_id", "content", at).select("media_id", "display_idx", F.expr(f"substring(content, cast(display_idx * {frame_bytes} + 1 as int), {frame_bytes})").alias("plane"))
