"""ISO base media files: reading sample tables as packets, and writing cuts of them.

``PacketSource`` is a Python data source, one partition a file, that skips payloads by seeking. Tables are validated before anything as large as
they claim is made. The writer lays out ``ftyp``, ``mdat`` and ``moov`` and copies sample descriptions untouched.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.errors import CheckFailed, ParseError
from ..operators.tracks import AUDIO_CODECS, VIDEO_CODECS

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf"}
LIMIT32 = (1 << 32) - 1
PACKET_SCHEMA = "media_id string, track_id int, kind string, codec string, timescale long, decode_idx long, file_offset long, size long, duration long, cts_offset long, is_sync boolean"
TRACK_SCHEMA = "media_id string, track_id int, kind string, codec string, timescale long, has_edit_list boolean, stsd_entries int, width int, height int"


@dataclass
class Box:
    kind: bytes
    body: bytes = b""
    children: list[Box] = field(default_factory=list)

    def find(self, *path: bytes) -> Box | None:
        for kind in path:
            self = next((c for c in self.children if c.kind == kind), None)
            if self is None:
                return None
        return self

    def all(self, kind: bytes) -> list[Box]:
        return [c for c in self.children if c.kind == kind]

    def bytes(self) -> bytes:
        body = b"".join(c.bytes() for c in self.children) if self.kind in CONTAINERS else self.body
        return struct.pack(">I4s", len(body) + 8, self.kind) + body


def _header(f: BinaryIO, end: int) -> tuple[bytes, int, int] | None:
    """Kind, start of the body and end of the next box."""
    at = f.tell()
    if at >= end:
        return None
    head = f.read(8)
    if len(head) < 8:
        raise ParseError("truncated_box", str(at))
    size, kind = struct.unpack(">I4s", head)
    if size == 1:
        wide = f.read(8)
        if len(wide) < 8:
            raise ParseError("truncated_box", str(at))
        size = struct.unpack(">Q", wide)[0]
    elif size == 0:
        size = end - at
        if kind != b"mdat":
            return kind, f.tell(), end
        raise ParseError("open_box_before_moov", kind.decode("latin-1"))
    if size < f.tell() - at or at + size > end:
        raise ParseError("box_size", f"{kind.decode('latin-1')} {size}")
    return kind, f.tell(), at + size


def _parse(kind: bytes, body: bytes) -> Box:
    if kind not in CONTAINERS:
        return Box(kind, body)
    box, f = Box(kind), io.BytesIO(body)
    while (h := _header(f, len(body))) is not None:
        box.children.append(_parse(h[0], body[h[1] : h[2]]))
        f.seek(h[2])
    return box


def read_moov(f: BinaryIO) -> tuple[Box, bytes, int]:
    """The movie box, the file type box (whole) and the file's length; payloads are skipped."""
    length = f.seek(0, 2)
    f.seek(0)
    ftyp = b""
    while (h := _header(f, length)) is not None:
        kind, start, end = h
        if kind == b"ftyp":
            ftyp = struct.pack(">I4s", end - start + 8, kind) + f.read(end - start)
        if kind == b"moov":
            return _parse(kind, f.read(end - start)), ftyp, length
        f.seek(end)
    raise ParseError("no_moov")


@dataclass
class Track:
    track_id: int
    codec: str
    timescale: int
    has_edit_list: bool
    stsd_entries: int
    width: int
    height: int
    box: Box

    @property
    def kind(self) -> str:
        return "video" if self.codec in VIDEO_CODECS else "audio" if self.codec in AUDIO_CODECS else "other"


def tracks(moov: Box) -> list[Track]:
    out = []
    for trak in moov.all(b"trak"):
        tkhd, mdhd, stsd = trak.find(b"tkhd"), trak.find(b"mdia", b"mdhd"), trak.find(b"mdia", b"minf", b"stbl", b"stsd")
        if tkhd is None or mdhd is None or stsd is None:
            raise ParseError("incomplete_track")
        track_id = struct.unpack_from(">I", tkhd.body, 20 if tkhd.body[0] else 12)[0]
        timescale = struct.unpack_from(">I", mdhd.body, 20 if mdhd.body[0] else 12)[0]
        entries = struct.unpack_from(">I", stsd.body, 4)[0]
        codec = stsd.body[12:16].decode("latin-1") if entries else ""
        w, h = (struct.unpack_from(">HH", stsd.body, 8 + 32) if codec in VIDEO_CODECS and len(stsd.body) >= 44 else (0, 0))
        out.append(Track(track_id, codec, timescale, trak.find(b"edts", b"elst") is not None, entries, w, h, trak))
    return out


def first_track(found: list[Track], kind: str) -> Track | None:
    return next((t for t in found if t.kind == kind), None)


def _table(stbl: Box, kind: bytes, form: str) -> list[tuple] | None:
    box = stbl.find(kind)
    if box is None:
        return None
    n, width = struct.unpack_from(">I", box.body, 4)[0], struct.calcsize(form)
    if 8 + n * width > len(box.body):
        raise ParseError("table_size", kind.decode())
    return list(struct.iter_unpack(form, box.body[8 : 8 + n * width]))


def _runs(runs: list[tuple[int, int]], total: int, name: str) -> list[int]:
    if sum(n for n, _ in runs) != total:
        raise ParseError("run_total", name)
    return [v for n, v in runs for _ in range(n)]


def samples(track: Track, file_length: int) -> list[tuple[int, int, int, int, bool]]:
    """(offset, size, duration, cts offset, sync) of every packet in decode order; without a sync table all are sync."""
    stbl = track.box.find(b"mdia", b"minf", b"stbl")
    stsz = stbl.find(b"stsz")
    if stsz is None:
        raise ParseError("no_sizes")
    same, n = struct.unpack_from(">II", stsz.body, 4)
    if same:
        if same * n > file_length:
            raise ParseError("sizes_exceed_file", f"{n} x {same}")
        sizes = [same] * n
    else:
        if 12 + 4 * n > len(stsz.body):
            raise ParseError("table_size", "stsz")
        sizes = list(struct.unpack_from(f">{n}I", stsz.body, 12))
        if n > file_length or sum(sizes) > file_length:
            raise ParseError("sizes_exceed_file", str(n))
    chunks = _table(stbl, b"stco", ">I") if stbl.find(b"stco") else _table(stbl, b"co64", ">Q")
    offsets = [c[0] for c in chunks or []]
    entries, before = _table(stbl, b"stsc", ">III") or [], 0
    for k, (first, per, _) in enumerate(entries):
        if first < 1 or (k == 0 and first != 1) or first <= before or first > len(offsets) or per == 0:
            raise ParseError("chunk_runs", f"{k}: {first} {per}")
        before = first
    places: list[int] = []
    for (first, per, _), after in zip(entries, [e[0] for e in entries[1:]] + [len(offsets) + 1], strict=True):
        for chunk in range(first, after):
            at = offsets[chunk - 1]
            for _ in range(per):
                if len(places) == n:
                    raise ParseError("chunk_total", "more than sizes")
                places.append(at)
                at += sizes[len(places) - 1]
                if at > file_length:
                    raise ParseError("offset_beyond_file", str(at))
    if len(places) != n:
        raise ParseError("chunk_total", f"{len(places)} of {n}")
    durations = _runs(_table(stbl, b"stts", ">II") or [], n, "stts")
    ctts = stbl.find(b"ctts")
    shifts = _runs(_table(stbl, b"ctts", ">Ii") or [], n, "ctts") if ctts else [0] * n
    stss = _table(stbl, b"stss", ">I")
    sync = None if stss is None else {s[0] - 1 for s in stss}
    return [(places[i], sizes[i], durations[i], shifts[i], sync is None or i in sync) for i in range(n)]


def read_byte_range(path: str, offset: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(size)
    if len(data) != size:
        raise CheckFailed("short_read", f"{path} {offset} {size}")
    return data


# -- data sources --------------------------------------------------------------------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    """One partition a file: tables of one file are small beside its payload, files are the unit of parallelism."""

    def __init__(self, options: dict, packets: bool):
        self.paths, self.packets = [p for p in options.get("paths", options.get("path", "")).split("\n") if p], packets

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path.removeprefix("file://"), "rb") as f:
            moov, _, length = read_moov(f)
        for t in tracks(moov):
            if self.packets:
                for i, (offset, size, duration, shift, sync) in enumerate(samples(t, length)):
                    yield partition.path, t.track_id, t.kind, t.codec, t.timescale, i, offset, size, duration, shift, sync
            else:
                yield partition.path, t.track_id, t.kind, t.codec, t.timescale, t.has_edit_list, t.stsd_entries, t.width, t.height


class PacketSource(DataSource):
    """``spark.read.format("isobmff_packets").option("paths", "a\\nb")``"""

    @classmethod
    def name(cls) -> str:
        return "isobmff_packets"

    def schema(self) -> str:
        return PACKET_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, True)


class TrackSource(DataSource):
    """``spark.read.format("isobmff_tracks")``: one row a track."""

    @classmethod
    def name(cls) -> str:
        return "isobmff_tracks"

    def schema(self) -> str:
        return TRACK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, False)


# -- writing -------------------------------------------------------------------------------------------------------------------------------


def run_lengths(values: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1] = (out[-1][0] + 1, v)
        else:
            out.append((1, v))
    return out


def chunked(kept: list[tuple], timescale: int) -> list[list[tuple]]:
    """A chunk ends with the packet that fills a second; without a timescale there is one."""
    out: list[list[tuple]] = []
    held, total = [], 0
    for packet in kept:
        held.append(packet)
        total += packet[2]
        if timescale and total >= timescale:
            out.append(held)
            held, total = [], 0
    return out + [held] if held else out


def plan_mdat(ftyp_length: int, body_length: int) -> tuple[int, bool]:
    """Length of the payload's header (8, or 16 where its size needs 64 bits), and whether offsets need 64 bits."""
    header = 8 if body_length + 8 <= LIMIT32 else 16
    return header, ftyp_length + header + body_length > LIMIT32


def mdat_header(header: int, body_length: int) -> bytes:
    return struct.pack(">I4s", body_length + 8, b"mdat") if header == 8 else struct.pack(">I4sQ", 1, b"mdat", body_length + 16)


def _full(kind: bytes, data: bytes, version: int = 0) -> Box:
    return Box(kind, struct.pack(">I", version << 24) + data)


def _with_duration(body: bytes, at0: int, at1: int, duration: int) -> bytes:
    if body[0]:
        return body[:at1] + struct.pack(">Q", duration) + body[at1 + 8 :]
    return body[:at0] + struct.pack(">I", min(duration, LIMIT32)) + body[at0 + 4 :]


def write_mp4(source: str, output: str, keep: dict[int, list[int]]) -> None:
    """Write the packets of each track (by track id, as decode indices in order) to a new file; tracks that keep nothing are left out."""
    with open(source, "rb") as f:
        moov, ftyp, length = read_moov(f)
        found = [t for t in tracks(moov) if keep.get(t.track_id)]
        if not found:
            raise CheckFailed("nothing_kept")
        plans = []
        for order, t in enumerate(found):
            every = samples(t, length)
            if any(i < 0 or i >= len(every) for i in keep[t.track_id]):
                raise CheckFailed("kept_packet_missing", str(t.track_id))
            chunks, clock = chunked([every[i] for i in keep[t.track_id]], t.timescale), 0
            for number, chunk in enumerate(chunks):
                plans.append((clock / t.timescale if t.timescale else 0.0, order, number, chunk))
                clock += sum(p[2] for p in chunk)
        plans.sort(key=lambda p: p[:3])
        body = sum(p[1] for plan in plans for p in plan[3])
        header, wide = plan_mdat(len(ftyp), body)
        at, offsets = len(ftyp) + header, {}
        for _, order, number, chunk in plans:
            offsets[order, number] = at
            at += sum(p[1] for p in chunk)
        mvhd = moov.find(b"mvhd")
        movie_scale = struct.unpack_from(">I", mvhd.body, 20 if mvhd.body[0] else 12)[0]
        longest, traks = 0, []
        for order, t in enumerate(found):
            chunks = [p[3] for p in sorted((p for p in plans if p[1] == order), key=lambda p: p[2])]
            kept = [p for c in chunks for p in c]
            media = sum(p[2] for p in kept)
            movie = media * movie_scale // t.timescale if t.timescale else 0
            longest = max(longest, movie)
            traks.append(_new_trak(t, kept, chunks, [offsets[order, i] for i in range(len(chunks))], wide, media, movie))
        head = Box(b"mvhd", _with_duration(mvhd.body, 16, 24, longest))
        keep_box = [c for c in moov.children if c.kind not in (b"trak", b"mvhd")]
        with open(output, "wb") as out:
            out.write(ftyp + mdat_header(header, body))
            for *_, chunk in plans:
                for offset, size, *_ in chunk:
                    f.seek(offset)
                    data = f.read(size)
                    if len(data) != size:
                        raise CheckFailed("short_read", str(offset))
                    out.write(data)
            out.write(Box(b"moov", children=[head, *traks, *keep_box]).bytes())


def _new_trak(t: Track, kept: list[tuple], chunks: list[list[tuple]], offsets: list[int], wide: bool, media: int, movie: int) -> Box:
    stbl = t.box.find(b"mdia", b"minf", b"stbl")
    entries = [(i + 1, len(c)) for i, c in enumerate(chunks) if i == 0 or len(c) != len(chunks[i - 1])]
    pack = lambda n, form, rows: struct.pack(">I", n) + b"".join(struct.pack(form, *r) for r in rows)
    stts = run_lengths([p[2] for p in kept])
    new = [stbl.find(b"stsd"), _full(b"stts", pack(len(stts), ">II", stts))]
    if any(p[3] for p in kept) or stbl.find(b"ctts"):
        ctts = run_lengths([p[3] for p in kept])
        new.append(_full(b"ctts", pack(len(ctts), ">Ii", ctts), int(any(p[3] < 0 for p in kept))))
    if stbl.find(b"stss"):
        sync = [(i + 1,) for i, p in enumerate(kept) if p[4]]
        new.append(_full(b"stss", pack(len(sync), ">I", sync)))
    new.append(_full(b"stsc", pack(len(entries), ">III", [(a, n, 1) for a, n in entries])))
    new.append(_full(b"stsz", struct.pack(">I", 0) + pack(len(kept), ">I", [(p[1],) for p in kept])))
    new.append(_full(b"co64" if wide else b"stco", pack(len(offsets), ">Q" if wide else ">I", [(o,) for o in offsets])))

    def rebuilt(box: Box) -> Box:
        if box.kind == b"stbl":
            return Box(b"stbl", children=new)
        if box.kind == b"tkhd":
            return Box(b"tkhd", _with_duration(box.body, 20, 28, movie))
        if box.kind == b"mdhd":
            return Box(b"mdhd", _with_duration(box.body, 16, 24, media))
        return Box(box.kind, box.body, [rebuilt(c) for c in box.children if c.kind != b"edts"])

    return rebuilt(t.box)


def payloads(path: str, packets: list[tuple]) -> Iterator[bytes]:
    with Path(path).open("rb") as f:
        for offset, size, *_ in packets:
            f.seek(offset)
            yield f.read(size)
