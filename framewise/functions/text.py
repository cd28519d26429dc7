"""Times as text, headers, names and flags as column functions. Parsers give null for text that isn't a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of an index row's flags.
KEY_PACKET, LEADING, PTS_VALID, DTS_VALID, OFFSET_VALID, NEEDS_EARLIER = 1, 2, 4, 8, 16, 32
#: Tags whose times count from an event's start.
RELATIVE_TAGS = ("\\move(", "\\t(", "\\fad(", "\\fade(", "\\k")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_flag(flags: Column | str, bit: int) -> Column:
    return _c(flags).bitwiseAND(bit) != 0


def is_cm(label: Column | str) -> Column:
    return _c(label) == ":CM"


def is_cut_cancelled(label: Column | str) -> Column:
    return _c(label).contains("(cut-cancel)")


def has_relative_timing(text: Column | str) -> Column:
    out = F.lit(False)
    for tag in RELATIVE_TAGS:
        out = out | _c(text).contains(tag)
    return out


def _clock(x: Column, pattern: str, parts: int, last: int, unit: int) -> Column:
    part = lambda i: F.regexp_extract(x, pattern, i).cast("long")
    good = x.rlike(pattern) & F.coalesce(F.when(x.rlike(pattern), (part(2) <= 59) & (part(3) <= 59) & (part(4) <= last)), F.lit(False))
    return F.when(good, ((part(1) * 60 + part(2)) * 60 + part(3)) * unit + part(4))


def parse_ass_time(x: Column | str) -> Column:
    """``h:mm:ss.cc`` in hundredths; a field may have any number of digits, so ``.5`` is five hundredths."""
    return _clock(F.trim(_c(x)), r"^([0-9]+):([0-9]+):([0-9]+)\.([0-9]+)$", 4, 99, 100)


def parse_srt_time(x: Column | str) -> Column:
    """``hh:mm:ss,mmm`` in thousandths."""
    return _clock(F.trim(_c(x)), r"^([0-9]+):([0-9]+):([0-9]+),([0-9]+)$", 4, 999, 1000)


def _parts(x: Column, unit: int) -> tuple[Column, Column, Column, Column]:
    whole = lambda by: ((x - x % by) / by).cast("long")
    return whole(3600 * unit), whole(60 * unit) % 60, whole(unit) % 60, x % unit


def format_ass_time(x: Column | str) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", *_parts(_c(x).cast("long"), 100))


def format_srt_time(x: Column | str) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", *_parts(_c(x).cast("long"), 1000))


def format_mm_ss(seconds: Column | str) -> Column:
    """Minutes and seconds, rounded, not below zero."""
    s = F.greatest(F.lit(0), F.round(_c(seconds)).cast("long"))
    return F.format_string("%02d:%02d", ((s - s % 60) / 60).cast("long"), s % 60)


def frame_time(frame: Column | str, fps: Column | float) -> Column:
    """A frame's time in minutes and seconds, rounded down."""
    s = F.floor(_c(frame) / fps)
    return F.format_string("%02d:%02d", ((s - s % 60) / 60).cast("long"), s % 60)


def split_time(x: Column | str, width: int = 12) -> tuple[Column, Column]:
    """The leading time and what follows it. A time has a fixed width, and more where its hours have over two digits; shorter text is all time."""
    long = F.length(F.regexp_extract(_c(x), r"^[0-9]{3,}:[0-9]{2}:[0-9]{2},[0-9]{3}", 0))
    width = F.when(long > 0, long).otherwise(width)
    return F.substring(_c(x), F.lit(1), width), F.substring(_c(x), width + 1, F.lit(1 << 30))


def header_value(header: Column | str, key: str) -> Column:
    return F.try_element_at(_c(header), F.lit(key))


def header_long(header: Column | str, key: str) -> Column:
    """A header number that must be there."""
    return F.coalesce(header_value(header, key), F.raise_error(F.lit(f"header has no {key}"))).cast("long")


def _ratio(header: Column | str, num: str, den: str, default: tuple[int, int]) -> tuple[Column, Column]:
    at = lambda k, d: F.coalesce(header_value(header, k).try_cast("long"), F.lit(d))
    return at(num, default[0]), at(den, default[1])


def time_base(header: Column | str) -> tuple[Column, Column]:
    """Seconds in a unit as numerator and denominator, 1/1 by default."""
    return _ratio(header, "time_base_num", "time_base_den", (1, 1))


def frame_rate(header: Column | str) -> tuple[Column, Column]:
    return _ratio(header, "frame_rate_num", "frame_rate_den", (30000, 1001))


def fps(header: Column | str) -> Column:
    """Frames a second, 30000/1001 by default; a denominator of 0 gives the numerator."""
    num, den = frame_rate(header)
    return F.when(den == 0, num.cast("double")).otherwise(num.cast("double") / F.when(den == 0, 1).otherwise(den))


def sanitised(stem: Column | str, most: int = 80) -> Column:
    """A file name's stem as a folder name: control signs, slashes and white space become underscores, 80 characters at most."""
    return F.substring(F.regexp_replace(_c(stem), r"[\p{Cc}/\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", "_"), 1, most)


def fnv1a(x: Column | str) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes in hex. Spark's integers don't wrap, so the product is taken in halves that fit.

    hash * (2**40 + 435) mod 2**64, with the hash as two numbers of 32 bits.
    """
    low, high = 0x84222325, 0xCBF29CE4
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(_c(x)))), lambda i: F.conv(F.hex(F.substring(_c(x).cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(_c(x)) == 0, F.array().cast("array<bigint>")).otherwise(codes)
    mask = (1 << 32) - 1

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        bottom = lo * 435
        top = h["hi"] * 435 + F.shiftright(bottom, 32) + F.shiftleft(lo.bitwiseAND((1 << 24) - 1), 8)
        return F.struct(bottom.bitwiseAND(mask).alias("lo"), top.bitwiseAND(mask).alias("hi"))

    start = F.struct(F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi"))
    return F.aggregate(codes, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0"))))


def subtitle_format(path: Column | str) -> Column:
    """``ass`` or ``srt`` by the extension (``ssa`` is ``ass``), or null."""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))
    return F.when(ext.isin("ass", "ssa"), "ass").when(ext == "srt", "srt")


def presence_threshold(seconds: Column | str) -> Column:
    """The share of frames a logo must be on: lower for media of up to seven minutes."""
    return F.when(_c(seconds) <= 420, 0.03).otherwise(0.1)


def presence_decision(fraction: Column | str, threshold: Column | str, text: Column | str) -> Column:
    return F.when(_c(fraction) < _c(threshold), "below_threshold").when(F.length(_c(text)) == 0, "no_intervals").otherwise("use")


def even_down(x: Column | str) -> Column:
    return _c(x) - F.pmod(_c(x), F.lit(2))


def rect_fault(x: Column | str, y: Column | str, w: Column | str, h: Column | str, width: Column | str, height: Column | str) -> Column:
    """The first rule that a rectangle in a frame breaks, or null."""
    return (
        F.when((_c(x) < 0) | (_c(y) < 0), "negative")
        .when((_c(w) <= 0) | (_c(h) <= 0), "empty")
        .when(_c(x) + _c(w) > _c(width), "too_wide")
        .when(_c(y) + _c(h) > _c(height), "too_high")
    )
