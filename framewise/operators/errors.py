"""Errors with a code. Checks that look at many rows give a frame ``media_id, ord, code, detail``; ``raise_first`` raises the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MediaError(Exception):
    """Base of all errors of this library."""


class CheckFailed(MediaError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


class ParseError(CheckFailed):
    """A text or binary input that breaks its format."""


class Unsupported(CheckFailed):
    """An input that is valid but can't be processed."""


def raise_first(found: DataFrame) -> None:
    """``found`` has ``ord, code, detail``; the smallest ``ord`` wins, and only that row reaches the driver."""
    row = found.agg(F.min(F.struct("ord", "code", "detail")).alias("e")).first()
    if row and row["e"] is not None:
        raise CheckFailed(row["e"]["code"], row["e"]["detail"] or "")
