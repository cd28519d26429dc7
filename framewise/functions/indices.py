"""Indices of frames as typed columns: display and decode order never mix, differences are counts, and sums stay inside 32 bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = (1 << 32) - 1


@dataclass(frozen=True)
class Index:
    """A column of one order's indices. ``a - b`` of one order is a number of frames; of two orders it is an error before anything runs."""

    column: Column

    def __sub__(self, other: Index) -> Column:
        if type(other) is not type(self):
            raise TypeError(f"{type(self).__name__} - {type(other).__name__}")
        less = F.raise_error(F.concat(F.lit("index difference below 0: "), self.column.cast("string"), F.lit(" - "), other.column.cast("string"))).cast("long")
        return F.when(self.column < other.column, less).otherwise(self.column - other.column)

    def __add__(self, count: Column | int):
        """Further on by a number of frames; beyond 32 bits is an error."""
        total = self.column.cast("long") + self._count(count)
        over = F.raise_error(F.concat(F.lit("index beyond 32 bits: "), total.cast("string"))).cast("long")
        return type(self)(F.when(total > MOST, over).otherwise(total))

    def checked_add(self, count: Column | int) -> Column:
        """The same, null where it would go beyond 32 bits."""
        total = self.column.cast("long") + self._count(count)
        return F.when(total <= MOST, total)

    @staticmethod
    def _count(count: Column | int) -> Column:
        if isinstance(count, Index):
            raise TypeError("two indices can't be added")
        return (F.lit(count) if isinstance(count, int) else count).cast("long")


class DisplayIdx(Index):
    pass


class DecodeIdx(Index):
    pass
