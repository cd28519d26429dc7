"""Two-level windows over a dense or sparse integer position.

A plain window sorts a whole partition in one task; one long medium would then be one task. Here positions are cut into chunks: a window runs
inside each chunk, another over one summary row per chunk, and both are joined on the chunk. ``keys`` name the medium.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536


def _chunked(df: DataFrame, pos: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk)).cast("long"))


def running(df: DataFrame, keys: list[str], pos: str, **sums: tuple[str | Column, bool]) -> DataFrame:
    """``df`` with running sums: ``name=(value, inclusive)``; values are summed in the order of ``pos``, which has no ties inside ``keys``."""
    rows = _chunked(df, pos, CHUNK).withColumns({f"_v_{n}": (F.col(v) if isinstance(v, str) else v) for n, (v, _) in sums.items()})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_chunk").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    totals = totals.select(*keys, "_chunk", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    out = rows.join(totals, [*keys, "_chunk"])
    for n, (_, inclusive) in sums.items():
        here = F.sum(f"_v_{n}").over(inside)
        out = out.withColumn(n, F.col(f"_b_{n}") + here - (F.lit(0) if inclusive else F.col(f"_v_{n}")))
    return out.select(*df.columns, *sums)


def carried(df: DataFrame, keys: list[str], pos: str, **values: tuple[Column, str]) -> DataFrame:
    """``df`` with, for ``name=(condition, side)``, the nearest position where the condition holds: ``side`` is ``before`` (<=), ``after`` (>=),
    ``below`` (<) or ``above`` (>); null where there is none. Rows of one position see each other on the sides with equality."""
    rows = _chunked(df, pos, CHUNK).withColumns({f"_p_{n}": F.when(c, F.col(pos)) for n, (c, _) in values.items()})
    spans = {"before": (Window.unboundedPreceding, 0), "below": (Window.unboundedPreceding, -1)}
    flip = {"after": "before", "above": "below"}
    summary = rows.groupBy(*keys, "_chunk").agg(*(f(f"_p_{n}").alias(f"_{k}_{n}") for n in values for k, f in (("lo", F.min), ("hi", F.max))))
    chunks = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    edge = []
    for n, (_, side) in values.items():
        back = side in spans
        w = chunks.orderBy("_chunk" if back else F.desc("_chunk"))
        edge.append((F.max(f"_hi_{n}") if back else F.min(f"_lo_{n}")).over(w).alias(f"_e_{n}"))
    out = rows.join(summary.select(*keys, "_chunk", *edge), [*keys, "_chunk"])
    for n, (_, side) in values.items():
        back = side in spans
        # ranges of positions, so that rows of one position are peers; a descending order turns "after" into "before"
        order = F.col(pos) if back else -F.col(pos)
        w = Window.partitionBy(*keys, "_chunk").orderBy(order).rangeBetween(*spans[side if back else flip[side]])
        here = (F.max if back else F.min)(f"_p_{n}").over(w)
        out = out.withColumn(n, F.coalesce(here, F.col(f"_e_{n}")))
    return out.select(*df.columns, *values)


def as_of(points: DataFrame, refs: DataFrame, keys: list[str], point: str, ref: str, **sides: str) -> DataFrame:
    """``points`` with, for ``name=side`` (see ``carried``), the nearest value of ``ref``; no cross product, no broadcast."""
    held = [c for c in points.columns]
    tagged = points.select(*(F.col(k) for k in keys), F.col(point).alias("_pos"), F.struct(*held).alias("_row"))
    marks = refs.select(*(F.col(k) for k in keys), F.col(ref).alias("_pos")).distinct().withColumn("_row", F.lit(None).cast(tagged.schema["_row"].dataType))
    both = carried(tagged.unionByName(marks), keys, "_pos", **{n: (F.col("_row").isNull(), side) for n, side in sides.items()})
    return both.filter("_row is not null").select("_row.*", *sides)


def islands(df: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Maximal runs of consecutive rows with one value of ``flag``: ``keys, flag, start, end`` (half-open), for dense positions."""
    rows = df.select(*keys, F.col(pos).alias("_pos"), F.col(flag).alias("_flag"))
    before = rows.select(*keys, (F.col("_pos") + 1).alias("_pos"), F.col("_flag").alias("_old"))
    opened = rows.join(before, [*keys, "_pos"], "left").withColumn("_open", (~F.col("_flag").eqNullSafe(F.col("_old"))).cast("long"))
    runs = running(opened, keys, "_pos", _run=("_open", True))
    return runs.groupBy(*keys, "_run").agg(F.first("_flag").alias(flag), F.min("_pos").alias("start"), (F.max("_pos") + 1).alias("end")).drop("_run")
