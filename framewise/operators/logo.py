"""Logo models: learning coefficients from frames, choosing attention points, scoring frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .errors import CheckFailed

LEVELS, SIDE, POINT_SHARE, LEAST_FRAMES = 32, 5, 0.35, 4
#: The share of the mean correlation from which on a point has its full weight.
WEIGHT_SHARE = 0.2


# -- learning ----------------------------------------------------------------------------------------------------------------------------


def border_pixels(w: int, h: int) -> list[int]:
    """Row-major indices of the outermost pixels, each once."""
    return [y * w + x for y in range(h) for x in range(w) if y in (0, h - 1) or x in (0, w - 1)]


def background(border: str, threshold: int) -> Column:
    """Mean of the middle half of an array of border values, or null where they spread by more than the threshold."""
    n = f"size({border})"
    q = f"({n} div 4)"
    middle = f"slice(array_sort({border}), {q} + 1, {n} - 2 * {q})"
    mean = f"aggregate({middle}, 0D, (a, x) -> a + x) / size({middle})"
    return F.expr(f"if({n} = 0 or array_max({border}) - array_min({border}) > {threshold}, null, {mean})")


def usable_frames(luma: DataFrame, w: int, h: int, threshold: int) -> DataFrame:
    """``media_id, display_idx, plane, y``: frames whose border is flat, with its brightness; ``plane`` is an array of pixel values."""
    at = F.array(*(F.lit(i) for i in border_pixels(w, h)))
    rows = luma.withColumn("_border", F.transform(at, lambda i: F.get("plane", i)))
    return rows.withColumn("y", background("_border", threshold)).filter("y is not null").drop("_border")


def regression_sums(frames: DataFrame) -> DataFrame:
    """By pixel: n, sums of x, x², y, y² and xy; ``x`` is the background's brightness and ``y`` the pixel's."""
    rows = frames.select("media_id", F.posexplode("plane").alias("pixel", "v"), F.col("y").alias("x")).withColumn("v", F.col("v").cast("double"))
    return rows.groupBy("media_id", "pixel").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("v").alias("sy"),
        F.sum(F.col("v") * F.col("v")).alias("syy"), F.sum(F.col("x") * F.col("v")).alias("sxy"),
    )


def coefficients(sums: DataFrame) -> DataFrame:
    """``a`` and ``b`` with background = a * pixel + 255 * b, the mean of both regressions; null where a slope doesn't exist or isn't finite."""
    # of the background on the pixel, and of the pixel on the background, turned round
    a1, b1 = "try_divide(n * sxy - sx * sy, n * syy - sy * sy)", "try_divide(sx * syy - sy * sxy, n * syy - sy * sy)"
    a2, b2 = "try_divide(n * sxy - sx * sy, n * sxx - sx * sx)", "try_divide(sy * sxx - sx * sxy, n * sxx - sx * sx)"
    rows = sums.withColumns({"a1": F.expr(a1), "b1": F.expr(b1), "a2": F.expr(a2), "b2": F.expr(b2)})
    rows = rows.withColumns({"a": F.expr("(a1 + try_divide(1D, a2)) / 2"), "b": F.expr("(b1 - try_divide(b2, a2)) / 2 / 255")})
    good = F.col("a").isNotNull() & ~F.isnan("a") & (F.col("a") != 0) & (F.abs("a") != F.lit(float("inf")))
    return rows.select("media_id", "pixel", "n", F.when(good, F.col("a")).alias("a"), F.when(good, F.col("b")).alias("b"))


def learned(luma: DataFrame, w: int, h: int, threshold: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Coefficients of one medium as float32 planes, and how many frames were used, of how many."""
    total = luma.count()
    rows = coefficients(regression_sums(usable_frames(luma, w, h, threshold))).orderBy("pixel").collect()  # one row per pixel of the logo
    used = rows[0]["n"] if rows else 0
    if not used:
        raise CheckFailed("no_usable_frames", f"0 of {total}")
    if used < LEAST_FRAMES:
        raise CheckFailed("too_few_frames", f"{used} of {total}")
    if len(rows) != w * h or any(r["a"] is None or r["b"] is None for r in rows):
        raise CheckFailed("no_coefficients", "a pixel's brightness doesn't follow the background")
    return np.array([r["a"] for r in rows], np.float32), np.array([r["b"] for r in rows], np.float32), used, total


# -- masks and scores --------------------------------------------------------------------------------------------------------------------


def drawn(a: np.ndarray, b: np.ndarray, level: float) -> np.ndarray:
    """The logo on a flat background of that brightness; where ``a`` isn't above 0 the background shows."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    on = a > 0
    return np.where(on, (level - b * 255) / np.where(on, a, 1), level)


def windows(plane: np.ndarray, w: int) -> np.ndarray:
    """The 5 x 5 neighbourhoods of the pixels that have one: (rows, columns, 25)."""
    view = np.lib.stride_tricks.sliding_window_view(plane.reshape(-1, w), (SIDE, SIDE))
    return view.reshape(*view.shape[:2], SIDE * SIDE)


@dataclass
class Mask:
    """Attention points: the pixels of each one's window, its kernel and its factors by brightness level; and the logo's own score."""

    pixels: np.ndarray
    kernels: np.ndarray
    scale: np.ndarray
    scale2: np.ndarray
    black: float
    a: np.ndarray
    b: np.ndarray

    def raw(self, planes: np.ndarray) -> np.ndarray:
        """One score for each plane: correlations with the points' kernels, scaled by the brightness around them, clipped and added up."""
        near = planes[:, self.pixels].astype(np.float64)
        mean = near.mean(axis=2)
        level = (np.clip(mean, 0, 255) / 8).astype(np.int64)
        corr = ((near - mean[:, :, None]) * self.kernels).sum(axis=2)
        at = np.arange(len(self.pixels))
        return (np.clip(corr * self.scale[at, level], -1, 1) * self.scale2[at, level]).sum(axis=1)

    def scores(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(with the frame as it is, with the logo taken off), both in units of the logo's own score."""
        with np.errstate(all="ignore"):
            clean = self.a.astype(np.float64) * planes + self.b.astype(np.float64) * 255
            return self.raw(planes) / self.black, self.raw(clean) / self.black


def top_points(a: np.ndarray, b: np.ndarray, w: int, h: int) -> np.ndarray:
    """Places (y, x) of the points with the largest variance around them on medium brightness; ties keep row-major order."""
    if w < SIDE or h < SIDE:
        raise CheckFailed("logo_too_small", f"{w}x{h}")
    near = windows(drawn(a, b, 128), w)
    variance = near.var(axis=2)
    k = min(int(w * h * POINT_SHARE), variance.size)
    order = np.argsort(-variance.ravel(), kind="stable")[:k]
    return np.stack(np.unravel_index(order, variance.shape), axis=1) + SIDE // 2


def mask(a: np.ndarray, b: np.ndarray, w: int, h: int) -> Mask:
    """Kernels from the logo on black, scales from its correlations on every level, the logo's own score on a dark background. A point's scale on
    a level is one over the size of its correlation there; its weight is that size against a fifth of the mean size of all, 1 at most."""
    points = top_points(a, b, w, h)
    if not len(points):
        raise CheckFailed("logo_without_points", f"{w}x{h}")
    reach = np.arange(-(SIDE // 2), SIDE // 2 + 1)
    pixels = ((points[:, 0, None, None] + reach[None, :, None]) * w + points[:, 1, None, None] + reach[None, None, :]).reshape(len(points), -1)
    near = drawn(a, b, 0)[pixels]
    kernels = near - near.mean(axis=1, keepdims=True)
    corr = np.empty((len(points), LEVELS))
    for level in range(LEVELS):
        shown = drawn(a, b, level * 8)[pixels]
        corr[:, level] = np.abs(((shown - shown.mean(axis=1, keepdims=True)) * kernels).sum(axis=1))
    scale = np.divide(1, corr, out=np.zeros_like(corr), where=corr > 0)
    full = WEIGHT_SHARE * corr.mean()  # one number over all points and levels
    scale2 = np.minimum(1, corr / full) if full > 0 else np.zeros_like(corr)
    out = Mask(pixels, kernels, scale, scale2, 1.0, a, b)
    out.black = float(out.raw(drawn(a, b, 16)[None])[0])
    return out


def frame_scores(luma: DataFrame, model: Mask) -> DataFrame:
    """``media_id, display_idx, corr0, corr1``; ``luma`` has ``plane`` as binary, one byte a pixel. The mask is some kilobytes and is broadcast."""
    held = luma.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            planes = np.stack([np.frombuffer(p, np.uint8) for p in pdf["plane"]]).astype(np.float32) if len(pdf) else np.zeros((0, len(held.value.a)), np.float32)
            parts = [held.value.scores(planes[i : i + 256]) for i in range(0, len(planes), 256)] or [(np.zeros(0), np.zeros(0))]
            c0, c1 = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            yield pd.DataFrame({"media_id": pdf["media_id"], "display_idx": pdf["display_idx"], "corr0": c0.astype(float), "corr1": c1.astype(float)})

    return luma.select("media_id", "display_idx", "plane").mapInPandas(scored, "media_id string, display_idx long, corr0 double, corr1 double")


def top_variance(planes: DataFrame, w: int, h: int, share: float = POINT_SHARE) -> DataFrame:
    """The same choice of points for many planes at once: ``media_id, y, x, variance, rank``, by descending variance, then y, then x.

    The variance is kept as an integer, 25 * sum of squares less the square of the sum, so that ties are exact.
    """
    cells = planes.select("media_id", F.posexplode("plane").alias("i", "v")).select("media_id", (F.col("i").cast("long")).alias("i"), F.col("v").cast("long").alias("v"))
    spread = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-2, 3) for dx in range(-2, 3))))
    rows = cells.select("media_id", "v", F.expr(f"i div {w}").alias("y"), (F.col("i") % w).alias("x"), spread.alias("d"))
    rows = rows.select("media_id", "v", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    rows = rows.filter((F.col("y") >= 2) & (F.col("y") < h - 2) & (F.col("x") >= 2) & (F.col("x") < w - 2))
    sums = rows.groupBy("media_id", "y", "x").agg((F.count(F.lit(1)) * F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v")).alias("variance"))
    rank = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("variance"), "y", "x"))
    return sums.withColumn("rank", rank).filter(F.col("rank") <= int(w * h * share))
