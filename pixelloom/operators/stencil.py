"""Neighbourhood operators on pixel tables (image_id, x, y, values): windows over rows and columns.

Two-dimensional filters are separable: a window over rows, then one over columns. Each window partitions by (image_id, y)
or (image_id, x), never by the image alone, so an image's size doesn't bound a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def col() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")



def clamped(v: Column, k: int, w) -> Column:
    """The value k steps on, the nearest edge's beyond it."""
    if k == 0:
        return v
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(v, k).over(w), F.last(v).over(whole)) if k > 0 else F.coalesce(F.lag(v, -k).over(w), F.first(v).over(whole))


def _both(df: DataFrame, columns: list[str], one) -> DataFrame:
    """A one-dimensional filter along rows, then along columns."""
    for w in (row(), col()):
        df = df.withColumns({c: one(F.col(c), w) for c in columns})
    return df


def box_blur(df: DataFrame, columns: list[str], r: int) -> DataFrame:
    """Mean of the samples in range; fewer at the edges."""
    return _both(df, columns, lambda v, w: F.avg(v).over(w.rowsBetween(-r, r)))


def mean_filter(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Mean of (2 (k div 2) + 1)^2 samples; edge samples count for those beyond."""
    r = k // 2

    def one(v: Column, w) -> Column:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at, n = F.row_number().over(w), F.count(v).over(whole)
        short_left, short_right = F.greatest(F.lit(0), F.lit(r + 1) - at), F.greatest(F.lit(0), at + r - n)
        return (F.sum(v).over(w.rowsBetween(-r, r)) + short_left * F.first(v).over(whole) + short_right * F.last(v).over(whole)) / (2 * r + 1)

    return _both(df, columns, one)


def kernel(sigma: float, r: int) -> list[float]:
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(k) for x in k]


def gaussian(df: DataFrame, columns: list[str], sigma: float, r: int | None = None) -> DataFrame:
    """Separable Gaussian, edges clamped."""
    r = r if r is not None else min(20, max(1, round(2 * sigma)))
    k = kernel(sigma, r)
    return _both(df, columns, lambda v, w: sum((clamped(v, i, w) * k[i + r] for i in range(-r + 1, r + 1)), clamped(v, -r, w) * k[0]))


def unsharp(df: DataFrame, column: str, r: int, amount: float) -> DataFrame:
    soft = box_blur(df.withColumn("_soft", F.col(column)), ["_soft"], r)
    return soft.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) + (F.col(column) - F.col("_soft")) * amount))).drop("_soft")


def erode(df: DataFrame, columns: list[str], r: int) -> DataFrame:
    return _both(df, columns, lambda v, w: F.min(v).over(w.rowsBetween(-r, r)))


def dilate(df: DataFrame, columns: list[str], r: int) -> DataFrame:
    return _both(df, columns, lambda v, w: F.max(v).over(w.rowsBetween(-r, r)))


def opening(df: DataFrame, columns: list[str], r: int) -> DataFrame:
    return dilate(erode(df, columns, r), columns, r)


def closing(df: DataFrame, columns: list[str], r: int) -> DataFrame:
    return erode(dilate(df, columns, r), columns, r)


def sobel_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <c>_gx and <c>_gy; null on the image's border."""
    step = {}
    for c in columns:
        before, after = F.lag(c, 1).over(row()), F.lead(c, 1).over(row())
        step |= {f"_{c}_d": after - before, f"_{c}_s": before + F.col(c) * 2 + after}
    df = df.withColumns(step)
    out = {}
    for c in columns:
        d, s = f"_{c}_d", f"_{c}_s"
        out |= {f"{c}_gx": F.lag(d, 1).over(col()) + F.col(d) * 2 + F.lead(d, 1).over(col()), f"{c}_gy": F.lead(s, 1).over(col()) - F.lag(s, 1).over(col())}
    return df.withColumns(out).drop(*step)


def sobel(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column becomes its gradient magnitude / 8; 0 on the border."""
    g = sobel_parts(df, columns)
    out = {c: F.coalesce(F.sqrt(F.col(f"{c}_gx") ** 2 + F.col(f"{c}_gy") ** 2) / 8, F.lit(0.0)) for c in columns}
    return g.withColumns(out).drop(*[f"{c}_{d}" for c in columns for d in ("gx", "gy")])


def edge_strength(df: DataFrame, threshold: float = 0.15, gamma: float = 0.65) -> DataFrame:
    """Adds edge: L1 Sobel energy of lab_l, lab_a, lab_b; the border has the image's maximum; below the cutoff 0."""
    g = sobel_parts(df, ["lab_l", "lab_a", "lab_b"])
    energy = sum((F.abs(f"lab_{c}_gx") + F.abs(f"lab_{c}_gy")) * w for c, w in (("l", 1.0), ("a", 0.95), ("b", 0.95)))
    g = g.withColumn("_e", energy).drop(*[f"lab_{c}_{d}" for c in "lab" for d in ("gx", "gy")])
    top = g.groupBy("image_id").agg(F.greatest(F.lit(1.0), F.max("_e")).alias("_top"), F.max("x").alias("_w"), F.max("y").alias("_h"))
    g = g.join(top, "image_id")  # one row an image
    cut = F.greatest(F.lit(min(1.0, max(0.0, threshold))) * F.col("_top"), F.lit(1.0))
    v = F.coalesce("_e", "_top")
    e = F.when(v <= cut, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - cut) / F.greatest(F.col("_top") - cut, F.lit(1.0)))))
    e = e if gamma == 1.0 else F.pow(e, F.lit(min(3.0, max(0.2, gamma))))
    return g.withColumn("edge", F.when((F.col("_w") < 2) | (F.col("_h") < 2), 1.0).otherwise(e)).drop("_e", "_top", "_w", "_h")


def boundary(label: str) -> Column:
    """Whether a neighbour has another label; the image's edge isn't a boundary."""
    return F.greatest(*[(~F.coalesce(n, F.col(label)).eqNullSafe(F.col(label))).cast("int") for w in (row(), col()) for n in (F.lag(label, 1).over(w), F.lead(label, 1).over(w))])
