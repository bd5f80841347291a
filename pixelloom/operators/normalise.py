"""Normalisation by image statistics: aggregate by image, join back (one row an image)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def at_ranks(df: DataFrame, column: str, ranks: dict[str, Column], by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """by, and the value at each 0-based rank (an expression of n, the number of rows).

    Exact without sorting an image in one task: equal values are counted first, then ranks are cumulated over
    distinct values.
    """
    counts = df.groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(Window.partitionBy(*by))
    to = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))
    placed = counts.select(*by, "_v", n.alias("n"), to.alias("_to"), (to - F.col("_c")).alias("_from"))
    return placed.groupBy(*by).agg(*[F.min(F.when((F.col("_from") <= k) & (k < F.col("_to")), F.col("_v"))).alias(name) for name, k in ranks.items()])


def floor_rank(p: float) -> Column:
    return F.least(F.floor(F.col("n") * (p / 100)), F.col("n") - 1)


def ceil_rank(p: float) -> Column:
    return F.least(F.ceil(F.col("n") * (p / 100)), F.col("n") - 1)


def percentile_stretch(df: DataFrame, column: str, low: float = 1.0, high: float = 99.0, unit_feature: bool | Column = False) -> DataFrame:
    """The column, stretched between two rank percentiles; where unit_feature holds (of all images, or a condition on
    image_id) a flat map in 0..1 stays as it is."""
    ranks = {"_lo": floor_rank(low), "_hi": ceil_rank(high), "_min": F.lit(0), "_max": F.col("n") - 1}
    s = at_ranks(df, column, ranks)
    v = F.col(column)
    out = clamp01((v - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)))
    if unit_feature is not False:
        flat = F.lit(unit_feature) & (F.col("_hi") - F.col("_lo") < 1e-12) & (F.col("_min") >= -1e-9) & (F.col("_max") <= 1 + 1e-9)
        out = F.when(flat, v).otherwise(out)
    return df.join(s, "image_id").withColumn(column, out).drop("_lo", "_hi", "_min", "_max")


def stretch_all(df: DataFrame, columns: list[str], low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Several columns stretched at once: their ranks come from one aggregate over (image_id, column). A flat map in 0..1
    stays as it is."""
    ranks = {"lo": floor_rank(low), "hi": ceil_rank(high), "min": F.lit(0), "max": F.col("n") - 1}
    s = at_ranks(df.unpivot(["image_id"], columns, "_f", "_x"), "_x", ranks, ("image_id", "_f"))
    s = s.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("_f", F.struct(*ranks)))).alias("_r"))
    out = {}
    for c in columns:
        r, v = F.col("_r")[c], F.col(c)
        flat = (r["hi"] - r["lo"] < 1e-12) & (r["min"] >= -1e-9) & (r["max"] <= 1 + 1e-9)
        out[c] = F.when(flat, v).otherwise(clamp01((v - r["lo"]) / F.greatest(r["hi"] - r["lo"], F.lit(1e-12))))
    return df.join(s, "image_id").withColumns(out).drop("_r")  # one row an image


def min_max(df: DataFrame, column: str) -> DataFrame:
    s = df.groupBy("image_id").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.join(s, "image_id").withColumn(column, (F.col(column) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12))).drop("_lo", "_hi")


def robust_centre(df: DataFrame, column: str, gamma: float = 0.5, low: float = 0.1, high: float = 0.9, trimmed: float = 0.5, median: float = 0.5) -> DataFrame:
    """image_id, centre: a mix of the trimmed mean and the upper median of compressed values, decompressed."""
    c = df.select("image_id", F.pow(F.greatest(F.col(column), F.lit(0.0)), F.lit(gamma)).alias("c"))
    p = c.groupBy("image_id").agg(F.percentile("c", F.lit(low)).alias("lo"), F.percentile("c", F.lit(high)).alias("hi"))
    m = at_ranks(c, "c", {"med": F.floor(F.col("n") / 2)})
    inside = F.when((F.col("c") >= F.col("lo")) & (F.col("c") <= F.col("hi")), F.col("c"))
    t = c.join(p, "image_id").groupBy("image_id").agg(F.avg(inside).alias("tm"))
    return t.join(m, "image_id").select("image_id", F.pow(F.col("tm") * trimmed + F.col("med") * median, F.lit(1 / gamma)).alias("centre"))


def threshold_filter(df: DataFrame, column: str, threshold: float, normalised: bool = True) -> DataFrame:
    """Values from the threshold on stay, others become 0; the test may look at the min-max normalised value."""
    if not normalised:
        return df.withColumn(column, F.when(F.col(column) >= threshold, F.col(column)).otherwise(0.0))
    n = min_max(df.withColumn("_t", F.col(column)), "_t")
    return n.withColumn(column, F.when(F.col("_t") >= threshold, F.col(column)).otherwise(0.0)).drop("_t")


def quantile_filter(df: DataFrame, column: str, keep: float) -> DataFrame:
    """The top share of values stays."""
    s = at_ranks(df, column, {"_cut": F.least(F.floor(F.col("n") * (1 - keep)), F.col("n") - 1)})
    return df.join(s, "image_id").withColumn(column, F.when(F.col(column) >= F.col("_cut"), F.col(column)).otherwise(0.0)).drop("_cut")


def stretch_positive(df: DataFrame, column: str, gamma: float = 1.2, least: float = 0.0) -> DataFrame:
    """Positive values stretched to least..1; all equal: 1; zeros stay."""
    pos = F.when(F.col(column) > 0, F.col(column))
    s = df.groupBy("image_id").agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    t = F.pow((F.col(column) - F.col("_lo")) / F.when(span > 1e-12, span).otherwise(1.0), F.lit(gamma))
    out = F.when(F.col(column) > 0, F.when(span > 1e-12, t * (1 - least) + least).otherwise(1.0)).otherwise(0.0)
    return df.join(s, "image_id").withColumn(column, out).drop("_lo", "_hi")


def mask_stats(df: DataFrame, column: str) -> DataFrame:
    """image_id, mean, kinds: distinct 8-bit values, 3 at most."""
    return df.groupBy("image_id").agg(F.avg(column).alias("mean"), F.least(F.lit(3), F.countDistinct(F.round(F.col(column) * 255))).alias("kinds"))


def clipped_variance(df: DataFrame, column: str, low: float = 1.0, high: float = 99.0) -> DataFrame:
    s = at_ranks(df, column, {"_lo": floor_rank(low), "_hi": floor_rank(high)})
    v = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(column)))
    return df.join(s, "image_id").groupBy("image_id").agg(F.var_pop(v).alias("variance"))
