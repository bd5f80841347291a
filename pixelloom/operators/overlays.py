"""Visual projections: overlays and residual packs as 8-bit channels of pixel tables, and the marker of a weighted centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import colour as C

from .normalise import clamp01
from .stencil import boundary, gaussian

#: What complexity and saliency are drawn in, a region line, and the share of a region's colour.
COMPLEX, SALIENT, LINE, SHARE = (60.0, 220.0, 180.0), (255.0, 40.0, 40.0), 20, 0.45


def u8(v: Column, rounding: bool = False) -> Column:
    """0..255, truncated or rounded, saturating."""
    return F.greatest(F.lit(0), F.least(F.lit(255), (F.floor(v + 0.5) if rounding else F.floor(v)).cast("int")))


def _over(base: Column, c: Column, tint: tuple[float, float, float]) -> list[Column]:
    return [u8(base * (1 - c) + c * t).alias(n) for n, t in zip("rgb", tint, strict=True)]


def gray_map(v: Column) -> Column:
    return u8(clamp01(v) * 255)


def complexity_overlay(complexity: Column, gray: Column) -> list[Column]:
    """Gray where smooth, tinted where complex."""
    return _over(gray * 255, complexity, COMPLEX)


def saliency_overlay(saliency: Column, light: Column) -> list[Column]:
    """L* as gray, salient pixels red."""
    return _over(clamp01(light / 100) * 255, saliency, SALIENT)


def edge_map(edge: Column) -> Column:
    return u8(edge * 255, True)


def region_overlay(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b: pixels blended with their region's mean colour (black without one), and lines between regions."""
    own = regions.select("image_id", "region", *[F.col(f"mean_{c}").alias(f"_{c}") for c in "rgb"])
    drawn = labelled.withColumn("_line", boundary("region")).join(own, ["image_id", "region"], "left")
    blend = lambda c: F.floor(F.coalesce(F.col(f"_{c}"), F.lit(0)) * SHARE + F.col(c) * (1 - SHARE) + 0.5).cast("int")
    return drawn.select("image_id", "x", "y", *[F.when(F.col("_line") == 1, LINE).otherwise(blend(c)).alias(c) for c in "rgb"])


def region_fill(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id, x, y, r, g, b: every pixel in its region's mean colour, black without one."""
    own = regions.select("image_id", "region", *[F.col(f"mean_{c}").alias(f"_{c}") for c in "rgb"])
    return labelled.select("image_id", "x", "y", "region").join(own, ["image_id", "region"], "left").select("image_id", "x", "y", *[F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("int").alias(c) for c in "rgb"])


def unit_ab(v: Column, span: float = 256.0) -> Column:
    """a* or b* as 0..1: spans 256 for maps, 255 (kept in 0..1) for images."""
    out = (v + 128) / span
    return out if span == 256.0 else clamp01(out)


def global_residual_pack(df: DataFrame) -> DataFrame:
    """image_id, x, y, sat, light, l, a, b: distances from the image's means, 8 bits, rounded. df: lab_l, lab_a, lab_b, r, g, b of 8 bits."""
    _, sat, light = C.hsl(*C.unit("r", "g", "b"))
    df = df.withColumns({"_sat": sat, "_light": light})
    parts = {"sat": ("_sat", 255.0), "light": ("_light", 255.0), "l": ("lab_l", 2.55), "a": ("lab_a", 1.0), "b": ("lab_b", 1.0)}
    means = df.groupBy("image_id").agg(*[F.avg(c).alias(f"_m_{n}") for n, (c, _) in parts.items()])
    return df.join(means, "image_id").select("image_id", "x", "y", *[u8(F.abs(F.col(c) - F.col(f"_m_{n}")) * k, True).alias(n) for n, (c, k) in parts.items()])


def local_residual_pack(df: DataFrame, sigma: float, r: int | None = None) -> DataFrame:
    """image_id, x, y, l, a, b: distances of 8-bit planes from their Gaussian blur (also of 8 bits)."""
    planes = {"l": clamp01(F.col("lab_l") / 100), "a": unit_ab(F.col("lab_a"), 255.0), "b": unit_ab(F.col("lab_b"), 255.0)}
    q = df.select("image_id", "x", "y", *[F.floor(v * 255).cast("double").alias(n) for n, v in planes.items()])
    soft = gaussian(q.withColumns({f"_{n}": F.col(n) for n in planes}), [f"_{n}" for n in planes], sigma, r)
    return soft.select("image_id", "x", "y", *[F.abs(F.col(n) - F.floor(F.col(f"_{n}") + 0.5)).cast("int").alias(n) for n in planes])


def weighted_centroid(df: DataFrame, column: str) -> DataFrame:
    """image_id, cx, cy of a map kept in 0..1; null for an empty map."""
    v = clamp01(F.col(column))
    g = df.groupBy("image_id").agg(F.sum(v).alias("s"), F.sum(v * F.col("x")).alias("sx"), F.sum(v * F.col("y")).alias("sy"))
    at = lambda c: F.when(F.col("s") > 1e-12, F.try_divide(F.col(c), F.col("s")))
    return g.select("image_id", at("sx").alias("cx"), at("sy").alias("cy"))


def with_centroid(df: DataFrame, column: str) -> DataFrame:
    """image_id, x, y, r, g, b: the map as gray with a red dot, ringed white, at its centroid. df has w and h."""
    c = weighted_centroid(df, column)
    # fixed values: the dot's radius is a share of the shorter side, 2 to 5
    radius = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.least("w", "h") / 140 + 0.5)))
    d2 = F.pow(F.col("x") - F.floor(F.col("cx") + 0.5), F.lit(2)) + F.pow(F.col("y") - F.floor(F.col("cy") + 0.5), F.lit(2))
    dot, ring = d2 <= radius * radius, d2 <= (radius + 1) * (radius + 1)
    gray = gray_map(F.col(column))
    paint = lambda n: F.when(dot, 255 if n == "r" else 0).when(ring, 255).otherwise(gray).cast("int").alias(n)
    return df.join(c, "image_id", "left").select("image_id", "x", "y", *[paint(n) for n in "rgb"])
