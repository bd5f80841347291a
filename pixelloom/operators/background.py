"""Background and foreground estimates: border likelihood, candidates, barriers, protection, soft masks. Numbers are fixed values; ``planes`` has
radii that follow an image's size and the centred form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalise import clamp01, mask_stats, percentile_stretch
from .stencil import box_blur, unsharp

PROTOTYPES = 96


def sizes(df: DataFrame) -> DataFrame:
    """Adds w and h of the image (one row an image is joined)."""
    s = df.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return df.join(s, "image_id")


def on_border(band: int) -> Column:
    return (F.col("x") < band) | (F.col("y") < band) | (F.col("x") + band >= F.col("w")) | (F.col("y") + band >= F.col("h"))


def border_likelihood(df: DataFrame, band: int = 3, radius: int = 4) -> DataFrame:
    """Adds border_bg: likeness in Lab to the nearest of at most 96 border pixels, taken at even steps, then blurred.

    Prototypes travel as one array an image, so that no pixel is multiplied by them.
    """
    df = sizes(df)
    w = Window.partitionBy("image_id").orderBy("y", "x")
    b = df.where(on_border(band)).withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("image_id")))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / PROTOTYPES))
    b = b.where((F.col("_k") % step == 0) & (F.col("_k") / step < PROTOTYPES))
    protos = b.groupBy("image_id").agg(F.collect_list(F.struct("lab_l", "lab_a", "lab_b")).alias("_p"))
    sq = lambda p, c, k: F.pow((F.col(f"lab_{c}") - p[f"lab_{c}"]) / k, F.lit(2.0))
    near = F.array_min(F.transform("_p", lambda p: sq(p, "l", 100.0) + sq(p, "a", 128.0) + sq(p, "b", 128.0)))
    raw = df.join(protos, "image_id").withColumn("border_bg", F.exp(-near / (0.16 * 0.16))).drop("_p")
    return box_blur(raw, ["border_bg"], radius)


def subject_prior(cx: float = 0.5, cy: float = 0.5, rx: float = 0.35, ry: float = 0.45) -> Column:
    """Gaussian centre bias; needs x, y, w, h."""
    dx, dy = ((F.col("x") + 0.5) / F.col("w") - cx) / max(rx, 1e-6), ((F.col("y") + 0.5) / F.col("h") - cy) / max(ry, 1e-6)
    return F.exp(-(dx * dx + dy * dy))


def candidate(threshold: float) -> Column:
    return F.when(F.col("border_bg") > threshold, 1.0).otherwise(0.0)


def barrier(stops: dict[str, float], relax: float) -> Column:
    """1 where a feature exceeds its stop, unless the pixel looks like the border."""
    hit = F.lit(False)
    for c, v in stops.items():
        hit = hit | (F.col(c) > v)
    return F.when(F.col("border_bg") >= relax, 0.0).when(hit, 1.0).otherwise(0.0)


def weighted(parts: list[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts)
    if total < 1e-12:
        return F.lit(0.0)
    out = parts[0][0] * parts[0][1]
    for c, w in parts[1:]:
        out = out + c * w
    return clamp01(out / total)


def protect(df: DataFrame, weights: dict[str, float], low: float = 70.0, high: float = 99.0) -> DataFrame:
    """Adds protect: weighted features, stretched so that only the strongest count."""
    s = F.lit(0.0)
    for c, w in weights.items():
        s = s + F.col(c) * w
    return percentile_stretch(df.withColumn("protect", s), "protect", low, high)


def soft_background(df: DataFrame, mask: str, weights: tuple[float, float, float] = (0.0, 0.08, 0.15)) -> DataFrame:
    """Adds soft_bg: border likelihood blended with the mask, the less the emptier the mask."""
    s = mask_stats(df, mask)
    j = df.join(s, "image_id")
    flat = F.col("kinds") <= 2
    w = F.when(flat & ((F.col("mean") <= 0.02) | (F.col("mean") >= 0.98)), weights[0]).when(flat, weights[1]).otherwise(weights[2])
    return j.withColumn("soft_bg", clamp01(F.col(mask) * w + F.col("border_bg") * (F.lit(1.0) - w))).drop("mean", "kinds")


def soft_foreground(df: DataFrame, radius: int = 6, sharpen: int = 2, amount: float = 0.5) -> DataFrame:
    """Adds soft_fg of soft_bg and subject: blended, blurred, sharpened, stretched."""
    f = df.withColumn("soft_fg", weighted([(F.lit(1.0) - F.col("soft_bg"), 0.45), (F.lit(0.5), 0.15), (F.col("subject"), 0.40)]))
    return percentile_stretch(unsharp(box_blur(f, ["soft_fg"], radius), "soft_fg", sharpen, amount), "soft_fg", 2.0, 98.0)
