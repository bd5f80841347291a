"""Feature statistics, dynamic weights, fusion of feature maps, scores of clusters and regions, compositing. Numbers in the expressions are fixed
values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import colour as C

from .normalise import at_ranks, clamp01, min_max

#: Feature columns in their order.
FEATURES = "dct lab_grad spectral global_light global_lab_a global_lab_b global_sat local_light local_lab_a local_lab_b local_sat background_mask_morph background_fg_confidence subject_prior abs_light abs_lab_a abs_lab_b abs_sat segment_foreground".split()


# Defaults of dynamic weights.
@dataclass(frozen=True)
class DynamicParams:
    enabled: bool = False
    min_multiplier: float = 0.35
    max_multiplier: float = 1.80
    variance_ref: float = 0.05
    range_ref: float = 0.65
    peakiness_ref: float = 4.0
    eps: float = 1e-6
    mix_variance: float = 0.45
    mix_range: float = 0.35
    mix_peakiness: float = 0.20
    low: float = 2.0
    high: float = 98.0


def feature_stats(df: DataFrame, columns: list[str], p: DynamicParams = DynamicParams()) -> DataFrame:
    """image_id, feature, variance (clipped), p5, p95, range, mean, peakiness."""
    long = df.unpivot(["image_id"], columns, "feature", "v")
    rank = lambda q: F.least(F.floor(F.col("n") * (q / 100)), F.col("n") - 1)
    r = at_ranks(long, "v", {"_lo": rank(p.low), "_hi": rank(p.high), "p5": rank(5.0), "p95": rank(95.0)}, ("image_id", "feature"))
    j = long.join(r, ["image_id", "feature"])  # one row a feature of an image
    clipped = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("v")))
    g = j.groupBy("image_id", "feature").agg(F.var_pop(clipped).alias("variance"), F.max("p5").alias("p5"), F.max("p95").alias("p95"), F.avg("v").alias("mean"))
    peak = F.greatest(F.lit(0.0), F.col("p95") / (F.col("mean") + p.eps) - 1)
    return g.withColumns({"range": F.col("p95") - F.col("p5"), "peakiness": F.when(F.col("mean") + p.eps > 0, peak).otherwise(0.0)})


def pixel_score(p: DynamicParams = DynamicParams()) -> Column:
    """How telling a feature's statistics are, 0 to 1."""
    part = lambda c, ref: clamp01(F.col(c) / ref)
    return clamp01(part("variance", p.variance_ref) * p.mix_variance + part("range", p.range_ref) * p.mix_range + part("peakiness", p.peakiness_ref) * p.mix_peakiness)


def dynamic_weights(df: DataFrame, add: dict[str, float], mul: dict[str, float] | None = None, p: DynamicParams = DynamicParams(), off: tuple[str, ...] = (), regions: DataFrame | None = None, shares: tuple[float, float] = (0.65, 0.35)) -> DataFrame:
    """A row for each image and feature: base weights, statistics, scores, multiplier, and the weights that follow.

    A feature without base weight is reported with zeros, and its column is never read; one that is ``off`` has multiplier 1.
    ``regions`` (image_id, feature, region_score) is mixed with the pixels' score.
    """
    mul = mul or {}
    names = list(dict.fromkeys([*add, *mul]))
    used = [c for c in names if add.get(c) or mul.get(c)]
    stats = ["variance", "p5", "p95", "range", "mean", "peakiness"]
    base = lambda w: F.create_map(*[x for c in names for x in (F.lit(c), F.lit(float(w.get(c) or 0)))])[F.col("feature")]
    s = feature_stats(df, used, p).withColumn("pixel_score", pixel_score(p))
    if regions is not None:
        s = s.join(regions, ["image_id", "feature"], "left").withColumn("region_score", F.coalesce("region_score", F.lit(0.0)))
        total = sum(shares)
        score = clamp01((F.col("pixel_score") * shares[0] + F.col("region_score") * shares[1]) / total) if total > 1e-12 else F.col("pixel_score")
    else:
        s, score = s.withColumn("region_score", F.lit(0.0)), F.col("pixel_score")
    still = F.col("feature").isin(*off) if off else F.lit(False)
    s = s.withColumns({"score": F.when(still, 0.0).otherwise(score), "pixel_score": F.when(still, 0.0).otherwise(F.col("pixel_score")), "region_score": F.when(still, 0.0).otherwise(F.col("region_score"))})
    s = s.withColumn("multiplier", F.when(still, 1.0).otherwise(F.col("score") * (p.max_multiplier - p.min_multiplier) + p.min_multiplier))
    columns = ["image_id", "feature", *stats, "pixel_score", "region_score", "score", "multiplier"]
    out, unused = s.select(*columns), [c for c in names if c not in used]
    if unused:
        none = df.select("image_id").distinct().select("image_id", F.explode(F.array(*map(F.lit, unused))).alias("feature"), *[F.lit(0.0).alias(c) for c in columns[2:]])
        out = out.unionByName(none)
    out = out.withColumns({"base_add": base(add), "base_mul": base(mul)})
    return out.withColumns({"add_weight": F.col("base_add") * F.col("multiplier"), "mul_weight": F.col("base_mul") * F.col("multiplier")})


def hybrid(values: list[Column], add: list[float], mul: list[float], alpha: float = 0.10, gamma: float = 2.5, eps: float = 0.10) -> tuple[Column, Column, Column]:
    """Sum, soft product, and their blend, each with gamma, of feature maps. No weight: sum 0, product 1."""
    ta, tm = sum(add), sum(mul)
    a, g = F.lit(0.0), F.lit(0.0)
    for v, x, y in zip(values, add, mul, strict=True):
        if ta > 0 and x:
            a = a + v * (x / ta)
        if tm > 0 and y:
            g = g + F.log(v * (1 - eps) + eps) * (y / tm)
    m = F.exp(g)
    shaped = lambda c: clamp01(F.pow(c, F.lit(gamma)))
    return shaped(a), shaped(m), shaped(a * alpha + m * (1 - alpha))


def linear(values: list[Column], weights: list[float]) -> Column:
    out = F.lit(0.0)
    for v, w in zip(values, weights, strict=True):
        if w:
            out = out + v * (w / sum(weights))
    return clamp01(out)


def masked(df: DataFrame, weight: str, normalised: bool = False) -> DataFrame:
    """df with r, g, b (0..1) times a map; ``normalised`` stretches an image's map to 0..1 first."""
    if normalised:
        df = min_max(df.withColumn("_m", F.col(weight)), "_m")
    w = clamp01(F.col("_m" if normalised else weight))
    out = df.withColumns({c: clamp01(F.col(c) * w) for c in "rgb"})
    return out.drop("_m") if normalised else out


# Defaults of cluster scores.
@dataclass(frozen=True)
class ScoreParams:
    enabled: bool = True
    area_power: float = 0.45
    mean_power: float = 1.0
    peak_power: float = 0.80
    area_weight: float = 0.45
    mean_weight: float = 0.35
    peak_weight: float = 0.20
    saturation_bonus: float = 0.25
    neutral_strength: float = 0.75
    neutral_sat: float = 0.16
    neutral_min_area: float = 0.08
    neutral_full_area: float = 0.35
    background_strength: float = 0.35
    min_area: float = 0.002
    skin_strength: float = 0.0


def cluster_score(p: ScoreParams = ScoreParams()) -> Column:
    """Final score of cluster rows: r, g, b (0..1), area_ratio, weight_sum, mean_weight, p90_weight, background_mean."""
    if not p.enabled:
        return F.col("weight_sum")
    c, power = F.col, lambda n, e: F.pow(clamp01(F.col(n)), F.lit(max(e, 1e-6)))
    sat = clamp01(C.saturation(c("r"), c("g"), c("b")))
    base = (power("area_ratio", p.area_power) * p.area_weight + power("mean_weight", p.mean_power) * p.mean_weight + power("p90_weight", p.peak_power) * p.peak_weight) / (p.area_weight + p.mean_weight + p.peak_weight)
    clip = lambda v, low: F.greatest(F.lit(low), F.least(F.lit(1.0), v))
    low_sat = F.lit(1.0) - C.smoothstep(p.neutral_sat, p.neutral_sat + 0.10, sat)
    neutral = clip(F.lit(1.0) - low_sat * C.smoothstep(p.neutral_min_area, p.neutral_full_area, c("area_ratio")) * p.neutral_strength, 0.02)
    back = clip(F.lit(1.0) - clamp01(c("background_mean")) * (F.lit(1.0) - sat * 0.65) * p.background_strength, 0.05)
    skin = clip(F.lit(1.0) - C.skin(c("r"), c("g"), c("b")) * p.skin_strength, 0.02)
    gate = C.smoothstep(p.min_area * 0.5, p.min_area, c("area_ratio")) if p.min_area > 0 else F.lit(1.0)
    return base * (sat * p.saturation_bonus + 1) * neutral * back * skin * gate


def effective_areas(regions: DataFrame) -> DataFrame:
    """image_id, region, effective: background area of like tone, over all regions of the image. Regions are few: they
    travel as one array an image."""
    lists = regions.groupBy("image_id").agg(F.collect_list(F.struct("r", "g", "b", "area_ratio", "bg_probability")).alias("_all"))
    near = lambda o: C.tone_affinity([F.col(k) for k in "rgb"], [o[k] for k in "rgb"])
    total = F.aggregate("_all", F.lit(0.0), lambda s, o: s + o["area_ratio"] * clamp01(o["bg_probability"]) * near(o))
    return regions.join(lists, "image_id").select("image_id", "region", clamp01(total).alias("effective"))


def luma(rgb: Column) -> Column:
    return rgb["r"] * 0.299 + rgb["g"] * 0.587 + rgb["b"] * 0.114


def composite(layers: DataFrame, mode: str = "add", threshold: float = 16.0, result_threshold: float = 0.0) -> DataFrame:
    """image_id, x, y, r, g, b: layers (layer, r, g, b, weight) added to black, or multiplied into white, in order.

    A layer's pixel below the luma threshold changes nothing. Buffers have 8 bits, so each layer rounds and saturates. Pixels of the result
    below its threshold become black.
    """
    channels = "rgb"
    s = F.array_sort(F.collect_list(F.struct("layer", *channels, "weight")))
    start = F.struct(*[F.lit(255.0 if mode == "multiply" else 0.0).alias(c) for c in channels])

    def step(acc: Column, x: Column) -> Column:
        def one(c: str) -> Column:
            v = acc[c] * F.pow(x[c] / 255.0, x["weight"]) if mode == "multiply" else F.least(F.lit(255.0), acc[c] + x[c] * x["weight"])
            return F.when(luma(x) < threshold, acc[c]).otherwise(F.floor(v + 0.5).cast("double")).alias(c)

        return F.struct(*[one(c) for c in channels])

    g = layers.groupBy("image_id", "x", "y").agg(F.aggregate(s, start, step).alias("v"))
    dark = luma(F.col("v")) < result_threshold if result_threshold > 0 else F.lit(False)
    return g.select("image_id", "x", "y", *[F.when(dark, 0).otherwise(F.col(f"v.{c}").cast("int")).alias(c) for c in channels])


def scaled_to_first(layers: DataFrame) -> DataFrame:
    """layers with every layer's pixels drawn at the size of the image's first layer (nearest sample)."""
    size = layers.groupBy("image_id", "layer").agg((F.max("x") + 1).alias("lw"), (F.max("y") + 1).alias("lh"))
    first = size.groupBy("image_id").agg(F.min_by("lw", "layer").alias("w"), F.min_by("lh", "layer").alias("h"))
    sized = layers.join(size, ["image_id", "layer"]).join(first, "image_id")
    # which places of the first layer's grid a pixel is the sample of: x with floor((x + 1/2) lw / w) its own
    span = lambda at, own, out: F.filter(F.sequence(F.floor(F.col(at) * F.col(out) / F.col(own)).cast("int") - 1, F.ceil((F.col(at) + 1) * F.col(out) / F.col(own)).cast("int") + 1), lambda i: (i >= 0) & (i < F.col(out)) & (F.floor((i + 0.5) * F.col(own) / F.col(out)) == F.col(at)))
    wide = sized.withColumn("_x", F.explode(span("x", "lw", "w"))).withColumn("_y", F.explode(span("y", "lh", "h")))
    return wide.drop("x", "y", "lw", "lh", "w", "h").withColumnsRenamed({"_x": "x", "_y": "y"})
