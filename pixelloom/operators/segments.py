"""Region features, scores and weights: aggregates of labelled pixels, expressions over region rows, and lookups back to pixels.

Regions are rows (image_id, region, ...); a label's lookup is a join on (image_id, region), missing ones are 0.

Numbers in the expressions are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import colour as C

from .background import on_border
from .fusion import effective_areas
from .normalise import clamp01
from .partition import LAB, border_median_lab, lab_gap
from .stencil import boundary


# Parameters of region scores.
@dataclass(frozen=True)
class RegionParams:
    border_band: int = 8
    saliency_dct_weight: float = 0.20
    saliency_lab_grad_weight: float = 0.22
    saliency_spectral_weight: float = 0.28
    saliency_local_light_weight: float = 0.15
    saliency_local_sat_weight: float = 0.15
    bg_border_weight: float = 0.26
    bg_color_weight: float = 0.32
    bg_low_saliency_weight: float = 0.18
    bg_low_center_weight: float = 0.16
    bg_low_edge_weight: float = 0.08
    subject_center_weight: float = 0.35
    subject_saliency_weight: float = 0.45
    subject_edge_weight: float = 0.20
    subject_protect_strength: float = 0.55
    background_correction_strength: float = 0.00
    area_power: float = 0.55
    region_area_weight: float = 0.18
    region_subject_weight: float = 0.28
    region_saliency_mean_weight: float = 0.18
    region_saliency_peak_weight: float = 0.20
    region_foreground_weight: float = 0.20
    region_center_weight: float = 0.08
    region_saturation_weight: float = 0.12
    color_stability_weight: float = 0.30
    bg_probability_penalty_strength: float = 0.45
    bg_flat_penalty_strength: float = 0.55
    bg_flat_area_min_ratio: float = 0.08
    bg_flat_area_full_ratio: float = 0.35
    bg_flat_sat_threshold: float = 0.28
    subject_prominence_bonus_strength: float = 0.20
    min_region_area_ratio: float = 0.0015
    vivid_rg_bonus_strength: float = 0.12
    vivid_rg_sat_threshold: float = 0.45
    vivid_rg_hue_width: float = 38.0
    background_bias: str = "balanced"


# Parameters of the background's share in colours, and of the neutral background's suppression.
@dataclass(frozen=True)
class AmbientParams:
    enabled: bool = True
    strength: float = 0.10
    min_area_ratio: float = 0.26
    full_area_ratio: float = 0.85
    min_saturation: float = 0.08
    colorfulness_weight: float = 0.65
    tone_harmony_weight: float = 0.25
    stability_weight: float = 0.01
    max_weight: float = 0.30
    neutral_suppression_enabled: bool = True
    neutral_suppression_strength: float = 0.95
    neutral_sat_threshold: float = 0.12
    neutral_black_l_threshold: float = 18.0
    neutral_white_l_threshold: float = 85.0
    neutral_light_softness: float = 10.0
    neutral_bg_probability_threshold: float = 0.45
    neutral_min_effective_area_ratio: float = 0.05
    neutral_full_effective_area_ratio: float = 0.25


def step(low: float, high: float, v: Column) -> Column:
    """Smoothstep; a plain step where the edges don't rise."""
    return C.smoothstep(low, high, v) if high > low else F.when(v >= high, 1.0).otherwise(0.0)


def mean_of(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean in 0..1, weights below 0 as 0; without weights 0."""
    parts = [(c, w) for c, w in parts if w > 0]
    if not parts:
        return F.lit(0.0)
    total = parts[0][0] * parts[0][1]
    for c, w in parts[1:]:
        total = total + c * w
    return clamp01(total / sum(w for _, w in parts))


def within(v: Column, low: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), v))


def saliency(p: RegionParams = RegionParams()) -> Column:
    """Of feature columns dct, lab_grad, spectral, local_light, local_sat."""
    return mean_of([(F.col(c), getattr(p, f"saliency_{c}_weight")) for c in ("dct", "lab_grad", "spectral", "local_light", "local_sat")])


def boundary_map(label: str = "region") -> Column:
    """1 where a neighbour has another label, else a share of the edge strength."""
    return F.greatest(boundary(label).cast("double"), F.col("edge") * 0.65)


def region_rows(df: DataFrame, p: RegionParams = RegionParams()) -> DataFrame:
    """Region rows of labelled pixels: r, g, b in 0..1, lab_l, lab_a, lab_b, saliency, edge, subject, w, h."""
    hue_s = lambda: C.hsl(F.col("r"), F.col("g"), F.col("b"))
    agg = df.groupBy("image_id", "region").agg(
        F.count(F.lit(1)).alias("area"), (F.count(F.lit(1)) / F.max(F.col("w") * F.col("h"))).alias("area_ratio"),
        F.avg(on_border(max(1, p.border_band)).cast("double")).alias("border_ratio"), F.avg("subject").alias("center_prior"),
        F.avg("saliency").alias("saliency_mean"), F.max("saliency").alias("saliency_peak"), F.avg("edge").alias("edge_mean"),
        *[F.avg(c).alias(c) for c in ("r", "g", "b", *LAB)], *[F.var_pop(c).alias(f"var_{c}") for c in LAB],
    )
    rows = agg.join(border_median_lab(df, p.border_band), "image_id")
    spread = F.sqrt(sum(F.col(f"var_{c}") / k for c, k in zip(LAB, (10000.0, 16384.0, 16384.0), strict=True)))
    near = lab_gap([F.col(c) for c in LAB], [F.col(f"c_{c}") for c in LAB])
    hue, sat, _ = hue_s()
    rg = F.greatest(*[C.circular_affinity(hue, at, max(1.0, p.vivid_rg_hue_width)) for at in (0.0, 120.0)])
    rows = rows.withColumns({
        "color_stability": clamp01(1 - spread / 0.18), "border_color_similarity": clamp01(F.exp(-near / (0.18 * 0.18))),
        "mean_saturation": clamp01(sat), "red_green_affinity": rg,
    })
    salient = clamp01(F.col("saliency_mean") * 0.65 + F.col("saliency_peak") * 0.35)
    subject = mean_of([(F.col("center_prior"), p.subject_center_weight), (salient, p.subject_saliency_weight), (F.col("edge_mean"), p.subject_edge_weight)])
    back = mean_of([
        (F.col("border_ratio"), p.bg_border_weight), (F.col("border_color_similarity"), p.bg_color_weight), (1 - F.col("saliency_mean"), p.bg_low_saliency_weight),
        (1 - F.col("center_prior"), p.bg_low_center_weight), (1 - F.col("edge_mean"), p.bg_low_edge_weight),
    ])
    rows = rows.withColumns({"subject_raw": subject, "bg_raw": back})
    bias = {"subject": 1.20, "background": 0.82}.get(p.background_bias, 1.0)
    kept = clamp01(F.col("bg_raw") * (1 - F.col("subject_raw") * (clip(p.subject_protect_strength) * bias)))
    rows = rows.withColumn("bg_probability", clamp01(kept * 0.85 + F.col("bg_raw") * 0.15) if p.background_bias == "background" else kept)
    rows = rows.withColumn("subject_confidence", clamp01((1 - F.col("bg_probability")) * 0.55 + F.col("subject_raw") * 0.45))
    return rows.drop(*LAB, *[f"var_{c}" for c in LAB], *[f"c_{c}" for c in LAB], "subject_raw", "bg_raw")


def clip(v: float) -> float:
    return min(1.0, max(0.0, v))


def region_scores(rows: DataFrame, p: RegionParams = RegionParams()) -> DataFrame:
    """Region rows with background_penalty, vivid_rg_bonus and color_score."""
    c = F.col
    large = step(p.bg_flat_area_min_ratio, p.bg_flat_area_full_ratio, c("area_ratio"))
    dull = 1 - step(p.bg_flat_sat_threshold, p.bg_flat_sat_threshold + 0.10, c("mean_saturation"))
    vivid = clamp01((c("mean_saturation") - p.vivid_rg_sat_threshold) / max(1 - p.vivid_rg_sat_threshold, 1e-6))
    rows = rows.withColumns({"background_penalty": clamp01(large * c("color_stability") * dull), "vivid_rg_bonus": clamp01(large * vivid * c("red_green_affinity"))})
    area = F.pow(F.greatest(clamp01(c("area_ratio")), F.lit(1e-9)), F.lit(max(0.05, p.area_power)))
    mean, peak = clamp01(c("saliency_mean")), clamp01(c("saliency_peak"))
    base = mean_of([
        (clamp01(area), p.region_area_weight), (clamp01(c("subject_confidence")), p.region_subject_weight), (mean, p.region_saliency_mean_weight),
        (peak, p.region_saliency_peak_weight), (clamp01(1 - c("bg_probability")), p.region_foreground_weight),
        (clamp01(c("center_prior")), p.region_center_weight), (clamp01(c("mean_saturation")), p.region_saturation_weight),
    ])
    factors = [
        c("color_stability") * p.color_stability_weight + (1 - p.color_stability_weight),
        within(1 - c("background_penalty") * clip(p.bg_flat_penalty_strength), 0.02),
        within(1 - clamp01(c("bg_probability")) * (1 - clamp01(c("mean_saturation")) * 0.65) * clip(p.bg_probability_penalty_strength), 0.05),
        clamp01(c("subject_confidence")) * F.greatest(clamp01(mean * 0.60 + peak * 0.40), F.lit(0.05)) * max(0.0, p.subject_prominence_bonus_strength) + 1,
        c("vivid_rg_bonus") * max(0.0, p.vivid_rg_bonus_strength) + 1,
        step(p.min_region_area_ratio * 0.5, p.min_region_area_ratio, c("area_ratio")) if p.min_region_area_ratio > 0 else F.lit(1.0),
    ]
    score = base
    for f in factors:
        score = score * f
    return rows.withColumn("color_score", F.greatest(score, F.lit(0.0)))


def region_colour(scored: DataFrame) -> DataFrame:
    """image_id, region, r, g, b, score of the best region (ties: the first); black and no region where none scores."""
    best = scored.where("color_score > 0").groupBy("image_id").agg(F.max_by(F.struct("region", "r", "g", "b", "color_score"), F.struct("color_score", -F.col("region"))).alias("m"))
    images = scored.select("image_id").distinct()
    zero = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit(0.0))
    return images.join(best, "image_id", "left").select("image_id", F.col("m.region").alias("region"), *[zero(c).alias(c) for c in "rgb"], zero("color_score").alias("score"))


def lookup(pixels: DataFrame, rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """pixels with values of their region's row; 0 where there is none."""
    values = rows.select("image_id", "region", *[v.alias(k) for k, v in columns.items()])
    return pixels.join(values, ["image_id", "region"], "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in columns})


def painted(pixels: DataFrame, rows: DataFrame) -> DataFrame:
    """pixels with bg_probability, subject_confidence, the foreground that follows, and a ramp of region numbers."""
    many = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    out = lookup(pixels, rows, {"bg_probability": clamp01(F.col("bg_probability")), "subject_confidence": clamp01(F.col("subject_confidence"))}).join(many, "image_id", "left")
    ramp = F.when(F.col("_n") > 1, F.col("region") / (F.col("_n") - 1)).otherwise(0.0)
    fore = clamp01((1 - F.col("bg_probability")) * 0.65 + F.col("subject_confidence") * 0.35)
    return out.withColumns({"segment_foreground": fore, "region_id": ramp}).drop("_n")


def with_prior(foreground: Column, strength: float) -> Column:
    """A foreground blended with the segments' one."""
    s = clip(strength)
    return clamp01(foreground * (1 - s) + F.col("segment_foreground") * s)


def tones(rows: DataFrame) -> DataFrame:
    """image_id, and the regions' mean colours by area (t_) and by area and background probability (u_)."""
    w, u = F.col("area").cast("double"), F.col("area") * clamp01(F.col("bg_probability"))
    sums = [F.sum(F.col(c) * k).alias(f"{n}_{c}") for n, k in (("t", w), ("u", u)) for c in "rgb"]
    g = rows.groupBy("image_id").agg(*sums, F.sum(w).alias("_t"), F.sum(u).alias("_u"))
    t = {f"t_{c}": F.col(f"t_{c}") / F.col("_t") for c in "rgb"}
    g = g.withColumns(t)
    return g.withColumns({f"u_{c}": F.when(F.col("_u") > 1e-12, F.col(f"u_{c}") / F.when(F.col("_u") > 1e-12, F.col("_u"))).otherwise(F.col(f"t_{c}")) for c in "rgb"}).drop("_t", "_u")


def _areas(rows: DataFrame) -> DataFrame:
    """Region rows with effective: the larger of their own area and the background's of like tone."""
    return rows.join(effective_areas(rows), ["image_id", "region"]).withColumn("effective", F.greatest("area_ratio", "effective"))


def ambient_weights(rows: DataFrame, p: AmbientParams = AmbientParams()) -> DataFrame:
    """image_id, region, ambient: what a large, stable, coloured background keeps as weight in the image's colours."""
    if not p.enabled or p.strength <= 0:
        return rows.select("image_id", "region", F.lit(0.0).alias("ambient"))
    r = _areas(rows).join(tones(rows), "image_id")
    own = [F.col(c) for c in "rgb"]
    harmony = F.greatest(*[C.tone_affinity(own, [F.col(f"{n}_{c}") for c in "rgb"]) for n in "tu"])
    colour = F.lit(1.0) if p.min_saturation <= 1e-9 else step(0.0, max(1e-6, clip(p.min_saturation)), F.col("mean_saturation"))
    parts = [(colour, p.colorfulness_weight), (harmony, p.tone_harmony_weight), (clamp01(F.col("color_stability")), p.stability_weight)]
    quality = mean_of(parts) if sum(max(0.0, w) for _, w in parts) > 1e-12 else F.lit(1.0)
    gate = step(clip(p.min_area_ratio), clip(p.full_area_ratio), F.col("effective"))
    v = clamp01(F.col("bg_probability")) * gate * quality * clamp01(1 - F.col("subject_confidence")) * p.strength
    return r.select("image_id", "region", F.least(F.lit(clip(p.max_weight)), F.greatest(F.lit(0.0), v)).alias("ambient"))


def neutral_penalties(rows: DataFrame, p: AmbientParams = AmbientParams()) -> DataFrame:
    """image_id, region, penalty, and its parts: how much a large dull background is suppressed where it is near black or white."""
    if not p.neutral_suppression_enabled or p.neutral_suppression_strength <= 0:
        return rows.select("image_id", "region", *[F.lit(0.0).alias(c) for c in ("penalty", "area_gate", "bg_gate", "low_sat", "non_subject")])
    sat, bg = max(1e-6, clip(p.neutral_sat_threshold)), clip(p.neutral_bg_probability_threshold)
    r = _areas(rows).withColumns({
        "area_gate": step(clip(p.neutral_min_effective_area_ratio), clip(p.neutral_full_effective_area_ratio), F.col("effective")),
        "bg_gate": step(bg, min(1.0, bg + 0.25), F.col("bg_probability")), "low_sat": 1 - step(sat, min(1.0, sat + 0.10), F.col("mean_saturation")),
        "non_subject": step(0.20, 0.55, 1 - F.col("subject_confidence")),
    })
    penalty = F.col("area_gate") * F.col("bg_gate") * F.col("low_sat") * F.col("non_subject") * clip(p.neutral_suppression_strength)
    return r.select("image_id", "region", penalty.alias("penalty"), "area_gate", "bg_gate", "low_sat", "non_subject")


def neutral_suppression(penalty: Column, light: Column, p: AmbientParams = AmbientParams()) -> Column:
    """A pixel's suppression: its region's penalty where L* is near black or white."""
    soft = max(1e-6, p.neutral_light_softness)
    black = 1 - step(p.neutral_black_l_threshold, p.neutral_black_l_threshold + soft, light)
    white = step(p.neutral_white_l_threshold - soft, p.neutral_white_l_threshold, light)
    return clamp01(penalty * clamp01(F.greatest(black, white)))


def top_penalties(penalties: DataFrame, n: int = 12, least: float = 0.001) -> DataFrame:
    """The n largest penalties above ``least`` of each image, with their parts."""
    from pyspark.sql import Window

    w = Window.partitionBy("image_id").orderBy(F.desc("penalty"), "region")
    return penalties.where(F.col("penalty") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# Shares of separation, correlation with saliency, and separation from the background.
def region_dynamic_scores(pixels: DataFrame, features: list[str], weights: tuple[float, float, float] = (0.45, 0.35, 0.20)) -> DataFrame:
    """image_id, feature, region_score. pixels: region, saliency, bg_probability and the features."""
    long = pixels.unpivot(["image_id", "region", "saliency", "bg_probability"], features, "feature", "v")
    parts = long.groupBy("image_id", "feature", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    whole = parts.groupBy("image_id", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    mean = F.col("s") * F.col("s") / F.col("n")
    total = F.col("q") - mean
    whole = whole.select("image_id", "feature", F.when(total <= 1e-12, 0.0).otherwise(clamp01((F.col("b") - mean) / F.when(total > 1e-12, total))).alias("separation"))
    b = clamp01(F.col("bg_probability"))
    mean_by = lambda w: F.when(F.sum(w) > 1e-12, F.try_divide(F.sum(F.col("v") * w), F.sum(w)))
    apart = mean_by(1 - b) - mean_by(b)
    # a flat map has no correlation
    flat = (F.var_pop("v") <= 1e-12) | (F.var_pop("saliency") <= 1e-12)
    more = long.groupBy("image_id", "feature").agg(clamp01(F.coalesce(F.when(~flat, F.try_divide(F.covar_pop("v", "saliency"), F.stddev_pop("v") * F.stddev_pop("saliency"))), F.lit(0.0))).alias("correlation"), clamp01(F.coalesce(apart, F.lit(0.0)) / 0.45).alias("apart"))
    total_weight = sum(weights)
    score = sum(F.col(c) * w for c, w in zip(("separation", "correlation", "apart"), weights, strict=True))
    return whole.join(more, ["image_id", "feature"]).select("image_id", "feature", (clamp01(score / total_weight) if total_weight > 1e-12 else F.lit(0.0)).alias("region_score"))
