"""Whole programs: feature fusion with its colours, and impression colour.

Maps of an image are made on its planes in one task (``planes``; an image is bounded by max_dim), so that no map is shuffled; regions,
statistics, weights, fusion, filters and clusters are DataFrame operations on the maps, which are written once between them. Numbers in the
expressions are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import fusion as U
from pixelloom.operators import normalise as N
from pixelloom.operators import partition as T
from pixelloom.operators import planes as P
from pixelloom.operators import regions as R
from pixelloom.operators import segments as G
from pixelloom.operators import weighted as W
from pixelloom.operators.normalise import clamp01
from pixelloom.sources.images import resized
from pixelloom.sources.scratch import saved

from .params import FusionParams, ImpressionProgramParams, validated

LAB = ("lab_l", "lab_a", "lab_b")
#: What one task makes of an image, beside its colours.
FUSION_PLANES = (*U.FEATURES[:11], "subject_prior", "abs_light", "abs_lab_a", "abs_lab_b", "abs_sat", "edge", "mask_raw", "fg_raw", "bg_candidate", "bg_barrier", "mask_before", "protect", "mask_after")


def _maps(pixels: DataFrame, names: tuple[str, ...], make, whole: tuple[str, ...] = ()) -> DataFrame:
    """image_id, x, y, w, h, r, g, b (0..1), Lab and what ``make`` gives for an image (h, w, 3) of 8 bits."""
    values = [*"rgb", *LAB, *names]

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        w, h = int(t.x.max()) + 1, int(t.y.max()) + 1
        if len(t) != w * h:
            raise ValueError("the image has gaps")
        rgb = t[["r", "g", "b"]].to_numpy().reshape(h, w, 3)
        planes = P.lab_planes(rgb / 255)
        found = make(rgb, planes)
        out = {"image_id": t.image_id.to_numpy(), "x": t.x.to_numpy(), "y": t.y.to_numpy(), "w": w, "h": h}
        out |= {c: rgb[..., i].ravel() / 255 for i, c in enumerate("rgb")} | {c: p.ravel() for c, p in zip(LAB, planes, strict=True)}
        out |= {c: found[c].ravel().astype("int32" if c in whole else float) for c in (*names, *whole)}
        return pd.DataFrame(out)

    schema = "image_id long, x int, y int, w int, h int, " + ", ".join(f"{c} double" for c in values) + "".join(f", {c} int" for c in whole)
    return pixels.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(one, schema)


def _unit_ab(planes) -> tuple[np.ndarray, np.ndarray]:
    return (planes[1] + 128) / 256, (planes[2] + 128) / 256


def fusion_maps(pixels: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """Every map that needs an image as a whole, and the regions' labels."""
    bar, part = p.background.flood_barrier, p.background.partition
    part = replace(part, open_radius=p.background.morphology.open_radius, close_radius=p.background.morphology.close_radius, erode_radius=p.background.morphology.erode_radius)
    soft, sub = p.background.soft_mask, p.subject_prior

    def make(rgb: np.ndarray, planes) -> dict[str, np.ndarray]:
        unit = rgb / 255
        sat, light = P.hsl_planes(unit)
        a, b = _unit_ab(planes)
        s = lambda v: P.stretch(v, p.percentile.low, p.percentile.high)
        out = {
            "dct": s(P.complexity(P.gray(unit), p.dct.high_freq_threshold)), "lab_grad": s(P.lab_gradient(planes)),
            "spectral": s(P.spectral(planes, p.spectral_residual.mean_filter_kernel, p.spectral_residual.gaussian_sigma, p.spectral_residual.gamma, p.spectral_residual.post_gamma)),
        }
        channels = {"light": light, "lab_a": a, "lab_b": b, "sat": sat}
        for c, v in channels.items():
            out[f"global_{c}"] = s(P.global_residual(v, getattr(p.global_residual, c)))
            local = P.local_residual(v, p.gauss_sigma)
            out[f"local_{c}"] = s(local ** p.saturation.local_post_gamma if c == "sat" else local)
        out["subject_prior"] = s(P.prior(light.shape, sub.center_x, sub.center_y, sub.radius_x, sub.radius_y))
        out |= {"abs_light": s(planes[0]), "abs_lab_a": s(a), "abs_lab_b": s(b), "abs_sat": s(sat)}
        out["region"], out["edge"] = R.segment_planes(rgb, p.segment_fusion.segment)
        return out | _background(planes, out)

    def _background(planes, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        shape = planes[0].shape
        colour = np.maximum(f["local_lab_a"], f["local_lab_b"])
        names = ("bg_candidate", "bg_barrier", "mask_before", "protect", "mask_after")
        if not part.enabled:
            return dict.fromkeys(names, np.zeros(shape)) | dict.fromkeys(("mask_raw", "fg_raw"), np.ones(shape))
        border = P.border_likelihood(planes, part.border_band, soft.border_bg_blur_radius)
        candidate = border > bar.color_threshold
        stop = (f["lab_grad"] > bar.grad_stop) | (f["dct"] > bar.dct_stop) | (f["local_light"] > bar.local_light_stop) | (f["spectral"] > bar.spectral_stop)
        barrier = stop & (border < bar.barrier_color_relax_threshold) if bar.enabled else np.zeros(shape, bool)
        parts = ((f["lab_grad"], bar.protect_grad_weight), (f["dct"], bar.protect_dct_weight), (f["spectral"], bar.protect_spectral_weight), (f["local_light"], bar.protect_local_light_weight), (colour, bar.protect_local_sat_weight))
        protect = P.stretch(sum(v * k for v, k in parts), bar.protect_p_low, bar.protect_p_high)
        before = T.separated(planes, part, candidate, candidate & ~barrier).mask
        mask = (before * (1 - min(1.0, max(0.0, bar.protect_strength)) * protect)).clip(0, 1) if bar.enabled else before
        back = P.soft_background(mask, border, (0.0, 0.08, 0.15))
        fore = P.weighted([(1 - back, 0.45), (np.full(shape, 0.5), 0.15), (P.prior(shape), 0.40)])
        fore = P.unsharp(P.box(fore, P.adaptive(shape, 40, 6, 24, soft.fg_confidence_blur_radius)), max(1, soft.fg_confidence_sharpen_radius), soft.fg_confidence_sharpen_amount)
        fore = P.stretch(fore, 2.0, 98.0)
        hard = fore if not 0.02 < mask.mean() < 0.98 else ((1 - mask) * 0.20 + fore * 0.80).clip(0, 1)
        return {"bg_candidate": candidate, "bg_barrier": barrier, "mask_before": before, "protect": protect, "mask_after": mask, "mask_raw": hard, "fg_raw": fore}

    return _maps(resized(pixels, p.max_dim), FUSION_PLANES, make, ("region",))


def blended(names: list[str], p: FusionParams) -> tuple[Column, Column, Column]:
    """Sum, soft product and their blend of feature columns, with an image's weights in the map column _w."""
    add, mul = (lambda c, k=k: F.coalesce(F.col("_w")[c][k], F.lit(0.0)) for k in ("add_weight", "mul_weight"))
    total = lambda w: sum((w(c) for c in names[1:]), w(names[0]))
    e = p.fusion.epsilon
    ta, tm = total(add), total(mul)
    share = lambda s, t: F.when(t > 0, s / F.when(t > 0, t)).otherwise(0.0)
    a = share(sum((F.col(c) * add(c) for c in names[1:]), F.col(names[0]) * add(names[0])), ta)
    m = F.exp(share(sum((F.log(F.col(c) * (1 - e) + e) * mul(c) for c in names[1:]), F.log(F.col(names[0]) * (1 - e) + e) * mul(names[0])), tm))
    shaped = lambda v: clamp01(F.pow(v, F.lit(p.fusion.gamma)))
    return shaped(a), shaped(m), shaped(a * p.fusion.alpha + m * (1 - p.fusion.alpha))


@dataclass
class Fused:
    """What feature fusion gives: pixels with every map, region rows, weights with diagnostics, cluster rows, and colours."""

    pixels: DataFrame
    regions: DataFrame
    weights: DataFrame
    clusters: DataFrame
    colours: DataFrame


def fuse(pixels: DataFrame, p: FusionParams = FusionParams()) -> Fused:
    """pixels: image_id, x, y, r, g, b of 8 bits."""
    flt, rs, mix = validated(p.filter), p.segment_fusion.region_scoring, p.segment_fusion.dynamic_weights
    m = fusion_maps(pixels, p)
    # saliency looks at local colour in place of local saturation
    s = G.mean_of([(F.col(c), getattr(rs, f"saliency_{n}_weight")) for n, c in (("dct", "dct"), ("lab_grad", "lab_grad"), ("spectral", "spectral"), ("local_light", "local_light"))] + [(F.greatest("local_lab_a", "local_lab_b"), rs.saliency_local_sat_weight)])
    m = saved(m.withColumns({"saliency": s, "subject": F.col("subject_prior")}), "fusion-maps")
    regions = saved(G.region_scores(G.region_rows(m, rs), rs), "fusion-regions")
    m = G.painted(m, regions)
    strength = rs.background_correction_strength
    m = m.withColumns({"background_mask_morph": G.with_prior(F.col("mask_raw"), strength), "background_fg_confidence": G.with_prior(F.col("fg_raw"), strength)})
    m = saved(N.stretch_all(saved(m, "fusion-painted"), ["background_mask_morph", "background_fg_confidence"], p.percentile.low, p.percentile.high), "fusion-features")
    scores = G.region_dynamic_scores(m, [c for c in U.FEATURES if p.weights_add.get(c) or p.weights_mul.get(c)], (mix.separation_weight, mix.saliency_corr_weight, mix.bg_suppression_weight)) if mix.enabled else None
    off = p.static_features if p.dynamic_weights.enabled else tuple(U.FEATURES)
    weights = saved(U.dynamic_weights(m, p.weights_add, p.weights_mul, p.dynamic_weights, off, scores, (mix.pixel_stat_weight, mix.region_score_weight)), "fusion-weights")
    by_image = weights.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("add_weight", "mul_weight")))).alias("_w"))
    a, g, h = blended(list(U.FEATURES), p)
    m = saved(m.join(by_image, "image_id").withColumns({"fused_add": a, "fused_mul": g, "fused": h}).drop("_w"), "fusion-fused")
    f = m.withColumn("filtered", F.col("fused"))
    f = N.threshold_filter(f, "filtered", flt.threshold, flt.normalise) if flt.method == "threshold" else N.quantile_filter(f, "filtered", flt.quantile)
    f = N.stretch_positive(f, "filtered", flt.gamma, flt.least)
    amb = G.ambient_weights(regions, p.impression_background).join(G.neutral_penalties(regions, p.impression_background).select("image_id", "region", "penalty"), ["image_id", "region"])
    f = G.lookup(f, amb, {"ambient": F.col("ambient"), "penalty": F.col("penalty")})
    f = f.withColumn("suppression", G.neutral_suppression(F.col("penalty"), F.col("lab_l"), p.impression_background))
    f = f.withColumns({"weight": W.cluster_weight(F.col("filtered"), F.col("ambient"), F.col("suppression")), "hint": W.background_hint(F.col("mask_after"), F.col("bg_probability"), F.col("suppression"))})
    f = saved(f, "fusion-weighted")
    i = p.impression
    clusters = saved(W.scored_clusters(W.impression_clusters(f, i.k, i.max_iter, i.sample_stride, i.seed), i.cluster_scoring), "fusion-clusters")
    colours = W.winner(clusters).withColumn("kind", F.lit("weighted")).select("image_id", "kind", "r", "g", "b", "score")
    colours = colours.unionByName(G.region_colour(regions).select("image_id", F.lit("region").alias("kind"), "r", "g", "b", "score"))
    return Fused(f, regions, weights, clusters, colours)


IMPRESSION_PLANES = ("dct", "lab_grad", "spectral", "local_light", "local_sat", "border_bg", "bg_raw", "bg_mask", "fg_confidence", "saliency")


def impression_maps(pixels: DataFrame, p: ImpressionProgramParams = ImpressionProgramParams()) -> DataFrame:
    """Maps, background masks and foreground confidence, and the colour clusters' labels."""
    q, sr = p.soft_mask, p.spectral_residual

    def make(rgb: np.ndarray, planes) -> dict[str, np.ndarray]:
        unit, shape = rgb / 255, planes[0].shape
        sat, light = P.hsl_planes(unit)
        s = lambda v: P.stretch(v, p.percentile.low, p.percentile.high)
        out = {
            "dct": s(P.complexity(P.gray(unit))), "lab_grad": s(P.lab_gradient(planes)),
            "spectral": s(P.spectral(planes, sr.mean_filter_kernel, sr.gaussian_sigma, 1.0, sr.post_gamma, (sr.l_weight, sr.a_weight, sr.b_weight))),
            "local_light": s(P.local_residual(light, p.gauss_sigma)), "local_sat": s(P.local_residual(sat, p.gauss_sigma)),
        }
        subject = P.prior(shape, q.subject_center_x, q.subject_center_y, q.subject_radius_x, q.subject_radius_y)
        share = [(v, getattr(q, f"saliency_{c}")) for c, v in out.items()]
        total = sum(k for _, k in share)
        base = P.stretch(sum(v * k for v, k in share) / total, 5.0, 95.0) if total >= 1e-12 else np.zeros(shape)
        smooth = P.box(base, P.adaptive(shape, 24, 8, 32))
        salient = P.stretch(P.weighted([(base, q.saliency_base_weight), (smooth, q.saliency_smooth_weight), (subject, q.saliency_subject_weight)]), 2.0, 98.0) ** 0.85
        border = P.border_likelihood(planes, p.color_partition.border_band, centred=True)
        sep = T.separated(planes, p.color_partition)
        blend = (0.0, 0.40, 0.55)
        raw, clean = (P.soft_background(v, border, blend) for v in (sep.raw, sep.mask)) if p.color_partition.enabled else (border, border)
        fore = P.weighted([(1 - clean, q.foreground_color_weight), (salient, q.foreground_saliency_weight), (subject, q.foreground_subject_weight)])
        fore = P.stretch(P.box(fore, P.adaptive(shape, 40, 6, 24)), 2.0, 98.0)
        return out | {"border_bg": border, "bg_raw": raw if p.color_partition.enabled else 1 - fore, "bg_mask": 1 - fore, "fg_confidence": fore, "saliency": salient, "cluster": sep.labels}

    return _maps(resized(pixels, p.max_dim), IMPRESSION_PLANES, make, ("cluster",))


@dataclass
class Impression:
    pixels: DataFrame
    palette: DataFrame


def impression(pixels: DataFrame, p: ImpressionProgramParams = ImpressionProgramParams()) -> Impression:
    """pixels: image_id, x, y, r, g, b of 8 bits. Pixels with every map and their linear fusion, and the foreground's palette."""
    m = impression_maps(pixels, p)
    w = {c: getattr(p.feature_weights, c) for c in ("dct", "lab_grad", "spectral", "local_light", "local_sat", "bg_mask", "fg_confidence")}
    m = saved(m.withColumn("fused", U.linear([F.col(c) for c in w], list(w.values()))), "impression-maps")
    palette = W.foreground_palette(m.withColumn("fg", F.col("fg_confidence")), p.palette.algorithm, p.palette.n_colors, p.palette.min_fg_ratio)
    return Impression(m, palette)
