"""Colours of weighted pixels: weighted k-means with its own seeding, the choice of a cluster by score, foreground palettes.

Clustering needs all sampled pixels of an image in turn, so an image is one group (at most max_dim squared pixels); choosing a cluster
and foreground gates are aggregates and expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import colour as C

from .fusion import ScoreParams, cluster_score
from .normalise import at_ranks, clamp01

#: A linear congruential generator of 64 bits.
_ADD, _MULTIPLY = 1442695040888963407, 6364136223846793005


def uniform(seed: int):
    """Numbers in 0..1 of the generator."""
    state = seed + _ADD & (1 << 64) - 1
    while True:
        state = state * _MULTIPLY + _ADD & (1 << 64) - 1
        yield (state >> 11) / (1 << 53)


def seeded(p: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres: the first point, then points drawn by squared distance to the nearest centre. Points that all coincide
    repeat the first."""
    draw = uniform(seed)
    next(draw)
    centres, d = [p[0]], np.full(len(p), np.inf)
    while len(centres) < k:
        d = np.minimum(d, ((p - centres[-1]) ** 2).sum(1))
        total = d.sum()
        if total <= 0:
            return np.array(centres + [centres[0]] * (k - len(centres)))
        at = np.searchsorted(np.cumsum(d), next(draw) * total)
        centres.append(p[min(int(at), len(p) - 1)])
    return np.array(centres)


def nearest(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((p - c) ** 2).sum(1) for c in centres]).argmin(0)


def weighted_kmeans(p: np.ndarray, w: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres: points go to the nearest centre, centres to the weighted mean, until no label changes (all start as 0)."""
    label, centres = np.zeros(len(p), np.int64), centres.copy()
    for _ in range(rounds):
        new = nearest(p, centres)
        if (new == label).all():
            break
        label = new
        total = np.bincount(label, w, len(centres))
        mean = np.stack([np.bincount(label, w * p[:, c], len(centres)) for c in range(3)], 1)
        full = total > 0
        centres[full] = mean[full] / total[full, None]
    return label, centres


ASSIGNED = "image_id long, cluster int, r double, g double, b double, weight double, hint double"


def impression_clusters(pixels: DataFrame, k: int = 8, rounds: int = 10, stride: int = 2, seed: int = 42, normalised: bool = False) -> DataFrame:
    """image_id, cluster, centre, and each sampled pixel's weight and hint. pixels: x, y, r, g, b in 0..1, weight, hint.

    Pixels of a regular grid with positive weight take part. With no more of them than clusters, they are one cluster at their
    weighted mean. ``normalised`` stretches the weights of the image first.
    """
    weight = clamp01(F.col("weight"))
    if normalised:
        s = pixels.groupBy("image_id").agg(F.min("weight").alias("_lo"), F.max("weight").alias("_hi"))
        pixels = pixels.join(s, "image_id")
        weight = clamp01((F.col("weight") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-12)))
    step = max(1, stride)
    some = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).select("image_id", "x", "y", "r", "g", "b", weight.alias("weight"), clamp01(F.coalesce("hint", F.lit(0.0))).alias("hint")).where("weight > 0")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        p, w = t[["r", "g", "b"]].to_numpy(float), t.weight.to_numpy(float)
        if len(p) <= k:
            label, centres = np.zeros(len(p), np.int64), np.average(p, axis=0, weights=w)[None]
        else:
            label, centres = weighted_kmeans(p, w, seeded(p, k, seed), rounds)
        c = centres[label]
        return pd.DataFrame({"image_id": t.image_id.to_numpy(), "cluster": label.astype("int32"), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2], "weight": w, "hint": t.hint.to_numpy(float)})

    return some.groupBy("image_id").applyInPandas(one, ASSIGNED)


def cluster_rows(assigned: DataFrame) -> DataFrame:
    """Rows of clusters (image_id, cluster, r, g, b, weight, hint): share of samples, sum, mean, 0.9 rank percentile and largest of the
    weights, mean hint."""
    peak = at_ranks(assigned, "weight", {"p90_weight": F.floor((F.col("n") - 1) * 0.90 + 0.5)}, ("image_id", "cluster"))
    g = assigned.groupBy("image_id", "cluster").agg(
        *[F.first(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight_sum"),
        F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"), F.avg("hint").alias("background_mean"),
    )
    g = g.withColumn("area_ratio", F.col("count") / F.sum("count").over(Window.partitionBy("image_id")))
    return g.join(peak, ["image_id", "cluster"])


def scored_clusters(assigned: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """Cluster rows with score and hex (channels truncated)."""
    u8 = [C.to_u8(F.col(c), False) for c in "rgb"]
    return cluster_rows(assigned).withColumns({"score": cluster_score(p), "hex": C.hexed(*u8)})


def winner(scored: DataFrame) -> DataFrame:
    """image_id, cluster, r, g, b, hex, score of the best cluster (ties: the last)."""
    best = F.max_by(F.struct("cluster", "r", "g", "b", "hex", "score"), F.struct("score", "cluster")).alias("m")
    return scored.groupBy("image_id").agg(best).select("image_id", "m.*")


def cluster_weight(filtered: Column, ambient: Column, suppression: Column) -> Column:
    """A pixel's weight in the colour clusters."""
    return clamp01(clamp01(filtered + ambient) * (1 - clamp01(suppression)))


def background_hint(mask: Column, segment: Column, neutral: Column) -> Column:
    """How far a pixel counts as background of its cluster."""
    return clamp01(clamp01(mask) * 0.55 + clamp01(segment) * 0.25 + clamp01(neutral) * 0.20)


# -- palettes of the foreground ---------------------------------------------------------------------------------

TRAIN = 20_000


def foreground_gate(pixels: DataFrame, min_fg_ratio: float = 0.05) -> DataFrame:
    """pixels with gate: the confidence (column fg) as weight, pixels with none left out; all pixels alike where an image's confidence
    sums up to less than a share of its pixels."""
    w = clamp01(F.col("fg"))
    gate = F.when(w > 1e-6, w)
    s = pixels.groupBy("image_id").agg(F.coalesce(F.sum(gate), F.lit(0.0)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    all_alike = (F.col("_s") <= 0) | (F.col("_s") < F.col("_n") * min(1.0, max(0.0, min_fg_ratio)))
    return pixels.join(s, "image_id").withColumn("gate", F.when(all_alike, 1.0).otherwise(gate)).where("gate is not null").drop("_s", "_n")


def even_sample(n: int, most: int) -> np.ndarray:
    """Places spread evenly over 0..n, at most so many."""
    return np.arange(n) if n <= most else np.minimum(((np.arange(most) + 0.5) * n / most).astype(np.int64), n - 1)


def palette_kmeans(p: np.ndarray, w: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Labels: trained on an even sample, seeds drawn by weight and by weighted squared distance, every point then goes to the
    nearest centre."""
    rng = np.random.default_rng(seed)
    some = even_sample(len(p), TRAIN)
    q, v = p[some], w[some]
    draw = lambda mass: min(int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum())), len(mass) - 1)
    centres, d = [q[draw(v) if v.sum() >= 1e-10 else 0]], np.full(len(q), np.inf)
    while len(centres) < k:
        d = np.minimum(d, ((q - centres[-1]) ** 2).sum(1))
        if (d * v).sum() < 1e-30:
            break
        centres.append(q[draw(d * v)])
    centres, label = np.array(centres), np.full(len(q), -1)
    for _ in range(20):
        new = nearest(q, centres)
        if (new == label).all():
            break
        label = new
        total = np.bincount(label, v, len(centres))
        full = total > 0
        centres[full] = np.stack([np.bincount(label, v * q[:, c], len(centres)) for c in range(3)], 1)[full] / total[full, None]
    return nearest(p, centres)


def budget_cut(p: np.ndarray, k: int, depth: int = 10) -> np.ndarray:
    """Labels: halved at the middle pixel of the widest channel (ties: the first); the left half gets the larger half of the colours left."""
    label, leaves = np.zeros(len(p), np.int64), 0
    todo = [(np.arange(len(p)), k, 0)]
    while todo:
        own, left, level = todo.pop()
        if len(own) <= 1 or left <= 1 or level > depth:
            label[own] = leaves
            leaves += 1
            continue
        order = own[np.argsort(p[own, int(np.ptp(p[own], axis=0).argmax())], kind="stable")]
        half, share = len(order) // 2, (left + 1) // 2
        todo += [(order[half:], left - share, level + 1), (order[:half], share, level + 1)]
    return label


PALETTE = "image_id long, entry int, r double, g double, b double, hex string, proportion double"


def foreground_palette(pixels: DataFrame, algorithm: str = "kmeanspp", n_colors: int = 1, min_fg_ratio: float = 0.05) -> DataFrame:
    """image_id, entry, r, g, b, hex, proportion, by proportion. pixels: x, y, r, g, b in 0..1, fg.

    minibatch is kmeanspp; octree is mediancut with equal weights; unknown names are kmeanspp.
    """
    gated = foreground_gate(pixels, min_fg_ratio).select("image_id", "x", "y", "r", "g", "b", "gate")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        p, w = t[["r", "g", "b"]].to_numpy(float), t.gate.to_numpy(float)
        k = max(1, min(n_colors, len(p)))
        if algorithm == "octree":
            w = np.ones(len(p))
        label = budget_cut(p, k) if algorithm in ("mediancut", "octree") else palette_kmeans(p, w, k)
        total = np.bincount(label, w)
        mean = np.stack([np.bincount(label, w * p[:, c]) for c in range(3)], 1) / np.maximum(total, 1e-10)[:, None]
        order = np.argsort(-total, kind="stable")[: max(1, n_colors)]
        u8 = np.floor(mean.clip(0, 1) * 255).astype(int)
        rows = [(int(t.image_id.iloc[0]), e, *map(float, mean[i]), "#%02x%02x%02x" % tuple(u8[i]), float(total[i] / max(w.sum(), 1e-10))) for e, i in enumerate(order)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PALETTE.split(", ")])

    return gated.groupBy("image_id").applyInPandas(one, PALETTE)
