"""Background separation by colour: variance-driven median cut, merging of small clusters, background scores, flood, guards.

Cutting and scoring exist twice: level by level over pixel tables of all images (``cut_paths``, ``cluster_scores``), and per image
on planes (``separated``), which is what programs use. Merges depend on their order; they run on cluster rows, of which an image has at
most 2^depth.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.sources.scratch import saved

from . import planes as P
from .background import on_border
from .normalise import at_ranks, clamp01

LAB = ("lab_l", "lab_a", "lab_b")
SCALE = (100.0, 128.0, 128.0)


# Parameters of separation.
@dataclass(frozen=True)
class PartitionParams:
    enabled: bool = True
    max_clusters: int = 16
    max_depth: int = 5
    variance_threshold: float = 0.01
    min_cluster_area_ratio: float = 0.005
    border_band: int = 12
    bg_score_threshold: float = 0.50
    bg_connect_threshold: float = 0.08
    max_bg_ratio: float = 0.85
    open_radius: int = 2
    close_radius: int = 2
    erode_radius: int = 1


# -- over pixel tables ------------------------------------------------------------------------------------------


def cut_paths(df: DataFrame, depth: int = 5, threshold: float = 0.01) -> DataFrame:
    """df (image_id, lab_l, lab_a, lab_b, ...) with path: which side of each upper median a pixel is on.

    A cluster is halved on its channel of highest variance while it has two pixels, enough variance, and neither side has more than
    95 %. One round a level cuts all clusters of all images; tables are written between rounds.
    """
    df = df.withColumns({"path": F.lit(""), "_open": F.lit(True)})
    for _ in range(depth):
        var = {c: F.var_pop(c).alias(f"_v_{c}") for c in LAB}
        stats = df.where("_open").groupBy("image_id", "path").agg(F.count(F.lit(1)).alias("_n"), *var.values())
        l, a, b = (F.col(f"_v_{c}") for c in LAB)
        stats = stats.where((F.col("_n") > 1) & (l + a + b >= threshold)).withColumn("_axis", F.when((l >= a) & (l >= b), 0).when(a >= b, 1).otherwise(2)).select("image_id", "path", "_n", "_axis")
        # a cluster is gathered by no task: equal values are counted first, and joins carry one row a cluster
        value = F.when(F.col("_axis") == 0, F.col("lab_l")).when(F.col("_axis") == 1, F.col("lab_a")).otherwise(F.col("lab_b"))
        own = df.join(stats, ["image_id", "path"], "left").withColumn("_value", value)
        middle = at_ranks(own.where("_open and _axis is not null"), "_value", {"_middle": F.floor(F.col("n") / 2)}, ("image_id", "path"))
        own = saved(own.join(middle, ["image_id", "path"], "left").withColumn("_left", F.col("_value") <= F.col("_middle")), "cut-level")
        share = own.where("_middle is not null").groupBy("image_id", "path").agg(F.avg(F.col("_left").cast("double")).alias("_share"))
        own = own.join(share, ["image_id", "path"], "left")
        cut = F.col("_share").isNotNull() & (F.col("_share") > 0) & (F.col("_share") < 1) & (F.greatest("_share", 1 - F.col("_share")) <= 0.95) & F.col("_open")
        own = own.withColumn("_open", cut).withColumn("path", F.when(cut, F.concat("path", F.when(F.col("_left"), "0").otherwise("1"))).otherwise(F.col("path")))
        df = saved(own.drop("_n", "_axis", "_value", "_middle", "_left", "_share"), "cut-level")
    return df.drop("_open")


def border_median_lab(df: DataFrame, band: int) -> DataFrame:
    """image_id and the upper medians of the border's L*, a*, b* (c_lab_l ...). df has w and h."""
    border = df.where(on_border(max(1, band))).unpivot(["image_id"], list(LAB), "c", "v")
    middle = at_ranks(border, "v", {"m": F.floor(F.col("n") / 2)}, ("image_id", "c"))
    return middle.groupBy("image_id").agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(f"c_{c}") for c in LAB])


def lab_gap(a: list, b: list):
    """Squared distance in Lab, channels scaled."""
    return sum(((x - y) / s) * ((x - y) / s) for x, y, s in zip(a, b, SCALE, strict=True))


def cluster_stats(df: DataFrame, cluster: str = "cluster", band: int = 12) -> DataFrame:
    """Cluster rows: n, share of the border, mean and variance of each channel, mean colour. df has w and h."""
    colours = [F.avg(c).alias(f"mean_{c}") for c in ("r", "g", "b") if c in df.columns]
    return df.groupBy("image_id", cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(on_border(max(1, band)).cast("double")).alias("border_share"),
        *[F.avg(c).alias(f"mean_{c}") for c in LAB], *[F.var_pop(c).alias(f"var_{c}") for c in LAB], *colours,
    )


def cluster_scores(df: DataFrame, cluster: str = "cluster", band: int = 12) -> DataFrame:
    """Cluster rows with bg_score: the border's share of it, and how near it is to the border's median colour."""
    rows = cluster_stats(df, cluster, band).join(border_median_lab(df, band), "image_id")
    gap = F.sqrt(lab_gap([F.col(f"mean_{c}") for c in LAB], [F.col(f"c_{c}") for c in LAB]))
    return rows.withColumn("bg_score", clamp01(F.col("border_share") * 0.6 + clamp01(1 - gap) * 0.4)).drop(*[f"c_{c}" for c in LAB])


def background_mask(df: DataFrame, scores: DataFrame, threshold: float, cluster: str = "cluster") -> DataFrame:
    """df with mask: 1 where the pixel's cluster scores as background."""
    flags = scores.select("image_id", cluster, F.when(F.col("bg_score") >= threshold, 1.0).otherwise(0.0).alias("mask"))
    return df.join(flags, ["image_id", cluster])


def painted(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """image_id, x, y, r, g, b: every pixel in its cluster's mean colour."""
    mean = df.groupBy("image_id", cluster).agg(*[F.avg(c).alias(c) for c in "rgb"])
    return df.select("image_id", "x", "y", cluster).join(mean, ["image_id", cluster]).drop(cluster)


def nearest_pairs(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    """image_id, cluster, nearest, gap: each cluster's nearest other one of its image (ties: the first)."""
    other = clusters.select("image_id", F.col(cluster).alias("nearest"), *[F.col(f"mean_{c}").alias(f"o_{c}") for c in LAB])
    gap = lab_gap([F.col(f"mean_{c}") for c in LAB], [F.col(f"o_{c}") for c in LAB])
    pairs = clusters.join(other, "image_id").where(F.col(cluster) != F.col("nearest")).withColumn("gap", gap)
    best = pairs.groupBy("image_id", cluster).agg(F.min(F.struct("gap", "nearest")).alias("m"))
    return best.select("image_id", cluster, F.col("m.nearest").alias("nearest"), F.col("m.gap").alias("gap"))


MERGED = "image_id long, path string, cluster int"


def merged_paths(df: DataFrame, ratio: float, most: int) -> DataFrame:
    """image_id, path, cluster: paths of ``cut_paths`` after merging. An image's clusters, at most 2^depth rows, are one group."""
    rows = df.groupBy("image_id", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in LAB])

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("path")
        label = merge_clusters(t.n.to_numpy(), t[list(LAB)].to_numpy(), ratio, most)
        return pd.DataFrame({"image_id": t.image_id, "path": t.path, "cluster": label.astype("int32")})

    return rows.groupBy("image_id").applyInPandas(one, MERGED)


# -- on rows of clusters and planes of one image ----------------------------------------------------------------


def merge_clusters(n: np.ndarray, sums: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """The merged cluster of each cluster, in order: first those below ``ratio`` of all pixels go to their nearest large one, then the
    smallest go to their nearest one until ``most`` are left. Means follow every merge."""
    n, sums = n.astype(float).copy(), sums.astype(float).copy()
    label, alive = np.arange(len(n)), list(range(len(n)))
    least = int(n.sum() * ratio)

    def nearest(i: int, others: list[int]) -> int | None:
        if not others:
            return None
        mean = sums[others] / n[others, None]
        return others[int((((mean - sums[i] / n[i]) / SCALE) ** 2).sum(1).argmin())]

    def give(i: int, j: int) -> None:
        n[j] += n[i]
        sums[j] += sums[i]
        label[label == i] = j
        alive.remove(i)

    if least >= 2:
        for i in range(len(n)):
            to = nearest(i, [j for j in alive if j != i and n[j] >= least]) if n[i] < least else None
            if to is not None:
                give(i, to)
    while len(alive) > max(1, most):
        i = min(alive, key=lambda j: n[j])
        give(i, nearest(i, [j for j in alive if j != i]))
    return np.searchsorted(alive, label)


def cut_labels(lab: np.ndarray, depth: int, threshold: float) -> np.ndarray:
    """``cut_paths`` of one image's pixels (n, 3): leaf numbers in path order."""
    label = np.zeros(len(lab), np.int64)
    leaves = 0
    todo = [(np.arange(len(lab)), 0)]
    while todo:
        own, level = todo.pop()
        p = lab[own]
        var = p.var(0) if len(own) else np.zeros(3)
        if len(own) > 1 and level < depth and var.sum() >= threshold:
            v = p[:, int(var.argmax())]
            left = v <= np.partition(v, len(v) // 2)[len(v) // 2]
            if 0 < left.sum() < len(left) and max(left.mean(), 1 - left.mean()) <= 0.95:
                # the left side is cut first
                todo += [(own[~left], level + 1), (own[left], level + 1)]
                continue
        label[own] = leaves
        leaves += 1
    return label


def score_labels(planes, label: np.ndarray, band: int) -> np.ndarray:
    """``cluster_scores`` of one image."""
    border = P.on_border(label.shape, max(1, band))
    centre = [P.at_rank(p[border], int(border.sum()) // 2) for p in planes]
    n = np.bincount(label.ravel())
    share = np.bincount(label[border], minlength=len(n)) / n
    mean = [np.bincount(label.ravel(), p.ravel()) / n for p in planes]
    return (share * 0.6 + (1 - P.lab_distance(mean, centre)).clip(0, 1) * 0.4).clip(0, 1)


@dataclass
class Separated:
    labels: np.ndarray
    scores: np.ndarray
    candidate: np.ndarray
    raw: np.ndarray
    mask: np.ndarray


def separated(planes, p: PartitionParams = PartitionParams(), seeds: np.ndarray | None = None, enters: np.ndarray | None = None) -> Separated:
    """Clusters of an image, the cluster mask, the flooded mask and the cleaned one; a mask above max_bg_ratio falls back to the
    cluster mask. ``seeds`` and ``enters`` replace the cluster mask at the border, and bound the flood."""
    shape = planes[0].shape
    if not p.enabled:
        none = np.zeros(shape)
        return Separated(np.zeros(shape, int), np.zeros(1), none, none, none)
    lab = np.stack([q.ravel() for q in planes], 1)
    label = cut_labels(lab, p.max_depth, p.variance_threshold)
    n = np.bincount(label)
    sums = np.stack([np.bincount(label, lab[:, k]) for k in range(3)], 1)
    label = merge_clusters(n, sums, p.min_cluster_area_ratio, p.max_clusters)[label].reshape(shape)
    scores = score_labels(planes, label, p.border_band)
    candidate = (scores >= p.bg_score_threshold)[label].astype(float)
    start = P.on_border(shape, max(1, p.border_band)) & ((candidate >= p.bg_score_threshold) if seeds is None else seeds)
    flood = P.flooded(start, planes, p.bg_connect_threshold, enters).astype(float)
    raw = candidate if flood.mean() > p.max_bg_ratio else flood
    clean = P.opening(P.closing(raw, p.close_radius), p.open_radius)
    clean = P.erode(clean, p.erode_radius)
    return Separated(label, scores, candidate, raw, candidate if clean.mean() > p.max_bg_ratio else clean)
