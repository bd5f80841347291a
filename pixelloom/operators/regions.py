"""Region segmentation on the pixel-neighbour graph.

Links, statistics and adjacency are DataFrame operations. Components of an image's pixels, and the merges that depend on
their order, run per image: an image is the unit of work; ``images.pixels`` bounds its size by max_dim.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import colour as C

from . import planes as P
from .stencil import closing, col, edge_strength, opening, row


# Defaults of segmentation.
@dataclass(frozen=True)
class SegmentParams:
    """Defaults of the library call."""

    preprocess_max_dim: int = 512
    min_region_area: int = 50
    min_cluster_area_ratio: float = 0.001
    edge_threshold: float = 0.15
    edge_split_strength: float = 0.4
    edge_gamma: float = 0.65
    edge_merge_strength: float = 0.05
    color_merge_distance: float = 8.0
    small_region_color_distance: float = 24.0
    merge_small_regions: bool = True
    morph_open_radius: int = 0
    morph_close_radius: int = 0
    color_weight: float = 1.0
    edge_weight: float = 1.0


def _clip(v: float, low: float, high: float) -> float:
    return min(high, max(low, v))


# How limits follow from the parameters.
def limits(p: SegmentParams) -> dict[str, float]:
    cw, ew = _clip(p.color_weight, 0.25, 4.0), _clip(p.edge_weight, 0.25, 4.0)
    wall = _clip(p.edge_split_strength * 0.68, 0.45, 0.85)
    grow = 1.3 * _clip(p.color_merge_distance * 1.75 + 4.0, 12.0, 30.0)
    return {"cw": cw, "ew": ew, "wall": wall, "grow2": grow * grow, "rgb2": (wall * 72.0 / ew) ** 2, "y": int(wall * 42.0 / ew), "chroma": int(wall * 180.0 / ew)}


def link(other: dict[str, Column], p: SegmentParams = SegmentParams()) -> Column:
    """Whether a pixel links with a neighbour; ``other`` has the neighbour's r, g, b, edge."""
    m = limits(p)
    own = {k: F.col(k) for k in ("r", "g", "b", "edge")}
    d2 = sum((own[k] - other[k]) * (own[k] - other[k]) for k in "rgb")
    y = F.abs(F.floor((own["r"] + own["g"] * 2 + own["b"]) / 4) - F.floor((other["r"] + other["g"] * 2 + other["b"]) / 4))
    co, cg = (own["r"] - own["b"]) - (other["r"] - other["b"]), (own["g"] * 2 - own["r"] - own["b"]) - (other["g"] * 2 - other["r"] - other["b"])
    strong = (d2 >= m["rgb2"]) | (y >= m["y"]) | (F.abs(co) + F.abs(cg) >= m["chroma"])
    return ~strong & ((own["edge"] + other["edge"]) * (0.175 * m["ew"]) < m["wall"]) & (d2 * m["cw"] <= m["grow2"])


def with_links(pixels: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """Adds right and down: links with the next pixel of the row and column (null at the edge)."""
    return pixels.withColumns({n: link({k: F.lead(k, 1).over(w) for k in ("r", "g", "b", "edge")}, p) for n, w in (("right", row()), ("down", col()))})


def with_edges(pixels: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    lab = dict(zip(("lab_l", "lab_a", "lab_b"), C.lab(*C.unit("r", "g", "b")), strict=True))
    out = edge_strength(pixels.withColumns(lab), p.edge_threshold, p.edge_gamma).drop("lab_l", "lab_a", "lab_b")
    if p.morph_open_radius > 0:
        out = opening(out, ["edge"], p.morph_open_radius)
    return closing(out, ["edge"], p.morph_close_radius) if p.morph_close_radius > 0 else out


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _relabel(roots: list[int]) -> np.ndarray:
    """Numbers of roots in the order in which they first occur."""
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(r, len(seen)) for r in roots])


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.sqrt(((a - b) ** 2).sum(1))
    y = np.abs((a[:, 0] + 2 * a[:, 1] + a[:, 2]) // 4 - (b[:, 0] + 2 * b[:, 1] + b[:, 2]) // 4)
    co, cg = (a[:, 0] - a[:, 2]) - (b[:, 0] - b[:, 2]), (2 * a[:, 1] - a[:, 0] - a[:, 2]) - (2 * b[:, 1] - b[:, 0] - b[:, 2])
    return np.clip(np.maximum(np.maximum(d / 72, y / 42), (np.abs(co) + np.abs(cg)) / 180), 0, 1)


def merge(label: np.ndarray, rgb: np.ndarray, edge: np.ndarray, w: int, h: int, p: SegmentParams) -> np.ndarray:
    """Merges touching regions that no edge parts, then takes small regions into their best neighbours, smallest first."""
    grid = np.arange(w * h).reshape(h, w)
    a = np.concatenate([grid[:, :-1].ravel(), grid[:-1].ravel()])
    b = np.concatenate([grid[:, 1:].ravel(), grid[1:].ravel()])
    cut = label[a] != label[b]
    a, b = a[cut], b[cut]
    low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
    e, d = np.maximum(_direct(rgb[a], rgb[b]), (edge[a] + edge[b]) / 2), np.sqrt(((rgb[a] - rgb[b]) ** 2).sum(1))
    t = pd.DataFrame({"a": low, "b": high, "e": e, "d": d}).groupby(["a", "b"]).agg(e=("e", "mean"), d=("d", "mean"), n=("e", "size")).reset_index()
    n, m = int(label.max()) + 1, limits(p)
    u = Union(n)
    same = (t.e <= p.edge_merge_strength) | ((t.d * m["cw"] <= _clip(p.color_merge_distance * 1.9 + 5, 14, 32)) & (t.e * m["ew"] < _clip(p.edge_split_strength, 0.25, 0.98) * 0.45))
    for x, y in zip(t.a[same], t.b[same], strict=True):
        u.join(x, y)
    if p.merge_small_regions:
        area = np.bincount(label, minlength=n)
        mean = np.stack([np.bincount(label, rgb[:, c], n) / area for c in range(3)], 1)
        least = max(p.min_region_area, int(w * h * p.min_cluster_area_ratio + 0.5), 1)
        # each region's neighbours are one stretch of arrays, in the order of touching pairs
        own, other = np.concatenate([t.a, t.b]), np.concatenate([t.b, t.a])
        order = np.lexsort((np.tile(np.arange(len(t)), 2), own))
        own, other = own[order], other[order]
        edge_of, length = (np.tile(t[c].to_numpy(float), 2)[order] for c in ("e", "n"))
        stretch = np.searchsorted(own, np.arange(n + 1))
        for i in np.lexsort((np.arange(n), area)):
            if area[i] >= least:
                break
            k = np.arange(stretch[i], stretch[i + 1])
            dist = np.sqrt(((mean[i] - mean[other[k]]) ** 2).sum(1))
            # fixed values: how near, unparted, long and large a neighbour should be
            score = dist * m["cw"] + edge_of[k] * m["ew"] * 35 - np.sqrt(length[k]) * 3 - np.minimum(np.log1p(area[other[k]]), 12)
            can = np.array([u.find(j) != u.find(int(i)) for j in other[k].tolist()], bool)
            if area[i] > max(2, least // 4):
                can &= (edge_of[k] < p.edge_split_strength) | (dist * m["cw"] <= p.small_region_color_distance * 1.6)
            if can.any():
                u.join(int(i), int(other[k][can][score[can].argmin()]))
    return _relabel([u.find(int(i)) for i in label])


def segment(pixels: DataFrame, p: SegmentParams = SegmentParams()) -> DataFrame:
    """pixels (image_id, x, y, r, g, b) with edge and region. A table without pixels is an error."""
    if pixels.isEmpty():
        raise ValueError("an image needs at least one pixel")
    linked = with_links(with_edges(pixels, p), p).select("image_id", "x", "y", "r", "g", "b", "edge", F.coalesce("right", F.lit(False)).alias("right"), F.coalesce("down", F.lit(False)).alias("down"))

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        w, h = int(t.x.max()) + 1, int(t.y.max()) + 1
        if len(t) != w * h:
            raise ValueError("the image has gaps")
        label = P.components(t.right.to_numpy(bool).reshape(h, w)[:, :-1], t.down.to_numpy(bool).reshape(h, w)[:-1]).ravel()
        label = merge(label, t[["r", "g", "b"]].to_numpy(float), t.edge.to_numpy(float), w, h, p)
        return t[["image_id", "x", "y", "r", "g", "b", "edge"]].assign(region=label.astype("int32"))

    return linked.groupBy("image_id").applyInPandas(one, "image_id long, x int, y int, r int, g int, b int, edge double, region int")


def segment_planes(rgb: np.ndarray, p: SegmentParams = SegmentParams()) -> tuple[np.ndarray, np.ndarray]:
    """Labels and edge strength of one 8-bit image (h, w, 3): ``segment`` without a table."""
    h, w, _ = rgb.shape
    if not h * w:
        raise ValueError("an image needs at least one pixel")
    edge = P.edge_strength(P.lab_planes(rgb / 255), p.edge_threshold, p.edge_gamma)
    edge = P.closing(P.opening(edge, p.morph_open_radius), p.morph_close_radius)
    c, m = rgb.astype(np.int64), limits(p)

    def links(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
        d2 = ((a - b) ** 2).sum(-1)
        luma = lambda v: (v @ np.array([1, 2, 1])) // 4
        chroma = sum(np.abs((a - b) @ np.array(k)) for k in ([1, 0, -1], [-1, 2, -1]))
        strong = (d2 >= m["rgb2"]) | (np.abs(luma(a) - luma(b)) >= m["y"]) | (chroma >= m["chroma"])
        return ~strong & ((ea + eb) * (0.175 * m["ew"]) < m["wall"]) & (d2 * m["cw"] <= m["grow2"])

    label = P.components(links(c[:, :-1], c[:, 1:], edge[:, :-1], edge[:, 1:]), links(c[:-1], c[1:], edge[:-1], edge[1:])).ravel()
    return merge(label, c.reshape(-1, 3).astype(float), edge.ravel(), w, h, p).reshape(h, w), edge


def region_stats(labelled: DataFrame) -> DataFrame:
    """image_id, region, area, centroid, bounding box, mean colour rounded in integers."""
    mean = lambda c: F.floor((F.sum(c) + F.floor(F.count(F.lit(1)) / 2)) / F.count(F.lit(1))).cast("int").alias(f"mean_{c}")
    return labelled.groupBy("image_id", "region").agg(
        F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), *[mean(c) for c in "rgb"],
    )


def adjacency(labelled: DataFrame) -> DataFrame:
    """image_id, a, b, length, edge and colour difference (sums) of touching regions."""
    parts = []
    for w in (row(), col()):
        n = {k: F.lead(k, 1).over(w) for k in ("r", "g", "b", "edge", "region")}
        parts.append(labelled.select("image_id", "r", "g", "b", "edge", "region", *[v.alias(f"n_{k}") for k, v in n.items()]).where("n_region is not null and n_region <> region"))
    s = parts[0].unionByName(parts[1])
    d = F.sqrt(sum((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in "rgb"))
    y = F.abs(F.floor((F.col("r") + F.col("g") * 2 + F.col("b")) / 4) - F.floor((F.col("n_r") + F.col("n_g") * 2 + F.col("n_b")) / 4))
    co = F.abs((F.col("r") - F.col("b")) - (F.col("n_r") - F.col("n_b")))
    cg = F.abs((F.col("g") * 2 - F.col("r") - F.col("b")) - (F.col("n_g") * 2 - F.col("n_r") - F.col("n_b")))
    direct = F.least(F.lit(1.0), F.greatest(d / 72.0, y / 42.0, (co + cg) / 180.0))
    edge = F.greatest(direct, (F.col("edge") + F.col("n_edge")) * 0.5)
    return s.groupBy("image_id", F.least("region", "n_region").alias("a"), F.greatest("region", "n_region").alias("b")).agg(F.count(F.lit(1)).alias("length"), F.sum(edge).alias("sum_edge"), F.sum(d).alias("sum_color"))


def reached(pixels: DataFrame, seed: Column, step: Column) -> DataFrame:
    """image_id, x, y of pixels that a flood from ``seed`` reaches. A step into a pixel needs ``step``, an expression of
    the pixel's columns and of the pixel's that it comes to (n_ names).

    Which steps are possible is four window expressions a pixel; the flood itself runs per image.
    """
    cols = [c for c in pixels.columns if c not in ("image_id", "x", "y")]
    flags = {}
    for name, w, f in (("right", row(), F.lead), ("left", row(), F.lag), ("down", col(), F.lead), ("up", col(), F.lag)):
        flags |= {f"_{name}_{c}": f(c, 1).over(w) for c in cols}
    wide = pixels.withColumns(flags)

    out = wide
    for name in ("right", "left", "down", "up"):
        out = out.withColumns({f"n_{c}": F.col(f"_{name}_{c}") for c in cols}).withColumn(f"go_{name}", F.coalesce(step, F.lit(False))).drop(*[f"n_{c}" for c in cols])
    out = out.withColumn("seed", seed).select("image_id", "x", "y", "seed", "go_right", "go_left", "go_down", "go_up")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        w, h = int(t.x.max()) + 1, int(t.y.max()) + 1
        g = {k: t[f"go_{k}"].to_numpy(bool).reshape(h, w) for k in ("right", "left", "down", "up")}
        found = t.seed.to_numpy(bool).reshape(h, w).copy()
        front = found.copy()
        while front.any():
            new = np.zeros_like(front)
            new[:, 1:] |= (front & g["right"])[:, :-1]
            new[:, :-1] |= (front & g["left"])[:, 1:]
            new[1:] |= (front & g["down"])[:-1]
            new[:-1] |= (front & g["up"])[1:]
            front = new & ~found
            found |= front
        return t[["image_id", "x", "y"]][found.ravel()]

    return out.groupBy("image_id").applyInPandas(one, "image_id long, x int, y int")
