"""Colour clustering: assignment and update steps as DataFrame operations, whole palettes per image.

Steps over all images are joins and aggregates (``assign``, ``update``, ``lloyd``). A palette is per image: its pixels
are first reduced to distinct colours with counts (a partial aggregate), so that what reaches one task is at most
the image's distinct colours; the algorithms then run in numpy on that table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import colour as C

ALGORITHMS = ("kmeans", "minibatch", "median_cut", "octree")


def assign(points: DataFrame, centres: list[tuple[int, list[float]]], columns: list[str], out: str = "cluster") -> DataFrame:
    """Nearest centre of each row (ties: the first), as one expression over the literal centres: no join."""
    d = [F.struct(sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(columns, p, strict=True)).alias("d"), F.lit(k).alias("k")) for k, p in centres]
    return points.withColumn(out, F.array_min(F.array(*d))["k"])


def update(assigned: DataFrame, columns: list[str], weight: Column | None = None, by: tuple[str, ...] = ("cluster",)) -> DataFrame:
    """Weighted centroids, weights and counts of clusters."""
    w = weight if weight is not None else F.lit(1.0)
    return assigned.groupBy(*by).agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns], F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n"))


def lloyd(points: DataFrame, columns: list[str], centres: list[tuple[int, list[float]]], rounds: int = 10, tol: float = 1e-3) -> list[tuple[int, list[float]]]:
    """Lloyd's algorithm over a whole table; the driver holds the k centres."""
    for _ in range(rounds):
        rows = update(assign(points, centres, columns), columns).collect()
        new = {r["cluster"]: [r[c] for c in columns] for r in rows}
        moved = max((sum((a - b) ** 2 for a, b in zip(p, new.get(k, p), strict=True)) for k, p in centres), default=0)
        centres = [(k, new.get(k, p)) for k, p in centres]
        if moved < tol * tol:
            break
    return centres


def octree_leaves(df: DataFrame, depth: int = 8) -> DataFrame:
    """image_id, path, n, sums: leaves of an RGB octree; a digit of the path is one bit of each channel."""
    bit = lambda c, d: F.shiftright(F.col(c), 7 - d).bitwiseAND(F.lit(1))
    path = F.concat(*[(bit("r", d) * 4 + bit("g", d) * 2 + bit("b", d)).cast("string") for d in range(depth)])
    return df.groupBy("image_id", path.alias("path")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "rgb"])


def octree_range_leaves(df: DataFrame, columns: list[str], depth: int = 8) -> DataFrame:
    """The same by midpoints of the image's bounding box: a digit says where a value is above the middle."""
    box = df.groupBy("image_id").agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    df = df.join(box, "image_id")
    cell = {}
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        span = F.when(span <= 0, 1.0).otherwise(span)
        # ceil - 1: a value on a midpoint belongs to the lower half
        cell[c] = F.greatest(F.lit(0), F.ceil((F.col(c) - F.col(f"_lo_{c}")) / span * (1 << depth)) - 1).cast("int")
    df = df.withColumns({f"_q_{c}": e for c, e in cell.items()})
    bit = lambda c, d: F.shiftright(F.col(f"_q_{c}"), depth - 1 - d).bitwiseAND(F.lit(1))
    path = F.concat(*[sum(bit(c, d) * (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)).cast("string") for d in range(depth)])
    return df.groupBy("image_id", path.alias("path")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in columns])


# -- palettes of an image, in numpy ----------------------------------------------------------------------------


def _seeds(p: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre drawn by weight times squared distance."""
    c = [p[rng.choice(len(p), p=w / w.sum())]]
    d = ((p - c[0]) ** 2).sum(1)
    while len(c) < k:
        q = d * w
        c.append(p[rng.choice(len(p), p=q / q.sum())] if q.sum() > 0 else p[len(c) % len(p)])
        d = np.minimum(d, ((p - c[-1]) ** 2).sum(1))
    return np.array(c)


def _nearest(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((p[:, None, :] - c[None]) ** 2).sum(2).argmin(1)


def kmeans(p: np.ndarray, w: np.ndarray, k: int, seed: int = 42, rounds: int = 50, tol: float = 1e-3, batch: int | None = None) -> np.ndarray:
    """The cluster of each weighted point. With ``batch``, centres follow batches of points in a seeded order."""
    k = min(k, len(p))
    rng = np.random.default_rng(seed)
    c = _seeds(p, w, k, rng)
    if batch:
        order, total = rng.permutation(len(p)), np.zeros(k)
        n = -(-len(p) // batch)
        for i in range(min(20, max(5, n // 4))):
            own = order[(i % n) * batch : (i % n + 1) * batch]
            a = _nearest(p[own], c)
            add = np.bincount(a, w[own], k)
            total += add
            before = c.copy()
            for j in np.flatnonzero(add):
                m = a == j
                c[j] += (np.average(p[own][m], axis=0, weights=w[own][m]) - c[j]) * add[j] / total[j]
            # a batch that moves no centre is the last
            if i and ((c - before) ** 2).sum(1).max() < 1e-2 * 1e-2:
                break
        return _nearest(p, c)
    for _ in range(rounds):
        a = _nearest(p, c)
        new = np.array([np.average(p[a == j], axis=0, weights=w[a == j]) if (a == j).any() else c[j] for j in range(k)])
        done = ((new - c) ** 2).sum(1).max() < tol * tol
        c = new
        if done:
            break
    return _nearest(p, c)


def median_cut(p: np.ndarray, w: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Splits the bucket of most pixels on its widest axis (ties: the last) at half of its pixels, k - 1 times. Buckets are (points,
    pixels of each): the point in the middle may have pixels on both sides. Points are in the order of their first pixels."""
    buckets = [(np.arange(len(p)), w.astype(float))]
    while len(buckets) < k:
        can = [i for i, (_, n) in enumerate(buckets) if n.sum() > 1]
        if not can:
            break
        at = max(can, key=lambda i: (buckets[i][1].sum(), i))
        own, n = buckets[at]
        span = np.ptp(p[own], axis=0)
        order = np.argsort(p[own, int(np.flatnonzero(span == span.max())[-1])], kind="stable")
        own, n = own[order], n[order]
        half = n.sum() // 2 if (n == np.floor(n)).all() else n.sum() / 2
        left = np.clip(half - (np.cumsum(n) - n), 0, n)
        buckets[at] = (own[left > 0], left[left > 0])
        right = n - left
        buckets.append((own[right > 0], right[right > 0]))
    return buckets


def octree(path: np.ndarray, w: np.ndarray, k: int) -> list[np.ndarray]:
    """Leaves of an octree reduced to about k: path (n, 8) has the octant of each point at each level, points in the order of their first pixels.

    Fixed rules: the deepest level first, in it the node that was split last; a node takes in all its children unless that leaves fewer than
    k, else only as many of the smallest as needed, whose pixels then belong to no leaf. Leaves are counted one short, so k + 1 may be left.
    """
    depth = path.shape[1]
    number = [np.zeros(len(path), np.int64)]
    for d in range(depth):
        # nodes of a level in the order in which they were made
        _, first, inverse = np.unique(np.stack([number[-1], path[:, d]], 1), axis=0, return_index=True, return_inverse=True)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        number.append(rank[inverse.ravel()])
    leaf = number[depth].copy()
    members = {(depth, int(i)): np.flatnonzero(leaf == i) for i in np.unique(leaf)}
    size = {node: float(w[m].sum()) for node, m in members.items()}
    count = len(members) - 1
    for d in range(depth - 1, -1, -1):
        kids: dict[int, list[tuple[int, tuple[int, int]]]] = {}
        at = np.unique(number[d + 1], return_index=True)[1]
        for i in at.tolist():
            child = (d + 1, int(number[d + 1][i]))
            kids.setdefault(int(number[d][i]), []).append((int(path[i, d]), child))
        for node in sorted(kids, reverse=True):
            if count <= k:
                return list(members.values())
            own = [c for _, c in sorted(kids[node]) if c in members]
            need = count - k
            if count - len(own) + 1 >= k or need >= len(own):
                members[d, node] = np.concatenate([members.pop(c) for c in own])
                size[d, node] = sum(size[c] for c in own)
                count -= len(own) - 1
            else:
                for c in sorted(own, key=size.__getitem__)[:need]:
                    del members[c]
                count -= need
    return list(members.values())


def octants(p: np.ndarray, rgb: np.ndarray | None = None, depth: int = 8) -> np.ndarray:
    """The octant of each point at each level: bits of 8-bit channels, or halves of the points' bounding box (a value on a middle is low)."""
    if rgb is not None:
        cell = rgb.astype(np.int64)
    else:
        span = np.ptp(p, axis=0)
        cell = np.maximum(np.ceil((p - p.min(0)) / np.where(np.abs(span) < 1e-10, 1.0, span) * (1 << depth)) - 1, 0).astype(np.int64)
    shifts = np.arange(depth - 1, -1, -1)
    bits = cell[:, None, :] >> shifts[None, :, None] & 1
    return bits @ np.array([4, 2, 1])


def palette(pixels: DataFrame, algorithm: str = "kmeans", space: str = "CIELAB", k: int = 10, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """Palette rows of each image, by ascending lightness; the dominant entry has the largest proportion. Colours are means in the
    space. Pixels have an order: idx, or y and x."""
    w = weight if weight is not None else F.lit(1.0)
    order = F.col("idx") if "idx" in pixels.columns else F.struct("y", "x")
    counted = pixels.groupBy("image_id", "r", "g", "b").agg(F.sum(w).alias("w"), F.min(order).alias("first"))
    # CAM16 is reckoned in numpy from the distinct colours: its expressions take longer to compile than all else to run
    values = dict(zip(("u", "v", "t"), C.convert_to("RGB" if space == "CAM16" else space, *C.unit("r", "g", "b")), strict=True))
    # points come in the order of their first pixels
    table = counted.withColumns(values).withColumn("at", F.row_number().over(Window.partitionBy("image_id").orderBy("first"))).drop("first")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("at")
        t = t[(t.w > 0) & np.isfinite(t[["u", "v", "t"]]).all(axis=1)]
        rgb, p, ww = t[["r", "g", "b"]].to_numpy(float), t[["u", "v", "t"]].to_numpy(float), t.w.to_numpy(float)
        if space == "CAM16":
            p = C.rgb_cam16ucs(p)
        if algorithm == "median_cut":
            groups = median_cut(p, ww, k)
        elif algorithm == "octree":
            groups = [(i, ww[i]) for i in octree(octants(p, rgb if space == "RGB" else None), ww, k)]
        else:
            a = kmeans(p, ww, k, seed, batch=2048 if algorithm == "minibatch" else None)
            groups = [(i, ww[i]) for i in (np.flatnonzero(a == j) for j in np.unique(a))]
        total = sum(n.sum() for _, n in groups)
        mean = np.array([np.average(p[i], axis=0, weights=n) for i, n in groups])
        if space == "CAM16":
            mean = C.cam16ucs_rgb(mean)
        rows = [(int(t.image_id.iloc[0]), j, *map(float, m), float(n.sum() / total)) for j, (m, (_, n)) in enumerate(zip(mean, groups, strict=True))]
        return pd.DataFrame(rows, columns=["image_id", "part", "u", "v", "t", "proportion"])

    parts = table.groupBy("image_id").applyInPandas(one, "image_id long, part int, u double, v double, t double, proportion double")
    parts = C.with_rgb(parts, "RGB" if space == "CAM16" else space, ("u", "v", "t"), ("_r", "_g", "_b"))
    rgb = [F.col(f"_{c}") for c in "rgb"]
    image = Window.partitionBy("image_id")
    # of equal proportions the last counts
    parts = parts.withColumns({"lab_l": C.lab(*rgb)[0], "_best": F.max(F.struct("proportion", "part")).over(image)["part"], **{c: C.to_u8(v, True) for c, v in zip("rgb", rgb, strict=True)}})
    entry = F.row_number().over(image.orderBy("lab_l", "part")) - 1
    return parts.select(
        "image_id", F.lit(algorithm).alias("algorithm"), F.lit(space).alias("colorspace"), entry.alias("entry"), "r", "g", "b",
        C.hexed(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "lab_l", "proportion", (F.col("part") == F.col("_best")).alias("is_dominant"),
    )


def clusters_nd(pixels: DataFrame, columns: list[str], k: int = 10, seed: int = 42, sample: int | None = None) -> DataFrame:
    """image_id, x, y, cluster by k-means on any columns; with ``sample`` trained on so many pixels of a seeded order."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        p = t[columns].to_numpy(float)
        if sample and len(p) > sample:
            own = np.random.default_rng(seed).permutation(len(p))[:sample]
            a = kmeans(p[own], np.ones(len(own)), k, seed)
            c = np.array([p[own][a == j].mean(0) for j in np.unique(a)])
            label = _nearest(p, c)
        else:
            label = kmeans(p, np.ones(len(p)), k, seed)
        return pd.DataFrame({"image_id": t.image_id.to_numpy(), "x": t.x.to_numpy(), "y": t.y.to_numpy(), "cluster": label.astype("int32")})

    return pixels.select("image_id", "x", "y", *columns).groupBy("image_id").applyInPandas(one, "image_id long, x int, y int, cluster int")


def dominant(clustered: DataFrame, complexity: str = "complexity") -> DataFrame:
    """image_id, cluster, proportion, avg_c, score: softmax of proportion times softmax of mean complexity."""
    w = Window.partitionBy("image_id")
    g = clustered.groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(complexity).alias("avg_c"))
    g = g.withColumn("proportion", F.col("n") / F.sum("n").over(w))
    e = lambda c: F.exp(F.col(c) - F.max(c).over(w))
    g = g.withColumns({"_p": e("proportion"), "_c": e("avg_c")})
    return g.select("image_id", "cluster", "proportion", "avg_c", (F.col("_p") / F.sum("_p").over(w) * F.col("_c") / F.sum("_c").over(w)).alias("score"))
