"""Frequency-domain operators: DCT complexity, discrete Fourier transform, spectral residual."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .stencil import clamped, col, row


def dct_row(u: int, n: int = 8) -> list[float]:
    """Row u of the orthonormal DCT-II matrix."""
    s = math.sqrt((1 if u == 0 else 2) / n)
    return [s * math.cos((2 * x + 1) * u * math.pi / (2 * n)) for x in range(n)]


def dct_ratio(energy: Column, low: list[Column], dc: Column) -> Column:
    """High-frequency share of AC energy. All energy is the block's sum of squares, so only the low coefficients are
    needed beside it."""
    ac = energy - dc * dc
    return F.greatest(F.lit(0.0), ac - sum(c * c for c in low)) / (ac + 1e-10)


def tile_complexity(tiles: DataFrame, t: int = 4) -> DataFrame:
    """image_id, complexity of 8x8 tiles (image_id, x, y, v), from the DC and the coefficients with u + v < t."""
    basis = [[F.array(*[F.lit(k) for k in dct_row(u)])[F.col(a)] for u in range(t)] for a in ("x", "y")]
    coef = {f"f{u}{v}": F.sum(F.col("v") * basis[0][u] * basis[1][v]) for u in range(t) for v in range(t - u)}
    g = tiles.groupBy("image_id").agg(F.sum(F.col("v") * F.col("v")).alias("e"), *[c.alias(k) for k, c in coef.items()])
    return g.select("image_id", dct_ratio(F.col("e"), [F.col(k) for k in coef if k != "f00"], F.col("f00")).alias("complexity"))


def complexity_map(df: DataFrame, column: str, t: int = 4) -> DataFrame:
    """Adds complexity: of the 8x8 block at x-4..x+3, y-4..y+3, edges clamped. An image is one group, as its plane is what is reckoned with;
    ``complexity_windows`` gives the same without one."""
    from . import planes

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        w, h = int(p.x.max()) + 1, int(p.y.max()) + 1
        return p.assign(complexity=planes.complexity(p[column].to_numpy(float).reshape(h, w), t).ravel())

    schema = StructType([*df.schema.fields, StructField("complexity", DoubleType())])
    return df.groupBy("image_id").applyInPandas(one, schema)


def complexity_windows(df: DataFrame, column: str, t: int = 4) -> DataFrame:
    """``complexity_map`` by separable windows: an image's size bounds no task."""
    rows = {"_sq": sum((clamped(F.col(column), i - 4, row()) ** 2 for i in range(1, 8)), clamped(F.col(column), -4, row()) ** 2)}
    for u in range(t):
        k = dct_row(u)
        rows[f"_r{u}"] = sum((clamped(F.col(column), i - 4, row()) * k[i] for i in range(1, 8)), clamped(F.col(column), -4, row()) * k[0])
    df = df.withColumns(rows)
    cols = {"_e": sum((clamped(F.col("_sq"), i - 4, col()) for i in range(1, 8)), clamped(F.col("_sq"), -4, col()))}
    for u in range(t):
        for v in range(t - u):
            k = dct_row(v)
            cols[f"_f{u}{v}"] = sum((clamped(F.col(f"_r{u}"), i - 4, col()) * k[i] for i in range(1, 8)), clamped(F.col(f"_r{u}"), -4, col()) * k[0])
    df = df.withColumns(cols)
    low = [F.col(c) for c in cols if c not in ("_e", "_f00")]
    return df.withColumn("complexity", dct_ratio(F.col("_e"), low, F.col("_f00"))).drop(*rows, *cols)


def tile_dft(tiles: DataFrame, n: int = 8) -> DataFrame:
    """image_id, u, v, re, im of n x n tiles: a join with the twiddle table and a sum."""
    spark = tiles.sparkSession
    tw = spark.createDataFrame([(x, u, math.cos(2 * math.pi * u * x / n), -math.sin(2 * math.pi * u * x / n)) for x in range(n) for u in range(n)], "k int, f int, c double, s double")
    a = tiles.join(tw, tiles["x"] == tw["k"]).groupBy("image_id", "y", F.col("f").alias("u")).agg(F.sum(F.col("v") * F.col("c")).alias("re"), F.sum(F.col("v") * F.col("s")).alias("im"))
    b = a.join(tw, a["y"] == tw["k"]).groupBy("image_id", "u", F.col("f").alias("v"))
    return b.agg(F.sum(F.col("re") * F.col("c") - F.col("im") * F.col("s")).alias("re"), F.sum(F.col("re") * F.col("s") + F.col("im") * F.col("c")).alias("im"))


def _mean(a: np.ndarray, k: int) -> np.ndarray:
    r = k // 2
    p = np.pad(a, r, mode="edge")
    s = np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1))
    return s.mean((2, 3))


def _gauss(a: np.ndarray, sigma: float, r: int) -> np.ndarray:
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    p = np.pad(a, r, mode="edge")
    p = np.lib.stride_tricks.sliding_window_view(p, 2 * r + 1, axis=0) @ k
    return np.lib.stride_tricks.sliding_window_view(p, 2 * r + 1, axis=1) @ k


def residual_plane(a: np.ndarray, k: int = 3, sigma: float = 3.0, r: int = 6, normalise: bool = True) -> np.ndarray:
    """Spectral residual saliency of one plane."""
    f = np.fft.fft2(a)
    log, phase = np.log(np.sqrt(f.real**2 + f.imag**2 + 1e-20)), np.arctan2(f.imag, f.real)
    s = np.fft.ifft2(np.exp(log - _mean(log, k)) * np.exp(1j * phase)).real
    s = _gauss(s * s, sigma, r)
    return (s - s.min()) / max(s.max() - s.min(), 1e-12) if normalise else s


def spectral_residual(df: DataFrame, columns: list[str], variant: str = "l2", gamma: float = 1.0, weights: tuple[float, ...] = (1, 1, 1)) -> DataFrame:
    """image_id, x, y, saliency of three channels: an image is one group, as its Fourier transform needs all of it.

    ``l2``: norm of the channels' residuals; ``mean``: weighted mean. Then min-max and gamma.
    """

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        w, h = int(p.x.max()) + 1, int(p.y.max()) + 1
        maps = [residual_plane(p[c].to_numpy(float).reshape(h, w), normalise=variant == "l2") for c in columns]
        s = np.sqrt(sum(m * m for m in maps)) if variant == "l2" else sum(m * k for m, k in zip(maps, weights, strict=True)) / sum(weights)
        s = np.clip((s - s.min()) / max(s.max() - s.min(), 1e-12), 0, 1) ** gamma
        return pd.DataFrame({"image_id": p.image_id.to_numpy(), "x": p.x.to_numpy(), "y": p.y.to_numpy(), "saliency": s.reshape(-1)})

    return df.select("image_id", "x", "y", *columns).groupBy("image_id").applyInPandas(one, "image_id long, x int, y int, saliency double")


