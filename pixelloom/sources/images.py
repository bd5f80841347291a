"""Images: directory scans, decoding into pixel tables, names and groups, and PNG files."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("jpg", "jpeg", "png")


def fit(w: Column, h: Column, most: int) -> tuple[Column, Column]:
    """Width and height that fit into ``most``, one pixel at least."""
    s = F.lit(float(most)) / F.greatest(w, h)
    small = (w <= most) & (h <= most)
    one = lambda v: F.when(small, v).otherwise(F.greatest(F.lit(1), F.floor(v * s))).cast("int")
    return one(w), one(h)


def listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path of all files of several folders (of originals and of results), by path."""
    out = None
    for f in folders:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f).select("path")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("path")


def undecodable(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path of image files that can't be decoded."""
    df = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    ext = F.lower(F.regexp_extract("origin", r"\.([^.]*)$", 1))
    return df.where(ext.isin(*EXTENSIONS) & (F.col("width") <= 0)).select(F.col("origin").alias("path"))


def scan(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """path, stem, w, h, data of the folder's images; files that can't be decoded are left out (``undecodable`` lists them). Bytes are
    B, G, R (and alpha) by row."""
    df = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    ext = F.lower(F.regexp_extract("origin", r"\.([^.]*)$", 1))
    return df.where(ext.isin(*EXTENSIONS)).select(F.col("origin").alias("path"), F.regexp_extract("origin", r"([^/]*)\.[^.]*$", 1).alias("stem"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), "data")


def pixels(images: DataFrame, max_dim: int | None = 1024) -> DataFrame:
    """image_id, x, y, r, g, b of decoded images that fit into max_dim (None: as they are); alpha is dropped."""
    numbered = images.select(F.xxhash64("path").alias("image_id"), "w", "h", "channels", "data")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            for r in t.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(-1, r.channels).astype("int32")
                a = np.repeat(a[:, :1], 3, 1) if r.channels == 1 else a[:, :3]
                i = np.arange(len(a))
                yield pd.DataFrame({"image_id": r.image_id, "x": (i % r.w).astype("int32"), "y": (i // r.w).astype("int32"), "r": a[:, 2], "g": a[:, 1], "b": a[:, 0]})

    out = numbered.mapInPandas(run, "image_id long, x int, y int, r int, g int, b int")
    return out if max_dim is None else resized(out, max_dim)


def lanczos(n: int, m: int, a: int = 3) -> np.ndarray:
    """m x n weights that resample n samples to m."""
    s = max(n / m, 1.0)
    at = (np.arange(m)[:, None] + 0.5) * n / m - 0.5
    t = (np.arange(n)[None] - at) / s
    w = np.where(np.abs(t) < a, np.sinc(t) * np.sinc(t / a), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(df: DataFrame, most: int) -> DataFrame:
    """Pixel tables whose images fit into ``most`` (Lanczos, three lobes)."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        w, h = int(t.x.max()) + 1, int(t.y.max()) + 1
        k = min(1.0, most / max(w, h))
        nw, nh = (w, h) if k == 1.0 else (max(1, int(w * k)), max(1, int(h * k)))
        out = {c: np.clip(np.rint(lanczos(h, nh) @ t[c].to_numpy(float).reshape(h, w) @ lanczos(w, nw).T), 0, 255).astype("int32").ravel() for c in "rgb"}
        i = np.arange(nw * nh)
        return pd.DataFrame({"image_id": t.image_id.iloc[0], "x": (i % nw).astype("int32"), "y": (i // nw).astype("int32"), **out})

    return df.select("image_id", "x", "y", "r", "g", "b").groupBy("image_id").applyInPandas(one, "image_id long, x int, y int, r int, g int, b int")


def grouped(paths: DataFrame) -> DataFrame:
    """prefix, n, labels of image files: <id>_p<digits>[_<label>]; files without label are the originals."""
    ok = paths.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin(*EXTENSIONS))
    label = F.regexp_extract("path", r"_p[0-9]+_(.*)[.][^.]*$", 1)
    named = ok.select(F.regexp_extract("path", r"/([^/]*_p[0-9]+)[^/]*$", 1).alias("prefix"), F.when(label == "", "original").otherwise(label).alias("label"))
    return named.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.collect_list("label").alias("labels"))


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit PNG of an h x w (gray) or h x w x 3 array."""
    a = np.ascontiguousarray(rgb, np.uint8)
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], 1).tobytes()
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def rendered(df: DataFrame, columns: list[str]) -> DataFrame:
    """image_id, png of a value column (0..1, gray), or of three columns of 8 bits or, if they aren't integers, 0..1."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        w, h = int(t.x.max()) + 1, int(t.y.max()) + 1
        a = t[columns].to_numpy()
        if len(columns) == 1 or a.dtype.kind == "f":
            a = np.clip(a.astype(float), 0, 1) * 255
        return pd.DataFrame({"image_id": [t.image_id.iloc[0]], "png": [png(a.reshape((h, w) if len(columns) == 1 else (h, w, 3)))]})

    return df.select("image_id", "x", "y", *columns).groupBy("image_id").applyInPandas(one, "image_id long, png binary")


def thumbnails(df: DataFrame, most: int = 200) -> DataFrame:
    """image_id, uri: previews that fit into ``most``, as PNG data URIs."""
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64("png"))
    return rendered(resized(df, most), ["r", "g", "b"]).select("image_id", uri.alias("uri"))


def data_uri(content: bytes, kind: str = "png") -> str:
    return f"data:image/{kind};base64,{base64.b64encode(content).decode()}"
