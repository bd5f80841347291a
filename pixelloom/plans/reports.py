"""Reports: JSON rows, HTML pages and sheets of thumbnails.

Pages are for reading: they are made on the driver from palettes, cluster and region rows, a few an image, streamed in order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions import colour as C
from pixelloom.operators import fusion as U
from pixelloom.sources.images import data_uri, lanczos, png


def region_json(regions: DataFrame, top: int | None = None) -> DataFrame:
    """image_id, json: colour, share in percent and area of each region, largest first."""
    w = Window.partitionBy("image_id")
    r = regions.withColumn("_pct", F.round(F.col("area") * 100 / F.sum("area").over(w), 2)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("area"), "region")))
    r = r if top is None else r.where(F.col("_k") <= top)
    item = F.struct("_k", C.hexed("mean_r", "mean_g", "mean_b", True).alias("color"), F.col("_pct").alias("area_pct"), "area")
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["color"].alias("color"), x["area_pct"].alias("area_pct"), x["area"].alias("area")))
    return r.groupBy("image_id").agg(F.to_json(rows).alias("json"))


def rows_json(rows: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """image_id, json: an image's rows as an array of objects, in an order: diagnostics of weights, regions or clusters."""
    columns = columns or [c for c in rows.columns if c != "image_id"]
    item = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*columns).alias("v"))
    return rows.groupBy("image_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])).alias("json"))


def groups_json(groups: DataFrame) -> DataFrame:
    """prefix, json of file groups: what a viewer asks for."""
    return groups.select("prefix", F.to_json(F.struct("prefix", F.array_sort("labels").alias("labels"))).alias("json"))


def matching_groups(groups: DataFrame, text: str) -> DataFrame:
    """Groups whose prefix holds a text."""
    return groups.where(F.contains("prefix", F.lit(text)))


def weight_table(weights: DataFrame) -> str:
    """The weights of an image's features as lines of text."""
    cols = ["feature", "base_add", "base_mul", "variance", "range", "peakiness", "score", "multiplier", "add_weight", "mul_weight"]
    lines = [" ".join(f"{c:>24}" if c == "feature" else f"{c:>10}" for c in cols)]
    for r in weights.select("image_id", *cols).orderBy("image_id", F.array_position(F.array(*map(F.lit, U.FEATURES)), F.col("feature"))).toLocalIterator():
        lines.append(" ".join(f"{r[c]:>24}" if c == "feature" else f"{r[c]:>10.4f}" for c in cols))
    return "\n".join(lines)


def weight_effect(pixels: DataFrame) -> DataFrame:
    """image_id and how a suppression (column suppression) changes weights: active shares, rank percentiles of positive values, and mean
    weights of dark and light pixels (L* below 20, above 85) before and after. pixels: lab_l, filtered, ambient, suppression, weight."""
    from pixelloom.operators.normalise import at_ranks, clamp01

    before = clamp01(F.col("filtered") + F.col("ambient"))
    out = pixels.groupBy("image_id").agg(
        F.avg((F.col("suppression") > 0).cast("double")).alias("suppressed"), F.avg((F.col("weight") > 0).cast("double")).alias("active"),
        *[f(F.when(c, v)).alias(f"{n}_{k}") for n, c in (("dark", F.col("lab_l") < 20), ("light", F.col("lab_l") > 85)) for k, v, f in (("n", F.lit(1), F.count), ("before", before, F.avg), ("after", F.col("weight"), F.avg))],
    )
    rank = lambda q: F.floor(F.col("n") * q / 100)
    for name, column, qs in (("s", "suppression", (50, 90, 99)), ("w", "weight", (10, 50, 90))):
        p = at_ranks(pixels.where(F.col(column) > 0), column, {f"{name}_p{q}": rank(q) for q in qs})
        out = out.join(p, "image_id", "left")
    drop = lambda n: F.when(F.col(f"{n}_before") > 0, 1 - F.try_divide(F.col(f"{n}_after"), F.col(f"{n}_before")))
    return out.withColumns({"dark_reduction": drop("dark"), "light_reduction": drop("light")})


# -- pages ------------------------------------------------------------------------------------------------------

_STYLE = "body{font-family:sans-serif;max-width:70em;margin:2em auto}td,th{padding:.2em .6em;text-align:left}.s{display:inline-block;padding:1em;margin:.1em}"


def page(title: str, parts: Iterable[str]) -> str:
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>"
    return "\n".join([head, *parts, "</body></html>"])


def swatch(colour: str, text: str) -> str:
    return f"<span class='s' style='background:{escape(colour)}'>{escape(text)}</span>"


def table(rows: Iterable[Iterable[object]], head: Iterable[str]) -> str:
    cell = lambda v, tag: f"<{tag}>{v if str(v).startswith('<') else escape(f'{v:.4f}' if isinstance(v, float) else str(v))}</{tag}>"
    line = lambda r, tag: "<tr>" + "".join(cell(v, tag) for v in r) + "</tr>"
    return "<table>" + line(head, "th") + "".join(line(r, "td") for r in rows) + "</table>"


def _sections(rows: DataFrame, keys: list[str], order: list[str], item) -> Iterator[str]:
    """A heading for each combination of keys, and its rows."""
    at = None
    for r in rows.orderBy(*keys, *order).toLocalIterator():
        if tuple(r[k] for k in keys) != at:
            at = tuple(r[k] for k in keys)
            yield f"<h2>{escape(' / '.join(map(str, at)))}</h2>"
        yield item(r)


def palette_html(palettes: DataFrame, title: str = "Palettes", seconds: dict[tuple[str, str], float] | None = None) -> str:
    """Palettes of the matrix, and a summary of how many there are and how long each algorithm and space took."""

    def item(r: Row) -> str:
        return swatch(r.hex, f"{r.hex} {r.proportion:.1%}{' *' if r.is_dominant else ''}")

    s = seconds or {}
    summary = [f"<p>{len(s)} combinations, {sum(s.values()):.1f} s in all, {sum(s.values()) / len(s):.2f} s each</p>"] if s else []
    times = [table([(a, c, float(v)) for (a, c), v in sorted(s.items())], ("algorithm", "space", "seconds"))] if s else []
    return page(title, [*summary, *times, *_sections(palettes, ["image_id", "algorithm", "colorspace"], ["entry"], item)])


def dct_html(clusters: DataFrame, title: str = "Complexity") -> str:
    """Cluster rows by variant: share, mean complexity, score; the best one marked."""
    best = clusters.withColumn("_best", F.col("score") == F.max("score").over(Window.partitionBy("image_id", "variant")))
    item = lambda r: f"<p>{r.cluster}: {r.proportion:.1%}, complexity {r.avg_c:.3f}, score {r.score:.4f}{' *' if r['_best'] else ''}</p>"
    return page(title, _sections(best, ["image_id", "variant"], ["cluster"], item))


def impression_html(palette: DataFrame, config: str = "", title: str = "Impression colours") -> str:
    """Foreground palettes and the configuration."""
    item = lambda r: swatch(r.hex, f"{r.hex} {r.proportion:.1%}")
    return page(title, [*_sections(palette, ["image_id"], ["entry"], item), f"<h2>Configuration</h2><pre>{escape(config)}</pre>"])


def fusion_html(colours: DataFrame, clusters: DataFrame, title: str = "Fusion") -> str:
    """An overview of each image's colours, and its clusters by score."""
    rgb = lambda r: "#%02x%02x%02x" % tuple(int(min(1.0, max(0.0, r[c])) * 255) for c in "rgb")
    rows = [(r.image_id, r.kind, swatch(rgb(r), rgb(r)), float(r.score)) for r in colours.orderBy("image_id", "kind").toLocalIterator()]
    item = lambda r: swatch(r.hex, f"{r.hex} {r.area_ratio:.1%} {r.score:.4f}")
    return page(title, [table(rows, ("image", "kind", "colour", "score")), *_sections(clusters, ["image_id"], ["cluster"], item)])


def segment_html(regions: DataFrame, top: int = 5, title: str = "Segments") -> str:
    """How many regions each image has, and its largest ones."""
    w = Window.partitionBy("image_id")
    r = regions.withColumns({"_n": F.count(F.lit(1)).over(w), "_share": F.col("area") / F.sum("area").over(w), "_k": F.row_number().over(w.orderBy(F.desc("area"), "region"))}).where(F.col("_k") <= top)
    colour = lambda x: "#%02X%02X%02X" % (x.mean_r, x.mean_g, x.mean_b)
    item = lambda x: (f"<p>{x['_n']} regions</p>" if x["_k"] == 1 else "") + swatch(colour(x), f"{colour(x)} {x['_share']:.1%}")
    return page(title, _sections(r, ["image_id"], ["_k"], item))


# -- sheets -----------------------------------------------------------------------------------------------------


def short_name(feature: str) -> str:
    """A feature's name for a small label."""
    for long, short in (("global_", "g_"), ("local_", "l_"), ("background_", "bg_"), ("segment_", "seg_"), ("residual", "res"), ("confidence", "conf"), ("foreground", "fg")):
        feature = feature.replace(long, short)
    return feature


def thumbnail(a: np.ndarray, width: int) -> np.ndarray:
    """An 8-bit image (h, w, 3) at another width."""
    h, w, _ = a.shape
    nh = max(1, round(h * width / w))
    return np.clip(np.rint(np.einsum("ij,jkc,lk->ilc", lanczos(h, nh), a.astype(float), lanczos(w, width))), 0, 255).astype(np.uint8)


def sheets(pixels: DataFrame, columns: list[str], cols: int = 4, width: int = 120, pad: int = 4) -> DataFrame:
    """image_id, png, labels: an image (r, g, b in 0..1) and its maps as thumbnails in a grid; labels name them in the grid's order."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["y", "x"])
        w, h = int(t.x.max()) + 1, int(t.y.max()) + 1
        u8 = lambda v: (np.clip(v, 0, 1) * 255).astype(np.uint8)
        shots = [u8(t[["r", "g", "b"]].to_numpy(float)).reshape(h, w, 3)] + [np.repeat(u8(t[c].to_numpy(float)).reshape(h, w, 1), 3, 2) for c in columns]
        shots = [thumbnail(s, width) for s in shots]
        th = shots[0].shape[0]
        rows = -(-len(shots) // cols)
        out = np.full((pad + rows * (th + pad), pad + cols * (width + pad), 3), 24, np.uint8)
        for i, s in enumerate(shots):
            y, x = pad + i // cols * (th + pad), pad + i % cols * (width + pad)
            out[y : y + th, x : x + width] = s
        return pd.DataFrame({"image_id": [t.image_id.iloc[0]], "png": [png(out)], "labels": [["original", *map(short_name, columns)]]})

    return pixels.select("image_id", "x", "y", "r", "g", "b", *columns).groupBy("image_id").applyInPandas(one, "image_id long, png binary, labels array<string>")


def stamp(spark: SparkSession) -> str:
    """The time, to the millisecond."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]


def sheet_html(sheet: DataFrame, title: str = "Sheets") -> str:
    """Sheets as pictures in a page, with their labels and the time."""
    return page(f"{title} {stamp(sheet.sparkSession)}", (f"<h2>{r.image_id}</h2><img src='{data_uri(bytes(r.png))}'><p>{escape(', '.join(r.labels))}</p>" for r in sheet.orderBy("image_id").toLocalIterator()))
