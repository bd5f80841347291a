"""python -m pixelloom PROGRAM FOLDER OUT [PARAMETERS.yaml]: palettes, dct, segments, fusion or impression of a folder's images, as
tables, pictures and a page in OUT. PIXELLOOM_PROFILE=1 prints seconds."""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators import regions as R
from pixelloom.plans import params, pipelines, programs, reports
from pixelloom.sources import images


def _saved(df: DataFrame, out: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{out}/{name}")
    return df.sparkSession.read.parquet(f"{out}/{name}")


def _page(out: str, html: str) -> None:
    with open(os.path.join(out, "report.html"), "w", encoding="utf-8") as f:
        f.write(html)


def run(spark: SparkSession, program: str, folder: str, out: str, yaml: str = "") -> None:
    os.makedirs(out, exist_ok=True)
    found = images.scan(spark, folder)
    for r in images.undecodable(spark, folder).orderBy("path").toLocalIterator():
        print(f"not an image: {r.path}")
    kinds = {"fusion": params.FusionParams, "impression": params.ImpressionProgramParams, "segments": R.SegmentParams}
    if program not in (*kinds, "palettes", "dct"):
        raise SystemExit(__doc__)
    kind = kinds.get(program)
    p = (params.from_yaml(kind, yaml) if yaml.strip() else kind()) if kind else None
    most = getattr(p, "max_dim", getattr(p, "preprocess_max_dim", 1024))
    px = _saved(images.pixels(found, most), out, "pixels")
    began = time.time()
    if program == "palettes":
        rows, seconds = None, {}
        for a in pipelines.K.ALGORITHMS:
            for s in pipelines.C.SPACES:
                at = time.time()
                part = _saved(pipelines.palette_matrix(px, (a,), (s,)), out, f"palettes-{a}-{s}")
                seconds[a, s] = time.time() - at
                rows = part if rows is None else rows.unionByName(part)
        _page(out, reports.palette_html(rows, seconds=seconds))
    elif program == "dct":
        # with and without positions, of all pixels and of a sample
        variants = {"4d": (False, None), "4d sample": (False, 2048), "6d": (True, None), "6d sample": (True, 2048)}
        rows = None
        for name, (positions, sample) in variants.items():
            part = pipelines.dct_dominant(px, positions=positions, sample=sample).withColumn("variant", F.lit(name))
            rows = part if rows is None else rows.unionByName(part)
        _page(out, reports.dct_html(_saved(rows, out, "clusters")))
    elif program == "segments":
        labelled, regions = pipelines.segmented(px, p)
        _saved(labelled, out, "labels")
        rows = _saved(regions, out, "regions")
        _saved(reports.region_json(rows), out, "json")
        _page(out, reports.segment_html(rows))
    elif program == "fusion":
        f = programs.fuse(px, p)
        for name in ("pixels", "regions", "weights", "clusters", "colours"):
            _saved(getattr(f, name), out, f"fusion-{name}")
        _saved(reports.rows_json(f.weights, ["feature"]), out, "weights-json")
        print(reports.weight_table(f.weights))
        _page(out, reports.fusion_html(f.colours, f.clusters))
    else:
        i = programs.impression(px, p)
        _saved(reports.sheets(i.pixels, ["dct", "lab_grad", "spectral", "local_light", "local_sat", "bg_mask", "fg_confidence", "fused"]), out, "sheets")
        _page(out, reports.impression_html(_saved(i.palette, out, "palette"), yaml))
    print(f"{px.select('image_id').distinct().count()} images")
    if os.environ.get("PIXELLOOM_PROFILE"):
        print(f"{program}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    if len(sys.argv) not in (4, 5):
        raise SystemExit(__doc__)
    text = ""
    if len(sys.argv) == 5:
        with open(sys.argv[4], encoding="utf-8") as f:
            text = f.read()
    run(SparkSession.builder.getOrCreate(), *sys.argv[1:4], text)
