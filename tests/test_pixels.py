"""Pixel operators on small images built in code."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import clustering as K
from pixelloom.operators import frequency as Q
from pixelloom.operators import normalise as N
from pixelloom.operators import regions as R
from pixelloom.sources import images


def _image(spark, a, image_id=1):
    h, w, _ = a.shape
    rows = [(image_id, x, y, *map(int, a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")


def test_two_blocks_are_two_regions(spark):
    a = np.zeros((6, 12, 3), int)
    a[:, :6], a[:, 6:] = (240, 80, 90), (70, 110, 230)
    s = R.segment(_image(spark, a), R.SegmentParams(min_region_area=1)).toPandas()
    assert s.region.nunique() == 2 and len(s) == 72


def test_a_noisy_pixel_is_taken_in(spark):
    a = np.full((10, 10, 3), (220, 220, 230))
    a[5, 5] = (225, 219, 231)
    assert R.segment(_image(spark, a), R.SegmentParams(min_region_area=8)).toPandas().region.nunique() == 1


def test_red_and_blue(spark):
    a = np.zeros((4, 4, 3), int)
    a[:, :2, 0], a[:, 2:, 2] = 255, 255
    s = R.segment(_image(spark, a), R.SegmentParams(min_region_area=1)).toPandas()
    assert len(s) == 16 and s.edge.between(0, 1).all() and s.region.nunique() >= 1


def test_defaults():
    p = R.SegmentParams()
    got = (p.preprocess_max_dim, p.min_region_area, p.min_cluster_area_ratio, p.edge_threshold, p.edge_split_strength, p.edge_gamma, p.edge_merge_strength, p.color_merge_distance, p.small_region_color_distance, p.merge_small_regions, p.color_weight, p.edge_weight)
    assert got == (512, 50, 0.001, 0.15, 0.4, 0.65, 0.05, 8.0, 24.0, True, 1.0, 1.0)


def test_no_pixels_is_an_error(spark):
    with pytest.raises(ValueError):
        R.segment(_image(spark, np.zeros((0, 0, 3), int)))


@pytest.mark.parametrize(("w", "h", "out"), [(100, 100, (100, 100)), (1024, 512, (512, 256)), (2048, 1, (512, 1))])
def test_fit(spark, w, h, out):
    from pyspark.sql import functions as F

    got = spark.range(1).select(*images.fit(F.lit(w), F.lit(h), 512)).first()
    assert tuple(got) == out


def test_png_and_image_source(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "x_p0.png").write_bytes(images.png(a))
    (tmp_path / "note.txt").write_text("no image")
    p = images.pixels(images.scan(spark, str(tmp_path))).toPandas().sort_values(["y", "x"])
    assert (p[["r", "g", "b"]].to_numpy().reshape(5, 7, 3) == a).all()


def test_png_is_well_formed():
    raw = images.png(np.zeros((2, 3), np.uint8))
    n, kind = struct.unpack(">I4s", raw[8:16])
    assert kind == b"IHDR" and zlib.crc32(raw[12 : 16 + n]) == struct.unpack(">I", raw[16 + n : 20 + n])[0]


def test_resize_keeps_flat_colour(spark):
    out = images.resized(_image(spark, np.full((8, 16, 3), 77)), 8).toPandas()
    assert len(out) == 32 and (out[["r", "g", "b"]] == 77).all().all()


def test_constant_image_has_no_complexity(spark):
    from pyspark.sql import functions as F

    df = _image(spark, np.full((9, 9, 3), 50)).withColumn("v", F.col("r") / 255.0)
    assert Q.complexity_map(df, "v").agg(F.max("complexity")).first()[0] < 1e-4


@pytest.mark.parametrize("algorithm", K.ALGORITHMS)
def test_palette_shares(spark, data, algorithm):
    from pixelloom.sources import views

    p = K.palette(views.scenes(spark), algorithm, "RGB", 4).toPandas()
    assert np.allclose(p.groupby("image_id").proportion.sum(), 1) and (p.groupby("image_id").is_dominant.sum() == 1).all()
    # octrees may keep one more
    assert (p.groupby("image_id").size() <= 4 + (algorithm == "octree")).all()


def test_without_training_operators(tmp_path):
    """The rest imports where the optional folder and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "pixelloom"), tmp_path / "pixelloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'rgb_to_lab' in q and len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_parameters():
    from pixelloom.plans import params

    p = params.from_yaml(R.SegmentParams, "edge_threshold: 0.08\ncolor_merge_distance: 5.0\n")
    assert (p.edge_threshold, p.color_merge_distance, p.min_region_area) == (0.08, 5.0, 50)
    assert params.from_yaml(R.SegmentParams, "{}") == R.SegmentParams()
    for bad in ({"method": "x"}, {"gamma": 0.0}, {"quantile": 0.5}, {"method": "quantile"}):
        with pytest.raises(ValueError):
            params.validated(params.FilterParams(**bad))
    with pytest.raises(ValueError):
        params.from_dict(R.SegmentParams, {"no_such": 1})


def test_plans(spark):
    from pixelloom.plans import pipelines, reports

    rng = np.random.default_rng(2)
    a = np.full((20, 20, 3), (230, 230, 235))
    a[6:14, 6:14] = (200, 40, 60)
    a = np.clip(a + rng.integers(-2, 3, a.shape), 0, 255)
    px = _image(spark, a).cache()
    _, regions = pipelines.segmented(px, R.SegmentParams(min_region_area=4))
    assert reports.region_json(regions, 5).first().json.startswith('[{"color":"#')
    page = reports.palette_html(pipelines.palette_matrix(px, ("median_cut",), ("RGB",), 3), "a <b>")
    assert "a &lt;b&gt;" in page and "median_cut" in page


def test_stream(spark, tmp_path):
    from pixelloom.streaming.images import palettes

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a_p0.png").write_bytes(images.png(np.full((4, 4, 3), 90, np.uint8)))
    q = palettes(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), algorithm="median_cut", space="RGB", k=2)
    assert q.awaitTermination(60)
    # halves of one colour's pixels
    assert {r.hex for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"#5a5a5a"}


def test_flat_maps_stay_where_they_are_unit_features(spark):
    flat = {1: 0.5, 2: 0.5, 3: 1.5}
    df = spark.createDataFrame([(i, x, 0, v) for i, v in flat.items() for x in range(4)], "image_id long, x int, y int, v double")
    seen = lambda unit: {r.image_id: r.v for r in N.percentile_stretch(df, "v", unit_feature=unit).collect()}
    assert seen(False) == {1: 0, 2: 0, 3: 0}
    assert seen(True) == {1: 0.5, 2: 0.5, 3: 0}
    assert seen(F.col("image_id") < 2) == {1: 0.5, 2: 0, 3: 0}
