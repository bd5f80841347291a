"""Planes against windows, trees against plain ones, and whole programs on small scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import colour as C
from pixelloom.operators import background as B
from pixelloom.operators import clustering as K
from pixelloom.operators import frequency as Q
from pixelloom.operators import fusion as U
from pixelloom.operators import normalise as N
from pixelloom.operators import overlays as O
from pixelloom.operators import partition as T
from pixelloom.operators import planes as P
from pixelloom.operators import regions as R
from pixelloom.operators import segments as G
from pixelloom.operators import stencil as S
from pixelloom.operators import weighted as W
from pixelloom.plans import params, programs, reports
from pixelloom.sources import images


def _table(spark, *arrays):
    rows = [(i, x, y, *map(int, a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).integers(0, 256, (21, 26, 3))


@pytest.fixture(scope="module")
def disc():
    y, x = np.mgrid[:40, :48]
    a = np.full((40, 48, 3), (232, 234, 238))
    a[(x - 24) ** 2 + (y - 21) ** 2 <= 100] = (200, 40, 60)
    return np.clip(a + np.random.default_rng(4).integers(-2, 3, a.shape), 0, 255)


def _plane(df, column, shape):
    t = df.select("x", "y", column).toPandas().sort_values(["y", "x"])
    return t[column].to_numpy(float).reshape(shape)


def test_planes_equal_windows(spark, noise):
    shape = noise.shape[:2]
    df = _table(spark, noise).withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), C.lab(*C.unit("r", "g", "b")), strict=True))).withColumn("v", C.gray(*C.unit("r", "g", "b"))).cache()
    planes, v = P.lab_planes(noise / 255), P.gray(noise / 255)
    same = lambda d, column, plane: np.testing.assert_allclose(_plane(d, column, shape), plane, atol=1e-9)
    for c, p in zip(("lab_l", "lab_a", "lab_b"), planes, strict=True):
        same(df, c, p)
    same(S.box_blur(df, ["v"], 3), "v", P.box(v, 3))
    same(S.opening(df, ["v"], 2), "v", P.opening(v, 2))
    same(S.closing(df, ["v"], 1), "v", P.closing(v, 1))
    same(S.unsharp(df, "v", 2, 0.6), "v", P.unsharp(v, 2, 0.6))
    same(S.sobel(df, ["lab_l"]), "lab_l", P.sobel(planes[0]))
    same(S.edge_strength(df), "edge", P.edge_strength(planes, 0.15, 0.65))
    same(Q.complexity_map(df, "v", 3), "complexity", P.complexity(v, 3))
    same(Q.complexity_windows(df, "v", 3), "complexity", P.complexity(v, 3))
    same(N.percentile_stretch(df, "v", 5, 95), "v", P.stretch(v, 5, 95))
    same(B.border_likelihood(df, 3, 4), "border_bg", P.border_likelihood(planes, 3, 4))
    sat, light = P.hsl_planes(noise / 255)
    _, s, lt = C.hsl(*C.unit("r", "g", "b"))
    same(df.withColumns({"s": s, "l": lt}), "s", sat)
    same(df.withColumns({"s": s, "l": lt}), "l", light)
    centre = N.robust_centre(df, "v", 1.0, 0.02, 0.98, 0.65, 0.35).first().centre
    assert abs(centre - P.robust_centre(v)) < 1e-9


def test_cam16_in_numpy_equals_the_expressions(spark):
    colours = np.random.default_rng(7).integers(0, 256, (40, 3))
    df = spark.createDataFrame([tuple(map(int, c)) for c in colours], "r int, g int, b int")
    got = np.array(df.select(*C.cam16ucs(*C.unit("r", "g", "b"))).collect())
    np.testing.assert_allclose(C.rgb_cam16ucs(colours / 255), got, atol=1e-8)
    np.testing.assert_allclose(C.cam16ucs_rgb(got), colours / 255, atol=2e-3)


def test_robust_centre_modes():
    a = np.linspace(0.1, 0.9, 101)
    for p in (P.CentreParams(), P.CentreParams("gamma", gamma_power=0.5)):
        assert abs(P.robust_centre(a, p) - 0.5) < 0.05
    assert 0 <= P.robust_centre(a, P.CentreParams("log")) <= 1
    with pytest.raises(ValueError):
        P.robust_centre(a, P.CentreParams("other"))


def test_segments_of_planes_equal_those_of_tables(spark, noise, disc):
    for a in (noise, disc):
        for p in (R.SegmentParams(min_region_area=8), R.SegmentParams(min_region_area=8, morph_open_radius=1, morph_close_radius=1)):
            label, edge = R.segment_planes(a, p)
            t = R.segment(_table(spark, a), p)
            np.testing.assert_allclose(_plane(t, "edge", a.shape[:2]), edge, atol=1e-9)
            assert (_plane(t, "region", a.shape[:2]) == label).all()


def test_components_against_flood():
    r = np.random.default_rng(5)
    for _ in range(30):
        h, w = r.integers(1, 12, 2)
        right, down = r.random((h, w - 1)) < 0.5, r.random((h - 1, w)) < 0.5
        label, at = np.full((h, w), -1), 0
        for y in range(h):
            for x in range(w):
                if label[y, x] >= 0:
                    continue
                todo = [(y, x)]
                while todo:
                    i, j = todo.pop()
                    if label[i, j] >= 0:
                        continue
                    label[i, j] = at
                    todo += [(i, j + 1)] * bool(j + 1 < w and right[i, j]) + [(i, j - 1)] * bool(j and right[i, j - 1])
                    todo += [(i + 1, j)] * bool(i + 1 < h and down[i, j]) + [(i - 1, j)] * bool(i and down[i - 1, j])
                at += 1
        assert (P.components(right, down) == label).all()


def test_cuts_of_planes_equal_those_of_tables(spark, noise):
    df = _table(spark, noise).withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), C.lab(*C.unit("r", "g", "b")), strict=True)))
    paths = T.cut_paths(df, 3, 0.01).toPandas().sort_values(["y", "x"])
    number = {p: i for i, p in enumerate(sorted(paths.path.unique()))}
    lab = np.stack([p.ravel() for p in P.lab_planes(noise / 255)], 1)
    assert paths.path.map(number).tolist() == T.cut_labels(lab, 3, 0.01).tolist()


def test_merging_keeps_all_pixels():
    r = np.random.default_rng(6)
    n, sums = r.integers(1, 60, 12), r.random((12, 3)) * 100
    label = T.merge_clusters(n, sums * n[:, None], 0.05, 4)
    assert set(label) == set(range(label.max() + 1)) and label.max() < 4
    assert T.merge_clusters(np.array([5]), np.ones((1, 3)), 0.5, 4).tolist() == [0]


def test_separation_finds_the_disc(disc):
    s = T.separated(P.lab_planes(disc / 255))
    inside = (disc[..., 1] < 100)
    assert s.mask[inside].mean() < 0.1 and s.mask[~inside].mean() > 0.7
    off = T.separated(P.lab_planes(disc / 255), T.PartitionParams(enabled=False))
    assert (off.mask == 0).all()


def _plain_octree(path, w, k):
    """One pixel colour after the other into a tree of nodes, then reduced."""

    class Node:
        def __init__(self):
            self.kids, self.n, self.leaf, self.items = {}, 0.0, True, []

    root, split, leaves = Node(), [[] for _ in range(9)], 0
    for i, (row, c) in enumerate(zip(path.tolist(), w, strict=True)):
        node = root
        for d, o in enumerate(row):
            if o not in node.kids:
                node.kids[o] = Node()
                leaves += 1
                if node.leaf:
                    node.leaf = False
                    leaves -= 1
                    split[d].append(node)
            node = node.kids[o]
        node.n += c
        node.items.append(i)
    while leaves > k and any(split):
        node = [s for s in split if s][-1].pop()
        kids = [node.kids[o] for o in sorted(node.kids)]
        need = leaves - k
        if leaves - len(kids) + 1 >= k or need >= len(kids):
            node.items = [i for c in kids for i in c.items]
            node.n += sum(c.n for c in kids)
            node.kids, node.leaf = {}, True
            leaves -= len(kids) - 1
        else:
            gone = sorted(kids, key=lambda c: c.n)[:need]
            node.kids = {o: c for o, c in node.kids.items() if c not in gone}
            leaves -= need
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out += [sorted(node.items)] if node.leaf and node.n else []
        todo += node.kids.values()
    return sorted(out)


def test_octree_against_a_plain_tree():
    r = np.random.default_rng(1)
    for t in range(30):
        rgb = r.integers(0, 256, (int(r.integers(1, 300)), 3)) if t % 2 else r.integers(0, 12, (200, 3)) * 20
        rgb = rgb[np.sort(np.unique(rgb, axis=0, return_index=True)[1])]
        w, k = r.integers(1, 30, len(rgb)).astype(float), int(r.integers(1, 14))
        path = K.octants(rgb / 255, rgb)
        assert sorted(sorted(x.tolist()) for x in K.octree(path, w, k)) == _plain_octree(path, w, k)


def test_median_cut_halves_pixels():
    p, w = np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0]]), np.array([1.0, 8, 1])
    buckets = K.median_cut(p, w, 2)
    assert [n.sum() for _, n in buckets] == [5, 5] and sum(n.sum() for _, n in K.median_cut(p, w, 5)) == 10
    assert len(K.median_cut(p[:1], np.array([1.0]), 4)) == 1


def test_budget_cut_and_even_sample():
    p = np.random.default_rng(2).random((100, 3))
    label = W.budget_cut(p, 5)
    assert len(set(label)) == 5 and (W.budget_cut(p, 1) == 0).all()
    assert W.even_sample(10, 20).tolist() == list(range(10)) and W.even_sample(100, 4).tolist() == [12, 37, 62, 87]


def test_generator_and_seeds():
    draw = W.uniform(42)
    first = next(draw)
    assert 0 <= first < 1 and first != next(draw) and next(W.uniform(42)) == first
    p = np.random.default_rng(3).random((50, 3))
    assert (W.seeded(p, 4, 42)[0] == p[0]).all() and (W.seeded(np.ones((9, 3)), 3, 42) == 1).all()


def test_weighted_clusters(spark, disc):
    df = _table(spark, disc).select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    red = F.when(F.col("g") < 0.4, 1.0).otherwise(0.02)
    s = W.scored_clusters(W.impression_clusters(df.withColumns({"weight": red, "hint": 1 - red}), 4))
    best = W.winner(s).first()
    assert best.r > 0.7 and best.g < 0.3 and abs(s.agg(F.sum("area_ratio")).first()[0] - 1) < 1e-9
    few = W.impression_clusters(df.limit(3).withColumns({"weight": F.lit(1.0), "hint": F.lit(0.0)}), 8, stride=1)
    assert few.select("cluster").distinct().count() == 1


def test_region_colour_without_a_score(spark):
    rows = spark.createDataFrame([(1, 0, 0.1, 0.2, 0.3, 0.0), (2, 0, 0.1, 0.2, 0.3, 0.5), (2, 1, 0.4, 0.5, 0.6, 0.5)], "image_id long, region int, r double, g double, b double, color_score double")
    got = {x.image_id: (x.region, x.r, x.score) for x in G.region_colour(rows).collect()}
    assert got == {1: (None, 0.0, 0.0), 2: (0, 0.1, 0.5)}


def test_composite_of_scaled_layers(spark):
    rows = [(1, 0, x, y, 100.0, 100.0, 100.0, 0.5) for x in range(4) for y in range(2)] + [(1, 1, x, 0, 200.0, 20.0, 20.0, 1.0) for x in range(2)]
    layers = spark.createDataFrame(rows, "image_id long, layer int, x int, y int, r double, g double, b double, weight double")
    scaled = U.scaled_to_first(layers)
    assert scaled.where("layer = 1").count() == 8 and scaled.where("layer = 0").count() == 8
    got = U.composite(scaled, "add", 10.0).collect()
    assert len(got) == 8 and {(x.r, x.g, x.b) for x in got} == {(250, 70, 70)}
    assert {(x.r, x.g) for x in U.composite(scaled, "add", 90.0, 60.0).collect()} == {(0, 0)}


def test_programs(spark, disc):
    px = _table(spark, disc, np.roll(disc, 5, 1))
    f = programs.fuse(px)
    colours = {(x.image_id, x.kind): x for x in f.colours.collect()}
    assert set(colours) == {(i, k) for i in range(2) for k in ("weighted", "region")}
    assert all(c.r > 0.6 and c.g < 0.4 for c in colours.values())
    weights = f.weights.collect()
    assert len(weights) == 2 * len(U.FEATURES) and {x.multiplier for x in weights if x.feature == "subject_prior"} == {0.0}
    assert {x.multiplier for x in weights if x.feature == "segment_foreground"} == {1.0}
    assert "dct" in reports.weight_table(f.weights) and "weighted" in reports.fusion_html(f.colours, f.clusters)
    effect = reports.weight_effect(f.pixels).collect()
    assert len(effect) == 2 and all(0 <= x.suppressed <= 1 for x in effect)
    i = programs.impression(px, params.ImpressionProgramParams(palette=params.PaletteParams("mediancut", 3)))
    rows = i.palette.collect()
    assert len(rows) == 6 and abs(sum(x.proportion for x in rows) - 2) < 1e-9
    assert "Configuration" in reports.impression_html(i.palette, "a: <b>")
    sheet = reports.sheets(i.pixels, ["dct", "fg_confidence", "fused"], 2, 60)
    assert all(bytes(x.png).startswith(b"\x89PNG") and x.labels == ["original", "dct", "fg_conf", "fused"] for x in sheet.collect())
    assert "data:image/png" in reports.sheet_html(sheet)


def test_programs_without_partition_or_filtering(spark, disc):
    px = _table(spark, disc)
    off = params.from_dict(params.ImpressionProgramParams, {"color_partition": {"enabled": False}})
    assert programs.impression(px, off).palette.count() == 1
    p = params.from_dict(params.FusionParams, {"background": {"partition": {"enabled": False}}, "filter": {"method": "quantile", "quantile": 0.3, "threshold": 0.0}, "dynamic_weights": {"enabled": False}})
    assert p.background.partition.border_band == 12 and p.background.flood_barrier == params.BarrierParams()
    got = programs.fuse(px, p)
    assert got.pixels.agg(F.max("mask_raw")).first()[0] == 1.0 and got.colours.count() == 2


def test_parameter_groups():
    p = params.from_dict(params.FusionParams, {"max_dim": 100, "global_residual": {"light": {"trim_high": 90.0}}, "impression": {"cluster_scoring": {"area_weight": 0.1}}})
    assert p.max_dim == 100 and p.global_residual.light == P.CentreParams("gamma", 0.0, 90.0, 0.7, 0.3)
    assert p.impression.cluster_scoring.area_weight == 0.1 and p.impression.cluster_scoring.area_power == 0.65 and p.impression.k == 8
    for bad in ({"nothing": 1}, {"impression": {"nothing": 1}}, {"impression": {"cluster_scoring": {"nothing": 1}}}):
        with pytest.raises(ValueError):
            params.from_dict(params.FusionParams, bad)


def test_default_values_of_weights_and_scores():
    d, s = U.DynamicParams(), U.ScoreParams()
    assert (d.min_multiplier, d.max_multiplier, d.range_ref, d.peakiness_ref, d.low, d.high) == (0.35, 1.80, 0.65, 4.0, 2.0, 98.0)
    assert (s.area_power, s.peak_power, s.area_weight, s.mean_weight, s.peak_weight, s.neutral_sat, s.neutral_strength, s.skin_strength, s.min_area) == (0.45, 0.80, 0.45, 0.35, 0.20, 0.16, 0.75, 0.0, 0.002)


def test_centroid_marker(spark):
    a = np.zeros((9, 9, 3), int)
    a[4, 4] = 255
    df = B.sizes(_table(spark, a)).withColumn("v", F.col("r") / 255.0)
    got = {(x.x, x.y): (x.r, x.g) for x in O.with_centroid(df, "v").collect()}
    assert got[4, 4] == (255, 0) and got[4, 6] == (255, 0) and got[4, 7] == (255, 255) and got[0, 0] == (0, 0)
    assert O.weighted_centroid(df.withColumn("v", F.lit(0.0)), "v").first().cx is None


def test_pages_escape_their_text(spark):
    assert reports.table([("<script>".replace("<", "&"), 1.0)], ("a & b",)).count("<td>") == 2
    assert "a &amp; b" in reports.page("a & b", [])
    clusters = spark.createDataFrame([(1, "4d", 0, 0.4, 0.1, 0.2), (1, "4d", 1, 0.6, 0.3, 0.8)], "image_id long, variant string, cluster int, proportion double, avg_c double, score double")
    assert reports.dct_html(clusters).count(" *</p>") == 1
    regions = spark.createDataFrame([(1, 0, 10, 1, 2, 3), (1, 1, 30, 255, 0, 16)], "image_id long, region int, area long, mean_r int, mean_g int, mean_b int")
    assert "2 regions" in reports.segment_html(regions) and "#FF0010" in reports.segment_html(regions)


def test_folders_bad_files_and_previews(spark, tmp_path):
    for folder in ("in", "out"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"7_p0{'_heat' * (folder == 'out')}.png").write_bytes(images.png(np.full((300, 500, 3), 90, np.uint8)))
    (tmp_path / "in/bad.png").write_text("no image")
    found = images.listed(spark, [str(tmp_path / "in"), str(tmp_path / "out")])
    groups = images.grouped(found)
    own = groups.where("prefix = '7_p0'").first()
    assert found.count() == 3 and own.n == 2 and sorted(own.labels) == ["heat", "original"]
    assert reports.matching_groups(groups, "7_").count() == 1 and reports.matching_groups(groups, "8").count() == 0
    assert any('"prefix":"7_p0"' in x.json for x in reports.groups_json(groups).collect())
    assert images.undecodable(spark, str(tmp_path / "in")).count() == 1
    px = images.pixels(images.scan(spark, str(tmp_path / "out")), 100)
    assert (px.agg(F.max("x")).first()[0], px.agg(F.max("y")).first()[0]) == (99, 59)
    assert images.thumbnails(px, 20).first().uri.startswith("data:image/png;base64,iVBOR")


@pytest.mark.parametrize(("raw", "text"), [(b"", ""), (b"Man", "TWFu"), (b"Ma", "TWE="), (b"M", "TQ==")])
def test_data_uris(raw, text):
    assert images.data_uri(raw).split(",")[1] == text


@pytest.mark.parametrize("program", ["dct", "segments", "fusion", "impression"])
def test_command_line(spark, tmp_path, disc, program, monkeypatch, capsys):
    from pixelloom.__main__ import run

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a_p0.png").write_bytes(images.png(disc.astype(np.uint8)))
    (tmp_path / "in/bad.png").write_text("no image")
    monkeypatch.setenv("PIXELLOOM_PROFILE", "1")
    run(spark, program, str(tmp_path / "in"), str(tmp_path / "out"), "max_dim: 30" if program in ("fusion", "impression") else "")
    said = capsys.readouterr().out
    assert "not an image" in said and "1 images" in said and f"{program}: " in said
    assert "<h2>" in (tmp_path / "out/report.html").read_text()
    with pytest.raises(SystemExit):
        run(spark, "other", str(tmp_path / "in"), str(tmp_path / "out"))


def test_palettes_of_a_folder(spark, tmp_path, monkeypatch):
    from pixelloom.__main__ import run

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a_p0.png").write_bytes(images.png(np.random.default_rng(1).integers(0, 255, (6, 7, 3)).astype(np.uint8)))
    monkeypatch.setattr(K, "ALGORITHMS", ("median_cut",))
    monkeypatch.setattr(C, "SPACES", ("RGB", "Oklab"))
    run(spark, "palettes", str(tmp_path / "in"), str(tmp_path / "out"))
    assert "2 combinations" in (tmp_path / "out/report.html").read_text()
