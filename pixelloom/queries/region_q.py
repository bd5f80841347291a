"""Clustering, region, background, fusion and compositing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import colour as C
from pixelloom.operators import background as B
from pixelloom.operators import clustering as K
from pixelloom.operators import frequency as Q
from pixelloom.operators import fusion as U
from pixelloom.operators import regions as R
from pixelloom.queries import duck as D
from pixelloom.queries.catalog import query, r6
from pixelloom.queries.window_q import COL, K6, L_M, LAB_M, LAB_S, ROW, XY, _lab, _light, _two, edge_sql, stretch_sql
from pixelloom.sources import views as V

CENTRES = [(0, [30.0, 40.0, 200.0]), (1, [120.0, 125.0, 60.0]), (2, [200.0, 220.0, 120.0]), (3, [60.0, 180.0, 20.0])]
_DIST = [f"(r-{p[0]})*(r-{p[0]})+(g-{p[1]})*(g-{p[1]})+(b-{p[2]})*(b-{p[2]})" for _, p in CENTRES]
_MIN = "least(" + ",".join(_DIST) + ")"
_ASSIGN = f"SELECT image_id, idx, r, g, b, CASE {' '.join(f'WHEN {d}={_MIN} THEN {k}' for k, d in enumerate(_DIST))} END AS cluster FROM ({D.BAG})"


@query(f"SELECT image_id, idx, CAST(cluster AS INT) AS cluster FROM ({_ASSIGN})")
def kmeans_assign(spark, sf_dir):
    return K.assign(V.pixel_bag(spark, sf_dir), CENTRES, ["r", "g", "b"]).select("image_id", "idx", "cluster")


@query(f"SELECT CAST(cluster AS INT) AS cluster, {D.r6('sum((g+1)*r)/sum(g+1)::DOUBLE')} AS r, {D.r6('sum((g+1)*b)/sum(g+1)::DOUBLE')} AS b, CAST(count(*) AS BIGINT) AS n FROM ({_ASSIGN}) GROUP BY 1")
def kmeans_weighted_update(spark, sf_dir):
    a = K.assign(V.pixel_bag(spark, sf_dir), CENTRES, ["r", "g", "b"])
    return K.update(a, ["r", "b"], F.col("g") + 1.0).select("cluster", r6(F.col("r")).alias("r"), r6(F.col("b")).alias("b"), "n")


@query(f"SELECT CAST(cluster AS INT) AS cluster, {D.r6('avg(r)')} AS r, {D.r6('avg(g)')} AS g, {D.r6('avg(b)')} AS b FROM ({_ASSIGN}) GROUP BY 1")
def kmeans_one_lloyd(spark, sf_dir):
    new = K.lloyd(V.pixel_bag(spark, sf_dir), ["r", "g", "b"], CENTRES, rounds=1)
    return spark.createDataFrame([(k, *p) for k, p in new], "cluster int, r double, g double, b double").select("cluster", *[r6(F.col(c)).alias(c) for c in "rgb"])


_PATH = "||".join(f"CAST(((r>>{7 - d})&1)*4+((g>>{7 - d})&1)*2+((b>>{7 - d})&1) AS VARCHAR)" for d in range(8))


@query(f"SELECT image_id, {_PATH} AS path, CAST(count(*) AS BIGINT) AS n, CAST(sum(r) AS BIGINT) AS sum_r FROM ({D.BAG}) GROUP BY 1,2")
def octree_leaves_rgb(spark, sf_dir):
    return K.octree_leaves(V.pixel_bag(spark, sf_dir)).select("image_id", "path", "n", "sum_r")


_Q = ", ".join(f"greatest(0,CAST(ceil(({c}-min({c}) OVER w)/greatest(1,max({c}) OVER w-min({c}) OVER w)::DOUBLE*256)-1 AS INT)) AS q{c}" for c in "rgb")
_QPATH = "||".join(f"CAST(((qr>>{7 - d})&1)*4+((qg>>{7 - d})&1)*2+((qb>>{7 - d})&1) AS VARCHAR)" for d in range(8))


@query(f"SELECT image_id, {_QPATH} AS path, CAST(count(*) AS BIGINT) AS n FROM (SELECT image_id, {_Q} FROM ({D.BAG}) WINDOW w AS (PARTITION BY image_id)) GROUP BY 1,2")
def octree_leaves_range(spark, sf_dir):
    return K.octree_range_leaves(V.pixel_bag(spark, sf_dir), ["r", "g", "b"]).select("image_id", "path", "n")


def _palette(algorithm, space):
    return lambda spark, sf_dir: K.palette(V.pixel_bag(spark, sf_dir), algorithm, space)


for _a in K.ALGORITHMS:
    for _s in C.SPACES:
        _f = _palette(_a, _s)
        _f.__name__ = f"palette_{_a}_{_s.lower()}"
        query()(_f)


@query()
def impression_palette(spark, sf_dir):
    """Weighted palette: weights by saturation."""
    return K.palette(V.mosaic64(spark, sf_dir), "kmeans", "CIELAB", 5, weight=C.saturation(*C.unit("r", "g", "b")))


def _lab_c(spark, sf_dir):
    m = _lab(V.mosaic64(spark, sf_dir)).withColumn("v", F.col("lab_l") / 100)
    return B.sizes(Q.complexity_map(m, "v")).withColumns({"fx": F.col("x") / F.col("w"), "fy": F.col("y") / F.col("h")})


@query()
def dct4d_clusters(spark, sf_dir):
    m = _lab_c(spark, sf_dir)
    c = K.clusters_nd(m, ["lab_l", "lab_a", "lab_b", "complexity"])
    return K.dominant(c.join(m.select("image_id", "x", "y", "complexity"), ["image_id", "x", "y"]))


@query()
def dct6d_minibatch_clusters(spark, sf_dir):
    m = _lab_c(spark, sf_dir)
    c = K.clusters_nd(m, ["lab_l", "lab_a", "lab_b", "complexity", "fx", "fy"], sample=2048)
    return K.dominant(c.join(m.select("image_id", "x", "y", "complexity"), ["image_id", "x", "y"]))


# -- regions ----------------------------------------------------------------------------------------------------

# Limits that follow from the defaults, typed out: wall 0.45, growth 23.4, 72 * 0.45, 42 * 0.45, 180 * 0.45.
_M = {"wall": 0.45, "grow2": 547.56, "rgb2": 1049.76, "y": 18, "chroma": 81}
_EDGES = edge_sql(LAB_S)


def _link_sql(w: str) -> str:
    n = {k: f"lead({k}) OVER ({w})" for k in ("r", "g", "b", "edge")}
    d2 = f"((r-{n['r']})*(r-{n['r']})+(g-{n['g']})*(g-{n['g']})+(b-{n['b']})*(b-{n['b']}))"
    y = f"abs((r+2*g+b)//4-({n['r']}+2*{n['g']}+{n['b']})//4)"
    ch = f"(abs((r-b)-({n['r']}-{n['b']}))+abs((2*g-r-b)-(2*{n['g']}-{n['r']}-{n['b']})))"
    return f"(NOT ({d2}>={D.num(_M['rgb2'])} OR {y}>={_M['y']} OR {ch}>={_M['chroma']}) AND (edge+{n['edge']})*0.175e0<{D.num(_M['wall'])} AND {d2}<={D.num(_M['grow2'])})"


_ROWW, _COLW = ROW, COL


@query(f"SELECT image_id, CAST(count_if(rt) AS BIGINT) AS right_links, CAST(count_if(dn) AS BIGINT) AS down_links FROM (SELECT image_id, {_link_sql(_ROWW)} AS rt, {_link_sql(_COLW)} AS dn FROM ({_EDGES})) GROUP BY 1")
def neighbour_links(spark, sf_dir):
    p = R.with_links(R.with_edges(V.scenes(spark, sf_dir)))
    return p.groupBy("image_id").agg(F.count_if("right").alias("right_links"), F.count_if("down").alias("down_links"))


_KEY = "r*65536+g*256+b"


@query(
    f"""SELECT image_id, CAST({_KEY} AS INT) AS region, CAST(count(*) AS BIGINT) AS area, {D.r6('avg(x)')} AS cx, {D.r6('avg(y)')} AS cy, min(x) AS x0, max(y) AS y1, CAST((sum(r)+count(*)//2)//count(*) AS INT) AS mean_r
FROM ({D.SCENES}) GROUP BY image_id, r, g, b"""
)
def region_stats(spark, sf_dir):
    df = V.scenes(spark, sf_dir).withColumn("region", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int"))
    return R.region_stats(df).select("image_id", "region", "area", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"), "x0", "y1", "mean_r")


def _adj_sql() -> str:
    parts = []
    for w in (_ROWW, _COLW):
        n = ", ".join(f"lead({k}) OVER ({w}) AS n{k}" for k in ("r", "g", "b", "edge", "region"))
        parts.append(f"SELECT *, {n} FROM (SELECT *, {_KEY} AS region FROM ({_EDGES}))")
    d = "sqrt((r-nr)*(r-nr)+(g-ng)*(g-ng)+(b-nb)*(b-nb))"
    y = "abs((r+2*g+b)//4-(nr+2*ng+nb)//4)"
    ch = "(abs((r-b)-(nr-nb))+abs((2*g-r-b)-(2*ng-nr-nb)))"
    e = f"greatest(least(1.0e0,greatest({d}/72.0e0,{y}/42.0e0,{ch}/180.0e0)),(edge+nedge)*0.5e0)"
    return f"SELECT image_id, CAST(least(region,nregion) AS INT) AS a, CAST(greatest(region,nregion) AS INT) AS b, CAST(count(*) AS BIGINT) AS length, {D.r6(f'sum({e})', 4)} AS sum_edge, {D.r6(f'sum({d})', 4)} AS sum_color FROM ({' UNION ALL '.join(parts)}) WHERE nregion IS NOT NULL AND nregion<>region GROUP BY 1, 2, 3"


@query(_adj_sql())
def region_adjacency(spark, sf_dir):
    df = R.with_edges(V.scenes(spark, sf_dir)).withColumn("region", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int"))
    return R.adjacency(df).select("image_id", "a", "b", "length", r6(F.col("sum_edge"), 4).alias("sum_edge"), r6(F.col("sum_color"), 4).alias("sum_color"))


@query()
def segment_full(spark, sf_dir):
    return R.region_stats(R.segment(V.scenes(spark, sf_dir)))


@query(f"SELECT image_id, string_agg(printf('%06X:%d',k,n),';' ORDER BY n DESC, k) AS palette FROM (SELECT image_id, {_KEY} AS k, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, {_KEY}) AS rk FROM ({D.SCENES}) GROUP BY image_id, r, g, b) WHERE rk<=5 GROUP BY 1")
def top5_regions(spark, sf_dir):
    from pyspark.sql import Window

    g = V.scenes(spark, sf_dir).groupBy("image_id", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = g.withColumn("rk", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "k"))).where("rk <= 5")
    item = F.format_string("%06X:%d", "k", "n")
    return top.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", item.alias("s")))), lambda x: x["s"]), ";").alias("palette"))


_FLOOD = f"""WITH RECURSIVE p AS ({D.SCENES}), f(image_id,x,y) AS (SELECT image_id,x,y FROM p WHERE x=0 AND y=0
UNION SELECT n.image_id,n.x,n.y FROM f JOIN p c ON c.image_id=f.image_id AND c.x=f.x AND c.y=f.y JOIN p n ON n.image_id=f.image_id AND abs(n.x-f.x)+abs(n.y-f.y)=1
AND (c.r-n.r)*(c.r-n.r)+(c.g-n.g)*(c.g-n.g)+(c.b-n.b)*(c.b-n.b)<=551) SELECT image_id, CAST(count(*) AS BIGINT) AS reached FROM f GROUP BY 1"""


@query(_FLOOD)
def flood_fill_bg(spark, sf_dir):
    d2 = sum((F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in "rgb")
    found = R.reached(V.scenes(spark, sf_dir), (F.col("x") == 0) & (F.col("y") == 0), d2 <= 551)
    return found.groupBy("image_id").agg(F.count(F.lit(1)).alias("reached"))


# -- background -------------------------------------------------------------------------------------------------

_BORDER = "x<3 OR y<3 OR x+3>=64 OR y+3>=64"
_PROTO = f"SELECT image_id, lab_l AS pl, lab_a AS pa, lab_b AS pb FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y,x)-1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM ({LAB_M}) WHERE {_BORDER}) WHERE k%greatest(1,n//96)=0 AND k/greatest(1,n//96)<96"
_RAWBG = f"SELECT image_id, x, y, exp(-min(pow((lab_l-pl)/100,2)+pow((lab_a-pa)/128,2)+pow((lab_b-pb)/128,2))/(0.16e0*0.16e0)) AS v FROM ({LAB_M}) JOIN ({_PROTO}) USING (image_id) GROUP BY 1,2,3"
_BG = _two(_RAWBG, lambda w: f"avg(v) OVER ({w} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)")


def _bg(spark, sf_dir):
    return B.border_likelihood(_lab(V.mosaic64(spark, sf_dir)))


@query(f"SELECT {XY}, {D.r6('v')} AS border_bg FROM ({_BG})")
def border_likelihood(spark, sf_dir):
    return _bg(spark, sf_dir).select("image_id", "x", "y", r6(F.col("border_bg")).alias("border_bg"))


_PRIOR = "exp(-(pow(((x+0.5e0)/64-0.5e0)/0.35e0,2)+pow(((y+0.5e0)/64-0.5e0)/0.45e0,2)))"


@query(f"SELECT {XY}, {D.r6(_PRIOR)} AS subject FROM ({D.MOSAIC})")
def subject_prior(spark, sf_dir):
    return B.sizes(V.mosaic64(spark, sf_dir)).select("image_id", "x", "y", r6(B.subject_prior()).alias("subject"))


@query(f"SELECT image_id, CAST(count_if(v>0.9e0) AS BIGINT) AS candidates, CAST(count_if(v<0.97e0 AND (gr>0.5e0 OR re>0.8e0)) AS BIGINT) AS barriers FROM ({_BG}) JOIN (SELECT {XY}, g/255.0e0 AS gr, r/255.0e0 AS re FROM ({D.MOSAIC})) USING ({XY}) GROUP BY 1")
def flood_barrier(spark, sf_dir):
    m = _bg(spark, sf_dir).withColumns({"gr": F.col("g") / 255.0, "re": F.col("r") / 255.0})
    m = m.select("image_id", B.candidate(0.9).alias("c"), B.barrier({"gr": 0.5, "re": 0.8}, 0.97).alias("s"))
    return m.groupBy("image_id").agg(F.sum("c").cast("bigint").alias("candidates"), F.sum("s").cast("bigint").alias("barriers"))


@query(f"SELECT {XY}, {D.r6('v', 5)} AS protect FROM ({stretch_sql(f'SELECT {XY}, r/255.0e0*0.4e0+g/255.0e0*0.6e0 AS v FROM ({D.MOSAIC})', 70, 99)})")
def fg_protect(spark, sf_dir):
    m = V.mosaic64(spark, sf_dir).withColumns({"f1": F.col("r") / 255.0, "f2": F.col("g") / 255.0})
    return B.protect(m, {"f1": 0.4, "f2": 0.6}).select("image_id", "x", "y", r6(F.col("protect"), 5).alias("protect"))


_SBG = f"SELECT {XY}, {D.clamp('CASE WHEN b>100 THEN 0.08e0 ELSE 0.0e0 END+v*0.92e0')} AS v FROM ({_BG}) JOIN ({D.MOSAIC}) USING ({XY})"


@query(f"SELECT {XY}, {D.r6('v')} AS soft_bg FROM ({_SBG})")
def soft_bg(spark, sf_dir):
    m = _bg(spark, sf_dir).withColumn("mask", F.when(F.col("b") > 100, 1.0).otherwise(0.0))
    return B.soft_background(m, "mask").select("image_id", "x", "y", r6(F.col("soft_bg")).alias("soft_bg"))


@query()
def soft_fg(spark, sf_dir):
    m = _bg(spark, sf_dir).withColumn("mask", F.when(F.col("b") > 100, 1.0).otherwise(0.0)).withColumn("subject", B.subject_prior())
    return B.soft_foreground(B.soft_background(m, "mask")).select("image_id", "x", "y", r6(F.col("soft_fg")).alias("soft_fg"))


# -- fusion -----------------------------------------------------------------------------------------------------

_F3 = {"dct": 0.5, "lab_grad": 0.3, "abs_sat": 0.2}
_MAPS = f"SELECT {XY}, r/255.0e0 AS dct, g/255.0e0 AS lab_grad, b/255.0e0 AS abs_sat FROM ({D.MOSAIC})"


def _maps(spark, sf_dir):
    return V.mosaic64(spark, sf_dir).select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(n) for c, n in zip("rgb", _F3, strict=True)])


_RK = "row_number() OVER (PARTITION BY image_id,feature ORDER BY v)-1 AS k, count(*) OVER (PARTITION BY image_id,feature) AS n"
_LONG = f"SELECT image_id, feature, v FROM (UNPIVOT ({_MAPS}) ON dct, lab_grad, abs_sat INTO NAME feature VALUE v)"


def _pick(q: float) -> str:
    return f"max(CASE WHEN k=least(floor(n*{D.num(q / 100)}),n-1) THEN v END) OVER w"


_STATS = f"""SELECT image_id, feature, var_pop(greatest(lo,least(hi,v))) AS variance, max(p5) AS p5, max(p95) AS p95, avg(v) AS mean, max(p95)-max(p5) AS range_, greatest(0.0e0,max(p95)/(avg(v)+1e-6)-1) AS peakiness
FROM (SELECT *, {_pick(2)} AS lo, {_pick(98)} AS hi, {_pick(5)} AS p5, {_pick(95)} AS p95 FROM (SELECT *, {_RK} FROM ({_LONG})) WINDOW w AS (PARTITION BY image_id,feature)) GROUP BY 1,2"""


@query(f"SELECT image_id, feature, {D.r6('variance')} AS variance, {D.r6('p5')} AS p5, {D.r6('p95')} AS p95, {D.r6('mean')} AS mean, {D.r6('peakiness', 5)} AS peakiness FROM ({_STATS})")
def feature_stats(spark, sf_dir):
    s = U.feature_stats(_maps(spark, sf_dir), list(_F3))
    return s.select("image_id", "feature", *[r6(F.col(c), 5 if c == "peakiness" else 6).alias(c) for c in ("variance", "p5", "p95", "mean", "peakiness")])


_PIX = D.clamp(D.clamp("variance/0.05e0") + "*0.45e0+" + D.clamp("range_/0.65e0") + "*0.35e0+" + D.clamp("peakiness/4.0e0") + "*0.2e0")
_BASE = " ".join(f"WHEN '{k}' THEN {D.num(v)}" for k, v in _F3.items())


@query(f"SELECT image_id, feature, {D.r6(f'({_PIX}*1.45e0+0.35e0)*CASE feature {_BASE} END')} AS weight FROM ({_STATS}) UNION ALL SELECT DISTINCT image_id, 'spectral', 0.0e0 FROM ({D.MOSAIC})")
def dynamic_weights(spark, sf_dir):
    """Features without base weight are reported with weight 0."""
    w = U.dynamic_weights(_maps(spark, sf_dir), {**_F3, "spectral": 0.0})
    return w.select("image_id", "feature", r6(F.col("add_weight")).alias("weight"))


_ADD = "(dct*0.5e0+lab_grad*0.3e0+abs_sat*0.2e0)"
_MUL = "exp(ln(dct*0.9e0+0.1e0)*0.25e0+ln(lab_grad*0.9e0+0.1e0)*0.25e0+ln(abs_sat*0.9e0+0.1e0)*0.5e0)"


@query(f"SELECT {XY}, {D.r6(D.clamp(f'pow({_ADD},2.5e0)'))} AS added, {D.r6(D.clamp(f'pow({_MUL},2.5e0)'))} AS multiplied, {D.r6(D.clamp(f'pow({_ADD}*0.1e0+{_MUL}*0.9e0,2.5e0)'))} AS hybrid FROM ({_MAPS})")
def hybrid_fusion(spark, sf_dir):
    a, m, h = U.hybrid([F.col(c) for c in _F3], list(_F3.values()), [1.0, 1.0, 2.0])
    return _maps(spark, sf_dir).select("image_id", "x", "y", r6(a).alias("added"), r6(m).alias("multiplied"), r6(h).alias("hybrid"))


@query(f"SELECT {XY}, {D.r6(D.clamp(_ADD))} AS fused, {D.r6(f'dct*{D.clamp(_ADD)}')} AS composite FROM ({_MAPS})")
def linear_fusion(spark, sf_dir):
    v = U.linear([F.col(c) for c in _F3], list(_F3.values()))
    return _maps(spark, sf_dir).select("image_id", "x", "y", r6(v).alias("fused"), r6(F.col("dct") * v).alias("composite"))


_CL = f"""SELECT image_id, CAST(r//64 AS INT) AS cluster, avg(r)/255 AS cr, avg(g)/255 AS cg, avg(b)/255 AS cb, count(*)/sum(count(*)) OVER (PARTITION BY image_id)::DOUBLE AS area_ratio, avg(g)/255 AS mean_weight, max(g)/255.0e0 AS p90_weight, avg(b)/255 AS background_mean FROM ({D.MOSAIC}) GROUP BY 1,2"""


def _score_sql() -> str:
    hi, lo = "greatest(cr,cg,cb)", "least(cr,cg,cb)"
    sat = f"(({hi}-{lo})/greatest({hi},1e-12))"
    top = f"greatest({hi},1e-6)"
    skin = f"CASE WHEN {hi}<0.06e0 THEN 0.0e0 ELSE " + "*".join((D.smooth(0.02, 0.10, f"greatest(0.0e0,(cr-cg)/{top})"), D.smooth(0.0, 0.05, f"greatest(0.0e0,(cg-cb)/{top})"), D.smooth(0.04, 0.10, f"({hi}-{lo})/{top}"), D.smooth(0.06, 0.12, "(cr+cg+cb)/3"), f"(1.0e0-{D.smooth(0.90, 0.98, '(cr+cg+cb)/3')})")) + " END"
    base = "(pow(area_ratio,0.45e0)*0.45e0+mean_weight*0.35e0+pow(p90_weight,0.8e0)*0.20e0)"
    neutral = f"greatest(0.02e0,1-(1-{D.smooth(0.16, 0.26, sat)})*{D.smooth(0.08, 0.35, 'area_ratio')}*0.75e0)"
    back = f"greatest(0.05e0,1-background_mean*(1-{sat}*0.65e0)*0.35e0)"
    return f"{base}*({sat}*0.25e0+1)*{neutral}*{back}*greatest(0.02e0,1-({skin})*0.6e0)*{D.smooth(0.001, 0.002, 'area_ratio')}"


@query(f"SELECT image_id, cluster, {D.r6(_score_sql())} AS score FROM ({_CL})")
def cluster_score(spark, sf_dir):
    from pyspark.sql import Window

    m = V.mosaic64(spark, sf_dir).groupBy("image_id", F.floor(F.col("r") / 64).cast("int").alias("cluster"))
    g = m.agg(*[(F.avg(c) / 255).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"), (F.max("g") / 255.0).alias("p90_weight"))
    g = g.withColumns({"area_ratio": F.col("n") / F.sum("n").over(Window.partitionBy("image_id")), "mean_weight": F.col("g"), "background_mean": F.col("b")})
    return g.select("image_id", "cluster", r6(U.cluster_score(U.ScoreParams(skin_strength=0.6))).alias("score"))


_RG = f"SELECT image_id, CAST(r//64 AS INT) AS region, avg(r)/255 AS cr, avg(g)/255 AS cg, avg(b)/255 AS cb, count(*)/4096.0e0 AS area_ratio, avg(b)/255 AS bg FROM ({D.MOSAIC}) GROUP BY 1,2"


@query(f"SELECT a.image_id AS image_id, a.region AS region, {D.r6(D.clamp('sum(b.area_ratio*b.bg*exp(-(pow(a.cr-b.cr,2)+pow(a.cg-b.cg,2)+pow(a.cb-b.cb,2))/3/(0.32e0*0.32e0)))'))} AS effective FROM ({_RG}) a JOIN ({_RG}) b ON a.image_id=b.image_id GROUP BY 1,2")
def effective_bg_area(spark, sf_dir):
    g = V.mosaic64(spark, sf_dir).groupBy("image_id", F.floor(F.col("r") / 64).cast("int").alias("region")).agg(*[(F.avg(c) / 255).alias(c) for c in "rgb"], (F.count(F.lit(1)) / 4096.0).alias("area_ratio"))
    return U.effective_areas(g.withColumn("bg_probability", F.col("b"))).select("image_id", "region", r6(F.col("effective")).alias("effective"))


# -- compositing, reports ---------------------------------------------------------------------------------------

# two layers of an image: its channels in order, and turned; weights 0.5 and 0.8
_LAYERS = (("r", "g", "b", "0.5e0"), ("g", "b", "r", "0.8e0"))


def _chain(mode: str, threshold: int = 16, result: int = 0) -> str:
    start = "255.0e0" if mode == "multiply" else "0.0e0"
    s = f"SELECT {XY}, r, g, b, {start} AS a0, {start} AS a1, {start} AS a2 FROM ({D.MOSAIC})"
    for *own, w in _LAYERS:
        bright = f"{own[0]}*0.299e0+{own[1]}*0.587e0+{own[2]}*0.114e0"
        v = [f"a{i}*pow({c}/255.0e0,{w})" if mode == "multiply" else f"least(255.0e0,a{i}+{c}*{w})" for i, c in enumerate(own)]
        s = f"SELECT {XY}, r, g, b, {', '.join(f'CASE WHEN {bright}<{threshold} THEN a{i} ELSE floor({x}+0.5e0) END AS a{i}' for i, x in enumerate(v))} FROM ({s})"
    dark = f"a0*0.299e0+a1*0.587e0+a2*0.114e0<{result}"
    return f"SELECT {XY}, {', '.join(f'CAST(CASE WHEN {dark} THEN 0 ELSE a{i} END AS INT) AS {c}' for i, c in enumerate('rgb'))} FROM ({s})"


def _layers(spark, sf_dir):
    m = V.mosaic64(spark, sf_dir)
    d = lambda c: F.col(c).cast("double")
    one = F.array(*[F.struct(F.lit(i).alias("layer"), d(x).alias("r"), d(y).alias("g"), d(z).alias("b"), F.lit(w).alias("weight")) for i, (x, y, z, w) in enumerate((("r", "g", "b", 0.5), ("g", "b", "r", 0.8)))])
    return m.select("image_id", "x", "y", F.inline(one))


@query(_chain("add", 110, 90))
def add_composite(spark, sf_dir):
    """Layers below luma 110 are skipped; a result below 90 is black."""
    return U.composite(_layers(spark, sf_dir), "add", 110, 90)


@query(_chain("multiply"))
def multiply_composite(spark, sf_dir):
    return U.composite(_layers(spark, sf_dir), "multiply")


_NAMES = "SELECT l_orderkey, 'img/'||CAST(l_orderkey AS VARCHAR)||'_p'||CAST(l_linenumber%3 AS VARCHAR)||CASE WHEN l_linenumber%2=0 THEN '_dct_heat' ELSE '' END||'.PNG' AS path FROM lineitem"


@query(f"SELECT prefix, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT regexp_extract(path,'/([^/]*_p[0-9]+)[^/]*$',1) AS prefix, coalesce(nullif(regexp_extract(path,'_p[0-9]+_(.*)[.][^.]*$',1),''),'original') AS label FROM ({_NAMES}) WHERE lower(path) LIKE '%.png') GROUP BY 1")
def file_groups(spark, sf_dir):
    from pixelloom.sources.images import grouped

    li = V.table(spark, sf_dir, "lineitem")
    heat = F.when(F.col("l_linenumber") % 2 == 0, "_dct_heat").otherwise("")
    path = F.concat(F.lit("img/"), F.col("l_orderkey").cast("string"), F.lit("_p"), (F.col("l_linenumber") % 3).cast("string"), heat, F.lit(".PNG"))
    g = grouped(li.select(path.alias("path")))
    return g.select("prefix", "n", F.array_join(F.array_sort(F.array_distinct("labels")), ",").alias("labels"))
