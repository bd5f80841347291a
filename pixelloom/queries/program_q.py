"""Whole programs and their operators: separation, regions' features and scores, weighted colours, overlays, reports.

Oracles have their constants typed out, not taken from the parameter classes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import colour as C
from pixelloom.operators import background as B
from pixelloom.operators import frequency as Q
from pixelloom.operators import fusion as U
from pixelloom.operators import normalise as N
from pixelloom.operators import overlays as O
from pixelloom.operators import partition as T
from pixelloom.operators import regions as R
from pixelloom.operators import segments as G
from pixelloom.operators import weighted as W
from pixelloom.plans import programs, reports
from pixelloom.queries import duck as D
from pixelloom.queries.catalog import query, r6
from pixelloom.queries.window_q import LAB_M, RANKED, XY, _at, _lab, _out, _two, stretch_sql
from pixelloom.sources import views as V

LAB = ("lab_l", "lab_a", "lab_b")
_SCALE = {"lab_l": "100", "lab_a": "128", "lab_b": "128"}


def _mosaic(spark, sf_dir):
    return B.sizes(_lab(V.mosaic64(spark, sf_dir)))


def _step(low: float, high: float, e: str) -> str:
    return D.smooth(low, high, e)


# -- normalisation ----------------------------------------------------------------------------------------------

_UA = f"SELECT {XY}, (lab_a+128)/256 AS v FROM ({LAB_M})"


@query(
    f"""SELECT {XY}, {D.r6('abs(v-c)')} AS v FROM ({_UA}) JOIN (SELECT image_id, 0.65e0*avg(CASE WHEN v>=lo AND v<=hi THEN v END)+0.35e0*max(CASE WHEN k=n//2 THEN v END) AS c FROM
({RANKED} ({_UA})) JOIN (SELECT image_id, quantile_cont(v,0.02e0) AS lo, quantile_cont(v,0.98e0) AS hi FROM ({_UA}) GROUP BY 1) USING (image_id) GROUP BY 1) USING (image_id)"""
)
def global_robust_residual(spark, sf_dir):
    df = _mosaic(spark, sf_dir).select("image_id", "x", "y", O.unit_ab(F.col("lab_a")).alias("v"))
    c = N.robust_centre(df, "v", 1.0, 0.02, 0.98, 0.65, 0.35)
    return _out(df.join(c, "image_id").withColumn("v", F.abs(F.col("v") - F.col("centre"))), "v")


def _abs(column: str) -> str:
    return stretch_sql(f"SELECT {XY}, {column} AS v FROM ({LAB_M})", 1, 99)


@query(f"SELECT {XY}, {D.r6('a.v')} AS abs_light, {D.r6('b.v')} AS abs_lab_a, {D.r6('c.v')} AS abs_lab_b FROM ({_abs('lab_l')}) a JOIN ({_abs('(lab_a+128)/256')}) b USING ({XY}) JOIN ({_abs('(lab_b+128)/256')}) c USING ({XY})")
def abs_features(spark, sf_dir):
    m = _mosaic(spark, sf_dir).select("image_id", "x", "y", F.col("lab_l").alias("abs_light"), O.unit_ab(F.col("lab_a")).alias("abs_lab_a"), O.unit_ab(F.col("lab_b")).alias("abs_lab_b"))
    return _out(N.stretch_all(m, ["abs_light", "abs_lab_a", "abs_lab_b"]), "abs_light", "abs_lab_a", "abs_lab_b")


# -- separation -------------------------------------------------------------------------------------------------

_BORDER = "(x<12 OR y<12 OR x+12>=64 OR y+12>=64)"
_MEDIAN = "SELECT image_id, " + ", ".join(f"max(CASE WHEN k_{c}=n//2 THEN {c} END) AS c_{c}" for c in LAB) + " FROM (SELECT image_id, " + ", ".join(f"{c}, row_number() OVER (PARTITION BY image_id ORDER BY {c})-1 AS k_{c}" for c in LAB) + f", count(*) OVER (PARTITION BY image_id) AS n FROM ({LAB_M}) WHERE {_BORDER}) GROUP BY 1"


@query("SELECT image_id, " + ", ".join(f"{D.r6(f'c_{c}')} AS c_{c}" for c in LAB) + f" FROM ({_MEDIAN})")
def border_median_lab(spark, sf_dir):
    return T.border_median_lab(_mosaic(spark, sf_dir), 12).select("image_id", *[r6(F.col(f"c_{c}")).alias(f"c_{c}") for c in LAB])


def _cut_sql(src: str) -> str:
    """One level: clusters halved at the upper median of the channel of highest variance."""
    var = ", ".join(f"var_pop({c}) OVER p AS v_{c}" for c in LAB)
    axis = "CASE WHEN v_lab_l>=v_lab_a AND v_lab_l>=v_lab_b THEN lab_l WHEN v_lab_a>=v_lab_b THEN lab_a ELSE lab_b END"
    a = f"SELECT *, {axis} AS ax, v_lab_l+v_lab_a+v_lab_b AS total, count(*) OVER p AS cn FROM (SELECT *, {var} FROM ({src}) WINDOW p AS (PARTITION BY image_id,path)) WINDOW p AS (PARTITION BY image_id,path)"
    b = f"SELECT *, max(CASE WHEN rk=cn//2 THEN ax END) OVER (PARTITION BY image_id,path) AS mid FROM (SELECT *, row_number() OVER (PARTITION BY image_id,path ORDER BY ax)-1 AS rk FROM ({a}))"
    c = f"SELECT *, avg(CASE WHEN ax<=mid THEN 1.0e0 ELSE 0.0e0 END) OVER (PARTITION BY image_id,path) AS share FROM ({b})"
    keep = "closed OR cn<=1 OR total<0.01e0 OR share<=0 OR share>=1 OR greatest(share,1-share)>0.95e0"
    return f"SELECT image_id,x,y,lab_l,lab_a,lab_b, {keep} AS closed, CASE WHEN {keep} THEN path WHEN ax<=mid THEN path||'0' ELSE path||'1' END AS path FROM ({c})"


_CUT = _cut_sql(_cut_sql(f"SELECT {XY}, lab_l, lab_a, lab_b, '' AS path, false AS closed FROM ({LAB_M})"))


@query(f"SELECT image_id, path, CAST(count(*) AS BIGINT) AS n, {D.r6('avg(lab_l)')} AS lab_l FROM ({_CUT}) GROUP BY 1,2")
def variance_cut(spark, sf_dir):
    """Two levels of variance-driven median cut, of all images at once."""
    df = T.cut_paths(_lab(V.mosaic64(spark, sf_dir)), 2, 0.01)
    return df.groupBy("image_id", "path").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("lab_l")).alias("lab_l"))


_CLUSTERS = f"SELECT image_id, CAST(r//32 AS INT) AS cluster, count(*) AS n, avg(CASE WHEN {_BORDER} THEN 1.0e0 ELSE 0.0e0 END) AS share, avg(lab_l) AS ml, avg(lab_a) AS ma, avg(lab_b) AS mb FROM ({LAB_M}) GROUP BY 1,2"
_GAP = "sqrt(pow((ml-c_lab_l)/100,2)+pow((ma-c_lab_a)/128,2)+pow((mb-c_lab_b)/128,2))"
_BGSCORE = D.clamp(f"share*0.6e0+{D.clamp(f'1-{_GAP}')}*0.4e0")


def _clusters(spark, sf_dir):
    return _mosaic(spark, sf_dir).withColumn("cluster", F.floor(F.col("r") / 32).cast("int"))


@query(f"SELECT image_id, cluster, CAST(n AS BIGINT) AS n, {D.r6(_BGSCORE)} AS bg_score FROM ({_CLUSTERS}) JOIN ({_MEDIAN}) USING (image_id)")
def cluster_bg_score(spark, sf_dir):
    return T.cluster_scores(_clusters(spark, sf_dir)).select("image_id", "cluster", "n", r6(F.col("bg_score")).alias("bg_score"))


@query(f"SELECT {XY}, CASE WHEN {_BGSCORE}>=0.5e0 THEN 1.0e0 ELSE 0.0e0 END AS mask FROM (SELECT {XY}, CAST(r//32 AS INT) AS cluster FROM ({D.MOSAIC})) JOIN ({_CLUSTERS}) USING (image_id, cluster) JOIN ({_MEDIAN}) USING (image_id)")
def cluster_mask(spark, sf_dir):
    df = _clusters(spark, sf_dir)
    return T.background_mask(df, T.cluster_scores(df), 0.5).select("image_id", "x", "y", "mask")


@query(
    f"""SELECT image_id, cluster, nearest, {D.r6('gap')} AS gap FROM (SELECT a.image_id, a.cluster, b.cluster AS nearest, pow((a.ml-b.ml)/100,2)+pow((a.ma-b.ma)/128,2)+pow((a.mb-b.mb)/128,2) AS gap
FROM ({_CLUSTERS}) a JOIN ({_CLUSTERS}) b ON a.image_id=b.image_id AND a.cluster<>b.cluster) QUALIFY row_number() OVER (PARTITION BY image_id,cluster ORDER BY gap,nearest)=1"""
)
def nearest_cluster_pairs(spark, sf_dir):
    return T.nearest_pairs(T.cluster_stats(_clusters(spark, sf_dir))).select("image_id", "cluster", "nearest", r6(F.col("gap")).alias("gap"))


@query(f"SELECT {XY}, " + ", ".join(f"{D.r6(f'avg({c}) OVER (PARTITION BY image_id, r0)')} AS {c}" for c in "rgb") + f" FROM (SELECT *, r//32 AS r0 FROM ({D.MOSAIC}))")
def cluster_paint(spark, sf_dir):
    return T.painted(_clusters(spark, sf_dir)).select("image_id", "x", "y", *[r6(F.col(c)).alias(c) for c in "rgb"])


@query()
def merged_clusters(spark, sf_dir):
    """Clusters of two levels, merged down to three."""
    df = T.cut_paths(_lab(V.mosaic64(spark, sf_dir)), 2, 0.01)
    return df.select("image_id", "path").join(T.merged_paths(df, 0.05, 3), ["image_id", "path"]).groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("n"))


# -- regions ----------------------------------------------------------------------------------------------------

_PRIOR = "exp(-(pow(((x+0.5e0)/64-0.5e0)/0.35e0,2)+pow(((y+0.5e0)/64-0.5e0)/0.45e0,2)))"
_PIX = f"SELECT {XY}, r/255.0e0 AS r, g/255.0e0 AS g, b/255.0e0 AS b, lab_l, lab_a, lab_b, CAST(r//32 AS INT) AS region, g/255.0e0 AS saliency, b/255.0e0 AS edge, {_PRIOR} AS subject FROM ({D.lab(D.MOSAIC, 'image_id,x,y,r,g,b')})"
_BAND8 = "(x<8 OR y<8 OR x+8>=64 OR y+8>=64)"
_MEDIAN8 = _MEDIAN.replace(_BORDER, _BAND8)
_AGG = f"""SELECT image_id, region, count(*) AS area, count(*)/4096.0e0 AS area_ratio, avg(CASE WHEN {_BAND8} THEN 1.0e0 ELSE 0.0e0 END) AS border_ratio, avg(subject) AS center, avg(saliency) AS sal, max(saliency) AS peak, avg(edge) AS em,
avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(lab_l) AS ml, avg(lab_a) AS ma, avg(lab_b) AS mb, sqrt(var_pop(lab_l)/10000+var_pop(lab_a)/16384+var_pop(lab_b)/16384) AS spread FROM ({_PIX}) GROUP BY 1,2"""
_HUE = "CASE WHEN d<=1e-12 THEN 0.0e0 WHEN hi=r THEN 60*((g-b)/d-6*floor((g-b)/d/6)) WHEN hi=g THEN 60*((b-r)/d+2) ELSE 60*((r-g)/d+4) END"
_SAT = "CASE WHEN d<=1e-12 THEN 0.0e0 ELSE least(1.0e0,d/greatest(1-abs(hi+lo-1),1e-12)) END"
_ROWS = f"""SELECT *, {D.clamp('1-spread/0.18e0')} AS stability, exp(-({_GAP}*{_GAP})/(0.18e0*0.18e0)) AS alike, {_SAT} AS sat,
greatest({D.clamp('1-least(hue,360-hue)/38.0e0')},{D.clamp('1-abs(hue-120)/38.0e0')}) AS rg,
{D.clamp(f'(center*0.35e0+{D.clamp("sal*0.65e0+peak*0.35e0")}*0.45e0+em*0.20e0)/1.0e0')} AS subj_raw FROM
(SELECT *, {_HUE} AS hue FROM (SELECT *, hi-lo AS d FROM (SELECT *, greatest(r,g,b) AS hi, least(r,g,b) AS lo FROM ({_AGG}) JOIN ({_MEDIAN8}) USING (image_id))))"""
_BGRAW = D.clamp("(border_ratio*0.26e0+alike*0.32e0+(1-sal)*0.18e0+(1-center)*0.16e0+(1-em)*0.08e0)/1.0e0")
_REGION = f"SELECT *, {D.clamp('(1-bg)*0.55e0+subj_raw*0.45e0')} AS subj FROM (SELECT *, {D.clamp(f'{_BGRAW}*(1-0.55e0*subj_raw)')} AS bg FROM ({_ROWS}))"


def _labelled(spark, sf_dir):
    m = _mosaic(spark, sf_dir)
    u = {c: F.col(c) / 255.0 for c in "rgb"}
    return m.withColumns({"region": F.floor(F.col("r") / 32).cast("int"), "saliency": u["g"], "edge": u["b"], "subject": B.subject_prior()}).withColumns(u)


@query(f"SELECT image_id, region, CAST(area AS BIGINT) AS area, {D.r6('stability')} AS stability, {D.r6('alike')} AS alike, {D.r6('sat')} AS saturation, {D.r6('rg', 5)} AS red_green, {D.r6('bg')} AS bg, {D.r6('subj')} AS subject FROM ({_REGION})")
def region_features(spark, sf_dir):
    names = {"color_stability": "stability", "border_color_similarity": "alike", "mean_saturation": "saturation", "red_green_affinity": "red_green", "bg_probability": "bg", "subject_confidence": "subject"}
    return G.region_rows(_labelled(spark, sf_dir)).select("image_id", "region", "area", *[r6(F.col(k), 5 if v == "red_green" else 6).alias(v) for k, v in names.items()])


_FLAT = _step(0.08, 0.35, "area_ratio")
_BASE = D.clamp(f"({D.clamp('pow(greatest(area_ratio,1e-9),0.55e0)')}*0.18e0+subj*0.28e0+sal*0.18e0+peak*0.20e0+(1-bg)*0.20e0+center*0.08e0+sat*0.12e0)/1.24e0")
_PEN = D.clamp(f"{_FLAT}*stability*(1-{_step(0.28, 0.38, 'sat')})")
_BON = D.clamp(f"{_FLAT}*{D.clamp('(sat-0.45e0)/0.55e0')}*rg")
_CSCORE = f"{_BASE}*(0.7e0+0.3e0*stability)*greatest(0.02e0,1-0.55e0*{_PEN})*greatest(0.05e0,1-0.45e0*bg*(1-0.65e0*sat))*(1+0.20e0*subj*greatest(0.05e0,{D.clamp('sal*0.6e0+peak*0.4e0')}))*(1+0.12e0*{_BON})*{_step(0.00075, 0.0015, 'area_ratio')}"


def _regions(spark, sf_dir):
    return G.region_scores(G.region_rows(_labelled(spark, sf_dir)))


@query(f"SELECT image_id, region, {D.r6(_PEN)} AS penalty, {D.r6(_BON, 5)} AS bonus, {D.r6(_CSCORE, 5)} AS score FROM ({_REGION})")
def region_scores(spark, sf_dir):
    return _regions(spark, sf_dir).select("image_id", "region", r6(F.col("background_penalty")).alias("penalty"), r6(F.col("vivid_rg_bonus"), 5).alias("bonus"), r6(F.col("color_score"), 5).alias("score"))


@query(f"SELECT image_id, region, {D.r6('r')} AS r, {D.r6('g')} AS g, {D.r6('b')} AS b FROM (SELECT *, {_CSCORE} AS score FROM ({_REGION})) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, region)=1")
def region_color(spark, sf_dir):
    return G.region_colour(_regions(spark, sf_dir)).select("image_id", "region", *[r6(F.col(c)).alias(c) for c in "rgb"])


def _aff(a: str, b: str) -> str:
    return f"exp(-(pow({a}r-{b}r,2)+pow({a}g-{b}g,2)+pow({a}b-{b}b,2))/3/(0.32e0*0.32e0))"


_EFF = f"SELECT a.image_id, a.region, greatest(any_value(a.area_ratio),{D.clamp('sum(b.area_ratio*b.bg*' + _aff('a.', 'b.') + ')')}) AS eff FROM ({_REGION}) a JOIN ({_REGION}) b ON a.image_id=b.image_id GROUP BY 1,2"
_TONES = "SELECT image_id, " + ", ".join(f"sum({c}*area)/sum(area) AS t{c}, sum({c}*area*bg)/sum(area*bg) AS u{c}" for c in "rgb") + f" FROM ({_REGION}) GROUP BY 1"
_QUALITY = f"({_step(0.0, 0.08, 'sat')}*0.65e0+greatest({_aff('', 't')},{_aff('', 'u')})*0.25e0+stability*0.01e0)/0.91e0"
_AMB = f"least(0.30e0,greatest(0.0e0,0.10e0*bg*{_step(0.26, 0.85, 'eff')}*{D.clamp(_QUALITY)}*{D.clamp('1-subj')}))"


@query(f"SELECT image_id, region, {D.r6('eff')} AS effective, {D.r6(_AMB, 7)} AS ambient FROM ({_REGION}) JOIN ({_EFF}) USING (image_id, region) JOIN ({_TONES}) USING (image_id)")
def ambient_weight(spark, sf_dir):
    rows = _regions(spark, sf_dir)
    eff = U.effective_areas(rows).withColumnRenamed("effective", "e")
    out = G.ambient_weights(rows).join(eff, ["image_id", "region"]).join(rows.select("image_id", "region", "area_ratio"), ["image_id", "region"])
    return out.select("image_id", "region", r6(F.greatest("area_ratio", "e")).alias("effective"), r6(F.col("ambient"), 7).alias("ambient"))


_NEUTRAL = f"0.95e0*{_step(0.05, 0.25, 'eff')}*{_step(0.45, 0.70, 'bg')}*(1-{_step(0.12, 0.22, 'sat')})*{_step(0.20, 0.55, '(1-subj)')}"
_EXTREME = f"greatest(1-{_step(18.0, 28.0, 'lab_l')},{_step(75.0, 85.0, 'lab_l')})"


@query(f"SELECT {XY}, {D.r6(D.clamp(f'pen*{D.clamp(_EXTREME)}'), 7)} AS suppression FROM ({_PIX}) JOIN (SELECT image_id, region, {_NEUTRAL} AS pen FROM ({_REGION}) JOIN ({_EFF}) USING (image_id, region)) USING (image_id, region)")
def neutral_suppression(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    pen = G.neutral_penalties(_regions(spark, sf_dir))
    p = G.lookup(df.select("image_id", "x", "y", "region", "lab_l"), pen, {"penalty": F.col("penalty")})
    return p.select("image_id", "x", "y", r6(G.neutral_suppression(F.col("penalty"), F.col("lab_l")), 7).alias("suppression"))


@query(f"SELECT {XY}, {D.r6(D.clamp('(1-bg)*0.65e0+subj*0.35e0'))} AS foreground, {D.r6('region/7.0e0')} AS region_id FROM ({_PIX}) JOIN (SELECT image_id, region, bg, subj FROM ({_REGION})) USING (image_id, region)")
def segment_foreground(spark, sf_dir):
    df = _labelled(spark, sf_dir)
    # the ramp of region numbers runs over as many regions as there are; here eight labels
    p = G.painted(df.select("image_id", "x", "y", "region"), G.region_rows(df))
    return p.select("image_id", "x", "y", r6(F.col("segment_foreground")).alias("foreground"), r6(F.col("region") / 7.0).alias("region_id"))


_RDYN = f"""SELECT image_id, {D.r6(D.clamp("CASE WHEN total<=1e-12 THEN 0.0e0 ELSE " + D.clamp("btw/total") + " END*0.45e0+" + D.clamp("coalesce(cr,0.0e0)") + "*0.35e0+" + D.clamp("(fm-bm)/0.45e0") + "*0.20e0"))} AS score FROM
(SELECT image_id, var_pop(r)*count(*) AS total, corr(r,saliency) AS cr, sum(r*(1-edge))/sum(1-edge) AS fm, sum(r*edge)/sum(edge) AS bm FROM ({_PIX}) GROUP BY 1) JOIN
(SELECT image_id, sum(n*(m-gm)*(m-gm)) AS btw FROM (SELECT image_id, region, count(*) AS n, avg(r) AS m FROM ({_PIX}) GROUP BY 1,2) JOIN (SELECT image_id, avg(r) AS gm FROM ({_PIX}) GROUP BY 1) USING (image_id) GROUP BY 1) USING (image_id)"""


@query(_RDYN)
def region_dynamic_score(spark, sf_dir):
    """The score of one feature (red), the background probability being blue."""
    df = _labelled(spark, sf_dir).withColumn("bg_probability", F.col("edge"))
    return G.region_dynamic_scores(df.select("image_id", "region", "saliency", "bg_probability", "r"), ["r"]).select("image_id", r6(F.col("region_score")).alias("score"))


# -- weighted colours -------------------------------------------------------------------------------------------

_ASSIGNED = f"SELECT image_id, CAST(r//64 AS INT) AS cluster, g/255.0e0 AS weight, b/255.0e0 AS hint FROM ({D.MOSAIC}) WHERE x%2=0 AND y%2=0"


@query(
    f"""SELECT image_id, cluster, CAST(count(*) AS BIGINT) AS n, {D.r6('sum(weight)', 5)} AS weight_sum, {D.r6('max(CASE WHEN k=floor((cn-1)*0.9e0+0.5e0) THEN weight END)')} AS p90, {D.r6('max(weight)')} AS top, {D.r6('avg(hint)')} AS background,
{D.r6('count(*)/any_value(total)::DOUBLE')} AS area FROM (SELECT *, row_number() OVER (PARTITION BY image_id,cluster ORDER BY weight)-1 AS k, count(*) OVER (PARTITION BY image_id,cluster) AS cn, count(*) OVER (PARTITION BY image_id) AS total FROM ({_ASSIGNED})) GROUP BY 1,2"""
)
def weighted_cluster_rows(spark, sf_dir):
    m = V.mosaic64(spark, sf_dir).where((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    a = m.select("image_id", F.floor(F.col("r") / 64).cast("int").alias("cluster"), F.lit(0.0).alias("r"), (F.col("g") / 255.0).alias("weight"), (F.col("b") / 255.0).alias("hint"))
    a = a.withColumns({"g": F.lit(0.0), "b": F.lit(0.0)})
    return W.cluster_rows(a).select("image_id", "cluster", F.col("count").alias("n"), r6(F.col("weight_sum"), 5).alias("weight_sum"), r6(F.col("p90_weight")).alias("p90"), r6(F.col("max_weight")).alias("top"), r6(F.col("background_mean")).alias("background"), r6(F.col("area_ratio")).alias("area"))


_FG = f"SELECT image_id, x, y, CASE WHEN r>image_id*64+100 THEN g/255.0e0 ELSE 0.0e0 END AS fg FROM ({D.MOSAIC})"


@query(f"SELECT image_id, CAST(count(*) AS BIGINT) AS n, {D.r6('sum(gate)', 4)} AS total FROM (SELECT image_id, CASE WHEN s<=0 OR s<n*0.3e0 THEN 1.0e0 WHEN fg>1e-6 THEN fg END AS gate FROM (SELECT *, sum(CASE WHEN fg>1e-6 THEN fg ELSE 0.0e0 END) OVER w AS s, count(*) OVER w AS n FROM ({_FG}) WINDOW w AS (PARTITION BY image_id))) WHERE gate IS NOT NULL GROUP BY 1")
def foreground_gate(spark, sf_dir):
    """Confidence as weight; all pixels alike where there is too little of it."""
    m = V.mosaic64(spark, sf_dir).select("image_id", "x", "y", F.when(F.col("r") > F.col("image_id") * 64 + 100, F.col("g") / 255.0).otherwise(0.0).alias("fg"))
    return W.foreground_gate(m, 0.3).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("gate"), 4).alias("total"))


@query(f"SELECT {XY}, {D.r6(D.clamp(D.clamp('fr+fg') + '*(1-fb)'))} AS weight, {D.r6(D.clamp('fr*0.55e0+fg*0.25e0+fb*0.20e0'))} AS hint FROM (SELECT {XY}, r/255.0e0 AS fr, g/255.0e0 AS fg, b/255.0e0 AS fb FROM ({D.MOSAIC}))")
def cluster_weights(spark, sf_dir):
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    return V.mosaic64(spark, sf_dir).select("image_id", "x", "y", r6(W.cluster_weight(r, g, b)).alias("weight"), r6(W.background_hint(r, g, b)).alias("hint"))


def _unit(spark, sf_dir):
    m = V.mosaic64(spark, sf_dir)
    return m.select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(c) for c in "rgb"]).withColumns({"weight": F.col("g"), "hint": F.col("b"), "fg": F.col("g")})


@query()
def weighted_clusters(spark, sf_dir):
    return W.winner(W.scored_clusters(W.impression_clusters(_unit(spark, sf_dir), 4)))


def _fg_palette(algorithm):
    def run(spark, sf_dir):
        return W.foreground_palette(_unit(spark, sf_dir), algorithm, 4)

    run.__name__ = f"foreground_palette_{algorithm}"
    return run


for _a in ("kmeanspp", "minibatch", "mediancut", "octree"):
    query()(_fg_palette(_a))


# -- overlays and reports ---------------------------------------------------------------------------------------

_TRUNC = lambda e: f"CAST(greatest(0,least(255,floor({e}))) AS INT)"
_ROUND = lambda e: f"CAST(greatest(0,least(255,floor({e}+0.5e0))) AS INT)"
_HI, _LO = "greatest(r,g,b)/255.0e0", "least(r,g,b)/255.0e0"
_HSL = f"SELECT {XY}, ({_HI}+{_LO})/2 AS light, CASE WHEN {_HI}={_LO} THEN 0.0e0 ELSE ({_HI}-{_LO})/(1-abs({_HI}+{_LO}-1)) END AS sat, lab_l, lab_a, lab_b FROM ({D.lab(D.MOSAIC, 'image_id,x,y,r,g,b')})"
_DEV = lambda c, k: _ROUND(f"abs({c}-avg({c}) OVER (PARTITION BY image_id))*{k}")


@query(f"SELECT {XY}, {_DEV('sat', '255.0e0')} AS sat, {_DEV('light', '255.0e0')} AS light, {_DEV('lab_l', '2.55e0')} AS l, {_DEV('lab_a', '1.0e0')} AS a, {_DEV('lab_b', '1.0e0')} AS b FROM ({_HSL})")
def residual_rgb_pack(spark, sf_dir):
    return O.global_residual_pack(_lab(V.mosaic64(spark, sf_dir)))


def _weights_3(src: str) -> str:
    from pixelloom.operators.stencil import kernel

    k = kernel(1.0, 3)
    return _two(src, lambda w: "(" + "+".join(f"{_at(i, w)}*{D.num(v)}" for i, v in zip(range(-3, 4), k, strict=True)) + ")")


_L8 = f"SELECT {XY}, floor({D.clamp('lab_l/100')}*255)::DOUBLE AS v FROM ({LAB_M})"


@query(f"SELECT {XY}, CAST(abs(a.v-floor(b.v+0.5e0)) AS INT) AS l FROM ({_L8}) a JOIN ({_weights_3(_L8)}) b USING ({XY})")
def local_residual_pack(spark, sf_dir):
    return O.local_residual_pack(_lab(V.mosaic64(spark, sf_dir)), 1.0, 3).select("image_id", "x", "y", "l")


_OVER = ", ".join(f"{_TRUNC(f'(0.299e0*r+0.587e0*g+0.114e0*b)*(1-b/255.0e0)+{t}.0e0*(b/255.0e0)')} AS {c}" for c, t in zip(("dr", "dg", "db"), (60, 220, 180), strict=True))
_L01 = D.clamp("lab_l/100")
_SAL = ", ".join(f"{_TRUNC(f'{_L01}*255*(1-b/255.0e0)+{t}.0e0*(b/255.0e0)')} AS {c}" for c, t in zip(("sr", "sg", "sb"), (255, 40, 40), strict=True))


@query(f"SELECT {XY}, {_OVER}, {_SAL} FROM (SELECT {XY}, r, g, b, lab_l FROM ({D.lab(D.MOSAIC, 'image_id,x,y,r,g,b')}))")
def map_overlays(spark, sf_dir):
    """A map (blue) drawn over gray and over L*."""
    m = _lab(V.mosaic64(spark, sf_dir))
    v, gray = F.col("b") / 255.0, (F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114) / 255.0
    a, b = O.complexity_overlay(v, gray), O.saliency_overlay(v, F.col("lab_l"))
    return m.select("image_id", "x", "y", *[c.alias(n) for c, n in zip(a + b, ("dr", "dg", "db", "sr", "sg", "sb"), strict=True)])


@query()
def dct_overlay(spark, sf_dir):
    """Complexity over gray, with the heat ramp beside it."""
    m = V.mosaic64(spark, sf_dir).withColumn("v", C.gray(*C.unit("r", "g", "b")))
    m = Q.complexity_map(m, "v")
    heat = C.heat(F.col("complexity"))
    return m.select("image_id", "x", "y", *O.complexity_overlay(F.col("complexity"), F.col("v")), *[h.alias(f"heat_{c}") for h, c in zip(heat, "rgb", strict=True)])


_REG = "r*65536+g*256+b"
_SC = f"SELECT *, {_REG} AS region FROM ({D.SCENES})"
_LINE = " OR ".join(f"coalesce({f}(region) OVER ({w}),region)<>region" for f in ("lag", "lead") for w in ("PARTITION BY image_id,y ORDER BY x", "PARTITION BY image_id,x ORDER BY y"))


@query(f"SELECT {XY}, " + ", ".join(f"CAST(CASE WHEN {_LINE} THEN 20 ELSE floor({c}*0.45e0+{c}*0.55e0+0.5e0) END AS INT) AS {c}" for c in "rgb") + f" FROM ({_SC})")
def region_overlay(spark, sf_dir):
    df = V.scenes(spark, sf_dir).withColumn("region", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int"))
    return O.region_overlay(df, R.region_stats(df))


@query(f"SELECT image_id, {D.r6('sum(v*x)/sum(v)')} AS cx, {D.r6('sum(v*y)/sum(v)')} AS cy FROM (SELECT {XY}, r/255.0e0 AS v FROM ({D.MOSAIC})) GROUP BY 1")
def weighted_centroid(spark, sf_dir):
    m = V.mosaic64(spark, sf_dir).withColumn("v", F.col("r") / 255.0)
    return O.weighted_centroid(m, "v").select("image_id", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


_TOP = f"SELECT image_id, r, g, b, count(*) AS area, round(count(*)*100/1024.0e0,2) AS pct, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, {_REG}) AS k FROM ({D.SCENES}) GROUP BY image_id, r, g, b"


@query(f"""SELECT image_id, '['||string_agg('{{"color":"'||printf('#%02X%02X%02X',r,g,b)||'","area_pct":'||CAST(pct AS VARCHAR)||',"area":'||CAST(area AS VARCHAR)||'}}',',' ORDER BY k)||']' AS json FROM ({_TOP}) WHERE k<=3 GROUP BY 1""")
def region_palette_json(spark, sf_dir):
    df = V.scenes(spark, sf_dir).withColumn("region", (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).cast("int"))
    return reports.region_json(R.region_stats(df), 3)


@query(f"""SELECT image_id, '['||string_agg('{{"cluster":'||CAST(cluster AS VARCHAR)||',"n":'||CAST(n AS VARCHAR)||'}}',',' ORDER BY n DESC, cluster)||']' AS json FROM (SELECT image_id, CAST(r//32 AS INT) AS cluster, count(*) AS n FROM ({D.MOSAIC}) GROUP BY 1,2) GROUP BY 1""")
def diagnostics_json(spark, sf_dir):
    rows = _clusters(spark, sf_dir).groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("_o", -F.col("n"))
    return reports.rows_json(rows, ["_o", "cluster"], ["cluster", "n"])


_W = f"SELECT image_id, lab_l, r/255.0e0 AS f, g/255.0e0 AS a, CASE WHEN b>100 THEN 0.5e0 ELSE 0.0e0 END AS s FROM ({D.lab(D.MOSAIC, 'image_id,x,y,r,g,b')})"
_WT = f"SELECT *, {D.clamp('f+a')} AS before, {D.clamp('f+a')}*(1-s) AS w FROM ({_W})"


@query(f"SELECT image_id, {D.r6('avg(CASE WHEN s>0 THEN 1.0e0 ELSE 0.0e0 END)')} AS suppressed, CAST(count_if(lab_l<20) AS BIGINT) AS dark_n, CAST(count_if(lab_l>85) AS BIGINT) AS light_n, {D.r6('avg(CASE WHEN lab_l>85 THEN before END)')} AS light_before, {D.r6('avg(CASE WHEN lab_l>85 THEN w END)')} AS light_after FROM ({_WT}) GROUP BY 1")
def weight_effect(spark, sf_dir):
    m = _mosaic(spark, sf_dir).withColumns({"filtered": F.col("r") / 255.0, "ambient": F.col("g") / 255.0, "suppression": F.when(F.col("b") > 100, 0.5).otherwise(0.0)})
    m = m.withColumn("weight", W.cluster_weight(F.col("filtered"), F.col("ambient"), F.col("suppression")))
    e = reports.weight_effect(m)
    return e.select("image_id", r6(F.col("suppressed")).alias("suppressed"), "dark_n", "light_n", r6(F.col("light_before")).alias("light_before"), r6(F.col("light_after")).alias("light_after"))


# -- programs ---------------------------------------------------------------------------------------------------


_T01 = D.clamp("t")


@query(f"SELECT {XY}, " + ", ".join(f"{D.r6(f'{c}/255.0e0*{_T01}')} AS {c}" for c in "rgb") + f" FROM (SELECT *, (b-min(b) OVER w)/greatest(max(b) OVER w-min(b) OVER w,1e-12) AS t FROM ({D.MOSAIC}) WINDOW w AS (PARTITION BY image_id))")
def composite_direct(spark, sf_dir):
    """Pixels times their blue, stretched over the image."""
    m = V.mosaic64(spark, sf_dir)
    m = m.select("image_id", "x", "y", *[(F.col(c) / 255.0).alias(c) for c in "rgb"], (F.col("b") / 255.0).alias("map"))
    return _out(U.masked(m, "map", True), "r", "g", "b")


@query(f"SELECT {XY}, r, g, b FROM ({D.MOSAIC})")
def hex_round_trip(spark, sf_dir):
    """Colours written as text and read again."""
    m = V.mosaic64(spark, sf_dir).withColumn("hex", C.hexed(F.col("r"), F.col("g"), F.col("b"), True))
    return m.select("image_id", "x", "y", *[v.alias(c) for c, v in zip("rgb", C.from_hex(F.col("hex")), strict=True)])


@query()
def fusion_program(spark, sf_dir):
    """Feature fusion of every image: its colours."""
    return programs.fuse(V.mosaic64(spark, sf_dir)).colours


@query()
def fusion_weights(spark, sf_dir):
    """Dynamic weights of all nineteen maps."""
    return programs.fuse(V.scenes(spark, sf_dir)).weights


@query()
def impression_program(spark, sf_dir):
    return programs.impression(V.mosaic64(spark, sf_dir)).palette


@query()
def bg_pipeline(spark, sf_dir):
    """How much of each image is background: clusters' candidates, flooded, cleaned, and the confident foreground."""
    m = programs.fusion_maps(V.mosaic64(spark, sf_dir))
    return m.groupBy("image_id").agg(*[F.avg(c).alias(c) for c in ("bg_candidate", "bg_barrier", "mask_before", "protect", "mask_after", "fg_raw")])
