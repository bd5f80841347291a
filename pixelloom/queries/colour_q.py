"""Colour-space and pixel scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import colour as C
from pixelloom.queries import duck as D
from pixelloom.queries.catalog import query, r6
from pixelloom.sources import views as V

KEYS = "image_id,idx,r,g,b"


def _three(df, columns, names, n=6):
    return df.select("image_id", "idx", *[r6(c, n).alias(k) for c, k in zip(columns, names, strict=True)])


LAB3 = ("lab_l", "lab_a", "lab_b")


@query(f"SELECT image_id, idx, {', '.join(f'{D.r6(n, 5)} AS {n}' for n in LAB3)} FROM ({D.lab(D.BAG)})")
def rgb_to_lab(spark, sf_dir):
    df = V.pixel_bag(spark, sf_dir)
    return _three(df, C.lab(*C.unit("r", "g", "b")), LAB3, 5)


_LMS = ", ".join(f"cbrt({D.dot(row, ('lr', 'lg', 'lb'))}) AS {n}" for row, n in zip(C.OK_LMS, ("p", "q", "s"), strict=True))
OKLAB = f"SELECT {KEYS}, " + ", ".join(f"{D.dot(row, ('p', 'q', 's'))} AS {n}" for row, n in zip(C.OK_LAB, ("ok_l", "ok_a", "ok_b"), strict=True)) + f" FROM (SELECT {KEYS}, {_LMS} FROM ({D.linear(D.BAG)}))"


@query(f"SELECT image_id, idx, {D.r6('ok_l')} AS ok_l, {D.r6('ok_a')} AS ok_a, {D.r6('ok_b')} AS ok_b FROM ({OKLAB})")
def rgb_to_oklab(spark, sf_dir):
    return _three(V.pixel_bag(spark, sf_dir), C.oklab(*C.unit("r", "g", "b")), ("ok_l", "ok_a", "ok_b"))


HSL = f"""SELECT *, CASE WHEN d=0 THEN 0.0e0 WHEN hi=r THEN CASE WHEN g>=b THEN 60.0e0*(g-b)/d ELSE 60.0e0*(g-b)/d+360 END WHEN hi=g THEN 60.0e0*(b-r)/d+120 ELSE 60.0e0*(r-g)/d+240 END AS hue,
(hi+lo)/510.0e0 AS light, CASE WHEN d=0 THEN 0.0e0 WHEN hi+lo<=255 THEN d/(hi+lo)::DOUBLE ELSE d/(510.0e0-hi-lo) END AS sat
FROM (SELECT {KEYS}, greatest(r,g,b) AS hi, least(r,g,b) AS lo, greatest(r,g,b)-least(r,g,b) AS d FROM ({D.BAG}))"""


@query(f"SELECT image_id, idx, {D.r6('hue', 5)} AS hue, {D.r6('sat')} AS sat, {D.r6('light')} AS light FROM ({HSL})")
def rgb_to_hsl(spark, sf_dir):
    h, s, lt = C.hsl(*C.unit("r", "g", "b"))
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", r6(h, 5).alias("hue"), r6(s).alias("sat"), r6(lt).alias("light"))


def _cam_sql() -> str:
    v, n = C.VIEW, D.num
    rgb = ("lr", "lg", "lb")
    xyz = ", ".join(f"100*{D.dot(row, rgb)} AS {c}" for row, c in zip(C.TO_XYZ, "XYZ", strict=True))
    cone = ", ".join(f"{D.dot(row, ('X', 'Y', 'Z'))}*{n(d)} AS c{i}" for i, (row, d) in enumerate(zip(C.M16, v.d, strict=True)))
    adapt = ", ".join(f"sign(c{i})*400*pow({n(v.fl)}*abs(c{i})/100,0.42e0)/(pow({n(v.fl)}*abs(c{i})/100,0.42e0)+27.13e0) AS a{i}" for i in range(3))
    base = f"SELECT {KEYS}, {adapt} FROM (SELECT {KEYS}, {cone} FROM (SELECT {KEYS}, {xyz} FROM ({D.linear(D.BAG)})))"
    s1 = f"SELECT *, (11*a0-12*a1+a2)/11 AS ca, (a0+a1-2*a2)/9 AS cb, greatest(0.0e0,2*a0+a1+a2/20)*{n(v.nbb)}/{n(v.aw)} AS la FROM ({base})"
    s2 = f"SELECT *, atan2(cb,ca) AS h, 100*pow(la,{n(v.c * v.z)}) AS j FROM ({s1})"
    s3 = f"SELECT *, {n(50000 / 13 * v.nc * v.nbb)}*0.25e0*(cos(h+2)+3.8e0)*sqrt(ca*ca+cb*cb)/(a0+a1+1.05e0*a2+0.305e0) AS t FROM ({s2})"
    s4 = f"SELECT *, pow(greatest(t,0.0e0),0.9e0)*{n(v.spread)}*sqrt(j/100)*{n(v.fl**0.25)} AS m FROM ({s3})"
    return f"SELECT {KEYS}, 1.7e0*j/(1+0.007e0*j) AS jp, ln(1+0.0228e0*m)/0.0228e0*cos(h) AS ap, ln(1+0.0228e0*m)/0.0228e0*sin(h) AS bp FROM ({s4})"


@query(f"SELECT image_id, idx, {D.r6('jp', 4)} AS jp, {D.r6('ap', 4)} AS ap, {D.r6('bp', 4)} AS bp FROM ({_cam_sql()})")
def rgb_to_cam16ucs(spark, sf_dir):
    return _three(V.pixel_bag(spark, sf_dir), C.cam16ucs(*C.unit("r", "g", "b")), ("jp", "ap", "bp"), 4)


_SAME = f"SELECT image_id, idx, r, g, b FROM ({D.BAG})"


def _back(spark, sf_dir, space):
    """Converted and back: 8-bit colours survive every space."""
    df = V.pixel_bag(spark, sf_dir)
    there = df.withColumns(dict(zip(("u", "v", "w"), C.convert_to(space, *C.unit("r", "g", "b")), strict=True)))
    back = C.with_rgb(there, space, ("u", "v", "w"), ("rr", "gg", "bb"))
    return back.select("image_id", "idx", *[C.to_u8(F.col(c), True).alias(n) for c, n in zip(("rr", "gg", "bb"), "rgb", strict=True)])


@query(_SAME)
def lab_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "CIELAB")


@query(_SAME)
def oklab_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "Oklab")


@query(_SAME)
def hsl_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "HSL")


@query(_SAME)
def cam16_roundtrip(spark, sf_dir):
    return _back(spark, sf_dir, "CAM16")


@query(f"SELECT image_id, idx, {D.r6('0.299e0*r/255+0.587e0*g/255+0.114e0*b/255')} AS gray FROM ({D.BAG})")
def gray_luma(spark, sf_dir):
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", r6(C.gray(*C.unit("r", "g", "b"))).alias("gray"))


@query(f"SELECT image_id, idx, CAST((r+2*g+b)//4 AS INT) AS y, CAST(r-b AS INT) AS co, CAST(2*g-r-b AS INT) AS cg FROM ({D.BAG})")
def ycocg_int(spark, sf_dir):
    y, co, cg = C.luma_chroma(F.col("r"), F.col("g"), F.col("b"))
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", y.alias("y"), co.alias("co"), cg.alias("cg"))


@query(f"SELECT image_id, idx, {D.r6('CASE WHEN greatest(r,g,b)=0 THEN 0.0e0 ELSE (greatest(r,g,b)-least(r,g,b))/greatest(r,g,b)::DOUBLE END')} AS sat FROM ({D.BAG})")
def hsv_saturation(spark, sf_dir):
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", r6(C.saturation(*C.unit("r", "g", "b"))).alias("sat"))


_UBAG = f"SELECT image_id, idx, ur AS cr, ug AS cg, ub AS cb FROM (SELECT image_id,idx,r/255.0e0 AS ur,g/255.0e0 AS ug,b/255.0e0 AS ub FROM ({D.BAG}))"
_HI, _LO = "greatest(cr,cg,cb)", "least(cr,cg,cb)"
_TOP = f"greatest({_HI},1e-6)"
_SKIN = f"CASE WHEN {_HI}<0.06e0 THEN 0.0e0 ELSE " + "*".join((D.smooth(0.02, 0.10, f"greatest(0.0e0,(cr-cg)/{_TOP})"), D.smooth(0.0, 0.05, f"greatest(0.0e0,(cg-cb)/{_TOP})"), D.smooth(0.04, 0.10, f"({_HI}-{_LO})/{_TOP}"), D.smooth(0.06, 0.12, "(cr+cg+cb)/3"), f"(1.0e0-{D.smooth(0.90, 0.98, '(cr+cg+cb)/3')})")) + " END"


@query(f"SELECT image_id, idx, {D.r6(_SKIN)} AS skin FROM ({_UBAG})")
def skin_likeness(spark, sf_dir):
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", r6(C.skin(*C.unit("r", "g", "b"))).alias("skin"))


_NEAR = lambda c: D.clamp(f"1.0e0-least(abs(hue-{c}),360-abs(hue-{c}))/35.0e0")


@query(f"SELECT image_id, idx, {D.r6(_NEAR(0))} AS red, {D.r6(_NEAR(120))} AS green FROM ({HSL})")
def hue_affinity(spark, sf_dir):
    h = C.hsl(*C.unit("r", "g", "b"))[0]
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", r6(C.circular_affinity(h, 0.0, 35.0)).alias("red"), r6(C.circular_affinity(h, 120.0, 35.0)).alias("green"))


@query(f"SELECT image_id, idx, {D.r6('exp(-((cr-0.8e0)*(cr-0.8e0)+(cg-0.4e0)*(cg-0.4e0)+(cb-0.2e0)*(cb-0.2e0))/3/(0.32e0*0.32e0))')} AS near FROM ({_UBAG})")
def tone_affinity(spark, sf_dir):
    tone = (F.lit(0.8), F.lit(0.4), F.lit(0.2))
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", r6(C.tone_affinity(C.unit("r", "g", "b"), tone)).alias("near"))


@query(f"SELECT image_id, idx, printf('#%02x%02x%02x',r,g,b) AS lower_hex, printf('#%02X%02X%02X',r,g,b) AS upper_hex, printf('#%02x%02x%02x',CAST(floor(r*0.9e0) AS INT),CAST(floor(g*0.9e0) AS INT),CAST(floor(b*0.9e0) AS INT)) AS dimmed FROM ({D.BAG})")
def hex_codes(spark, sf_dir):
    dim = [F.floor(F.col(c) * 0.9).cast("int") for c in "rgb"]
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", C.hexed("r", "g", "b").alias("lower_hex"), C.hexed("r", "g", "b", True).alias("upper_hex"), C.hexed(*dim).alias("dimmed"))


def _heat_sql() -> str:
    u8 = lambda e: f"CAST(greatest(0,least(255,trunc({e}))) AS INT)"
    up = lambda at: u8(f"(v-{at}e0)/0.25e0*4.0e0*255")
    down = lambda at: u8(f"(1.0e0-(v-{at}e0)/0.25e0*4.0e0)*255")
    return f"""SELECT image_id, idx, CASE WHEN v<0.5 THEN 0 WHEN v<0.75 THEN {up('0.5')} ELSE 255 END AS hr, CASE WHEN v<0.25 THEN {up('0.0')} WHEN v<0.75 THEN 255 ELSE {down('0.75')} END AS hg,
CASE WHEN v<0.25 THEN 255 WHEN v<0.5 THEN {down('0.25')} ELSE 0 END AS hb FROM (SELECT image_id, idx, r/255.0e0 AS v FROM ({D.BAG}))"""


@query(_heat_sql())
def heat_ramp(spark, sf_dir):
    h = C.heat(F.col("r") / 255.0)
    return V.pixel_bag(spark, sf_dir).select("image_id", "idx", *[c.cast("int").alias(n) for c, n in zip(h, ("hr", "hg", "hb"), strict=True)])
