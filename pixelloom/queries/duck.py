"""Text of DuckDB SQL that the oracles share: pixel views, colour conversions, small functions."""

from __future__ import annotations

from pixelloom.functions import colour

TILE8 = "SELECT vec_id AS image_id, CAST(p%8 AS INT) AS x, CAST(p//8 AS INT) AS y, CAST(embedding[p+1] AS DOUBLE) AS v FROM embeddings, range(64) t(p)"
MOSAIC = f"""SELECT image_id,x,y,max(CASE WHEN ch=0 THEN u8 END) AS r,max(CASE WHEN ch=1 THEN u8 END) AS g,max(CASE WHEN ch=2 THEN u8 END) AS b
FROM (SELECT CAST(floor(image_id/192) AS BIGINT) AS image_id, CAST(y*8+x AS INT) AS x, CAST(image_id%64 AS INT) AS y, CAST(floor((image_id%192)/64) AS INT) AS ch,
CAST(least(255,greatest(0,floor((v+0.6e0)/1.2e0*256))) AS INT) AS u8 FROM ({TILE8})) m GROUP BY image_id,x,y HAVING count(*)=3"""
BAG = "SELECT CAST(l_suppkey AS BIGINT) AS image_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax)-1 AS BIGINT) AS idx, CAST(l_quantity*5 AS INT) AS r, CAST(round(l_discount*100)*25 AS INT) AS g, CAST(round(l_tax*100)*31 AS INT) AS b FROM lineitem"
_IN_DISC = "pow(p%32-16,2)+pow(floor(p/32)-17,2)<=64"
SCENES = f"""SELECT CAST(s AS BIGINT) AS image_id, CAST(p%32 AS INT) AS x, CAST(floor(p/32) AS INT) AS y,
CAST(CASE s%4 WHEN 0 THEN (CASE WHEN p%32<16 THEN 240 ELSE 70 END) WHEN 1 THEN 220+CASE WHEN p=16*32+16 THEN 5 ELSE 0 END WHEN 2 THEN CASE WHEN {_IN_DISC} THEN 200 ELSE 235 END ELSE (p%32)*8 END AS INT) AS r,
CAST(CASE s%4 WHEN 0 THEN (CASE WHEN p%32<16 THEN 80 ELSE 110 END) WHEN 1 THEN 220 WHEN 2 THEN CASE WHEN {_IN_DISC} THEN 40 ELSE 235 END ELSE floor(p/32)*8 END AS INT) AS g,
CAST(CASE s%4 WHEN 0 THEN (CASE WHEN p%32<16 THEN 90 ELSE 230 END) WHEN 1 THEN 230 WHEN 2 THEN CASE WHEN {_IN_DISC} THEN 60 ELSE 240 END ELSE 128 END AS INT) AS b
FROM (SELECT unnest(range(4*greatest(1,(SELECT count(*) FROM supplier)//100))) AS s) a, range(1024) c(p)"""
VIEWS = {"tile8": TILE8, "mosaic64": MOSAIC, "pixel_bag": BAG, "scenes": SCENES}


def num(v: float) -> str:
    s = repr(float(v))
    return s if "e" in s else s + "e0"


def r6(e: str, n: int = 6) -> str:
    return f"round({e},{n})+0.0e0"


def clamp(e: str) -> str:
    return f"greatest(0.0e0,least(1.0e0,{e}))"


def lin(c: str) -> str:
    return f"CASE WHEN {c}<=0.04045e0 THEN {c}/12.92e0 ELSE pow(({c}+0.055e0)/1.055e0,2.4e0) END"


def gam(c: str) -> str:
    return f"CASE WHEN {c}<=0.0031308e0 THEN {c}*12.92e0 ELSE pow(greatest({c},0.0e0),{num(1 / 2.4)})*1.055e0-0.055e0 END"


def dot(row, names) -> str:
    return "(" + "+".join(f"{n}*({num(k)})" for k, n in zip(row, names, strict=True)) + ")"


def smooth(low: float, high: float, e: str) -> str:
    t = clamp(f"(({e})-{num(low)})/{num(high - low)}")
    return f"({t}*{t}*(3.0e0-2.0e0*{t}))"


def linear(src: str, keys: str = "image_id,idx,r,g,b") -> str:
    """lr, lg, lb beside the keys."""
    return f"SELECT {keys}, {lin('(r/255.0e0)')} AS lr, {lin('(g/255.0e0)')} AS lg, {lin('(b/255.0e0)')} AS lb FROM ({src})"


def lab(src: str, keys: str = "image_id,idx,r,g,b") -> str:
    """lab_l, lab_a, lab_b beside the keys."""
    rgb, names = ("lr", "lg", "lb"), ("tx", "ty", "tz")
    xyz = ", ".join(f"{dot(row, rgb)}/{num(w)} AS {n}" for row, w, n in zip(colour.TO_XYZ, colour.WHITE, names, strict=True))
    f = ", ".join(f"CASE WHEN {n}>{num(216 / 24389)} THEN cbrt({n}) ELSE ({n}*{num(24389 / 27)}+16)/116 END AS f{n}" for n in names)
    return f"SELECT {keys}, fty*116-16 AS lab_l, (ftx-fty)*500 AS lab_a, (fty-ftz)*200 AS lab_b FROM (SELECT {keys}, {f} FROM (SELECT {keys}, {xyz} FROM ({linear(src, keys)})))"
