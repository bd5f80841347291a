"""Colour-space conversions and pixel scalars as Column expressions; channels are 0..1 unless said otherwise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Linear sRGB to XYZ (D65) and its inverse, white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
#: Oklab from linear sRGB, and back.
OK_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OK_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OK_LMS_BACK = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
OK_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
#: Cone responses of CAM16.
M16 = ((0.401288, 0.650173, -0.051461), (-0.250268, 1.204414, 0.045854), (-0.002079, 0.048952, 0.953127))
M16_BACK = ((1.86206786, -1.01125463, 0.14918677), (0.38752654, 0.62144744, -0.00897398), (-0.01584150, -0.03412294, 1.04996444))
UCS_C1, UCS_C2 = 0.007, 0.0228
SPACES = ("RGB", "CIELAB", "Oklab", "HSL", "CAM16")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def mul(m, v) -> list[Column]:
    return [v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in m]


def unit(*names: str) -> list[Column]:
    """8-bit columns as 0..1."""
    return [F.col(n) / 255.0 for n in names]


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def from_linear(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def _f(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)


def _f_back(t: Column) -> Column:
    return F.when(t > 6 / 29, t * t * t).otherwise((t * 116 - 16) * (27 / 24389))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y, z = (_f(v / w) for v, w in zip(mul(TO_XYZ, [to_linear(c) for c in (r, g, b)]), WHITE, strict=True))
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def lab_to_rgb(lc: Column, a: Column, b: Column) -> list[Column]:
    y = (lc + 16) / 116
    xyz = [_f_back(t) * w for t, w in zip((y + a / 500, y, y - b / 200), WHITE, strict=True)]
    return [clamp01(from_linear(c)) for c in mul(FROM_XYZ, xyz)]


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    return mul(OK_LAB, [F.cbrt(c) for c in mul(OK_LMS, [to_linear(c) for c in (r, g, b)])])


def oklab_to_rgb(lc: Column, a: Column, b: Column) -> list[Column]:
    lms = [c * c * c for c in mul(OK_LMS_BACK, (lc, a, b))]
    return [clamp01(from_linear(c)) for c in mul(OK_RGB, lms)]


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees below 360, saturation, lightness."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / 2
    safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
    hue = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / safe * 60 + 360, F.lit(360.0))).when(high == g, (b - r) / safe * 60 + 120).otherwise((r - g) / safe * 60 + 240)
    span = F.when(light <= 0.5, high + low).otherwise(F.lit(2.0) - high - low)
    return hue, F.when((d == 0) | (span == 0), 0.0).otherwise(d / F.when(span == 0, 1.0).otherwise(span)), light


def hsl_to_rgb(h: Column, s: Column, lt: Column) -> list[Column]:
    c = (F.lit(1.0) - F.abs(lt * 2 - 1)) * s
    k = F.pmod(h, F.lit(360.0)) / 60
    x = c * (F.lit(1.0) - F.abs(F.pmod(k, F.lit(2.0)) - 1))
    m, zero = lt - c / 2, F.lit(0.0)
    parts = ((c, x, x * 0), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x))
    out = []
    for i in range(3):
        v = parts[5][i]
        for j in range(4, -1, -1):
            v = F.when(k < j + 1, parts[j][i]).otherwise(v)
        out.append(clamp01(v + m))
    return out


class Viewing:
    """Constants of CAM16: adapting luminance 40, background 20 % of white, average surround."""

    def __init__(self, la: float = 40.0, yb: float = 20.0) -> None:
        f, self.c, self.nc = 1.0, 0.69, 1.0
        w = [100 * x for x in WHITE]
        rgb = [sum(m * x for m, x in zip(row, w, strict=True)) for row in M16]
        d = min(1.0, max(0.0, f * (1 - math.exp((-la - 42) / 92) / 3.6)))
        self.d = [d * 100 / x + 1 - d for x in rgb]
        k = 1 / (5 * la + 1)
        self.fl = k**4 * la + 0.1 * (1 - k**4) ** 2 * (5 * la) ** (1 / 3)
        self.n = yb / 100
        self.z = 1.48 + math.sqrt(self.n)
        self.nbb = 0.725 * self.n**-0.2
        a = [self._adapt(x * q) for x, q in zip(rgb, self.d, strict=True)]
        self.aw = (2 * a[0] + a[1] + a[2] / 20) * self.nbb
        self.spread = (1.64 - 0.29**self.n) ** 0.73

    def _adapt(self, v: float) -> float:
        t = (self.fl * abs(v) / 100) ** 0.42
        return math.copysign(400 * t / (t + 27.13), v)


VIEW = Viewing()


def cam16ucs(r: Column, g: Column, b: Column, v: Viewing = VIEW) -> list[Column]:
    """J', a', b'."""
    xyz = mul(TO_XYZ, [to_linear(c) * 100 for c in (r, g, b)])
    a = []
    for c, d in zip(mul(M16, xyz), v.d, strict=True):
        t = F.pow(F.abs(c * d) * (v.fl / 100), F.lit(0.42))
        a.append(F.signum(c) * t * 400 / (t + 27.13))
    ca, cb = (a[0] * 11 - a[1] * 12 + a[2]) / 11, (a[0] + a[1] - a[2] * 2) / 9
    h = F.atan2(cb, ca)
    j = F.pow(F.greatest((a[0] * 2 + a[1] + a[2] / 20) * v.nbb, F.lit(0.0)) / v.aw, F.lit(v.c * v.z)) * 100
    et = (F.cos(h + 2) + 3.8) * 0.25
    t = et * (50000 / 13 * v.nc * v.nbb) * F.sqrt(ca * ca + cb * cb) / (a[0] + a[1] + a[2] * 1.05 + 0.305)
    m = F.pow(F.greatest(t, F.lit(0.0)), F.lit(0.9)) * v.spread * F.sqrt(j / 100) * v.fl**0.25
    mp = F.log(m * UCS_C2 + 1) / UCS_C2
    return [j * (1 + 100 * UCS_C1) / (j * UCS_C1 + 1), mp * F.cos(h), mp * F.sin(h)]


def cam16ucs_to_rgb(df: DataFrame, names: tuple[str, str, str], out: tuple[str, str, str], v: Viewing = VIEW) -> DataFrame:
    """Adds R, G, B of the columns J', a', b'. Steps are columns of their own, so that no step is written out twice."""
    jp, ap, bp = (F.col(n) for n in names)
    c = lambda n: F.col(f"_cam_{n}")
    steps = (
        {"j": F.greatest(jp / (F.lit(1 + 100 * UCS_C1) - jp * UCS_C1), F.lit(0.0)), "m": (F.exp(F.sqrt(ap * ap + bp * bp) * UCS_C2) - 1) / UCS_C2, "h": F.atan2(bp, ap)},
        {"js": F.when(c("j") <= 0, 1.0).otherwise(c("j")), "cos": F.cos(c("h")), "sin": F.sin(c("h")), "p1": (F.cos(c("h") + 2) + 3.8) * (0.25 * 50000 / 13 * v.nc * v.nbb)},
        {"t": F.pow(c("m") / v.fl**0.25 / F.sqrt(c("js") / 100) / v.spread, F.lit(1 / 0.9)), "p2": F.pow(c("js") / 100, F.lit(1 / v.c / v.z)) * (v.aw / v.nbb)},
        {"g": c("t") * 23 * (c("p2") + 0.305) / (c("p1") * 23 + c("t") * 11 * c("cos") + c("t") * 108 * c("sin"))},
        {"ca": c("g") * c("cos"), "cb": c("g") * c("sin")},
        {f"a{i}": (c("p2") * 460 + c("ca") * x + c("cb") * y) / 1403 for i, (x, y) in enumerate(((451, 288), (-891, -261), (-220, -6300)))},
        {f"r{i}": F.signum(c(f"a{i}")) * (100 / v.fl) * F.pow(F.abs(c(f"a{i}")) * 27.13 / (F.lit(400.0) - F.abs(c(f"a{i}"))), F.lit(1 / 0.42)) / d for i, d in enumerate(v.d)},
        {f"x{i}": e / 100 for i, e in enumerate(mul(M16_BACK, [c(f"r{k}") for k in range(3)]))},
        {f"l{i}": e for i, e in enumerate(mul(FROM_XYZ, [c(f"x{k}") for k in range(3)]))},
    )
    used = []
    for step in steps:
        df = df.withColumns({f"_cam_{k}": e for k, e in step.items()})
        used += [f"_cam_{k}" for k in step]
    return df.withColumns({n: F.when(c("j") <= 0, 0.0).otherwise(clamp01(from_linear(c(f"l{i}")))) for i, n in enumerate(out)}).drop(*used)


def rgb_cam16ucs(rgb: np.ndarray, v: Viewing = VIEW) -> np.ndarray:
    """J', a', b' of colours (n, 3) in 0..1: ``cam16ucs`` in numpy, for an image's distinct colours."""
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    cone = (linear @ np.array(TO_XYZ).T * 100) @ np.array(M16).T * np.array(v.d)
    t = (np.abs(cone) * (v.fl / 100)) ** 0.42
    r, g, b = (np.sign(cone) * t * 400 / (t + 27.13)).T
    ca, cb = (r * 11 - g * 12 + b) / 11, (r + g - b * 2) / 9
    h = np.arctan2(cb, ca)
    j = (np.maximum((r * 2 + g + b / 20) * v.nbb, 0) / v.aw) ** (v.c * v.z) * 100
    s = (np.cos(h + 2) + 3.8) * 0.25 * (50000 / 13 * v.nc * v.nbb) * np.hypot(ca, cb) / (r + g + b * 1.05 + 0.305)
    m = np.maximum(s, 0) ** 0.9 * v.spread * np.sqrt(j / 100) * v.fl**0.25
    mp = np.log(m * UCS_C2 + 1) / UCS_C2
    return np.stack([j * (1 + 100 * UCS_C1) / (j * UCS_C1 + 1), mp * np.cos(h), mp * np.sin(h)], 1)


def cam16ucs_rgb(points: np.ndarray, v: Viewing = VIEW) -> np.ndarray:
    """R, G, B (0..1) of a few points (n, 3) of J', a', b', without a plan: ``cam16ucs_to_rgb`` in numpy."""
    jp, ap, bp = points.T
    j = np.maximum(jp / (1 + 100 * UCS_C1 - jp * UCS_C1), 0)
    m, h = (np.exp(np.hypot(ap, bp) * UCS_C2) - 1) / UCS_C2, np.arctan2(bp, ap)
    lit = np.where(j <= 0, 1.0, j)
    t = (m / v.fl**0.25 / np.sqrt(lit / 100) / v.spread) ** (1 / 0.9)
    p1, p2 = (np.cos(h + 2) + 3.8) * (0.25 * 50000 / 13 * v.nc * v.nbb), (lit / 100) ** (1 / v.c / v.z) * (v.aw / v.nbb)
    g = t * 23 * (p2 + 0.305) / (p1 * 23 + t * 11 * np.cos(h) + t * 108 * np.sin(h))
    a = np.stack([p2 * 460 + g * np.cos(h) * x + g * np.sin(h) * y for x, y in ((451, 288), (-891, -261), (-220, -6300))]) / 1403
    cone = np.sign(a) * (100 / v.fl) * (np.abs(a) * 27.13 / (400 - np.abs(a))) ** (1 / 0.42) / np.array(v.d)[:, None]
    linear = np.array(FROM_XYZ) @ (np.array(M16_BACK) @ cone / 100)
    rgb = np.where(linear <= 0.0031308, linear * 12.92, np.maximum(linear, 0) ** (1 / 2.4) * 1.055 - 0.055)
    return np.where(j <= 0, 0.0, rgb.clip(0, 1)).T


def convert_to(space: str, r: Column, g: Column, b: Column) -> list[Column]:
    return list({"RGB": lambda *c: c, "CIELAB": lab, "Oklab": oklab, "HSL": hsl, "CAM16": cam16ucs}[space](r, g, b))


def with_rgb(df: DataFrame, space: str, names: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Adds R, G, B (0..1, clamped) of columns in a colour space."""
    if space == "CAM16":
        return cam16ucs_to_rgb(df, names, out)
    back = {"RGB": lambda *x: [clamp01(v) for v in x], "CIELAB": lab_to_rgb, "Oklab": oklab_to_rgb, "HSL": hsl_to_rgb}[space]
    return df.withColumns(dict(zip(out, back(*[F.col(n) for n in names]), strict=True)))


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def luma_chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer luma and chroma of 8-bit channels."""
    return F.floor((r + g * 2 + b) / 4).cast("int"), (r - b).cast("int"), (g * 2 - r - b).cast("int")


def saturation(r: Column, g: Column, b: Column) -> Column:
    high = F.greatest(r, g, b)
    return F.when(high <= 1e-12, 0.0).otherwise((high - F.least(r, g, b)) / F.when(high <= 1e-12, 1.0).otherwise(high))


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = clamp01((v - low) / (high - low))
    return t * t * (F.lit(3.0) - t * 2)


def circular_affinity(hue: Column, centre: float, width: float) -> Column:
    """Triangular in the angle to centre, 0 from width degrees on."""
    d = F.abs(F.pmod(hue - centre + 180, F.lit(360.0)) - 180)
    return clamp01(F.lit(1.0) - d / width)


def tone_affinity(rgb, tone, scale: float = 0.32) -> Column:
    d2 = sum((a - b) * (a - b) for a, b in zip(rgb, tone, strict=True)) / 3
    return F.exp(-d2 / (scale * scale))


def heat(v: Column) -> list[Column]:
    """Four bands (fixed values): blue to cyan to green to yellow to red, 8-bit, truncated. Inside a band ramps are four times as steep
    as the band is wide, and saturate."""
    t = clamp01(v)
    u8 = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))
    up = lambda at: u8((t - at) / 0.25 * 4.0 * 255)
    down = lambda at: u8((F.lit(1.0) - (t - at) / 0.25 * 4.0) * 255)
    full, none = F.lit(255), F.lit(0)
    r = F.when(t < 0.5, none).when(t < 0.75, up(0.5)).otherwise(full)
    g = F.when(t < 0.25, up(0.0)).when(t < 0.75, full).otherwise(down(0.75))
    b = F.when(t < 0.25, full).when(t < 0.5, down(0.25)).otherwise(none)
    return [r, g, b]


def skin(r: Column, g: Column, b: Column) -> Column:
    """Likelihood of a skin tone: R leads G, G leads B, some spread, neither dark nor blown out. Edges are fixed values."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    top = F.greatest(high, F.lit(1e-6))
    lead = smoothstep(0.02, 0.10, F.greatest((r - g) / top, F.lit(0.0))) * smoothstep(0.0, 0.05, F.greatest((g - b) / top, F.lit(0.0)))
    light = (r + g + b) / 3.0
    gate = smoothstep(0.04, 0.10, (high - low) / top) * smoothstep(0.06, 0.12, light) * (F.lit(1.0) - smoothstep(0.90, 0.98, light))
    return F.when(high < 0.06, 0.0).otherwise(clamp01(lead * gate))


def to_u8(c: Column, rounding: bool) -> Column:
    v = clamp01(c) * 255
    return (F.round(v) if rounding else F.floor(v)).cast("int")


def hexed(r: Column, g: Column, b: Column, upper: bool = False) -> Column:
    """8-bit channels as #rrggbb."""
    x = "%02X" if upper else "%02x"
    return F.format_string(f"#{x}{x}{x}", r, g, b)


def from_hex(c: Column) -> list[Column]:
    """8-bit channels of #rrggbb, in either case; null for anything else."""
    ok = c.rlike("^#[0-9A-Fa-f]{6}$")
    return [F.when(ok, F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")) for i in range(3)]
