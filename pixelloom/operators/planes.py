"""Filters on whole planes of one image (numpy arrays of rows), for programs that need some thirty of them at once.

``stencil``, ``normalise``, ``frequency`` and ``background`` have the same operators as windows over pixel tables, where an
image's size bounds nothing; here an image is one group, bounded by the loader's max_dim, and no map is shuffled. Tests compare the two. Numbers in the expressions are fixed
values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from pixelloom.functions import colour as C

from .frequency import _gauss, residual_plane
from .stencil import kernel  # noqa: F401  (the same kernel as the window form's)

PROTOTYPES = 96


def lab_planes(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L*, a*, b* of an image (h, w, 3) in 0..1."""
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    t = [linear @ np.array(row) / white for row, white in zip(C.TO_XYZ, C.WHITE, strict=True)]
    x, y, z = (np.where(v > 216 / 24389, np.cbrt(v), (v * 24389 / 27 + 16) / 116) for v in t)
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def hsl_planes(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation and lightness."""
    high, low = rgb.max(-1), rgb.min(-1)
    light, span = (high + low) / 2, high - low
    return np.where(span <= 1e-12, 0.0, span / np.maximum(1 - np.abs(2 * light - 1), 1e-12)).clip(0, 1), light


def gray(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def _axes(a: np.ndarray, one) -> np.ndarray:
    """A one-dimensional filter of the last axis along rows, then along columns."""
    return one(one(a).T).T


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of the samples in range; fewer at the edges."""
    if r <= 0:
        return a

    def one(v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        total = np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, 1)], 1)
        low, high = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r, n - 1) + 1
        return (total[:, high] - total[:, low]) / (high - low)

    return _axes(a, one)


def _extreme(a: np.ndarray, r: int, pick, beyond: float) -> np.ndarray:
    one = lambda v: pick(np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (r, r)), constant_values=beyond), 2 * r + 1, axis=1), axis=2)
    return _axes(a, one) if r > 0 else a


def erode(a: np.ndarray, r: int) -> np.ndarray:
    return _extreme(a, r, np.min, np.inf)


def dilate(a: np.ndarray, r: int) -> np.ndarray:
    return _extreme(a, r, np.max, -np.inf)


def opening(a: np.ndarray, r: int) -> np.ndarray:
    return dilate(erode(a, r), r)


def closing(a: np.ndarray, r: int) -> np.ndarray:
    return erode(dilate(a, r), r)


def unsharp(a: np.ndarray, r: int, amount: float) -> np.ndarray:
    return (a + (a - box(a, r)) * amount).clip(0, 1) if amount > 0 and r > 0 else a


def _gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel sums; NaN on the border."""
    gx, gy = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    if min(a.shape) >= 3:
        step, smooth = a[:, 2:] - a[:, :-2], a[:, :-2] + 2 * a[:, 1:-1] + a[:, 2:]
        gx[1:-1, 1:-1] = step[:-2] + 2 * step[1:-1] + step[2:]
        gy[1:-1, 1:-1] = smooth[2:] - smooth[:-2]
    return gx, gy


def sobel(a: np.ndarray) -> np.ndarray:
    gx, gy = _gradients(a)
    return np.nan_to_num(np.sqrt(gx * gx + gy * gy) / 8)


def lab_gradient(planes) -> np.ndarray:
    return np.sqrt(sum(sobel(p) ** 2 for p in planes))


def edge_strength(planes, threshold: float, gamma: float) -> np.ndarray:
    """L1 Sobel energy of L*, a*, b*, from a cutoff on; the border has the maximum; tiny images are all edge."""
    if min(planes[0].shape) < 3:
        return np.ones(planes[0].shape)
    energy = sum(np.abs(g) * w for p, w in zip(planes, (1.0, 0.95, 0.95), strict=True) for g in _gradients(p))
    top = max(1.0, float(np.nanmax(energy)))
    energy = np.where(np.isnan(energy), top, energy)
    cut = max(min(1.0, max(0.0, threshold)) * top, 1.0)
    e = np.where(energy <= cut, 0.0, (energy - cut) / max(top - cut, 1.0)).clip(0, 1)
    return e ** min(3.0, max(0.2, gamma))


def complexity(a: np.ndarray, least: int = 4) -> np.ndarray:
    """Share of an 8x8 block's AC energy at frequencies u + v >= least, around every pixel.

    The block's energy is the sum of its squares (the transform is orthonormal), so only low frequencies are transformed.
    """
    p = np.pad(a, ((4, 3), (4, 3)), mode="edge")
    windows = lambda v, axis: np.lib.stride_tricks.sliding_window_view(v, 8, axis=axis)
    k = np.arange(8)
    basis = [math.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * k + 1) * u * math.pi / 16) for u in range(least)]
    energy = windows(windows(p * p, 1).sum(-1), 0).sum(-1)
    rows = [windows(p, 1) @ b for b in basis]
    low, dc = 0.0, 0.0
    for u in range(least):
        for v in range(least - u):
            f = windows(rows[u], 0) @ basis[v]
            if u == v == 0:
                dc = f * f
            else:
                low = low + f * f
    ac = np.maximum(energy - dc, 0)
    return np.maximum(ac - low, 0) / (ac + 1e-10)


def at_rank(a: np.ndarray, rank: int) -> float:
    return float(np.partition(a, rank, axis=None)[rank])


def stretch(a: np.ndarray, low: float = 1.0, high: float = 99.0, unit: bool = False) -> np.ndarray:
    """Between two rank percentiles; with unit a flat map in 0..1 stays as it is."""
    n = a.size
    lo, hi = at_rank(a, min(int(n * (low / 100)), n - 1)), at_rank(a, min(math.ceil(n * (high / 100)), n - 1))
    if unit and hi - lo < 1e-12 and a.min() >= -1e-9 and a.max() <= 1 + 1e-9:
        return a
    return ((a - lo) / max(hi - lo, 1e-12)).clip(0, 1)


# Defaults of the robust centre.
@dataclass(frozen=True)
class CentreParams:
    compression: str = "gamma"
    trim_low: float = 2.0
    trim_high: float = 98.0
    trimmed_mean_weight: float = 0.65
    median_weight: float = 0.35
    gamma_power: float = 1.0
    log_base: float = math.e


def _compress(v, p: CentreParams):
    """To the domain in which the centre is sought, and back."""
    if p.compression == "gamma":
        return v**p.gamma_power, lambda c: c ** (1 / p.gamma_power)
    if p.compression != "log":
        raise ValueError(f"compression must be gamma or log, not {p.compression}")
    tiny = 1e-10
    unit = math.log(1 + tiny) / math.log(p.log_base)
    return np.log(tiny + v) / math.log(p.log_base) / unit, lambda c: p.log_base ** (c * unit) - tiny


def robust_centre(a: np.ndarray, p: CentreParams = CentreParams()) -> float:
    """A mix of the trimmed mean and the upper median in the compressed domain, taken back and kept in 0..1."""
    v, back = _compress(a.reshape(-1), p)
    low, high = np.percentile(v, [p.trim_low, p.trim_high])
    inside = v[(v >= low) & (v <= high)]
    total = max(p.trimmed_mean_weight + p.median_weight, 1e-12)
    centre = (p.trimmed_mean_weight * (inside.mean() if len(inside) else at_rank(v, len(v) // 2)) + p.median_weight * at_rank(v, len(v) // 2)) / total
    return float(np.clip(back(centre), 0, 1))


def global_residual(a: np.ndarray, p: CentreParams = CentreParams()) -> np.ndarray:
    return np.abs(a - robust_centre(a, p))


def local_residual(a: np.ndarray, sigma: float) -> np.ndarray:
    """Difference from a Gaussian blur, of 8-bit planes."""
    v = np.floor(a.clip(0, 1) * 255)
    return np.abs(v - np.floor(_gauss(v, sigma, min(20, max(1, round(2 * sigma)))) + 0.5)) / 255


def spectral(planes, k: int, sigma: float, gamma: float = 1.0, post: float = 1.0, weights=None) -> np.ndarray:
    """Spectral residual of L*, a*, b*. Without weights: gamma on L* first, norm of the normalised residuals, min-max and gamma;
    with weights: their weighted mean and gamma."""
    r = max(1, round(3 * sigma))
    if weights is None:
        first = np.sign(planes[0]) * np.abs(planes[0]) ** gamma
        s = np.sqrt(sum(residual_plane(p, k, sigma, r) ** 2 for p in (first, *planes[1:])))
        s = (s - s.min()) / max(s.max() - s.min(), 1e-12)
    else:
        s = sum(residual_plane(p, k, sigma, r, False) * w for p, w in zip(planes, weights, strict=True)) / max(sum(weights), 1e-12)
    return s.clip(0, 1) ** post


def prior(shape, cx: float = 0.5, cy: float = 0.5, rx: float = 0.35, ry: float = 0.45) -> np.ndarray:
    """Gaussian bias towards a centre."""
    h, w = shape
    dx, dy = ((np.arange(w) + 0.5) / w - cx) / max(rx, 1e-6), ((np.arange(h) + 0.5) / h - cy) / max(ry, 1e-6)
    return np.exp(-(dx[None] ** 2 + dy[:, None] ** 2))


def on_border(shape, band: int) -> np.ndarray:
    out = np.ones(shape, bool)
    out[band : shape[0] - band, band : shape[1] - band] = False
    return out


def adaptive(shape, divisor: int, low: int, high: int, fixed: int = 0) -> int:
    """A blur radius: fixed if positive, else a share of the shorter side."""
    return fixed if fixed > 0 else min(high, max(low, min(shape) // divisor))


def lab_distance(a, b) -> np.ndarray:
    return np.sqrt(sum(((p - q) / s) ** 2 for p, q, s in zip(a, b, (100, 128, 128), strict=True)))


def border_likelihood(planes, band: int, radius: int = 0, centred: bool = False) -> np.ndarray:
    """Likeness to the nearest of at most PROTOTYPES border pixels, blurred; ``centred`` lowers it towards the centre."""
    h, w = planes[0].shape
    band = max(1, min(band, w, h))
    own = np.flatnonzero(on_border((h, w), band))
    own = own[:: max(1, len(own) // PROTOTYPES)][:PROTOTYPES]
    near = np.full((h, w), np.inf)
    for i in own:
        near = np.minimum(near, lab_distance(planes, [p.flat[i] for p in planes]))
    out = np.exp(-((near / 0.16) ** 2))
    if centred:
        dx, dy = (np.arange(w) + 0.5) / w - 0.5, (np.arange(h) + 0.5) / h - 0.5
        edge = 1 - (1 - np.sqrt(dx[None] ** 2 + dy[:, None] ** 2) / 0.70710678118).clip(0, 1)
        out = out * (0.58 + 0.42 * edge)
    return box(out.clip(0, 1), adaptive((h, w), 48, 4, 16, radius))


def weighted(parts) -> np.ndarray:
    """Weighted mean in 0..1; without weights 0."""
    total = sum(max(w, 0.0) for _, w in parts)
    return (sum(a * max(w, 0.0) for a, w in parts) / total).clip(0, 1) if total > 1e-12 else np.zeros_like(np.asarray(parts[0][0], float))


def soft_background(mask: np.ndarray, border: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    """Border likelihood blended with a mask: weights for an empty or full, a hard, and a soft mask."""
    hard = len(np.unique(np.floor(mask.clip(0, 1) * 255 + 0.5))) <= 2
    w = weights[0] if hard and not 0.02 < mask.mean() < 0.98 else weights[1] if hard else weights[2]
    return (mask * w + border * (1 - w)).clip(0, 1)


def flooded(seeds: np.ndarray, planes, threshold: float, enters: np.ndarray | None = None) -> np.ndarray:
    """Pixels reached from the seeds by steps of at most ``threshold`` in Lab, into pixels that ``enters`` allows."""
    gap = {"x": lab_distance([p[:, 1:] for p in planes], [p[:, :-1] for p in planes]) <= threshold, "y": lab_distance([p[1:] for p in planes], [p[:-1] for p in planes]) <= threshold}
    found, front = seeds.copy(), seeds.copy()
    while front.any():
        new = np.zeros_like(front)
        new[:, 1:] |= front[:, :-1] & gap["x"]
        new[:, :-1] |= front[:, 1:] & gap["x"]
        new[1:] |= front[:-1] & gap["y"]
        new[:-1] |= front[1:] & gap["y"]
        front = new & ~found if enters is None else new & ~found & enters
        found |= front
    return found


def components(right: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Labels of pixels linked to the right (h, w - 1) and below (h - 1, w), numbered as they first occur in raster order."""
    h, w = down.shape[0] + 1, right.shape[1] + 1
    grid = np.arange(h * w).reshape(h, w)
    a = np.concatenate([grid[:, :-1][right], grid[:-1][down]])
    b = np.concatenate([grid[:, 1:][right], grid[1:][down]])
    label = np.arange(h * w)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return np.unique(label, return_inverse=True)[1].reshape(h, w)
