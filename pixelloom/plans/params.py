"""Parameters from YAML: missing fields keep their defaults, unknown ones are an error. Groups are dataclasses in dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from pixelloom.operators.fusion import FEATURES, DynamicParams, ScoreParams
from pixelloom.operators.partition import PartitionParams
from pixelloom.operators.planes import CentreParams
from pixelloom.operators.regions import SegmentParams
from pixelloom.operators.segments import AmbientParams, RegionParams

try:
    import yaml
except ImportError:  # optional
    yaml = None


# Every number of the groups below.
@dataclass(frozen=True)
class FilterParams:
    """What is kept of a fused map: by threshold or by quantile, then stretched."""

    method: str = "threshold"
    threshold: float = 0.10
    quantile: float = 0.0
    normalise: bool = True
    gamma: float = 1.2
    least: float = 0.0


@dataclass(frozen=True)
class PercentileParams:
    low: float = 1.0
    high: float = 99.0


@dataclass(frozen=True)
class ResidualParams:
    light: CentreParams = CentreParams("gamma", 0.0, 95.0, 0.7, 0.3)
    lab_a: CentreParams = CentreParams()
    lab_b: CentreParams = CentreParams()
    sat: CentreParams = CentreParams()


@dataclass(frozen=True)
class SaturationParams:
    local_post_gamma: float = 1.0


@dataclass(frozen=True)
class MorphologyParams:
    open_radius: int = 2
    close_radius: int = 8
    erode_radius: int = 2


@dataclass(frozen=True)
class BarrierParams:
    enabled: bool = True
    grad_stop: float = 0.51
    dct_stop: float = 0.45
    local_light_stop: float = 0.40
    spectral_stop: float = 0.50
    color_threshold: float = 0.35
    barrier_color_relax_threshold: float = 0.92
    protect_strength: float = 0.75
    protect_p_low: float = 70.0
    protect_p_high: float = 99.0
    protect_grad_weight: float = 0.30
    protect_dct_weight: float = 0.25
    protect_spectral_weight: float = 0.15
    protect_local_light_weight: float = 0.15
    protect_local_sat_weight: float = 0.15


@dataclass(frozen=True)
class FusionMaskParams:
    border_bg_blur_radius: int = 1
    fg_confidence_blur_radius: int = 1
    fg_confidence_sharpen_amount: float = 0.40
    fg_confidence_sharpen_radius: int = 1


@dataclass(frozen=True)
class BackgroundParams:
    partition: PartitionParams = PartitionParams(True, 8, 8, 0.11, 0.01, 12, 0.55, 0.10, 0.88, 2, 8, 2)
    morphology: MorphologyParams = MorphologyParams()
    flood_barrier: BarrierParams = BarrierParams()
    soft_mask: FusionMaskParams = FusionMaskParams()


@dataclass(frozen=True)
class PriorParams:
    center_x: float = 0.5
    center_y: float = 0.55
    radius_x: float = 0.0
    radius_y: float = 0.0


@dataclass(frozen=True)
class RegionMixParams:
    enabled: bool = True
    pixel_stat_weight: float = 0.65
    region_score_weight: float = 0.35
    separation_weight: float = 0.45
    saliency_corr_weight: float = 0.35
    bg_suppression_weight: float = 0.20


@dataclass(frozen=True)
class SegmentFusionParams:
    enabled: bool = True
    segment: SegmentParams = SegmentParams(512, 70, 0.002, 0.0005, 0.25, 0.6, 0.12, 8.0, 20.0, True, 0, 1, 0.8, 2.5)
    region_scoring: RegionParams = RegionParams()
    dynamic_weights: RegionMixParams = RegionMixParams()


@dataclass(frozen=True)
class BlendParams:
    alpha: float = 0.10
    gamma: float = 2.5
    epsilon: float = 0.10


@dataclass(frozen=True)
class DirectParams:
    normalize_before: bool = True


@dataclass(frozen=True)
class DctParams:
    high_freq_threshold: int = 3


@dataclass(frozen=True)
class SpectralParams:
    mean_filter_kernel: int = 10
    gaussian_sigma: float = 1.0
    gamma: float = 0.81
    post_gamma: float = 0.9


@dataclass(frozen=True)
class ImpressionParams:
    k: int = 8
    max_iter: int = 10
    sample_stride: int = 2
    seed: int = 42
    cluster_scoring: ScoreParams = ScoreParams(area_power=0.65, mean_weight=0.75, skin_strength=0.6)


def _weights(*values: float) -> dict[str, float]:
    return dict(zip(FEATURES, values, strict=True))


@dataclass(frozen=True)
class FusionParams:
    """All groups of feature fusion."""

    max_dim: int = 512
    gauss_sigma: float = 12.0
    percentile: PercentileParams = PercentileParams()
    global_residual: ResidualParams = ResidualParams()
    saturation: SaturationParams = SaturationParams()
    background: BackgroundParams = BackgroundParams()
    subject_prior: PriorParams = PriorParams()
    segment_fusion: SegmentFusionParams = SegmentFusionParams()
    weights_add: dict = field(default_factory=lambda: _weights(0.1, 0.02, 0.15, 0, 0.09, 0.08, 0.01, 0, 0.03, 0.02, 0.01, 0, 0, 0, 0, 0.035, 0.03, 0.10, 0.50))
    weights_mul: dict = field(default_factory=lambda: _weights(0.01, 0, 0.12, 0.03, 0.13, 0.13, 0, 0.07, 0.015, 0.01, 0, 0, 0.17, 0, 0, 0.06, 0.02, 0.10, 0.70))
    fusion: BlendParams = BlendParams()
    direct_blend: DirectParams = DirectParams()
    impression_background: AmbientParams = AmbientParams()
    filter: FilterParams = FilterParams()
    dct: DctParams = DctParams()
    spectral_residual: SpectralParams = SpectralParams()
    impression: ImpressionParams = ImpressionParams()
    dynamic_weights: DynamicParams = DynamicParams(True, 0.35, 1.85, 0.05, 0.65, 4.0, 1e-6, 0.55, 0.25, 0.20)
    #: Features whose weights stay as they are.
    static_features: tuple = ("background_mask_morph", "background_fg_confidence", "subject_prior", "segment_foreground")


@dataclass(frozen=True)
class ImpressionSpectralParams:
    mean_filter_kernel: int = 3
    gaussian_sigma: float = 3.0
    l_weight: float = 1.0
    a_weight: float = 1.0
    b_weight: float = 1.0
    post_gamma: float = 1.0


@dataclass(frozen=True)
class SoftMaskParams:
    saliency_dct: float = 0.12
    saliency_lab_grad: float = 0.20
    saliency_spectral: float = 0.38
    saliency_local_light: float = 0.10
    saliency_local_sat: float = 0.20
    saliency_base_weight: float = 0.15
    saliency_smooth_weight: float = 0.45
    saliency_subject_weight: float = 0.40
    foreground_color_weight: float = 0.50
    foreground_saliency_weight: float = 0.40
    foreground_subject_weight: float = 0.10
    subject_center_x: float = 0.50
    subject_center_y: float = 0.55
    subject_radius_x: float = 0.30
    subject_radius_y: float = 0.48


@dataclass(frozen=True)
class FeatureWeights:
    dct: float = 0.15
    lab_grad: float = 0.20
    spectral: float = 0.10
    local_light: float = 0.06
    local_sat: float = 0.06
    bg_mask: float = 0.25
    fg_confidence: float = 0.30


@dataclass(frozen=True)
class PaletteParams:
    algorithm: str = "kmeanspp"
    n_colors: int = 1
    min_fg_ratio: float = 0.05


@dataclass(frozen=True)
class ImpressionProgramParams:
    """All groups of impression colour."""

    max_dim: int = 720
    gauss_sigma: float = 50.0
    percentile: PercentileParams = PercentileParams()
    spectral_residual: ImpressionSpectralParams = ImpressionSpectralParams()
    color_partition: PartitionParams = PartitionParams()
    soft_mask: SoftMaskParams = SoftMaskParams()
    feature_weights: FeatureWeights = FeatureWeights()
    palette: PaletteParams = PaletteParams()


def from_dict(kind: type, values: dict[str, Any] | None):
    """A parameter dataclass of a dictionary, groups included."""
    if not is_dataclass(kind):
        raise TypeError(f"{kind} isn't a parameter class")
    names = {f.name for f in fields(kind)}
    unknown = set(values or {}) - names
    if unknown:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    hints, out = get_type_hints(kind), {}
    for name, v in (values or {}).items():
        group = hints[name]
        if is_dataclass(group) and isinstance(v, dict):
            # a group's own defaults, not its class's
            default = getattr(kind(), name)
            from_dict(group, v)
            out[name] = type(default)(**{**{f.name: getattr(default, f.name) for f in fields(default)}, **_nested(default, v)})
        else:
            out[name] = tuple(v) if isinstance(v, list) else v
    return kind(**out)


def _nested(default, values: dict[str, Any]) -> dict[str, Any]:
    out = {}
    for name, v in values.items():
        old = getattr(default, name)
        out[name] = type(old)(**{**{f.name: getattr(old, f.name) for f in fields(old)}, **_nested(old, v)}) if is_dataclass(old) and isinstance(v, dict) else v
    return out


def from_yaml(kind: type, text: str):
    if yaml is None:
        raise RuntimeError("PyYAML isn't installed")
    return from_dict(kind, yaml.safe_load(text))


def validated(p: FilterParams) -> FilterParams:
    """The same, or a ValueError."""
    if p.method not in ("threshold", "quantile"):
        raise ValueError(f"unknown method {p.method!r}")
    if p.method == "threshold" and p.quantile or p.method == "quantile" and not 0 < p.quantile <= 1:
        raise ValueError("either a threshold or a quantile in (0, 1]")
    if not 0 <= p.threshold <= 1 or not 0 <= p.least <= 1 or p.gamma <= 0:
        raise ValueError("a parameter is out of range")
    return p
