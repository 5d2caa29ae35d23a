"""Parameters with their defaults and checks, and the planners that turn an effort level into a pass schedule."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from math import isfinite


def _two(value, name: str) -> tuple[int, int]:
    out = (int(value), int(value)) if isinstance(value, int) else tuple(int(v) for v in value)
    if len(out) != 2:
        raise ValueError(f"{name} has two numbers")
    return out


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class PhysicalScale:
    """Length of a pixel and time between frames, with the units' names."""

    pixel_size: float
    dt: float
    length_unit: str = "m"
    time_unit: str = "s"

    def __post_init__(self) -> None:
        _need(all(isfinite(v) and v > 0 for v in (self.pixel_size, self.dt)), "pixel_size and dt are finite and positive")

    @property
    def velocity_unit(self) -> str:
        return f"{self.length_unit}/{self.time_unit}"


@dataclass(frozen=True)
class ROI:
    """Rows r0..r1 and columns c0..c1, 1-based and inclusive."""

    r0: int
    r1: int
    c0: int
    c1: int

    def __post_init__(self) -> None:
        _need(1 <= self.r0 <= self.r1 and 1 <= self.c0 <= self.c1, "a region isn't empty and starts at 1 or later")


#: Validators by name with the fields that they take.
VALIDATORS = {"peak_ratio": ("threshold",), "correlation_moment": ("threshold",), "velocity_magnitude": ("min", "max"), "uod": ("threshold", "neighborhood_size", "epsilon")}


@dataclass(frozen=True)
class Validator:
    kind: str
    threshold: float = 2.0
    min: float = 0.0
    max: float = float("inf")
    neighborhood_size: int = 2
    epsilon: float = 0.1

    def __post_init__(self) -> None:
        _need(self.kind in VALIDATORS, f"a validator is one of {', '.join(VALIDATORS)}")
        _need(self.threshold >= 0 and self.epsilon >= 0 and self.neighborhood_size >= 1 and 0 <= self.min <= self.max, f"{self.kind}: a limit is out of range")


def parse_validator(spec) -> Validator:
    """From a Validator, ("peak_ratio", 1.3), or ("velocity_magnitude", {"min": 0, "max": 5}); functions stay as they are."""
    if isinstance(spec, Validator) or callable(spec):
        return spec
    name, value = spec
    name = "uod" if name == "universal_outlier" else name
    _need(name in VALIDATORS, f"unknown validator {name!r}")
    if isinstance(value, dict):
        _need(set(value) <= set(VALIDATORS[name]), f"{name} takes {', '.join(VALIDATORS[name])}")
        return Validator(name, **value)
    _need("threshold" in VALIDATORS[name], f"{name} takes named limits")
    return Validator(name, threshold=float(value))


@dataclass(frozen=True)
class PIVParameters:
    """One pass of window correlation."""

    window_size: tuple[int, int] = (32, 32)
    search_area_size: tuple[int, int] | None = None
    overlap: tuple[int, int] | None = None
    correlation_method: str = "cross"
    padding: bool = False
    apodization: str = "none"
    subpixel_method: str = "gauss3"
    n_peaks: int = 3
    peak_finder: str = "regionalmax"
    uncertainty: bool = False
    uod_enable: bool = True
    uod_threshold: float = 2.0
    uod_neighborhood: int = 2
    min_peak_ratio: float = 1.0
    validation: tuple = ()
    replace_outliers: bool = True
    max_iterations: int = 1
    convergence_tol: float = 0.05
    keep_correlation_planes: bool = False

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("window_size", _two(self.window_size, "window_size"))
        put("search_area_size", self.window_size if self.search_area_size is None else _two(self.search_area_size, "search_area_size"))
        put("overlap", (16, 16) if self.overlap is None else _two(self.overlap, "overlap"))
        put("validation", tuple(parse_validator(v) for v in self.validation))
        _need(min(self.window_size) >= 4, "a window has 4 pixels or more a side")
        _need(all(s >= w and (s - w) % 2 == 0 for s, w in zip(self.search_area_size, self.window_size, strict=True)), "a search area is the window or larger by an even number")
        _need(all(0 <= o < w for o, w in zip(self.overlap, self.window_size, strict=True)), "an overlap is below the window's size")
        if not callable(self.correlation_method) and self.correlation_method not in ("cross", "phase"):
            from .kernels.correlation import CORRELATORS

            _need(self.correlation_method in CORRELATORS, "correlation_method is 'cross', 'phase', a registered correlator or a function")
            put("correlation_method", CORRELATORS[self.correlation_method])
        for name, among in (("apodization", ("none", "gauss")), ("subpixel_method", ("gauss3", "gauss9", "gauss2d", "none")), ("peak_finder", ("regionalmax", "exclusion"))):
            _need(getattr(self, name) in among, f"{name} is one of {', '.join(among)}")
        _need(self.n_peaks >= 1 and self.uod_threshold > 0 and self.uod_neighborhood >= 1 and self.min_peak_ratio >= 0 and self.max_iterations >= 1 and self.convergence_tol >= 0, "a limit is out of range")

    @property
    def step(self) -> tuple[int, int]:
        return tuple(w - o for w, o in zip(self.window_size, self.overlap, strict=True))


@dataclass(frozen=True)
class PTVParameters:
    """Particle detection and matching."""

    threshold: float | None = None
    threshold_k: float = 4.0
    min_separation: float = 2.0
    min_diameter: float = 1.0
    max_diameter: float = 12.0
    search_radius: float = 3.0
    intensity_weight: float = 0.0
    diameter_weight: float = 0.0
    uod_enable: bool = True
    uod_threshold: float = 2.0
    uod_neighbors: int = 8
    uod_epsilon: float = 0.1

    def __post_init__(self) -> None:
        _need(self.threshold_k > 0 and self.min_separation > 0 and 0 < self.min_diameter < self.max_diameter, "a detection limit is out of range")
        _need(self.search_radius > 0 and self.intensity_weight >= 0 and self.diameter_weight >= 0, "a matching limit is out of range")
        _need(self.uod_threshold > 0 and self.uod_neighbors >= 3 and self.uod_epsilon > 0, "an outlier limit is out of range")


def multipass_parameters(window_sizes, overlap_fraction: float = 0.5, final: dict | None = None, **every) -> list[PIVParameters]:
    """A pass for each window size; ``final`` holds for the last one only."""
    _need(0 <= overlap_fraction < 1 and len(window_sizes) > 0, "there is a pass, and an overlap fraction from 0 to below 1")
    out = []
    for i, size in enumerate(window_sizes):
        window = _two(size, "window_size")
        own = every | (final or {} if i == len(window_sizes) - 1 else {})
        overlap = own.pop("overlap", None) or tuple(int(round(w * overlap_fraction)) for w in window)
        out.append(PIVParameters(window_size=window, overlap=overlap, **own))
    return out


#: Window sizes of the effort levels.
EFFORTS = {"low": (32,), "medium": (64, 32), "high": (128, 64, 32)}
#: Options that only the last pass takes.
FINAL_ONLY = ("uncertainty", "max_iterations", "keep_correlation_planes")


def effort_schedule(level: str = "medium", ensemble: bool = False, image_size: tuple[int, int] | None = None, window_size: int | None = None, final: dict | None = None, **every) -> list[PIVParameters]:
    """The passes of an effort level, rescaled to end at ``window_size`` and clamped to the image."""
    _need(level in EFFORTS, f"an effort is one of {', '.join(EFFORTS)}")
    sizes = list(EFFORTS[level]) + [32] * (ensemble and level == "high")
    if window_size is not None:
        sizes = [max(4, round(s * window_size / 32)) for s in sizes]
    if image_size is not None:
        sizes = [min(s, *image_size) for s in sizes]
    last = {k: every.pop(k) for k in FINAL_ONLY if k in every} | (final or {})
    if level == "high":
        every = {"padding": True, "apodization": "gauss"} | every
        last = {"max_iterations": 2, "uncertainty": True} | last
    if (area := every.pop("search_area_size", None)) is not None:  # never below a pass's window
        area = _two(area, "search_area_size")
        passes = []
        for i, s in enumerate(sizes):
            fit = tuple(max(a + (a - s) % 2, s) for a in area)
            if image_size is not None:
                fit = tuple(max(s, min(f, n - (n - s) % 2)) for f, n in zip(fit, image_size, strict=True))
            passes += multipass_parameters([s], final=last if i == len(sizes) - 1 else None, search_area_size=fit, **every)
        return passes
    return multipass_parameters(sizes, final=last, **every)


def to_json(params) -> str:
    import json

    return json.dumps({f.name: getattr(params, f.name) for f in fields(params)}, default=lambda v: v.__dict__)


__all__ = ["PIVParameters", "PTVParameters", "PhysicalScale", "ROI", "Validator", "effort_schedule", "multipass_parameters", "parse_validator", "replace", "field", "to_json"]
