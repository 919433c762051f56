"""Parameters of centre-line tracing, with their checks."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

#: What a call without parameters uses; fixed values.
DEFAULT_TEASAR_PARAMS = {
    "scale": 1.5,
    "const": 300,
    "pdrf_scale": 100000,
    "pdrf_exponent": 4,
    "soma_acceptance_threshold": 3500,
    "soma_detection_threshold": 750,
    "soma_invalidation_const": 300,
    "soma_invalidation_scale": 2,
}


@dataclass(frozen=True)
class TeasarParams:
    """The defaults here hold for keys that a given mapping leaves out."""

    scale: float = 10.0
    const: float = 10.0
    pdrf_scale: float = 5000.0
    pdrf_exponent: float = 16.0
    soma_detection_threshold: float = 1100.0
    soma_acceptance_threshold: float = 4000.0
    soma_invalidation_scale: float = 0.5
    soma_invalidation_const: float = 0.0
    max_paths: int | None = None

    @classmethod
    def of(cls, given: dict | TeasarParams | None) -> TeasarParams:
        if isinstance(given, cls):
            return given
        given = dict(DEFAULT_TEASAR_PARAMS if given is None else given)
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        params = replace(cls(), **given)
        e = params.pdrf_exponent
        if float(e).is_integer() and int(e) % 2:
            raise ValueError("pdrf_exponent must not be an odd integer")
        return params

    def as_dict(self) -> dict:
        return asdict(self)


def check_anisotropy(anisotropy) -> tuple[float, float, float]:
    values = tuple(float(x) for x in anisotropy)
    if len(values) != 3 or not all(math.isfinite(x) and x > 0 for x in values):
        raise ValueError("anisotropy must be three finite numbers above 0")
    return values
