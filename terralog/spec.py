"""Statistic specifications: every default is written here, never inside an algorithm."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

# Bounds and refusal names.
MAX_BAND_M = 500_000.0
PERMUTATIONS = (9, 999)
MIN_UNITS = 8
TOO_FEW, CONSTANT, NO_NEIGHBOURS, LOW_COVERAGE = (
    "too-few-valid-units", "constant-field", "no-weight-neighbors", "time-coverage-insufficient")


@dataclass(frozen=True)
class StatSpec:
    field: str = "value"
    unit: str = "unit_id"
    band_m: float = 3000.0
    standardization: str = "row"
    permutations: int = 199
    seed: int = 20260924
    correction: str = "fdr-bh"
    alpha: float = 0.05

    def issues(self) -> list[str]:
        """All problems at once; empty when the spec is usable."""
        out = []
        if not 0 < self.band_m <= MAX_BAND_M:
            out.append("band-bound")
        if self.standardization not in ("row", "binary"):
            out.append("standardization")
        if not PERMUTATIONS[0] <= self.permutations <= PERMUTATIONS[1]:
            out.append("permutations-bound")
        if self.correction not in ("fdr-bh", "bonferroni", "none"):
            out.append("correction")
        if not 0 < self.alpha < 1:
            out.append("alpha-bound")
        return out

    def checked(self) -> StatSpec:
        if found := self.issues():
            raise ValueError(", ".join(found))
        return self

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()
