"""Constants, the acquisition protocol, and names of result columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed values that results depend on (mm^2/s unless noted).
FIBER_THRESHOLD = 0.15
RES_MAX, WAT_MIN = 0.3e-3, 3.0e-3
D_RES, D_HIN, D_WAT, D_NONRES = 0.15e-3, 1.0e-3, 3.0e-3, 1.5e-3
D_WAT_MEAN, ISO_MAX = 3.05e-3, 3.5e-3
B0_NORMALISE, B0_NOISE = 100.0, 50.0
AD_MIN, AD_MAX, RD_MIN, RD_MAX = 0.05e-3, 3.5e-3, 0.15e-3, 3.0e-3
PEAK_RATIO, CONCENTRATION_GATE, LEAST_WEIGHT, SEPARATION_DEG = 0.35, 0.35, 0.05, 35.0


@dataclass(frozen=True)
class Protocol:
    """b-values and unit gradient directions of the measurements, in order."""

    b: tuple[float, ...]
    g: tuple[tuple[float, float, float], ...]

    def __post_init__(self) -> None:
        if len(self.b) != len(self.g):
            raise ValueError("as many b-values as gradient directions are needed")

    @property
    def shells(self) -> dict[float, int]:
        """Measurements of each b-value over 50 after rounding to hundreds (half to even)."""
        out: dict[float, int] = {}
        for b in self.b:
            s = round(b / 100) * 100.0
            if s > B0_NOISE:
                out[s] = out.get(s, 0) + 1
        return out

    @property
    def isotropic_parts(self) -> int:
        """3 isotropic compartments if b reaches 2000 on 2 or more shells, else 2."""
        return 3 if max(self.b) >= 2000 and len(self.shells) >= 2 else 2

    @property
    def directions(self) -> int:
        """Dictionary directions: 1.3 times the largest shell, 30 without a shell."""
        return int(1.3 * max(self.shells.values())) if self.shells else 30


def hemisphere(n: int) -> list[tuple[float, float, float]]:
    """n directions on the upper half sphere along a Fibonacci spiral."""
    phi = (1 + math.sqrt(5)) / 2
    out = []
    for i in range(n):
        z = 1 - (i + 0.5) / n
        r, a = math.sqrt(1 - z * z), 2 * math.pi * i / phi
        out.append((r * math.cos(a), r * math.sin(a), z))
    return out


def pairs(ad: tuple[float, float, int] = (0.5e-3, 2.2e-3, 3), rd: tuple[float, float, int] = (0.05e-3, 1.2e-3, 3), ratio: float = 2.0) -> list[tuple[float, float]]:
    """Admissible (axial, radial) diffusivities: axial at least ``ratio`` times radial, axial outermost."""
    grid = [[lo + (hi - lo) * i / (n - 1) if n > 1 else lo for i in range(n)] for lo, hi, n in (ad, rd)]
    out = [(a, r) for a in grid[0] for r in grid[1] if a >= r * ratio]
    if not out:
        raise ValueError("no pair is admissible")
    return out


def iso_grid(n: int = 10, lo: float = 0.1e-3, hi: float = 5.0e-3) -> list[float]:
    """Log-uniform diffusivities with the compartment limits as anchors and no gap over a factor of 2."""
    points = [lo * (hi / lo) ** (i / (n - 1)) for i in range(n)] if n > 1 else [lo]
    for a in (RES_MAX - 1e-6, WAT_MIN + 1e-6):
        if lo < a < hi and all(abs(a - p) > 1e-6 for p in points):
            points.append(a)
    points = sorted(set(points))
    out = [points[0]]
    for a, b in zip(points, points[1:]):
        parts = 1 << max(0, math.ceil(math.log2(math.log2(b / a)) - 1e-12)) if b / a > 2 else 1
        out += [a * (b / a) ** (i / parts) for i in range(1, parts + 1)]
    return out


def linear_grid(n: int, lo: float = 0.0, hi: float = 3.0e-3) -> list[float]:
    """n diffusivities at equal distances."""
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]


def spacing(directions: list[tuple[float, float, float]]) -> float:
    """Mean angle between each direction and the one nearest to it."""
    nearest = (max(sum(a * b for a, b in zip(u, v)) for j, v in enumerate(directions) if j != i) for i, u in enumerate(directions))
    return sum(math.acos(max(-1.0, min(1.0, x))) for x in nearest) / len(directions)


def cone_schedule(grid: float, target: float) -> list[tuple[float, int]]:
    """Half angle and number of directions of the cones that lead from a grid's spacing to a target angle, by equal ratios;
    none where the grid is as fine as the target."""
    if target >= grid:
        return []
    middle = math.sqrt(grid * target)
    return [(grid, max(4, math.ceil((grid / middle) ** 2 - 1e-9))), (middle, max(4, math.ceil((middle / target) ** 2 - 1e-9)))]


CHANNELS = (
    "fiber_fraction restricted_fraction hindered_fraction water_fraction nonrestricted_fraction axial_diffusivity radial_diffusivity fiber_fa "
    "mean_iso_adc ad_linear rd_linear n_fiber_populations dir1_x dir1_y dir1_z fiber_fraction_pop2 axial_diffusivity_pop2 radial_diffusivity_pop2 "
    "fiber_fa_pop2 dir2_x dir2_y dir2_z fiber_fraction_pop3 axial_diffusivity_pop3 radial_diffusivity_pop3 fiber_fa_pop3 dir3_x dir3_y dir3_z "
    "dominant_basin_concentration"
).split()


def channels(compartments: int = 3) -> list[str]:
    """Names of the result channels; two isotropic compartments have no hindered and water fractions."""
    return [c for c in CHANNELS if compartments == 3 or c not in ("hindered_fraction", "water_fraction")]
