"""Peaks and basins of weights over a dictionary of directions."""

from __future__ import annotations

import numpy as np

from voxelmill import schema as S


class Directions:
    """Unit directions with the ``neighbours`` nearest of each by dot product (equals: those of greater index)."""

    def __init__(self, directions: list, neighbours: int | None = None):
        self.u = np.array(directions)
        near = np.round(self.u @ self.u.T, 12)
        np.fill_diagonal(near, -np.inf)
        k = neighbours or max(2, min(6, len(self.u) // 5))
        rank = np.lexsort((-np.arange(len(self.u))[None, :].repeat(len(self.u), 0), -near), axis=1)
        self.near, self.across = rank[:, :k], np.round(np.abs(self.u @ self.u.T), 12)

    def basins(self, t: np.ndarray) -> np.ndarray:
        """Of rows of weights, the weight of each direction's basin (0 for one that is no peak).

        A peak has weight and no neighbour with more (an equal one of smaller index counts as more); each direction counts for the
        peak nearest to it, the first of equals.
        """
        other = t[:, self.near]
        beaten = (other > t[:, :, None]) | ((other == t[:, :, None]) & (self.near < np.arange(t.shape[1])[:, None])[None])
        peak = (t > 0) & ~(beaten & (other > 0)).any(2)
        home = np.where(peak[:, None, :], self.across[None], -1.0).argmax(2)
        mass = np.zeros_like(t)
        np.add.at(mass, (np.arange(len(t))[:, None], home), np.where(peak.any(1)[:, None], t, 0.0))
        return mass

    def dominant(self, mass: np.ndarray, gate: float, most: int, least: float = S.LEAST_WEIGHT, ratio: float = S.PEAK_RATIO, apart: float = S.SEPARATION_DEG) -> list[int]:
        """Directions of a voxel's fibers, the heaviest basin first: large ones, not near an accepted one, and none where the
        largest basin does not pass the gate."""
        top, total, out = mass.max(), mass.sum(), []
        if total < 1e-10 or top < gate * total:
            return out
        for d in np.argsort(-mass, kind="stable").tolist():
            if len(out) == most or mass[d] < least * total or mass[d] < ratio * top:
                break
            if all(self.across[d, e] <= np.cos(np.radians(apart)) for e in out):
                out.append(d)
        return out

    def dominant_of(self, mass: np.ndarray, gate: np.ndarray, most: int, least: float = S.LEAST_WEIGHT, ratio: float = S.PEAK_RATIO, apart: float = S.SEPARATION_DEG) -> tuple[np.ndarray, np.ndarray]:
        """``dominant`` of rows of basins, each with its gate: ``most`` directions a row, and where there are that many."""
        order, every = np.argsort(-mass, axis=1, kind="stable"), np.arange(len(mass))
        top, total = mass.max(1), mass.sum(1)
        going = every[(total >= 1e-10) & ~(top < gate * total)]
        out, count = np.zeros((len(mass), most), int), np.zeros(len(mass), int)
        for place in range(mass.shape[1]):
            d = order[going, place]
            m = mass[going, d]
            on = (count[going] < most) & ~(m < least * total[going]) & ~(m < ratio * top[going])
            going, d = going[on], d[on]
            if not len(going):
                break
            taken = np.arange(most) < count[going][:, None]
            fine = ((self.across[d[:, None], out[going]] <= np.cos(np.radians(apart))) | ~taken).all(1)
            out[going[fine], count[going[fine]]] = d[fine]
            count[going[fine]] += 1
        return out, np.arange(most) < count[:, None]
