"""Non-negative and bounded fits of voxel signals, a few hundred rows at a time.

Voxels are independent, so each fit is one ``mapInArrow`` over the rows as they are partitioned, without a
shuffle; the dictionary (protocol by atoms, a few hundred columns) goes with the task.  Rows keep their
columns and get those that the fit adds; rows with a null signal must be filtered before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxelmill import schema as S
from voxelmill.operators.directions import Directions
from voxelmill.schema import Protocol

#: Rows that are solved at once, and bytes that their own matrices may take.
ROWS, MATRIX_BYTES = 256, 32 << 20
#: The same where a row's matrices are small.
MANY = 2048
#: Rounds of exchanges before a row goes on one variable at a time, and rows of free sets of like size that are solved at once.
PIVOTS, ALIKE = 15, 16
#: Rounds of the approximation from which free sets are guessed, and its step beyond each round's minimiser.
GUESSES, STRIDE = 90, 1.8
#: Median penalty under which rows hardly settle by such exchanges and so begin one variable at a time.
SMALL = 4e-4
#: Concentration under which the fiber penalty grows, where it is greatest, and by what factor.
SPREAD_LOW, SPREAD_HIGH, SPREAD_GAIN = 0.24, 0.36, 8.0
#: Grid of the single-fiber fit: axial and radial (low, high, steps), least ratio.
FINE_AD, FINE_RD, FINE_RATIO = (0.6e-3, 2.6e-3, 14), (0.15e-3, 1.1e-3, 12), 1.1


def nnls(gram: np.ndarray, rhs: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Minimisers of x'Gx/2 - h'x over x >= 0, for rows of h and one G or one for each row.

    An active-set method for all rows together: the variable of steepest descent is freed, the free ones
    are solved for, and those that would turn negative are stopped at zero first.  Free sets are small, so
    only their part of G is solved.  On the way a part in 1e10 is added to the diagonal for columns that all but coincide; the
    last free sets are solved again without it.  Rows begin at zero or at ``start`` (>= 0).  Rows that don't settle raise an error.
    """
    rows, n = rhs.shape
    shared = gram.ndim == 2
    jitter = 1e-10 * np.trace(gram, axis1=-2, axis2=-1) / n
    jitter = np.full(rows, jitter) if shared else jitter
    x, free, barred = np.zeros((rows, n)), np.zeros((rows, n), bool), np.zeros((rows, n), bool)
    limit = 1e-10 * np.maximum(1.0, np.abs(rhs).max(1, initial=0.0))
    going = np.arange(rows)

    def solved(at: np.ndarray, extra: np.ndarray = jitter) -> np.ndarray:
        """Of these rows, the minimiser over their free variables."""
        most = int(free[at].sum(1).max(initial=0))
        if not most:
            return np.zeros((len(at), n))
        idx = np.argsort(~free[at], axis=1, kind="stable")[:, :most]
        own = np.take_along_axis(free[at], idx, 1)
        part = gram[idx[:, :, None], idx[:, None, :]] if shared else gram[at[:, None, None], idx[:, :, None], idx[:, None, :]]
        part = np.where(own[:, :, None] & own[:, None, :], part, 0.0)
        part[:, np.arange(most), np.arange(most)] += np.where(own, extra[at][:, None], 1.0)
        value = np.linalg.solve(part, np.where(own, np.take_along_axis(rhs[at], idx, 1), 0.0)[:, :, None])[:, :, 0]
        out = np.zeros((len(at), n))
        np.put_along_axis(out, idx, np.where(own, value, 0.0), 1)
        return out

    def slopes(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (x @ gram if shared else (gram[at] @ x[:, :, None])[:, :, 0]) - rhs[at]

    def settle(at: np.ndarray, z: np.ndarray) -> None:
        """Goes from x to the minimisers z over the free variables of these rows, and on while some would turn negative."""
        while len(at):
            negative = free[at] & (z <= 0)
            fine = ~negative.any(1)
            x[at[fine]] = z[fine]
            at, z, negative = at[~fine], z[~fine], negative[~fine]
            if not len(at):
                break
            old = x[at]
            ratio = np.where(negative, old / np.where(negative, np.maximum(old - z, 1e-300), 1.0), np.inf)
            step = ratio.min(1)
            new = old + step[:, None] * (z - old)
            stop = negative & (ratio <= step[:, None])
            free[at] &= ~stop
            x[at] = np.where(free[at], np.maximum(new, 0.0), 0.0)
            z = solved(at)

    if start is not None:
        x[:], free[:] = start, start > 0
        settle(going, solved(going))
    for _ in range(10 * n + 10):  # rounding alone could make it go round for ever
        slope = slopes(going, x[going])
        slope[free[going] | barred[going]] = np.inf
        pick = slope.argmin(1)
        more = slope[np.arange(len(going)), pick] < -limit[going]
        going, pick = going[more], pick[more]
        if not len(going):
            break
        free[going, pick] = True
        z = solved(going)
        idle = z[np.arange(len(going)), pick] <= 0  # descent too small for the arithmetic
        free[going[idle], pick[idle]] = False
        barred[going[idle], pick[idle]] = True
        at, z = going[~idle], z[~idle]
        barred[at] = False
        settle(at, z)
    if len(going):
        off = np.abs(np.minimum(x[going], slopes(going, x[going]))).max(1) > 1e4 * limit[going]
        if off.any():
            raise ArithmeticError(f"{int(off.sum())} of {rows} non-negative fits did not settle")
    every = np.arange(rows)
    try:
        z = solved(every, np.zeros(rows))
    except np.linalg.LinAlgError:  # columns that coincide
        return x
    error = lambda y: np.abs(np.where(free, slopes(every, y), 0.0)).max(1, initial=0.0)
    better = np.isfinite(z).all(1) & (z >= 0).all(1) & (error(np.nan_to_num(z)) <= error(x))
    x[better] = z[better]
    return x


def ridge_nnls(plain: np.ndarray, penalty: np.ndarray, rhs: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """``nnls`` of the matrix ``plain`` plus penalties on its diagonal, one row of them for all or one for each row of ``rhs``.

    Where all penalties are over zero there is one minimiser, and many variables change sides at once: those of the free ones that come out
    negative, and those at zero with descent (block principal pivoting; one alone where their number does not fall).  Rows begin with
    guessed free variables, or with ``start``.  Those that take over ``PIVOTS`` rounds go on by ``nnls`` from there.
    """
    rows, n = rhs.shape
    own = penalty.ndim == 2
    if not rows:
        return np.zeros((0, n))
    x, late = np.zeros((rows, n)), np.arange(rows)
    if penalty.min() > 0 and np.median(penalty) >= SMALL:
        try:
            x, late = _pivoted(plain, penalty, rhs, start)
        except np.linalg.LinAlgError:  # penalties too small for the arithmetic
            x, late = np.zeros((rows, n)), np.arange(rows)
    if not own and len(late):
        x[late] = nnls(plain + np.diag(penalty), rhs[late], x[late])
    elif len(late):
        block = max(1, MATRIX_BYTES // plain.nbytes)
        for i in range(0, len(late), block):
            at = late[i : i + block]
            x[at] = nnls(plain + penalty[at][:, :, None] * np.eye(n), rhs[at], x[at])
    return x


def _guessed(plain: np.ndarray, penalty: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Free variables of each row, nearly: those of some rounds of alternating directions (a ridge fit around the last non-negative point, with one
    inverse for all rows), in single precision.  What is guessed wrong costs a round more, and changes no result."""
    low = penalty.min(0) if penalty.ndim == 2 else penalty
    pull = np.sqrt(low * np.trace(plain) / len(plain))
    inverse = np.linalg.inv(plain + np.diag(low + pull))
    keep = (pull / (pull + penalty - low)).astype(np.float32)
    base, turn = (rhs @ inverse).astype(np.float32), (pull[:, None] * inverse).astype(np.float32)
    z = np.maximum(base, 0)
    u = np.zeros_like(z)
    for _ in range(GUESSES):
        v = (z - u) @ turn
        v += base
        v *= STRIDE
        v += (1 - STRIDE) * z
        v += u
        z = np.maximum(v, 0)
        z *= keep
        u = v - z
    return z > 0


def _pivoted(plain: np.ndarray, penalty: np.ndarray, rhs: np.ndarray, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers, and the rows that have not settled, with the positive part of their last free solution."""
    rows, n = rhs.shape
    own = penalty.ndim == 2
    limit = 1e-10 * np.maximum(1.0, np.abs(rhs).max(1, initial=0.0))
    free = _guessed(plain, penalty, rhs) if start is None else start.copy()
    # What is beyond a row's free variables is column n: it meets no other, has penalty 1 and gets weight 0.
    wide = np.zeros((n + 1, n + 1))
    wide[:n, :n] = plain
    flat, ridge = wide.ravel(), np.concatenate([penalty, np.ones((rows, 1) if own else 1)], axis=-1)
    x, going = np.zeros((rows, n)), np.arange(rows)
    least, spare = np.full(rows, n + 1), np.full(rows, 3)
    for _ in range(PIVOTS):
        size = free[going].sum(1)
        order = np.argsort(size, kind="stable")
        row, column = np.nonzero(free[going[order]])
        idx = np.full((len(going), int(size.max())), n)
        idx[row, np.arange(len(row)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])] = column
        h = np.concatenate([rhs[going[order]], np.zeros((len(going), 1))], axis=1)
        z = np.zeros((len(going), n + 1))
        for i in range(0, len(order), ALIKE):  # free sets of like size are solved together
            at = order[i : i + ALIKE]
            most = int(size[at[-1]])
            if not most:
                continue
            part = idx[i : i + ALIKE, :most]
            gram = flat.take(part[:, :, None] * (n + 1) + part[:, None, :])
            diagonal = gram.reshape(len(at), -1)[:, :: most + 1]
            diagonal += np.take_along_axis(ridge[going[at]], part, 1) if own else ridge[part]
            value = np.linalg.solve(gram, np.take_along_axis(h[i : i + ALIKE], part, 1)[:, :, None])[:, :, 0]
            full = np.zeros((len(at), n + 1))
            np.put_along_axis(full, part, value, 1)
            z[at] = full
        z = z[:, :n]
        slope = z @ plain + z * (penalty[going] if own else penalty) - rhs[going]
        wrong = np.where(free[going], z <= 0, slope < -limit[going][:, None])
        count = wrong.sum(1)
        x[going] = np.maximum(z, 0.0)
        more = count > 0
        going, wrong, count = going[more], wrong[more], count[more]
        if not len(going):
            break
        spare[going] = np.where(count < least[going], 3, spare[going] - 1)
        least[going] = np.minimum(least[going], count)
        alone = np.flatnonzero(spare[going] < 0)
        last = n - 1 - wrong[alone, ::-1].argmax(1)
        wrong[alone] = False
        wrong[alone, last] = True
        free[going] ^= wrong
    return x, going


def fit_rows(rows: DataFrame, solve: Callable[[pa.RecordBatch], list[pa.Array]], added: list[tuple[str, T.DataType]], at_once: int = ROWS) -> DataFrame:
    """``rows`` with the columns that ``solve`` makes of each chunk."""
    names = [*rows.columns, *[n for n, _ in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                yield pa.RecordBatch.from_arrays([*part.columns, *solve(part)], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in added]]))


def matrix_of(part: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array column as a matrix.  Rows with another number of values or with a null among them end the job with their id."""
    column = part.column(name)
    values = column.flatten()
    short = pc.not_equal(pc.fill_null(pc.list_value_length(column), -1), width).to_numpy(zero_copy_only=False)
    if short.any() or values.null_count:
        bad = int(np.flatnonzero(short)[0]) if short.any() else int(np.flatnonzero(values.is_null())[0] // width)
        own = part.column("voxel_id")[bad].as_py() if "voxel_id" in part.schema.names else bad
        raise ValueError(f"{name} of voxel {own} must have {width} numbers and no nulls")
    return values.to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def values_of(part: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers; null is NaN."""
    return part.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def lists_of(values: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """A matrix as an array column, null in the rows of ``none``."""
    rows, width = values.shape
    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values, dtype=float).ravel()), mask=None if none is None else pa.array(none))


class Dictionary:
    """Fiber atoms (pair-major: pair, then direction) and isotropic atoms of a protocol."""

    def __init__(self, protocol: Protocol, directions: list, pairs: list, grid: list, neighbours: int | None = None):
        self.b, self.g = np.array(protocol.b), np.array(protocol.g)
        self.u, self.pairs, self.grid = np.array(directions), list(pairs), np.array(grid)
        self.c2 = (self.g @ self.u.T) ** 2
        fiber = [np.exp(-self.b[:, None] * (rd + (ad - rd) * self.c2)) for ad, rd in self.pairs]
        self.iso = np.exp(-self.b[:, None] * self.grid[None, :])
        self.matrix = np.hstack([*fiber, self.iso])
        self.fibers = len(self.pairs) * len(self.u)
        self.directions = Directions(directions, neighbours)

    def penalty(self, fiber: float, iso: float) -> np.ndarray:
        return np.concatenate([np.full(self.fibers, fiber), np.full(len(self.grid), iso)])

    def sums(self) -> np.ndarray:
        """Columns that sum weights: of the fibers, of the bands rf, hf, wf of the isotropic atoms, and of these times their diffusivity."""
        out = np.zeros((self.matrix.shape[1], 7))
        out[: self.fibers, 0] = 1.0
        for k, inside in enumerate((self.grid <= S.RES_MAX, (self.grid > S.RES_MAX) & (self.grid <= S.WAT_MIN), self.grid > S.WAT_MIN)):
            out[self.fibers :, 1 + k], out[self.fibers :, 4 + k] = inside, inside * self.grid
        return out

    def basins(self, w: np.ndarray) -> np.ndarray:
        """Weight of each direction's basin (0 for one that is no peak)."""
        return self.directions.basins(w[:, : self.fibers].reshape(len(w), len(self.pairs), -1).sum(1))


def spectra(rows: DataFrame, dictionary: Dictionary, fiber: float | str, iso: float | str, gate: float | str = S.CONCENTRATION_GATE, most: int = 2, again: bool = True, spread: tuple[float, float, float] = (SPREAD_LOW, SPREAD_HIGH, SPREAD_GAIN), select: tuple[float, float, float] = (S.LEAST_WEIGHT, S.PEAK_RATIO, S.SEPARATION_DEG)) -> DataFrame:
    """Ridge non-negative weights over the whole dictionary, solved ``again`` with a greater fiber penalty
    where the fiber weight is spread over directions.

    Adds parts (sums of the weights: of the fibers, of the isotropic bands rf, hf, wf, and of these weighted by diffusivity), concentration
    (share of the largest basin), dirs (of the fibers) and shares (of what their basins hold together).  Penalties and ``gate`` are
    numbers, or names of columns.
    ``spread``: concentration at which the penalty is greatest, at and over which it stays, and its greatest factor;
    ``select``: least weight, least ratio to the heaviest and least angle of a fiber.
    """
    a = dictionary.matrix
    plain, sums = a.T @ a, dictionary.sums()
    is_fiber = np.arange(a.shape[1]) < dictionary.fibers
    low, high, gain = spread

    def share(mass: np.ndarray) -> np.ndarray:
        total = mass.sum(1)
        return np.where(total >= 1e-10, mass.max(1) / np.maximum(total, 1e-10), 0.0)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        h = matrix_of(part, "signal", len(dictionary.b)) @ a
        of_fiber, of_iso, least = (values_of(part, x) if isinstance(x, str) else np.full(len(h), float(x)) for x in (fiber, iso, gate))
        w = np.empty_like(h)
        pairs, which = np.unique(np.column_stack([of_fiber, of_iso]), axis=0, return_inverse=True)
        for k, pair in enumerate(pairs.tolist()):
            own = np.flatnonzero(which.reshape(-1) == k)
            w[own] = ridge_nnls(plain, dictionary.penalty(*pair), h[own])
        c = share(dictionary.basins(w))
        own = np.flatnonzero((c < high) & again)
        grow = 1 + (gain - 1) * np.clip((high - c[own]) / (high - low), 0, 1)
        w[own] = ridge_nnls(plain, np.where(is_fiber, (grow * of_fiber[own])[:, None], of_iso[own][:, None]), h[own], w[own] > 0)
        mass = dictionary.basins(w)
        dirs, there = dictionary.directions.dominant_of(mass, least, most, *select)
        held = np.where(there, np.take_along_axis(mass, dirs, 1), 0.0)
        held /= np.where(there[:, :1], held.sum(1, keepdims=True), 1.0)
        ends = pa.array(np.append(0, there.sum(1).cumsum()).astype(np.int32))
        return [lists_of(w @ sums), pa.array(share(mass)), *(pa.ListArray.from_arrays(ends, pa.array(x[there])) for x in (dirs.astype(np.int32), held))]

    doubles = T.ArrayType(T.DoubleType())
    return fit_rows(rows, solve, [("parts", doubles), ("concentration", T.DoubleType()), ("dirs", T.ArrayType(T.IntegerType())), ("shares", doubles)])


def single_fiber(rows: DataFrame, protocol: Protocol, grid: list, ad: tuple = FINE_AD, rd: tuple = FINE_RD, ratio: float = FINE_RATIO, signal: str = "signal") -> DataFrame:
    """Tensor and fractions of one fiber of known direction (ux, uy, uz), together; null without one.

    For each admissible pair of diffusivities the fiber's column and the isotropic ones get the best
    non-negative weights; the pair with the least residual stays, and 5 x 5 pairs around it at half the
    spacing are tried.  With isotropic weights of any sign a pair's residual is a closed form and no greater, so only pairs for which that
    does not exceed the residual of the first of them are solved (in blocks, whose matrices share the isotropic part).
    Adds fit_ad, fit_rd, fit_w (fiber, then ``grid``), fit_residual.
    """
    b, g = np.array(protocol.b), np.array(protocol.g)
    iso = np.exp(-b[:, None] * np.array(grid)[None, :])
    iso_gram, k = iso.T @ iso, len(grid)
    span, sizes, _ = np.linalg.svd(iso, full_matrices=False)
    span = span[:, sizes > 1e-13 * sizes[0]]
    axes = [np.linspace(*x) for x in (ad, rd)]
    step = [x[1] - x[0] for x in axes]
    around = [(np.arange(5) - 2) * x / 2 for x in step]
    at_once = len(axes[0]) * len(axes[1])
    block, solved = max(1, MATRIX_BYTES // (8 * at_once * (k + 8))), max(1, MATRIX_BYTES // (8 * ((k + 1) ** 2 + 3 * len(b))))

    def bounds(y: np.ndarray, c2: np.ndarray, ad: np.ndarray, rd: np.ndarray) -> np.ndarray:
        """What no residual of each voxel's pairs is under, by the part of signal and fiber that the isotropic columns can't hold; a fiber's
        signal is the product of a factor of its axial and one of its radial diffusivity."""
        x, r = np.exp(-b * c2[:, None, :] * ad[:, :, None]), np.exp(-b * (1 - c2[:, None, :]) * rd[:, :, None]).transpose(0, 2, 1)
        off = y - (y @ span) @ span.T
        rest = (off * off).sum(1)[:, None, None]
        size = (x * x) @ (r * r)
        free = np.maximum(size - sum(((x * q) @ r) ** 2 for q in span.T), 1e-300)
        low = rest - np.maximum((x * off[:, None, :]) @ r, 0.0) ** 2 / free
        return low - 1e-13 * (y * y).sum(1)[:, None, None] * (1 + size / free)  # less what rounding may do

    def best(y: np.ndarray, c2: np.ndarray, ad: np.ndarray, rd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least residual of each voxel over the pairs of its ad and rd, inadmissible ones left out, and its pair and weights."""
        n, every = len(y), np.arange(len(y))
        low = np.where(ad[:, :, None] >= rd[:, None, :] * ratio, bounds(y, c2, ad, rd), np.inf).reshape(n, -1)
        residual, place, weights = np.full(low.shape, np.inf), np.zeros(low.shape, int), []

        def solve(at: np.ndarray, pair: np.ndarray) -> None:
            for i in range(0, len(at), solved):
                v, p = at[i : i + solved], pair[i : i + solved]
                one, two = ad[v, p // rd.shape[1]][:, None], rd[v, p % rd.shape[1]][:, None]
                own = np.exp(-b * (two + (one - two) * c2[v]))
                gram = np.empty((len(own), k + 1, k + 1))
                gram[:, 0, 0], gram[:, 1:, 1:] = (own * own).sum(1), iso_gram
                gram[:, 0, 1:] = gram[:, 1:, 0] = own @ iso
                w = nnls(gram, np.column_stack([(own * y[v]).sum(1), (y @ iso)[v]]))
                off = y[v] - w[:, :1] * own - w[:, 1:] @ iso.T
                residual[v, p], place[v, p] = (off * off).sum(1), sum(map(len, weights)) + np.arange(len(v))
                weights.append(w)

        first = low.argmin(1)
        some = np.flatnonzero(np.isfinite(low[every, first]))
        solve(some, first[some])
        keep = low <= residual[every, first][:, None]
        keep[~np.isfinite(low)] = False
        keep[every, first] = False
        solve(*np.nonzero(keep))
        first = residual.argmin(1)
        found = np.column_stack([ad[every, first // rd.shape[1]], rd[every, first % rd.shape[1]]])
        w = np.concatenate([*weights, np.zeros((1, k + 1))])[np.where(np.isfinite(residual[every, first]), place[every, first], -1)]
        return residual[every, first], found, w

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        y = matrix_of(part, signal, len(b))
        u = np.column_stack([values_of(part, c) for c in ("ux", "uy", "uz")])
        c2 = (u @ g.T) ** 2
        residual, found, w = np.full(len(y), np.nan), np.full((len(y), 2), np.nan), np.full((len(y), k + 1), np.nan)
        has = np.flatnonzero(~np.isnan(c2[:, 0]))
        for i in range(0, len(has), block):
            own = has[i : i + block]
            residual[own], found[own], w[own] = best(y[own], c2[own], *(np.broadcast_to(x, (len(own), len(x))) for x in axes))
            near = [np.maximum(found[own][:, j, None] + x, least) for j, (x, least) in enumerate(zip(around, (0.2e-3, S.RD_MIN)))]
            value, pair, weight = best(y[own], c2[own], *near)
            win = value < residual[own]
            residual[own[win]], found[own[win]], w[own[win]] = value[win], pair[win], weight[win]
        none = np.isnan(residual)
        return [pa.array(found[:, 0], mask=none), pa.array(found[:, 1], mask=none), lists_of(w, none), pa.array(residual, mask=none)]

    d = T.DoubleType()
    return fit_rows(rows, solve, [("fit_ad", d), ("fit_rd", d), ("fit_w", T.ArrayType(d)), ("fit_residual", d)], MANY)


def anchored_fractions(rows: DataFrame, protocol: Protocol, fibers: int = 2, iso: tuple = (S.D_RES, S.D_HIN, S.D_WAT)) -> DataFrame:
    """Non-negative weights of up to ``fibers`` fibers (ad1, rd1, u1x, u1y, u1z, ...; null: none) and of
    isotropic compartments at fixed diffusivities.  Adds anchored (fibers, then ``iso``)."""
    b, g = np.array(protocol.b), np.array(protocol.g)
    fixed = np.exp(-b[:, None] * np.array(iso)[None, :])

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        y = matrix_of(part, "signal", len(b))
        a = np.empty((len(y), len(b), fibers + len(iso)))
        a[:, :, fibers:] = fixed
        none = np.zeros((len(y), fibers + len(iso)), bool)
        for k in range(fibers):
            ad, rd, *u = (values_of(part, c.format(k + 1)) for c in ("ad{}", "rd{}", "u{}x", "u{}y", "u{}z"))
            none[:, k] = np.isnan(ad) | np.isnan(rd) | np.isnan(u[0])
            ad, rd, u = np.nan_to_num(ad), np.nan_to_num(rd), np.nan_to_num(np.column_stack(u))
            a[:, :, k] = np.exp(-b * (rd[:, None] + (ad - rd)[:, None] * (u @ g.T) ** 2))
        a[np.broadcast_to(none[:, None, :], a.shape)] = 0.0
        gram, h = a.transpose(0, 2, 1) @ a, (a.transpose(0, 2, 1) @ y[:, :, None])[:, :, 0]
        gram[:, np.arange(a.shape[2]), np.arange(a.shape[2])] += none  # a column of zeros gets weight 0
        return [lists_of(nnls(gram, h))]

    return fit_rows(rows, solve, [("anchored", T.ArrayType(T.DoubleType()))], MANY)


def log_regression(s: np.ndarray, other: np.ndarray, part: np.ndarray, b: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axial and radial diffusivity of one fiber when the rest of the signal is known; and where it can be solved."""
    y = np.log(np.clip((s - other) / (part[:, None] + 1e-12), 0.01, 1.0))
    weight, x = s * s, b * c2
    sums = [(weight * p * q).sum(1) for p, q in ((b, b), (b, x), (x, x), (b, y), (x, y))]
    det = sums[0] * sums[2] - sums[1] ** 2
    good = np.abs(det) >= 1e-20
    safe = np.where(good, det, 1.0)
    p, q = (sums[3] * sums[2] - sums[4] * sums[1]) / safe, (sums[4] * sums[0] - sums[3] * sums[1]) / safe
    rd, ad = np.clip(-p, S.RD_MIN, S.RD_MAX), np.clip(-p - q, S.AD_MIN, S.AD_MAX)
    mean = (ad + rd) / 2
    return np.where(ad < rd, mean, ad), np.where(ad < rd, mean, rd), good


def crossing_fibers(rows: DataFrame, protocol: Protocol, fibers: int = 2, rounds: int = 25) -> DataFrame:
    """Diffusivities of two or more crossing fibers with known fractions f1, f2, ..., directions u1x, u1y, u1z, ... and an
    isotropic signal ``iso_signal``.  A row has as many fibers as its first directions are not null; with fewer than two it gets nulls.
    Three rounds of one fiber after the other, then damped Gauss-Newton steps on all of them within bounds.  Adds ad1, rd1,
    ad2, rd2, ..., cost0 (of the start) and cost.
    """
    b, g = np.array(protocol.b), np.array(protocol.g)

    def parts(p: np.ndarray, f: np.ndarray, c2: np.ndarray) -> np.ndarray:
        ad, rd = p[:, 0::2, None], p[:, 1::2, None]
        return f[:, :, None] * np.exp(-b * (rd + (ad - rd) * c2))

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        there = ~np.isnan(np.column_stack([values_of(part, f"u{k + 1}x") for k in range(fibers)]))
        count = np.cumprod(there, axis=1).sum(1)
        out = np.full((2 * fibers + 2, part.num_rows), np.nan)
        for n in range(2, fibers + 1):
            at = np.flatnonzero(count == n)
            if len(at):
                *params, start, cost = refine(part.take(pa.array(at)), n)
                out[: 2 * n, at], out[-2, at], out[-1, at] = params, start, cost
        return [pa.array(v, mask=np.isnan(v)) for v in out]

    def refine(part: pa.RecordBatch, fibers: int) -> list[np.ndarray]:
        low, high = np.tile([S.AD_MIN, S.RD_MIN], fibers), np.tile([S.AD_MAX, S.RD_MAX], fibers)
        s, iso = matrix_of(part, "signal", len(b)), matrix_of(part, "iso_signal", len(b))
        f = np.column_stack([values_of(part, f"f{k + 1}") for k in range(fibers)])
        u = np.stack([np.column_stack([values_of(part, f"u{k + 1}{c}") for c in "xyz"]) for k in range(fibers)], 1)
        c2 = (u @ g.T) ** 2
        p = np.tile([1.6e-3, 0.4e-3], (len(s), fibers))
        for _ in range(3):
            for k in range(fibers):
                each = parts(p, f, c2)
                ad, rd, good = log_regression(s, iso + each.sum(1) - each[:, k], f[:, k], b, c2[:, k])
                p[good, 2 * k], p[good, 2 * k + 1] = ad[good], rd[good]
        cost = ((s - iso - parts(p, f, c2).sum(1)) ** 2).sum(1)
        start, damping = cost.copy(), np.full(len(s), 1e-3)
        active = np.arange(len(s))
        for _ in range(rounds):
            each = parts(p[active], f[active], c2[active])
            slope = np.empty((len(active), len(b), 2 * fibers))  # of the residual
            slope[:, :, 0::2] = (each * b * c2[active]).transpose(0, 2, 1)
            slope[:, :, 1::2] = (each * b * (1 - c2[active])).transpose(0, 2, 1)
            r = s[active] - iso[active] - each.sum(1)
            normal, down = slope.transpose(0, 2, 1) @ slope, slope.transpose(0, 2, 1) @ r[:, :, None]
            scale = np.diagonal(normal, axis1=1, axis2=2) + 1e-12
            better = np.zeros(len(active), bool)
            for _ in range(10):
                i = np.flatnonzero(~better)
                if not len(i):
                    break
                rows_ = active[i]
                system = normal[i] + (damping[rows_][:, None] * scale[i])[:, :, None] * np.eye(2 * fibers)
                new = np.clip(p[rows_] - np.linalg.solve(system, down[i])[:, :, 0], low, high)
                value = ((s[rows_] - iso[rows_] - parts(new, f[rows_], c2[rows_]).sum(1)) ** 2).sum(1)
                win = value < cost[rows_]
                p[rows_[win]], cost[rows_[win]], better[i[win]] = new[win], value[win], True
                damping[rows_] = np.clip(np.where(win, damping[rows_] / 2, damping[rows_] * 3), 1e-10, 1e10)
            active = active[better]
            if not len(active):
                break
        return [*p.T, start, cost]

    names = [f"{n}{k + 1}" for k in range(fibers) for n in ("ad", "rd")] + ["cost0", "cost"]
    return fit_rows(rows, solve, [(n, T.DoubleType()) for n in names], MANY)


def cone(axis: np.ndarray, half: float, n: int) -> np.ndarray:
    """For each axis, n directions that fill the cone around it along a spiral: (axes, n, 3)."""
    i = np.arange(n)
    z = 1 - (i + 0.5) / n * (1 - np.cos(half))
    r, turn = np.sqrt(np.maximum(0, 1 - z * z)), 2 * np.pi * i / ((1 + np.sqrt(5)) / 2)
    help_ = np.where((np.abs(axis[:, :1]) < 0.9), [1.0, 0.0, 0.0], [0.0, 1.0, 0.0])
    x = np.cross(axis, help_)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.cross(axis, x)
    out = z[None, :, None] * axis[:, None, :] + r[None, :, None] * (np.cos(turn)[None, :, None] * x[:, None, :] + np.sin(turn)[None, :, None] * y[:, None, :])
    return out / np.linalg.norm(out, axis=2, keepdims=True)


def refined_directions(rows: DataFrame, protocol: Protocol, schedule: list[tuple[float, int]], names: tuple[str, ...] = ("rf", "hf", "wf"), fixed: tuple[float, ...] = (S.D_RES, S.D_HIN, S.D_WAT)) -> DataFrame:
    """The direction (ux, uy, uz) of one fiber, searched anew in cones of (half angle, number) around it; null without one.

    Each candidate gets the closed-form tensor for a normalised ``signal`` with fixed fractions ff and ``names``; the one with the least squared
    error stays, the coarse direction itself included, so the error never grows.  The next cone is around the best so
    far.  Adds ref_x, ref_y, ref_z, ref_ad, ref_rd, ref_error0 (of the coarse direction) and ref_error.
    """
    b, g = np.array(protocol.b), np.array(protocol.g)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        s = matrix_of(part, "signal", len(b))
        f = np.column_stack([values_of(part, c) for c in ("ff", *names)])
        iso = sum((f[:, k + 1, None] * np.exp(-b * d) for k, d in enumerate(fixed)), np.zeros((1, len(b))))
        unit = f / f.sum(1, keepdims=True)
        rest = sum((unit[:, k + 1, None] * np.exp(-b * d) for k, d in enumerate(fixed)), np.zeros((1, len(b))))

        def scored(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            c2 = (u @ g.T) ** 2
            ad, rd, good = log_regression(np.maximum(s, 0.01), rest, unit[:, 0], b, c2)
            made = iso + f[:, :1] * np.exp(-b * (rd[:, None] + (ad - rd)[:, None] * c2))
            return ad, rd, np.where(good, ((s - made) ** 2).sum(1), np.inf)

        u = np.column_stack([values_of(part, c) for c in ("ux", "uy", "uz")])
        best, (ad, rd, error) = u.copy(), scored(u)
        start = error.copy()
        for half, n in schedule:
            around = cone(best.copy(), half, n)
            for k in range(n):
                new_ad, new_rd, value = scored(around[:, k])
                win = value < error
                best[win], ad[win], rd[win], error[win] = around[win, k], new_ad[win], new_rd[win], value[win]
        none = ~np.isfinite(error)
        return [pa.array(v, mask=none | np.isnan(v)) for v in (*best.T, ad, rd, start, error)]

    d = T.DoubleType()
    return fit_rows(rows, solve, [(n, d) for n in ("ref_x", "ref_y", "ref_z", "ref_ad", "ref_rd", "ref_error0", "ref_error")])
