"""Closed-form axial and radial diffusivities, fit quality and maps over fiber populations.

What sums over the measurements of a voxel is one Arrow pass of NumPy products over the rows' own partitions, since array
lambdas are interpreted element by element; what is left is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill import schema as S
from voxelmill.functions import columns as C
from voxelmill.operators.quantiles import percentiles
from voxelmill.operators.solvers import fit_rows, log_regression, matrix_of, values_of
from voxelmill.schema import Protocol


def _isotropic(b: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The signal of isotropic parts, each a fraction and a diffusivity of each row."""
    return sum((f[:, None] * np.exp(-b * d[:, None]) for f, d in parts), np.zeros((1, len(b))))


def conditioned(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """ad, rd, fa of rows with a normalised ``signal``, a direction (ux, uy, uz) and fractions ff, rf, hf, wf.

    The isotropic part at fixed diffusivities is taken off, and the logarithm of the rest is regressed
    on (b, b cos^2) with weights S^2: five sums and a 2 x 2 solve.  Null where that is singular or has no direction.
    """
    b, g = np.array(protocol.b), np.array(protocol.g)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        s = np.maximum(matrix_of(part, "signal", len(b)), 0.01)
        f = np.column_stack([values_of(part, c) for c in ("ff", "rf", "hf", "wf")])
        f = f / f.sum(1, keepdims=True)
        u = np.column_stack([values_of(part, c) for c in ("ux", "uy", "uz")])
        iso = _isotropic(b, [(f[:, k], np.full(len(f), d)) for k, d in ((1, S.D_RES), (2, S.D_HIN), (3, S.D_WAT))])
        ad, rd, good = log_regression(s, iso, f[:, 0], b, (u @ g.T) ** 2)
        good &= ~np.isnan(ad)
        return [pa.array(x, mask=~good) for x in (ad, rd)]

    out = fit_rows(rows, solve, [("ad", T.DoubleType()), ("rd", T.DoubleType())])
    return out.withColumn("fa", C.fa(F.col("ad"), F.col("rd")))


def recovered(part: pa.RecordBatch, three: bool, adc: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Isotropic fractions (null: 0) and diffusivities of rows: rf, hf, wf or rf, nrf; what is not fixed follows from the
    mean diffusivity ``adc`` (null: 1e-3).  Without ``adc`` all are fixed."""
    names = ("rf", "hf", "wf") if three else ("rf", "nrf")
    f = [np.nan_to_num(values_of(part, n)) for n in names]
    full = lambda d: np.full(part.num_rows, d)
    if adc is None:
        return list(zip(f, map(full, (S.D_RES, S.D_HIN, S.D_WAT) if three else (S.D_RES, S.D_NONRES))))
    mean = values_of(part, adc)
    mean, total = np.where(np.isnan(mean), 1e-3, mean), sum(f)
    rest = mean * total - f[0] * S.D_RES
    share = np.where(f[1] > 1e-6, f[1], 1.0)
    if three:
        own = np.where((f[1] > 1e-6) & (total >= 1e-10), np.clip((rest - f[2] * S.D_WAT_MEAN) / share, S.RES_MAX, S.WAT_MIN), 0.9e-3)
        return list(zip(f, (full(S.D_RES), own, full(S.D_WAT_MEAN))))
    own = np.where(total < 1e-10, 1e-3, np.where(f[1] > 1e-6, np.clip(rest / share, S.RES_MAX, S.ISO_MAX), mean))
    return list(zip(f, (full(S.D_RES), own)))


def fit_quality(rows: DataFrame, protocol: Protocol, populations: int = 1, three: bool = True, adc: str | None = None, threshold: float = S.FIBER_THRESHOLD) -> DataFrame:
    """r2, rmse of fitted rows against their raw, normalised ``signal`` (scaled to a mean of 1 at b = 0).

    The signal is rebuilt from the total fiber fraction ff, the isotropic fractions (rf, hf, wf; or rf, nrf) and the
    populations' tensors ad1, rd1, u1x, u1y, u1z, ad2, ...; f2, f3 are the shares of the others, the first has what they leave.  A
    population counts if ff is over the threshold, its share over 1e-6 and it has a tensor and a direction.  Null for rows
    without any fraction; r2 is null where the signal does not vary.
    """
    b, g = np.array(protocol.b), np.array(protocol.g)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        s = matrix_of(part, "signal", len(b))
        ff = np.nan_to_num(values_of(part, "ff"))
        iso = recovered(part, three, adc)
        shares = [np.zeros(0)] + [np.nan_to_num(values_of(part, f"f{k}")) for k in range(2, populations + 1)]
        shares[0] = np.maximum(ff - sum(shares[1:], np.zeros(len(ff))), 0.0)
        made = np.zeros_like(s) + _isotropic(b, iso)
        for k, f in enumerate(shares, 1):
            ad, rd = values_of(part, f"ad{k}"), values_of(part, f"rd{k}")
            u = np.column_stack([values_of(part, f"u{k}{c}") for c in "xyz"])
            use = (ff > threshold) & (f > 1e-6) & ~np.isnan(ad) & ~np.isnan(u[:, 0])
            ad, rd, u = (np.nan_to_num(x) for x in (ad, rd, u))
            made += np.where(use, f, 0.0)[:, None] * np.exp(-b * (rd[:, None] + (ad - rd)[:, None] * (u @ g.T) ** 2))
        some = ff + sum(f for f, _ in iso) >= 1e-6
        rr, spread = ((s - made) ** 2).sum(1), ((s - s.mean(1, keepdims=True)) ** 2).sum(1)
        varies = spread > 1e-14
        r2 = 1 - rr / np.where(varies, spread, 1.0)
        return [pa.array(r2, mask=~(some & varies)), pa.array(np.sqrt(rr / len(b)), mask=~some)]

    return fit_rows(rows, solve, [("r2", T.DoubleType()), ("rmse", T.DoubleType())])


def quality_report(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row (for each key ``by``) over r2 and rmse: medians, means and shares beyond limits."""
    r2, rmse = F.col("r2"), F.col("rmse")
    share = lambda cond: (cond.cast("int"), F.avg)
    also = {
        "mean_r2": (r2, F.avg), "over_99": share(r2 > 0.99), "over_95": share(r2 > 0.95), "over_90": share(r2 > 0.9), "under_90": share(r2 < 0.9),
        "mean_rmse": (rmse, F.avg), "rmse_over_05": share(rmse > 0.05),
    }
    return percentiles(rows, {"median_r2": (r2, 0.5), "median_rmse": (rmse, 0.5)}, by, also)


def fiber_maps(rows: DataFrame, populations: int = 2) -> DataFrame:
    """agg_ff, agg_ad, agg_rd and agg_fa over up to three populations, from the total fiber fraction ff, the others' fractions f2, f3
    and their tensors ad1, rd1, ...

    The first population has what the others leave of the total; diffusivities are sums of fraction times value (null: 0) over the
    total.  All but agg_ff are null without a first tensor or without fibers; agg_fa, of the mean tensor, also where that is 0.
    """
    value = lambda name: F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
    total = F.greatest(value("ff"), F.lit(0.0))
    rest = [value(f"f{k}") for k in range(2, populations + 1)]
    shares = [F.greatest(total - sum(rest, F.lit(0.0)), F.lit(0.0)), *rest]
    there = F.col("ad1").isNotNull() & ~F.isnan("ad1") & (total > 0)
    mean = {n: F.when(there, sum((f * value(f"{n}{k}") for k, f in enumerate(shares, 1)), F.lit(0.0)) / total) for n in ("ad", "rd")}
    rows = rows.withColumns({"agg_ff": F.nanvl(F.col("ff"), F.lit(None).cast("double")), "agg_ad": mean["ad"], "agg_rd": mean["rd"]})
    a, r = F.col("agg_ad"), F.col("agg_rd")
    md, size = (a + 2 * r) / 3, F.sqrt(a * a + 2 * r * r)
    return rows.withColumn("agg_fa", F.when(size > 0, F.sqrt(F.lit(1.5)) * F.sqrt((a - md) * (a - md) + 2 * (r - md) * (r - md)) / size))


def dead_zone(rows: DataFrame, before: str = "rf", after: str = "rf_corrected", limit: float = 0.02) -> DataFrame:
    """One row: voxels whose restricted fraction is under the limit, and its mean before and after a correction."""
    return rows.agg(F.count_if(F.col(before) < limit).alias("dead"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"))
