"""Noise, masks, normalisation and sampling of voxel signals, of one subject or by subject.

``by`` names the columns that tell subjects apart; without it all rows are one subject's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill import schema as S
from voxelmill.functions import columns as C
from voxelmill.operators.quantiles import beside, percentiles
from voxelmill.schema import Protocol


def in_mask(signals: DataFrame) -> DataFrame:
    """Voxels of the brain mask."""
    return signals.filter("in_mask")


def _inside(value: Column) -> Column:
    return F.when(F.col("in_mask"), value)


def default_mask(signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Without a mask: voxels whose mean signal is over the 10th percentile of the subject's positive means."""
    means = signals.withColumn("mean_signal", C.total(F.col("signal")) / F.size("signal"))
    cut = percentiles(means, {"cut": (F.when(F.col("mean_signal") > 0, F.col("mean_signal")), 0.1)}, by)
    return beside(means, cut, by).filter("mean_signal > cut").drop("cut")


def temporal_noise(signals: DataFrame, protocol: Protocol, by: Sequence[str] = ()) -> DataFrame:
    """A row a subject: snr, sigma from repeats with b under 50; (20, 1) without voxels.

    The correction of a voxel's SNR for the noise floor is a fixed-point iteration whose k-th value is
    mean / (std sqrt(c_k)), c_k = 2/3 + (-1/2)^k / 3, so it ends at the same k for all voxels: the first
    at which the mean change is under 0.01, at most 20.
    """
    keep = [b < S.B0_NOISE for b in protocol.b]
    mean, std = C.mean_where(F.col("signal"), keep), C.std_where(F.col("signal"), keep)
    rows = signals.select(*by, _inside(mean).alias("mean"), _inside(F.when(std == 0, F.lit(1e-10)).otherwise(std)).alias("std"))
    ratio = F.col("mean") / F.col("std")
    one = percentiles(rows, {"ratio": (ratio, 0.5), "spread": (F.col("std"), 0.5)}, by, {"change": (ratio, F.avg)})
    c = [2 / 3 + (-0.5) ** k / 3 for k in range(21)]
    root = [1 / x**0.5 for x in c]
    last = F.coalesce(*[F.when(F.col("change") * abs(root[k] - root[k - 1]) < 0.01, F.lit(k)) for k in range(1, 21)], F.lit(20))
    at = F.element_at(C.doubles(root), last + 1)
    return one.select(*by, F.when(F.col("change").isNull(), F.lit(20.0)).otherwise(F.col("ratio") * at).alias("snr"), F.when(F.col("change").isNull(), F.lit(1.0)).otherwise(F.col("spread") / at).alias("sigma"))


def spatial_noise(signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row a subject: snr, sigma from the background of the first measurement; (20, 1) without one."""
    first = F.col("signal")[0]
    one = percentiles(signals, {"middle": (_inside(first), 0.5)}, by, {"outside": (F.when(~F.col("in_mask") & (first > 0), first), F.avg)})
    sigma = F.col("outside") / 1.253
    return one.select(*by, F.coalesce(F.col("middle") / sigma, F.lit(20.0)).alias("snr"), F.coalesce(sigma, F.lit(1.0)).alias("sigma"))


def corrected(signals: DataFrame, noise: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signals less the Rician bias of the subject's sigma in ``noise``; 0 outside the mask."""
    out = beside(signals, noise.select(*by, "sigma"), by)
    zero = F.transform("signal", lambda s: F.lit(0.0))
    return out.withColumn("signal", F.when(F.col("in_mask"), C.rician(F.col("signal"), F.col("sigma"))).otherwise(zero)).drop("sigma")


def normalised(signals: DataFrame, protocol: Protocol) -> DataFrame:
    """Signals over their own S0, with s0; voxels with S0 under 1e-6 are left out."""
    out = signals.withColumn("s0", C.s0(F.col("signal"), protocol)).filter("s0 >= 1e-6")
    return out.withColumn("signal", F.transform("signal", lambda s: s / F.col("s0")))


def eligible(signals: DataFrame, protocol: Protocol, by: Sequence[str] = ()) -> DataFrame:
    """Voxels for calibration: S0 over a twentieth of the median of the subject's positive ones."""
    base = C.s0(F.col("signal"), protocol) if any(b < S.B0_NORMALISE for b in protocol.b) else F.col("signal")[0]
    rows = in_mask(signals).withColumn("s0", base)
    cut = percentiles(rows, {"cut": (F.when(F.col("s0") > 0, F.col("s0")), 0.5)}, by).select(*by, (0.05 * F.col("cut")).alias("cut"))
    return beside(rows, cut, by).filter("s0 > cut").drop("cut")


def sample(rows: DataFrame, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """n voxels of each subject without replacement, in the order of an arithmetic hash of id and seed.

    By subject, each task keeps its own first n of a subject before they are shuffled.
    """
    key = F.pmod((F.col("voxel_id") + seed) * 7919 + 104729, F.lit(1000003))
    if not by:
        return rows.orderBy(key, "voxel_id").limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(key, "voxel_id"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def sample_sigma(rows: DataFrame, protocol: Protocol, by: Sequence[str] = ()) -> DataFrame:
    """A row a subject: the normalised noise of a calibration sample with s0."""
    keep = [b < S.B0_NORMALISE for b in protocol.b]
    spread = C.std_where(F.col("signal"), keep) / F.col("s0") if sum(keep) >= 2 else 0.3 * C.std_where(F.col("signal"), [True] * len(keep), True)
    return percentiles(rows, {"sigma": (spread, 0.5)}, by)
