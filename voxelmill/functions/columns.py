"""Column expressions of the signal model: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelmill import schema as S
from voxelmill.schema import Protocol


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + of(x))


def mean_where(signal: Column, keep: list[bool]) -> Column:
    """Mean of the measurements whose flag is set; 0 if there are none."""
    at = [i for i, k in enumerate(keep) if k]
    return sum((signal[i] for i in at), F.lit(0.0)) / len(at) if at else F.lit(0.0)


def std_where(signal: Column, keep: list[bool], population: bool = False) -> Column:
    """Standard deviation of the flagged measurements, summed in order."""
    at = [i for i, k in enumerate(keep) if k]
    mean = mean_where(signal, keep)
    n = len(at) - (0 if population else 1)
    return F.sqrt(sum(((signal[i] - mean) * (signal[i] - mean) for i in at), F.lit(0.0)) / n) if n > 0 else F.lit(None).cast("double")


def s0(signal: Column, protocol: Protocol) -> Column:
    """Mean of the measurements with b under 100."""
    return mean_where(signal, [b < S.B0_NORMALISE for b in protocol.b])


def rician(signal: Column, sigma: Column) -> Column:
    """sqrt(s^2 - 2 sigma^2), or 0 where that is not positive."""
    two = 2 * sigma * sigma
    return F.transform(signal, lambda s: F.when(s * s > two, F.sqrt(s * s - two)).otherwise(F.lit(0.0)))


def fa(ad: Column, rd: Column) -> Column:
    """Anisotropy of a fiber: (AD - RD) / sqrt(AD^2 + 2 RD^2) in [0, 1]."""
    a, r = F.greatest(ad, rd), F.least(ad, rd)
    flat = (a < 1e-10) | (r < 1e-10) | (a - r < 1e-10)
    return F.when(ad.isNull() | rd.isNull(), F.lit(None)).when(flat, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (a - r) / F.sqrt(a * a + 2 * r * r))))


def squared_cosines(ux: Column, uy: Column, uz: Column, protocol: Protocol) -> Column:
    """(g . u)^2 of each measurement."""
    dots = F.arrays_zip(*[doubles(g[i] for g in protocol.g).alias(c) for i, c in enumerate("xyz")])
    return F.transform(dots, lambda g: F.pow(g["x"] * ux + g["y"] * uy + g["z"] * uz, F.lit(2.0)))


def fiber_signal(b: Column, c2: Column, ad: Column, rd: Column) -> Column:
    return F.zip_with(b, c2, lambda x, c: F.exp(-x * (rd + (ad - rd) * c)))


def recover_iso(rf: Column, hf: Column, wf: Column, adc: Column) -> Column:
    """Hindered diffusivity that agrees with the mean isotropic one, three compartments; null where the mean is not positive, or the
    hindered or all isotropic fractions are not over 1e-6."""
    tot = rf + hf + wf
    d = (adc * tot - rf * S.D_RES - wf * S.D_WAT_MEAN) / hf
    return F.when((adc > 0) & (hf > 1e-6) & (tot > 1e-6), F.greatest(F.lit(S.RES_MAX), F.least(F.lit(S.WAT_MIN), d)))


def recover_nonrestricted(rf: Column, nrf: Column, adc: Column) -> Column:
    """The same of the non-restricted diffusivity, two compartments."""
    tot = rf + nrf
    d = (adc * tot - rf * S.D_RES) / nrf
    return F.when((adc > 0) & (nrf > 1e-6) & (tot > 1e-6), F.greatest(F.lit(S.RES_MAX), F.least(F.lit(S.ISO_MAX), d)))


def confidence(d: Column, low: float, threshold: float, high: float, as_coded: bool = False) -> Column:
    """0 at a compartment's threshold, rising to 1 at the edges of its zone and beyond; null without a diffusivity.

    ``as_coded`` gives the opposite ramp inside the zone.
    """
    ramp = F.when(d < threshold, (d - low) / (threshold - low)).otherwise((high - d) / (high - threshold))
    return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("double")).when((d < low) | (d > high), F.lit(1.0)).otherwise(ramp if as_coded else 1 - ramp)
