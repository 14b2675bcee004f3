"""Dictionary weights to fractions, direction totals, peaks and basins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill import schema as S
from voxelmill.functions import columns as C
from voxelmill.operators.directions import Directions
from voxelmill.operators.solvers import fit_rows, matrix_of


def fractions(atoms: DataFrame) -> DataFrame:
    """Per voxel_id of atoms (kind aniso or iso, adc, w): fractions, centroids and mean isotropic ADC."""
    iso = F.col("kind") == "iso"
    band = {"nrf": iso & (F.col("adc") > S.RES_MAX), "rf": iso & (F.col("adc") <= S.RES_MAX), "hf": iso & (F.col("adc") > S.RES_MAX) & (F.col("adc") <= S.WAT_MIN), "wf": iso & (F.col("adc") > S.WAT_MIN)}
    of = lambda cond, x=F.col("w"): F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    sums = [of(F.col("kind") == "aniso").alias("ff"), of(iso, F.col("w") * F.col("adc")).alias("adc"), F.sum("w").alias("tot")]
    for n, c in band.items():
        sums += [of(c).alias(n), of(c, F.col("w") * F.col("adc")).alias(f"{n}_d")]
    out = atoms.groupBy("voxel_id").agg(*sums).filter("tot >= 1e-10")
    total_iso = F.col("rf") + F.col("hf") + F.col("wf")
    default = {"rf": S.D_RES, "hf": S.D_HIN, "wf": S.D_WAT, "nrf": S.D_NONRES}
    return out.select(
        "voxel_id", (F.col("ff") / F.col("tot")).alias("fiber_fraction"), *[(F.col(n) / F.col("tot")).alias(x) for n, x in (("rf", "restricted_fraction"), ("hf", "hindered_fraction"), ("wf", "water_fraction"), ("nrf", "nonrestricted_fraction"))],
        *[F.when(F.col(n) > 1e-10, F.col(f"{n}_d") / F.col(n)).otherwise(F.lit(default[n])).alias(f"{n}_centroid") for n in band],
        F.when(total_iso > 0, F.col("adc") / total_iso).otherwise(F.lit(0.0)).alias("mean_iso_adc"),
    )


def with_totals(rows: DataFrame, n_dirs: int, n_pairs: int) -> DataFrame:
    """Adds t: weights of a pair-major array column ``w`` summed over the pairs (null: 0)."""
    at = lambda d, p: F.coalesce(F.get("w", d + p * n_dirs), F.lit(0.0))
    return rows.withColumn("t", F.transform(F.sequence(F.lit(0), F.lit(n_dirs - 1)), lambda d: sum((at(d, p) for p in range(n_pairs)), F.lit(0.0))))


def basins(rows: DataFrame, directions: Directions, gate: float = S.CONCENTRATION_GATE, most: int = 0) -> DataFrame:
    """Adds mass (weight of each direction's basin, 0 for one that is no peak) to rows with ``t``, in one pass over their own
    partitions, and with ``most`` dirs: up to so many directions of fibers, none where the gate is not passed."""

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        mass = directions.basins(matrix_of(part, "t", len(directions.u)))
        out = [pa.array(list(mass), pa.list_(pa.float64()))]
        return [*out, pa.array([directions.dominant(m, gate, most) for m in mass], pa.list_(pa.int32()))] if most else out

    dirs = [("dirs", T.ArrayType(T.IntegerType()))] if most else []
    return fit_rows(rows, solve, [("mass", T.ArrayType(T.DoubleType())), *dirs])


def peaks(masses: DataFrame) -> DataFrame:
    """voxel_id, d, w, mass, place (by mass, then d): a row for each peak of rows with ``t`` and ``mass``."""
    every = F.transform("mass", lambda m, d: F.struct((-m).alias("less"), d.alias("d"), F.get("t", d).alias("w")))
    rows = masses.select("voxel_id", F.posexplode(F.array_sort(F.filter(every, lambda x: x["less"] < 0))).alias("at", "x"))
    return rows.select("voxel_id", F.col("x.d").alias("d"), F.col("x.w").alias("w"), (-F.col("x.less")).alias("mass"), (F.col("at") + 1).alias("place"))


def concentration(masses: DataFrame) -> DataFrame:
    """voxel_id, concentration: share of the largest basin; voxels without weight are left out."""
    total = C.total(F.col("mass"))
    share = F.when(total >= 1e-10, F.array_max("mass") / total).otherwise(F.lit(0.0))
    return masses.filter(total > 0).select("voxel_id", share.alias("concentration"))
