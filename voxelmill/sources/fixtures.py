"""Signals, weights and labelled rows derived from the given tables by closed formulas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill import schema as S
from voxelmill.functions import columns as C
from voxelmill.operators.solvers import fit_rows, lists_of, values_of
from voxelmill.schema import Protocol, hemisphere

DIRECTIONS = hemisphere(20)
#: 4 unweighted measurements, then 20 directions at each of b = 1000, 2000, 3000.
PROTOCOL = Protocol(
    tuple([0.0] * 4 + [1000.0 * (1 + i // 20) for i in range(60)]),
    tuple([(0.0, 0.0, 0.0)] * 4 + [DIRECTIONS[i % 20] for i in range(60)]),
)
WEIGHT_DIRECTIONS = hemisphere(12)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores, two tasks for each; a table of many splits stays as it is.  A split may be without rows, so as many
    splits as cores don't mean that all work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, rows.columns[0]) if rows.rdd.getNumPartitions() < 4 * cores else rows


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One voxel for each part."""
    k = F.col("voxel_id")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("voxel_id"), F.col("p_retailprice").alias("s0_true"), F.col("p_brand").alias("scenario"), (F.col("p_size") / 50.0).alias("weight"))
    rows = spread(rows)
    rows = rows.select("*", (0.20 + 0.01 * (37 * k % 61)).alias("ff"), (0.01 * (53 * k % 21)).alias("rf"), (0.10 + 0.01 * (71 * k % 41)).alias("hf"), (0.01 * (89 * k % 11)).alias("wf"))
    tot = F.col("ff") + F.col("rf") + F.col("hf") + F.col("wf")
    rows = rows.withColumns({n: F.col(n) / tot for n in ("ff", "rf", "hf", "wf")})
    rows = rows.select("*", (1.2e-3 + 1e-5 * (29 * k % 81)).alias("ad_true"), (0.2e-3 + 1e-5 * (43 * k % 41)).alias("rd_true"), (13 * k % 20).cast("int").alias("dir_id"), (k % 10 != 0).alias("in_mask"))
    u = [F.element_at(C.doubles(d[i] for d in DIRECTIONS), F.col("dir_id") + 1) for i in range(3)]
    return rows.withColumns({"ux": u[0], "uy": u[1], "uz": u[2]})


def _noise(k: np.ndarray, n: int) -> np.ndarray:
    """Noise of n measurements of each voxel, in [-0.5, 0.5]."""
    return (7919 * k[:, None] + 104729 * np.arange(n)) % 1000 / 999.0 - 0.5


def _parts(part: pa.RecordBatch, b: np.ndarray) -> np.ndarray:
    """The isotropic signal of ``truth``."""
    return sum(values_of(part, n)[:, None] * np.exp(-b * d) for n, d in (("rf", S.D_RES), ("hf", S.D_HIN), ("wf", S.D_WAT)))


def _fiber(part: pa.RecordBatch, names: tuple[str, ...], b: np.ndarray, g: np.ndarray) -> np.ndarray:
    f, ad, rd, *u = (values_of(part, n)[:, None] for n in names)
    return f * np.exp(-b * (rd + (ad - rd) * (np.hstack(u) @ g.T) ** 2))


def signals(spark: SparkSession, sf_dir: str, protocol: Protocol = PROTOCOL) -> DataFrame:
    """``truth`` with its noisy signal; every 97th voxel is dead (all zero)."""
    b, g = np.array(protocol.b), np.array(protocol.g)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        k = part.column("voxel_id").to_numpy()
        s0 = values_of(part, "s0_true")[:, None]
        s = s0 * (_fiber(part, ("ff", "ad_true", "rd_true", "ux", "uy", "uz"), b, g) + _parts(part, b)) + 0.02 * s0 * _noise(k, len(b))
        s[k % 97 == 0] = 0.0
        return [lists_of(s)]

    return fit_rows(truth(spark, sf_dir), solve, [("signal", T.ArrayType(T.DoubleType()))])


#: The first measurements of ``PROTOCOL``: one shell.
SHORT = Protocol(PROTOCOL.b[:24], PROTOCOL.g[:24])


def subjects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Signals of four subjects (subject_id, voxel_id, x, y, z, in_mask, signal), whose voxel numbers are the same, and their protocols:
    every other one has ``SHORT``."""
    k = F.col("voxel_id")
    names = ["subject_id", "voxel_id", "x", "y", "z", "in_mask", "signal"]
    every = signals(spark, sf_dir).withColumns({"subject_id": F.concat(F.lit("S"), (k % 4).cast("string")), "signal": F.when(k % 2 == 0, F.col("signal")).otherwise(F.slice("signal", 1, len(SHORT.b)))})
    own = F.floor(k / 4)
    place = {"x": own % 16, "y": F.floor(own / 16) % 16, "z": F.floor(own / 256)}
    rows = every.withColumns({n: c.cast("int") for n, c in place.items()}).withColumn("voxel_id", own).select(*names)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 4).alias("n")).distinct()
    m = F.explode(F.arrays_zip(*[F.array(*map(F.lit, x)).alias(n) for n, x in (("m", range(len(PROTOCOL.b))), ("b", PROTOCOL.b), *((f"g{c}", [g[i] for g in PROTOCOL.g]) for i, c in enumerate("xyz")))]))
    protocols = parts.select(F.concat(F.lit("S"), F.col("n").cast("string")).alias("subject_id"), "n", m.alias("p")).filter((F.col("n") % 2 == 0) | (F.col("p.m") < len(SHORT.b)))
    return rows, protocols.select("subject_id", "p.*")


def two_fibers(spark: SparkSession, sf_dir: str, protocol: Protocol = PROTOCOL) -> DataFrame:
    """Voxels with two crossing fibers (fractions f1, f2, directions u1x, ..., u2z; diffusivities ad_k_true,
    rd_k_true), their normalised signal with noise, and its isotropic part."""
    rows = truth(spark, sf_dir)
    at = {1: F.col("dir_id"), 2: (F.col("dir_id") + 10) % 20}
    rows = rows.withColumns({f"u{k}{c}": F.element_at(C.doubles(d[i] for d in DIRECTIONS), at[k] + 1) for k in at for i, c in enumerate("xyz")})
    rows = rows.withColumns({"f1": 0.6 * F.col("ff"), "f2": 0.4 * F.col("ff"), "ad_1_true": F.col("ad_true"), "rd_1_true": F.col("rd_true"), "ad_2_true": F.col("ad_true"), "rd_2_true": F.col("rd_true") + 1e-4})
    b, g = np.array(protocol.b), np.array(protocol.g)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        iso = _parts(part, b)
        s = iso + sum(_fiber(part, (f"f{k}", f"ad_{k}_true", f"rd_{k}_true", f"u{k}x", f"u{k}y", f"u{k}z"), b, g) for k in (1, 2))
        s = s + 0.002 * _noise(part.column("voxel_id").to_numpy(), len(b))
        return [lists_of(x) for x in (iso, s)]

    return fit_rows(rows, solve, [("iso_signal", T.ArrayType(T.DoubleType())), ("signal", T.ArrayType(T.DoubleType()))])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row for each part: true cell (ff_level, rf_level), and biased estimates of both."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("voxel_id"), F.element_at(C.doubles((0.0, 0.2, 0.4, 0.6)), (k % 4 + 1).cast("int")).alias("ff_level"),
        F.element_at(C.doubles((0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)), (F.floor(k / 4) % 9 + 1).cast("int")).alias("rf_level"),
    ).filter("ff_level + rf_level <= 0.95")
    noise = 0.002 * (F.col("voxel_id") * 7919 % 11) / 10
    return rows.withColumn("ff_est", F.col("ff_level") + 0.001 * (F.col("voxel_id") % 7)).withColumn("rf_est", F.greatest(F.col("rf_level") * (0.9 - 0.3 * F.col("ff_level")) - 0.03, F.lit(0.0)) + noise)


def labelled_signals(spark: SparkSession, sf_dir: str, protocol: Protocol = PROTOCOL) -> DataFrame:
    """The signals of the voxels of ``labelled``, of known cell (ff_level, rf_level), whose other
    parameters vary by closed formulas: the rest's shares and diffusivities, and one fiber or two."""
    b = np.array(protocol.b)
    c2 = (np.array(protocol.g) @ np.array(DIRECTIONS).T).T ** 2

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        k, ff, rf = part.column("voxel_id").to_numpy()[:, None], values_of(part, "ff_level")[:, None], values_of(part, "rf_level")[:, None]
        share = lambda factor, of, lo, hi: lo + (hi - lo) * (factor * k % of) / (of - 1.0)
        r, h, w, s = share(37, 61, 0.1e-3, 0.28e-3), share(53, 101, 0.4e-3, 2.5e-3), share(71, 41, 3.0e-3, 5.0e-3), share(89, 31, 0.4, 0.95)
        ad, rd, f = share(29, 83, 1.2e-3, 2.0e-3), share(43, 47, 0.1e-3, 0.8e-3), np.where(k // 36 % 2 == 0, 1.0, share(11, 17, 0.0, 1.0))
        one, two = (np.exp(-b * (rd + (ad - rd) * c2[(13 * k[:, 0] + n) % 20])) for n in (0, 10))
        iso = rf * np.exp(-b * r) + (1 - ff - rf) * (s * np.exp(-b * h) + (1 - s) * np.exp(-b * w))
        return [lists_of(ff * (f * one + (1 - f) * two) + iso + 0.02 * _noise(k[:, 0], len(b)))]

    rows = spread(labelled(spark, sf_dir).select("voxel_id", "ff_level", "rf_level"))
    return fit_rows(rows, solve, [("signal", T.ArrayType(T.DoubleType()))])


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as dictionary weights: one voxel for each order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = F.when(F.col("l_returnflag") == "R", "aniso").otherwise("iso")
    return rows.select(F.col("l_orderkey").alias("voxel_id"), kind.alias("kind"), (0.04 * F.col("l_discount")).alias("adc"), F.col("l_quantity").cast("double").alias("w"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as weights over 12 directions x 5 pairs and 4 isotropic atoms."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("voxel_id"), "label", F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("w"))
