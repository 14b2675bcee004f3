"""Choice of penalties for many subjects at once: every step is one job over all of them.

Subjects are told apart by the columns ``by``.  Moments are summed by subject, penalty curves are computed where a subject's moment
lies, non-negative fits run by (subject, penalty), and curves are read in windows of a subject, so the number of jobs
does not grow with that of the subjects and nothing of them comes to the driver.  Results of a step are small (a row or a
curve of some dozen rows a subject) and are written, so no step runs twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.operators.calibration import _fiber_scale, _neighbours, _points, cap, corner, discrepancy, least
from voxelmill.operators.quantiles import beside
from voxelmill.operators.solvers import ROWS, Dictionary, fit_rows, matrix_of, ridge_nnls, values_of
from voxelmill.storage import stash

#: Subjects whose sums a task holds before it gives them on.
HELD = 256
ISO_VALUES, FIBER_VALUES = (-5.0, 1.0, 40), (-4.0, 4.0, 40)


def _fields(rows: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(n, rows.schema[n].dataType) for n in names]


def moments_by(rows: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """For each subject, ``moment``: the mean of s s' over its signals, row after row (n * n numbers)."""
    by = list(by)
    schema = T.StructType([*_fields(rows, by), T.StructField("at", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            keys = list(held)
            size = n * n + 1
            columns = [pa.array([k[i] for k in keys for _ in range(size)], own) for i, own in enumerate(types)]
            at, value = np.tile(np.arange(size, dtype=np.int32), len(keys)), np.concatenate([held[k] for k in keys])
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(value)], names=[*by, "at", "value"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(k).type for k in by]
            keys = list(zip(*(batch.column(k).to_pylist() for k in by))) if by else [()] * batch.num_rows
            s = matrix_of(batch, "signal", n)
            where: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                where.setdefault(k, []).append(i)
            for k, own in where.items():
                total = np.append((s[own].T @ s[own]).ravel(), float(len(own)))
                held[k] = held[k] + total if k in held else total
                if len(held) >= HELD:
                    yield given()
        if held:
            yield given()

    named = [c for c in rows.columns if c == "voxel_id" and c not in by]
    added = rows.select(*by, *named, "signal").mapInArrow(sums, schema).groupBy(*by, "at").agg(F.sum("value").alias("value"))
    one = added.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("sums"))  # n * n + 1 numbers a subject
    count = F.element_at("sums", -1)["value"]
    return one.select(*by, F.transform(F.slice("sums", 1, n * n), lambda x: x["value"] / count).alias("moment"))


def curves_by(moments: DataFrame, dictionary: Dictionary, by: Sequence[str], iso: str | None = None) -> DataFrame:
    """lambda, rss, eta2, dof, gcv for each subject of ``moments_by``: of ridge penalties on the isotropic atoms alone or, where ``iso`` names
    the column of the isotropic penalty, of fiber penalties over the whole dictionary.  Each subject and penalty is a row of its own, dealt to
    all tasks."""
    by, n, k = list(by), len(dictionary.b), len(dictionary.grid)
    names = ("rss", "eta2", "dof", "gcv")

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        out = []
        fixed = values_of(part, iso) if iso else np.zeros(part.num_rows)
        for moment, value, penalty in zip(matrix_of(part, "moment", n * n), fixed, values_of(part, "lambda")):
            if iso:
                points = _points(moment.reshape(n, n), dictionary.matrix, dictionary.penalty(0.0, value), dictionary.penalty(1.0, 0.0), np.array([penalty]))
            else:
                points = _points(moment.reshape(n, n), dictionary.iso, np.zeros(k), np.ones(k), np.array([penalty]))
            out.append(points[0][1:])
        return [pa.array(x, pa.float64()) for x in zip(*out)] if out else [pa.array([], pa.float64()) for _ in names]

    values = np.logspace(*(FIBER_VALUES if iso else ISO_VALUES))
    rows = moments.select(*by, "moment", *([iso] if iso else []), F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("lambda"))
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *by, "lambda")
    return fit_rows(rows, solve, [(x, T.DoubleType()) for x in names]).select(*by, "lambda", *names)


def residuals_by(rows: DataFrame, dictionary: Dictionary, by: Sequence[str], values: Column, iso: str | None = None) -> DataFrame:
    """lambda, residual of each subject: mean squared residual of the non-negative fits of its signals for each of its ``values`` (an array).

    With the column ``iso`` of an isotropic penalty these are fiber penalties over the whole dictionary, else isotropic ones of the
    isotropic atoms.  Rows are dealt by subject, penalty and a part of the signal, so that those of one matrix meet.
    """
    by = list(by)
    a = dictionary.matrix if iso else dictionary.iso
    plain = a.T @ a

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        s = matrix_of(part, "signal", len(a))
        pair = np.column_stack([values_of(part, "lambda"), values_of(part, iso) if iso else np.zeros(len(s))])
        out = np.empty(len(s))
        for own in np.unique(pair, axis=0):
            at = np.flatnonzero((pair == own).all(1))
            penalty = dictionary.penalty(own[0], own[1]) if iso else np.full(a.shape[1], own[0])
            off = s[at] - ridge_nnls(plain, penalty, s[at] @ a) @ a.T
            out[at] = (off * off).sum(1)
        return [pa.array(out)]

    each = rows.select(*by, "voxel_id", "signal", *([iso] if iso else []), F.explode(values).alias("lambda"))
    each = each.repartition(*by, "lambda", F.pmod(F.xxhash64("voxel_id"), F.lit(4)))
    return fit_rows(each, solve, [("residual", T.DoubleType())]).groupBy(*by, "lambda").agg(F.avg("residual").alias("residual"))


def discrepancy_by(sample: DataFrame, dictionary: Dictionary, by: Sequence[str], known: DataFrame, tolerance: float = 1e-3, passes: int = 4) -> DataFrame:
    """For each subject the fiber penalty (lambda) at which its mean residual meets its limit; ``known`` has its iso and its limit.

    A curve over ten decades gives the two neighbours of each subject's crossing, and each further pass, one job for all that are not yet within
    the tolerance, 8 values between these.  Edges are those of ``discrepancy``.
    """
    by = list(by)
    known = known.select(*by, "iso", "limit")
    points = stash(residuals_by(beside(sample, known, by), dictionary, by, F.array(*[F.lit(float(v)) for v in np.logspace(-6, 4, 16)]), "iso"), "points")
    for _ in range(passes):
        near = _neighbours(beside(points, known, by), by)
        meets = (F.col("residual") <= F.col("limit")) & (F.col("next") > F.col("limit"))
        cross = near.filter(meets).groupBy(*by).agg(F.min_by(F.struct("lambda", "residual", "next_lambda", "next", "limit"), "lambda").alias("c")).select(*by, "c.*")
        wide = stash(cross.filter(F.col("next") - F.col("residual") > tolerance * F.col("limit")), "crossings")
        if wide.isEmpty():
            break
        inner = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.col("low") * F.pow(F.col("high") / F.col("low"), k / 9.0))
        ends = wide.select(*by, F.col("lambda").alias("low"), F.col("next_lambda").alias("high"))
        rows = beside(beside(sample, known, by), ends, by).filter("low is not null")
        same = [F.col(f"points.{k}").eqNullSafe(F.col(f"wide.{k}")) for k in by]
        kept = points.alias("points").join(wide.select(*by).alias("wide"), same, "left_anti").select(*by, "lambda", "residual")
        old = wide.select(*by, F.explode(F.array(F.struct("lambda", "residual"), F.struct(F.col("next_lambda").alias("lambda"), F.col("next").alias("residual")))).alias("p")).select(*by, "p.*")
        points = stash(kept.unionByName(old).unionByName(residuals_by(rows, dictionary, by, inner, "iso")), "points")
    floor = F.greatest(0.1 * F.col("iso"), F.lit(_fiber_scale(dictionary)))
    return discrepancy(beside(points, known.withColumn("floor", floor), by), "limit", "floor", by)


def without_fibers_by(sample: DataFrame, dictionary: Dictionary, by: Sequence[str]) -> DataFrame:
    """``signal`` of the sample less the fiber atoms' part of its non-negative fit with its subject's penalties (columns fiber, iso)."""
    a, by = dictionary.matrix, list(by)
    plain, fibers = a.T @ a, a[:, : dictionary.fibers]

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        s = matrix_of(part, "signal", len(a)).copy()
        pair = np.column_stack([values_of(part, "fiber"), values_of(part, "iso")])
        for own in np.unique(pair, axis=0):
            at = np.flatnonzero((pair == own).all(1))
            s[at] = s[at] - ridge_nnls(plain, dictionary.penalty(*own), s[at] @ a)[:, : dictionary.fibers] @ fibers.T
        return [pa.array(list(s), pa.list_(pa.float64()))]

    rows = sample.select(*by, "voxel_id", "signal", "fiber", "iso")
    return fit_rows(rows, solve, [("rest", T.ArrayType(T.DoubleType()))], ROWS).select(*by, "voxel_id", F.col("rest").alias("signal"))


def two_pass_by(sample: DataFrame, dictionary: Dictionary, sigma: DataFrame, by: Sequence[str], method: str = "discrepancy") -> DataFrame:
    """by, step, lambda: both penalties of each subject's sample (voxel_id, signal), by the steps of ``calibration.two_pass``; ``sigma`` is the
    noise of each."""
    if method not in ("discrepancy", "gcv", "corner"):
        raise ValueError(f"no such method: {method}")
    by, n = list(by), len(dictionary.b)
    sample = stash(sample.select(*by, "voxel_id", "signal"), "samples")
    limits = sigma.select(*by, (n * F.coalesce("sigma", F.lit(0.0)) ** 2).alias("limit"))
    by_gcv = lambda rows: least(curves_by(moments_by(rows, n, by), dictionary, by), by=by)
    named = lambda table, name: table.select(*by, F.col("lambda").alias(name))

    steps = stash(beside(named(by_gcv(sample), "iso_first"), limits, by), "steps")
    first = discrepancy_by(sample, dictionary, by, steps.withColumnRenamed("iso_first", "iso"))
    steps = stash(beside(steps, named(first, "fiber_first"), by), "steps")
    own = steps.select(*by, F.col("fiber_first").alias("fiber"), F.col("iso_first").alias("iso"))
    rest = stash(without_fibers_by(beside(sample, own, by), dictionary, by), "rests")
    curve = residuals_by(rest, dictionary, by, F.array(*[F.lit(float(v)) for v in np.logspace(-5, 1, 16)]))
    steps = beside(steps, named(by_gcv(rest), "iso_second"), by)
    steps = beside(steps, named(cap(beside(curve, limits, by), "limit", by), "iso_cap"), by)
    steps = stash(steps.withColumn("iso", F.least("iso_second", "iso_cap")), "steps")
    if method == "discrepancy":
        second = discrepancy_by(sample, dictionary, by, steps)
    else:
        curve = curves_by(beside(moments_by(sample, n, by), steps.select(*by, "iso"), by), dictionary, by, "iso")
        second = least(curve, by=by) if method == "gcv" else corner(curve, by)
    names = ("iso_first", "fiber_first", "iso_second", "iso_cap", "iso", "fiber")
    return beside(steps, named(second, "fiber"), by).unpivot(by, list(names), "step", "lambda")
