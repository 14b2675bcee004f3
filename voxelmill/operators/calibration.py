"""Choice of penalties, gates and corrections from a sample or a labelled table.

Ridge residuals, norms and degrees of freedom are quadratic in the signals, so the penalty curves need
only their second moments: an N x N sum that Spark adds up over any number of voxels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill import schema as S
from voxelmill.operators.quantiles import percentiles
from voxelmill.operators.solvers import ROWS, Dictionary, fit_rows, matrix_of, nnls, ridge_nnls


def _named(rows: DataFrame) -> list[str]:
    """The id that errors name, where there is one."""
    return [c for c in rows.columns if c == "voxel_id"]


def moments(rows: DataFrame, n: int) -> np.ndarray:
    """Mean of s s' over the signals of n measurements (zeros without rows)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n, n)), 0
        for batch in batches:
            s = matrix_of(batch, "signal", n)
            total, count = total + s.T @ s, count + len(s)
        yield pa.RecordBatch.from_pydict({"at": np.arange(n * n + 1), "value": np.append(total.ravel(), float(count))})

    out = np.zeros(n * n + 1)
    for row in rows.select(*_named(rows), "signal").mapInArrow(sums, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # n * n + 1 numbers
        out[row["at"]] = row["value"]
    return out[:-1].reshape(n, n) / max(out[-1], 1.0)


def _points(moment: np.ndarray, matrix: np.ndarray, fixed: np.ndarray, varied: np.ndarray, values: np.ndarray) -> list[tuple]:
    n = len(matrix)
    out = []
    for value in values:
        reg = fixed + value * varied
        inverse = np.linalg.inv(matrix.T @ matrix + np.diag(reg))
        weights = inverse @ matrix.T
        off = np.eye(n) - matrix @ weights
        rss, eta2 = (float(np.sum((m @ moment) * m)) for m in (off, weights))
        dof = float(matrix.shape[1] - np.sum(reg * np.diag(inverse)))
        gcv = max(rss, 0.0) / n / max((1 - dof / n) ** 2, 1e-12) if dof < n else float("inf")
        out.append((float(value), max(rss, 0.0), max(eta2, 0.0), dof, gcv))
    return out


def penalty_curve(spark: SparkSession, moment: np.ndarray, matrix: np.ndarray, fixed: np.ndarray, varied: np.ndarray, values: np.ndarray) -> DataFrame:
    """lambda, rss, eta2, dof, gcv for ridge penalties ``fixed + lambda * varied`` on the columns."""
    return spark.createDataFrame(_points(moment, matrix, fixed, varied, values), "lambda double, rss double, eta2 double, dof double, gcv double")  # one row a value


def least(curve: DataFrame, score: str = "gcv", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key ``by``: the value of least score, the first of equals."""
    return curve.groupBy(*by).agg(F.min_by("lambda", F.struct(score, "lambda")).alias("lambda"), F.min(score).alias("score"))


def corner(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key ``by``: the value at which (ln rss / 2, ln eta2 / 2) bends most, and whether that is weak.

    The bend at a point is the curvature of the circle through it and its two neighbours; ends have none.
    """
    order = Window.partitionBy(*by).orderBy("lambda")  # a curve of a few dozen rows
    point = F.struct((F.log(F.greatest("rss", F.lit(1e-300))) / 2).alias("x"), (F.log(F.greatest("eta2", F.lit(1e-300))) / 2).alias("y"))
    rows = curve.withColumn("q", point).withColumn("p", F.lag("q").over(order)).withColumn("r", F.lead("q").over(order))
    d = lambda a, b: F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))
    area = F.abs((F.col("q.x") - F.col("p.x")) * (F.col("r.y") - F.col("p.y")) - (F.col("r.x") - F.col("p.x")) * (F.col("q.y") - F.col("p.y"))) / 2
    sides = d("p", "q") * d("q", "r") * d("p", "r")
    bend = F.when(F.col("p").isNotNull() & F.col("r").isNotNull(), F.when(sides > 1e-300, 4 * area / sides).otherwise(F.lit(0.0)))
    rows = rows.withColumn("bend", bend).filter("bend is not null")
    return rows.groupBy(*by).agg(F.min_by("lambda", F.struct(-F.col("bend"), F.col("lambda"))).alias("lambda"), (F.max("bend") < 1e-6).alias("weak"))


def cap(curve: DataFrame, limit: float | str, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key ``by``: the last value before ``residual`` first exceeds the limit; the least one if it does at once."""
    order = Window.partitionBy(*by).orderBy("lambda").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = curve.withColumn("fine", F.min((F.col("residual") <= _of(limit)).cast("int")).over(order))
    return rows.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("fine") == 1, F.col("lambda"))), F.min("lambda")).alias("lambda"))


def _residuals(sample: DataFrame, matrix: np.ndarray, penalties: dict[float, np.ndarray]) -> DataFrame:
    plain = matrix.T @ matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column("lambda").to_numpy()
            for v in np.unique(value):
                s = matrix_of(batch.filter(pa.array(value == v)), "signal", len(matrix))
                for at in range(0, len(s), ROWS):
                    part = s[at : at + ROWS]
                    off = part - ridge_nnls(plain, penalties[float(v)], part @ matrix) @ matrix.T
                    yield pa.RecordBatch.from_pydict({"lambda": np.full(len(part), v), "residual": (off * off).sum(1)})

    each = sample.select(*_named(sample), "signal", F.explode(F.array(*[F.lit(v) for v in penalties])).alias("lambda")).repartition(4 * len(penalties), "lambda", "signal")
    return each.mapInArrow(run, "lambda double, residual double").groupBy("lambda").agg(F.avg("residual").alias("residual"))


def residual_curve(sample: DataFrame, dictionary: Dictionary, iso: float, values: list[float]) -> DataFrame:
    """lambda, residual: mean squared residual of the non-negative fit of a sample, for each fiber penalty."""
    return _residuals(sample, dictionary.matrix, {v: dictionary.penalty(v, iso) for v in map(float, values)})


def iso_residual_curve(sample: DataFrame, dictionary: Dictionary, values: list[float]) -> DataFrame:
    """The same of the isotropic atoms alone, for each isotropic penalty."""
    return _residuals(sample, dictionary.iso, {v: np.full(len(dictionary.grid), v) for v in map(float, values)})


def without_fibers(sample: DataFrame, dictionary: Dictionary, fiber: float, iso: float) -> DataFrame:
    """``signal`` of the sample less the fiber atoms' part of its non-negative fit."""
    a = dictionary.matrix
    plain, penalty = a.T @ a, dictionary.penalty(fiber, iso)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = matrix_of(batch, "signal", len(a))
            for at in range(0, len(s), ROWS):
                part = s[at : at + ROWS]
                w = ridge_nnls(plain, penalty, part @ a)[:, : dictionary.fibers]
                yield pa.RecordBatch.from_pydict({"signal": list(part - w @ a[:, : dictionary.fibers].T)})

    return sample.select(*_named(sample), "signal").mapInArrow(run, "signal array<double>")


def two_pass(sample: DataFrame, dictionary: Dictionary, sigma: float, method: str = "discrepancy") -> DataFrame:
    """step, lambda: both penalties of a sample, chosen in two passes; ``iso`` and ``fiber`` are the results.

    The first pass takes the isotropic penalty by cross-validation on the whole signal and the fiber
    penalty by discrepancy.  The second takes the isotropic one on what the first fit's fibers leave, not
    above the value where the isotropic fit of that stops meeting the noise, and with it the fiber penalty
    by ``method``: discrepancy, gcv or corner.  Only single numbers come to the driver between steps.
    """
    if method not in ("discrepancy", "gcv", "corner"):
        raise ValueError(f"no such method: {method}")
    spark, n, k = sample.sparkSession, len(dictionary.b), len(dictionary.grid)
    limit = n * sigma**2

    def by_gcv(rows: DataFrame) -> float:
        curve = penalty_curve(spark, moments(rows, n), dictionary.iso, np.zeros(k), np.ones(k), np.logspace(-5, 1, 40))
        return least(curve).first()["lambda"]

    def fiber(iso: float, how: str) -> float:
        if how == "discrepancy":
            return discrepancy_search(sample, dictionary, iso, limit)
        curve = penalty_curve(spark, moments(sample, n), dictionary.matrix, dictionary.penalty(0.0, iso), dictionary.penalty(1.0, 0.0), np.logspace(-4, 4, 40))
        return (least(curve) if how == "gcv" else corner(curve)).first()["lambda"]

    steps = {"iso_first": by_gcv(sample)}
    steps["fiber_first"] = fiber(steps["iso_first"], "discrepancy")
    rest = without_fibers(sample, dictionary, steps["fiber_first"], steps["iso_first"])
    steps["iso_second"] = by_gcv(rest)
    top = cap(iso_residual_curve(rest, dictionary, list(np.logspace(-5, 1, 16))), limit).first()["lambda"]
    steps["iso_cap"] = steps["iso_second"] if top is None else top  # no rows, no cap
    steps["iso"] = min(steps["iso_second"], steps["iso_cap"])
    steps["fiber"] = fiber(steps["iso"], method)
    return spark.createDataFrame(list(steps.items()), "step string, lambda double")  # six numbers


def grid_scores(spark: SparkSession, moment: np.ndarray, b: np.ndarray, grids: dict[int, list[float]]) -> DataFrame:
    """n_iso, lambda, score: for each isotropic grid, its best penalty by cross-validation, from one moment."""
    points = []
    for n, grid in grids.items():
        atoms = np.exp(-b[:, None] * np.array(grid)[None, :])
        points += [(n, p[0], p[-1]) for p in _points(moment, atoms, np.zeros(len(grid)), np.ones(len(grid)), np.logspace(-5, 1, 40))]
    curves = spark.createDataFrame(points, "n_iso int, lambda double, gcv double")  # 40 rows a grid
    return curves.groupBy("n_iso").agg(F.min_by("lambda", F.struct("gcv", "lambda")).alias("lambda"), F.min("gcv").alias("score"))


def near_sizes(size: int, lo: int = 4, hi: int = 34, radius: int = 6, step: int = 2) -> list[int]:
    """Grid sizes to compare a chosen one with: within the radius, in steps, both ends and itself included."""
    a, b = max(lo, size - radius), min(hi, size + radius)
    return sorted({a, size, b, *range(a, b + 1, step)})


def fewest(scores: DataFrame, within: float = 0.02, flat: float = 0.005) -> DataFrame:
    """One row of ``scores(n_iso, score)``: best (least score, the smaller of equals), span (relative), and
    n_iso, the smallest whose score is within a share of the least; null where the span is under ``flat``."""
    low = scores.agg(F.min("score").alias("least"), F.max("score").alias("most"), F.min_by("n_iso", F.struct("score", "n_iso")).alias("best"))
    rows = scores.crossJoin(F.broadcast(low))  # one row is broadcast
    close = F.min(F.when(F.col("score") <= F.col("least") * (1 + within), F.col("n_iso")))
    span = F.first((F.col("most") - F.col("least")) / F.nullif(F.col("least"), F.lit(0.0)))
    return rows.agg(F.first("best").alias("best"), span.alias("span"), close.alias("close")).select("best", "span", F.when(F.col("span") < flat, None).otherwise(F.col("close")).alias("n_iso"))


def crosscheck(scores: DataFrame, size: int, step: int = 2) -> DataFrame:
    """One row: the chosen size, the best by score, and whether they lie within a step."""
    best = scores.agg(F.min_by("n_iso", F.struct("score", "n_iso")).alias("best"))
    return best.select(F.lit(size).alias("chosen"), "best", (F.abs(F.col("best") - size) <= step).alias("agrees"))


#: Grid sizes that the bootstrap compares, noisy replicates of each voxel, and the restricted fraction that its spread is scaled by.
SIZES, REPLICATES, TYPICAL = (4, 6, 8, 10, 12, 16, 20, 31), 50, 0.15


def bootstrap_scores(sample: DataFrame, b: np.ndarray, grids: dict[int, list[float]], penalties: dict[int, float], sigma: float, replicates: int = REPLICATES) -> DataFrame:
    """n_iso, cv (per cent), bias, score of each isotropic grid over a sample (voxel_id, signal).

    Each voxel's restricted fraction is fitted to its signal, and to noisy replicates of it (Rician, seeded by voxel and replicate, the
    same for all grids); cv is the mean spread of the replicates over their mean, bias the mean distance of their mean from the
    first.  The score adds bias squared and the squared spread at a fraction of ``TYPICAL``.
    """
    atoms = {n: np.exp(-b[:, None] * np.array(grid)[None, :]) for n, grid in grids.items()}

    def restricted(n: int, signals: np.ndarray) -> np.ndarray:
        a = atoms[n]
        w = nnls(a.T @ a + penalties[n] * np.eye(a.shape[1]), signals @ a)
        total = w.sum(1)
        own = w[:, np.array(grids[n]) <= S.RES_MAX].sum(1)
        return np.where(total > 1e-10, own / np.maximum(total, 1e-10), np.nan)

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        out = np.full((2, part.num_rows), np.nan)
        for i, (voxel, n, s) in enumerate(zip(part.column("voxel_id").to_pylist(), part.column("n_iso").to_pylist(), matrix_of(part, "signal", len(b)))):
            noise = np.stack([np.random.default_rng([voxel or 0, r]).normal(0, sigma, (2, len(b))) for r in range(replicates)])
            found = restricted(n, np.sqrt((s + noise[:, 0]) ** 2 + noise[:, 1] ** 2))
            found = found[~np.isnan(found)]
            if len(found):
                out[:, i] = 100 * found.std() / (found.mean() + 1e-10), abs(found.mean() - np.nan_to_num(restricted(n, s[None]))[0])
        return [pa.array(v, mask=np.isnan(v)) for v in out]

    rows = sample.select("voxel_id", "signal", F.explode(F.array(*map(F.lit, grids))).alias("n_iso"))
    rows = rows.repartition(sample.sparkSession.sparkContext.defaultParallelism, "n_iso", "voxel_id")
    rows = fit_rows(rows, solve, [("cv", T.DoubleType()), ("bias", T.DoubleType())])
    out = rows.groupBy("n_iso").agg(F.avg("cv").alias("cv"), F.avg("bias").alias("bias"))
    return out.withColumn("score", F.col("bias") ** 2 + (F.col("cv") / 100 * TYPICAL) ** 2)


def bootstrap_choice(scores: DataFrame, default: int = 10) -> DataFrame:
    """One row: best (least score, the smaller of equals), flat (the scores hardly differ), homogeneous (no grid has a bias), and
    n_iso, which is the default in either case."""
    one = scores.agg(F.min_by("n_iso", F.struct("score", "n_iso")).alias("best"), F.min("score").alias("low"), F.max("score").alias("high"), F.max("bias").alias("bias"))
    flat, alike = (F.col("high") - F.col("low")) / (F.col("low") + 1e-15) < 0.5, F.col("bias") < 0.01
    one = one.select("best", flat.alias("flat"), alike.alias("homogeneous"))
    return one.withColumn("n_iso", F.when(F.col("best").isNull() | F.col("flat") | F.col("homogeneous"), F.lit(default)).otherwise(F.col("best")))


def _freedom(gram: np.ndarray, plain: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Degrees of freedom of each row of non-negative weights: the trace of the penalised fit on its free columns."""
    free = weights > 0
    both = free[:, :, None] & free[:, None, :]
    return np.trace(np.linalg.solve(np.where(both, gram, np.eye(len(gram))), np.where(both, plain, 0.0)), axis1=1, axis2=2)


def sure_risks(sample: DataFrame, b: np.ndarray, candidates: list[tuple[float, list[float], float]], sigma: float, probes: int | None = 15) -> DataFrame:
    """value, risk of each candidate (value, isotropic grid, penalty): Stein's unbiased estimate of the prediction risk of the non-negative
    fit, mean over a sample (voxel_id, signal).  The divergence is taken from so many random signs, seeded by voxel, the same for
    all candidates, or with ``probes`` None from the fit's free columns, of which it is the degrees of freedom."""
    atoms = [np.exp(-b[:, None] * np.array(grid)[None, :]) for _, grid, _ in candidates]
    plain = [a.T @ a for a in atoms]
    grams = [g + penalty * np.eye(len(g)) for g, (_, _, penalty) in zip(plain, candidates)]
    step = 0.01 * sigma if sigma > 0 else 1e-6

    def exact(part: pa.RecordBatch) -> list[pa.Array]:
        which, s = part.column("k").to_numpy(), matrix_of(part, "signal", len(b))
        out = np.empty(len(s))
        for k in np.unique(which):
            own = np.flatnonzero(which == k)
            w = nnls(grams[k], s[own] @ atoms[k])
            out[own] = ((s[own] - w @ atoms[k].T) ** 2).sum(1) + sigma**2 * (2 * _freedom(grams[k], plain[k], w) - len(b))
        return [pa.array(out)]

    def solve(part: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for voxel, k, s in zip(part.column("voxel_id").to_pylist(), part.column("k").to_pylist(), matrix_of(part, "signal", len(b))):
            signs = np.random.default_rng([voxel or 0, 42]).choice([-1.0, 1.0], (probes, len(b)))
            made = nnls(grams[k], np.vstack([s, s + step * signs]) @ atoms[k]) @ atoms[k].T
            divergence = (signs * (made[1:] - made[0])).sum() / step / probes
            out.append(-len(b) * sigma**2 + ((s - made[0]) ** 2).sum() + 2 * sigma**2 * divergence)
        return [pa.array(out, pa.float64())]

    rows = sample.select("voxel_id", "signal", F.posexplode(F.array(*[F.lit(float(v)) for v, _, _ in candidates])).alias("k", "value"))
    rows = rows.repartition(sample.sparkSession.sparkContext.defaultParallelism, "k", "voxel_id")
    return fit_rows(rows, exact if probes is None else solve, [("risk", T.DoubleType())]).groupBy("value").agg(F.avg("risk").alias("risk"))


def sure_check(risks: DataFrame, chosen: float, within: float = 0.15) -> DataFrame:
    """One row: the risk of the chosen value, the least one and its value, and whether the chosen is within a share of it."""
    one = risks.agg(F.min_by("value", F.struct("risk", "value")).alias("best"), F.min("risk").alias("least"), F.min(F.when(F.col("value") == chosen, F.col("risk"))).alias("risk"))
    return one.select(F.lit(float(chosen)).alias("chosen"), "risk", "best", "least", (F.col("risk") <= F.col("least") * (1 + within)).alias("agrees"))


def _of(value: float | str) -> Column:
    """A number, or a column by its name."""
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def _neighbours(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """A curve with the value and residual that follow each."""
    order = Window.partitionBy(*by).orderBy("lambda")
    return curve.withColumn("next", F.lead("residual").over(order)).withColumn("next_lambda", F.lead("lambda").over(order))


def discrepancy(curve: DataFrame, limit: float | str, floor: float | str, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key ``by``: the value at which the rising residual meets the limit, by its logarithm between the two
    neighbours; the least value (not under the floor) if all exceed the limit, the greatest if none does."""
    limit, floor = _of(limit), _of(floor)
    rows = _neighbours(curve, by)
    share = (limit - F.col("residual")) / (F.col("next") - F.col("residual"))
    meets = (F.col("residual") <= limit) & (F.col("next") > limit)
    at = F.exp(F.log("lambda") + share * (F.log("next_lambda") - F.log("lambda")))
    one = rows.groupBy(*by).agg(F.min(F.when(meets, at)).alias("at"), F.min("residual").alias("least"), F.min("lambda").alias("low"), F.max("lambda").alias("high"), F.max(limit).alias("_limit"), F.max(floor).alias("_floor"))
    value = F.when(F.col("at").isNotNull(), F.greatest("at", "_floor")).when(F.col("least") > F.col("_limit"), F.greatest("low", "_floor")).otherwise(F.col("high"))
    return one.select(*by, value.alias("lambda"))


def discrepancy_search(sample: DataFrame, dictionary: Dictionary, iso: float, limit: float, tolerance: float = 1e-3, passes: int = 4) -> float:
    """The fiber penalty at which a sample's mean residual meets the limit, to a relative tolerance of the residual.

    The curve over ten decades gives the two neighbours of the crossing, and each further pass 8 values between these; only the
    curve's few numbers come to the driver.  Edges are those of ``discrepancy``.
    """
    floor = fiber_floor(dictionary, iso)
    curve = residual_curve(sample, dictionary, iso, list(np.logspace(-6, 4, 16)))
    points = sorted((r["lambda"], r["residual"]) for r in curve.collect())  # a row a value
    if not points:
        return floor
    for _ in range(passes):
        cross = next((i for i in range(len(points) - 1) if points[i][1] <= limit < points[i + 1][1]), None)
        if cross is None:
            break
        (a, low), (b, high) = points[cross : cross + 2]
        if high - low <= tolerance * limit:
            break
        inner = residual_curve(sample, dictionary, iso, list(np.geomspace(a, b, 10)[1:-1]))
        points = sorted([(a, low), (b, high), *((r["lambda"], r["residual"]) for r in inner.collect())])
    spark = sample.sparkSession
    return discrepancy(spark.createDataFrame(points, "lambda double, residual double"), limit, floor).first()["lambda"]


def fiber_floor(dictionary: Dictionary, iso: float) -> float:
    """Least fiber penalty that a discrepancy may give."""
    return max(0.1 * iso, _fiber_scale(dictionary))


def _fiber_scale(dictionary: Dictionary) -> float:
    return 0.075 * float(np.linalg.eigvalsh(dictionary.matrix.T @ dictionary.matrix)[-1]) / dictionary.fibers


def concentration_gate(rows: DataFrame, percentile: float = 0.9, at_least: int = 30, default: float = S.CONCENTRATION_GATE) -> DataFrame:
    """One row: the percentile of ``concentration`` over fiber-free rows whose ff is over the threshold."""
    use = F.when(F.col("ff") > S.FIBER_THRESHOLD, F.col("concentration"))
    found = percentiles(rows, {"found": (use, percentile)}).crossJoin(F.broadcast(rows.agg(F.count(use).alias("rows"))))  # one row each
    return found.select(F.when(F.col("rows") >= at_least, F.col("found")).otherwise(F.lit(default)).alias("gate"), "rows")


def restricted_response(labelled: DataFrame) -> DataFrame:
    """ff_level, rf_level, ff_est, rf_est: mean estimates of a labelled table in each true cell."""
    return labelled.groupBy("ff_level", "rf_level").agg(F.avg("ff_est").alias("ff_est"), F.avg("rf_est").alias("rf_est"))


def _inverse():  # noqa: ANN202
    """Restricted fraction at which a response row (rf_level, rf_est, rising) takes the observed value."""

    def of(row, seen):  # noqa: ANN001, ANN202
        n = F.size(row)
        below = F.size(F.filter(row, lambda p: p["est"] <= seen))
        a, b = F.get(row, below - 1), F.get(row, below)
        inside = a["level"] + (seen - a["est"]) / (b["est"] - a["est"]) * (b["level"] - a["level"])
        return F.when(below == 0, F.get(row, F.lit(0))["level"]).when(below == n, F.get(row, n - 1)["level"]).otherwise(inside)

    return of


def corrected_restricted(rows: DataFrame, response: DataFrame) -> DataFrame:
    """``rows(ff, rf, hf)`` with rf_corrected, hf_corrected by inverting a response table.

    Each response row of one true fiber level is made to rise by a running maximum and inverted at the
    observed rf (flat stretches give their last level); the results of the two rows around the observed ff
    are interpolated, beyond the ends the end row is taken.  What rf gains, hf loses, both within 0 and 1.
    """
    up = Window.partitionBy("ff_level").orderBy("rf_level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rising = response.withColumn("rf_est", F.max("rf_est").over(up))
    # A table of true cells (4 x 9): its rows as one array.
    table = rising.groupBy("ff_level").agg(F.avg("ff_est").alias("ff"), F.array_sort(F.collect_list(F.struct(F.col("rf_level").alias("level"), F.col("rf_est").alias("est")))).alias("row"))
    table = table.agg(F.array_sort(F.collect_list(F.struct("ff", "row"))).alias("_t"))
    out = rows.crossJoin(F.broadcast(table))  # one row is broadcast
    inverse = _inverse()
    below = F.size(F.filter("_t", lambda t: t["ff"] <= F.col("ff")))
    lo = F.get("_t", F.greatest(below - 1, F.lit(0)))
    hi = F.get("_t", F.least(below, F.size("_t") - 1))
    out = out.withColumns({"_lo": lo, "_hi": hi})
    a, b = inverse(F.col("_lo.row"), F.col("rf")), inverse(F.col("_hi.row"), F.col("rf"))
    wide = F.col("_hi.ff") - F.col("_lo.ff")
    share = F.when((wide > 0) & (F.col("ff") > F.col("_lo.ff")), (F.col("ff") - F.col("_lo.ff")) / wide).otherwise(F.lit(0.0))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    out = out.withColumn("rf_corrected", F.when(F.size("_t") > 0, clip(a + share * (b - a))).otherwise(F.col("rf")))
    return out.withColumn("hf_corrected", clip(F.col("hf") - (F.col("rf_corrected") - F.col("rf")))).drop("_t", "_lo", "_hi")
