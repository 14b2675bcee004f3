import numpy as np
import pyarrow as pa
import pytest

from voxelmill import schema as S
from voxelmill.operators import calibration, signals, solvers
from voxelmill.operators.quantiles import beside
from voxelmill.plans import fitting, subjects
from voxelmill.sources import fixtures as X

SF = "/root/testdata/sf0.001"


class At_once:
    """Rows whose Arrow pass runs here, so that a test can count what it calls."""

    def __init__(self, batch):
        self.batch, self.columns, self.schema = batch, batch.schema.names, type("Empty", (), {"fields": []})

    def mapInArrow(self, task, schema):  # noqa: N802, ANN001, ANN201
        return pa.Table.from_batches(list(task(iter([self.batch])))).to_pandas()


@pytest.fixture(scope="module")
def voxels(spark):
    rows = signals.normalised(signals.in_mask(X.signals(spark, SF)), X.PROTOCOL).select("voxel_id", "signal", "ux", "uy", "uz")
    return At_once(pa.RecordBatch.from_pandas(rows.orderBy("voxel_id").toPandas()))


@pytest.fixture
def counted(monkeypatch):
    plain, seen = solvers.nnls, []
    monkeypatch.setattr(solvers, "nnls", lambda gram, rhs, *start: (seen.append(len(rhs)), plain(gram, rhs, *start))[1])
    return seen


def test_single_fiber_solves_few_pairs_and_finds_the_best_of_all(voxels, counted):
    grid = S.iso_grid(10)
    got = solvers.single_fiber(voxels, X.PROTOCOL, grid)
    assert 0 < sum(counted) < 8 * len(got)  # of some 170 pairs a voxel
    b, g, iso = np.array(X.PROTOCOL.b), np.array(X.PROTOCOL.g), np.exp(-np.array(X.PROTOCOL.b)[:, None] * np.array(grid))
    for r in got.head(12).itertuples():
        c2, residuals = (g @ np.array([r.ux, r.uy, r.uz])) ** 2, []
        for ad in np.linspace(*solvers.FINE_AD):
            for rd in np.linspace(*solvers.FINE_RD):
                if ad >= rd * solvers.FINE_RATIO:
                    a = np.column_stack([np.exp(-b * (rd + (ad - rd) * c2)), iso])
                    w = solvers.nnls(a.T @ a, (r.signal @ a)[None])[0]
                    residuals.append((((r.signal - a @ w) ** 2).sum(), ad, rd))
        least, ad, rd = min(residuals)
        assert r.fit_residual <= least + 1e-12
        assert abs(r.fit_ad - ad) <= 1.01 * (2.6e-3 - 0.6e-3) / 13 and abs(r.fit_rd - rd) <= 1.01 * (1.1e-3 - 0.15e-3) / 11


def test_single_fiber_within_what_the_isotropic_part_holds(counted):
    """With no more measurements than the isotropic columns span, no pair is left out by its bound."""
    protocol = X.Protocol(X.PROTOCOL.b[3:5], X.PROTOCOL.g[3:5])
    batch = pa.RecordBatch.from_pydict({"voxel_id": [1], "signal": [[1.0, 0.4]], "ux": [1.0], "uy": [0.0], "uz": [0.0]})
    got = solvers.single_fiber(At_once(batch), protocol, S.iso_grid(10))
    assert got["fit_residual"][0] < 1e-12 and sum(counted) > 100


@pytest.mark.parametrize("fiber, iso", [(0.65, 0.005), (1e-3, 1e-5), (0.0, 0.0)])
def test_ridge_fits_are_those_of_the_active_set(voxels, fiber, iso):
    d = fitting.Config().dictionary(X.PROTOCOL)
    plain, h = d.matrix.T @ d.matrix, solvers.matrix_of(voxels.batch, "signal", 64) @ d.matrix
    want = solvers.nnls(plain + np.diag(d.penalty(fiber, iso)), h)
    assert np.allclose(solvers.ridge_nnls(plain, d.penalty(fiber, iso), h) @ d.matrix.T, want @ d.matrix.T, atol=1e-8)
    each = np.repeat(d.penalty(fiber, iso)[None], len(h), 0)
    for start in (None, want > 0, np.zeros(h.shape, bool), np.ones(h.shape, bool)):
        got = solvers.ridge_nnls(plain, each, h, start)
        assert (got >= 0).all() and np.allclose(got @ d.matrix.T, want @ d.matrix.T, atol=1e-8)
        if fiber:
            assert np.allclose(got, want, atol=1e-7)
    assert solvers.ridge_nnls(plain, each[:0], h[:0]).shape == (0, 142)


def test_spectra_exchange_many_variables_at_once(voxels, counted):
    d = fitting.Config().dictionary(X.PROTOCOL)
    got = solvers.spectra(voxels, d, *fitting.Config().penalties(d))
    assert len(got) > 100 and sum(counted) < 0.1 * len(got)  # one by one for all of them before


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_signals_are_not_broadcast_to_meet_a_table_by_key(spark):
    rows = signals.eligible(X.signals(spark, SF), X.PROTOCOL, ["scenario"])
    assert "BuildLeft" not in plan(rows) and "BuildRight" in plan(rows)
    assert "BuildLeft" not in plan(signals.default_mask(X.signals(spark, SF), ["scenario"]))
    few, many = spark.range(3).selectExpr("id as k", "id * 2 as v"), spark.range(10**7).selectExpr("id % 9 as k", "id as w")
    table = many.groupBy("k").agg({"w": "max"}).withColumnRenamed("max(w)", "x")
    joined = beside(few.unionByName(spark.createDataFrame([(None, 5), (77, 6)], "k long, v long")), table.unionByName(spark.createDataFrame([(None, 8)], "k long, x long")), ["k"])
    assert "BuildLeft" not in plan(joined.filter("x > v"))
    got = {(r.k, r.v, r.x) for r in joined.collect()}
    assert {(k, v) for k, v, _ in got} == {(0, 0), (1, 2), (2, 4), (None, 5), (77, 6)} and {x for k, _, x in got if k in (None, 77)} == {8, None}
    assert all(x == max(w for w in range(10**7 - 9, 10**7) if w % 9 == k) for k, _, x in got if k in (0, 1, 2))


def test_scores_merge_tables_of_voxels(spark):
    rows, protocols = X.subjects(spark, SF)
    names = ["ff", "rf", "hf", "wf", "nrf", "mean_iso_adc", *[f"{n}{k}" for k in (1, 2) for n in ("f", "ad", "rd")], *[f"u{k}{c}" for k in (1, 2) for c in "xyz"]]
    fitted = rows.selectExpr("subject_id", "voxel_id", *[f"0.1D as {n}" for n in names])
    assert plan(subjects.scored(fitted, rows, protocols)).count("SortMergeJoin") == 2


def test_calibration_curves_are_those_of_the_active_set(spark, voxels):
    d = fitting.Config(directions=8).dictionary(X.PROTOCOL)
    rows = spark.createDataFrame([(int(i), s.tolist()) for i, s in zip(voxels.batch.column("voxel_id").to_pylist(), solvers.matrix_of(voxels.batch, "signal", 64)[:20])], "voxel_id long, signal array<double>")
    curve = {r["lambda"]: r["residual"] for r in calibration.residual_curve(rows, d, 0.005, [1e-5, 0.1, 10.0]).collect()}
    h = solvers.matrix_of(voxels.batch, "signal", 64)[:20]
    for value, residual in curve.items():
        off = h - solvers.nnls(d.matrix.T @ d.matrix + np.diag(d.penalty(value, 0.005)), h @ d.matrix) @ d.matrix.T
        assert residual == pytest.approx((off * off).sum(1).mean(), rel=1e-9)
