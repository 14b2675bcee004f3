import numpy as np
import pytest

from voxelmill.operators import signals, solvers
from voxelmill.plans import fitting
from voxelmill.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_signals_are_made_once_and_not_in_the_scan(spark):
    """A filter on a signal stays above the pass that makes it; in the scan's own few tasks it made every signal again, serially."""
    got = plan(signals.normalised(X.labelled_signals(spark, SF), X.PROTOCOL))
    made, read = got.index("MapInArrow"), got.index("Relation")
    assert got.index("Filter") < made < read and "EXP" not in got and "transform" not in got[made:]


def test_labelled_signals_follow_their_formulas(spark):
    b, g, u = np.array(X.PROTOCOL.b), np.array(X.PROTOCOL.g), np.array(X.DIRECTIONS)
    rows = X.labelled_signals(spark, SF).collect()
    assert {r["voxel_id"] for r in rows} == {r["voxel_id"] for r in X.labelled(spark, SF).collect()}
    for r in rows[:40]:
        k, ff, rf = r["voxel_id"], r["ff_level"], r["rf_level"]
        part = lambda factor, of, lo, hi: lo + (hi - lo) * (factor * k % of) / (of - 1)  # noqa: E731, B023
        f = 1.0 if k // 36 % 2 == 0 else part(11, 17, 0.0, 1.0)
        ad, rd = part(29, 83, 1.2e-3, 2.0e-3), part(43, 47, 0.1e-3, 0.8e-3)
        fiber = [np.exp(-b * (rd + (ad - rd) * (g @ u[(13 * k + n) % 20]) ** 2)) for n in (0, 10)]
        s = part(89, 31, 0.4, 0.95)
        rest = s * np.exp(-b * part(53, 101, 0.4e-3, 2.5e-3)) + (1 - s) * np.exp(-b * part(71, 41, 3.0e-3, 5.0e-3))
        want = ff * (f * fiber[0] + (1 - f) * fiber[1]) + rf * np.exp(-b * part(37, 61, 0.1e-3, 0.28e-3)) + (1 - ff - rf) * rest
        noise = 0.02 * ((7919 * k + 104729 * np.arange(len(b))) % 1000 / 999 - 0.5)
        assert np.allclose(r["signal"], want + noise, rtol=0, atol=1e-14)


@pytest.mark.parametrize("made", ["signals", "labelled_signals"])
def test_small_penalties_of_the_calibration_settle_by_exchanges(spark, monkeypatch, made):
    """With an isotropic penalty of 1e-5, as ``voxel_fit`` finds it, few rows are left to be solved one variable at a time."""
    rows = signals.normalised(getattr(X, made)(spark, SF), X.PROTOCOL).select("signal").toPandas()
    d = fitting.Config().dictionary(X.PROTOCOL)
    plain, penalty, h = d.matrix.T @ d.matrix, d.penalty(0.0464, 1e-5), np.stack(rows["signal"]) @ d.matrix
    nnls, late = solvers.nnls, []
    monkeypatch.setattr(solvers, "nnls", lambda gram, rhs, *start: (late.append(len(rhs)), nnls(gram, rhs, *start))[1])
    got = solvers.ridge_nnls(plain, penalty, h)
    assert len(h) > 100 and sum(late) < 0.05 * len(h)
    assert np.allclose(got @ d.matrix.T, nnls(plain + np.diag(penalty), h) @ d.matrix.T, atol=1e-8)
    slope = got @ plain + got * penalty - h
    assert (got >= 0).all() and (slope >= -1e-7).all() and np.abs(slope[got > 0]).max() < 1e-7


def test_dominant_directions_of_many_rows_are_those_of_each():
    random, d = np.random.default_rng(5), fitting.Config().dictionary(X.PROTOCOL).directions
    mass = np.where(random.random((300, len(d.u))) < 0.3, np.round(random.random((300, len(d.u))) ** 3, 1), 0.0)
    mass[0] = 0.0
    gate = random.random(300) * 0.3
    for most, select in ((1, ()), (3, ()), (3, (0.0, 0.0, 20.0)), (2, (0.1, 0.9, 60.0))):
        dirs, there = d.dominant_of(mass, gate, most, *select)
        want = [d.dominant(m, g, most, *select) for m, g in zip(mass, gate)]
        assert [x[t].tolist() for x, t in zip(dirs, there)] == want
        assert any(want) and not all(want)


def test_rows_of_few_splits_are_dealt_to_all_cores(spark):
    """As many splits as cores may hold all rows in one of them."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, numPartitions=cores).filter("id >= 0")
    assert X.spread(rows).rdd.getNumPartitions() == 2 * cores
    many = spark.range(0, 1000, numPartitions=4 * cores)
    assert X.spread(many) is many
