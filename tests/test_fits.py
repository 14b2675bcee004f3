"""The fits: optimality of the solver, recovery of what signals were made of, empty tables, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import schema as S
from voxelmill.operators import calibration, quantiles, signals, solvers
from voxelmill.plans import fitting
from voxelmill.sources import fixtures as X
from voxelmill.sources.maps import read_maps, write_maps
from voxelmill.sources.protocols import read_protocol
from voxelmill.sources.signals import SIGNALS, read_signals, write_signals
from voxelmill.streaming.fits import fit_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("penalty", [1e-6, 1e-2, 1.0])
def test_solver_meets_the_optimality_conditions(penalty):
    d = fitting.Config().dictionary(X.PROTOCOL)
    rng = np.random.default_rng(1)
    y = (rng.random((40, d.matrix.shape[1])) ** 20) @ d.matrix.T
    gram, h = d.matrix.T @ d.matrix + np.diag(d.penalty(penalty, 0.005)), y @ d.matrix
    x = solvers.nnls(gram, h)
    slope = x @ gram - h
    assert x.min() >= 0
    assert np.abs(np.minimum(x, slope)).max() < 1e-6
    assert np.allclose(x, solvers.nnls(np.repeat(gram[None], len(h), 0), h), atol=1e-8)


def test_solver_small_cases():
    assert solvers.nnls(np.eye(2), np.array([[1.0, -1.0], [0.0, 0.0]])).tolist() == [[pytest.approx(1.0), 0.0], [0.0, 0.0]]
    assert solvers.nnls(np.eye(2), np.zeros((0, 2))).shape == (0, 2)


def test_crossing_fibers_recover(spark):
    got = fitting.crossing_fit(spark, SF).toPandas()
    assert (got["cost"] <= got["cost0"] + 1e-15).all()
    for k in (1, 2):
        assert (got[f"ad{k}"] - got[f"ad_{k}_true"]).abs().median() < 2e-5
        assert (got[f"rd{k}"] - got[f"rd_{k}_true"]).abs().median() < 2e-5


def test_single_fiber_and_anchored_fractions_recover(spark):
    got = fitting.single_fiber_fit(spark, SF).toPandas()
    assert (got["ff"] - got["ff_true"]).abs().median() < 0.05
    assert (got["fit_ad"] - got["ad_true"]).abs().median() < 1e-4
    anchored = fitting.anchored_fractions(spark, SF).toPandas()
    assert (anchored["ff"] - anchored["ff_true"]).abs().median() < 0.05
    assert (anchored[["ff", "rf", "hf", "wf"]].sum(axis=1) - 1).abs().max() < 1e-9


def test_whole_fit(spark):
    rows = X.signals(spark, SF).filter("voxel_id < 60")
    got = fitting.fit(rows, X.PROTOCOL).toPandas()
    assert len(got) == rows.filter("in_mask and voxel_id % 97 <> 0").count()
    assert (got[["ff", "rf", "hf", "wf"]].sum(axis=1) - 1).abs().max() < 1e-6
    assert set(got["n_fibers"]) <= {0, 1, 2}
    assert got.loc[got["n_fibers"] == 1, "ad1"].notna().all() and got.loc[got["n_fibers"] < 2, "ad2"].isna().all()
    assert fitting.fit(rows.filter("false"), X.PROTOCOL).count() == 0


def test_fit_takes_calibrations(spark):
    rows = X.signals(spark, SF).filter("voxel_id < 30")
    noise = spark.createDataFrame(fitting.noise_of(X.signals(spark, SF), X.PROTOCOL).collect())
    penalties = fitting.calibrated(rows, X.PROTOCOL, noise=noise)
    step = {r["step"]: r["lambda"] for r in penalties.collect()}
    gate, response = fitting.references(X.labelled_signals(spark, SF), X.PROTOCOL, penalties=penalties)
    assert 0 < gate.first()["gate"] <= 1 and response.filter("rf_est between 0 and 1").count() == response.count() > 30
    same = fitting.Config(fiber_penalty=step["fiber"], iso_penalty=step["iso"], gate=gate.first()["gate"])
    raw = fitting.fit(rows, X.PROTOCOL, same, noise)
    want = calibration.corrected_restricted(raw, response).toPandas().set_index("voxel_id").sort_index()
    got = fitting.fit(rows, X.PROTOCOL, noise=noise, penalties=penalties, gate=gate, response=response).toPandas().set_index("voxel_id").sort_index()
    assert np.allclose(got["ff"], want["ff"]) and np.allclose(got["rf"], want["rf_corrected"]) and np.allclose(got["hf"], want["hf_corrected"])
    assert (got["rf"] - want["rf"]).abs().max() > 1e-3


def test_fit_follows_the_compartments_of_the_protocol(spark):
    keep = [i for i, b in enumerate(X.PROTOCOL.b) if b <= 1000]
    protocol = fitting.Protocol(tuple(X.PROTOCOL.b[i] for i in keep), tuple(X.PROTOCOL.g[i] for i in keep))
    got = fitting.fit(X.signals(spark, SF, protocol).filter("voxel_id < 20"), protocol).toPandas()
    assert len(got) and got[["hf", "wf"]].isna().all().all()
    assert (got[["ff", "rf", "nrf"]].sum(axis=1) - 1).abs().max() < 1e-6


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = X.signals(spark, SF).filter("voxel_id < 12").select("voxel_id", "in_mask", "signal")
    rows.write.parquet(str(tmp_path / "in"))
    noise = spark.createDataFrame(fitting.noise_of(X.signals(spark, SF), X.PROTOCOL).collect())
    stream = fit_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), X.PROTOCOL, noise)
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("voxel_id").select("voxel_id", F.round("ff", 9)).collect()
    assert got == fitting.fit(rows, X.PROTOCOL, noise=noise).orderBy("voxel_id").select("voxel_id", F.round("ff", 9)).collect()


def test_penalty_curve_against_single_voxels(spark):
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id < 20")
    d = fitting.Config().dictionary(X.PROTOCOL)
    curve = calibration.penalty_curve(spark, calibration.moments(rows, 64), d.iso, np.zeros(len(d.grid)), np.ones(len(d.grid)), np.array([0.01, 1.0])).orderBy("lambda").toPandas()
    y = np.array([r["signal"] for r in rows.collect()])
    for value, rss in zip(curve["lambda"], curve["rss"]):
        w = np.linalg.solve(d.iso.T @ d.iso + value * np.eye(len(d.grid)), d.iso.T @ y.T)
        assert ((y.T - d.iso @ w) ** 2).sum(0).mean() == pytest.approx(rss, rel=1e-6)


def test_corner_and_cap(spark):
    curve = spark.createDataFrame([(float(k), float(np.exp(2 * x)), float(np.exp(2 * y))) for k, (x, y) in enumerate([(0, 4), (0, 2), (0, 0), (2, 0), (4, 0)])], "lambda double, rss double, eta2 double")
    assert calibration.corner(curve).first()["lambda"] == 2.0
    residual = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 1.0)], "lambda double, residual double")
    assert calibration.cap(residual, 2.0).first()[0] == 1.0
    assert calibration.cap(residual, 0.5).first()[0] == 1.0
    assert calibration.discrepancy(residual, 2.0, 0.0).first()[0] == pytest.approx(2**0.5)


def test_fewest_and_crosscheck(spark):
    scores = lambda *s: spark.createDataFrame([(n, float(x)) for n, x in s], "n_iso int, score double")
    got = calibration.fewest(scores((4, 2.0), (6, 1.01), (8, 1.0), (10, 1.0))).first()
    assert (got["best"], got["n_iso"], got["span"]) == (8, 6, 1.0)
    flat = calibration.fewest(scores((4, 1.004), (6, 1.0))).first()
    assert (flat["best"], flat["n_iso"]) == (6, None)
    assert calibration.fewest(scores()).first()["n_iso"] is None
    assert calibration.near_sizes(10) == [4, 6, 8, 10, 12, 14, 16] and calibration.near_sizes(5) == [4, 5, 6, 8, 10, 11]
    assert calibration.crosscheck(scores((4, 2.0), (8, 1.0)), 10).first()["agrees"] is True
    assert calibration.crosscheck(scores((4, 2.0), (8, 1.0)), 12).first()["agrees"] is False


def test_grid_scores_are_the_least_of_each_curve(spark):
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id < 20")
    y, b = np.array([r["signal"] for r in rows.collect()]), np.array(X.PROTOCOL.b)
    for row in calibration.grid_scores(spark, calibration.moments(rows, 64), b, {4: [1e-4, 1e-3, 3e-3], 6: [1e-4, 5e-4, 1e-3, 3e-3]}).collect():
        a = np.exp(-b[:, None] * np.array([1e-4, 1e-3, 3e-3] if row["n_iso"] == 4 else [1e-4, 5e-4, 1e-3, 3e-3])[None, :])
        best = np.inf
        for v in np.logspace(-5, 1, 40):
            hat = a @ np.linalg.solve(a.T @ a + v * np.eye(a.shape[1]), a.T)
            best = min(best, ((y.T - hat @ y.T) ** 2).sum(0).mean() / 64 / (1 - np.trace(hat) / 64) ** 2)
        assert row["score"] == pytest.approx(best, rel=1e-6)


def test_two_pass(spark):
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id < 20").select("signal")
    d = fitting.Config(directions=8).dictionary(X.PROTOCOL)
    got = {r["step"]: r["lambda"] for r in calibration.two_pass(rows, d, 0.02).collect()}
    assert got["iso"] == min(got["iso_second"], got["iso_cap"])
    assert got["fiber_first"] >= calibration.fiber_floor(d, got["iso_first"]) and got["fiber"] >= calibration.fiber_floor(d, got["iso"])
    y = np.array([r["signal"] for r in rows.collect()])
    w = solvers.nnls(d.matrix.T @ d.matrix + np.diag(d.penalty(1.0, 0.01)), y @ d.matrix)
    left = np.array([r["signal"] for r in calibration.without_fibers(rows, d, 1.0, 0.01).collect()])
    assert np.allclose(left, y - w[:, : d.fibers] @ d.matrix[:, : d.fibers].T, atol=1e-7)
    assert calibration.two_pass(rows.filter("false"), d, 0.0).count() == 6
    with pytest.raises(ValueError):
        calibration.two_pass(rows, d, 0.02, "other")


def test_text_protocol(spark, tmp_path):
    (tmp_path / "b").write_text("0 1000\n2000  1000\n")
    (tmp_path / "g").write_text("0 2 0 0\n0 0 3 0\n0 0 0 1\n")
    p = read_protocol(spark, str(tmp_path / "b"), str(tmp_path / "g"))
    assert p.b == (0.0, 1000.0, 2000.0, 1000.0)
    assert p.g == ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))


def test_maps(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 0.1, None, 2.0), (2, 0.6, 0.2, 0.3, 2.0)], "voxel_id long, hindered_fraction double, nonrestricted_fraction double, dir1_x double, ad_linear double")
    assert write_maps(rows, str(tmp_path / "m")) == ["hindered_fraction", "dir1_x"]
    assert read_maps(spark, str(tmp_path / "m")).count() == 3


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_percentiles(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(7)
    for values in ([], [3.0], [2.0, 1.0], rng.normal(size=57), rng.normal(size=3000), rng.integers(0, 5, 1000).astype(float), np.r_[np.zeros(500), rng.normal(size=500)]):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            got = quantiles.percentiles(rows, {"q": (F.col("x"), p)}).first()["q"]
            assert got is None if not len(values) else got == pytest.approx(float(np.percentile(values, 100 * p)), abs=1e-12)


def test_signals_of_another_length_or_with_nulls_end_the_job(spark):
    d = fitting.Config(directions=8).dictionary(X.PROTOCOL)
    for signal in ([1.0] * 60, [1.0] * 63 + [None]):
        rows = spark.createDataFrame([(7, [1.0] * 64), (8, signal)], "voxel_id long, signal array<double>").coalesce(1)
        with pytest.raises(Exception, match="voxel 8"):
            solvers.spectra(rows, d, 1.0, 0.005).collect()


def test_cones():
    u = S.hemisphere(30)
    grid = S.spacing(u)
    dots = np.array(u) @ np.array(u).T - 3 * np.eye(30)
    assert grid == pytest.approx(np.arccos(dots.max(1)).mean())
    schedule = S.cone_schedule(grid, np.radians(1))
    assert S.cone_schedule(0.01, 0.02) == [] and schedule[0][0] == grid and all(n >= 4 for _, n in schedule)
    assert schedule[0][0] / schedule[1][0] == pytest.approx(schedule[1][0] / np.radians(1))
    for axis in ((0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.6, 0.0, 0.8)):
        around = solvers.cone(np.array([axis]), 0.3, 25)[0]
        angle = np.arccos(around @ np.array(axis))
        assert np.allclose(np.linalg.norm(around, axis=1), 1) and angle.max() <= 0.3 and angle.max() > 0.25


def test_refined_directions(spark):
    got = fitting.refined_directions(spark, SF).toPandas()
    assert (got["ref_error"] <= got["ref_error0"] + 1e-15).all()
    assert got["cos_refined"].mean() > got["cos_grid"].mean()
    assert ((got["ref_ad"] - got["ad_true"]).abs() / got["ad_true"]).median() < 0.03
    rows = spark.createDataFrame([(1, [1.0] * 64, None, None, None, 0.5, 0.2, 0.2, 0.1)], "voxel_id long, signal array<double>, ux double, uy double, uz double, ff double, rf double, hf double, wf double")
    assert solvers.refined_directions(rows, X.PROTOCOL, [(0.2, 4)]).first()["ref_ad"] is None


def test_refined_directions_by_brute_force(spark):
    """Every candidate of both cones is scored on its own."""
    b, g = np.array(X.PROTOCOL.b), np.array(X.PROTOCOL.g)
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id between 1 and 9").select("voxel_id", "signal", "ux", "uy", "uz", "ff", "rf", "hf", "wf")
    schedule = [(0.3, 7), (0.1, 5)]
    for r in solvers.refined_directions(rows, X.PROTOCOL, schedule).collect():
        s, best = np.array(r["signal"]), (np.inf, None)

        def score(u):
            iso = r["rf"] * np.exp(-b * 0.15e-3) + r["hf"] * np.exp(-b * 1e-3) + r["wf"] * np.exp(-b * 3e-3)
            c2, flat = (g @ u) ** 2, np.maximum(s, 0.01)
            y = np.log(np.clip((flat - iso) / (r["ff"] + 1e-12), 0.01, 1))
            x = -np.linalg.lstsq(np.column_stack([b, b * c2]) * flat[:, None], y * flat, rcond=None)[0]
            rd, ad = np.clip(x[0], S.RD_MIN, S.RD_MAX), np.clip(x[0] + x[1], S.AD_MIN, S.AD_MAX)
            ad, rd = (ad, rd) if ad >= rd else ((ad + rd) / 2,) * 2
            return ((s - iso - r["ff"] * np.exp(-b * (rd + (ad - rd) * c2))) ** 2).sum()

        axis = np.array([r["ux"], r["uy"], r["uz"]])
        best = (score(axis), axis)
        for half, n in schedule:
            for u in solvers.cone(best[1][None], half, n)[0]:
                best = min(best, (score(u), u), key=lambda x: x[0])
        assert r["ref_error"] == pytest.approx(best[0], rel=1e-6)


def test_three_fibers(spark):
    """Three crossing fibers, noise-free; and rows with two of three."""
    b, g, u = np.array(X.PROTOCOL.b), np.array(X.PROTOCOL.g), np.eye(3)
    truth = [(1.7e-3, 0.3e-3), (1.5e-3, 0.4e-3), (1.9e-3, 0.2e-3)]
    parts = [0.2 * np.exp(-b * (rd + (ad - rd) * (g @ u[k]) ** 2)) for k, (ad, rd) in enumerate(truth)]
    iso = 0.4 * np.exp(-b * 1e-3)
    row = lambda i, n: (i, (iso + sum(parts[:n])).tolist(), iso.tolist(), *[0.2] * 3, *[x for k in range(3) for x in (u[k].tolist() if k < n else [None] * 3)])
    schema = "voxel_id long, signal array<double>, iso_signal array<double>, f1 double, f2 double, f3 double, " + ", ".join(f"u{k}{c} double" for k in (1, 2, 3) for c in "xyz")
    got = {r["voxel_id"]: r for r in solvers.crossing_fibers(spark.createDataFrame([row(3, 3), row(2, 2), row(1, 1)], schema), X.PROTOCOL, 3).collect()}
    for n in (2, 3):
        assert all(abs(got[n][f"ad{k + 1}"] - truth[k][0]) < 1e-6 and abs(got[n][f"rd{k + 1}"] - truth[k][1]) < 1e-6 for k in range(n))
    assert got[2]["ad3"] is None and got[1]["ad1"] is None and got[1]["cost"] is None


def test_result_channels(spark, tmp_path):
    rows = X.signals(spark, SF).filter("voxel_id < 40")
    for config in (fitting.Config(fibers=3), fitting.Config(fibers=1, joint=False), fitting.Config(resolve=False, grid="linear", compartments=2)):
        out = fitting.results(fitting.fit(rows, X.PROTOCOL, config), compartments=config.compartments or 3)
        assert out.columns == ["voxel_id", *S.channels(config.compartments or 3)]
        got = out.toPandas()
        n = got["n_fiber_populations"]
        assert n.dropna().between(0, config.fibers).all() and (got["fiber_fraction"] >= 0).all()
        assert got.loc[n == 1, "axial_diffusivity"].notna().all() and got.loc[~(n >= 2), "fiber_fraction_pop2"].isna().all()
        assert got.loc[~(n >= 1), "dir1_x"].isna().all()
    assert len(S.channels()) == 30
    written = write_maps(out, str(tmp_path / "maps"))
    assert "ad_linear" not in written and "nonrestricted_fraction" in written


def brute_nnls(a, y, penalty):
    """The best of all sets of columns."""
    best = (0.0, np.zeros(a.shape[1]))
    for mask in range(1, 1 << a.shape[1]):
        on = [i for i in range(a.shape[1]) if mask >> i & 1]
        m = a[:, on].T @ a[:, on] + penalty * np.eye(len(on))
        w = np.linalg.solve(m, a[:, on].T @ y)
        if (w >= 0).all():
            value = w @ m @ w / 2 - w @ (a[:, on].T @ y)
            if value < best[0]:
                full = np.zeros(a.shape[1])
                full[on] = w
                best = (value, full)
    return best[1]


def test_bootstrap_and_sure_by_brute_force(spark):
    b, sigma = np.array(X.PROTOCOL.b), 0.02
    sample = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id between 1 and 4").select("voxel_id", "signal")
    grids, penalties = {3: [1e-4, 1e-3, 3e-3], 4: [1e-4, 2.9e-4, 1e-3, 3e-3]}, {3: 0.01, 4: 0.02}
    got = {r["n_iso"]: r for r in calibration.bootstrap_scores(sample, b, grids, penalties, sigma, 6).collect()}
    risks = {r["value"]: r["risk"] for r in calibration.sure_risks(sample, b, [(0.01, grids[3], 0.01), (0.5, grids[4], 0.5)], sigma, 5).collect()}
    rows = sample.collect()
    for n, grid in grids.items():
        a, cv, bias = np.exp(-b[:, None] * np.array(grid)[None]), [], []
        share = lambda y: (lambda w: w[np.array(grid) <= 0.3e-3].sum() / w.sum())(brute_nnls(a, y, penalties[n]))
        for r in rows:
            s, found = np.array(r["signal"]), []
            for k in range(6):
                noise = np.random.default_rng([r["voxel_id"], k]).normal(0, sigma, (2, 64))
                found.append(share(np.hypot(s + noise[0], noise[1])))
            cv.append(100 * np.std(found) / (np.mean(found) + 1e-10))
            bias.append(abs(np.mean(found) - share(s)))
        assert got[n]["cv"] == pytest.approx(np.mean(cv), rel=1e-6) and got[n]["bias"] == pytest.approx(np.mean(bias), abs=1e-9)
        assert got[n]["score"] == pytest.approx(np.mean(bias) ** 2 + (np.mean(cv) / 100 * 0.15) ** 2, rel=1e-6)
    for value, grid in ((0.01, grids[3]), (0.5, grids[4])):
        a, total = np.exp(-b[:, None] * np.array(grid)[None]), []
        for r in rows:
            s = np.array(r["signal"])
            signs, made = np.random.default_rng([r["voxel_id"], 42]).choice([-1.0, 1.0], (5, 64)), a @ brute_nnls(a, s, value)
            divergence = np.mean([z @ (a @ brute_nnls(a, s + 0.01 * sigma * z, value) - made) / (0.01 * sigma) for z in signs])
            total.append(-64 * sigma**2 + ((s - made) ** 2).sum() + 2 * sigma**2 * divergence)
        assert risks[value] == pytest.approx(np.mean(total), rel=1e-5)
    exact = {r["value"]: r["risk"] for r in calibration.sure_risks(sample, b, [(0.01, grids[3], 0.01), (0.5, grids[4], 0.5)], sigma, None).collect()}
    for value, grid in ((0.01, grids[3]), (0.5, grids[4])):
        a, total = np.exp(-b[:, None] * np.array(grid)[None]), []
        for r in rows:  # the divergence measurement by measurement
            s, step = np.array(r["signal"]), 1e-7
            made = a @ brute_nnls(a, s, value)
            divergence = sum((a @ brute_nnls(a, s + step * e, value) - made)[i] / step for i, e in enumerate(np.eye(64)))
            total.append(-64 * sigma**2 + ((s - made) ** 2).sum() + 2 * sigma**2 * divergence)
        assert exact[value] == pytest.approx(np.mean(total), rel=1e-4)
    choice = calibration.bootstrap_choice(spark.createDataFrame([(4, 5.0, 0.2, 1.0), (8, 5.0, 0.02, 0.1)], "n_iso int, cv double, bias double, score double")).first()
    assert (choice["best"], choice["flat"], choice["homogeneous"], choice["n_iso"]) == (8, False, False, 8)
    alike = calibration.bootstrap_choice(spark.createDataFrame([(4, 5.0, 0.001, 1.0), (8, 5.0, 0.002, 0.1)], "n_iso int, cv double, bias double, score double")).first()
    assert alike["homogeneous"] and alike["n_iso"] == 10
    check = calibration.sure_check(spark.createDataFrame([(1.0, 2.0), (2.0, 1.9), (3.0, 4.0)], "value double, risk double"), 1.0).first()
    assert check["agrees"] and check["best"] == 2.0


def test_discrepancy_search_meets_the_limit(spark):
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id < 12").select("signal")
    d = fitting.Config(directions=8).dictionary(X.PROTOCOL)
    limit = calibration.residual_curve(rows, d, 0.005, [300.0]).first()["residual"]
    value = calibration.discrepancy_search(rows, d, 0.005, limit)
    got = calibration.residual_curve(rows, d, 0.005, [value]).first()["residual"]
    assert got == pytest.approx(limit, rel=2e-3)


def test_signal_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0, 0, 0, True, [1.0, float("nan")]), ("b", 2, 0, 1, 0, None, [1.0]), ("b", 3, 0, 1, 1, True, None)], SIGNALS)
    write_signals(rows, str(tmp_path / "s"))
    got = {r["voxel_id"]: r for r in read_signals(spark, str(tmp_path / "s")).collect()}
    assert got[1]["signal"] == [1.0, None] and got[2]["in_mask"] is False and got[3]["signal"] is None
    assert read_signals(spark, str(tmp_path / "s"), ["a"]).count() == 1
    with pytest.raises(Exception, match="voxel 2"):
        read_signals(spark, str(tmp_path / "s"), measurements=2).collect()


def test_entry_without_the_training_data_folders(tmp_path):
    """The other queries are there when both folders are gone, with corpus_pipeline.py or without."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for name in ("voxelmill", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(sorted(e.queries())); assert 'tensor_fit' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_basins_of_rows_with_nulls_ties_and_nothing(spark):
    from voxelmill.operators import weights
    from voxelmill.operators.directions import Directions

    u = Directions(S.hemisphere(12), 2)
    rows = [(1, None), (2, [0.0] * 24), (3, [1.0] * 24), (4, [None] * 3 + [2.0] + [0.0] * 20), (4, [None] * 3 + [2.0] + [0.0] * 20)]
    found = weights.basins(weights.with_totals(spark.createDataFrame(rows, "voxel_id long, w array<double>"), 12, 2), u, most=2)
    mass = {r["voxel_id"]: (sum(r["mass"]), list(r["dirs"])) for r in found.collect()}
    assert mass[1] == mass[2] == (0.0, []) and mass[4] == (2.0, [3]) and abs(mass[3][0] - 24) < 1e-9
    peaks = [tuple(r) for r in weights.peaks(found).filter("voxel_id <> 3").collect()]
    assert peaks == [(4, 3, 2.0, 2.0, 1)] * 2
    assert {r["voxel_id"] for r in weights.concentration(found).collect()} == {3, 4}
    assert weights.peaks(found.limit(0)).count() == 0
