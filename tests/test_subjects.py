"""Tables of many subjects: percentiles by key, protocols, fits, penalties, stored maps and scores against one subject at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import schema as S
from voxelmill.operators import calibration, diffusivity, quantiles, signals, solvers
from voxelmill.operators import subjects as by_subject
from voxelmill.plans import fitting, subjects
from voxelmill.sources import fixtures as X
from voxelmill.sources import protocols as P
from voxelmill.sources.maps import read_maps, replace_maps, wide_maps
from voxelmill.storage import stash

SF = "/root/testdata/sf0.001"
ROW = ["subject_id", "voxel_id"]


@pytest.fixture(scope="module")
def two(spark):
    """Two subjects with a protocol each, whose voxel numbers are the same."""
    rows, protocols = X.subjects(spark, SF)
    keep = F.col("subject_id").isin("S1", "S2")
    rows = stash(rows.filter(keep & (F.col("voxel_id") < 12)), "two")
    return rows, stash(protocols.filter(keep), "two-protocols")


@pytest.mark.parametrize("accuracy", [10_000, 10])
def test_percentiles_by_key(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(2)
    rows = [("a", float(x), 1) for x in np.round(rng.normal(size=900), 2)] + [("b", float(x), 2) for x in rng.random(40)] + [(None, 5.0, 3), (None, 7.0, None), ("c", None, 4), ("d", 1.0, None), ("d", 1.0, None)]
    frame = spark.createDataFrame(rows, "k string, x double, n int").repartition(5)
    got = quantiles.percentiles(frame, {"low": (F.col("x"), 0.1), "mid": (F.col("x"), 0.5)}, ["k"], {"most": (F.col("n"), F.max)}).collect()
    assert {r["k"] for r in got} == {"a", "b", "c", "d", None} and len(got) == 5
    for r in got:
        own = [x for k, x, _ in rows if k == r["k"] and x is not None]
        counts = [n for k, _, n in rows if k == r["k"] and n is not None]
        assert r["most"] == (max(counts) if counts else None)
        for name, p in (("low", 0.1), ("mid", 0.5)):
            assert r[name] == (pytest.approx(np.quantile(own, p), abs=1e-12) if own else None)
    assert quantiles.percentiles(frame.filter("false"), {"mid": (F.col("x"), 0.5)}, ["k"]).count() == 0
    one = quantiles.percentiles(frame.filter("false"), {"mid": (F.col("x"), 0.5)}, also={"most": (F.col("n"), F.max)}).collect()
    assert [tuple(r) for r in one] == [(None, None)]


def test_samples_by_key_are_those_of_each(spark):
    rows = spark.range(600).select(F.col("id").alias("voxel_id"), (F.col("id") % 3).alias("k"))
    got = signals.sample(rows, 7, by=["k"]).collect()
    for k in range(3):
        assert sorted(r["voxel_id"] for r in got if r["k"] == k) == sorted(r["voxel_id"] for r in signals.sample(rows.filter(F.col("k") == k), 7).collect())


def test_protocols_by_subject(spark, two):
    own, known = P.by_subject(two[1])
    ids = {r["subject_id"]: r["protocol_id"] for r in own.collect()}
    assert len(known) == 2 and known[ids["S1"]].b == X.SHORT.b and known[ids["S2"]].b == X.PROTOCOL.b
    assert np.allclose(known[ids["S2"]].g, X.PROTOCOL.g)
    more = spark.createDataFrame([r for n in ("S1", "S3") for r in P.protocol_rows(n, X.SHORT)], P.PROTOCOLS)
    assert len(P.by_subject(more)[1]) == 1
    with pytest.raises(ValueError, match="over 1 different"):
        P.by_subject(two[1], 1)
    with pytest.raises(ValueError, match="lacks"):
        P.by_subject(spark.createDataFrame([("S", 0, None, 0.0, 0.0, 1.0)], P.PROTOCOLS))
    with pytest.raises(ValueError, match="no protocol of subject S1"):
        subjects.each_protocol(two[0], two[1].filter("subject_id = 'S2'"))


def of(frame, keys):
    return frame.toPandas().sort_values(keys).reset_index(drop=True)


def test_subjects_are_fitted_as_each_alone(spark, two):
    rows, protocols = two
    penalties = spark.createDataFrame([("S1", "fiber", 0.8), ("S1", "iso", 0.02)], "subject_id string, step string, lambda double")
    gate = spark.createDataFrame([("S2", 0.9)], "subject_id string, gate double")
    got = of(subjects.fit_subjects(rows, protocols, penalties=penalties, gate=gate), ROW)
    assert list(got.columns[:5]) == list(subjects.KEYS) and not got[ROW].duplicated().any()
    alone = {"S1": (X.SHORT, fitting.Config(fiber_penalty=0.8, iso_penalty=0.02)), "S2": (X.PROTOCOL, fitting.Config(gate=0.9))}
    for name, (protocol, config) in alone.items():
        want = of(fitting.fit(rows.filter(F.col("subject_id") == name), protocol, config), ["voxel_id"])
        own = got[got["subject_id"] == name].reset_index(drop=True)
        assert len(own) == len(want) > 5
        for c in want.columns:
            assert np.allclose(own[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9), c
    assert got.loc[got["subject_id"] == "S1", "hf"].isna().all() and got.loc[got["subject_id"] == "S2", "hf"].notna().all()


def test_penalties_of_subjects_are_those_of_each(spark, two):
    rows, protocols = two
    config = fitting.Config(sample=6, directions=8)
    for protocol, own in subjects.each_protocol(rows.filter("subject_id = 'S2'"), protocols.filter("subject_id = 'S2'")):
        twice = own.unionByName(own.withColumns({"subject_id": F.lit("T"), "signal": F.transform("signal", lambda s: s * (1 + 0.02 * F.sin(s)))}))
        unit, sigma = fitting.unit_sample(twice, protocol, config, by=["subject_id"])
        dictionary = config.dictionary(protocol)
        noise = {r["subject_id"]: r["sigma"] for r in sigma.collect()}
        for method in ("discrepancy", "gcv"):
            got = {(r["subject_id"], r["step"]): r["lambda"] for r in by_subject.two_pass_by(unit, dictionary, sigma, ["subject_id"], method).collect()}
            for name in ("S2", "T") if method == "discrepancy" else ("T",):
                want = {r["step"]: r["lambda"] for r in calibration.two_pass(unit.filter(F.col("subject_id") == name), dictionary, noise[name], method).collect()}
                for step, value in want.items():
                    assert got[name, step] == pytest.approx(value, rel=1e-6), (name, step)


def test_curves_of_one_subject_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(by_subject, "HELD", 1)
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id < 40").repartition(3)
    got = by_subject.moments_by(rows, 64, ["scenario"]).collect()
    assert len(got) == rows.select("scenario").distinct().count()
    for r in got[:3]:
        y = np.array([s["signal"] for s in rows.filter(F.col("scenario") == r["scenario"]).collect()])
        assert np.allclose(np.array(r["moment"]).reshape(64, 64), y.T @ y / len(y))


def test_maps_are_replaced_by_subject(spark, tmp_path):
    path = str(tmp_path / "maps")
    first = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, 0.25, 1.0), ("b", 1, 0.75, 3.0)], "subject_id string, voxel_id long, fiber_fraction double, ad_linear double")
    keys = ("subject_id", "voxel_id")
    state = lambda: {tuple(r) for r in read_maps(spark, path).select("subject_id", "channel", "voxel_id", "value").collect()}
    assert replace_maps(first, path, keys=keys) == ["fiber_fraction"]
    want = {("a", "fiber_fraction", 1, 0.5), ("a", "fiber_fraction", 2, 0.25), ("b", "fiber_fraction", 1, 0.75)}
    assert state() == want
    replace_maps(first, path, keys=keys)  # again: the same
    assert state() == want
    again = spark.createDataFrame([("a", 2, 0.125)], "subject_id string, voxel_id long, fiber_fraction double")
    replace_maps(again, path, keys=keys)
    assert state() == {("a", "fiber_fraction", 2, 0.125), ("b", "fiber_fraction", 1, 0.75)}
    quality = spark.createDataFrame([("b", 1, 0.9)], "subject_id string, voxel_id long, r2 double")
    replace_maps(quality, path, keys=keys)
    wide = wide_maps(read_maps(spark, path), ["fiber_fraction", "r2", "rmse"])
    assert {tuple(r) for r in wide.collect()} == {("a", 2, 0.125, None, None), ("b", 1, 0.75, 0.9, None)}


def test_stored_results_are_scored_without_a_shuffle(spark, two, tmp_path):
    rows, protocols = two
    spark.sql(f"create database if not exists kept location '{tmp_path}'")
    try:
        fitted = subjects.store(subjects.fit_subjects(rows, protocols), "kept.fits", 4)
        voxels = subjects.store(rows, "kept.voxels", 4)
        names = ["subject_id", "voxel_id"]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = fitted.join(voxels, names)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = of(subjects.scored(fitted, voxels, protocols), ROW)
        assert len(got) == fitted.count() and (got["rmse"] >= 0).all() and got["r2"].median() > 0.9
        maps = subjects.derived_maps(fitted).toPandas()
        assert len(maps) == len(got) and maps["agg_ff"].between(0, 1).all()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database kept cascade")


def test_the_joint_fit_gives_fractions(spark):
    rows = X.signals(spark, SF).filter("voxel_id < 60")
    got = of(fitting.fit(rows, X.PROTOCOL, fitting.Config(resolve=False)), ["voxel_id"])
    alone = got["n_fibers"] == 1
    assert np.allclose(got["f1"][alone], got["ff"][alone])
    assert (got[["ff", "rf", "hf", "wf"]].sum(axis=1) - 1).abs().max() < 1e-9
    unit = {r["voxel_id"]: np.array(r["signal"]) for r in signals.normalised(rows, X.PROTOCOL).collect()}
    b, g, grid = np.array(X.PROTOCOL.b), np.array(X.PROTOCOL.g), np.array(S.iso_grid(10))
    for r in got[alone].itertuples():  # weights of the tensor that was found and of the isotropic grid
        c2 = (g @ np.array([r.u1x, r.u1y, r.u1z])) ** 2
        a = np.column_stack([np.exp(-b * (r.rd1 + (r.ad1 - r.rd1) * c2)), np.exp(-b[:, None] * grid)])
        w = solvers.nnls(a.T @ a, (unit[r.voxel_id] @ a)[None])[0] if r.voxel_id in unit else None
        assert r.ff == pytest.approx(w[0] / w.sum(), abs=1e-6) and r.rf == pytest.approx(w[1:][grid <= S.RES_MAX].sum() / w.sum(), abs=1e-6)
        assert r.mean_iso_adc == pytest.approx(w[1:] @ grid / w[1:].sum(), abs=1e-9)
    solved = of(fitting.fit(rows, X.PROTOCOL), ["voxel_id"])
    assert np.allclose(solved["f1"][alone], solved["ff"][alone])


def test_single_fibers_in_any_blocks(spark, monkeypatch):
    rows = signals.normalised(X.signals(spark, SF), X.PROTOCOL).filter("voxel_id < 25").select("voxel_id", "signal", "ux", "uy", F.when(F.col("voxel_id") != 3, F.col("uz")).alias("uz"), F.lit(0).alias("z"))
    rows = rows.withColumn("ux", F.when(F.col("voxel_id") != 3, F.col("ux")))
    want = of(solvers.single_fiber(rows, X.PROTOCOL, S.iso_grid(10)), ["voxel_id"])
    monkeypatch.setattr(solvers, "MATRIX_BYTES", 1)
    got = of(solvers.single_fiber(rows, X.PROTOCOL, S.iso_grid(10)), ["voxel_id"])
    assert np.allclose(got[["fit_ad", "fit_rd", "fit_residual"]], want[["fit_ad", "fit_rd", "fit_residual"]], equal_nan=True)
    assert want["fit_ad"].isna().sum() == (want["voxel_id"] == 3).sum() == 1


def test_calibration_names_a_bad_signal(spark):
    for bad in ([1.0, 2.0, 3.0], [1.0, None, 2.0, 3.0]):
        rows = spark.createDataFrame([(5, [1.0] * 4), (9, bad)], "voxel_id long, signal array<double>")
        with pytest.raises(Exception, match="signal of voxel 9 must have 4 numbers"):
            calibration.moments(rows, 4)


def test_grid_and_gate_are_parameters(spark):
    rows = X.signals(spark, SF)
    config = fitting.Config(sample=30, grid_method="sweep", fibers=1, directions=8)
    out = fitting.calibrated_fit(rows.filter("voxel_id < 40"), X.PROTOCOL, config)
    assert out.count() > 20
    with pytest.raises(ValueError, match="choose a grid"):
        fitting.Config(grid_method="guess")


def test_maps_without_values(spark):
    rows = spark.createDataFrame([(0.6, 0.1, 1.5e-3, 1e-3, None, None), (0.6, 0.1, None, None, 1e-3, 1e-4), (0.0, 0.0, 1e-3, 1e-3, None, None), (0.5, float("nan"), 1e-3, 1e-3, None, None), (None, None, 1e-3, 1e-3, None, None)], "ff double, f2 double, ad1 double, rd1 double, ad2 double, rd2 double")
    got = [tuple(r) for r in diffusivity.fiber_maps(rows).select("agg_ff", "agg_ad", "agg_fa").collect()]
    assert got[0][:2] == (0.6, pytest.approx(1.25e-3)) and got[1] == (0.6, None, None) and got[2] == (0.0, None, None)
    assert got[3][:2] == (0.5, pytest.approx(1e-3)) and got[4] == (None, None, None)
