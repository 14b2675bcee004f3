"""The secrets' network is fitted to all findings of a table, in tasks, whatever their number, length and partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.llm import secret_scan


def found(spark, n, parts=3):
    text = F.concat(F.lit("token = "), F.sha1(F.col("id").cast("string")), F.lit(" and mail"), F.col("id").cast("string"), F.lit(".example.com"))
    return secret_scan.findings(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(parts))


def test_every_finding_is_learnt_from(spark, monkeypatch):
    """Also those over 1000 of a label and those over 256 characters, none of which the fit looked at before."""
    long = spark.createDataFrame([(9999, "see " + "ab.12/" * 500 + " there")], "doc_id long, text string")
    rows = found(spark, 1100).unionByName(secret_scan.findings(long))
    labelled = secret_scan.labelled_findings(rows)
    want = {(w["left"], w["body"], w["right"], w["base"]) for r in rows.collect() for w in r["windows"]}
    got = {(r["left"], r["body"], r["right"], r["label"]) for r in labelled.collect()}
    assert len(want) == 2201 and want <= got
    assert labelled.count() == 2 * len(want) and 0.4 < labelled.filter("label").count() / (2 * len(want)) < 0.6
    monkeypatch.setattr(secret_scan, "EPOCHS", 1)
    assert secret_scan.fit_all(rows).thresholds[True] > 0


def test_the_network_is_the_same_over_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "SHARD", 40_000)  # several shards
    a, b = (secret_scan.fit_all(found(spark, 60, n), 600) for n in (1, 5))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p) and a.line == b.line and a.thresholds == b.thresholds


@pytest.mark.parametrize("shard", [1 << 20, 30_000])
def test_quality_by_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(secret_scan, "SHARD", shard)
    network = secret_scan.fit_all(found(spark, 300))
    made = secret_scan.made_findings([("of that ", " which"), ("ö und die ", ".")], 1000, seed=77)
    p, label = network.probability(network.logits(made)), np.array([f.label for f in made])
    taken = p >= np.array([network.thresholds[f.signed] for f in made])
    assert taken[label].mean() > 0.93 and taken[~label].mean() < 0.08 and abs(p.mean() - label.mean()) < 0.1


def test_calibration_is_that_of_the_list(spark):
    made = secret_scan.made_findings([("ab ", " c"), ("", "\n")], 400, seed=5)
    one, two = secret_scan.fit(made), secret_scan.fit(made)
    made = secret_scan.made_findings([("x ", " y")], 500, seed=6)
    one.calibrate(made)
    rows = spark.createDataFrame([(f.left, f.body, f.right, f.signed, f.label, i, i % 3) for i, f in enumerate(made)], "left string, body string, right string, signed boolean, label boolean, key long, shard long")
    secret_scan.calibrate_all(rows, two)
    assert np.allclose(one.line, two.line, rtol=1e-6) and all(one.thresholds[k] == pytest.approx(two.thresholds[k], abs=1e-6) for k in (False, True))


def test_the_nth_by_counting(spark):
    values = sorted([*range(-30_000, 30_000, 7), 1 << 40, -(1 << 40), 5, 5, 5])
    rows = spark.createDataFrame([(v,) for v in values], "q long")
    assert [secret_scan._nth(rows, k) for k in (0, 1, 4300, len(values) - 1)] == [values[k] for k in (0, 1, 4300, len(values) - 1)]


def test_peaks_of_long_windows_in_pieces(monkeypatch):
    network = secret_scan.Network()
    made = [secret_scan.Finding("left ", "a1" * n + "Z9", " right", True) for n in (5, 40, 300)] + [secret_scan.Finding("", "", "", False)]
    want = network.peaks(made)
    monkeypatch.setattr(secret_scan, "PIECE", 16)
    got = network.peaks(made)
    assert np.allclose(got[0], want[0])
    some = want[0] > 0
    assert np.array_equal(got[1][some], want[1][some]) and np.array_equal(got[2][some], want[2][some])
