"""Interval lookups against a search in sorted lists, and dictionary tables against the objects of one protocol."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill import schema as S
from voxelmill.operators import calibration, dictionaries, intervals
from voxelmill.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bins", [1, 4, 256])
def test_lookups(spark, bins):
    rng = np.random.default_rng(1)
    table = [("a", float(x), i) for i, x in enumerate(np.round(rng.exponential(1, 60), 1))] + [("b", 2.0, 7), (None, 1.0, 1), (None, 3.0, 2)] + [("d", None, 1)]
    rows = [(k, float(v)) for k in ("a", "b", None, "c", "d") for v in (-5.0, 0.0, 0.3, 1.0, 2.0, 2.5, 3.0, 99.0)] + [("a", 0.3)] * 50 + [("a", None)]
    got = intervals.around(spark.createDataFrame(rows, "k string, v double"), F.col("v"), spark.createDataFrame(table, "k string, at double, n int"), "at", ["k"], bins).collect()
    assert len(got) == len(rows)
    for r in got:
        own = sorted((x, n) for k, x, n in table if k == r["k"] and x is not None)
        if not own or r["v"] is None:
            assert r["low"] is None and r["high"] is None
            continue
        i = bisect.bisect_right([x for x, _ in own], r["v"])
        assert tuple(r["low"]) == own[max(i - 1, 0)] and tuple(r["high"]) == own[min(i, len(own) - 1)]
    assert intervals.around(spark.createDataFrame([], "k string, v double"), F.col("v"), spark.createDataFrame(table, "k string, at double, n int"), "at", ["k"]).count() == 0


def test_corrections_by_table_are_those_of_one_table(spark):
    response = calibration.restricted_response(X.labelled(spark, SF))
    rows = X.truth(spark, SF).select("voxel_id", "ff", "rf", "hf")
    want = {r["voxel_id"]: (r["rf_corrected"], r["hf_corrected"]) for r in calibration.corrected_restricted(rows, response).collect()}
    got = intervals.corrected_by_table(rows.withColumn("k", F.col("voxel_id") % 2), response.withColumn("k", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))), ["k"]).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["rf_corrected"], r["hf_corrected"]) == pytest.approx(want[r["voxel_id"]], abs=1e-12)
    kept = intervals.corrected_by_table(rows.withColumn("k", F.lit("none")), response.withColumn("k", F.lit("other")), ["k"])
    assert kept.filter("rf_corrected <> rf or hf_corrected <> hf").count() == 0 and kept.count() == len(want)


def test_dictionary_tables(spark):
    sizes = spark.createDataFrame([(n, n) for n in (1, 2, 4, 7, 10, 16, 31)], "key int, n int")
    got = {}
    for r in dictionaries.grid_table(sizes).collect():
        got.setdefault(r["key"], []).append((r["k"], r["adc"]))
    for n, points in got.items():
        assert [k for k, _ in sorted(points)] == list(range(len(points)))
        assert np.allclose([x for _, x in sorted(points)], S.iso_grid(n), rtol=1e-9)
    one = spark.createDataFrame([("s", 3, 2.0)], "subject_id string, steps int, ratio double")
    assert np.allclose([(r["ad"], r["rd"]) for r in dictionaries.pair_table(one).orderBy("p").collect()], S.pairs())
    with pytest.raises(Exception, match="no admissible pair of subject s"):
        dictionaries.pair_table(one.withColumn("ratio", F.lit(1e6))).collect()
    from voxelmill.sources import protocols as P

    table = spark.createDataFrame([r for n, p in (("long", X.PROTOCOL), ("short", X.SHORT)) for r in P.protocol_rows(n, p)] + [("none", 0, 0.0, 0.0, 0.0, 0.0)], P.PROTOCOLS)
    summary = {r["subject_id"]: r for r in dictionaries.protocol_summary(table).collect()}
    for n, p in (("long", X.PROTOCOL), ("short", X.SHORT)):
        assert (summary[n]["isotropic_parts"], summary[n]["directions"], summary[n]["shells"]) == (p.isotropic_parts, p.directions, len(p.shells))
    assert (summary["none"]["directions"], summary["none"]["isotropic_parts"], summary["none"]["steps"]) == (30, 2, 4)
