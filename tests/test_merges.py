"""Tables of voxels meet by merging, however small Spark takes one of them to be: a broadcast passes through the driver."""

import re

from voxelmill.plans import subjects

SF = "/root/testdata/sf0.001"


def test_scores_by_subject_broadcasts_no_voxels(spark):
    got = subjects.scores_by_subject(spark, SF)
    assert got.count() > 0
    joins = re.findall(r"(\w+Join\w*) \[[^\n]*voxel_id", got._jdf.queryExecution().executedPlan().toString())
    assert len(joins) >= 3 and set(joins) == {"SortMergeJoin"}, joins
