"""Result maps as Parquet: one row for each voxel and channel, a folder for each channel, or for each subject and channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Channels that others imply; the last only where ``hindered_fraction`` is there.
REDUNDANT = ("ad_linear", "rd_linear", "nonrestricted_fraction")


def channels(results: DataFrame, skip_redundant: bool = True, keys: tuple[str, ...] = ("voxel_id",)) -> list[str]:
    """Names of the channels to write: all columns but the keys, the redundant ones, and ``..._NaN``."""
    skip = set(REDUNDANT[:2]) | (set(REDUNDANT[2:]) if "hindered_fraction" in results.columns else set())
    return [c for c in results.columns if c not in keys and not c.endswith("_NaN") and not (skip_redundant and c in skip)]


def _long(results: DataFrame, keys: Sequence[str], names: list[str]) -> DataFrame:
    rows = results.select(*keys, *[F.col(c).cast("double").alias(c) for c in names])
    return rows.unpivot(list(keys), names, "channel", "value").filter("value is not null")


def write_maps(results: DataFrame, path: str, skip_redundant: bool = True, keys: tuple[str, ...] = ("voxel_id",)) -> list[str]:
    """Writes the channels and returns their names; nulls are not written."""
    names = channels(results, skip_redundant, keys)
    _long(results, keys, names).write.partitionBy("channel").parquet(path)
    return names


def replace_maps(results: DataFrame, path: str, skip_redundant: bool = True, keys: tuple[str, ...] = ("subject_id", "voxel_id"), within: str = "subject_id", parts: int = 8) -> list[str]:
    """Writes the channels by (subject, channel) and returns their names; what is there of these subjects' channels is replaced, and that
    of all others stays.  Writing the same results again leaves the same table, so a job that was cut short is run again.

    Only folders that get rows are replaced: a channel that has become null everywhere keeps its old values unless the caller removes
    its folder.  Rows of a subject and channel are dealt to ``parts`` tasks by voxel and sorted by it, so files are of like size and a range of
    voxels reads few row groups.
    """
    names = channels(results, skip_redundant, keys)
    rows = _long(results, keys, names).repartition(within, "channel", F.pmod(F.xxhash64("voxel_id"), F.lit(parts)))
    rows = rows.sortWithinPartitions(within, "channel", "voxel_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(within, "channel").parquet(path)
    return names


def read_maps(spark, path: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(path)


def wide_maps(maps: DataFrame, names: Sequence[str], keys: tuple[str, ...] = ("subject_id", "voxel_id")) -> DataFrame:
    """Stored maps as one row a voxel again, a column for each of the named channels (null where none is stored); other channels' folders
    are not read."""
    own = maps.filter(F.col("channel").isin(list(names)))
    return own.groupBy(*keys).agg(*[F.max(F.when(F.col("channel") == n, F.col("value"))).alias(n) for n in names])
