"""What operators share: intermediate tables, joins of skewed keys, memory of tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.storage import new_path, shared_dir, stash

#: Largest table, in bytes, that an operator may broadcast after measuring it.
BROADCAST_BYTES = 8 << 20
#: A key is hot if it has over 1 / HOT of all rows, so there are fewer than that many.
HOT = 1000


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcasting if ``rows * row_bytes`` is within the bound; else as it is,
    so that the join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one, ``row``, so that columns an operator adds can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def hot_keys(counts: DataFrame, total: int, name: str) -> DataFrame:
    """Of (key, rows), the keys with over 1 / HOT of ``total`` rows: fewer than HOT of them, as a written table."""
    key = counts.columns[0]
    return stash(counts.filter(F.col("rows") > max(1.0, total / HOT)).select(key), name)


def spread_join(rows: DataFrame, found: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join with ``found``, which has one row a key.  The rows of hot keys (see ``hot_keys``) stay where they are
    and meet their partners by broadcast, so no task gets a hot key's rows; the others are shuffled."""
    hot = F.broadcast(hot)  # under HOT rows
    warm = F.broadcast(found.join(hot, key, "left_semi"))  # a row for each of them
    cold = rows.join(hot, key, "left_anti").join(found, key)
    return cold.unionByName(rows.join(warm, key).select(*cold.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Hands memory that Arrow and the C library hold free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def released(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that gives free memory back as it ends: workers outlive their tasks, and what
    they hold would add up over the stages of a long job."""

    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            give_back()

    return run


__all__ = ["BROADCAST_BYTES", "HOT", "give_back", "hot_keys", "new_path", "packed", "partitions", "released", "shared_dir", "small", "spread_join", "stash"]
