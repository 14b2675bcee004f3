"""Exact duplicate removal by skew-safe combining (native DataFrame operations only).

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``; a null text
counts as empty.  Of equal texts, the row with the most code points in its original text stays, then
the one with the smallest ``doc_id``; a null ``doc_id`` comes after all others.

Three combining stages, each grouping by digest *and* full content, so that equality is never left
to a digest:

1. locally: the partial aggregate of each task leaves one row for each content and salt;
2. salted: rows of hot digests are spread over ``salts`` groups, others have one group;
3. globally: the salt winners of hot digests (at most ``salts`` rows a content) meet.

Winners then go back to all rows: those of hot digests, of which there are fewer than ``HOT``, by broadcast, so
that the rows of a large group stay where they are; the others by a join on the digest.  Should two contents share a
digest, the rows of that digest are told apart by their contents, in a join on both.

Empty tables give no rows.  Rows that repeat both ``doc_id`` and text count each in ``group_size`` and
have the same result; ``survivors`` returns one of them.  Other columns of the input are carried by
``survivors`` and not looked at otherwise, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm.shared import HOT, hot_keys, packed, spread_join, stash

SALTS = 16
#: Ids, moved to start from 0, lie below this; a rank is code points times this, less the id.
_STEP = 10**20
_NULL_ID = 2 * 10**19


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _big(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def _rank(n: Column, doc_id: Column) -> Column:
    moved = F.coalesce(doc_id.cast("decimal(38,0)") + _big(1 << 63), _big(_NULL_ID))
    return (n.cast("decimal(38,0)") * _big(_STEP) + (_big(_STEP - 1) - moved)).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    moved = _big(_STEP - 1) - rank % _big(_STEP)
    return F.when(moved < _big(_NULL_ID), (moved - _big(1 << 63)).cast("long"))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of ``digest``)."""
    raw = F.col(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(raw).alias("norm"), F.char_length(F.coalesce(raw, F.lit(""))).alias("n"))
    base = base.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), _rank(F.col("n"), F.col("doc_id")).alias("rank"))

    members = stash(base.select("doc_id", "digest", "rank"), "op10-members")
    hot = hot_keys(members.groupBy("digest").agg(F.count("*").alias("rows")), members.count(), "op10-hot")
    flag = F.broadcast(hot.withColumn("hot", F.lit(True)))  # under HOT rows

    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "rank"), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = base.join(flag, "digest", "left").groupBy("digest", "norm", salt.alias("salt"), "hot").agg(F.max("rank").alias("best"), F.count("*").alias("size"))
    salted = stash(salted.select("digest", F.when(F.col("hot"), F.col("norm")).alias("norm"), "hot", "best", "size"), "op10-salted")
    merged = salted.filter("hot").groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    groups = salted.filter("hot is null").select("digest", "best", "size").unionByName(merged.select("digest", "best", "size"))
    groups = stash(groups.groupBy("digest").agg(F.max("best").alias("best"), F.max("size").alias("group_size"), F.count("*").alias("contents")), "op10-groups")

    out = spread_join(members, groups.filter("contents = 1").drop("contents"), "digest", hot)
    shared = groups.filter("contents > 1").select("digest")
    if not shared.isEmpty():  # contents that share a digest
        rows = base.join(shared, "digest", "left_semi")
        own = rows.groupBy("digest", "norm").agg(F.max("rank").alias("best"), F.count("*").alias("group_size"))
        out = out.unionByName(rows.join(own, ["digest", "norm"]).select(*out.columns))
    return out.select(
        "doc_id",
        _id_of(F.col("best")).alias("keep_id"),
        "group_size",
        (F.col("rank") == F.col("best")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("digest")).distinct()
    rows = packed(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "key": sha256(normalised(F.col("row.text")))})
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("digest"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
SQL = {"op10_exact_dedup": ORACLE}
__all__ = ["HOT", "QUERIES", "SQL", "exact_dedup", "normalised", "survivors"]
