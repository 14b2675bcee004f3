"""Acquisition protocols: from text, and as a table of many subjects' measurements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelmill.schema import Protocol
from voxelmill.storage import stash

#: One row for each measurement of a subject; m tells their order.
PROTOCOLS = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("m", T.IntegerType()),
        T.StructField("b", T.DoubleType()),
        T.StructField("gx", T.DoubleType()),
        T.StructField("gy", T.DoubleType()),
        T.StructField("gz", T.DoubleType()),
    ]
)
#: Different protocols that one fit may have; each has a plan of its own.
MOST = 64


def _numbers(spark: SparkSession, path: str) -> list[list[float]]:
    """The rows of a matrix of numbers; a protocol has a few hundred."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).filter("line <> ''").orderBy("row")
    return [[float(x) for x in r["line"].split(" ")] for r in lines.select("line").collect()]


def _unit(g: tuple[float, float, float]) -> tuple[float, float, float]:
    norm = math.sqrt(sum(x * x for x in g)) or 1.0
    return tuple(x / norm for x in g)


def read_protocol(spark: SparkSession, b_path: str, g_path: str) -> Protocol:
    """b-values in any layout; directions as 3 rows or 3 columns, scaled to length 1 (zeros stay)."""
    b = [x for row in _numbers(spark, b_path) for x in row]
    g = _numbers(spark, g_path)
    if len(g) == 3 and len(b) != 3:
        g = [list(x) for x in zip(*g)]
    if any(len(x) != 3 for x in g):
        raise ValueError("directions need three components")
    return Protocol(tuple(b), tuple(_unit(v) for v in g))


def protocol_rows(subject: str, protocol: Protocol) -> list[tuple]:
    """The rows of ``PROTOCOLS`` of one subject."""
    return [(subject, m, float(b), *map(float, g)) for m, (b, g) in enumerate(zip(protocol.b, protocol.g))]


def by_subject(protocols: DataFrame, most: int = MOST) -> tuple[DataFrame, dict[str, Protocol]]:
    """(subject_id, protocol_id), and the different protocols by id, of rows of ``PROTOCOLS``.

    Subjects are many and protocols few: only the different ones, at most ``most``, come to the driver.
    """
    row = F.struct("m", "b", "gx", "gy", "gz")
    own = protocols.groupBy("subject_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # some hundred a subject
    own = stash(own.withColumn("protocol_id", F.sha2(F.to_json("rows"), 256)), "protocols")
    found = own.groupBy("protocol_id").agg(F.any_value("rows").alias("rows")).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} different protocols in one table")
    known = {}
    for r in found:
        if any(x is None for m in r["rows"] for x in m):
            raise ValueError("a measurement lacks its b-value or direction")
        known[r["protocol_id"]] = Protocol(tuple(m["b"] for m in r["rows"]), tuple(_unit((m["gx"], m["gy"], m["gz"])) for m in r["rows"]))
    return own.select("subject_id", "protocol_id"), known
