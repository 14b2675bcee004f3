"""Voxel signals and labelled rows as Parquet tables of fixed schemas, partitioned by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNALS = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("voxel_id", T.LongType()),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("z", T.IntegerType()),
        T.StructField("in_mask", T.BooleanType()),
        T.StructField("signal", T.ArrayType(T.DoubleType())),
    ]
)


def read_signals(spark: SparkSession, path: str, subjects: list[str] | None = None, measurements: int | None = None) -> DataFrame:
    """Rows of ``SIGNALS``; a folder for each subject is pruned by ``subjects``.

    A null ``in_mask`` is outside the mask, and NaN in a signal becomes null.  With ``measurements``, a signal of another
    length ends the job with its voxel's id.
    """
    rows = spark.read.schema(SIGNALS).parquet(path)
    if subjects is not None:
        rows = rows.filter(F.col("subject_id").isin(subjects))
    signal = F.transform("signal", lambda s: F.nanvl(s, F.lit(None).cast("double")))
    if measurements is not None:
        wrong = F.concat(F.lit("another number of measurements in voxel "), F.coalesce(F.col("voxel_id").cast("string"), F.lit("null")))
        signal = F.when(F.col("signal").isNull() | (F.size("signal") == measurements), signal).otherwise(F.raise_error(wrong).cast("array<double>"))
    return rows.withColumns({"in_mask": F.coalesce("in_mask", F.lit(False)), "signal": signal})


def write_signals(rows: DataFrame, path: str) -> None:
    """Writes rows of ``SIGNALS``, a folder for each subject."""
    rows.select(*SIGNALS.names).write.partitionBy("subject_id").parquet(path)
