"""Interval lookups: for each row, the two entries of a sorted table around its value, by key, as a join on bins of the value.

A key's entries are cut into intervals by ``lead``; the range of its entries is cut into ``BINS`` equal bins, and each interval is listed in the
bins that it touches, at most ``BINS`` more rows than entries a key.  A row knows its bin, so key and bin are an equality that
is hashed, and which of a bin's intervals holds the row is looked up among those alone.  The table may be of any size: whether it is broadcast is
Spark's choice by its measure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelmill.operators.quantiles import beside

BINS = 256


def around(rows: DataFrame, value: Column, table: DataFrame, at: str, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """``rows`` with ``low`` and ``high``, entries (structs of the columns of ``table`` but the keys) of their key in the order of ``at``, then of
    the other columns: the last whose ``at`` is not over the value, and the one that follows it.  Before the first entry both are the
    first, from the last on both are the last.

    Entries without ``at`` are left out.  Rows whose key has no entries, or whose value is null, get nulls.
    """
    by, rest = list(by), [c for c in table.columns if c not in by]
    entry = F.struct(at, *[c for c in rest if c != at])
    order = Window.partitionBy(*by).orderBy("_entry")
    table = table.filter(F.col(at).isNotNull())
    cuts = table.select(*by, entry.alias("_entry")).withColumn("_next", F.lead("_entry").over(order))
    cuts = cuts.filter(F.col("_next").isNull() | (F.col(f"_next.{at}") > F.col(f"_entry.{at}")))
    ends = table.groupBy(*by).agg(F.min(entry).alias("_first"), F.min(at).alias("_from"), F.max(at).alias("_to"))

    def bin_of(x: Column) -> Column:
        """The bin of a value, within the first and the last."""
        share = F.when(F.col("_to") > F.col("_from"), (x - F.col("_from")) / (F.col("_to") - F.col("_from"))).otherwise(F.lit(0.0))
        return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")

    own = beside(cuts, ends, by)
    last = F.when(F.col("_next").isNull(), F.lit(bins - 1)).otherwise(bin_of(F.col(f"_next.{at}")))
    own = own.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(f"_entry.{at}")), last)))
    own = own.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_bin").alias("_k_bin"), "_entry", "_next")
    seen = beside(rows.withColumn("_value", value.cast("double")), ends, by).withColumn("_bin", bin_of(F.col("_value")))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
    inside = (F.col("_value") >= F.col(f"_entry.{at}")) & (F.col("_next").isNull() | (F.col("_value") < F.col(f"_next.{at}")))
    out = seen.join(own, [*same, F.col("_bin") == F.col("_k_bin"), inside], "left")
    low = F.when(F.col("_value").isNotNull(), F.coalesce("_entry", "_first"))
    high = F.when(F.col("_value").isNotNull(), F.coalesce("_next", "_entry", "_first"))
    return out.select(*rows.columns, low.alias("low"), high.alias("high"))


def corrected_by_table(rows: DataFrame, response: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rows(ff, rf, hf, ...)`` with rf_corrected, hf_corrected as by ``calibration.corrected_restricted``, where each key has a response table of its own
    (by, ff_level, rf_level, ff_est, rf_est) and tables may be large.  Rows of a key without a table keep their fractions."""
    by = list(by)
    up = Window.partitionBy(*by, "ff_level").orderBy("rf_level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rising = response.select(*by, "ff_level", F.max("rf_est").over(up).alias("est"), F.col("rf_level").alias("level"))
    levels = response.groupBy(*by, "ff_level").agg(F.avg("ff_est").alias("mid"))
    out = around(rows, F.col("ff"), levels, "mid", by).withColumnsRenamed({"low": "_below", "high": "_above"})
    for side in ("_below", "_above"):
        out = out.withColumn("ff_level", F.col(f"{side}.ff_level"))
        out = around(out, F.col("rf"), rising, "est", [*by, "ff_level"])
        low, high = F.col("low"), F.col("high")
        wide = high["est"] - low["est"]
        share = F.when((wide > 0) & (F.col("rf") > low["est"]), (F.col("rf") - low["est"]) / wide).otherwise(F.lit(0.0))
        out = out.withColumn(f"{side}_rf", low["level"] + share * (high["level"] - low["level"])).drop("low", "high", "ff_level")
    wide = F.col("_above.mid") - F.col("_below.mid")
    share = F.when((wide > 0) & (F.col("ff") > F.col("_below.mid")), (F.col("ff") - F.col("_below.mid")) / wide).otherwise(F.lit(0.0))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    found = F.col("_below_rf") + share * (F.col("_above_rf") - F.col("_below_rf"))
    out = out.withColumn("rf_corrected", F.when(found.isNotNull(), clip(found)).otherwise(F.col("rf")))
    return out.withColumn("hf_corrected", clip(F.col("hf") - (F.col("rf_corrected") - F.col("rf")))).drop("_below", "_above", "_below_rf", "_above_rf")
