"""Protocols and dictionaries as tables, for many subjects at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelmill import schema as S

#: Advice by shells and greatest b: steps of each diffusivity and least ratio.  Fixed values.
ADVICE = ((1, 1500.0, 4, 1.2), (2, 2500.0, 6, 1.15))
MOST_ADVICE = (8, 1.1)


def protocol_shells(protocols: DataFrame) -> DataFrame:
    """subject_id, shell, measurements: rows of each b-value rounded to hundreds (half to even)."""
    return protocols.groupBy("subject_id", F.bround("b", -2).alias("shell")).agg(F.count("*").alias("measurements"))


def protocol_summary(protocols: DataFrame) -> DataFrame:
    """subject_id, measurements, b_max, shells (over 50), isotropic_parts, directions, and the advised steps and ratio of a dictionary."""
    own = F.col("shell") > S.B0_NOISE
    shells = protocol_shells(protocols).groupBy("subject_id").agg(F.sum("measurements").alias("measurements"), F.count_if(own).alias("shells"), F.max(F.when(own, F.col("measurements"))).alias("largest"))
    top = protocols.groupBy("subject_id").agg(F.max("b").alias("b_max"))
    out = shells.join(top, "subject_id")
    parts = F.when((F.col("b_max") >= 2000) & (F.col("shells") >= 2), F.lit(3)).otherwise(F.lit(2))
    directions = F.coalesce(F.floor(1.3 * F.col("largest")), F.lit(30)).cast("int")
    steps, ratio = F.lit(MOST_ADVICE[0]), F.lit(MOST_ADVICE[1])
    for most, below, n, r in reversed(ADVICE):
        few = (F.col("shells") <= most) | (F.col("b_max") < below)
        steps, ratio = F.when(few, F.lit(n)).otherwise(steps), F.when(few, F.lit(r)).otherwise(ratio)
    return out.select("subject_id", "measurements", "b_max", "shells", parts.alias("isotropic_parts"), directions.alias("directions"), steps.alias("steps"), ratio.alias("ratio"))


def pair_table(sizes: DataFrame, ad: tuple[float, float] = (0.5e-3, 2.2e-3), rd: tuple[float, float] = (0.05e-3, 1.2e-3)) -> DataFrame:
    """subject_id, p, ad, rd: the admissible pairs of each subject of (subject_id, steps, ratio), axial outermost.  A subject without
    one ends the job with its id."""

    def line(i, ends):  # noqa: ANN001, ANN202
        return F.when(F.col("steps") > 1, ends[0] + (ends[1] - ends[0]) * i / (F.col("steps") - 1)).otherwise(F.lit(ends[0]))

    rows = sizes.select("subject_id", "steps", "ratio", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("i"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("j")).select("subject_id", "i", "j", "ratio", line(F.col("i"), ad).alias("ad"), line(F.col("j"), rd).alias("rd"))
    use = F.col("ad") >= F.col("rd") * F.col("ratio")
    some = F.max(use.cast("int")).over(Window.partitionBy("subject_id"))
    rows = rows.withColumn("_some", some).filter(use | F.when(F.col("_some") == 0, F.raise_error(F.concat(F.lit("no admissible pair of subject "), "subject_id")).cast("boolean")))
    return rows.select("subject_id", (F.row_number().over(Window.partitionBy("subject_id").orderBy("i", "j")) - 1).alias("p"), "ad", "rd")


def grid_table(sizes: DataFrame, lo: float = 0.1e-3, hi: float = 5.0e-3) -> DataFrame:
    """key, k, adc: the isotropic grid of each row of (key, n): log-uniform points and the compartment limits, and between neighbours over a
    factor of 2 apart as many equal ratios, a power of two, as bring them within it."""
    points = sizes.select("key", F.explode(F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lit(lo) * F.pow(F.lit(hi / lo), i / (F.col("n") - 1)))).otherwise(F.array(F.lit(lo)))).alias("adc"))
    anchors = F.array(*[F.lit(a) for a in (S.RES_MAX - 1e-6, S.WAT_MIN + 1e-6) if lo < a < hi])
    near = points.groupBy("key").agg(F.collect_list("adc").alias("own"))  # a grid's few dozen points
    added = near.select("key", F.explode(F.filter(anchors, lambda a: F.forall("own", lambda p: F.abs(a - p) > 1e-6))).alias("adc"))
    every = points.unionByName(added).distinct()
    order = Window.partitionBy("key").orderBy("adc")
    gaps = every.withColumn("next", F.lead("adc").over(order))
    wide = F.col("next") / F.col("adc")
    parts = F.when(wide > 2, F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.log2(wide)) - 1e-12)))).otherwise(F.lit(1.0)).cast("int")
    cut = F.when(F.col("next").isNull(), F.array(F.col("adc"))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.col("adc") * F.pow(wide, i / parts)))
    out = gaps.select("key", F.explode(cut).alias("adc"))
    return out.select("key", (F.row_number().over(order) - 1).alias("k"), "adc")
