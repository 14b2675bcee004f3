"""Mixing sources to target weights by pivotal dependent rounding.

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources, by
code point with null last, weigh ``weights`` in turn and share ``share`` times all sizes; no target
exceeds ``cap`` times its source's size, the excess going to the others by weight until none is above.

Each document is owed target / source size copies: a whole part, and a fractional one, whose words are its
mass.  Pivotal rounding takes two documents that are still fractional and moves mass from one to the other, at random so that neither's expected
copies change, until one of them is integral; the other meets the next.  The words that are taken stay the same.

A reduction tree does this at scale: documents of a source are dealt to groups of about ``FAN`` by a hash, each
group leaves at most one fractional document, and those meet in the next level until one is left for each source.  It is settled last, by the same rule
for a source of any size: it becomes whole or nothing, and as many words as that adds or lacks are exchanged for it among documents not larger than
it, integral so far, in random order, the ``CHANGE`` smallest last.  They are taken from a part of the source, chosen by hash, that has some ``POOL`` times its words (all of
a smaller source).  The smallest that did not fit stays fractional and is rounded by chance.  A source misses its target by less than that
one's size, which is among the smallest unless one document outweighs all smaller ones of its source.

Copies are 0 to ``cap``; sizes of 0 are never fractional.  Draws come from hashes of ids, so reruns
agree.  Rows that repeat a ``doc_id`` are separate documents.  An empty table, or one without words,
gives targets of 0.  Of the input only doc_id, text and source are read; ``mixed`` carries all columns, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelmill.llm.shared import packed, partitions, small, stash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
#: Documents of a group of the reduction tree.
FAN = 4096
#: Sources whose targets one task finds; more are dealt by ranges.
SOURCES = 100_000
#: Words of the documents that the last one is exchanged with, as a multiple of its own.
POOL = 64
#: The smallest of these, which come last in an exchange.
CHANGE = 8
_ITEM = "source string, doc_id long, uid long, nth int, size long, place long, mass double, copies int, open boolean"


def ahead(rows: DataFrame, order: list[Column], sums: tuple[str, ...], name: str, one: bool) -> DataFrame:
    """``rows``, different ones, with their ``place`` in an order (from 0) and, of each column of ``sums``, the sum ``before_<column>`` of the rows before.

    Rows are dealt by ranges of the order and written; windows run inside a range, and one over a row a range tells what is before it.
    Where one task can hold all rows (``one``), they are one range.
    """
    over = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if one:
        every = Window.orderBy(*order)
        return rows.withColumn("place", F.row_number().over(every) - 1).withColumns({f"before_{c}": over(every, c) for c in sums})
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    dealt = stash(dealt, name)
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_place"), *[F.sum(c).alias(f"_{c}") for c in sums])
    totals = totals.select(F.col("_range").alias("_of"), *[over(Window.orderBy("_range"), f"_{c}").alias(f"_{c}") for c in ("place", *sums)])
    own = Window.partitionBy("_range").orderBy(*order)
    out = dealt.join(F.broadcast(totals), F.col("_range") == F.col("_of"))  # a row a range
    out = out.withColumn("place", F.row_number().over(own) - 1 + F.col("_place")).withColumns({f"before_{c}": over(own, c) + F.col(f"_{c}") for c in sums})
    return out.drop("_range", "_of", "_place", *[f"_{c}" for c in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, at_once: int = SOURCES) -> DataFrame:
    """source, source_size, target of each source; no window is wider than ``at_once`` sources or a range of them.

    Which sources reach the cap follows from sorting them by cap * size / weight: with the k first of
    them at the cap, the rest share what is left, and k is the least number that leaves none above.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = stash(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "op9-sources")
    one = rows.count() <= at_once
    rows = ahead(rows, by_name, (), "op9-places", one)
    of = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", of).withColumn("limit", F.lit(float(cap)) * F.col("source_size")).drop("place")
    rows = ahead(rows, [F.col("limit") / F.col("weight"), *by_name], ("limit", "weight"), "op9-limits", one)
    every = rows.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))
    unit = (F.lit(float(share)) * F.col("_size") - F.col("before_limit")) / (F.col("_weight") - F.col("before_weight"))
    rows = rows.crossJoin(F.broadcast(every)).withColumn("unit", unit)  # one row
    free = F.col("weight") * F.col("unit") <= F.col("limit")
    level = rows.agg(F.min(F.when(free, F.struct("place", "unit")))["unit"].alias("_level"))
    target = F.when(F.col("_level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("_level")))
    return rows.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))  # one row


def exchange(size: np.ndarray, mass: np.ndarray, draws: np.ndarray, held: int) -> tuple[np.ndarray, int]:
    """Settles the document that is left by smaller, integral ones: it becomes 0 or whole, and smaller ones are taken or given
    back for it, as far as they are not larger than what is missing.  The smallest of the others then holds the rest, and is settled
    likewise, as long as that leaves a smaller one."""
    while held >= 0:
        new, last = _swapped(size, mass.copy(), draws, held)
        if last >= 0 and size[last] >= size[held]:
            return mass, held
        mass, held = new, last
    return mass, held


def _swapped(size: np.ndarray, mass: np.ndarray, draws: np.ndarray, held: int) -> tuple[np.ndarray, int]:
    gap = {True: float(size[held] - mass[held]), False: float(mass[held])}  # it is taken, or not
    turn = {up: np.flatnonzero((size <= size[held]) & (np.arange(len(size)) != held) & ((mass > 0) == up)) for up in gap}
    able = [up for up in gap if size[turn[up]].sum() >= gap[up]]
    if not able:
        return mass, held
    up = bool(draws[held] * size[held] < mass[held]) if len(able) == 2 else able[0]
    rest, others = gap[up], []
    own = turn[up][np.argsort(size[turn[up]], kind="stable")]
    change, bulk = own[:CHANGE][::-1], own[CHANGE:]
    for j in [*bulk[np.argsort(draws[bulk], kind="stable")].tolist(), *change.tolist()]:
        if size[j] <= rest + 1e-9:
            rest -= float(size[j])
            mass[j] = 0.0 if up else float(size[j])
        else:
            others.append(j)
    mass[held] = float(size[held]) if up else 0.0
    if rest < 1e-6:
        return mass, -1
    least = min(others, key=lambda j: (size[j], j))
    mass[least] = float(size[least]) - rest if up else rest
    return mass, least


def pivotal(size: np.ndarray, mass: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds masses in (0, size) to 0 or size in pairs, the largest documents first, keeping their sum but for one document.

    Returns the masses and the position of the document that stays fractional, or -1.
    """
    out, held, total = mass.astype(float), -1, float(mass.sum())
    eps = 1e-9
    for step, j in enumerate(np.argsort(-size, kind="stable").tolist()):
        if held < 0:
            held = j
            continue
        i = held
        a, b, s, t = out[i], out[j], float(size[i]), float(size[j])
        rise, fall = min(s - a, b), min(a, t - b)
        move = rise if draws[step] * (rise + fall) < fall else -fall  # what the one gains and the other gives
        a, b = a + move, b - move
        a, b = (0.0 if x < eps * y else y if x > y - eps * y else x for x, y in ((a, s), (b, t)))
        out[i], out[j] = a, b
        held = i if 0 < a < s else j if 0 < b < t else -1
    if held >= 0:
        out[held] += total - out.sum()  # what rounding of numbers has lost
    return out, held


def _ordered(group: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A group in an order of its own, sizes, and draws of its documents."""
    group = group.sort_values(["place", "size", "uid", "nth"], kind="stable").reset_index(drop=True)
    draws = ((group["place"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / float(1 << 53)
    return group, group["size"].to_numpy(), draws


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    group, size, draws = _ordered(group)
    mass, held = pivotal(size, group["mass"].to_numpy(), draws)
    group["open"] = np.arange(len(group)) == held
    group["copies"] += ((mass >= size) & ~group["open"]).astype(np.int32)
    group["mass"] = mass
    return group.drop(columns=["bucket"])


def _exchanged(group: pd.DataFrame) -> pd.DataFrame:
    """A source's last fractional document and those that may be exchanged for it."""
    group, size, draws = _ordered(group)
    mass, before = group["mass"].to_numpy().copy(), ((group["mass"] >= group["size"]) & ~group["open"]).to_numpy()
    mass, held = exchange(size, mass, draws, int(group["open"].to_numpy().argmax()))
    group["open"] = np.arange(len(group)) == held
    group["copies"] += ((mass >= size) & ~group["open"]).astype(np.int32) - before.astype(np.int32)
    group["mass"] = mass
    return group


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, fan: int = FAN, pool: int = POOL) -> DataFrame:
    """One row per input row: doc_id, uid, nth, source, size, source_size, target, copies, taken."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    items = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("uid"), F.col("source").cast("string"), words.alias("size"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "uid").orderBy("source"))
    items = stash(items.withColumn("nth", nth).withColumn("place", F.xxhash64("doc_id", "uid", "nth")), "op9-items")
    goal = stash(targets(items, weights, share, cap).withColumnRenamed("source", "_source"), "op9-targets")
    count = goal.count()
    owed = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = items.join(small(goal, count, 200), F.col("source").eqNullSafe(F.col("_source")), "left")
    items = items.withColumn("copies", F.floor(owed + 1e-12).cast("int"))
    items = items.withColumn("mass", F.greatest(F.lit(0.0), owed - F.col("copies")) * F.col("size"))
    items = items.withColumn("open", (F.col("mass") > F.col("size") * 1e-9) & (F.col("mass") < F.col("size") * (1 - 1e-9)))
    columns = [c.split()[0] for c in _ITEM.split(", ")]

    settled = [items.filter("not open").select(columns)]
    level = items.filter("open").select(columns)
    most = level.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    depth = 0
    while most:
        groups = max(1, -(-most // fan))
        bucket = F.pmod(F.xxhash64("place", F.lit(depth)), F.lit(groups))
        done = stash(level.withColumn("bucket", bucket).groupBy("source", "bucket").applyInPandas(_settle, _ITEM), "op9-level")
        settled.append(done.filter("not open"))
        level, most, depth = done.filter("open"), groups if groups > 1 else 0, depth + 1
    out = reduce(DataFrame.unionByName, [*settled, level])
    last = level.select(F.col("source").alias("_source"), F.col("size").alias("_last"))  # a row a source
    words = goal.select(F.col("_source").alias("_of"), F.col("source_size").alias("_words"))
    last = last.join(small(words, count, 200), F.col("_source").eqNullSafe(F.col("_of")))
    out = out.join(small(last, count, 200), F.col("source").eqNullSafe(F.col("_source")), "left")
    near = F.pmod(F.xxhash64("place", F.lit(-2)), F.lit(1 << 30)) * F.col("_words") < F.col("_last") * F.lit(pool * (1 << 30))
    meets = F.coalesce((F.col("size") > 0) & (F.col("size") <= F.col("_last")) & (near | F.col("open")), F.lit(False))
    out = stash(out.withColumn("_meets", meets).select(*columns, "_meets"), "op9-rounded")
    swapped = out.filter("_meets").select(columns).groupBy("source").applyInPandas(_exchanged, _ITEM)
    out = out.filter("not _meets").select(columns).unionByName(swapped)
    chance = F.pmod(F.xxhash64("place", F.lit(-1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = out.withColumn("copies", F.col("copies") + (F.col("open") & (chance * F.col("size") < F.col("mass"))).cast("int"))
    out = out.join(small(goal, count, 200), F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.select("doc_id", "uid", "nth", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, with all their columns."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    copies = mix(docs, **how).filter("copies > 0").select(key.alias("key"), "uid", "nth", "copies")
    rows = packed(docs).withColumns({"key": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))), "uid": F.xxhash64("row.text")})
    nth = F.row_number().over(Window.partitionBy("key", "uid").orderBy("row.source"))
    rows = rows.withColumn("nth", nth).join(copies, ["key", "uid", "nth"])
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


QUERIES = {"op9_mixing": op9_mixing}
SQL: dict[str, str] = {}
