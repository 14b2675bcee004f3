"""Exact percentiles of any number of values, of all rows or by key, in two passes that Spark combines map-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.storage import stash

#: A sketch's ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def beside(rows: DataFrame, table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the columns of a table of one row, or of one row for each key ``by`` (a null key meets a null key; nulls where a
    key has none).  One row is broadcast; a table by key is as Spark's own measure of it decides, but ``rows`` never are: their
    columns of signals weigh far more than Spark takes them to, so no later filter may turn the outer join into an inner one, of
    which Spark broadcasts the side that it takes to be smaller.  That is what the condition on the table's columns is for."""
    if not by:
        return rows.crossJoin(F.broadcast(table))
    table = table.withColumnsRenamed({k: f"_{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    own, met = [c for c in table.columns if c not in {f"_{k}" for k in by}], reduce(Column.__and__, same)
    return rows.join(table, same, "left").withColumns({c: F.when(met, F.col(c)) for c in own}).drop(*[f"_{k}" for k in by])


def percentiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]], by: Sequence[str] = (), also: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """One row, or one for each key ``by``: for each name the percentile (0 to 1) of a column's non-null values, interpolated linearly
    between the two nearest; null without values.  ``also`` has other aggregates of columns (a column and a function of it).

    The columns are computed once and written, narrow as they are, so what they come from runs once.  A first pass over them brackets
    each percentile with a sketch whose error is bounded, and counts.  The second counts what lies below a
    bracket and at its two ends, and gathers what lies strictly between, which is some 6 / ACCURACY of a key's values at most
    (what is repeated more often than that is an end itself).  Both are combined before they are shuffled, so a key may have any share of the rows.
    Those by key are written, a row a key, so that Spark knows how small they are.
    """
    names, also, by = list(wanted), also or {}, list(by)
    values = rows.select(*by, *[x.cast("double").alias(n) for n, (x, _) in wanted.items()], *[x.alias(f"{n}_of") for n, (x, _) in also.items()])
    values = stash(values, "values")
    first = [f(F.col(f"{n}_of")).alias(n) for n, (_, f) in also.items()]
    for n, (_, p) in wanted.items():
        edges = [max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)]
        first += [F.percentile_approx(n, edges, ACCURACY).alias(f"{n}_edges"), F.count(n).alias(f"{n}_count")]
    bracket = values.groupBy(*by).agg(*first)
    both = beside(values.select(*by, *names), bracket, by)
    second = [F.any_value(n).alias(n) for n in also]
    for n in names:
        x, low, high = F.col(n), F.col(f"{n}_edges")[0], F.col(f"{n}_edges")[1]
        inside = F.when((x > low) & (x < high), x)
        second += [F.count_if(x < low).alias(f"{n}_below"), F.count_if(x == low).alias(f"{n}_at"), F.sort_array(F.collect_list(inside)).alias(f"{n}_mid")]
        second += [F.max(F.when(x < low, x)).alias(f"{n}_under"), F.min(F.when(x > high, x)).alias(f"{n}_over"), F.count_if((x == high) & (high > low)).alias(f"{n}_top")]
        second += [F.any_value(low).alias(f"{n}_low"), F.any_value(high).alias(f"{n}_high"), F.any_value(F.col(f"{n}_count")).alias(f"{n}_count")]
    one = both.groupBy(*by).agg(*second)

    def at(n: str, rank: Column) -> Column:
        """The value of a rank; a sketch's rank may be one off besides, as it counts from 1."""
        k = rank - F.col(f"{n}_below")
        m = k - F.col(f"{n}_at")
        low = F.when(k < 0, F.col(f"{n}_under")).when(m < 0, F.col(f"{n}_low"))
        high = F.when(m - F.size(f"{n}_mid") < F.col(f"{n}_top"), F.col(f"{n}_high")).otherwise(F.col(f"{n}_over"))
        return low.when(m < F.size(f"{n}_mid"), F.get(f"{n}_mid", m.cast("int"))).otherwise(high)

    out = []
    for n, (_, p) in wanted.items():
        place = F.lit(float(p)) * (F.col(f"{n}_count") - 1)
        rank = F.floor(place)
        a, b = at(n, rank), at(n, F.ceil(place))
        out.append(F.when(F.col(f"{n}_count") > 0, a + (b - a) * (place - rank)).alias(n))
    found = one.select(*by, *out, *also)
    return stash(found, "percentiles") if by else found
