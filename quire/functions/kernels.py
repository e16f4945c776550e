"""Grouping kernels over arrays and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: the optimiser copies a projected expression to each use, but not a generated one."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


GROUPS = "array<struct<total: double, n: int, members: array<int>>>"


def clusters(keys: Column, tolerance: Column) -> Column:
    """Greedy one-dimensional clusters: each key joins the first cluster whose mean is within the tolerance.

    ``keys``: sorted array of doubles.  Gives (total, n, members: indexes into keys) in order of creation.
    The fold stays in the JVM; it costs keys times clusters, so it is meant for one page's lines.
    """

    def place(state: Column, x: Column, tolerance: Column) -> Column:
        return let(F.array_position(F.transform(state["g"], lambda g: F.abs(x - g["total"] / g["n"]) <= tolerance), F.lit(True)).cast("int"), lambda near: put(state, x, near))

    def put(state: Column, x: Column, near: Column) -> Column:
        grown = F.transform(
            state["g"],
            lambda g, i: F.when(i + 1 == near, F.struct((g["total"] + x).alias("total"), (g["n"] + 1).alias("n"), F.concat(g["members"], F.array(state["i"])).alias("members"))).otherwise(g),
        )
        fresh = F.concat(state["g"], F.array(F.struct(x.alias("total"), F.lit(1).alias("n"), F.array(state["i"]).alias("members"))))
        return F.struct(F.when(near > 0, grown).otherwise(fresh).cast(GROUPS).alias("g"), (state["i"] + 1).alias("i"))

    start = F.struct(F.array().cast(GROUPS).alias("g"), F.lit(0).alias("i"))
    return let(tolerance, lambda t: F.aggregate(keys, start, lambda s, x: place(s, x, t), lambda s: s["g"]))


def median(values: Column) -> Column:
    """Median of an array; the mean of the middle two for an even count, null for none."""
    s, n = F.array_sort(values), F.size(values)
    low = F.element_at(s, ((n + 1) / 2).cast("int"))
    high = F.element_at(s, (n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def take_until(items: Column, stop) -> Column:
    """Leading items before the first for which ``stop`` holds."""
    at = F.array_position(F.transform(items, lambda x: F.coalesce(stop(x), F.lit(False))), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(items, 1, at - 1)).otherwise(items)


def nearest_rank(values: Column, percent: float) -> Column:
    """The sorted value at round-half-even(percent / 100 * (n - 1)), two decimals; 0 for none."""
    n = F.size(values)
    at = F.bround(F.lit(percent / 100) * (n - 1)).cast("int") + 1
    return F.when(n > 0, F.bround(F.element_at(F.array_sort(values), at), 2)).otherwise(F.lit(0.0))
