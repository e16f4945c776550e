"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule, piecewise linear over training time 0 to 1.  Its integral is the
source's overall weight, and shares the token budget; targets stop at ``max_epochs`` times the source's
size, and what is above is shared again by weight.  The schedule's running integral, scaled to the
target, is the source's cumulative token demand; a document that covers the tokens from c to c + size of
its source's stream trains at the time where demand reaches c + size / 2.  Inverting a piecewise
quadratic is closed form, so positions need no search.  Rows come back range-sorted by position.

A source's stream is its documents in md5 order, again and again.  Running sums take two steps, over
md5 prefixes and inside one prefix, so a source that holds most rows is still spread over all tasks; there are about as
many prefixes as rows in one.  Rows that agree in id and length have one md5: where they outgrow a prefix, the table is
written with a number for each row, by which such a prefix is dealt into several.

Defined cases: null text has size 0 and is taken with 0 tokens; null source is a source of its own, last
in order; a null id is ordered as an empty one; rows that repeat a document are documents of their own;
an empty table gives no rows; other columns pass through, and a column named like an output gives way.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import WORD, word_count, written

#: (time, weight) knots, in order of time, from 0 to 1.
Schedule = Sequence[tuple[float, float]]
_P = "_quire_"
_OUT = ("size", "source_size", "target", "copies", "taken", "positions", "position")


def ramp(weight: float, slope: float) -> Schedule:
    """A line with mean ``weight`` that goes from weight * (1 - slope) to weight * (1 + slope)."""
    return [(0.0, weight * (1 - slope)), (1.0, weight * (1 + slope))]


def integral(schedule: Schedule) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False))


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, max_epochs: float) -> list[float]:
    """Shares of the budget by weight, none above max_epochs * size; the excess is shared by weight again."""
    order = sorted(range(len(sizes)), key=lambda i: (max_epochs * sizes[i] / weights[i], i))
    left, weight, out = budget, sum(weights), [0.0] * len(sizes)
    for n, i in enumerate(order):
        level = left / weight
        cap = float(max_epochs * sizes[i])
        if cap <= level * weights[i]:
            out[i] = cap
            left -= cap
            weight -= weights[i]
        else:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
    return out


def _invert(share: Column, knots: Column) -> Column:
    """Time at which the scaled running integral reaches ``share`` (0 to 1); knots: (t, w, dw per time, integral before)."""
    k = F.element_at(knots, F.greatest(F.lit(1), F.size(F.filter(knots, lambda x: x["c"] <= share))))
    rest = F.greatest(share - k["c"], F.lit(0.0))
    root = F.sqrt(F.greatest(k["w"] * k["w"] + 2.0 * k["d"] * rest, F.lit(0.0)))
    return F.least(F.lit(1.0), k["t"] + F.when(rest == 0, 0.0).otherwise(2.0 * rest / (k["w"] + root)))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), slopes: Sequence[float] = (0.5, 0.0, -0.5), *, in_order: bool = True, share: float = 1.5, max_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_part: int = 1000) -> DataFrame:
    """All rows with size, source_size, target, copies (times the document is taken), taken, positions (of each copy) and position (of the first; null for none).

    Weights and slopes repeat over the sources in code point order, null last.  One row a source is held
    by the driver; sources are names of collections, not of documents.
    """
    docs = docs.drop(*[c for c in _OUT if c in docs.columns])
    text, source = F.col(text_col), F.col(source_col)
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.octet_length(text), F.lit(0)).cast("string")).cast("binary"))
    # one pass over the texts: bytes and rows by source and the first 16 bits of the order
    sizes_by = docs.select(source.alias("s"), F.conv(F.substring(order, 1, 4), 16, 10).cast("int").alias("p"), word_count(text).alias("b")).groupBy("s", "p").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    coarse = written(sizes_by)
    per = coarse.groupBy("s").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    n_rows = sum(r["n"] for r in per)
    bits = max(1, math.ceil(math.log2(max(2, n_rows / max(rows_per_part, math.isqrt(n_rows))))))
    shift = lambda c: F.shiftright(c, 16 - min(bits, 16)) if bits <= 16 else c
    full = 8 * max(rows_per_part, math.isqrt(n_rows))
    hot = [(r["s"], r["p"]) for r in coarse.groupBy("s", shift(F.col("p")).alias("p")).agg(F.sum("n").alias("n")).filter(F.col("n") > full).collect()] if bits <= 16 else []
    # a part that outgrows the others by far holds rows of one md5, if any does
    dealt = math.ceil(n_rows / full) + 1 if hot else 1
    if hot:
        docs = written(docs.withColumn(f"{_P}row", F.monotonically_increasing_id()))
    sized = docs.withColumn("size", word_count(text))
    per.sort(key=lambda r: (r["s"] is None, r["s"] if isinstance(r["s"], str) else str(r["s"])))
    sizes = [r["b"] for r in per]
    plans = [ramp(weights[i % len(weights)], slopes[i % len(slopes)]) for i in range(len(per))]
    goal = targets(sizes, [integral(p) for p in plans], share * sum(sizes), max_epochs)
    rows = []
    for r, plan, target in zip(per, plans, goal, strict=True):
        total, done, knots = integral(plan), 0.0, []
        for a, b in zip(plan, plan[1:], strict=False):
            knots.append((a[0], a[1] / total, (b[1] - a[1]) / (b[0] - a[0]) / total, done / total))
            done += (b[0] - a[0]) * (a[1] + b[1]) / 2
        full = min(max_epochs, int(target // r["b"])) if r["b"] else 0
        rows.append((r["s"], r["b"], target, full, target - full * r["b"], knots))
    knot = T.StructType([T.StructField(c, T.DoubleType()) for c in "twdc"])
    plan = docs.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField(f"{_P}s", docs.schema[source_col].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField(f"{_P}full", T.IntegerType()), T.StructField(f"{_P}rest", T.DoubleType()), T.StructField(f"{_P}knots", T.ArrayType(knot)),
    ]))
    # one key that is never null: the running sum and the join below deal rows out alike, so they move once
    number = shift(F.conv(F.substring(f"{_P}order", 1, 4), 16, 10).cast("int")) if bits <= 16 else F.shiftright(F.conv(F.substring(f"{_P}order", 1, 8), 16, 10).cast("long"), max(0, 32 - bits))
    keyed = sized.withColumns({f"{_P}order": order, f"{_P}tie": F.xxhash64(text)}).withColumn(f"{_P}p", number)
    if hot:
        where = docs.sparkSession.createDataFrame(hot, T.StructType([T.StructField(f"{_P}s", docs.schema[source_col].dataType), T.StructField(f"{_P}hot", T.IntegerType())]))
        is_hot = keyed[source_col].eqNullSafe(where[f"{_P}s"]) & (keyed[f"{_P}p"] == where[f"{_P}hot"])
        lane = F.when(F.col(f"{_P}hot").isNotNull(), F.pmod(F.xxhash64(f"{_P}row"), F.lit(dealt))).otherwise(0)
        keyed = keyed.join(F.broadcast(where), is_hot, "left").withColumn(f"{_P}lane", lane).drop(f"{_P}s", f"{_P}hot", f"{_P}row")
    else:
        keyed = keyed.withColumn(f"{_P}lane", F.lit(0).cast("long"))
    part = lambda c: F.concat_ws(":", F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")), F.col(f"{_P}p").cast("string"), F.col(f"{_P}lane").cast("string"))
    keyed = keyed.withColumn(f"{_P}part", part(source))
    if hot or bits > 16:
        parts = keyed.groupBy(source.alias(f"{_P}s"), f"{_P}p", f"{_P}lane").agg(F.sum("size").alias(f"{_P}part_size"))
    else:
        parts = coarse.groupBy(F.col("s").alias(f"{_P}s"), shift(F.col("p")).alias(f"{_P}p")).agg(F.sum("b").alias(f"{_P}part_size")).withColumn(f"{_P}lane", F.lit(0).cast("long"))
    before = Window.partitionBy(f"{_P}s").orderBy(f"{_P}p", f"{_P}lane").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(part(F.col(f"{_P}s")).alias(f"{_P}part"), F.coalesce(F.sum(f"{_P}part_size").over(before), F.lit(0)).alias(f"{_P}before"))
    inside = Window.partitionBy(f"{_P}part").orderBy(f"{_P}order", id_col, f"{_P}tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(f"{_P}inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, f"{_P}part")
    placed = placed.join(F.broadcast(plan), placed[source_col].eqNullSafe(plan[f"{_P}s"]), "left")
    middle = F.col(f"{_P}before") + F.col(f"{_P}inside") + F.col("size") / F.lit(2.0)
    extra = (middle <= F.col(f"{_P}rest")) & (F.col("size") > 0)
    passes = F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda k: k.cast("double"))
    reached = lambda k: F.least((middle + k * F.col("source_size")) / F.col("target"), F.lit(1.0))
    times = F.transform(F.filter(passes, lambda k: k < F.col("copies")), lambda k: F.round(_invert(reached(k), F.col(f"{_P}knots")), 9))
    out = (
        placed.withColumn("copies", (F.col(f"{_P}full") + extra.cast("int")).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumn("positions", times)
        .withColumn("position", F.get("positions", F.lit(0)))
        .drop(*[f"{_P}{c}" for c in ("s", "full", "rest", "knots", "order", "tie", "p", "lane", "part", "before", "inside")])
    )
    return out.orderBy("position", id_col) if in_order else out


def repeated(docs: DataFrame, *args, **options) -> DataFrame:
    """A row for each copy that the mix takes, range-sorted by its own position; arguments as for mix."""
    mixed = mix(docs, *args, in_order=False, **options)
    return mixed.withColumn("position", F.explode("positions")).orderBy("position")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents, mixed with weights 3, 1, 2 to 150 % of all words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(strlen(text), 0)::VARCHAR)) AS o
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS b FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1, 2][1 + i % 3] AS w, [0.5::DOUBLE, 0, -0.5][1 + i % 3] AS a FROM k),
c AS (
  SELECT *, 2.0::DOUBLE * b AS cap,
         1.5::DOUBLE * sum(b) OVER () - coalesce(sum(2.0::DOUBLE * b) OVER (ORDER BY 2.0::DOUBLE * b / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS money,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * b / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w),
l AS (SELECT *, cap <= money / ws * w AS capped FROM c),
v AS (SELECT arg_min(money / ws, (cap / w, i)) FILTER (WHERE NOT capped) AS level FROM l),
t AS (SELECT l.source, l.b, l.w, l.a, CASE WHEN capped THEN cap ELSE level * w END AS target FROM l, v),
e AS (SELECT *, CASE WHEN b > 0 THEN least(2, floor(target / b)) ELSE 0 END AS full_passes FROM t),
p AS (
  SELECT d.doc_id, d.size, e.b, e.target, e.full_passes, e.a,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
q AS (
  SELECT *, (full_passes + CASE WHEN middle <= target - full_passes * b AND size > 0 THEN 1 ELSE 0 END)::INT AS copies,
         CASE WHEN target > 0 THEN least(middle / target, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS y
  FROM p)
SELECT doc_id, size, b AS source_size, target, (copies * size)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN round(least(1.0::DOUBLE, CASE WHEN y = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * y / ((1 - a) + sqrt(greatest((1 - a) * (1 - a) + 2.0::DOUBLE * (2.0::DOUBLE * a) * y, 0))) END), 9) END AS position
FROM q
"""
