"""Sharding by sampled splitters, with DataFrame functions alone.

Records are ordered by (hash of the group, hash of the record).  A sample of these keys, drawn with
chance in proportion to a record's size, gives the splitters: its quantiles.  They cut the key space
into many fine ranges.  A group (equal texts) that several sampled keys fall into is large, and is cut
inside; any other group stays whole in one range.  Ranges that come out overfull are sampled again and subdivided,
and this is repeated until every overfull range holds a single key.  Ranges in key order then fill the shards up to
equal bytes.

Rows that agree in all columns have one key, which no splitter cuts.  Where they outgrow a range, they are counted,
cut into blocks by their number, which the shards take like ranges, and made anew from the count: being
equal, it doesn't matter which of them goes where.  So neither one task nor one shard gets them all.

Defined cases: a null text has size ``overhead`` and forms the group of null texts; a null id is a value
as any other; repeated rows are rows of their own, cut over shards if there are many; an empty table gives no rows; other
columns pass through (their values are part of the key), ``shard`` and ``slot`` give way to the operator's own, and
working columns have names that start with ``_quire_``.  Shards are the same in each run over the same files.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_P = "_quire_"
_KEY = T.StructType([T.StructField("g", T.LongType()), T.StructField("r", T.LongType())])
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
Key = tuple[int, int]


def record_size(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of the text, none for null, plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def _after(key: Key) -> Key:
    """The next key in order."""
    g, r = key
    return (g, r + 1) if r < _MOST else (min(g + 1, _MOST), _LEAST)


def _splitters(sample: list[Key], every: int) -> list[Key]:
    """Each ``every``-th sampled key; it moves to its group's start unless the group is as large as a range.

    A key drawn so often that it fills a range gets a splitter behind it, too.
    """
    sample.sort()
    out = []
    for i in range(every, len(sample), every):
        g, r = sample[i]
        first = bisect_left(sample, (g, _LEAST))
        inside = i - first >= every
        out.append((g, r) if inside else (g, _LEAST))
        if sample[i] == sample[i - every]:
            out += [sample[i], _after(sample[i])]
    return sorted(set(out))


def _in_range(keyed: DataFrame, splitters: list[Key]) -> DataFrame:
    """Adds the number of splitters at or below the key, found in two steps through a table of bounded size."""
    spark = keyed.sparkSession
    width = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[i : i + width] for i in range(0, len(splitters), width)]
    top = F.lit([b[0][0] for b in blocks[1:]]).cast("array<bigint>"), F.lit([b[0][1] for b in blocks[1:]]).cast("array<bigint>")
    tops = F.arrays_zip(top[0].alias("g"), top[1].alias("r"))
    key = F.col(f"{_P}key")
    below = lambda s: (s["g"] < key["g"]) | ((s["g"] == key["g"]) & (s["r"] <= key["r"]))
    table = spark.createDataFrame(
        [(i, i * width, [tuple(s) for s in b]) for i, b in enumerate(blocks or [[]])],
        T.StructType([T.StructField(f"{_P}block", T.IntegerType()), T.StructField(f"{_P}base", T.IntegerType()), T.StructField(f"{_P}splits", T.ArrayType(_KEY))]),
    )
    block = F.size(F.filter(tops, below)) if len(blocks) > 1 else F.lit(0)
    return (
        keyed.withColumn(f"{_P}block", block)
        .join(F.broadcast(table), f"{_P}block")
        .withColumn(f"{_P}range", F.col(f"{_P}base") + F.size(F.filter(F.col(f"{_P}splits"), below)))
        .drop(f"{_P}block", f"{_P}base", f"{_P}splits")
    )


def _sample(keyed: DataFrame, expected: int, total: int) -> list[Key]:
    """About ``expected`` keys, each row drawn with chance in proportion to its size.

    The draw depends on the key and on the row's place in the files, so that of equal rows their share is drawn.
    """
    draw = F.pmod(F.xxhash64(f"{_P}key", F.monotonically_increasing_id(), F.lit(7)), F.lit(1 << 52)) / float(1 << 52)
    rows = keyed.withColumn(f"{_P}draw", draw * total).filter(F.col(f"{_P}draw") < F.col(f"{_P}size") * float(expected)).select(f"{_P}key.g", f"{_P}key.r").collect()
    return [(r["g"], r["r"]) for r in rows]


def _ranges(keyed: DataFrame, splitters: list[Key]) -> dict[int, tuple[int, int, Key | None]]:
    """Bytes and rows of each fine range, and a key that divides it, None if it holds one key; as many rows as ranges come back."""
    part = lambda f, c: f(f"{_P}key.{c}").alias(f"{f.__name__}_{c}")
    ends = [part(f, c) for f in (F.min, F.max) for c in "gr"]
    rows = _in_range(keyed, splitters).groupBy(f"{_P}range").agg(F.sum(f"{_P}size").alias("b"), F.count(F.lit(1)).alias("n"), *ends).collect()
    middle = lambda r: (r["max_g"], _LEAST) if r["min_g"] < r["max_g"] else (r["max_g"], r["max_r"]) if r["min_r"] < r["max_r"] else None
    return {r[f"{_P}range"]: (r["b"], r["n"], middle(r)) for r in rows}


def _cut(narrow: DataFrame, fine: int, draws: int, total: int, limit: float) -> tuple[list[Key], dict[int, tuple[int, int, Key | None]]]:
    """Splitters, and what their ranges hold, such that an overfull range holds one key."""
    splitters = _splitters(_sample(narrow, fine * draws, max(total, 1)), draws)
    found, density = _ranges(narrow, splitters), fine * draws
    while over := sorted(k for k, (b, _, middle) in found.items() if b > limit and middle):
        density *= 4
        rows = _in_range(narrow, splitters).filter(F.array_contains(F.lit(over), F.col(f"{_P}range"))).drop(f"{_P}range")
        # with their middles, each round divides every overfull range
        splitters = sorted({*splitters, *_splitters(_sample(rows, density, total), draws), *(found[k][2] for k in over)})
        found = _ranges(narrow, splitters)
    return splitters, found


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, ranges_per_shard: int = 64, draws_per_range: int = 8) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (gapless from 0 in each shard).

    The driver holds some shards * ranges_per_shard * draws_per_range sampled keys, whatever the input.
    """
    docs = docs.drop(*[c for c in ("shard", "slot") if c in docs.columns])
    columns = docs.columns
    text, key_id = F.col(text_col), F.col(id_col)
    others = [F.col(c) for c in columns if c not in (id_col, text_col)]
    keyed = docs.withColumns({
        f"{_P}size": record_size(text, overhead),
        f"{_P}key": F.struct(F.xxhash64(text, F.lit(1)).alias("g"), F.xxhash64(key_id, F.length(text), *others, F.lit(2)).alias("r")),
    })
    narrow = keyed.select(f"{_P}size", f"{_P}key").persist()
    try:
        total, largest = narrow.agg(F.sum(f"{_P}size"), F.max(f"{_P}size")).first()
        total = total or 0
        fine = shards * ranges_per_shard
        limit = max(2 * total / fine, largest or 0)
        splitters, found = _cut(narrow, fine, draws_per_range, total, limit)
    finally:
        narrow.unpersist()
    plan, blocks, filled, rows_in = [], [], 0, [0] * shards

    def take(b: int, n: int) -> tuple[int, int]:
        """The shard of the next n rows of b bytes, and their first slot in it."""
        nonlocal filled
        to = min(shards - 1, int((filled + b / 2) * shards / max(total, 1)))
        filled += b
        rows_in[to] += n
        return to, rows_in[to] - n

    for k in sorted(found):
        b, n, _ = found[k]
        if b <= limit:
            plan.append((k, *take(b, n)))
            continue
        # cut where shards end, so that they fill up evenly, and where a block would outgrow a range
        pieces, each = min(n, math.ceil(b / limit)), total / shards
        edges = {i * n // pieces for i in range(pieces + 1)}
        edges |= {round((s * each - filled) * n / b) for s in range(int(filled / each), int((filled + b) / each) + 1)}
        edges = sorted(e for e in edges if 0 <= e <= n)
        for start, end in zip(edges, edges[1:], strict=False):
            blocks.append((k, start, end, *take(b * end // n - b * start // n, end - start)))
    ranged = _in_range(keyed, splitters)
    places = docs.sparkSession.createDataFrame(plan, T.StructType([T.StructField(f"{_P}range", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField(f"{_P}from", T.LongType())]))
    order = Window.partitionBy(f"{_P}range").orderBy(f"{_P}key")
    out = ranged.join(F.broadcast(places), f"{_P}range").withColumn("slot", F.col(f"{_P}from") + F.row_number().over(order) - 1).select(*columns, "shard", "slot")
    return out.unionByName(_counted(ranged, columns, blocks)) if blocks else out


def _counted(ranged: DataFrame, columns: list[str], blocks: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The rows of ranges that hold one key, from counts: (range, first row, end, shard, first slot) of each block."""
    cut = ranged.sparkSession.createDataFrame(blocks, T.StructType([
        T.StructField(f"{_P}range", T.IntegerType()), T.StructField(f"{_P}start", T.LongType()), T.StructField(f"{_P}end", T.LongType()),
        T.StructField("shard", T.IntegerType()), T.StructField(f"{_P}from", T.LongType()),
    ]))
    hot = ranged.join(F.broadcast(cut.select(f"{_P}range").distinct()), f"{_P}range", "left_semi")
    per = hot.groupBy(f"{_P}range", *columns).agg(F.count(F.lit(1)).alias(f"{_P}n"))
    # one row in nearly every range; more only where keys of different rows collide
    before = Window.partitionBy(f"{_P}range").orderBy(F.xxhash64(*columns), *columns).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(f"{_P}before", F.coalesce(F.sum(f"{_P}n").over(before), F.lit(0)))
    both = per.join(F.broadcast(cut), f"{_P}range").withColumns({
        f"{_P}a": F.greatest(f"{_P}start", f"{_P}before"), f"{_P}z": F.least(f"{_P}end", F.col(f"{_P}before") + F.col(f"{_P}n")),
    }).filter(F.col(f"{_P}a") < F.col(f"{_P}z"))
    # blocks are dealt out before their rows are made
    both = both.repartition(F.col(f"{_P}range"), F.col(f"{_P}start"))
    at = F.explode(F.sequence(F.col(f"{_P}a"), F.col(f"{_P}z") - 1)).alias(f"{_P}at")
    return both.select(*columns, "shard", f"{_P}from", f"{_P}start", at).select(*columns, "shard", (F.col(f"{_P}from") + F.col(f"{_P}at") - F.col(f"{_P}start")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document's shard under the law of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(docs.withColumns({"size": record_size(F.col("text")), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))}), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
