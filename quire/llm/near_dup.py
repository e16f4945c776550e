"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A first permutation places each word shingle on a ring of 2**32 places.  Coordinate k of a signature is
the least value of a second permutation over the set, read with the ring turned by k: two permutations
give every coordinate.  Bands of ``rows`` coordinates, ``bands`` of them, bring together all but some
5e-7 of the pairs at the threshold.

Equal sets are one node.  Nodes that share a band are not paired with each other: each is compared with
the band's leader, the member that shares most bands with most nodes.  What is linked to the leader
needs no further comparison; then leaders of the other bands follow, and last, only inside bands that
still hold several components, the members of different components, unless the shingles that a member has
alone leave too few to share.  So a band of n copies costs about n comparisons, and no link is given up.  Every link is confirmed on the full shingle sets.  Components are
found by hooking and pointer jumping over tables; neither links nor components come to the driver.

Defined cases: null, empty and white-space texts have an empty set and are linked with nothing; a text
with fewer words than a shingle is one shingle; a null id can be linked, and the component's id is its
smallest id that is not null (null if there is none); rows that repeat an id and a text are one
document, of which ``dedupe`` keeps one row, and rows with one id and different texts are documents of
their own; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import WORD, drop_written, mix64, text_bytes, window_hashes, word_bounds, word_hashes, written

_U, _V = np.uint64, np.uint32
#: Holders up to which a shingle counts as rare, and members above which a band counts as large.  Neither drops a pair.
FEW, LARGE = 8, 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles."""
    start, end, doc = word_bounds(data, offsets)
    words = word_hashes(data, start, end, lower=True)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    rolled, _ = window_hashes(words, doc, width)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = _U(b - a)
            for w in words[a:b]:
                short = mix64(np.array([short ^ w]), 0x5151)[0]
            out.append(np.array([short]))
        else:
            out.append(np.zeros(0, _U))
    return out


def _second(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit integers, written to ``out``."""
    np.right_shift(x, _V(16), out=out)
    np.bitwise_xor(x, out, out=out)
    np.multiply(out, _V(0x85EBCA6B), out=out)
    np.right_shift(out, _V(13), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, _V(0xC2B2AE35), out=out)
    np.right_shift(out, _V(16), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(sets: list[np.ndarray], n: int, block: int = 1 << 15) -> np.ndarray:
    """n coordinates of each non-empty set."""
    out = np.empty((len(sets), n), _V)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= block):
            size += len(sets[j])
            j += 1
        ring = (mix64(np.concatenate(sets[i:j]), 0xC1C) >> _U(32)).astype(_V)
        starts = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        turned, value, spare = np.empty_like(ring), np.empty_like(ring), np.empty_like(ring)
        for k in range(n):
            np.add(ring, _V(k), out=turned)
            out[i:j, k] = np.minimum.reduceat(_second(turned, value, spare), starts)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), _U) + np.arange(1, bands + 1, dtype=_U)
    for r in range(rows):
        keys = mix64(keys ^ signature[:, r::rows][:, :bands].astype(_U), 0xBA2D)
    return keys


def bands_for(threshold: float, rows: int = 6, miss: float = 5e-7) -> int:
    """Bands that a pair at the threshold escapes with chance ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def node_of(s: np.ndarray) -> int:
    """A number of the set itself: 64 bits of its size and the sum of its mixed hashes."""
    return int(mix64(np.array([mix64(s, 0x5E7).sum(dtype=_U)]), len(s)).view(np.int64)[0])


def _blocks(column, width: int, step: int = 2 << 20) -> Iterator[list[np.ndarray]]:
    data, offsets = text_bytes(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        yield shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        i = j


def _described(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, th (hash of the text), n (size of the set), node and band keys (null for an empty set)."""
    schema = T.StructType([docs.schema["id"], T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nodes, keys = [], [], []
            for sets in _blocks(b.column("text"), width):
                full = [s for s in sets if len(s)]
                made = iter(band_keys(signatures(full, bands * rows), bands, rows).view(np.int64)) if full else iter(())
                n += [len(s) for s in sets]
                nodes += [node_of(s) if len(s) else None for s in sets]
                keys += [next(made) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, set) of the wanted (id, th, node): only their texts are read again."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set", T.BinaryType())])
    w = wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "node")
    texts = docs.join(w, (docs["th"] == w["_th"]) & docs["id"].eqNullSafe(w["_id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [s.tobytes() for sets in _blocks(b.column("text"), width) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(raw, pa.binary())], names=schema.names)

    return texts.mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every linked node: comp is the least node that it reaches.

    Each round hooks every root to the least neighbouring root and then halves all paths, so the rounds grow with
    the logarithm of a component's diameter.  Tables are written between rounds.
    """
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parent = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        p, q = parent, parent.select(F.col("node").alias("b"), F.col("comp").alias("pb"))
        near = both.join(p.withColumnRenamed("node", "a"), "a").join(q, "b").filter("pb < comp").groupBy(F.col("comp").alias("node")).agg(F.min("pb").alias("hook"))
        hooked = p.join(near, "node", "left").select("node", F.least("comp", F.coalesce("hook", "comp")).alias("comp"))
        up = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("c2"))
        jumped = written(hooked.join(up, "comp").select("node", F.col("c2").alias("comp"), (F.col("c2") != F.col("comp")).alias("moved")))
        old = parent.withColumnRenamed("comp", "was")
        changed = jumped.join(old, "node").filter("was != comp").limit(1).count()
        drop_written(parent)
        parent = jumped.drop("moved")
        parent._quire_path = jumped._quire_path
        if not changed:
            drop_written(both)
            return parent


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after new links between nodes."""
    if comps is None:
        return components(links)
    old = comps.withColumnRenamed("comp", "old")
    a = links.join(old.withColumnRenamed("node", "a"), "a", "left").withColumn("a2", F.coalesce("old", "a")).drop("old")
    ab = a.join(old.withColumnRenamed("node", "b"), "b", "left").withColumn("b2", F.coalesce("old", "b"))
    moved = components(ab.select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    ends = old.select("node", F.col("old").alias("mid")).unionByName(moved.select("node", F.col("node").alias("mid"))).distinct()
    top = moved.select(F.col("node").alias("mid"), "comp")
    # a node that new links touch stands under its old component, which may have moved
    first = ends.groupBy("node").agg(F.min("mid").alias("mid"))
    out = written(first.join(top, "mid", "left").select("node", F.coalesce("comp", "mid").alias("comp")))
    drop_written(comps, moved)
    return out


def link(docs: DataFrame, *, width: int = 5, percent: int = 80, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(id, th, n, node of every row; node and comp of every linked node, or None)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    bands = bands_for(percent / 100, rows)
    described = written(_described(base, width, bands, rows))
    nodes = described.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "th")).alias("r"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    exploded = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = exploded.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    member = written(exploded.join(shared, F.col("key") == F.col("k")).select("key", "node", "n", "c"))
    if not member.limit(1).count():
        drop_written(member)
        return described, None
    score = member.groupBy("node").agg(F.sum("c").alias("score"))
    # written, so that the join below is on exchanged rows alone and a band with very many members can be split over tasks
    leader = written(member.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("lead")))
    led = written(member.join(leader, "key").filter("node != lead.node").select(F.col("node").alias("a"), F.col("lead.node").alias("b"), "lead.score", F.col("n").alias("na"), F.col("lead.n").alias("nb")).groupBy("a", "b").agg(F.max("score").alias("score"), F.max("na").alias("na"), F.max("nb").alias("nb")))
    drop_written(leader)
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    some = member.select("node").distinct()
    reps = described.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "th")).alias("r")).join(some, "node").select("r.id", "r.th", "node")
    sets = _sets(base, reps, width)
    sets = written(sets.groupBy("node").agg(F.first("set").alias("set")) if _repeats(described) else sets)

    first = led.filter(fits).groupBy("a").agg(F.max_by(F.struct("b", "na", "nb"), F.struct("score", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    first = written(first)
    links = written(_confirmed(first, sets, percent))
    comps = components(links) if links.limit(1).count() else None
    drop_written(links)

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components yet."""
        if comps is None:
            return pairs
        x = pairs.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
        x = x.join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        return x.filter("coalesce(ca, a) != coalesce(cb, b)").drop("ca", "cb")

    second = written(apart(led.filter(fits).select("a", "b").join(first, ["a", "b"], "left_anti")))
    if second.limit(1).count():
        links = written(_confirmed(second, sets, percent))
        if links.limit(1).count():
            comps = _merged(comps, links)
        drop_written(links)
    # bands that still hold several components: members of different ones
    at = member.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else member.withColumn("comp", F.col("node"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    left = written(at.join(mixed, "key", "left_semi").select("key", "node", "n", "comp"))
    if not left.limit(1).count():
        drop_written(member, led, sets, first, second, left)
        return described, comps
    # what a node shares with another is at most what isn't its own alone: most pairs fall to this before they are made
    some = left.select("node", "n").distinct()
    alone = _holders(sets.join(some, "node", "left_semi")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("few"))
    able = some.join(alone, "node", "left").withColumn("o", F.col("n") - F.coalesce("few", F.lit(0))).filter(f"100 * o >= {percent} * n")
    left2 = left.join(able.select("node", "o"), "node")
    # a pair is made in the least band that it shares, not in each
    left2 = written(left2.join(left2.groupBy("node").agg(F.collect_list("key").alias("keys")), "node"))
    # in large bands the bound also leaves out shingles with few holders; pairs that share one of those are made from it
    large = left2.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > LARGE).select("key")
    crowd = written(left2.join(large, "key", "left_semi").select("node", "n", "comp").distinct())
    rare = written(_holders(sets.join(crowd, "node", "left_semi")).filter(F.col("c") <= FEW))
    bound = crowd.join(rare.groupBy("node").agg(F.count(F.lit(1)).alias("few")), "node", "left").select("node", (F.col("n") - F.coalesce("few", F.lit(0))).alias("strict"))
    left3 = left2.join(large.withColumn("big", F.lit(True)), "key", "left").join(bound, "node", "left").withColumn("o", F.when(F.col("big"), F.col("strict")).otherwise(F.col("o")))
    x = left3.select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("o").alias("oa"), F.col("keys").alias("ka"))
    y = left3.select("key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("o").alias("ob"), F.col("keys").alias("kb"))
    reach = f"100 * least(oa, ob) >= {percent} * (na + nb - least(oa, ob))"
    cross = x.join(y, "key").filter(f"ca < cb AND {reach} AND array_min(array_intersect(ka, kb)) = key").select("a", "b")
    held = rare.filter("c > 1").join(crowd, "node")
    u, v = held.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca")), held.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    cross = cross.unionByName(u.join(v, "shingle").filter(f"ca < cb AND {fits}").select("a", "b")).distinct()
    tested = led.select("a", "b").unionByName(led.select(F.col("b").alias("a"), F.col("a").alias("b")))
    third = written(cross.join(tested, ["a", "b"], "left_anti"))
    if third.limit(1).count():
        links = written(_confirmed(third, sets, percent))
        if links.limit(1).count():
            comps = _merged(comps, links)
        drop_written(links)
    drop_written(member, led, sets, first, second, left, left2, crowd, rare, third)
    return described, comps


def _holders(sets: DataFrame) -> DataFrame:
    """(shingle, c, node) of the shingles that at most FEW of the sets have; a row for each holder."""
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("node", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                each = [np.frombuffer(x.as_py(), np.int64) for x in part.column("set")]
                nodes = np.repeat(part.column("node").to_numpy(), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), pa.array(nodes)], names=schema.names)

    rows = sets.select("node", "set").mapInArrow(run, schema)
    # only the first few holders are kept while counting, so that a common shingle costs no more than a rare one
    w = Window.partitionBy("shingle").orderBy("node")
    first = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= FEW + 1)
    per = first.groupBy("shingle").agg(F.max("r").alias("c"), F.collect_list("node").alias("nodes")).filter(F.col("c") <= FEW)
    return per.select("shingle", "c", F.explode("nodes").alias("node"))


def _repeats(described: DataFrame) -> bool:
    return described.groupBy("id", "th").count().filter("count > 1").limit(1).count() > 0


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_shingles, component_id (smallest id reachable) and kept."""
    described, comps = link(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    of_node = described.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    if comps is not None:
        placed = of_node.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        of_comp = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
        of_node = placed.join(of_comp, "comp").select("node", "component_id")
    else:
        of_node = of_node.withColumnRenamed("least", "component_id")
    out = described.join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def dedupe(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with the columns it came with: the smallest id, null last."""
    described, comps = link(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    full = described.filter("node IS NOT NULL")
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("th"))
    of_node = full.groupBy("node").agg(F.min(rank).alias("r"))
    if comps is not None:
        of_node = of_node.join(comps, "node", "left").groupBy(F.coalesce("comp", "node").alias("node")).agg(F.min("r").alias("r"))
    kept = of_node.select(F.col("r.id").alias("_quire_id"), F.col("r.th").alias("_quire_th"))
    empty = described.filter("node IS NULL").select(F.col("id").alias("_quire_id"), F.col("th").alias("_quire_th")).distinct()
    kept = kept.unionByName(empty)
    keyed = docs.withColumn("_quire_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = keyed.join(kept, keyed[id_col].eqNullSafe(kept["_quire_id"]) & (keyed["_quire_h"] == kept["_quire_th"]), "left_semi")
    if _repeats(full):
        spaces = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", "")) == ""
        out = out.filter(~spaces).dropDuplicates([id_col, "_quire_h"]).unionByName(out.filter(spaces))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: groups of documents whose sets of three-word shingles have 85 % or more in common."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=3, percent=85)


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id
"""
