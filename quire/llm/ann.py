"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Vectors are first reduced to distinct ones, each with its k + 1 smallest ids: equal vectors tie, ties go to the smaller
id, so no other id can be an answer.  Centroids and codebooks are fitted by k-means on a sample of these, chosen by a
hash: ``fit_rows`` of them, or 16 for each centroid if that is more.  There are 2 * sqrt(n) cells.  Every vector is
indexed: it goes to its nearest centroid, and its residual is coded as the nearest codeword of each subspace.

A query visits the cells whose centroids have the largest inner product with it: as many as brought ``target`` of the
true neighbours on the sample (so few where vectors cluster, many where they don't), and in any case so many
that they hold k candidates.  In a cell, tables of inner products between the query's parts and the codewords
rank all codes, and the best ``rerank`` are scored exactly, in double precision, on the vectors themselves.
So are all others of the part that could still be among the k: those whose rank value lies no further below the
k-th exact score than the largest error that the exact scores of this query and part have shown.

Small cells share a part, a large one is dealt over several, and queries are dealt into blocks; one task joins one part
of at most ``part_rows`` vectors with one block of about ``block_rows`` queries, whatever the input.

Defined cases: null or empty vectors, vectors of another length than the commonest, zero vectors and
vectors with a null or non-finite component take no part; null ids take no part, and ids must be of a whole-number type;
rows that repeat an id and a vector are one, an id with several vectors can be found by each; fewer candidates than k
give all of them; a query without any gives no row; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import one_thread, whole_ids, written

_F = np.float32


def nearest(x: np.ndarray, c: np.ndarray, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """For each row the closest centroid and its squared distance (less the row's own square), in bounded blocks."""
    near, dist, square = np.empty(len(x), np.int64), np.empty(len(x)), (c * c).sum(1)
    step = max(1, cells // max(1, len(c)))
    for i in range(0, len(x), step):
        d = square - 2 * (x[i : i + step] @ c.T)
        near[i : i + step] = d.argmin(1)
        dist[i : i + step] = d[np.arange(len(d)), near[i : i + step]]
    return near, dist


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centroids; empty ones move to rows that are badly served."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, d = nearest(x, c)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, col, k) for col in x.T], axis=1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(x.dtype)
        if (count == 0).any():
            c[count == 0] = x[np.argsort(-d)[: int((count == 0).sum())]]
    return c


def coarse(x: np.ndarray, k: int, most: int = 2048) -> np.ndarray:
    """k-means; above ``most`` centroids in two levels, so that the work grows as k ** 1.5."""
    if k <= most:
        return kmeans(x, k)
    near = nearest(x, top := kmeans(x, math.isqrt(k)))[0]
    inside = [x[near == g] for g in range(len(top))]
    return np.concatenate([kmeans(y, max(1, round(k * len(y) / len(x)))) for y in inside if len(y)])


class Index:
    """Centroids (cells x dim) and codebooks (parts x words x dim / parts)."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int, words: int = 256, book_rows: int = 20_000):
        sample = sample.astype(_F)
        self.dim = sample.shape[1]
        self.parts = math.gcd(parts, self.dim)
        self.centroids = coarse(sample, cells)
        some = sample[:book_rows]
        residual = self._split(some - self.centroids[nearest(some, self.centroids)[0]])
        self.books = np.stack([_padded(kmeans(residual[:, p], words, seed=7 + p), words) for p in range(self.parts)])

    def _split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.parts, self.dim // self.parts)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        residual = self._split(x - self.centroids[cell])
        return np.stack([nearest(residual[:, p], self.books[p])[0].astype(np.uint8) for p in range(self.parts)], axis=1)

    def probes_for(self, sample: np.ndarray, k: int, target: float, asked: int = 256) -> int:
        """Cells to visit so that ``target`` of the k nearest within the sample are met."""
        sample = sample.astype(_F)
        q = np.random.default_rng(11).choice(len(sample), min(asked, len(sample)), replace=False)
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = np.argsort(-(sample[q] @ self.centroids.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        rank = np.sort(np.take_along_axis(place, nearest(sample, self.centroids)[0][near], axis=1).ravel())
        return int(rank[math.ceil(target * len(rank)) - 1]) + 1

    def visit(self, q: np.ndarray, probes: int, held: np.ndarray, need: np.ndarray):
        """The cells for each query, best first: ``probes`` of them, more until they hold ``need`` candidates."""
        for row, n in zip(q.astype(_F) @ self.centroids.T, need, strict=True):
            order = np.argsort(-row, kind="stable")
            yield order[: max(probes, int(np.searchsorted(np.cumsum(held[order]), n)) + 1)]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with each codeword."""
        return np.einsum("npd,pwd->npw", self._split(q.astype(_F)), self.books)


def _padded(c: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([c, np.repeat(c[:1], n - len(c), axis=0)]) if len(c) < n else c


def _matrix(column, dtype=np.float64) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(arr), -1) if len(arr) else np.zeros((0, 1), dtype)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that can take part."""
    whole_ids(vectors, id_col)
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0)).filter(~bad & F.exists(v, lambda x: x != 0))


def _smallest(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): the k smallest ids of each distinct vector; Spark drops what ranks lower before it shuffles."""
    order = Window.partitionBy("h", "v").orderBy("id")
    # repeats of an id and a vector go first, so that each id counts once among the k
    kept = rows.withColumn("h", F.xxhash64("v")).withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= k)
    return kept.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))


_FOUND = "query_id long, vec_id long, score double"
_RESULT = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, probes: int | None = None, parts: int = 16, target: float = 0.98, rerank: int = 400, fit_rows: int = 20_000, part_rows: int = 4096, block_rows: int = 16_384, query_block: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, its own id left out."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], _RESULT)
    same = F.size("v") == dims[0]["d"]
    distinct = written(_smallest(rows.filter(same), k + 1))
    n = distinct.count()
    cells = cells or max(1, round(2 * math.sqrt(n)))
    wanted = max(fit_rows, 16 * cells)
    chosen = distinct.filter(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 40)) < F.lit(math.ceil(min(1.0, wanted / n) * (1 << 40)))) if wanted < n else distinct
    sample = _matrix(chosen.select("h", "v").orderBy(F.xxhash64("h", F.lit(4)), "v").select("v").toArrow().column("v"))
    if not len(sample):
        sample = _matrix(distinct.limit(1).select("v").toArrow().column("v"))
    index = Index(sample, cells, parts)
    probes = probes or index.probes_for(sample, max(1, round(k * len(sample) / n)), target)
    probes = min(probes, len(index.centroids))
    index = spark.sparkContext.broadcast(index)

    def place(batches):
        one_thread()
        for b in batches:
            x = _matrix(b.column("v"))
            cell = nearest(x.astype(_F), index.value.centroids)[0] if len(x) else np.zeros(0, np.int64)
            codes = index.value.encode(x.astype(_F), cell) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("ids"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["cell", "ids", "v", "code"])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), rows.schema["v"], T.StructField("code", T.BinaryType())])
    indexed = written(distinct.select("ids", "v").mapInArrow(place, schema))
    # parts of about part_rows vectors: small cells share one, a large one is dealt over several by hash
    size, held = np.zeros(len(index.value.centroids), np.int64), np.zeros(len(index.value.centroids), np.int64)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("held")).collect():
        size[r["cell"]], held[r["cell"]] = r["n"], r["held"]
    first, spread, n_parts, filled = np.zeros(len(size), np.int64), -(-size // part_rows), 0, 0
    for c in np.flatnonzero(size).tolist():
        if size[c] > part_rows or not n_parts or filled + size[c] > part_rows:
            n_parts, filled = n_parts + 1, 0
        first[c] = n_parts - 1
        n_parts += int(spread[c]) - 1
        filled = part_rows if size[c] > part_rows else filled + int(size[c])
    layout = spark.sparkContext.broadcast((first, spread, held))

    asked = valid(queries, id_col, vec_col).filter(same).dropDuplicates(["id", "v"])
    own = indexed.select(F.explode("ids").alias("id")).join(asked.select("id").distinct(), "id").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = written(asked.join(own, "id", "left").select("id", "v", F.coalesce("own", F.lit(0)).alias("own")))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))

    def cut(batches):
        first, spread, _ = layout.value
        for b in batches:
            cell, v = b.column("cell").to_numpy(), b.column("h").to_numpy()
            part = first[cell] + v % np.maximum(1, spread[cell])
            for block in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(part), block), pa.int32()), *[b.column(c) for c in ("cell", "ids", "v", "code")]], names=["part", "block", "cell", "ids", "v", "code"])

    key = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType())])
    dealt = indexed.withColumn("h", F.pmod(F.xxhash64("v"), F.lit(1 << 40))).mapInArrow(cut, T.StructType([*key.fields, *schema.fields]))

    def route(batches):
        first, spread, held = layout.value
        for b in batches:
            x = _matrix(b.column("v"))
            if not len(x):
                continue
            row, part, where = [], [], []
            for i, seen in enumerate(index.value.visit(x, probes, held, k + b.column("own").to_numpy())):
                seen = np.sort(seen[spread[seen] > 0])
                at = first[seen]
                for edge in np.split(np.arange(len(seen)), np.flatnonzero(np.diff(at)) + 1) if len(seen) else []:
                    some = seen[edge]
                    # the cells of one part; a cell that is dealt over several has them to itself
                    for p in range(int(at[edge[0]]), int(at[edge[0]] + spread[some].max())):
                        row.append(i)
                        part.append(p)
                        where.append(some.astype(np.int32).tobytes())
            for i in range(0, len(row), 4096):
                t = pa.array(row[i : i + 4096], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(part[i : i + 4096], pa.int32()), b.column("block").take(t), b.column("id").take(t), b.column("v").take(t), pa.array(where[i : i + 4096], pa.binary())], names=["part", "block", "id", "v", "cells"])

    routed = asked.mapInArrow(route, T.StructType([*key.fields, asked.schema["id"], asked.schema["v"], T.StructField("cells", T.BinaryType())]))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        """The best of one part for each query of one block that visits one of its cells."""
        one_thread()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(c):
            x, codes = _matrix(c.column("v")), np.stack([np.frombuffer(z.as_py(), np.uint8) for z in c.column("code")])
            here, cell = np.unique(c.column("cell").to_numpy(), return_inverse=True)
            ids = c.column("ids").combine_chunks()
            flat, edge = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
            for i in range(0, len(q), query_block):
                some = q.slice(i, query_block)
                y = _matrix(some.column("v"))
                seen = np.stack([np.isin(here, np.frombuffer(w.as_py(), np.int32)) for w in some.column("cells")])
                found.append(_best(index.value, y, some.column("id").to_numpy(), x, codes, here, cell, seen, flat, edge, k, rerank))
        return pa.table([np.concatenate(z) for z in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    found = routed.groupBy("part", "block").cogroup(dealt.groupBy("part", "block")).applyInArrow(meet, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(index: Index, y, qid, x, codes, here, cell, seen, flat, edge, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): what of the part's vectors x can be among the k nearest of the queries y; ``seen``: the cells of ``here`` that a query visits."""
    guess = (y.astype(_F) @ index.centroids[here].T)[:, cell]
    table = index.tables(y)
    for p in range(codes.shape[1]):
        guess += table[:, p][:, codes[:, p]]
    guess[~seen[:, cell]] = -np.inf
    r = min(rerank, len(x))
    best = np.argpartition(-guess, r - 1, axis=1)[:, :r]
    guessed = np.take_along_axis(guess, best, axis=1)
    exact = np.empty(best.shape)
    for i in range(0, len(y), 16):
        exact[i : i + 16] = np.einsum("qrd,qd->qr", x[best[i : i + 16]], y[i : i + 16])
    exact[~np.isfinite(guessed)] = -np.inf
    # k + 1 vectors, and all that tie with the last: one may be the query's own
    keep = min(k, r - 1)
    least = -np.partition(-exact, keep, axis=1)[:, keep]
    error = np.abs(np.subtract(exact, guessed, out=np.zeros_like(exact), where=np.isfinite(guessed))).max(axis=1)
    np.put_along_axis(guess, best, -np.inf, axis=1)
    row, more = np.nonzero((guess >= (least - error)[:, None]) & np.isfinite(guess))
    late = np.concatenate([(x[more[o : o + 65536]] * y[row[o : o + 65536]]).sum(axis=1) for o in range(0, len(row), 65536)] or [np.zeros(0)])
    a, b = np.nonzero((exact >= least[:, None]) & np.isfinite(exact))
    near = late >= least[row]
    asker, j, score = np.r_[a, row[near]], np.r_[best[a, b], more[near]], np.r_[exact[a, b], late[near]]
    times = edge[j + 1] - edge[j]
    at = np.repeat(edge[j], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    ids, asker, score = flat[at], np.repeat(asker, times), np.repeat(score, times)
    other = ids != qid[asker]
    ids, asker, score = ids[other], asker[other], score[other]
    # of each query no more than k leave the task
    order = np.lexsort((ids, -score, asker))
    ids, asker, score = ids[order], asker[order], score[order]
    rank = np.arange(len(asker)) - np.searchsorted(asker, asker)
    return qid[asker[rank < k]], ids[rank < k], score[rank < k]


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.pmod("vec_id", F.lit(20)) == 0))
