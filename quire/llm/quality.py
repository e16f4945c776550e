"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors: one for each hashed word, one for each hashed character
n-gram of a word (with marks for its two ends), one for a word that repeats the word before it, and one end
mark.  A softmax layer over the mean gives the
chance of label 1.  All is learned by stochastic gradient descent in numpy on a bounded sample of labelled
rows (``max_rows``, the labelled ids that hash lowest).  Because the output is linear in the mean, scoring
needs one number a distinct word.

Defined cases: a null or empty text has the end mark alone and so gets a score; a label that is null, or an
id with labels that disagree, teaches nothing; with no labelled rows every score is 0.5, with one class
the class's side; null ids and repeated rows are scored as they are; an empty table gives no rows; other
columns pass through, and a column named like an output gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import crc_bucket, mix64, text_bytes, word_bounds, word_hashes

_U = np.uint64
#: Slots of the end mark and of the mark for a word that repeats the word before it.
_END_MARK, _REPEAT, _FIRST = 0, 1, 2


@dataclass(frozen=True)
class Shape:
    word_slots: int = 1 << 16
    gram_slots: int = 1 << 16
    grams: tuple[int, ...] = (3, 4)
    dim: int = 8
    epochs: int = 8
    rate: float = 0.5
    seed: int = 11


def features(data: np.ndarray, offsets: np.ndarray, shape: Shape):
    """(Distinct word at each place, text of each place, places that repeat a word, owner word and slot of each feature)."""
    start, end, doc = word_bounds(data, offsets)
    h = word_hashes(data, start, end)
    distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
    length = end[first] - start[first] + 2
    at = np.cumsum(length) - length
    flat = np.empty(int(length.sum()), np.uint8)
    owner = np.repeat(np.arange(len(distinct)), length)
    source = np.arange(len(flat)) - np.repeat(at, length) - 1 + np.repeat(start[first], length)
    flat[:] = data[np.clip(source, 0, max(0, len(data) - 1))] if len(data) else 0
    flat[at], flat[at + length - 1] = 1, 2  # control bytes stand for the two ends of a word
    owners, slots = [np.arange(len(distinct))], [_FIRST + (distinct % _U(shape.word_slots)).astype(np.int64)]
    for n in shape.grams:
        if len(flat) < n:
            continue
        code = np.zeros(len(flat) - n + 1, _U)
        for k in range(n):
            code = code << _U(8) | flat[k : len(code) + k].astype(_U)
        inside = owner[: len(code)] == owner[n - 1 :]
        owners.append(owner[: len(code)][inside])
        slots.append(_FIRST + shape.word_slots + (mix64(code[inside], n) % _U(shape.gram_slots)).astype(np.int64))
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    return word, doc, again, np.concatenate(owners), np.concatenate(slots)


def train(texts: list[str], labels: list[int], shape: Shape = Shape()) -> np.ndarray:
    """One number a slot: its part of the logit of label 1."""
    rng = np.random.default_rng(shape.seed)
    slots = _FIRST + shape.word_slots + shape.gram_slots
    vectors = rng.uniform(-1 / shape.dim, 1 / shape.dim, (slots, shape.dim))
    out = np.zeros((2, shape.dim))
    rows = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        word, _, again, owner, slot = features(raw, np.array([0, len(raw)]), shape)
        times = np.bincount(word, minlength=int(owner.max()) + 1 if len(owner) else 0)[owner]
        ids, inverse = np.unique(np.r_[slot, _END_MARK, _REPEAT], return_inverse=True)
        weight = np.bincount(inverse, np.r_[times, 1, again.sum()])
        rows.append((ids.astype(np.int32), (weight / weight.sum()).astype(np.float32)))
    y = np.array(labels)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    steps, done = max(1, shape.epochs * len(rows)), 0
    for _ in range(shape.epochs):
        for i in rng.permutation(len(rows)):
            ids, weight = rows[i]
            hidden = weight @ vectors[ids]
            z = out @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            # classes weigh alike, so that a score of one half lies between them
            rate = shape.rate * (1 - done / steps) * (0.5 / share[y[i]])
            back = p @ out
            out -= rate * np.outer(p, hidden)
            vectors[ids] -= rate * np.outer(weight, back)
            done += 1
    return vectors @ (out[1] - out[0])


def score_texts(column: pa.Array, part: np.ndarray, shape: Shape, block: int = 1 << 20) -> np.ndarray:
    """Chance of label 1 for each text, a bounded block of texts at a time."""
    data, offsets = text_bytes(column)
    out = np.empty(len(offsets) - 1)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, side="right")) - 1)
        word, doc, again, owner, slot = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shape)
        n = int(owner.max()) + 1 if len(owner) else 0
        of_word, count = np.bincount(owner, part[slot], n), np.bincount(owner, minlength=n)
        total = np.bincount(doc, of_word[word] + again * part[_REPEAT], j - i) + part[_END_MARK]
        out[i:j] = total / (np.bincount(doc, count[word] + again, j - i) + 1)
        i = j
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, shape: Shape = Shape()) -> np.ndarray:
    """Learns from at most ``max_rows`` labelled rows; ids are chosen first, so only their texts move, and they are learned from in one task: the driver
    gets the finished numbers."""
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).filter("y = y2")
    ids = clean.orderBy(F.xxhash64(id_col), id_col).limit(max_rows).select(id_col, F.col("y").cast("int").alias("y")).toArrow()
    none = np.zeros(_FIRST + shape.word_slots + shape.gram_slots)
    if not ids.num_rows:
        return none
    chosen = docs.sparkSession.createDataFrame(ids, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("y", T.IntegerType())]))
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(id_col, F.col(text_col).alias("t"), "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for b in batches:
            texts += b.column("t").to_pylist()
            marks += b.column("y").to_pylist()
        if marks:
            yield pa.RecordBatch.from_arrays([pa.array([train([t or "" for t in texts], marks, shape).tobytes()], pa.binary())], names=["part"])

    part = rows.orderBy(F.xxhash64(id_col), id_col, "t").limit(max_rows).select("t", "y").mapInArrow(learn, "part binary").collect()
    return np.frombuffer(part[0]["part"]).copy() if part else none


def score(docs: DataFrame, part: np.ndarray, *, text_col: str = "text", threshold: float = 0.7, shape: Shape = Shape(), score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All rows with score and predicted (1 if score >= threshold)."""
    docs = docs.drop(*[c for c in (score_col, predicted_col) if c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(part)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score_texts(b.column(text_col), shared.value, shape)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every document's quality, learned from the labels of three quarters of the ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_bucket(F.col("doc_id"), 4) != 2)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
