"""Benchmark decontamination by q-gram lemma filtering.

A region of a document that is within k edits of an item of n characters shares at least
n + 1 - q - k * q of its q-grams with it, at diagonals (document place less item place) that differ by
at most k.  Shared q-grams are found with a bit table and a sorted list of the items' q-grams, and
counted in overlapping bands of diagonals, each 2k wide and starting k after the one before, so that some
band holds them all.  Bands that reach the bound are verified by banded alignment over their 2k + 1 diagonals; an item
that stands there word for word needs none.

Text is compared as bytes, A-Z and Latin-1 capitals lower-cased and white space of any kind as a space, so places are places
in the document itself.  The items are a stated query set: they are shipped in blocks of about
``block_bytes``, one after the other, and documents are read once a block.

Defined cases: null and empty texts are clean; null or empty items match nothing; items shorter than
``min_chars`` match only word for word, never inside a longer word; repeated items each count; null ids and repeated rows come back
as they are; no items or no documents give a defined empty result; other columns pass through, and a
column named like an output gives way.  Whole texts are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import drop_written, text_bytes, written

_U = np.uint64
_BITS = 20
_MULT = _U(0x9E3779B97F4A7C15)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
_PLAIN[9:14] = 32


def plain_bytes(data: np.ndarray) -> np.ndarray:
    """Lower case (A-Z and the two-byte letters from U+00C0 to U+00DE), white space as spaces; lengths stay."""
    out = _PLAIN[data]
    if len(data) > 1:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
        out[second] += 32
    return out


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes (8 at most) from each place on as one number."""
    code = np.zeros(max(0, len(data) - q + 1), _U)
    for k in range(q):
        code <<= _U(8)
        code |= data[k : len(code) + k]
    return code


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * _MULT) >> _U(64 - _BITS)


_FAR = 1 << 30


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, k: int) -> tuple[int, int, int] | None:
    """Fewest edits (k at most) between the item and any part of the text, with that part's ends.

    Banded: only ``width`` diagonals (text place less item place) from ``low`` on are kept, whatever the text's length.
    """
    n, size = len(item), len(text)
    if not n:
        return None
    # chars[i + d] faces item[i] on diagonal low + d; what lies outside the text equals nothing
    chars = np.full(n + width, 256, np.int16)
    a, z = max(0, low), min(size, low + n + width)
    if a >= z:
        return None
    chars[a - low : z - low] = text[a:z]
    lane = np.arange(width)
    begin = low + lane
    cost = np.where((begin >= 0) & (begin <= size), 0, _FAR)
    clipped = low < 0 or low + n + width > size
    for i in range(n):
        step, source = cost + (chars[i : i + width] != item[i]), begin.copy()
        up = cost[1:] + 1
        better = up < step[:-1]
        step[:-1][better], source[:-1][better] = up[better], begin[1:][better]
        if clipped:
            at = low + lane + i + 1
            step[(at < 0) | (at > size)] = _FAR
        least = np.minimum.accumulate(step - lane)
        source = source[np.maximum.accumulate(np.where(step - lane == least, lane, 0))]
        cost, begin = least + lane, source
        if clipped:
            cost[(at < 0) | (at > size)] = _FAR
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), low + end + n


#: Scripts that put no space between words: a neighbour of these joins nothing.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word."""
    return a.isalnum() and b.isalnum() and not _UNSPACED.match(a) and not _UNSPACED.match(b)


def _whole(raw: bytes, needle: bytes, start: int, end: int, low: int, high: int) -> int:
    """The first place of the needle from start to end that begins and ends with words of raw[low:high], -1 if none."""
    text = needle.decode("utf-8", "replace")
    p = raw.find(needle, start, end)
    while p >= 0:
        e = p + len(needle)
        left, right = raw[max(low, p - 4) : p].decode("utf-8", "ignore")[-1:], raw[e : min(high, e + 4)].decode("utf-8", "ignore")[:1]
        if not _joins(left, text[0]) and not _joins(text[-1], right):
            return p
        p = raw.find(needle, p + 1, end)
    return -1


def _reached(doc, item, band, place, at, bound) -> list[tuple[int, int, int]]:
    """(text, item, band) that share enough q-grams; one that stands in several places counts once."""
    if not len(doc):
        return []
    low, high = int(band.min()) - 1, int(band.max()) + 1
    bands = high - low + 1
    if (int(doc[-1]) + 1) * len(bound) * bands >= 1 << 62:
        raise ValueError("a block of texts this long needs a smaller step or fewer items a block")
    pair = (doc * len(bound) + item) * bands
    key = np.concatenate([pair + (band - low), pair + (band - 1 - low)])
    place, at = np.tile(place, 2), np.tile(at, 2)

    def enough(key, needed):
        distinct, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        return (count >= needed[distinct // bands % len(bound)])[inverse]

    ok = enough(key, bound)
    key, place, at = key[ok], place[ok], at[ok]
    for which in (0, 1):  # distinct places in the item, then in the text
        order = np.lexsort(((place, at)[which], key))
        key, place, at = key[order], place[order], at[order]
        other = (place, at)[which]
        once = np.r_[True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])] if len(key) else np.zeros(0, bool)
        distinct, count = np.unique(key[once], return_counts=True)
        good = distinct[count >= bound[distinct // bands % len(bound)]]
        ok = np.isin(key, good)
        key, place, at = key[ok], place[ok], at[ok]
        if not len(key):
            return []
    key = np.unique(key)
    pair = key // bands
    return list(zip((pair // len(bound)).tolist(), (pair % len(bound)).tolist(), (key % bands + low).tolist(), strict=True))


@dataclass
class Items:
    """Index of a block of benchmark items."""

    ids: list[int]
    texts: list[bytes]
    q: int = 8
    rate: float = 0.1
    min_chars: int = 50
    plain: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.plain = [plain_bytes(np.frombuffer(t.strip(b" \t\n\v\f\r"), np.uint8)) for t in self.texts]
        self.size = np.array([len(p) for p in self.plain], np.int64)
        self.k = np.where(self.size >= self.min_chars, (self.size * self.rate).astype(np.int64), 0)
        self.bound = np.maximum(1, self.size + 1 - self.q - self.k * self.q)
        codes, item, place = [], [], []
        for i, p in enumerate(self.plain):
            c = grams(p, self.q)
            codes.append(c)
            item.append(np.full(len(c), i))
            place.append(np.arange(len(c)))
        code = np.concatenate(codes) if codes else np.zeros(0, _U)
        order = np.argsort(code, kind="stable")
        self.item = np.concatenate(item)[order].astype(np.int32) if codes else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order].astype(np.int32) if codes else np.zeros(0, np.int32)
        self.code, first, count = np.unique(code[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[_slot(self.code)] = True
        long = self.size >= self.q
        self.reach = int((self.size + self.k)[long].max()) if long.any() else 0
        self.least = int(self.bound[long].min()) if long.any() else 1

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """(item id, start, end, edits) of each text, a span for an item and band."""
        out: list[list] = [[] for _ in range(len(offsets) - 1)]
        if not len(self.code):
            return out
        plain = plain_bytes(data)
        code = grams(plain, self.q)
        at = np.flatnonzero(self.bits[_slot(code)])
        found = np.minimum(np.searchsorted(self.code, code[at]), len(self.code) - 1)
        same = self.code[found] == code[at]
        at, found = at[same], found[same]
        # a region needs ``least`` places within ``reach``: what has fewer around it can't belong to one
        n = self.least
        if n > 1:
            if len(at) < n:
                return out
            starts = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] <= self.reach)
            mark = np.zeros(len(at) + 1, np.int64)
            np.add.at(mark, starts, 1)
            np.add.at(mark, starts + n, -1)
            dense = np.cumsum(mark)[:-1] > 0
            at, found = at[dense], found[dense]
        if not len(at):
            return out
        doc = np.searchsorted(offsets[1:], at, side="right")
        whole = at + self.q <= offsets[doc + 1]
        at, found, doc = at[whole], found[whole], doc[whole]
        many = self.count[found].astype(np.int64)
        rank = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        posting = np.repeat(self.first[found], many) + rank
        item, doc, at = self.item[posting].astype(np.int64), np.repeat(doc, many), np.repeat(at, many)
        docs, items = len(offsets) - 1, len(self.ids)
        if docs * items <= 1 << 22:  # a whole text has to reach the bound before its bands can
            pair = doc * items + item
            ok = (np.bincount(pair, minlength=docs * items) >= np.tile(self.bound, docs))[pair]
            item, doc, at, posting = item[ok], doc[ok], at[ok], posting[ok]
        place = self.place[posting].astype(np.int64)
        band = (at - place - offsets[doc]) // np.maximum(self.k[item], 1)
        keys = _reached(doc, item, band, place, at, self.bound)
        spans: dict[tuple[int, int], list] = {}
        for d, i, b in keys:
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            w = max(1, int(self.k[i]))
            a = max(lo, lo + b * w - w)
            z = min(hi, lo + b * w + 2 * w + int(self.size[i]) + w)
            got = spans.setdefault((d, i), [])
            if any(x[0] <= a + w and z - w <= x[1] + w for x in got if x[2] == 0):
                continue
            needle = self.plain[i].tobytes()
            if self.size[i] < self.min_chars:
                near, c = max(lo, a - 4), min(hi, z + 4)
                p = _whole(plain[near:c].tobytes(), needle, a - near, z - near, 0, c - near)
                p = p - (a - near) if p >= 0 else -1
            else:
                p = plain[a:z].tobytes().find(needle)
            if p >= 0:
                got.append((a + p, a + p + int(self.size[i]), 0))
            elif self.k[i] and (hit := align(self.plain[i], plain[lo:hi], b * w, 2 * w + 1, int(self.k[i]))):
                got.append((lo + hit[1], lo + hit[2], hit[0]))
        for (d, i), got in spans.items():
            lo = int(offsets[d])
            got.sort(key=lambda x: (x[2], x[0]))
            kept: list = []
            for s, e, edits in got:
                if all(e <= x[0] or s >= x[1] for x in kept):
                    kept.append((s, e, edits))
            out[d] += [(self.ids[i], s - lo, e - lo, edits) for s, e, edits in kept]
        return out


def _short(items: Items, data: np.ndarray, offsets: np.ndarray, out: list[list]) -> None:
    """Items of fewer than q bytes, word for word."""
    for i in np.flatnonzero((items.size > 0) & (items.size < items.q)):
        raw, needle = plain_bytes(data).tobytes(), items.plain[i].tobytes()
        for d in range(len(offsets) - 1):
            low, high = int(offsets[d]), int(offsets[d + 1])
            p = _whole(raw, needle, low, high, low, high)
            if p >= 0:
                out[d].append((items.ids[i], int(p - offsets[d]), int(p - offsets[d] + len(needle)), 0))


def find_items(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, rate: float = 0.1, min_chars: int = 50, block_bytes: int = 4 << 20, step: int = 2 << 20) -> DataFrame:
    """All rows with ``spans``: the item, the bytes from start to end of the text, and the edits between them.

    Items of more than ``block_bytes`` in all are searched block after block; the rows are written between two blocks,
    so that no task holds more than one block's index (about 25 bytes for each byte of the block).
    """
    docs = docs.drop(*[c for c in ("spans",) if c in docs.columns])
    items = benchmark.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    span = T.StructType([T.StructField("item_id", items.schema["i"].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(span))])
    out, before = docs.withColumn("spans", F.array().cast(T.ArrayType(span))), None
    for n in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n) if blocks > 1 else items
        rows = part.orderBy("i", "t").toArrow()
        block = Items(rows["i"].to_pylist(), [t.encode() for t in rows["t"].to_pylist()], q, rate, min_chars)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        kind = pa.list_(pa.struct([("item_id", rows["i"].type), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = text_bytes(b.column(text_col))
                spans, i = [], 0
                while i < len(offsets) - 1:
                    j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
                    piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    got = shared.value.search(piece, at)
                    _short(shared.value, piece, at, got)
                    spans += got
                    i = j
                have = b.column("spans").to_pylist()
                both = [[*(tuple(s.values()) for s in x), *y] for x, y in zip(have, spans, strict=True)]
                made = pa.array([[dict(zip(("item_id", "start", "end", "edits"), s, strict=True)) for s in sorted(x, key=_in_order)] for x in both], kind)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in schema.names[:-1]], made], names=schema.names)

        out = out.mapInArrow(run, schema)
        if blocks > 1:
            out = written(out)
            drop_written(before)
            before = out
            shared.destroy()
    return out


def _in_order(span: tuple) -> tuple:
    """Null ids last."""
    return (True, *span[1:]) if span[0] is None else (False, *span)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows that hold no item, with the columns they came with."""
    return find_items(docs, benchmark, text_col=text_col, **options).filter(F.size("spans") == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the benchmark items that each document holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.col("spans.item_id")))
    return found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), items.alias("item_ids"), F.array_min("spans.edits").alias("fewest_edits"))
