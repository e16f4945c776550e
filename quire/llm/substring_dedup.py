"""Exact substring deduplication with fixed-block anchors.

A run of ``window`` words that stands twice holds, at its earlier place, one whole block of
``window // 2`` words when the earlier text is cut into blocks that don't overlap.  So blocks are
indexed, every rolling window of a block's width probes the index, and only places around a hit can
belong to a repeat.  Hits are then extended: around them all windows of the full width are compared by
96-bit hashes of their words, and the maximal runs of repeated windows are what is removed.

Documents are dealt into groups of bounded text.  A group sends one entry for each distinct hash, packed
by hash bucket; a bucket answers each group with the hashes that matter to it.  So a passage that stands
in most documents costs one entry a group, whatever its count, and no task holds a key's rows.

Defined cases: null and empty texts have no words; a text with fewer words than the window keeps all; the
order of windows is (id, place), null ids last; rows that share an id are ordered by place alone, so of
repeated rows none removes words of another; ids must be of a whole-number type; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import WORD, by_bucket, from_planes, group_count, grouped, planes, settled, text_bytes, whole_ids, window_hashes, word_bounds, word_hashes

_U = np.uint64
_SENT = "bucket int, _group int, a binary, b binary, c binary, d binary"
_REPLY = "_group int, a binary"
_LAST_ID = np.iinfo(np.int64).max
_LOW = _U((1 << 30) - 1)


def _sorted_groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the key, and where each distinct value starts in it."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)


class _Group:
    """The words of a group of documents."""

    def __init__(self, table: pa.Table):
        self.data, self.offsets = text_bytes(table.column("text"))
        self.ids = table.column("id").combine_chunks().fill_null(_LAST_ID).to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int64)
        self.start, self.end, self.doc = word_bounds(self.data, self.offsets)
        self.words = word_hashes(self.data, self.start, self.end)
        self.cut = np.searchsorted(self.doc, np.arange(len(self.offsets)))
        self.place = np.arange(len(self.doc)) - self.cut[:-1][self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def probes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return window_hashes(self.words, self.doc, width)

    def candidates(self, hits: np.ndarray, window: int, width: int, buckets: int) -> np.ndarray:
        """Starts of full windows that hold a probe which hit."""
        h, inside = self.probes(width)
        n = len(self.words) - window + 1
        if n <= 0 or not len(hits):
            return np.zeros(0, np.int64)
        hit = inside & np.isin(_short_key(h, buckets), hits)
        seen = np.r_[0, np.cumsum(hit)]
        ok = (self.doc[:n] == self.doc[window - 1 :]) & (seen[window - width + 1 : window - width + 1 + n] > seen[:n])
        return np.flatnonzero(ok)


def _short_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 30 more bits: what a probe is known by.  Equal hashes have equal keys; a chance match only costs time."""
    return ((h >> _U(32)) * _U(buckets) >> _U(32)) << _U(30) | h & _LOW


def _send_probes(table: pa.Table, width: int, buckets: int) -> pa.Table:
    """For each bucket: 30 bits of each distinct probe, with 'is a block' and 'stands twice here'."""
    g = _Group(table)
    h, inside = g.probes(width)
    h, block = h[inside], (g.place[: len(h)] % width == 0)[inside]
    order, at = _sorted_groups(h)
    distinct = h[order[at]] if len(at) else h
    twice = np.diff(np.r_[at, len(h)]) > 1
    has_block = np.maximum.reduceat(block[order], at) if len(at) else np.zeros(0, bool)
    entry = ((distinct & _LOW) << _U(2) | has_block.astype(_U) << _U(1) | twice.astype(_U)).astype(np.uint32)
    rows = [(b, planes(entry[s])) for b, s in by_bucket(distinct, buckets)]
    group = table.column("_group")[0].as_py() if len(table) else 0
    n = len(rows)
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([group] * n, pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *[pa.nulls(n, pa.binary())] * 3], names=["bucket", "_group", "a", "b", "c", "d"])


def _match_probes(table: pa.Table) -> pa.Table:
    """Answers each group with the keys that are somewhere a block and stand in two places."""
    bucket = table.column("bucket")[0].as_py()
    groups = table.column("_group").to_numpy()
    parts = [from_planes(x.as_py(), np.uint32) for x in table.column("a")]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    entry = np.concatenate(parts)
    key = entry >> np.uint32(2)
    order, at = _sorted_groups(key)
    count = np.diff(np.r_[at, len(key)])
    block = np.maximum.reduceat((entry[order] >> np.uint32(1)) & np.uint32(1), at) > 0
    twice = np.maximum.reduceat(entry[order] & np.uint32(1), at) > 0
    good = np.repeat(block & (twice | (count > 1)), count)
    keep = order[good]
    out_g, out = [], []
    mine, theirs = owner[keep], key[keep]
    o = np.argsort(mine, kind="stable")
    mine, theirs = mine[o], theirs[o]
    at = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else []
    for lo, hi in zip(at, np.r_[at[1:], len(mine)].astype(int) if len(mine) else [], strict=True):
        out_g.append(int(groups[mine[lo]]))
        out.append(planes((_U(bucket) << _U(30)) | theirs[lo:hi].astype(_U)))
    return pa.table([pa.array(out_g, pa.int32()), pa.array(out, pa.binary())], names=["_group", "a"])


def _hits(replies: pa.Table) -> np.ndarray:
    parts = [from_planes(x.as_py(), np.uint64) for x in replies.column("a")]
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _send_windows(docs: pa.Table, replies: pa.Table, window: int, width: int, buckets: int) -> pa.Table:
    """For each bucket: hash, 32 more bits, and the first (id, place) here of each distinct candidate window."""
    g = _Group(docs)
    starts = g.candidates(_hits(replies), window, width, buckets)
    h, h2 = (window_hashes(g.words, g.doc, window, second)[0][starts] for second in (False, True)) if len(starts) else (np.zeros(0, _U),) * 2
    ids, place = g.ids[g.doc[starts]] if len(starts) else np.zeros(0, np.int64), g.place[starts]
    order = np.lexsort((place, ids, h))
    h, h2, ids, place = h[order], h2[order], ids[order], place[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    h, h2, ids, place = h[at], (h2[at] >> _U(32)).astype(np.uint32), ids[at], place[at].astype(np.uint32)
    rows = [(b, planes(h[s]), planes(h2[s]), planes(ids[s]), planes(place[s])) for b, s in by_bucket(h, buckets)]
    group = docs.column("_group")[0].as_py() if len(docs) else 0
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(cols[0], pa.int32()), pa.array([group] * len(rows), pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "_group", "a", "b", "c", "d"])


def _match_windows(table: pa.Table) -> pa.Table:
    """Answers each group with the windows that start earlier in another group."""
    groups = table.column("_group").to_numpy()
    cols = [[from_planes(x.as_py(), t) for x in table.column(c)] for c, t in (("a", np.uint64), ("b", np.uint32), ("c", np.int64), ("d", np.uint32))]
    owner = np.repeat(np.arange(len(groups)), [len(p) for p in cols[0]])
    h, h2, ids, place = (np.concatenate(c) for c in cols)
    order = np.lexsort((place, ids, h2, h))
    h, h2, ids, place, owner = h[order], h2[order], ids[order], place[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (ids > ids[first]) | ((ids == ids[first]) & (place > place[first]))
    h, owner = h[later], owner[later]
    o = np.argsort(owner, kind="stable")
    h, owner = h[o], owner[o]
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(owner)].astype(int) if len(owner) else []
    return pa.table([pa.array([int(groups[owner[i]]) for i in at], pa.int32()), pa.array([planes(h[i:j]) for i, j in zip(at, ends, strict=True)], pa.binary())], names=["_group", "a"])


def _removed(docs: pa.Table, hits: np.ndarray, elsewhere: np.ndarray, window: int, width: int, buckets: int) -> tuple[_Group, np.ndarray]:
    """The group, and for each of its words whether a window that covers it starts earlier somewhere."""
    g = _Group(docs)
    starts = g.candidates(hits, window, width, buckets)
    gone = np.zeros(len(g.words) + 1, np.int64)
    if len(starts):
        h = window_hashes(g.words, g.doc, window)[0][starts]
        ids, place = g.ids[g.doc[starts]], g.place[starts]
        order = np.lexsort((place, ids, h))
        hs, si, sp = h[order], ids[order], place[order]
        first = np.maximum.accumulate(np.where(np.r_[True, hs[1:] != hs[:-1]], np.arange(len(hs)), 0))
        again = np.empty(len(h), bool)
        again[order] = (si > si[first]) | ((si == si[first]) & (sp > sp[first]))
        s = starts[again | np.isin(h, elsewhere)]
        np.add.at(gone, s, 1)
        np.add.at(gone, s + window, -1)
    return g, np.cumsum(gone)[:-1] > 0


def _result(g: _Group, gone: np.ndarray, with_text: bool) -> tuple[list, ...]:
    n, lost, sums, kept_texts, spans = [], [], [], [], []
    raw = g.data.tobytes()
    for d, (a, b) in enumerate(zip(g.cut[:-1].tolist(), g.cut[1:].tolist(), strict=True)):
        keep = np.flatnonzero(~gone[a:b]) + a
        text = b" ".join([raw[s:e] for s, e in zip(g.start[keep].tolist(), g.end[keep].tolist(), strict=True)])
        n.append(b - a)
        lost.append(b - a - len(keep))
        sums.append(hashlib.sha256(text).hexdigest())
        if with_text:
            edge = np.flatnonzero(np.diff(np.r_[False, gone[a:b], False].astype(np.int8)))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept_texts.append(text.decode())
    return n, lost, sums, kept_texts, spans


def dedupe_substrings(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, group_bytes: int = 8 << 20, groups_per_bucket: int = 4) -> DataFrame:
    """A row for each document: id, n_words, n_removed, kept_sha256; with_text adds kept_text and the removed word spans."""
    width = max(1, window // 2)
    whole_ids(docs, id_col)
    base, size = settled(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), group_bytes)
    groups = group_count(size, group_bytes)
    buckets = max(4, -(-groups // groups_per_bucket))
    dealt = grouped(base, groups, "id", "text", "_salt")

    def send_probes(t: pa.Table) -> pa.Table:
        return _send_probes(t, width, buckets)

    def match_probes(t: pa.Table) -> pa.Table:
        return _match_probes(t)

    def send_windows(d: pa.Table, r: pa.Table) -> pa.Table:
        return _send_windows(d, r, window, width, buckets)

    def match_windows(t: pa.Table) -> pa.Table:
        return _match_windows(t)

    probes = dealt.groupBy("_group").applyInArrow(send_probes, _SENT)
    hits = probes.groupBy("bucket").applyInArrow(match_probes, _REPLY)
    windows = dealt.groupBy("_group").cogroup(hits.groupBy("_group")).applyInArrow(send_windows, _SENT)
    earlier = windows.groupBy("bucket").applyInArrow(match_windows, _REPLY)
    both = hits.select("_group", "a", F.lit(0).alias("kind")).unionByName(earlier.select("_group", "a", F.lit(1).alias("kind")))
    names = [id_col, "n_words", "n_removed", "kept_sha256"]
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if with_text:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        schema = schema.add("kept_text", T.StringType()).add("removed_spans", T.ArrayType(span))

    def finish(d: pa.Table, r: pa.Table) -> pa.Table:
        kind = r.column("kind").to_numpy()
        hit = _hits(r.filter(pa.array(kind == 0)))
        other = _hits(r.filter(pa.array(kind == 1)))
        n, lost, sums, texts, spans = _result(*_removed(d, hit, other, window, width, buckets), with_text)
        cols = [d.column("id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sums, pa.string())]
        if with_text:
            cols += [pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        return pa.table(cols, names=[*names, *(["kept_text", "removed_spans"] if with_text else [])])

    return dealt.groupBy("_group").cogroup(both.groupBy("_group")).applyInArrow(finish, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: words left in each document once runs of 20 words that stand earlier are removed."""
    return dedupe_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS l FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 19], ' ')) AS k FROM w, unnest(range(1, len(l) - 18)) AS u(i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM f, unnest(range(i, i + 20)) AS u(p) WHERE r > 1 GROUP BY doc_id),
t AS (SELECT w.doc_id, l, coalesce(gone, []) AS gone FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(l)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), ' '), '')) AS kept_sha256
FROM t
"""
