"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie end to end in one array of symbol ids.  Each round looks up the rank of every
adjacent pair, takes each sequence's lowest rank, and merges that pair wherever it stands in the
sequence, all sequences at once.  A sequence without a mergeable pair is done; its surviving symbols are
its tokens.  Merging all places of one pair at once equals one merge after the other, because a pair that
holds a merged symbol always ranks after the merge that makes it.

A chunk between white space is counted once a worker and then looked up; the table is emptied when it
has ``CACHED`` entries, so memory is bounded.  Long texts are cut at white space while they are read.

Defined cases: a null or empty text has no tokens; null ids and repeated rows come back as they are; an
empty table gives no rows; other columns pass through, and a column named like an output gives way.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CACHED = 400_000
_PIECE = 1 << 20
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_SPACE}]+")
_NONE = np.int64(1 << 40)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return [names[b] for b in range(256)]


class TokenCounter:
    """Counts of a byte-level BPE file whose pre-tokens never hold white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        splits = [p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"]
        steps = spec["normalizer"].get("normalizers", [spec["normalizer"]]) if spec.get("normalizer") else []
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or not splits or "Replace" not in kinds or model.get("continuing_subword_prefix"):
            raise ValueError("a byte-level BPE file with a splitting pattern that drops white space is needed")
        self._nfc, self._lower = "NFC" in kinds, "Lowercase" in kinds
        self._pattern = regex.compile(splits[0]["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        names = _byte_symbols()
        self._plain = np.array([vocab[c] for c in names], np.int64)
        self._last = np.array([vocab[c + end] for c in names], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._cache: dict[str, int] = {}

    def merge(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.zeros(len(pre_tokens), np.int64)
        lens = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        raw = np.frombuffer(b"".join(pre_tokens), np.uint8)
        symbols, owner = self._plain[raw], np.repeat(np.arange(len(lens)), lens)
        ends = (np.cumsum(lens) - 1)[lens > 0]
        symbols[ends] = self._last[raw[ends]]
        while len(symbols):
            pair = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self._keys, pair), len(self._keys) - 1)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = np.where((self._keys[at] == pair) & (owner[1:] == owner[:-1]), self._ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            out[owner[starts[done]]] = lengths[done]
            hit = (rank == np.repeat(least, lengths)) & (rank != _NONE)
            # in a run of overlapping places (a a a) every other one merges, from the left
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1))
            hit &= (place - run) % 2 == 0
            symbols[hit] = self._merged[rank[hit]]
            keep = ~np.r_[False, hit[:-1]] & np.repeat(~done, lengths)
            symbols, owner = symbols[keep], owner[keep]
        return out

    def _learn(self, chunks: set[str]) -> None:
        new = list(chunks.difference(self._cache))
        if not new:
            return
        pieces: list[bytes] = []
        owner: list[int] = []
        for i, chunk in enumerate(new):
            found = self._pattern.findall(chunk)
            pieces += [p.encode("utf-8", "replace") for p in found]
            owner += [i] * len(found)
        counts = np.bincount(np.array(owner, np.int64), self.merge(pieces), len(new)).astype(np.int64) if pieces else np.zeros(len(new), np.int64)
        self._cache.update(zip(new, counts.tolist(), strict=True))

    def _normal(self, text: str) -> str:
        if self._nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if self._lower else text

    def _chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if _ODD_SPACE.search(text) else text.split()

    def _parts(self, text: str) -> Iterator[tuple[list[str], int]]:
        """Chunks and special tokens of a text, a bounded piece at a time."""
        sections = [text]
        if self._special and "<" in text:
            sections = self._special.split(text)
        for k, section in enumerate(sections):
            i = 0
            while i < len(section) or (k and not i):
                j = len(section)
                if j - i > _PIECE:
                    cut = re.compile(f"[{_SPACE}]").search(section, i + _PIECE)
                    j = cut.start() if cut else j
                yield self._chunks(self._normal(section[i:j])), int(k > 0 and i == 0)
                i = max(j, i + 1)

    def count(self, texts: Iterable[str | None]) -> list[int]:
        out: list[int] = []
        held: list[tuple[int, list[str], int]] = []
        size = 0
        for n, text in enumerate(texts):
            out.append(0)
            for chunks, special in self._parts(text or ""):
                held.append((n, chunks, special))
                size += len(chunks)
                if size > 200_000:
                    self._settle(held, out)
                    held, size = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str], int]], out: list[int]) -> None:
        if len(self._cache) > CACHED:
            self._cache = {}
        seen: set[str] = set()
        for _, chunks, _ in held:
            seen.update(chunks)
        self._learn(seen)
        of = self._cache.__getitem__
        for n, chunks, special in held:
            out[n] += sum(map(of, chunks)) + special


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """All rows with n_bytes, n_tokens and over_limit. ``path``: of a tokenizer file that every worker can open."""
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    docs = docs.drop(*[f.name for f in new if f.name in docs.columns])
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for b in batches:
            texts = b.column(text_col)
            n = pa.array(counter.count(t.as_py() for t in texts), pa.int64())
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            over = pa.compute.greater(n, limit)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], size, n, over], names=[*[f.name for f in kept], "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, T.StructType([*kept, *new]))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: tokens of every document under the word-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
