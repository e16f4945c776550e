"""Label and value pairs of Arrow batches of (doc_id, pages): the rules of ``keyvalue.page_pairs`` for whole tables.

Rules on a text run once for each distinct text of a batch, and not at all for bare numbers, to which none applies; rules on places
are numpy over all pages of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.functions import lexicon as L
from quire.functions.text import STOP_WORDS, _folding
from quire.operators.reading import SPACE, Batch, clusters, medians, nth

_GAPS = re.compile(f"[{re.escape(SPACE)}]+")
#: As in the JVM: a dot is anything in a line, an end may have a line's end after it, white space is ASCII's.
_DOT, _END, _S = "[^\n\r\x85" + chr(0x2028) + chr(0x2029) + "]", "(?=(?:\r\n|[\n\r\x85" + chr(0x2028) + chr(0x2029) + r"])?\Z)", r"[ \t\n\x0b\f\r]"
_HASH = re.compile(rf"([A-Za-zÀ-ỹ0-9 \t\n\x0b\f\r./&_-]{{2,30}})#{_S}*({_DOT}+){_END}")
_WIDE = re.compile(rf"({_DOT}{{2,35}}?){_S}{{2,}}({_DOT}{{2,}}){_END}")
_BLOCKS, _CANONICAL = frozenset(L.SECTION_ALIASES), [(a, name) for name, aliases in {**L.SECTION_ALIASES, **L.FIELD_ALIASES}.items() for a in aliases]
_ALIASES = [a for v in L.SECTION_ALIASES.values() for a in v]
_ALIAS_SET, _STOP_SET = frozenset(_ALIASES), frozenset(L.STOP_LABELS)
_ANY_ALIAS, _ANY_STOP = (re.compile("|".join(map(re.escape, w))) for w in (_ALIASES, [s for s in L.STOP_LABELS if len(s) >= 4]))
_HINTS = frozenset(w for w in L.LABEL_HINTS if len(w) >= 2 and w not in STOP_WORDS)
_TOKEN, _DIGIT, _NOT_NUMERIC = re.compile("[a-z0-9_#]+"), re.compile("[0-9]"), re.compile("[^0-9.,/$%-]")


@cache
def _letters() -> dict[int, int]:
    return {ord(a): ord(b) for a, b in zip(*_folding(), strict=True)}


def fold(t: str) -> str:
    t = t.lower()
    return t if t.isascii() else "".join(c for c in t.translate(_letters()) if unicodedata.category(c) != "Mn")


def squeeze(t: str) -> str:
    if t.isascii() and t.isprintable() and "  " not in t:
        return t.lower().strip(" ")
    return _GAPS.sub(" ", fold(t)).strip(" ")


@lru_cache(1 << 14)
def canonical(norm: str) -> str | None:
    for alias, name in _CANONICAL:
        if alias in norm:
            return name
    return None


def known_label(norm: str) -> bool:
    return norm in _STOP_SET or _ANY_STOP.search(norm) is not None


def hinted(norm: str) -> bool:
    return not _HINTS.isdisjoint(_TOKEN.findall(norm))


def mostly_numeric(t: str) -> bool:
    bare = _GAPS.sub("", t)
    return len(bare) > 0 and len(_NOT_NUMERIC.sub("", bare)) > len(bare) * 0.65


def n_words(t: str) -> int:
    if t.isascii() and t.isprintable() and "  " not in t:
        return t.strip(" ").count(" ") + 1
    return len(_GAPS.split(t.strip(SPACE)))


def split_inline(t: str) -> tuple[str, str] | None:
    at = t.find(":") if ":" in t else t.find(chr(0xFF1A))
    if at >= 0:
        return t[:at].strip(SPACE), t[at + 1 :].strip(SPACE)
    if m := _HASH.match(t):
        return m[1].strip(SPACE) + "#", m[2].strip(SPACE)
    if m := _WIDE.match(t):
        return m[1].strip(SPACE), m[2].strip(SPACE)
    return None


def is_label(t: str) -> bool:
    c = t.strip(" :-#")
    if not c or len(c) > 45:
        return False
    n = squeeze(c)
    return _ANY_ALIAS.search(n) is not None or known_label(n) or (n_words(c) <= 5 and not mostly_numeric(c) and hinted(n))


def is_row_label(t: str) -> bool:
    c = t.strip(" :-#")
    if not c or len(c) > 45 or mostly_numeric(c):
        return False
    n = squeeze(c)
    return _ANY_ALIAS.search(n) is not None or known_label(n) or hinted(n)


class Rules(NamedTuple):
    """What the rules say of a line's text."""

    row: bool  #: labels the rest of its row
    alone: bool  #: a label with no value on its own line
    stop: bool
    head: bool
    block: bool  #: a label alone of a party, whose block of lines is its value
    inline: tuple[str, str] | None  #: label and value within the line
    name: str  #: the label that it is if alone


@lru_cache(1 << 14)
def rules(t: str) -> Rules:
    c, cut, whole = t.strip(" :-"), split_inline(t), squeeze(t)
    n = whole if c == t else squeeze(c)
    stop = known_label(n) or n in _ALIAS_SET
    alone = bool(c) and len(c) <= 45 and cut is None and (stop or (n_words(c) <= 4 and not _DIGIT.search(c) and hinted(n))) and is_label(c)
    inline = cut if cut and cut[1] and is_label(cut[0]) else None
    return Rules(is_row_label(t), alone, stop, sum(w in whole for w in L.TABLE_MARKERS) >= 2, alone and canonical(n) in _BLOCKS, inline, c.strip(SPACE))


@lru_cache(1 << 14)
def named(label: str) -> tuple[str, str | None]:
    norm = squeeze(label)
    return norm, canonical(norm)


def _flags(text: pa.Array) -> tuple[np.ndarray, list[Rules]]:
    """For each text the number of its rules, the last one for bare numbers."""
    some = np.flatnonzero(~np.asarray(pc.match_substring_regex(text, r"^[0-9.,$/%-]*$")))
    coded = text.take(pa.array(some)).dictionary_encode()
    found = [rules(t) for t in coded.dictionary.to_pylist()]
    out = np.full(len(text), len(found))
    out[some] = np.asarray(coded.indices)
    return out, [*found, Rules(False, False, False, False, False, None, "")]


def _joined(text: pa.Array, of: np.ndarray, n: int, sign: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), text), sign)


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each of the items start, start + 1, ... of all ranges."""
    of = np.repeat(np.arange(len(start)), size)
    return of, start[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)


def _by_row(b: Batch, text: pa.Array, row: np.ndarray):
    """(label's item, value): the leftmost line of a row labels the rest, if the gap is small."""
    page, p = b.page, b.place
    # items stand by (cy, x1, ord); rows are made by (cy, ord)
    order = np.lexsort((b.ord, p.cy, page))
    near = np.fmax(medians(p.height, page, b.n) * 1.1, 0.008)
    of = clusters(p.cy[order], page[order], near)
    final = np.lexsort((p.x1[order], of, page[order]))
    of, at = of[final], order[final]
    first = np.flatnonzero((np.diff(page[at], prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    size = np.diff(first, append=len(at))
    some = (size > 1) & row[at[first]]
    first, size = first[some], size[some]
    some = p.x1[at[first + 1]] - p.x2[at[first]] <= 0.24
    first, size = first[some], size[some]
    of, i = _ranges(first + 1, size - 1)
    return at[first], _joined(text.take(pa.array(at[i])), of, len(first), " ")


def _below(b: Batch, text: pa.Array, flags: dict[str, np.ndarray], at_once: int = 1 << 20):
    """(label's item, value): standalone labels with the lines under them; lines that a party's block takes label nothing."""
    p, label = b.place, np.flatnonzero(flags["alone"])
    block, left = flags["block"][label], p.cx[label] < 0.5
    x1, x2, cx = p.x1[label], p.x2[label], p.cx[label]
    lo = np.where(left, np.fmax(0.0, x1 - 0.08), np.fmax(0.42, x1 - 0.18))
    hi = np.where(left, np.fmin(0.58, np.fmax(x2 + 0.42, cx + 0.18)), np.fmin(1.0, x2 + 0.12))
    depth, size = np.where(block, 0.34, 0.12), np.searchsorted(b.page, b.page[label], side="right") - label - 1
    owners, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.cumsum(size)
    k = 0
    while k < len(label):
        z = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + at_once, side="right")))
        of, i = _ranges(label[k:z] + 1, size[k:z])
        of += k
        down = p.cy[i] - p.cy[label[of]]
        some = np.flatnonzero((p.cy[i] > p.cy[label[of]]) & (down <= depth[of]) & (p.cx[i] >= lo[of]) & (p.cx[i] <= hi[of]))
        of, i = of[some], i[some]
        ends = np.cumsum(flags["head"][i] | (block[of] & flags["stop"][i]))
        start = np.searchsorted(of, of)
        before = np.r_[0, ends][start]
        kept = np.flatnonzero((ends == before) & (nth(of) < np.where(block[of], 6, 1)))
        owners.append(of[kept])
        items.append(i[kept])
        k = z
    of, i = np.concatenate(owners), np.concatenate(items)
    taken = np.flatnonzero(block[of] & flags["alone"][i])
    if len(taken):
        # in pages where a block takes labels, what is taken is settled label by label
        pages, edge, gone = set(b.page[i[taken]].tolist()), np.searchsorted(of, np.arange(len(label) + 1)), np.zeros(len(label), bool)
        covered: set[int] = set()
        for k in np.flatnonzero(np.isin(b.page[label], list(pages))).tolist():
            if int(label[k]) in covered:
                gone[k] = True
            elif block[k]:
                covered.update(i[edge[k] : edge[k + 1]].tolist())
        some = ~gone[of]
        of, i = of[some], i[some]
    used, of = np.unique(of, return_inverse=True)
    return label[used], _joined(text.take(pa.array(i)), of, len(used), "\n")


def _squeezed(text: pa.Array) -> pa.Array:
    odd = np.flatnonzero(np.asarray(pc.or_(pc.invert(pc.string_is_ascii(text)), pc.match_substring_regex(text, r"[\t\n\x0b\f\r]|  |^ | $"))))
    out = pc.ascii_lower(text)
    if len(odd):
        mask = np.zeros(len(text), bool)
        mask[odd] = True
        out = pc.replace_with_mask(out, pa.array(mask), pa.array([squeeze(t) for t in text.take(pa.array(odd)).to_pylist()], pa.string()))
    return out


PAIRS = "label string, value string, canonical string, source string, confidence double"
_SOURCES, _SURE = ["inline:separator", "layout:same_row", "section:next_lines"], np.array([0.72, 0.68, 0.66])


def pairs(batches):
    """Batches of (doc_id, label, value, canonical, source, confidence), as ``keyvalue.page_pairs`` has them."""
    for batch in batches:
        b = Batch(batch)
        placed = np.flatnonzero(~np.isnan(b.place.x1))
        order = placed[np.lexsort((b.ord[placed], b.place.x1[placed], b.place.cy[placed], b.page[placed]))]
        b.page, b.place, b.ord, b.text = b.page[order], b.place.take(order), b.ord[order], b.text.take(pa.array(order))
        rule, found = _flags(b.text)
        flags = {c: np.array([getattr(r, c) for r in found], bool)[rule] for c in ("row", "alone", "stop", "head", "block")}
        cut = np.flatnonzero(np.array([r.inline is not None for r in found], bool)[rule])
        inline = [found[k].inline for k in rule[cut].tolist()]
        rows, row_values = _by_row(b, b.text, flags["row"])
        under, under_values = _below(b, b.text, flags)
        # labels as text: a row's is its line, a standalone one is named by the rules
        names = pa.array([r.name for r in found], pa.string()).take(pa.array(rule[under]))
        label = pa.concat_arrays([pa.array([x[0] for x in inline], pa.string()), b.text.take(pa.array(rows)), names])
        value = pa.concat_arrays([pa.array([x[1] for x in inline], pa.string()), row_values, under_values])
        at, kind = np.concatenate([cut, rows, under]), np.repeat([0, 1, 2], [len(cut), len(rows), len(under)])
        coded = label.dictionary_encode()
        known = [named(t) for t in coded.dictionary.to_pylist()]
        norm = np.asarray(pa.array([k[0] for k in known], pa.string()).dictionary_encode().indices)[np.asarray(coded.indices)]
        same = np.asarray(_squeezed(value).dictionary_encode().indices)
        # the first of each folded label and value of a page
        page = b.page[at]
        by = np.lexsort((same, norm, page))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(page[by]) != 0) | (np.diff(norm[by]) != 0) | (np.diff(same[by]) != 0)
        keep = np.sort(by[new])
        field = pa.array([k[1] for k in known], pa.string()).take(coded.indices)
        pick = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.ids.take(pa.array(b.doc[page[keep]])), label.take(pick), value.take(pick), field.take(pick), pa.array(_SOURCES).take(pa.array(kind[keep])), pa.array(_SURE[kind[keep]])], names=["doc_id", "label", "value", "canonical", "source", "confidence"])
