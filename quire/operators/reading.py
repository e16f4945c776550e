"""Reading order over Arrow batches of (doc_id, pages): the rules of ``pages`` in numpy, all pages of a batch at once.

Array functions inside a row are interpreted; where whole tables are read, these functions take the nested form as it
leaves Python, so that words need not go to the JVM and back.  Results are those of ``pages.pages``, ``reading_order``,
``boxes`` and ``spaced_rows``; a block without lines counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any script, as a pattern's white space in the JVM.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def inner(a: pa.Array, *names: str) -> pa.Array:
    for n in names:
        a = pc.struct_field(a, n)
    return a


def doubles(a: pa.Array) -> np.ndarray:
    """Numbers, NaN for missing ones."""
    return a.cast(pa.float64()).to_numpy(zero_copy_only=False)


def opened(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which list each item is of, and the items."""
    return np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0))), pc.list_flatten(lists)


def nth(of: np.ndarray) -> np.ndarray:
    """Each item's place among those of the same (sorted) owner."""
    return np.arange(len(of)) - np.searchsorted(of, of)


def trimmed(text: pa.Array) -> pa.Array:
    return pc.utf8_trim(text, SPACE)


@dataclass
class Boxes:
    x1: np.ndarray
    y1: np.ndarray
    x2: np.ndarray
    y2: np.ndarray

    def __post_init__(self):
        self.cx, self.cy = (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2
        self.width, self.height = np.fmax(self.x2 - self.x1, 0.001), np.fmax(self.y2 - self.y1, 0.001)

    def take(self, at) -> Boxes:
        return Boxes(self.x1[at], self.y1[at], self.x2[at], self.y2[at])


def boxes_in(a: pa.Array) -> Boxes:
    return Boxes(*(doubles(inner(a, c)) for c in ("x1", "y1", "x2", "y2")))


class Batch:
    """A batch's pages, and their lines and words as flat arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.doc, pages = opened(batch.column("pages"))
        self.ids, self.number, self.n = batch.column("doc_id"), nth(self.doc) + 1, len(self.doc)
        width, height = (doubles(inner(pages, "dimensions", c)) for c in ("width", "height"))
        ok = (width > 0) & (height > 0)
        self.width, self.height = np.where(ok, width, 1000.0), np.where(ok, height, 1000.0)
        page, blocks = opened(inner(pages, "blocks"))
        block, lines = opened(inner(blocks, "lines"))
        line, words = opened(inner(lines, "words"))
        page, value, geometry = page[block], inner(words, "value"), inner(words, "geometry")
        kept = np.flatnonzero(np.asarray(pc.not_equal(value, "").fill_null(False)))
        if len(kept) < len(line):
            line, value, geometry = line[kept], value.take(pa.array(kept)), geometry.take(pa.array(kept))
        text = trimmed(pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(len(lines) + 1)).astype(np.int32)), value), " "))
        boxed, place = np.asarray(geometry.is_valid()), boxes_in(geometry)
        whole = self._line_boxes(inner(lines, "geometry"), line[boxed], place.take(boxed))
        shown = np.flatnonzero(np.asarray(pc.not_equal(text, "")))
        self.page, self.text, self.place = page[shown], text.take(pa.array(shown)), whole.take(shown)
        self.ord = nth(self.page) + 1
        # words of lines that are shown; blank ones have no line's text but may be in one
        at = np.full(len(lines), -1)
        at[shown] = np.arange(len(shown))
        mine = np.flatnonzero(boxed & (at[line] >= 0))
        self.word_line, self.word, self.word_value = at[line[mine]], place.take(mine), value.take(pa.array(mine))

    @staticmethod
    def _line_boxes(own: pa.Array, line: np.ndarray, words: Boxes) -> Boxes:
        """A line's own box or else the union of its words'; NaN without either."""
        given, out = np.asarray(own.is_valid()), boxes_in(own)
        start = np.flatnonzero(np.diff(line, prepend=-1))
        if len(start) and not given.all():
            has, sides = line[start], []
            for side, f in (("x1", np.fmin), ("y1", np.fmin), ("x2", np.fmax), ("y2", np.fmax)):
                union = np.full(len(own), np.nan)
                union[has] = f.reduceat(getattr(words, side), start)
                sides.append(np.where(given, getattr(out, side), union))
            return Boxes(*sides)
        return out

    def slopes(self, least_dx: float) -> np.ndarray:
        """Each page's median slope of its lines, from a line's first word to its last; steep and short ones are left out."""
        line, w = self.word_line, self.word
        page = self.page[line]
        x, y = w.cx * self.width[page], w.cy * self.height[page]
        order = np.lexsort((y, x, w.x1, line))
        line, x, y = line[order], x[order], y[order]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        last = np.r_[first[1:], len(line)] - 1
        dx, dy = x[last] - x[first], y[last] - y[first]
        some = (last > first) & (dx >= least_dx) & (dx != 0)
        with np.errstate(all="ignore"):
            s = dy[some] / dx[some]
        flat = np.abs(s) <= 0.35
        return np.nan_to_num(medians(s[flat], self.page[line[first[some]]][flat], self.n))

    def rows(self, page: np.ndarray, place: Boxes, tilt: np.ndarray, factor: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Items of (sorted) pages in reading order, and whether each begins a row."""
        w, h = self.width[page], self.height[page]
        row, col = place.cy * h - tilt[page] * (place.cx * w), place.x1 * w
        order = np.lexsort((col, row, page))
        of = clusters(row[order], page[order], np.fmax(medians(place.height * h, page, self.n) * factor, least))
        back = np.empty(len(order), np.int64)
        back[order] = of
        final = np.lexsort((col, back, page))
        p, of = page[final], back[final]
        return final, (np.diff(p, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0)


def medians(values: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    """Each page's median, the mean of the middle two for an even count; NaN for none."""
    order = np.lexsort((values, page))
    edge = np.searchsorted(page[order], np.arange(n + 1))
    size, out, v = np.diff(edge), np.full(n, np.nan), values[order]
    some = np.flatnonzero(size)
    out[some] = (v[edge[some] + (size[some] + 1) // 2 - 1] + v[edge[some] + size[some] // 2]) / 2
    return out


def clusters(keys: np.ndarray, page: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """``kernels.clusters`` of each page: the number of each key's cluster. Keys ascend within a page, so none is near a cluster before the last."""
    begin = np.flatnonzero(np.diff(page, prepend=-1))
    size = np.diff(begin, append=len(page))
    longest = np.argsort(-size, kind="stable")
    begin, size = begin[longest], size[longest]
    tolerance = tolerance[page[begin]] if len(begin) else tolerance
    out, total, n, c = np.zeros(len(keys), np.int64), np.full(len(begin), np.nan), np.ones(len(begin)), np.full(len(begin), -1)
    for k in range(int(size[0]) if len(size) else 0):
        a = int(np.searchsorted(-size, -k, side="left"))
        x = keys[begin[:a] + k]
        near = np.abs(x - total[:a] / n[:a]) <= tolerance[:a]
        total[:a], n[:a] = np.where(near, total[:a] + x, x), np.where(near, n[:a] + 1, 1)
        c[:a] += ~near
        out[begin[:a] + k] = c[:a]
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As the JVM rounds doubles: half up by their decimal digits."""
    with np.errstate(all="ignore"):
        scaled = x * 10.0**digits
        whole = np.rint(scaled)
        out = whole / 10.0**digits
        # near a half, or where a double has few digits left, the decimal digits decide
        doubt = ~(np.abs(np.abs(scaled - whole) - 0.5) > 1e-3) | ~(np.abs(scaled) < 1e12)
    for i in np.flatnonzero(doubt & np.isfinite(x)).tolist():
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(x[i]) < 1e15 else x[i]
    return np.where(np.isfinite(x), out + 0.0, x)


def boxes(batches, digits: int | None = None):
    """Batches of (doc_id, page, id, label, x, y, width, height), as ``pages.boxes``; rounded if digits are given."""
    for batch in batches:
        b = Batch(batch)
        placed = np.flatnonzero(~np.isnan(b.place.x1))
        page, place = b.page[placed], b.place.take(placed)
        order, _ = b.rows(page, place, b.slopes(30), 0.9, 8.0)
        page, place = page[order], place.take(order)
        sides = [place.x1 * 100, place.y1 * 100, (place.x2 - place.x1) * 100, (place.y2 - place.y1) * 100]
        sides = [pa.array(s if digits is None else rounded(s, digits), from_pandas=True) for s in sides]
        ids, label = pa.array(nth(page) + 1).cast(pa.string()), b.text.take(pa.array(placed[order]))
        yield pa.RecordBatch.from_arrays([b.ids.take(pa.array(b.doc[page])), pa.array(b.number[page].astype(np.int32)), ids, label, *sides], names=["doc_id", "page", "id", "label", "x", "y", "width", "height"])


def spaced(batches):
    """Batches of (doc_id, page, text), as ``pages.spaced_rows``."""
    for batch in batches:
        b = Batch(batch)
        value = trimmed(b.word_value)
        shown = np.flatnonzero(np.asarray(pc.not_equal(value, "")))
        value, page, place = value.take(pa.array(shown)), b.page[b.word_line[shown]], b.word.take(shown)
        order, new = b.rows(page, place, b.slopes(25), 0.75, 7.0)
        page, place, value = page[order], place.take(order), value.take(pa.array(order))
        row = np.cumsum(new) - 1
        usual = medians(place.width, row, int(row[-1]) + 1 if len(row) else 0)[row]
        gap = place.x1 - np.r_[np.nan, place.x2[:-1]]
        with np.errstate(all="ignore"):
            wide = np.clip(np.nan_to_num(np.floor(gap / np.fmax(usual, 0.001)), nan=2), 2, 10).astype(np.int64)
            kind = np.where(new, np.where(np.diff(page, prepend=-1) != 0, 0, 1), np.where(gap > usual * 2.2, wide + 1, 2))
        # what stands before a word: nothing, a line's end, one space, or 2 to 10
        before = pa.array(["", "\n", " ", *[" " * k for k in range(2, 11)]]).take(pa.array(kind))
        text = pc.binary_join_element_wise(before, value, "")
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(b.n + 1)).astype(np.int32)), text), "")
        yield pa.RecordBatch.from_arrays([b.ids.take(pa.array(b.doc)), pa.array(b.number.astype(np.int32)), joined], names=["doc_id", "page", "text"])


BOXES = "page int, id string, label string, x double, y double, width double, height double"
SPACED = "page int, text string"
