"""Generic label and value pairs from lines, within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lexicon as L
from quire.functions.kernels import let, once, take_until
from quire.functions.text import U, has_any, hits, lines_of, squeeze, strip, tokens
from quire.operators.pages import positioned, row_groups

BLOCKS = list(L.SECTION_ALIASES)
PAIR = "struct<label: string, norm: string, canonical: string, value: string, display: string, source: string, confidence: double, page: int, lines: array<int>>"
_ALIASES = [a for v in L.SECTION_ALIASES.values() for a in v]
_LONG_STOPS = [s for s in L.STOP_LABELS if len(s) >= 4]


def canonical(norm: Column) -> Column:
    """The first field whose alias the label holds."""

    def first(n: Column) -> Column:
        out = None
        for name, aliases in {**L.SECTION_ALIASES, **L.FIELD_ALIASES}.items():
            out = F.when(has_any(n, aliases), name) if out is None else out.when(has_any(n, aliases), name)
        return out

    return let(norm, first)


def known_label(norm: Column) -> Column:
    return norm.isin(*L.STOP_LABELS) | has_any(norm, _LONG_STOPS)


def hinted(norm: Column) -> Column:
    return F.exists(tokens(norm), lambda t: t.isin(*L.LABEL_HINTS))


def mostly_numeric(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"{U}\s", "")
    return (F.length(bare) > 0) & (F.length(F.regexp_replace(bare, r"[^0-9.,/$%-]", "")) > F.length(bare) * 0.65)


def n_words(text: Column) -> Column:
    return F.size(F.split(strip(text), rf"{U}\s+"))


def split_inline(text: Column) -> Column:
    """(label, value) at a colon, at 'name# value' or at two spaces; null where none applies."""
    colon = F.when(F.locate(":", text) > 0, F.locate(":", text)).otherwise(F.locate("：", text))
    hash_, gap = r"^([A-Za-zÀ-ỹ0-9\s./&_-]{2,30})#\s*(.+)$", r"^(.{2,35}?)\s{2,}(.{2,})$"
    pair = lambda a, b: F.struct(strip(a).alias("label"), strip(b).alias("value"))
    return (
        F.when(colon > 0, pair(F.substring(text, F.lit(1), colon - 1), F.substring(text, colon + 1, F.length(text))))
        .when(text.rlike(hash_), pair(F.concat(strip(F.regexp_extract(text, hash_, 1)), F.lit("#")), F.regexp_extract(text, hash_, 2)))
        .when(text.rlike(gap), pair(F.regexp_extract(text, gap, 1), F.regexp_extract(text, gap, 2)))
    )


def is_label(text: Column) -> Column:
    def judge(c: Column) -> Column:
        return F.when((c == "") | (F.length(c) > 45), False).otherwise(let(squeeze(c), lambda n: has_any(n, _ALIASES) | known_label(n) | ((n_words(c) <= 5) & ~mostly_numeric(c) & hinted(n))))

    return let(strip(text, r" :\-#"), judge)


def is_row_label(text: Column) -> Column:
    return let(strip(text, r" :\-#"), lambda c: let(squeeze(c), lambda n: (c != "") & (F.length(c) <= 45) & ~mostly_numeric(c) & (has_any(n, _ALIASES) | known_label(n) | hinted(n))))


def is_standalone(text: Column) -> Column:
    """A label with no value on its own line."""

    def judge(c: Column) -> Column:
        strict = let(squeeze(c), lambda n: n.isin(*_ALIASES) | known_label(n) | ((n_words(c) <= 4) & ~c.rlike(r"\d") & hinted(n)))
        return F.when((c == "") | (F.length(c) > 45) | split_inline(text).isNotNull(), False).when(strict, is_label(c)).otherwise(False)

    return let(strip(text, r" :\-"), judge)


def is_stop(text: Column) -> Column:
    return let(squeeze(strip(text, r" :\-")), lambda n: known_label(n) | n.isin(*_ALIASES))


def is_table_head(text: Column) -> Column:
    return hits(squeeze(text), L.TABLE_MARKERS) >= 2


def pair(label: Column, value: Column, source: str, confidence: float, page: Column, lines: Column) -> Column:
    def make(x: Column) -> Column:
        first = F.get(F.filter(F.transform(F.split(x["value"], "\n"), lambda v: strip(v)), lambda v: v != ""), F.lit(0))
        return F.struct(
            x["label"].alias("label"), x["norm"].alias("norm"), canonical(x["norm"]).alias("canonical"), x["value"].alias("value"), F.coalesce(first, x["value"]).alias("display"),
            F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), page.cast("int").alias("page"), lines.cast("array<int>").alias("lines"),
        ).cast(PAIR)

    return let(F.struct(strip(label).alias("label"), strip(value).alias("value")), lambda x: let(F.struct(x["label"].alias("label"), squeeze(x["label"]).alias("norm"), x["value"].alias("value")), make))


def inline_pairs(lines: Column, page: Column) -> Column:
    made = F.transform(lines, lambda x: let(split_inline(x["text"]), lambda s: F.when(s.isNotNull() & is_label(s["label"]) & (s["value"] != ""), pair(s["label"], s["value"], "inline:separator", 0.72, page, F.array(x["ord"])))))
    return F.filter(made, lambda x: x.isNotNull())


def row_pairs(lines: Column, page: Column) -> Column:
    """The leftmost line of a row labels the rest, if the gap is small."""

    def one(g: Column) -> Column:
        label, rest = F.get(g["lines"], F.lit(0)), F.slice(g["lines"], 2, F.greatest(F.size(g["lines"]) - 1, F.lit(0)))
        value = F.array_join(F.transform(rest, lambda x: x["text"]), " ")
        near = F.array_min(F.transform(rest, lambda x: x["x1"])) - label["x2"] <= 0.24
        return F.when((F.size(g["lines"]) > 1) & near & (value != "") & is_row_label(label["text"]), pair(label["text"], value, "layout:same_row", 0.68, page, F.transform(g["lines"], lambda x: x["ord"])))

    return F.filter(F.transform(row_groups(positioned(lines), 1.1), one), lambda x: x.isNotNull())


def _sections(items: Column, values_of, page: Column) -> Column:
    """Standalone labels with the lines that follow them; lines that a party's block takes label nothing."""

    def step(state: Column, i: Column) -> Column:
        line = F.get(items, i)

        def add(values: Column) -> Column:
            text = F.array_join(F.transform(values, lambda v: v["text"]), "\n")
            block = line["canonical"].isin(*BLOCKS)
            ids = F.transform(values, lambda v: v["ord"])
            made = pair(strip(line["text"], r" :\-"), text, "section:next_lines", 0.66, page, F.concat(F.array(line["ord"]), ids))
            more = F.struct(F.when(F.coalesce(block, F.lit(False)), F.concat(state["covered"], ids)).otherwise(state["covered"]).cast("array<int>").alias("covered"), F.concat(state["pairs"], F.array(made)).cast(f"array<{PAIR}>").alias("pairs"))
            return F.when(F.size(values) > 0, more).otherwise(state)

        return F.when(line["alone"] & ~F.array_contains(state["covered"], line["ord"]), let(values_of(items, i, line), add)).otherwise(state)

    start = F.struct(F.array().cast("array<int>").alias("covered"), F.array().cast(f"array<{PAIR}>").alias("pairs"))
    labels = F.filter(F.transform(items, lambda x, i: F.when(x["alone"], i)), lambda i: i.isNotNull())
    return F.aggregate(labels, start, step, lambda s: s["pairs"])


def _following(items: Column, i: Column, line: Column) -> Column:
    """Values in line order: one line, or a party's block of up to five."""
    after = F.slice(items, i + 2, F.lit(5))
    block = take_until(after, lambda x: x["head"] | x["stop"])
    single = F.slice(take_until(after, lambda x: x["head"]), 1, 1)
    return F.when(F.coalesce(line["canonical"].isin(*BLOCKS), F.lit(False)), block).otherwise(single)


def _below(items: Column, i: Column, line: Column) -> Column:
    """Values under the label, within its column: one line, or a party's block of up to six."""
    block = F.coalesce(line["canonical"].isin(*BLOCKS), F.lit(False))
    left = line["cx"] < 0.5
    lo = F.when(left, F.greatest(F.lit(0.0), line["x1"] - 0.08)).otherwise(F.greatest(F.lit(0.42), line["x1"] - 0.18))
    hi = F.when(left, F.least(F.lit(0.58), F.greatest(line["x2"] + 0.42, line["cx"] + 0.18))).otherwise(F.least(F.lit(1.0), line["x2"] + 0.12))
    depth = F.when(block, 0.34).otherwise(0.12)

    def within(c: Column) -> Column:
        after = F.filter(F.slice(items, i + 2, F.size(items)), lambda x: (x["cy"] > line["cy"]) & (x["cy"] - line["cy"] <= c["depth"]) & (x["cx"] >= c["lo"]) & (x["cx"] <= c["hi"]))
        return F.when(c["block"], F.slice(take_until(after, lambda x: x["head"] | x["stop"]), 1, 6)).otherwise(F.slice(take_until(after, lambda x: x["head"]), 1, 1))

    return let(F.struct(block.alias("block"), lo.alias("lo"), hi.alias("hi"), depth.alias("depth")), within)


def _rules(x: Column, *more: str) -> Column:
    return F.struct(x["ord"].cast("int").alias("ord"), x["text"].alias("text"), F.coalesce(is_standalone(x["text"]), F.lit(False)).alias("alone"), is_stop(x["text"]).alias("stop"), is_table_head(x["text"]).alias("head"), canonical(squeeze(strip(x["text"], r" :\-"))).alias("canonical"), *[x[c].alias(c) for c in more])


def dedupe(pairs: Column) -> Column:
    """The first pair of each folded label and value."""

    def first(p: Column) -> Column:
        keys = F.transform(p, lambda x: F.concat(x["norm"], F.lit("\n"), squeeze(x["value"])))
        return let(keys, lambda k: F.filter(p, lambda x, i: F.array_position(k, F.get(k, i)) == i + 1))

    return let(pairs, first)


def text_pairs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds ``pairs`` from the lines of a text."""
    one = F.lit(1)
    out = once(docs, "_lines", F.transform(lines_of(F.col(text_col)), lambda x: F.struct(x["ord"].cast("int").alias("ord"), x["text"].alias("text"))))
    out = once(out, "_rules", F.transform("_lines", lambda x: _rules(x)))
    return once(out, "pairs", dedupe(F.concat(inline_pairs(F.col("_lines"), one), _sections(F.col("_rules"), _following, one)))).drop("_lines", "_rules")


def page_pairs(pages: DataFrame) -> DataFrame:
    """Adds ``pairs`` from a page's lines: inline, by row and under labels; lines by (cy, x1)."""
    by_place = F.transform(F.array_sort(F.transform(positioned(F.col("lines")), lambda x: F.struct(x["cy"].alias("a"), x["x1"].alias("b"), x["ord"].alias("o"), x.alias("x")))), lambda s: s["x"])
    out = once(pages, "_lines", by_place)
    out = once(out, "_rules", F.transform("_lines", lambda x: _rules(x, "x1", "x2", "cx", "cy")))
    page = F.col("page")
    return once(out, "pairs", dedupe(F.concat(inline_pairs(F.col("_lines"), page), row_pairs(F.col("_lines"), page), _sections(F.col("_rules"), _below, page)))).drop("_lines", "_rules")


def boxed_pairs(pages: DataFrame) -> DataFrame:
    """(doc_id, page, a pair's columns, bbox) of a page's ``pairs``; bbox: the pair's lines in percent, null without boxes."""
    mine = lambda p: F.filter("lines", lambda x: F.array_contains(p["lines"], x["ord"].cast("int")) & x["x1"].isNotNull())

    def box(a: Column) -> Column:
        side = lambda f, c: f(F.transform(a, lambda x: x[c]))
        x1, y1, x2, y2 = side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2")
        percent = lambda v, n: F.round(v * 100, 2).alias(n)
        return F.when(F.size(a) > 0, F.struct(percent(x1, "x"), percent(y1, "y"), percent(x2 - x1, "width"), percent(y2 - y1, "height")))

    each = F.explode(F.transform("pairs", lambda p: F.struct(p.alias("p"), let(mine(p), box).alias("bbox"))))
    return pages.select("doc_id", "page", each.alias("x")).select("doc_id", F.col("x.p.page").alias("page"), *[f"x.p.{c}" for c in ("label", "norm", "canonical", "value", "display", "source", "confidence", "lines")], "x.bbox")


def find_by_field(pairs: Column, field: Column) -> Column:
    """The first pair whose canonical label fills the field."""
    first = lambda names: F.get(F.filter(pairs, lambda p: p["canonical"].isin(*names)), F.lit(0))
    out = None
    for name, names in L.FIELD_CANONICALS.items():
        got = first(names)
        out = F.when(field == name, got) if out is None else out.when(field == name, got)
    return out


def match_question(pairs: Column, question: Column) -> Column:
    """The first pair with the best score of 1.5 or more: shared tokens, 2 for the whole label, 1.5 for its field's name."""

    def best(q: Column) -> Column:
        def scored(p: Column) -> Column:
            shared = F.size(F.array_intersect(q["tokens"], tokens(p["norm"])))
            named = F.coalesce(F.contains(q["norm"], F.translate(p["canonical"], "_", " ")), F.lit(False))
            score = shared + F.when(F.contains(q["norm"], p["norm"]), 2.0).otherwise(0.0) + F.when(named, 1.5).otherwise(0.0)
            return F.struct(F.when(F.size(tokens(p["norm"])) > 0, score).otherwise(0.0).alias("score"), p.alias("p"))

        every = F.transform(pairs, scored)
        return let(every, lambda a: let(F.array_max(F.transform(a, lambda x: x["score"])), lambda top: F.when((top >= 1.5) & (F.size(q["tokens"]) > 0), F.get(F.filter(a, lambda x: x["score"] == top), F.lit(0))["p"])))

    return let(squeeze(question), lambda n: let(F.struct(n.alias("norm"), tokens(n).alias("tokens")), best))
