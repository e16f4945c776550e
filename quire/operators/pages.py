"""Page geometry: unnesting, rows of lines, reading order, boxes and skew.

The nested document stays one row; a page is one row of arrays, and its kernels are array folds, so
nothing is shuffled between a document and its pages' results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.kernels import clusters, let, median, once
from quire.functions.text import fold, strip


def _box(words: Column) -> Column:
    """Union of the words' boxes; null if none has one."""
    g = F.filter(F.transform(words, lambda w: w["geometry"]), lambda x: x.isNotNull())
    return let(g, lambda b: F.when(F.size(b) > 0, F.struct(F.array_min(F.transform(b, lambda x: x["x1"])).alias("x1"), F.array_min(F.transform(b, lambda x: x["y1"])).alias("y1"), F.array_max(F.transform(b, lambda x: x["x2"])).alias("x2"), F.array_max(F.transform(b, lambda x: x["y2"])).alias("y2"))))


def _place(g: Column) -> list[Column]:
    return [g[c].alias(c) for c in ("x1", "y1", "x2", "y2")] + [((g["x1"] + g["x2"]) / 2).alias("cx"), ((g["y1"] + g["y2"]) / 2).alias("cy"), F.greatest(g["x2"] - g["x1"], F.lit(0.001)).alias("width"), F.greatest(g["y2"] - g["y1"], F.lit(0.001)).alias("height")]


def sheets(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, page, page_width, page_height, n_lines) of (doc_id, pages), and what more is made of the page ``p``. n_lines: all of the page's lines, blank ones too."""
    p = docs.select("doc_id", F.posexplode("pages").alias("i", "p"))
    dims = F.col("p.dimensions")
    ok = (dims["width"] > 0) & (dims["height"] > 0)
    n_lines = F.coalesce(F.aggregate("p.blocks", F.lit(0), lambda n, b: n + F.greatest(F.size(F.coalesce(b["lines"], F.array())), F.lit(0))), F.lit(0))
    return p.select("doc_id", (F.col("i") + 1).alias("page"), F.when(ok, dims["width"]).otherwise(1000.0).alias("page_width"), F.when(ok, dims["height"]).otherwise(1000.0).alias("page_height"), n_lines.alias("n_lines"), *more)


def pages(docs: DataFrame, words: bool = True) -> DataFrame:
    """(doc_id, page, page_width, page_height, n_lines, lines, words) from (doc_id, pages).

    n_lines: all of the page's lines, blank ones too; lines: texts that aren't blank, numbered over the page in document order (``ord``), with a null box where
    neither line nor words have one; words: those with a box, in document order. Without words, lines have none either (rules on lines then copy
    none with each line) and n_words has their number.
    """
    inner = lambda ws: [ws.alias("words")] if words else []
    shown = lambda w: w["geometry"].isNotNull() & (strip(w["value"]) != "")

    def line(block: Column, b: Column, x: Column, n: Column) -> Column:
        kept = F.filter(x["words"], lambda w: F.coalesce(w["value"], F.lit("")) != "")
        return let(kept, lambda ws: let(F.coalesce(x["geometry"], _box(ws)), lambda g: F.struct((b + 1).alias("block"), (n + 1).alias("line"), strip(F.array_join(F.transform(ws, lambda w: w["value"]), " ")).alias("text"), *_place(g), *inner(ws))))

    every = F.flatten(F.transform("p.blocks", lambda block, b: F.transform(block["lines"], lambda x, n: line(block, b, x, n))))
    numbered = let(F.filter(every, lambda x: x["text"] != ""), lambda a: F.transform(a, lambda x, i: F.struct((i + 1).alias("ord"), x["block"].alias("block"), x["line"].alias("line"), x["text"].alias("text"), fold(x["text"]).alias("norm"), *[x[c].alias(c) for c in ("x1", "y1", "x2", "y2", "cx", "cy", "width", "height")], *(inner(x["words"]) if words else []))))
    if not words:
        n_words = F.size(F.filter(F.flatten(F.flatten(F.transform("p.blocks", lambda b: F.transform(b["lines"], lambda x: F.coalesce(x["words"], F.array()))))), shown))
        return sheets(docs, F.explode(F.array(numbered)).alias("lines"), n_words.alias("n_words"))
    rows = sheets(docs, F.explode(F.array(numbered)).alias("lines"))
    word = lambda ln, w: F.struct(ln["ord"].alias("ord"), strip(w["value"]).alias("text"), w["confidence"].alias("confidence"), *_place(w["geometry"]))
    found = F.flatten(F.transform("lines", lambda ln: F.transform(F.filter(ln["words"], shown), lambda w: word(ln, w))))
    return once(rows, "words", found)


def positioned(lines: Column) -> Column:
    return F.filter(lines, lambda x: x["x1"].isNotNull())


def row_groups(lines: Column, factor: float, least: float = 0.008, default: float = 0.012) -> Column:
    """Array of (cy, lines by x1): greedy rows of lines, tolerance factor * median height."""

    def group(items: Column) -> Column:
        tolerance = F.greatest(F.coalesce(median(F.transform(items, lambda x: x["height"])), F.lit(default)) * factor, F.lit(least))
        found = clusters(F.transform(items, lambda x: x["cy"]), tolerance)
        by_x = lambda a: F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x["x1"].alias("k"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
        return F.transform(found, lambda g: F.struct((g["total"] / g["n"]).alias("cy"), by_x(F.transform(g["members"], lambda m: F.get(items, m))).alias("lines")))

    by_y = F.transform(F.array_sort(F.transform(lines, lambda x: F.struct(x["cy"].alias("k"), x["ord"].alias("o"), x.alias("x")))), lambda s: s["x"])
    return let(by_y, group)


def slope(points: Column, least_dx: float) -> Column:
    """Median slope of point rows (arrays of (x, y) by x); steep and short ones are left out, 0 for none."""

    def one(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.element_at(p, -1)
        dx = b["x"] - a["x"]
        return F.when((F.size(p) > 1) & (dx >= least_dx), (b["y"] - a["y"]) / F.nullif(dx, F.lit(0.0)))

    slopes = F.filter(F.transform(points, lambda p: F.when(F.size(p) > 1, one(p))), lambda s: s.isNotNull() & (F.abs(s) <= 0.35))
    return F.coalesce(median(slopes), F.lit(0.0))


def word_points(lines: Column, width: Column, height: Column, key: str = "x1") -> Column:
    """Each line's word centres in pixels, by the word's left side."""
    centre = lambda g: F.struct(g[key].alias("k"), ((g["x1"] + g["x2"]) / 2 * width).alias("x"), ((g["y1"] + g["y2"]) / 2 * height).alias("y"))
    return F.transform(lines, lambda ln: F.array_sort(F.transform(F.filter(ln["words"], lambda w: w["geometry"].isNotNull()), lambda w: centre(w["geometry"]))))


def _ordered(items: Column, tilt: Column, width: Column, height: Column, factor: float, least: float) -> Column:
    """Array of rows (arrays of items): rows by mean key, items by x and then by place."""

    def place(x: Column, i: Column) -> Column:
        return F.struct((x["cy"] * height - tilt * (x["cx"] * width)).alias("row"), (x["x1"] * width).alias("col"), i.alias("i"), x.alias("x"))

    def group(s: Column) -> Column:
        tolerance = F.greatest(median(F.transform(s, lambda x: x["x"]["height"] * height)) * factor, F.lit(least))
        found = clusters(F.transform(s, lambda x: x["row"]), tolerance)
        by_mean = F.array_sort(F.transform(found, lambda g, n: F.struct((g["total"] / g["n"]).alias("m"), n.alias("n"), g["members"].alias("members"))))
        row = lambda g: F.transform(F.array_sort(F.transform(g["members"], lambda m: let(F.get(s, m), lambda y: F.struct(y["col"].alias("c"), y["i"].alias("i"), y["x"].alias("x"))))), lambda y: y["x"])
        return F.transform(by_mean, row)

    return let(F.array_sort(F.transform(items, place)), group)


def word_rows() -> Column:
    """Rows of a page's words in reading order, of its words, slope and size."""
    return _ordered(F.col("words"), F.col("slope"), F.col("page_width"), F.col("page_height"), 0.75, 7.0)


def reading_order(pages_: DataFrame) -> DataFrame:
    """Adds slope, row_text (rows of words in reading order) and ordered (lines in reading order, those without a box last)."""
    w, h = F.col("page_width"), F.col("page_height")
    out = once(pages_, "slope", slope(word_points(F.col("lines"), w, h), 25))
    out = once(out, "line_slope", slope(word_points(positioned(F.col("lines")), w, h), 30))
    text = F.array_join(F.transform(word_rows(), lambda r: F.array_join(F.transform(r, lambda x: x["text"]), " ")), "\n")
    lines = F.flatten(_ordered(positioned(F.col("lines")), F.col("line_slope"), w, h, 0.9, 8.0))
    return out.withColumns({"row_text": F.when(F.size("words") > 0, text).otherwise(""), "ordered": F.concat(F.coalesce(lines, F.filter("lines", lambda x: F.lit(False))), F.filter("lines", lambda x: x["x1"].isNull()))})


def document_text(ordered_pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages by number, an empty line between; rows of words if any page has them, else lines."""
    lines = F.array_join(F.transform("ordered", lambda x: x["text"]), "\n")
    page = F.struct("page", F.col("row_text").alias("w"), lines.alias("l"))
    per = ordered_pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    join = lambda c: F.array_join(F.filter(F.transform("p", lambda x: x[c]), lambda x: x != ""), "\n\n")
    return per.select("doc_id", F.when(join("w") != "", join("w")).otherwise(join("l")).alias("text"))


def boxes(ordered_pages: DataFrame) -> DataFrame:
    """(doc_id, page, id, label, x, y, width, height) in percent; a line without a box takes a number but gives no row."""
    b = ordered_pages.select("doc_id", "page", F.posexplode("ordered").alias("i", "x")).filter("x.x1 IS NOT NULL")
    return b.select("doc_id", "page", (F.col("i") + 1).cast("string").alias("id"), F.col("x.text").alias("label"), (F.col("x.x1") * 100).alias("x"), (F.col("x.y1") * 100).alias("y"), ((F.col("x.x2") - F.col("x.x1")) * 100).alias("width"), ((F.col("x.y2") - F.col("x.y1")) * 100).alias("height"))


def chosen_boxes(ordered_pages: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """Boxes in reading order for the documents that ``special`` (doc_id) names as straightened, in document order for others."""
    if special is None:
        return raw_boxes(ordered_pages)
    ids = special.select("doc_id").distinct()
    return raw_boxes(ordered_pages.join(ids, "doc_id", "left_anti")).unionByName(boxes(ordered_pages.join(ids, "doc_id", "left_semi")))


def raw_text(docs: DataFrame, special: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, pages) in document order, a blank line after each block; where ``special`` (doc_id) names a
    document as straightened and its reading order gives a text, that text."""
    line = lambda x: F.concat(F.array_join(F.transform(x["words"], lambda w: w["value"]), " "), F.lit("\n"))
    block = lambda b: F.concat(F.array_join(F.transform(b["lines"], line), ""), F.lit("\n"))
    text = F.array_join(F.flatten(F.transform("pages", lambda p: F.transform(p["blocks"], block))), "")
    plain = docs.select("doc_id", F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "").alias("text"))
    if special is None:
        return plain
    straight = document_text(reading_order(pages(docs.join(special.select("doc_id").distinct(), "doc_id", "left_semi")))).withColumnRenamed("text", "_text")
    return plain.join(straight, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("_text") != "", F.col("_text")), F.col("text")).alias("text"))


def raw_boxes(pages_: DataFrame) -> DataFrame:
    """As boxes, in document order; a line without a box spans the page."""
    b = pages_.select("doc_id", "page", F.explode("lines").alias("x"))
    side = lambda c, d: F.coalesce(F.col(f"x.{c}"), F.lit(d))
    return b.select("doc_id", "page", F.col("x.ord").cast("string").alias("id"), F.col("x.text").alias("label"), (side("x1", 0.0) * 100).alias("x"), (side("y1", 0.0) * 100).alias("y"), ((side("x2", 1.0) - side("x1", 0.0)) * 100).alias("width"), ((side("y2", 1.0) - side("y1", 0.0)) * 100).alias("height"))


def thousandths(g: Column) -> Column:
    """[x1, y1, x2, y2] as whole thousandths between 0 and 1000, the second corner never before the first."""
    n = lambda c: F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(g[c] * 1000).cast("int")))
    return F.when(g.isNotNull(), F.array(n("x1"), n("y1"), F.greatest(n("x1"), n("x2")), F.greatest(n("y1"), n("y2"))))


def low_confidence(pages_: DataFrame, limit: float = 0.55) -> DataFrame:
    """(doc_id, page, text, confidence) of the words below the limit; a null confidence isn't low."""
    return pages_.select("doc_id", "page", F.explode("words").alias("w")).filter(F.col("w.confidence") < limit).select("doc_id", "page", "w.text", "w.confidence")


def words_below(docs: DataFrame, limit: float = 0.55) -> DataFrame:
    """As low_confidence, of (doc_id, pages): the words are unnested without their lines."""
    out = docs.select("doc_id", F.posexplode("pages").alias("i", "p"))
    for field, name in (("p.blocks", "b"), ("b.lines", "l"), ("l.words", "w")):
        out = out.select("doc_id", "i", F.explode(field).alias(name))
    low = out.filter((F.col("w.confidence") < limit) & F.col("w.geometry").isNotNull())
    return low.select("doc_id", (F.col("i") + 1).alias("page"), strip(F.col("w.value")).alias("text"), "w.confidence").filter(F.col("text") != "")


def suggest_tables(pages_: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, page, n_lines) of pages with so many lines that a table is likely."""
    return pages_.filter(F.col("n_lines") >= least).select("doc_id", "page", "n_lines")


def paragraph_gaps(tops: Column) -> Column:
    """For each row top after the first: whether the step down is a paragraph's."""

    def flags(steps: Column) -> Column:
        usual = F.coalesce(median(F.filter(steps, lambda s: s > 0.002)), F.lit(0.035))
        return let(usual, lambda m: F.transform(steps, lambda s: s > F.greatest(m * 1.35, m + 0.012)))

    return let(F.transform(F.slice(tops, 2, F.greatest(F.size(tops) - 1, F.lit(0))), lambda y, i: y - F.get(tops, i)), flags)


def spaced_text(words: Column) -> Column:
    """A row's words with spaces in proportion to the gaps; words: (text, x1, x2, width) by x1."""

    def join(m: Column) -> Column:
        def gap(x: Column, i: Column) -> Column:
            g = x["x1"] - F.get(words, i - 1)["x2"]
            wide = F.least(F.greatest(F.floor(g / F.greatest(m, F.lit(0.001))).cast("int"), F.lit(2)), F.lit(10))
            return F.when(i == 0, "").when(g > m * 2.2, F.repeat(F.lit(" "), wide)).otherwise(" ")

        return strip(F.array_join(F.transform(words, lambda x, i: F.concat(gap(x, i), x["text"])), ""))

    return let(F.coalesce(median(F.filter(F.transform(words, lambda x: x["width"]), lambda v: v > 0)), F.lit(0.015)), join)


def spaced_rows(ordered_pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): all of a page's rows of words in reading order, a line each, spaced by their gaps; empty without words."""
    text = F.array_join(F.transform(word_rows(), spaced_text), "\n")
    return ordered_pages.select("doc_id", "page", F.when(F.size("words") > 0, text).otherwise("").alias("text"))
