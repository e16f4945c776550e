"""Layout regions of a page: detectors in a fixed order, each on the lines that the ones before left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicon as L
from quire.functions.kernels import let, median, once, take_until
from quire.functions.text import has_any, hits
from quire.operators.keyvalue import n_words
from quire.operators.pages import positioned, row_groups

REGION = "struct<type: string, label: string, x: double, y: double, width: double, height: double, text: string, confidence: double, source: string, ids: array<int>>"


def region(kind: str, lines: Column, confidence, source: str, label: str | None = None) -> Column:
    """A region over the lines, or null for none; text by (y1, x1), box in percent."""

    def make(a: Column) -> Column:
        edge = lambda f, c: f(F.transform(a, lambda x: x[c]))
        text = F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(x["y1"].alias("y"), x["x1"].alias("x"), i.alias("i"), x["text"].alias("t")))), lambda s: s["t"])
        x1, y1, x2, y2 = edge(F.array_min, "x1"), edge(F.array_min, "y1"), edge(F.array_max, "x2"), edge(F.array_max, "y2")
        pct = lambda v: F.round(v * 100, 2)
        made = F.struct(F.lit(kind).alias("type"), F.lit(label or L.REGION_LABELS[kind]).alias("label"), pct(x1).alias("x"), pct(y1).alias("y"), pct(x2 - x1).alias("width"), pct(y2 - y1).alias("height"), F.array_join(text, "\n").alias("text"),
                        F.round(confidence if isinstance(confidence, Column) else F.lit(confidence), 2).alias("confidence"), F.lit(source).alias("source"), F.transform(a, lambda x: x["ord"].cast("int")).alias("ids"))
        return F.when(F.size(a) > 0, made.cast(REGION))

    return let(lines, make)


def nearby(lines: Column, y_gap: float, x_gap: float) -> Column:
    """Groups of lines by (y1, x1) where each is near the one before."""
    ordered = F.transform(F.array_sort(F.transform(lines, lambda x, i: F.struct(x["y1"].alias("a"), x["x1"].alias("b"), i.alias("i"), x.alias("x")))), lambda s: s["x"])

    def cut(a: Column) -> Column:
        fresh = F.transform(a, lambda x, i: F.when(i == 0, i).when((x["y1"] - F.get(a, i - 1)["y2"] <= y_gap) & (F.abs(x["x1"] - F.get(a, i - 1)["x1"]) <= x_gap), F.lit(None)).otherwise(i))
        starts = F.filter(fresh, lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(s, lambda b, k: F.slice(a, b + 1, F.coalesce(F.get(s, k + 1), F.size(a)) - b)))

    return let(ordered, cut)


def _table(lines: Column, has_table: Column, reach: float | None) -> Column:
    def scored(g: Column) -> Column:
        text = F.array_join(F.transform(g["lines"], lambda x: x["norm"]), " ")
        both = lambda t: has_any(t, ["item", "description", "hang hoa"]) & has_any(t, ["amount", "total", "thanh tien"])
        return let(text, lambda t: F.struct((hits(t, L.LAYOUT_TABLE) + F.when(both(t), 2).otherwise(0)).alias("score"), g["lines"].alias("lines")))

    ok = lambda s: (F.get(s["lines"], F.lit(0))["cy"] < 0.75) & (s["score"] >= 3)
    best = let(F.filter(F.transform(row_groups(lines, 1.2), scored), ok), lambda a: let(F.array_max(F.transform(a, lambda x: x["score"])), lambda m: F.get(F.filter(a, lambda x: x["score"] == m), F.lit(0))["lines"]))

    def grow(head: Column) -> Column:
        bottom = F.array_max(F.transform(head, lambda x: x["y2"]))
        far = lambda x, b: F.lit(False) if reach is None else x["cy"] - b > reach
        body = let(bottom, lambda b: take_until(F.filter(lines, lambda x: x["cy"] > b), lambda x: has_any(x["norm"], L.LAYOUT_TOTAL) | far(x, b)))
        full = let(body, lambda d: F.when(F.size(d) > 0, region("table", F.concat(head, d), 0.86, "layout_rule:table_header")))
        dense = F.filter(lines, lambda x: (x["cy"] >= 0.18) & (x["cy"] <= 0.80))
        other = F.when(has_table, let(dense, lambda d: F.when(F.size(d) >= 3, region("table", d, 0.58, "layout_rule:table_from_extractor", L.REGION_LABELS["dense_table"]))))
        return F.when(head.isNotNull(), full).otherwise(other)

    return let(best, grow)


def _title(lines: Column) -> Column:
    top = F.filter(lines, lambda x: x["cy"] <= 0.28)
    tallest = lambda a: F.slice(F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct((-x["height"]).alias("h"), x["y1"].alias("y"), i.alias("i"), x.alias("x")))), lambda s: s["x"]), 1, 1)

    def pick(t: Column) -> Column:
        named = F.filter(t, lambda x: has_any(x["norm"], L.LAYOUT_TITLE))
        usual = median(F.transform(t, lambda x: x["height"]))
        tall = let(usual, lambda m: F.filter(t, lambda x: (x["height"] >= m * 1.15) | (x["cy"] <= 0.12)))
        free = let(tall, lambda a: F.when(F.size(a) > 0, a).otherwise(F.slice(t, 1, 3)))
        return let(named, lambda n: F.when(F.size(n) > 0, region("title", tallest(n), 0.78, "layout_rule:title")).otherwise(region("title", tallest(free), 0.62, "layout_rule:title")))

    return let(top, pick)


def _keep(r: Column) -> Column:
    return F.filter(F.array(r), lambda x: x.isNotNull())


def regions(pages: DataFrame, tables: DataFrame | None = None, *, table_reach: float | None = 0.62, only: str | None = None) -> DataFrame:
    """(doc_id, page, ord, type, label, x, y, width, height, text, confidence, source) of every region.

    ``tables``: (doc_id, page) of pages with an extracted table, where the densest part counts as one.
    ``table_reach``: how far below its head a table may go, as a share of the page; None: to its last line.
    ``only``: the one type that is asked for; detectors after its own are left out, since none changes what those before it found, and ord counts this type's regions.
    """
    p = pages.select("doc_id", "page", positioned(F.col("lines")).alias("lines")).filter(F.size("lines") > 0)
    if tables is not None:
        p = p.join(tables.select("doc_id", "page", F.lit(True).alias("_has")).distinct(), ["doc_id", "page"], "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    else:
        p = p.withColumn("_has", F.lit(False))
    none = F.array().cast(f"array<{REGION}>")
    table = F.lit(None).cast(REGION) if only == "title" else _table(F.col("lines"), F.col("_has"), table_reach)
    title = F.lit(None).cast(REGION) if only == "table" else _title(F.col("lines"))
    p = once(p, "_table", table)
    p = once(p, "_found", F.concat(_keep(F.col("_table")), _keep(title)).cast(f"array<{REGION}>"))
    top = lambda d: F.coalesce(F.col("_table.y") / 100, F.lit(d))
    total = lambda x: has_any(x["norm"], L.LAYOUT_TOTAL)
    number = lambda a, f: F.filter(F.transform(a, f), lambda r: r.isNotNull())

    def header(free: Column) -> Column:
        return let(F.filter(free, lambda x: x["y1"] < F.least(top(0.30), F.lit(0.34))), lambda a: F.when(F.size(a) >= 2, F.array(region("header", a, 0.72, "layout_rule:top_before_table"))).otherwise(none))

    def info(free: Column) -> Column:
        return number(F.slice(nearby(F.filter(free, lambda x: has_any(x["norm"], L.LAYOUT_INFO)), 0.06, 0.35), 1, 4), lambda g: region("important_info", g, 0.76, "layout_rule:important_keywords"))

    def totals(free: Column) -> Column:
        lines = F.col("lines")
        reach = F.greatest(F.coalesce(median(F.transform(lines, lambda x: x["height"])), F.lit(0.012)) * 1.2, F.lit(0.008))
        same = lambda t, r: F.concat(F.array(t), F.filter(lines, lambda x: (x["ord"] != t["ord"]) & (F.abs(x["cy"] - t["cy"]) <= r)))
        return let(F.filter(free, total), lambda a: _keep(let(reach, lambda r: region("total", F.flatten(F.transform(a, lambda t: same(t, r))), 0.84, "layout_rule:total_keywords"))))

    def signature(free: Column) -> Column:
        def near(a: Column) -> Column:
            side = lambda f, c: f(F.transform(a, lambda x: x[c]))
            box = F.struct((side(F.array_min, "x1") - 0.18).alias("x1"), (side(F.array_max, "x2") + 0.18).alias("x2"), (side(F.array_min, "y1") - 0.08).alias("y1"), (side(F.array_max, "y2") + 0.08).alias("y2"))
            grown = let(box, lambda b: F.filter("lines", lambda x: (x["cx"] >= b["x1"]) & (x["cx"] <= b["x2"]) & (x["cy"] >= b["y1"]) & (x["cy"] <= b["y2"])))
            return F.when(F.size(a) > 0, _keep(region("signature", grown, 0.78, "layout_rule:signature_keywords"))).otherwise(none)

        return let(F.filter(free, lambda x: (x["cy"] >= 0.5) & has_any(x["norm"], L.LAYOUT_SIGNATURE)), near)

    def sides(free: Column) -> Column:
        rows = F.filter(free, lambda x: (x["cy"] < top(0.70)) & (x["cy"] >= 0.08) & (x["cy"] <= 0.60))

        def both(s: Column) -> Column:
            edge = lambda f, c, n: f(F.transform(s[n], lambda x: x[c]))
            overlap = F.least(edge(F.array_max, "y2", "l"), edge(F.array_max, "y2", "r")) - F.greatest(edge(F.array_min, "y1", "l"), edge(F.array_min, "y1", "r"))
            two = F.array(region("left_column", s["l"], 0.66, "layout_rule:two_columns"), region("right_column", s["r"], 0.66, "layout_rule:two_columns"))
            return F.when((F.size(s["l"]) >= 2) & (F.size(s["r"]) >= 2) & (overlap > 0.02), two).otherwise(none)

        return let(rows, lambda a: let(F.struct(F.filter(a, lambda x: x["cx"] < 0.47).alias("l"), F.filter(a, lambda x: x["cx"] > 0.53).alias("r")), both))

    def paragraphs(free: Column) -> Column:
        prose = F.filter(free, lambda x: (n_words(x["text"]) >= 4) & ~total(x) & ~has_any(x["norm"], L.LAYOUT_TABLE))
        long = lambda g: (F.size(g) > 1) | (n_words(F.get(g, F.lit(0))["text"]) >= 8)
        return number(F.slice(nearby(prose, 0.035, 0.12), 1, 6), lambda g: F.when(long(g), region("paragraph", g, F.least(F.size(g), F.lit(4)) * 0.05 + 0.58, "layout_rule:paragraph_group")))

    def footer(free: Column) -> Column:
        return _keep(region("footer", F.filter(free, lambda x: (x["cy"] >= 0.86) | has_any(x["norm"], L.LAYOUT_FOOTER)), 0.62, "layout_rule:bottom_or_footer_keywords"))

    detectors = {("table", "title"): None, ("header",): header, ("important_info",): info, ("total",): totals, ("signature",): signature, ("left_column", "right_column"): sides, ("paragraph",): paragraphs, ("footer",): footer}
    for n, detect in enumerate(detectors.values()):
        if not detect or n > next((k for k, kinds in enumerate(detectors) if only in kinds), n):
            continue
        used = F.flatten(F.transform("_found", lambda r: r["ids"]))
        free = let(used, lambda u: F.filter("lines", lambda x: ~F.array_contains(u, x["ord"].cast("int"))))
        p = once(p, "_found", F.concat(F.col("_found"), let(free, detect)).cast(f"array<{REGION}>"))
    if only:
        p = p.withColumn("_found", F.filter("_found", lambda r: r["type"] == only))
    by_place = F.transform(F.array_sort(F.transform("_found", lambda r, i: F.struct(r["y"].alias("y"), r["x"].alias("x"), i.alias("i"), r.alias("r")))), lambda s: s["r"])
    out = once(p, "_found", dedupe(by_place))
    return out.select("doc_id", "page", F.posexplode("_found").alias("i", "r")).select("doc_id", "page", (F.col("i") + 1).alias("ord"), *[f"r.{c}" for c in ("type", "label", "x", "y", "width", "height", "text", "confidence", "source")])


def numbered(found: DataFrame) -> DataFrame:
    """Regions with ``region_id``: their number over all pages of the document."""
    return found.withColumn("region_id", F.concat(F.lit("region_"), F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord")).cast("string")))


def dedupe(found: Column) -> Column:
    """Regions of a type that cover 85 % of the smaller box are one: the first kept stays."""

    def same(a: Column, b: Column) -> Column:
        w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
        h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
        smaller = F.least(a["width"] * a["height"], b["width"] * b["height"])
        return (a["type"] == b["type"]) & (w > 0) & (h > 0) & (F.try_divide(w * h, smaller) > 0.85)

    return F.aggregate(found, F.array().cast(f"array<{REGION}>"), lambda kept, r: F.when(F.exists(kept, lambda k: F.coalesce(same(k, r), F.lit(False))), kept).otherwise(F.concat(kept, F.array(r))))
