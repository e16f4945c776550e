"""Line-item tables of a page, as folds over the page's arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicon as L
from quire.functions.kernels import let, median, once, take_until
from quire.functions.text import fold, has_any
from quire.operators.pages import positioned, row_groups

COLUMN = "struct<header: string, x1: double, cx: double, lo: double, hi: double>"
NAMES = list(L.HEADERS)


def header_of(text: Column) -> Column:
    """The canonical header that a text names; '#' needs the whole text."""
    norm = fold(text)
    out = F.when(F.replace(norm, F.lit(" "), F.lit("")).isin(*L.HEADERS["#"]), "#")
    for name in NAMES[1:]:
        out = out.when(has_any(norm, L.HEADERS[name]), name)
    return out


def header_row(groups: Column) -> Column:
    """The group that names most headers, the upper one of equals; null if none looks like a table's head."""

    def scored(g: Column) -> Column:
        norm = fold(F.array_join(F.transform(g["lines"], lambda x: x["text"]), " "))
        lines = F.transform(g["lines"], lambda x: header_of(x["text"]))
        whole = let(norm, lambda n: F.filter(F.array(*[F.when(has_any(n, L.HEADERS[h]), h) for h in NAMES]), lambda x: x.isNotNull()))
        names = F.array_union(F.filter(lines, lambda x: x.isNotNull()), whole)
        return let(F.struct(names.alias("names"), norm.alias("norm"), g.alias("g")), lambda s: F.struct((-F.size(s["names"])).alias("k"), s["g"]["cy"].alias("cy"), s["names"].alias("names"), s["norm"].alias("norm"), s["g"]["lines"].alias("lines")))

    shaped = lambda s: (s["k"] <= -3) | (F.array_contains(s["names"], "Item & Description") & (F.array_contains(s["names"], "Qty") | F.array_contains(s["names"], "Amount")))
    ordered = lambda a, b: F.when(a["k"] != b["k"], F.signum(a["k"] - b["k"]).cast("int")).otherwise(F.signum(a["cy"] - b["cy"]).cast("int"))
    return F.get(F.array_sort(F.filter(F.transform(groups, scored), shaped), ordered), F.lit(0))


def columns(head: Column, margin: float = 0.015) -> Column:
    """Columns of a header row with their half-open ranges, left to right; each starts no earlier than the last ends."""

    def ranges(found: Column) -> Column:
        def add(done: Column, i: Column) -> Column:
            c, nxt, last = F.get(found, i), F.get(found, i + 1), F.element_at(done, -1)
            left = F.when(i == 0, F.when(c["header"] == "#", 0.0).otherwise(F.greatest(F.lit(0.0), c["x1"] - margin))).otherwise(F.greatest(last["hi"], c["x1"] - margin))

            def close(lo: Column) -> Column:
                right = F.when(nxt["x1"] - margin <= lo, (c["cx"] + nxt["cx"]) / 2).otherwise(nxt["x1"] - margin)
                hi = F.when(i == F.size(found) - 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(lo + 0.005, right)))
                return F.struct(c["header"].alias("header"), c["x1"].alias("x1"), c["cx"].alias("cx"), lo.alias("lo"), hi.alias("hi"))

            return F.concat(done, F.array(let(left, close).cast(COLUMN)))

        start = F.array().cast(f"array<{COLUMN}>")
        # an empty array has no last element
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, lambda done, i: F.when(F.size(done) == 0, add(F.array(F.struct(F.lit("").alias("header"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).cast(COLUMN)), i)).otherwise(add(done, i)), lambda d: F.filter(d, lambda x: x["header"] != ""))

    named = F.filter(F.transform(head["lines"], lambda x: F.struct(header_of(x["text"]).alias("header"), x["x1"].alias("x1"), x["cx"].alias("cx"))), lambda x: x["header"].isNotNull())
    once = let(named, lambda a: let(F.transform(a, lambda x: x["header"]), lambda hs: F.filter(a, lambda x, i: F.array_position(hs, x["header"]) == i + 1)))
    return let(once, lambda a: F.when(F.size(a) > 0, ranges(a)))


def bottom_of(lines: Column, below: Column) -> Column:
    """Top of the first line under the header that speaks of a total, else the lowest line's end."""
    under = F.array_sort(F.transform(F.filter(lines, lambda x: x["cy"] > below), lambda x: F.struct(x["cy"].alias("cy"), x["ord"].alias("o"), x["y1"].alias("y1"), x["y2"].alias("y2"), has_any(x["norm"], L.STOP_ROWS).alias("stop"))))
    return let(under, lambda u: let(F.get(F.filter(u, lambda x: x["stop"]), F.lit(0))["y1"], lambda y: F.when(y < 1.0, y).otherwise(F.coalesce(F.array_max(F.transform(u, lambda x: x["y2"])), F.lit(1.0)))))


def bands(t: Column) -> Column:
    """Row bands (top, bottom): between row numbers in the first column, else around the rows of lines. t: words, groups, columns, head, bottom."""

    def with_margin(m: Column) -> Column:
        c = F.get(t["columns"], F.lit(0))
        number = lambda w: (w["cy"] > t["head"]) & (w["cy"] < t["bottom"]) & (w["cx"] >= c["lo"]) & (w["cx"] < c["hi"]) & w["text"].rlike(r"^\d{1,3}$")
        found = F.array_sort(F.transform(F.filter(t["words"], number), lambda w: F.struct(w["cy"].alias("cy"), w["height"].alias("height"))))
        apart = F.aggregate(found, F.array().cast("array<double>"), lambda a, w: F.when((F.size(a) > 0) & (F.abs(w["cy"] - F.coalesce(F.get(a, F.size(a) - 1), F.lit(9.0))) < F.greatest(w["height"] * 1.5, F.lit(0.01))), a).otherwise(F.concat(a, F.array(w["cy"]))))
        anchors = F.when(c["header"].isin("#", "STT"), apart).otherwise(F.array().cast("array<double>"))
        between = lambda a: F.filter(F.transform(a, lambda y, i: F.struct(F.greatest(t["head"], y - m).alias("top"), F.coalesce(F.get(a, i + 1) - m, t["bottom"]).alias("bottom"))), lambda b: b["bottom"] > b["top"])
        inside = F.filter(t["groups"], lambda g: (g["cy"] > t["head"]) & (g["cy"] < t["bottom"]))
        around = F.transform(inside, lambda g: F.struct(F.greatest(t["head"], F.array_min(F.transform(g["lines"], lambda x: x["y1"])) - m).alias("top"), F.least(t["bottom"], F.array_max(F.transform(g["lines"], lambda x: x["y2"])) + m).alias("bottom")))
        return let(anchors, lambda a: F.when(F.size(a) > 0, between(a)).otherwise(around))

    return let(F.greatest(F.coalesce(median(F.transform(t["words"], lambda w: w["height"])), F.lit(0.012)) * 1.5, F.lit(0.006)), with_margin)


def cell_text(words: Column) -> Column:
    """Words by row and x, joined; stray spaces by signs go."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(F.bround(w["cy"], 3).alias("r"), w["x1"].alias("x"), w["text"].alias("t"))))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda w: w["t"]), " "), r"\s+", " "))
    return F.replace(F.replace(F.replace(joined, F.lit("$ "), F.lit("$")), F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit("."))


def extract_tables(pages_: DataFrame) -> DataFrame:
    """(doc_id, page, table_id, headers, rows, confidence) of the pages that hold a table with two columns or more; ids count a document's tables."""
    p = pages_.withColumn("_lines", positioned(F.col("lines"))).filter((F.size("_lines") > 0) & (F.size("words") > 0))
    p = once(p, "_groups", row_groups(F.col("_lines"), 1.1))
    p = once(p, "_head", header_row(F.col("_groups"))).filter("_head IS NOT NULL")
    local = has_any(F.col("_head.norm"), L.LOCAL_HEADER_MARKERS)
    rename = lambda h: F.when(local, F.element_at(F.create_map(*[F.lit(x) for kv in L.LOCAL_HEADERS.items() for x in kv]), h)).otherwise(h)
    named = F.transform(columns(F.col("_head")), lambda c: F.struct(rename(c["header"]).alias("header"), c["lo"].alias("lo"), c["hi"].alias("hi")))
    p = once(p, "_columns", named).filter(F.size("_columns") >= 2)
    p = once(p, "_below", F.array_max(F.transform("_head.lines", lambda x: x["y2"])))
    p = once(p, "_bottom", bottom_of(F.col("_lines"), F.col("_below")))
    p = once(p, "_bands", bands(F.struct(F.col("words").alias("words"), F.col("_groups").alias("groups"), F.col("_columns").alias("columns"), F.col("_below").alias("head"), F.col("_bottom").alias("bottom"))))
    cells = lambda ws: F.transform("_columns", lambda c: cell_text(F.filter(ws, lambda w: (w["cx"] >= c["lo"]) & (w["cx"] < c["hi"]))))
    row = lambda b: let(F.filter("words", lambda w: (w["cy"] > F.col("_below")) & (w["cy"] >= b["top"]) & (w["cy"] < b["bottom"])), lambda ws: F.when(F.size(ws) > 0, cells(ws)))
    p = once(p, "_rows", F.filter(F.transform("_bands", row), lambda r: r.isNotNull()))
    p = once(p, "rows", F.filter(take_until(F.col("_rows"), lambda r: has_any(fold(F.array_join(r, " ")), L.STOP_ROWS)), lambda r: F.exists(r, lambda c: F.trim(c) != "")))
    p = p.filter(F.size("rows") > 0).withColumn("headers", F.transform("_columns", lambda c: c["header"]))
    sure = F.round(F.least(F.lit(0.95), F.lit(0.55) + F.size("rows") * 0.08 + F.size("headers") * 0.04), 2)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return p.select("doc_id", "page", F.concat(F.lit("table_"), nth.cast("string")).alias("table_id"), "headers", "rows", sure.alias("confidence"))


def cells(tables: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, header, text)."""
    r = tables.select("doc_id", "page", "headers", F.posexplode("rows").alias("row", "r")).select("*", F.posexplode("r").alias("col", "text"))
    return r.select("doc_id", "page", "row", "col", F.get("headers", F.col("col")).alias("header"), "text")
