"""Queries over recognised pages: rows, reading order, boxes, tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quire.operators import pages as P
from quire.operators import reading as R
from quire.operators import tables as T
from quire.sources.synthetic import LINES_SQL, structured

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages(spark, sf_dir, **how):
    return P.pages(structured(spark, sf_dir), **how)


WITH = f"""WITH {LINES_SQL},
lw AS (SELECT doc_id, page, line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(text, ' ' ORDER BY word) AS text FROM ocr_words GROUP BY 1, 2, 3)"""


@query(f"{WITH} SELECT doc_id, page, count(*)::INT AS n_lines, count(DISTINCT y1)::INT AS n_rows, (SELECT count(*) FROM ocr_words w WHERE w.doc_id = lw.doc_id)::INT AS n_words FROM lw GROUP BY doc_id, page".replace("(SELECT count(*) FROM ocr_words w WHERE w.doc_id = lw.doc_id)::INT AS n_words FROM lw", "sum(len(string_split(text, ' ')))::INT AS n_words FROM lw"))
def row_clusters(spark, sf_dir):
    return pages(spark, sf_dir, words=False).select("doc_id", "page", F.size("lines").alias("n_lines"), F.size(P.row_groups(F.col("lines"), 1.1)).alias("n_rows"), "n_words")


@query(f"{WITH} SELECT DISTINCT doc_id, page, 0.0::DOUBLE AS slope FROM lw")
def skew_slope(spark, sf_dir):
    return P.reading_order(pages(spark, sf_dir)).select("doc_id", "page", "slope")


@query(f"{WITH}, r AS (SELECT doc_id, y1, string_agg(text, ' ' ORDER BY x1, line, word) AS t FROM ocr_words GROUP BY 1, 2) SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY y1)) AS text FROM r GROUP BY 1")
def reading_order_text(spark, sf_dir):
    d = P.document_text(P.reading_order(pages(spark, sf_dir)))
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"{WITH} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1)::VARCHAR AS id, text AS label, round(x1 * 100, 6) AS x, round(y1 * 100, 6) AS y, round((x2 - x1) * 100, 6) AS width, round((y2 - y1) * 100, 6) AS height FROM lw")
def bounding_boxes(spark, sf_dir):
    return structured(spark, sf_dir, partial(R.boxes, digits=6), R.BOXES)


@query(f"{WITH} SELECT doc_id, page, count(*)::INT AS n_lines FROM lw GROUP BY 1, 2 HAVING count(*) >= 12")
def suggest_tables(spark, sf_dir):
    return P.suggest_tables(P.sheets(structured(spark, sf_dir)))


@query(f"WITH {LINES_SQL} SELECT doc_id, page, text, confidence FROM ocr_words WHERE confidence < 0.55")
def low_confidence_words(spark, sf_dir):
    return P.words_below(structured(spark, sf_dir))


@query(f"{WITH}, t AS (SELECT DISTINCT doc_id, y1 FROM lw), s AS (SELECT doc_id, y1 - lag(y1) OVER (PARTITION BY doc_id ORDER BY y1) AS d FROM t), m AS (SELECT doc_id, median(d) AS m FROM s WHERE d > 0.002 GROUP BY 1) SELECT doc_id, count(*) FILTER (WHERE d > greatest(m * 1.35, m + 0.012))::INT AS n_gaps FROM s JOIN m USING (doc_id) GROUP BY 1")
def paragraph_gaps(spark, sf_dir):
    tops = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["y1"])))
    return pages(spark, sf_dir, words=False).select("doc_id", F.size(F.filter(P.paragraph_gaps(tops), lambda x: x)).alias("n_gaps"))


@query()
def row_spacing_text(spark, sf_dir):
    return structured(spark, sf_dir, R.spaced, R.SPACED)


@query(f"{WITH} SELECT doc_id, page, 0.214::DOUBLE AS below, 5 AS n_headers FROM lw WHERE text = '#' GROUP BY 1, 2")
def table_header(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("h", T.header_row(P.row_groups(P.positioned(F.col("lines")), 1.1))).filter("h IS NOT NULL")
    return p.select("doc_id", "page", F.array_max(F.transform("h.lines", lambda x: x["y2"])).alias("below"), F.size("h.names").alias("n_headers"))


@query(f"""WITH {LINES_SQL}, h AS (SELECT doc_id, page, text AS header, min(x1m) OVER w / 1000.0::DOUBLE - 0.015 AS x, row_number() OVER w AS k, lead(x1m) OVER w AS nx FROM ocr_lines WHERE line BETWEEN 4 AND 8 WINDOW w AS (PARTITION BY doc_id ORDER BY x1m ROWS BETWEEN CURRENT ROW AND CURRENT ROW))
SELECT doc_id, page, (k - 1)::INT AS col, header, round(CASE WHEN k = 1 THEN 0 ELSE x END, 6)::DOUBLE AS lo, round(coalesce(nx / 1000.0::DOUBLE - 0.015, 1), 6)::DOUBLE AS hi FROM h""")
def table_columns(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("h", T.header_row(P.row_groups(P.positioned(F.col("lines")), 1.1))).withColumn("c", T.columns(F.col("h")))
    return p.select("doc_id", "page", F.posexplode("c").alias("col", "x")).select("doc_id", "page", "col", "x.header", F.round("x.lo", 6).alias("lo"), F.round("x.hi", 6).alias("hi"))


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc_id, page, line, text, dense_rank() OVER (PARTITION BY doc_id ORDER BY y1m) - 1 AS r, line % 10 AS c FROM ocr_lines WHERE line BETWEEN 10 AND 899)
SELECT doc_id, page, r::INT AS row, c::INT AS col, ['#', 'Item & Description', 'Qty', 'Rate', 'Amount'][c + 1] AS header, text FROM b""")
def table_cells(spark, sf_dir):
    return T.cells(T.extract_tables(pages(spark, sf_dir)))


@query(f"""WITH {LINES_SQL}, b AS (SELECT doc_id, page, count(DISTINCT y1m) AS n FROM ocr_lines WHERE line BETWEEN 10 AND 899 GROUP BY 1, 2)
SELECT doc_id, page, n::INT AS n_rows, round(least(0.95::DOUBLE, 0.55::DOUBLE + n * 0.08::DOUBLE + 0.2::DOUBLE), 2) AS confidence FROM b""")
def table_bands(spark, sf_dir):
    return T.extract_tables(pages(spark, sf_dir)).select("doc_id", "page", F.size("rows").alias("n_rows"), "confidence")
