"""Queries over requests, runs and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import fields as E
from quire.operators import monitoring as M
from quire.plans.text_queries import _AMT, WITH, classified
from quire.sources.synthetic import REQUESTS_SQL, TEXT_SQL, ocr_text, requests, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rank(values: str, p: int) -> str:
    return f"round_even(list_sort({values})[round_even({p} / 100.0 * (len({values}) - 1), 0)::INT + 1], 2)"


LAST = f"WITH {REQUESTS_SQL}, r AS (SELECT * FROM requests ORDER BY ts DESC, ord DESC LIMIT 500), v AS (SELECT list(latency_ms) AS l FROM r)"


@query(f"""{LAST},
p AS (SELECT path, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, path LIMIT 10), s AS (SELECT status_code, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS requests_total, sum((status_code >= 400)::INT)::BIGINT AS errors_total, round_even(sum((status_code >= 400)::INT) / count(*), 4) AS error_rate, CASE WHEN max(latency_ms) > 1 THEN round_even(avg(latency_ms), 2) ELSE round_even(avg(latency_ms), 4) END AS avg_ms,
  (SELECT {_rank('l', 50)} FROM v) AS p50_ms, (SELECT {_rank('l', 95)} FROM v) AS p95_ms, round_even(max(latency_ms), 2) AS max_ms,
  (SELECT string_agg(path || '=' || n, ',' ORDER BY n DESC, path) FROM p) AS by_path, (SELECT string_agg(status_code || '=' || n, ',' ORDER BY status_code) FROM s) AS by_status FROM r""")
def api_summary(spark, sf_dir):
    return M.api_summary(requests(spark, sf_dir))


@query(f"{LAST} SELECT ord, path, status_code, latency_ms FROM r")
def last_n_window(spark, sf_dir):
    return M.last_n(requests(spark, sf_dir), 500).select("ord", "path", "status_code", "latency_ms")


@query(f"WITH {REQUESTS_SQL}, v AS (SELECT path, list(latency_ms) AS l FROM requests GROUP BY 1) SELECT path, {_rank('l', 50)} AS p50, {_rank('l', 95)} AS p95 FROM v")
def nearest_rank_percentile(spark, sf_dir):
    return M.percentiles_by(requests(spark, sf_dir), "path", "latency_ms")


def runs(spark, sf_dir):
    """Runs as the monitor keeps them, from orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw, after = (k % 100) / 100.0, (k % 37) / 100.0
    return o.select(F.col("o_orderdate").alias("ts"), k.alias("ord"), raw.alias("raw_error_rate"), after.alias("after_ai_error_rate"), F.bround(F.col("o_totalprice") / 1000, 2).alias("duration_ms"), M.quality_level(after).alias("quality_level"))


RUNS = """WITH r AS (SELECT o_orderdate AS ts, o_orderkey AS ord, (o_orderkey % 100) / 100.0::DOUBLE AS raw, (o_orderkey % 37) / 100.0::DOUBLE AS after_, round_even(o_totalprice / 1000, 2) AS ms FROM orders),
q AS (SELECT *, CASE WHEN after_ >= 0.35 THEN 'poor' WHEN after_ >= 0.15 THEN 'degraded' ELSE 'good' END AS lvl FROM r ORDER BY ts DESC, ord DESC LIMIT 200), v AS (SELECT list(ms) AS l FROM q)"""


@query(f"""{RUNS}, s AS (SELECT count(*) AS runs_total, sum((lvl = 'poor')::INT)::BIGINT AS poor_runs_total, round_even(avg(raw), 4) AS average_raw_error_rate, round_even(avg(after_), 4) AS average_after_ai_error_rate, round_even(avg(ms), 2) AS avg_ms,
  (SELECT {_rank('l', 95)} FROM v) AS p95_ms, round_even(max(ms), 2) AS max_ms, arg_max(lvl, (ts, ord)) AS latest_level FROM q)
SELECT *, round_even(poor_runs_total / runs_total, 4) AS poor_rate, round_even(greatest(average_raw_error_rate - average_after_ai_error_rate, 0), 4) AS average_improvement_rate FROM s""")
def run_summary(spark, sf_dir):
    return M.run_summary(runs(spark, sf_dir))


@query(f"""{RUNS}, {REQUESTS_SQL}, a AS (SELECT * FROM requests ORDER BY ts DESC, ord DESC LIMIT 500), s AS (SELECT round_even(sum((status_code >= 400)::INT) / count(*), 4) AS error_rate, count(*) AS requests_total FROM a)
SELECT CASE WHEN error_rate >= 0.2 OR (SELECT arg_max(lvl, (ts, ord)) FROM q) = 'poor' THEN 'degraded' ELSE 'ok' END AS status, error_rate, requests_total, (SELECT count(*) FROM q) AS runs_total FROM s""")
def health(spark, sf_dir):
    return M.health(M.api_summary(requests(spark, sf_dir)), M.run_summary(runs(spark, sf_dir)))


@query(f"""{WITH}, t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' WHEN 2 THEN 'receipt' WHEN 3 THEN 'warehouse_note' WHEN 4 THEN 'form' END AS want, (doc_id % 50)::DOUBLE AS ms FROM ocr_text),
d AS (SELECT doc_id, arg_min(x, i) AS got FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}|\\d{{4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}})\\b')) AS x, 1 AS i FROM ocr_text) GROUP BY 1),
w AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS want_date FROM orders),
e AS (SELECT t.doc_id, want, ms, document_type, want = document_type AS ok, (coalesce(got, '') = want_date)::INT AS c FROM t JOIN classed USING (doc_id) JOIN w USING (doc_id) LEFT JOIN d USING (doc_id)), v AS (SELECT list(ms) AS l FROM e)
SELECT count(*) AS documents, round_even(avg(ok::INT), 4) AS document_type_accuracy, round_even(sum(c) / count(*), 4) AS field_accuracy, count(*)::BIGINT AS checked_fields, sum(c)::BIGINT AS correct_fields, round_even(avg(ms), 2) AS average_latency_ms, (SELECT {_rank('l', 95)} FROM v) AS p95_latency_ms FROM e""")
def eval_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, "invoice").when(k % 6 == 1, "contract").when(k % 6 == 2, "receipt").when(k % 6 == 3, "warehouse_note").when(k % 6 == 4, "form")
    day = F.when((k % 6 == 0) & (k % 4 != 0), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    expected = o.select(k.alias("doc_id"), kind.alias("document_type"), F.create_map(F.lit("primary_date"), day).alias("fields"))
    got = classified(spark, sf_dir).select("doc_id", "document_type", F.create_map(F.lit("primary_date"), F.get(E.dates(F.col("text")), F.lit(0))).alias("fields"), (F.col("doc_id") % 50).cast("double").alias("latency_ms"))
    return M.evaluation_summary(M.evaluate(expected, got))


@query(f"""{WITH}, x AS (SELECT doc_id, document_type, (3 + 4 * (doc_id % 3))::INT AS words, (doc_id % 13)::INT AS low, doc_id % 3 = 0 AS llm, doc_id % 2 = 0 AS corrected, doc_id % 5 = 0 AS model,
  CASE WHEN document_type IN ('receipt', 'invoice') AND NOT regexp_matches(text, '{_AMT}') THEN 1 ELSE 0 END AS miss FROM classed),
y AS (SELECT *, CASE WHEN words > 0 THEN least(low, words) / words::DOUBLE ELSE 0 END AS raw, CASE WHEN document_type IN ('invoice', 'receipt', 'contract') THEN round_even(least((0.5 * miss + miss) / (miss + 3.0::DOUBLE), 1), 4) ELSE 0 END AS issue,
  least(CASE WHEN llm THEN CASE WHEN corrected THEN 0.55 ELSE 0.75 END ELSE 1 END, CASE WHEN model THEN 0.85 ELSE 1 END)::DOUBLE AS f FROM x)
SELECT doc_id, round_even(raw, 4)::DOUBLE AS raw_error_rate, round_even(greatest(raw * f, issue), 4)::DOUBLE AS after_ai_error_rate, CASE WHEN round_even(greatest(raw * f, issue), 4) >= 0.35 THEN 'poor' WHEN round_even(greatest(raw * f, issue), 4) >= 0.15 THEN 'degraded' ELSE 'good' END AS quality_level FROM y""")
def quality_estimate(spark, sf_dir):
    d, k = classified(spark, sf_dir), F.col("doc_id")
    lost = F.col("document_type").isin("receipt", "invoice") & ~F.col("text").rlike(E.L.AMOUNT)
    words = (3 + 4 * (k % 3)).cast("int")
    d = d.select("doc_id", "document_type", F.lit(False).alias("blank"), words.alias("word_count"), F.least((k % 13).cast("int"), words).alias("low_count"), (k % 3 == 0).alias("llm_ok"), (k % 2 == 0).alias("corrected"), (k % 5 == 0).alias("model_ok"),
                 F.when(lost, F.array(F.lit("total_amount"))).otherwise(F.array().cast("array<string>")).alias("missing"), F.when(lost, F.array(F.struct(F.lit("medium").alias("severity")))).otherwise(F.array().cast("array<struct<severity: string>>")).alias("warnings"))
    return M.quality(d).select("doc_id", "raw_error_rate", "after_ai_error_rate", "quality_level")


@query(f"WITH {TEXT_SQL} SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 < 8 THEN 'train' WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM ocr_text")
def split_buckets(spark, sf_dir):
    from quire.sources.datasets import split

    return split(ocr_text(spark, sf_dir), "doc_id").select("doc_id", "split")


@query("""WITH l AS (SELECT o_orderkey AS doc_id, (o_orderkey % 50)::INT AS x1, (o_orderkey % 31)::INT - 5 AS y1, (o_orderkey % 90)::INT AS x2, (o_orderkey % 47)::INT AS y2, CASE WHEN o_orderkey % 7 = 0 THEN '###' ELSE ' ca' || o_orderkey || '☃,x' END AS t FROM orders)
SELECT doc_id, greatest(0, least(x1, x2)) AS xmin, greatest(0, least(y1, y2)) AS ymin, greatest(0, x1, x2) AS xmax, greatest(0, y1, y2) AS ymax, 'ca' || doc_id || ',x' AS label FROM l
WHERE doc_id % 7 <> 0 AND greatest(0, x1, x2) > greatest(0, least(x1, x2)) AND greatest(0, y1, y2) > greatest(0, least(y1, y2))""")
def quad_to_box(spark, sf_dir):
    from quire.sources.datasets import label_boxes

    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    x1, y1, x2, y2 = k % 50, k % 31 - 5, k % 90, k % 47
    label = F.when(k % 7 == 0, "###").otherwise(F.concat(F.lit(" ca"), k.cast("string"), F.lit("☃,x")))
    line = F.concat_ws(",", *[x.cast("string") for x in (x1, y1, x2, y1, x2, y2, x1, y2)], label)
    return label_boxes(o.select(k.alias("doc_id"), line.alias("value"))).select("doc_id", "xmin", "ymin", "xmax", "ymax", "label")
