"""Queries over texts: normalising, classification, fields, warnings, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import lexicon as L
from quire.functions import text as X
from quire.operators import classify as C
from quire.operators import fields as E
from quire.sources.synthetic import TEXT_SQL, ocr_text, table

QUERIES, ORACLE_SQL = {}, {}
_GAP = "', '"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _hits(col: str, words) -> str:
    return "(" + " + ".join(f"contains({col}, '{w}')::INT" for w in words) + ")"


def _re2(pattern: str) -> str:
    """The oracle's patterns have no lookahead."""
    return pattern.replace(r"(?=\s|$)", r"(?:\s|$)")


def _count(col: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({col}, '{_re2(p)}')::INT" for p in patterns) + ")"


def _phrases(col: str, words) -> str:
    return "(" + " + ".join(f"regexp_matches({col}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INT" for w in words) + ")"


def _table_case(x: str, values: dict) -> str:
    top = max(values)
    return "CASE " + " ".join(f"WHEN {x} = {k} THEN {v}" for k, v in values.items() if k < top) + f" ELSE {values[top]} END"


STRONG, MEDIUM, MENTION = _count("n", L.STRONG_INVOICE), _count("n", L.MEDIUM_INVOICE), _count("n", L.REFERENCE_LISTS)
SCORE = f"CASE WHEN {STRONG} = 0 AND ({MEDIUM} <= 2 OR {MENTION} >= 2) THEN 0 ELSE 2 * {STRONG} + {MEDIUM} END"
CLASS_SQL = f"""
scored AS (SELECT doc_id, text, n, ({SCORE})::INT AS s, {', '.join(f'{_phrases("n", w)} AS {k}' for k, w in L.TYPE_KEYWORDS.items())} FROM norm),
best AS (SELECT *, greatest({', '.join(L.TYPE_KEYWORDS)}) AS top FROM scored),
classed AS (SELECT doc_id, text, n, s AS invoice_score, CASE WHEN s >= 4 THEN 'invoice' WHEN top = 0 THEN 'general_document' {' '.join(f"WHEN {k} = top THEN '{k}'" for k in L.TYPE_KEYWORDS)} END AS document_type,
  (CASE WHEN s >= 4 THEN {_table_case('s', L.INVOICE_CONFIDENCE)} WHEN top > 0 THEN {_table_case('top', L.TYPE_CONFIDENCE)} ELSE 0.35 END)::DOUBLE AS document_type_confidence FROM best)
"""
WITH = f"WITH {TEXT_SQL}, {CLASS_SQL}"


def amount_sql(x: str) -> str:
    k = rf"regexp_replace({x}, '[^\d,.\-]', '', 'g')"
    last = lambda sign: f"len(string_split({k}, '{sign}')[-1])"
    return f"""(CASE WHEN {k} IN ('', '-', '.', ',') THEN NULL
      WHEN contains({k}, ',') AND contains({k}, '.') AND {last(',')} < {last('.')} THEN try_cast(replace(replace({k}, '.', ''), ',', '.') AS DOUBLE)
      WHEN contains({k}, ',') AND contains({k}, '.') THEN try_cast(replace({k}, ',', '') AS DOUBLE)
      WHEN contains({k}, ',') AND {last(',')} = 3 THEN try_cast(replace({k}, ',', '') AS DOUBLE)
      WHEN contains({k}, ',') THEN try_cast(replace({k}, ',', '.') AS DOUBLE)
      WHEN contains({k}, '.') AND (len(string_split({k}, '.')) > 2 OR {last('.')} = 3) THEN try_cast(replace({k}, '.', '') AS DOUBLE)
      ELSE try_cast({k} AS DOUBLE) END)"""


def fold_sql(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'đ', 'd')"


def currency_sql(x: str) -> str:
    return f"CASE WHEN contains({fold_sql(x)}, 'usd') OR contains({x}, '$') THEN 'USD' WHEN contains({fold_sql(x)}, 'vnd') OR contains(lower({x}), 'đ') THEN 'VND' END"


def classified(spark, sf_dir):
    return C.classify(ocr_text(spark, sf_dir))


@query(f"{WITH} SELECT document_type, count(*) AS documents, avg(invoice_score) AS mean_score FROM classed GROUP BY 1")
def classify_summary(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("document_type").agg(F.count(F.lit(1)).alias("documents"), F.avg("invoice_score").alias("mean_score"))


@query(f"{WITH} SELECT doc_id, invoice_score, document_type, document_type_confidence FROM classed")
def classify_documents(spark, sf_dir):
    return classified(spark, sf_dir).drop("text")


@query(f"WITH t AS (SELECT doc_id, {fold_sql('text')} AS n FROM documents) SELECT doc_id, ({SCORE})::INT AS invoice_score FROM t")
def invoice_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.text_score(F.col("text")).alias("invoice_score"))


@query(f"""WITH {TEXT_SQL}, t AS (SELECT ({SCORE})::INT AS s, CASE doc_id % 6 WHEN 0 THEN 'invoice' WHEN 2 THEN 'receipt' ELSE 'other' END AS l FROM norm)
SELECT k::INT AS threshold, count(*) AS documents, avg(((s >= k) = (l = 'invoice'))::INT)::DOUBLE AS accuracy FROM t, range(2, 8) AS r(k) GROUP BY k""")
def threshold_sweep(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 6 == 0, "invoice").when(F.col("doc_id") % 6 == 2, "receipt").otherwise("other")
    return C.threshold_sweep(ocr_text(spark, sf_dir).withColumn("document_type", kind))


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS folded, md5(trim(regexp_replace({fold_sql('text')}, '\\s+', ' ', 'g'))) AS squeezed FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"), F.md5(X.squeeze(F.col("text")).cast("binary")).alias("squeezed"))


@query(f"SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all({fold_sql('text')}, '[a-z0-9_#]+')), lambda x: len(x) >= 2 AND NOT list_contains({_list(X.STOP_WORDS)}, x)))::INT AS n_tokens FROM documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(X.fold(F.col("text")))).alias("n_tokens"))


@query(f"WITH {TEXT_SQL}, d AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '{L.DATE}')) AS l FROM ocr_text) SELECT doc_id, array_to_string(list_sort(l), {_GAP}) AS dates FROM d WHERE len(l) > 0")
def extract_dates(spark, sf_dir):
    d = ocr_text(spark, sf_dir).select("doc_id", E.dates(F.col("text")).alias("l"))
    return d.filter(F.size("l") > 0).select("doc_id", F.array_join(F.array_sort("l"), ", ").alias("dates"))


_EMAILS = f"SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{L.EMAIL}'), lambda x: lower(x))) AS l FROM t"


@query(f"WITH t AS (SELECT doc_id, text FROM documents), d AS ({_EMAILS}) SELECT doc_id, array_to_string(list_sort(l), {_GAP}) AS emails FROM d WHERE len(l) > 0")
def extract_emails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", E.emails(F.col("text")).alias("l")).filter(F.size("l") > 0)
    return d.select("doc_id", F.array_join(F.array_sort(F.transform("l", F.lower)), ", ").alias("emails"))


@query(rf"""WITH {TEXT_SQL}, u AS (SELECT doc_id, text FROM ocr_text UNION ALL SELECT -1 - doc_id, text FROM documents),
d AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(concat(' ', text, ' '), '[^0-9]((?:\+?84|0)(?:[\s.\-]?[0-9]){{8,10}})[^0-9]', 1), lambda x: trim(x)), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) >= 9) AS l FROM u)
SELECT doc_id, len(list_distinct(l))::INT AS n_phones FROM d WHERE len(l) > 0""")
def extract_phones(spark, sf_dir):
    both = ocr_text(spark, sf_dir).unionByName(table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return both.select("doc_id", F.size(E.phones(F.col("text"))).alias("n_phones")).filter("n_phones > 0")


@query(rf"""{WITH}, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{L.TAX_CODE}')) AS code FROM lines WHERE {_any('norm', L.TAX_WORDS)})
SELECT DISTINCT doc_id, code FROM t JOIN classed USING (doc_id) WHERE document_type = 'invoice'""")
def extract_tax_codes(spark, sf_dir):
    d = classified(spark, sf_dir).filter("document_type = 'invoice'")
    return d.select("doc_id", F.explode(E.tax_codes(X.lines_of(F.col("text")))).alias("code"))


_AMT = rf"(?i)(?:(?:VND|VNĐ|USD|\$)\s*)?-?\d{{1,3}}(?:[.,\s]\d{{3}})+(?:[.,]\d{{1,2}})?|(?:-?\d+(?:[.,]\d{{1,2}})?\s*(?:VND|VNĐ|USD|\$|đ))"


@query(f"""{WITH},
on_line AS (SELECT doc_id, ord, h, unnest(regexp_extract_all(text, '{_AMT}')) AS raw FROM (SELECT *, {_hits('norm', L.TOTAL_WORDS)} AS h FROM lines) WHERE h > 0),
c AS (SELECT doc_id, {amount_sql('raw')} AS number, trim(raw) AS raw, {currency_sql('raw')} AS currency, ({_table_case('h', L.TOTAL_CONFIDENCE)})::DOUBLE AS confidence, 'line:total_keyword' AS source FROM on_line),
e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_AMT}')) AS raw FROM ocr_text),
f AS (SELECT doc_id, {amount_sql('raw')} AS number, trim(raw) AS raw, {currency_sql('raw')} AS currency, 0.55::DOUBLE AS confidence, 'regex:largest_amount' AS source FROM e WHERE doc_id NOT IN (SELECT doc_id FROM c WHERE number IS NOT NULL)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number DESC, raw) AS k FROM (SELECT * FROM c UNION ALL SELECT * FROM f) WHERE number IS NOT NULL)
SELECT doc_id, number, raw, currency, confidence, source FROM r JOIN classed USING (doc_id) WHERE k = 1 AND document_type IN ('invoice', 'receipt')""")
def total_amount(spark, sf_dir):
    d = classified(spark, sf_dir).filter(F.col("document_type").isin("invoice", "receipt"))
    d = d.select("doc_id", E.total_amount(X.lines_of(F.col("text")), F.col("text")).alias("t")).filter("t IS NOT NULL")
    return d.select("doc_id", *[f"t.{c}" for c in ("number", "raw", "currency", "confidence", "source")])


_NUM = [p.replace("(?i)", "") for p in L.INVOICE_NUMBER]


@query(rf"""{WITH},
m AS (SELECT doc_id, ord, coalesce(nullif(regexp_extract(text, '(?i){_NUM[0]}', 1), ''), nullif(regexp_extract(text, '(?i){_NUM[1]}', 1), '')) AS v FROM lines WHERE NOT {_any('norm', ['ma so thue', 'mst'])} AND {_any('norm', L.INVOICE_NUMBER_LINES)})
SELECT doc_id, arg_min(trim(v), ord) AS value FROM m JOIN classed USING (doc_id) WHERE v IS NOT NULL AND document_type = 'invoice' GROUP BY doc_id""")
def invoice_number(spark, sf_dir):
    d = classified(spark, sf_dir).filter("document_type = 'invoice'").select("doc_id", E.invoice_number(X.lines_of(F.col("text"))).alias("f"))
    return d.filter("f IS NOT NULL").select("doc_id", "f.value")


def labelled_sql(labels, name: str) -> str:
    """First line that holds a label and yields a value, as a table of (doc_id, value)."""
    sep = "trim(CASE WHEN contains(text, ':') THEN substr(text, instr(text, ':') + 1) WHEN contains(text, '-') THEN substr(text, instr(text, '-') + 1) WHEN contains(text, '–') THEN substr(text, instr(text, '–') + 1) ELSE text END)"
    cut = "CASE " + " ".join(f"WHEN contains(norm, '{w}') THEN trim(substr(text, instr(norm, '{w}') + {len(w)}), ' :-–')" for w in sorted(labels, key=len, reverse=True)) + " ELSE '' END"
    stop = _any("norm", L.NEXT_LINE_STOPS)
    return f"""
{name}_a AS (SELECT *, {stop} AS stops, row_number() OVER w AS k FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
{name}_b AS (SELECT *, CASE WHEN lead(stops) OVER w THEN '' ELSE coalesce(lead(text) OVER w, '') END AS following FROM {name}_a WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
{name}_c AS (SELECT doc_id, ord, following, {sep} AS v1, {cut} AS v2, norm FROM {name}_b WHERE {_any('norm', labels)}),
{name}_d AS (SELECT doc_id, ord, following, CASE WHEN v1 = '' OR {fold_sql('v1')} = norm THEN v2 ELSE v1 END AS v FROM {name}_c),
{name} AS (SELECT doc_id, arg_min(CASE WHEN v = '' THEN following ELSE v END, ord) AS value FROM {name}_d WHERE v <> '' OR following <> '' GROUP BY doc_id)"""


@query(f"""{WITH}, {', '.join(labelled_sql(w, k) for k, w in L.PARTY_LABELS.items())}
SELECT doc_id, field_name, value, CASE WHEN document_type IN ('contract', 'invoice') THEN 0.68 ELSE 0.58 END::DOUBLE AS confidence
FROM ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS field_name, value FROM {k}" for k in L.PARTY_LABELS)}) JOIN classed USING (doc_id)""")
def parties(spark, sf_dir):
    d = E.extract_fields(classified(spark, sf_dir))
    return E.long_fields(d, "doc_id").filter(F.col("source").isin(*[f"line:{k}" for k in L.PARTY_LABELS])).select("doc_id", "field_name", "value", "confidence")


@query(f"{WITH}, {labelled_sql(L.LOCAL_LABELS['buyer'][0], 'q')} SELECT doc_id, value FROM q")
def labeled_value_next_line(spark, sf_dir):
    d = ocr_text(spark, sf_dir).select("doc_id", E.labelled(X.lines_of(F.col("text")), L.LOCAL_LABELS["buyer"][0]).alias("v"))
    return d.filter("v IS NOT NULL").select("doc_id", "v.value")


@query(f"""{WITH}, {', '.join(labelled_sql(w[0], k + '_l') for k, w in L.LOCAL_LABELS.items() if k in ('invoice_form', 'invoice_symbol', 'payment_method', 'amount_in_words'))}
SELECT doc_id, field_name, value FROM ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS field_name, value FROM {k}_l" for k in ('invoice_form', 'invoice_symbol', 'payment_method', 'amount_in_words'))}) JOIN classed USING (doc_id) WHERE document_type = 'invoice'""")
def local_invoice_fields(spark, sf_dir):
    d = E.long_fields(E.extract_fields(classified(spark, sf_dir)), "doc_id")
    return d.filter(F.col("field_name").isin("invoice_form", "invoice_symbol", "payment_method", "amount_in_words")).select("doc_id", "field_name", "value")


@query(f"""{WITH}, f AS (SELECT unnest({_list(L.INVOICE_ONLY + L.FINANCIAL + ['buyer', 'reference_code'])}) AS field_name), t AS (SELECT DISTINCT document_type FROM classed)
SELECT document_type, field_name, CASE WHEN list_contains({_list(L.INVOICE_ONLY)}, field_name) THEN document_type = 'invoice' WHEN list_contains({_list(L.FINANCIAL)}, field_name) THEN document_type IN ('invoice', 'receipt') ELSE true END AS allowed FROM t, f""")
def field_gate(spark, sf_dir):
    kinds = classified(spark, sf_dir).select("document_type").distinct()
    rows = kinds.select("document_type", F.explode(F.array(*[F.lit(x) for x in [*L.INVOICE_ONLY, *L.FINANCIAL, "buyer", "reference_code"]])).alias("field_name"))
    return rows.withColumn("allowed", E.allowed(F.col("field_name"), F.col("document_type")))


def _with_warnings(spark, sf_dir):
    d = E.extract_fields(classified(spark, sf_dir)).withColumn("have", E.present(F.col("fields")))
    none = F.array().cast("array<struct<value: string, confidence: double>>")
    return d.withColumn("warnings", E.warnings(F.col("document_type"), F.col("have"), F.col("text"), none))


@query(f"""{WITH}, tot AS (SELECT DISTINCT doc_id FROM lines WHERE {_hits('norm', L.TOTAL_WORDS)} > 0 AND regexp_matches(text, '{_AMT}')),
anyt AS (SELECT DISTINCT doc_id FROM ocr_text WHERE regexp_matches(text, '{_AMT}')),
tax AS (SELECT DISTINCT doc_id FROM lines WHERE {_any('norm', L.TAX_WORDS)} AND regexp_matches(text, '{L.TAX_CODE}')),
w AS (SELECT 'missing_total_amount' AS type, 'medium' AS severity FROM classed WHERE document_type IN ('invoice', 'receipt') AND doc_id NOT IN (FROM tot) AND doc_id NOT IN (FROM anyt)
  UNION ALL SELECT 'missing_tax_code', 'low' FROM classed WHERE document_type = 'invoice' AND doc_id NOT IN (FROM tax))
SELECT type, severity, count(*) AS n FROM w GROUP BY ALL""")
def warnings_by_type(spark, sf_dir):
    return _with_warnings(spark, sf_dir).select(F.explode("warnings").alias("w")).groupBy("w.type", "w.severity").agg(F.count(F.lit(1)).alias("n"))


@query()
def summary_text(spark, sf_dir):
    d = E.extract_fields(classified(spark, sf_dir))
    return d.select("doc_id", E.summary(F.col("document_type"), F.col("text"), *[E.get_field(F.col("fields"), n) for n in ("primary_date", "total_amount", "invoice_number")]).alias("summary"))


@query()
def all_fields(spark, sf_dir):
    return E.long_fields(E.extract_fields(classified(spark, sf_dir)), "doc_id")


@query(f"""WITH {TEXT_SQL}, q AS (SELECT 'which reference code and visits'::VARCHAR AS question), w AS (SELECT list_filter(regexp_extract_all(question, '[A-Za-z0-9_]+'), lambda x: len(x) >= 4) AS ws FROM q),
m AS (SELECT doc_id, ord, text FROM lines, w WHERE len(list_filter(ws, lambda x: contains(norm, x))) > 0)
SELECT doc_id, string_agg(text, ' / ' ORDER BY ord) AS lines FROM m GROUP BY 1""")
def text_search(spark, sf_dir):
    d = ocr_text(spark, sf_dir).select("doc_id", E.relevant_lines(F.lit("which reference code and visits"), F.col("text")).alias("l"))
    return d.filter(F.size("l") > 0).select("doc_id", F.array_join("l", " / ").alias("lines"))


@query(f"""{WITH}, r AS (SELECT doc_id, document_type, CASE document_type WHEN 'invoice' THEN ['invoice_number', 'total_amount'] WHEN 'receipt' THEN ['total_amount'] WHEN 'contract' THEN ['primary_date'] ELSE [] END AS need FROM classed),
d AS (SELECT doc_id FROM ocr_text WHERE regexp_matches(text, '{L.DATE}')), a AS (SELECT doc_id FROM ocr_text WHERE regexp_matches(text, '{_AMT}')),
num AS (SELECT DISTINCT doc_id FROM lines WHERE (NOT {_any('norm', ['ma so thue', 'mst'])} AND {_any('norm', L.INVOICE_NUMBER_LINES)} AND (regexp_matches(text, '(?i){_NUM[0]}') OR regexp_matches(text, '(?i){_NUM[1]}'))) OR {_any('norm', L.LOCAL_LABELS['invoice_number'][0])})
SELECT doc_id, array_to_string(list_filter(need, lambda x: NOT ((x = 'primary_date' AND doc_id IN (SELECT doc_id FROM d)) OR (x = 'total_amount' AND doc_id IN (SELECT doc_id FROM a)) OR (x = 'invoice_number' AND doc_id IN (SELECT doc_id FROM num)))), ',') AS missing FROM r WHERE len(need) > 0""".replace("IN (SELECT doc_id FROM d)", "= d1").replace("IN (SELECT doc_id FROM a)", "= a1").replace("IN (SELECT doc_id FROM num)", "= n1").replace("FROM r WHERE", "FROM (SELECT r.*, d.doc_id AS d1, a.doc_id AS a1, num.doc_id AS n1 FROM r LEFT JOIN d USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN num USING (doc_id)) WHERE").replace("NOT ((x", "NOT coalesce((x").replace("= n1))", "= n1), false)"))
def missing_fields(spark, sf_dir):
    d = E.extract_fields(classified(spark, sf_dir)).filter(F.col("document_type").isin(*L.REQUIRED))
    return d.select("doc_id", F.array_join(E.missing_required(F.col("document_type"), E.present(F.col("fields"))), ",").alias("missing"))
