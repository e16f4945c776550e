"""Queries over pairs, merges and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import lines_of
from quire.operators import answers as A
from quire.operators import fields as E
from quire.operators import keyvalue as K
from quire.operators import pairing
from quire.plans.page_queries import pages
from quire.plans.text_queries import WITH, classified
from quire.sources.synthetic import LINES_SQL, TEXT_SQL, ocr_text, structured, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def text_pairs(spark, sf_dir):
    return K.text_pairs(ocr_text(spark, sf_dir))


@query(f"""WITH {TEXT_SQL} SELECT doc_id, trim(substr(text, 1, instr(text, ':') - 1)) AS label, trim(substr(text, instr(text, ':') + 1)) AS value FROM lines WHERE contains(text, ':') AND trim(substr(text, instr(text, ':') + 1)) <> ''
AND (contains(norm, 'invoice no') OR norm LIKE 'date:%' OR contains(norm, 'bill to') OR contains(norm, 'tax code') OR norm LIKE 'email:%' OR norm LIKE 'phone:%' OR contains(norm, 'amount due') OR contains(norm, 'mau so:') OR contains(norm, 'ky hieu:') OR contains(norm, 'so hoa don') OR norm LIKE 'ngay:%' OR contains(norm, 'don vi ban hang') OR contains(norm, 'ma so thue') OR contains(norm, 'hinh thuc thanh toan') OR contains(norm, 'tong cong') OR contains(norm, 'so tien viet bang chu') OR norm LIKE 'payment:%' OR contains(norm, 'reference code') OR contains(norm, 'so luong'))
UNION ALL SELECT doc_id, 'Customer#', substr(text, 10) FROM lines WHERE starts_with(text, 'Customer#')""")
def kv_inline(spark, sf_dir):
    p = text_pairs(spark, sf_dir).select("doc_id", F.explode(F.filter("pairs", lambda x: (x["source"] == "inline:separator") & ~x["label"].contains("  ") & ~x["label"].startswith("Status"))).alias("p"))
    return p.select("doc_id", "p.label", "p.value")


@query(f"""WITH {TEXT_SQL}, n AS (SELECT doc_id, ord, text, norm, lead(text) OVER w AS nxt, lead(text, 2) OVER w AS nxt2 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, trim(text, ' :-') AS label, nxt AS value FROM n WHERE text IN ('Prepared By', 'INVOICE', 'Người mua hàng:') AND nxt IS NOT NULL AND text <> 'Người mua hàng:'""")
def kv_next_line(spark, sf_dir):
    p = text_pairs(spark, sf_dir).select("doc_id", F.explode(F.filter("pairs", lambda x: (x["source"] == "section:next_lines") & x["label"].isin("Prepared By", "INVOICE"))).alias("p"))
    return p.select("doc_id", "p.label", "p.value")


@query(f"""WITH {LINES_SQL} SELECT doc_id, text AS label, (SELECT 1) AS page FROM ocr_lines WHERE line = 900""")
def kv_row(spark, sf_dir):
    p = pages(spark, sf_dir).select("doc_id", F.explode(K.row_pairs(F.col("lines"), F.col("page"))).alias("p"))
    return p.filter("p.label = 'Sub Total'").select("doc_id", "p.label", "p.page")


@query()
def page_pairs(spark, sf_dir):
    return structured(spark, sf_dir, pairing.pairs, pairing.PAIRS)


@query(f"WITH {TEXT_SQL} SELECT doc_id, trim(substr(text, instr(text, ':') + 1)) AS value FROM lines WHERE contains(norm, 'reference code')")
def kv_match_question(spark, sf_dir):
    p = text_pairs(spark, sf_dir).select("doc_id", K.match_question(F.col("pairs"), F.lit("What is the reference code?")).alias("p"))
    return p.filter("p.canonical IS NULL AND p.norm = 'reference code'").select("doc_id", F.col("p.display").alias("value"))


def entities(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n"), "l_quantity", "l_extendedprice")
    kind = F.when(F.col("k") % 5 == 0, "O").when(F.col("k") % 5 == 1, "B-COMPANY").when(F.col("k") % 5 == 2, "I-COMPANY").when(F.col("k") % 5 == 3, "B-TOTAL").otherwise("I-TOTAL")
    # a whole ordinal, so that both engines see one order
    place = F.col("n").cast("long") * 1000000 + F.col("k")
    rows = i.groupBy("doc_id", "n", "k").agg(F.min("l_quantity").alias("q"))
    return rows.select("doc_id", F.lit(1).alias("page"), place.alias("ord"), F.concat(F.lit("w"), F.col("k").cast("string")).alias("word"), kind.alias("label"), ((F.col("k") % 64) / 64.0).alias("confidence"), F.array((F.col("k") % 900).cast("int"), F.col("n").cast("int"), (F.col("k") % 900 + 50).cast("int"), (F.col("n") + 9).cast("int")).alias("box"))


_ENTITIES = """WITH g AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS k, l_linenumber AS n FROM lineitem),
p AS (SELECT doc_id, n::BIGINT * 1000000 + k AS ord, 'w' || k AS word, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'COMPANY' WHEN 2 THEN 'COMPANY' ELSE 'TOTAL' END AS kind, k % 5 IN (1, 3) AS b, (k % 64) / 64.0::DOUBLE AS c FROM g),
s AS (SELECT *, CASE WHEN kind IS NOT NULL AND (b OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind) THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
t AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS gr FROM s),
e AS (SELECT doc_id, kind AS label, min(ord) AS ord, string_agg(word, ' ' ORDER BY ord) AS value, round_even(avg(c), 4) AS confidence FROM t WHERE kind IS NOT NULL GROUP BY doc_id, kind, gr)"""


@query(f"{_ENTITIES} SELECT * FROM e")
def bio_entities(spark, sf_dir):
    return A.bio_entities(entities(spark, sf_dir)).drop("page", "box")


@query(f"{_ENTITIES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY confidence DESC, ord) AS k FROM e) SELECT doc_id, CASE label WHEN 'COMPANY' THEN 'seller' ELSE 'total_amount' END AS field_name, value, confidence, 'layoutxlm:' || lower(label) AS source FROM r WHERE k = 1")
def best_entity_field(spark, sf_dir):
    return A.best_entities(A.bio_entities(entities(spark, sf_dir)))


def _old(spark, sf_dir):
    k = F.col("o_orderkey")
    source = F.when(k % 3 == 0, "regex:largest_amount").when(k % 3 == 1, "generic_kv:layout:same_row").otherwise("regex:date")
    name = F.when(k % 3 == 0, "total_amount").when(k % 3 == 1, "buyer").otherwise("primary_date")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), name.alias("field_name"), F.concat(F.lit("old "), k.cast("string")).alias("value"), ((k % 21) / 20.0).alias("confidence"), source.alias("source"))


def _kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(k % 4 == 0, "general_document").otherwise("invoice").alias("document_type"))


_OLD = """o AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'total_amount' WHEN 1 THEN 'buyer' ELSE 'primary_date' END AS field_name, 'old ' || o_orderkey AS value, (o_orderkey % 21) / 20.0::DOUBLE AS confidence,
 CASE o_orderkey % 3 WHEN 0 THEN 'regex:largest_amount' WHEN 1 THEN 'generic_kv:layout:same_row' ELSE 'regex:date' END AS source, o_orderkey % 4 = 0 AS general FROM orders)"""


@query(f"""WITH {_OLD}, c AS (SELECT doc_id, field_name, CASE field_name WHEN 'total_amount' THEN CASE WHEN doc_id % 2 = 0 THEN (doc_id + 5000)::VARCHAR ELSE 'none' END WHEN 'buyer' THEN CASE WHEN doc_id % 5 = 0 THEN '12' ELSE 'New Buyer' END ELSE CASE WHEN doc_id % 7 = 0 THEN '1' ELSE '2024-01-05' END END AS v, ((doc_id % 11) / 10.0)::DOUBLE AS nc FROM o WHERE NOT (general AND field_name = 'total_amount')),
g AS (SELECT * FROM c WHERE NOT (v IN ('none', '12', '1'))),
j AS (SELECT o.*, g.v, g.nc, g.v IS NOT NULL AND ((nc >= 0.88 AND confidence <= 0.72) OR (starts_with(source, 'generic_kv:') AND nc >= confidence + 0.08)) AS take FROM o LEFT JOIN g USING (doc_id, field_name))
SELECT doc_id, field_name, CASE WHEN take THEN v ELSE value END AS value, CASE WHEN take THEN nc ELSE confidence END AS confidence, CASE WHEN take THEN 'layoutxlm:x' ELSE source END AS source FROM j""")
def merge_model(spark, sf_dir):
    old, k = _old(spark, sf_dir), F.col("doc_id")
    value = F.when(F.col("field_name") == "total_amount", F.when(k % 2 == 0, (k + 5000).cast("string")).otherwise("none")).when(F.col("field_name") == "buyer", F.when(k % 5 == 0, "12").otherwise("New Buyer")).otherwise(F.when(k % 7 == 0, "1").otherwise("2024-01-05"))
    new = old.select("doc_id", "field_name", value.alias("value"), ((k % 11) / 10.0).alias("confidence"), F.lit("layoutxlm:x").alias("source"))
    return A.merge_model(old, new, _kinds(spark, sf_dir))[0]


@query(f"""WITH {_OLD}, c AS (SELECT doc_id, field_name, CASE WHEN field_name = 'total_amount' THEN (doc_id + 7)::VARCHAR ELSE 'new' END AS v, CASE WHEN doc_id % 5 = 0 THEN 0.62 ELSE (doc_id % 10) / 10.0 END::DOUBLE AS nc0 FROM o WHERE NOT (general AND field_name = 'total_amount')),
d AS (SELECT *, CASE WHEN nc0 <= 0 THEN 0.62 ELSE nc0 END AS nc FROM c),
j AS (SELECT o.*, d.v, d.nc, d.v IS NOT NULL AND (source = 'regex:largest_amount' OR (confidence <= 0.56 AND nc >= 0.55)) AS take FROM o LEFT JOIN d USING (doc_id, field_name))
SELECT doc_id, field_name, CASE WHEN take THEN v ELSE value END AS value, CASE WHEN take THEN nc ELSE confidence END AS confidence, CASE WHEN take THEN 'llm:x' ELSE source END AS source FROM j""")
def merge_llm(spark, sf_dir):
    old, k = _old(spark, sf_dir), F.col("doc_id")
    label = F.when(F.col("field_name") == "total_amount", "Total Amount").when(F.col("field_name") == "buyer", " Buyer").otherwise("primary-date")
    sure = F.when(k % 5 == 0, "n/a").otherwise(((k % 10) / 10.0).cast("string"))
    new = old.select("doc_id", label.alias("field_name"), F.when(F.col("field_name") == "total_amount", (k + 7).cast("string")).otherwise("new").alias("value"), sure.alias("confidence"), F.lit("llm:x").alias("source"), F.lit(1).alias("ord"))
    return A.merge_assisted(old, new, _kinds(spark, sf_dir))


def _analysed(spark, sf_dir):
    d = E.extract_fields(classified(spark, sf_dir))
    d = K.text_pairs(d)
    return d.withColumn("fields", A.merge_pairs(F.col("fields"), F.col("pairs"), F.col("document_type")))


@query()
def merge_kv(spark, sf_dir):
    return E.long_fields(_analysed(spark, sf_dir), "doc_id").select("doc_id", "field_name", "value", "confidence", "source")


@query()
def qa_cascade(spark, sf_dir):
    ask = F.when(F.col("doc_id") % 4 == 0, "Tong tien la bao nhieu?").when(F.col("doc_id") % 4 == 1, "What is the reference code?").when(F.col("doc_id") % 4 == 2, "Tom tat noi dung").otherwise("Ai la nguoi mua?")
    d = _analysed(spark, sf_dir)
    rows = d.select("doc_id", "text", "pairs", "fields", ask.alias("question"), lines_of(F.col("text")).alias("lines"), E.summary(F.col("document_type"), F.col("text"), *[E.get_field(F.col("fields"), n) for n in ("primary_date", "total_amount", "invoice_number")]).alias("summary"), F.lit(None).cast("string").alias("llm_answer"))
    return A.answer(rows).select("doc_id", "question", "answer", "matched_field")


@query("""WITH b AS (SELECT o_orderkey AS doc_id, [{'id': 1, 'l': 'invoice'}, {'id': 2, 'l': 'no ' || o_orderkey}, {'id': 3, 'l': ''}, {'id': 4, 'l': 'total no ' || o_orderkey || ' usd'}] AS b FROM orders)
SELECT doc_id, array_to_string(list_transform(list_filter(b, lambda x: x.l <> '' AND (contains(x.l, 'no ' || doc_id) OR contains('no ' || doc_id, x.l))), lambda x: x.id), ',') AS ids FROM b""")
def box_lookup(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    box = lambda i, x: F.struct(F.lit(i).alias("id"), x.alias("label"))
    b = F.array(box(1, F.lit("INVOICE")), box(2, F.concat(F.lit("No "), k)), box(3, F.lit("")), box(4, F.concat(F.lit("Total NO "), k, F.lit(" USD"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array_join(E.box_ids(b, F.concat(F.lit("no "), k)), ",").alias("ids"))


@query(f"{WITH} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'invalid_date_format' WHEN doc_id % 3 = 1 THEN 'label_like_value' ELSE 'too_short_or_numeric' END AS reason FROM classed WHERE doc_id % 4 <> 3")
def rejected_candidates(spark, sf_dir):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, "primary_date").when(k % 3 == 1, "buyer").otherwise("seller_address")
    value = F.when(k % 4 == 3, F.when(k % 3 == 0, "05 June 2026").otherwise("12 Main Street")).when(k % 3 == 0, "1").when(k % 3 == 1, "Bill To").otherwise("456")
    return ocr_text(spark, sf_dir).select("doc_id", E.rejection(name, value).alias("reason")).filter("reason IS NOT NULL")
