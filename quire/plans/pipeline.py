"""The whole analysis of documents as one composed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import lines_of
from quire.operators import answers as A
from quire.operators import fields as E
from quire.operators import keyvalue as K
from quire.operators import layout as Y
from quire.operators import pages as P
from quire.operators import tables as T
from quire.operators.classify import classify
from quire.sources import adapters
from quire.sources import assist as S


def analyze_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to type, fields, pairs, warnings and summary: one narrow pass."""
    d = K.text_pairs(E.extract_fields(classify(docs)))
    d = d.withColumn("fields", A.merge_pairs(F.col("fields"), F.col("pairs"), F.col("document_type")))
    one = [E.get_field(F.col("fields"), n) for n in ("primary_date", "total_amount", "invoice_number")]
    none = F.array().cast("array<struct<value: string, confidence: double>>")
    return d.withColumns({"warnings": E.warnings(F.col("document_type"), E.present(F.col("fields")), F.col("text"), none), "summary": E.summary(F.col("document_type"), F.col("text"), *one)})


def long_fields(analysed: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, confidence, source) of the fields of analyze_text."""
    each = analysed.select("doc_id", F.explode("fields").alias("x"))
    return each.select("doc_id", "x.field_name", F.coalesce("x.f.value", F.array_join("x.f.values", ", ")).alias("value"), "x.f.confidence", "x.f.source")


def merge_all(analysed: DataFrame, *, entities: DataFrame | None = None, assistant: S.Assistant | None = None) -> dict[str, DataFrame]:
    """Fields after every source: rules and pairs (in ``analysed``), then a tagging model's entities, then a language model.

    entities: doc_id, ord, label, value, confidence.  Gives fields, the entities' rejected values and the model's analyses.
    """
    kinds = analysed.select("doc_id", "document_type")
    fields, rejected = long_fields(analysed), None
    if entities is not None:
        fields, rejected = A.merge_model(fields, A.best_entities(entities), kinds)
    analyses = S.analyse(analysed, assistant)
    if assistant is not None and assistant.state == "enabled":
        fields = A.merge_assisted(fields, S.candidates(analyses), kinds)
    return {"fields": fields, "rejected": rejected, "analyses": analyses}


def chosen_lines(docs: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """(doc_id, lines) of (doc_id, text): a document's recognised lines if it has any, else those of its text."""
    plain = docs.select("doc_id", F.transform(lines_of(F.col("text")), lambda x: x["text"]).alias("_text"))
    if recognised is None:
        return plain.select("doc_id", F.col("_text").alias("lines"))
    pages = P.pages(recognised).select("doc_id", F.struct("page", F.transform("lines", lambda x: x["text"]).alias("t")).alias("p"))
    own = pages.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"])).alias("_own"))
    return plain.join(own, "doc_id", "left").select("doc_id", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_text")).alias("lines"))


def analyze_structured(docs: DataFrame) -> dict[str, DataFrame]:
    """(doc_id, pages) to pages, text, boxes, tables, regions and pairs."""
    pages = P.reading_order(P.pages(docs))
    tables = T.extract_tables(pages)
    return {"pages": pages, "text": P.document_text(pages), "boxes": P.boxes(pages), "tables": tables, "regions": Y.numbered(Y.regions(pages, tables)), "pairs": K.boxed_pairs(K.page_pairs(pages))}


def answer_questions(analysed: DataFrame, questions: DataFrame, *, assistant: S.Assistant | None = None) -> DataFrame:
    """(question_id, doc_id, answer, matched_field) for (question_id, doc_id, question).

    The assistant's adapter sees (doc_id, context, text) with the question in the context; doc_id is the question's id there.
    """
    rows = questions.join(analysed, "doc_id").withColumn("lines", lines_of(F.col("text")))
    if assistant is not None and assistant.state == "enabled":
        known = F.to_json(F.struct(F.col("question"), S.context(rows).alias("known")))
        asked = rows.select(F.col("question_id").cast("long").alias("doc_id"), known.alias("context"), F.substring("text", 1, assistant.clip).alias("text"))
        replies = adapters.apply(asked, assistant.adapter, S.REPLIES).filter("error IS NULL").select(F.col("doc_id").alias("_q"), F.nullif(F.trim(F.coalesce(F.get_json_object("response", "$.answer"), "response")), F.lit("")).alias("llm_answer"))
        rows = rows.join(replies, rows["question_id"].cast("long") == replies["_q"], "left").drop("_q")
    else:
        rows = rows.withColumn("llm_answer", F.lit(None).cast("string"))
    return A.answer(rows).select("question_id", "doc_id", "answer", "matched_field")
