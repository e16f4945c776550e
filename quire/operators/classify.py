"""Document types from keyword evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lexicon as L
from quire.functions.kernels import let
from quire.functions.text import fold, has_phrase, matched


def _by_score(score: Column, table: dict[int, float]) -> Column:
    """The table's value at the score (its least score is the first); above its last score, its last."""
    low, top = min(table), max(table)
    return F.element_at(F.array(*[F.lit(table[k]) for k in range(low, top + 1)]), F.least(score, F.lit(top)) - low + 1)


def invoice_score(norm: Column) -> Column:
    """Two for each strong pattern, one for each medium one; 0 where the evidence is a mere mention."""
    count = lambda ps: sum((matched(norm, p).cast("int") for p in ps), F.lit(0))
    evidence = F.struct((count(L.STRONG_INVOICE) * 2).alias("strong"), count(L.MEDIUM_INVOICE).alias("medium"))

    def weigh(x: Column) -> Column:
        mention = (x["strong"] == 0) & ((x["medium"] <= 2) | (count(L.REFERENCE_LISTS) >= 2))
        return F.when(mention, 0).otherwise(x["strong"] + x["medium"])

    return let(evidence, weigh)


def text_score(text: Column) -> Column:
    """The invoice score of a raw text, folded once for all patterns."""
    return let(fold(F.coalesce(text, F.lit(""))), invoice_score)


def type_scores(norm: Column) -> Column:
    """Array of (score, rank: minus the order of the type, type)."""
    return F.array(*[F.struct(sum((has_phrase(norm, w).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("rank"), F.lit(kind).alias("type")) for i, (kind, words) in enumerate(L.TYPE_KEYWORDS.items())])


def classify(docs: DataFrame, *, text_col: str = "text", threshold: int = 4) -> DataFrame:
    """Adds invoice_score, document_type and document_type_confidence; a narrow projection."""

    def judge(norm: Column) -> Column:
        return let(F.struct(invoice_score(norm).alias("s"), F.array_max(type_scores(norm)).alias("b")), decide)

    def decide(x: Column) -> Column:
        invoice, other = x["s"] >= threshold, x["b"]["score"] > 0
        kind = F.when(invoice, "invoice").when(other, x["b"]["type"]).otherwise("general_document")
        sure = F.when(invoice, _by_score(F.greatest(x["s"], F.lit(4)), L.INVOICE_CONFIDENCE)).when(other, _by_score(x["b"]["score"], L.TYPE_CONFIDENCE)).otherwise(F.lit(0.35))
        return F.struct(x["s"].alias("invoice_score"), kind.alias("document_type"), sure.alias("document_type_confidence"))

    judged = docs.withColumn("_judged", let(fold(F.coalesce(F.col(text_col), F.lit(""))), judge))
    return judged.select(*docs.columns, "_judged.*")


def threshold_sweep(labelled: DataFrame, *, text_col: str = "text", label_col: str = "document_type", thresholds: range = range(2, 8)) -> DataFrame:
    """(threshold, documents, accuracy) of calling a document an invoice from that score on; one scan, one aggregate."""
    rows = labelled.filter(F.col(label_col).isNotNull() & (F.trim(F.coalesce(F.col(text_col), F.lit(""))) != ""))
    rows = rows.select((F.col(label_col) == "invoice").alias("is"), text_score(F.col(text_col)).alias("score"))
    each = rows.select("is", "score", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    return each.groupBy("threshold").agg(F.count(F.lit(1)).alias("documents"), F.avg(((F.col("score") >= F.col("threshold")) == F.col("is")).cast("double")).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the best accuracy."""
    return sweep.orderBy(F.desc("accuracy"), "threshold").limit(1)
