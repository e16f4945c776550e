"""Request and run monitoring, quality estimates and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.kernels import nearest_rank
from quire.functions.text import eval_normal, rate


def last_n(events: DataFrame, n: int, *, order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """The latest n rows; a top-n, so each task keeps n rows and no full sort is made."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def safe_mean(c: Column) -> Column:
    """Mean with two decimals if any value is above 1, else four; 0 for none."""
    mean = F.avg(c)
    return F.coalesce(F.when(F.max(c) > 1, F.bround(mean, 2)).otherwise(F.bround(mean, 4)), F.lit(0.0))


def api_summary(requests: DataFrame, *, keep: int = 500, top: int = 10) -> DataFrame:
    """One row: totals, error rate, latencies, the commonest paths and the statuses of the latest requests."""
    r = last_n(requests, keep)
    ordered = F.collect_list("latency_ms")
    base = r.agg(
        F.count(F.lit(1)).alias("requests_total"), F.coalesce(F.sum((F.col("status_code") >= 400).cast("long")), F.lit(0)).alias("errors_total"), safe_mean(F.col("latency_ms")).alias("avg_ms"),
        nearest_rank(ordered, 50).alias("p50_ms"), nearest_rank(ordered, 95).alias("p95_ms"), F.coalesce(F.bround(F.max("latency_ms"), 2), F.lit(0.0)).alias("max_ms"),
    )
    base = base.withColumn("error_rate", F.coalesce(rate(F.try_divide("errors_total", "requests_total")), F.lit(0.0)))
    paths = r.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(top)
    paths = paths.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "path", "n"))), lambda x: F.concat(x["path"], F.lit("="), x["n"].cast("string"))), ",").alias("by_path"))
    status = r.groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))
    status = status.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status_code", "n"))), lambda x: F.concat(x["status_code"].cast("string"), F.lit("="), x["n"].cast("string"))), ",").alias("by_status"))
    return base.crossJoin(F.broadcast(paths)).crossJoin(F.broadcast(status))


def run_summary(runs: DataFrame, *, keep: int = 200) -> DataFrame:
    """One row over the latest runs: counts, rates, durations and the latest run's level."""
    r = last_n(runs, keep)
    out = r.agg(
        F.count(F.lit(1)).alias("runs_total"), F.coalesce(F.sum((F.col("quality_level") == "poor").cast("long")), F.lit(0)).alias("poor_runs_total"), safe_mean(F.col("raw_error_rate")).alias("average_raw_error_rate"),
        safe_mean(F.col("after_ai_error_rate")).alias("average_after_ai_error_rate"), safe_mean(F.col("duration_ms")).alias("avg_ms"), nearest_rank(F.collect_list("duration_ms"), 95).alias("p95_ms"),
        F.coalesce(F.bround(F.max("duration_ms"), 2), F.lit(0.0)).alias("max_ms"), F.max_by("quality_level", F.struct("ts", "ord")).alias("latest_level"),
    )
    return out.withColumns({"poor_rate": F.coalesce(rate(F.try_divide("poor_runs_total", "runs_total")), F.lit(0.0)), "average_improvement_rate": rate(F.greatest(F.col("average_raw_error_rate") - F.col("average_after_ai_error_rate"), F.lit(0.0)))})


def health(api: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: degraded where a fifth of requests fail or the latest run is poor."""
    bad = (F.col("error_rate") >= 0.2) | (F.coalesce("latest_level", F.lit("")) == "poor")
    return api.crossJoin(F.broadcast(runs.select("latest_level", "runs_total"))).select(F.when(bad, "degraded").otherwise("ok").alias("status"), "error_rate", "requests_total", "runs_total")


def quality_level(after: Column) -> Column:
    return F.when(after >= 0.35, "poor").when(after >= 0.15, "degraded").otherwise("good")


def quality(docs: DataFrame) -> DataFrame:
    """Error estimates of each document.

    Needs: blank (no text), word_count, low_count, document_type, missing (array), warnings (array with
    severity), llm_ok, corrected and model_ok.
    """
    weight = lambda w: F.when(w["severity"] == "low", 0.25).when(w["severity"] == "high", 1.0).otherwise(0.5)
    score = F.aggregate("warnings", F.lit(0.0), lambda a, w: a + weight(w))
    missing = F.size("missing")
    issues = F.when(F.col("document_type").isin("invoice", "receipt", "contract"), rate((score + missing) / (missing + 3.0))).otherwise(0.0)
    raw = F.when(F.col("blank"), 1.0).when(F.col("word_count") > 0, F.col("low_count") / F.col("word_count")).otherwise(0.0)
    factor = F.least(F.when(F.col("llm_ok"), F.when(F.col("corrected"), 0.55).otherwise(0.75)).otherwise(1.0), F.when(F.col("model_ok"), 0.85).otherwise(1.0))
    out = docs.withColumn("_raw", raw).withColumn("_after", F.greatest(F.col("_raw") * factor, issues))
    out = out.withColumns({"raw_error_rate": rate(F.col("_raw")), "after_ai_error_rate": rate(F.col("_after"))}).drop("_raw", "_after")
    return out.withColumns({"improvement_rate": rate(F.greatest(F.col("raw_error_rate") - F.col("after_ai_error_rate"), F.lit(0.0))), "warning_count": F.size("warnings"), "quality_level": quality_level(F.col("after_ai_error_rate"))})


def evaluate(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per document: whether the type is right, checked and correct fields.

    expected: doc_id, document_type, fields map; predicted: doc_id, document_type, fields map, latency_ms.
    """
    p = predicted.select("doc_id", F.col("document_type").alias("predicted_type"), F.col("fields").alias("got"), "latency_ms")
    e = expected.join(p, "doc_id", "left")
    same = F.filter(F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))), lambda x: eval_normal(F.coalesce(x["value"], F.lit(""))) == eval_normal(F.coalesce(F.try_element_at("got", x["key"]), F.lit(""))))
    return e.select("doc_id", "latency_ms", F.col("document_type").alias("expected_type"), "predicted_type", F.when(F.col("document_type") != "", F.col("document_type") == F.coalesce("predicted_type", F.lit(""))).alias("type_correct"), F.coalesce(F.size("fields"), F.lit(0)).alias("checked_fields"), F.size(same).alias("correct_fields"))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row: documents, accuracies and latencies; the percentile from counts of equal latencies, so that none are collected."""
    counts = results.filter(F.col("latency_ms").isNotNull()).groupBy("latency_ms").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    p95 = ranked.filter(F.col("upto") > F.bround(F.lit(0.95) * (F.col("all") - 1))).agg(F.coalesce(F.bround(F.min("latency_ms"), 2), F.lit(0.0)).alias("p95_latency_ms"))
    return results.agg(
        F.count(F.lit(1)).alias("documents"), F.bround(F.avg(F.col("type_correct").cast("double")), 4).alias("document_type_accuracy"), F.bround(F.try_divide(F.sum("correct_fields"), F.sum("checked_fields")), 4).alias("field_accuracy"),
        F.sum("checked_fields").alias("checked_fields"), F.sum("correct_fields").alias("correct_fields"), F.bround(F.avg("latency_ms"), 2).alias("average_latency_ms"),
    ).crossJoin(F.broadcast(p95))


def percentiles_by(events: DataFrame, key: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles of each key, by counting instead of collecting: ranks in the window, rows kept by rank."""
    w = Window.partitionBy(key)
    ranked = events.filter(F.col(value).isNotNull()).select(key, value, F.row_number().over(w.orderBy(value)).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.bround(F.lit(p / 100) * (F.col("n") - 1)).cast("int") + 1, F.bround(value, 2))).alias(f"p{p}")
    return ranked.groupBy(key).agg(*[at(p) for p in percents])
