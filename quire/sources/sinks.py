"""Results as files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import pages as P


def write_results(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation results and their summary as JSON lines."""
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")


def export_rows(ordered_pages: DataFrame) -> DataFrame:
    """(doc_id, page, row, text, y1, paragraph) of the lines in reading order, for document renderers."""
    flags = P.paragraph_gaps(F.transform("ordered", lambda x: x["y1"]))
    rows = ordered_pages.withColumn("gaps", flags).select("doc_id", "page", "gaps", F.posexplode("ordered").alias("row", "x"))
    return rows.select("doc_id", "page", "row", "x.text", "x.y1", F.coalesce(F.get("gaps", F.col("row") - 1), F.lit(False)).alias("paragraph"))


def wrap(text: Column, widths: dict[str, float], limit: float, default: float = 1.0) -> Column:
    """Array of lines no wider than ``limit``: words are filled up, a word wider than a line is cut between characters.

    ``widths``: of single characters; others are ``default`` wide.  A text without words is one empty line.
    """
    table = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv]) if widths else F.create_map().cast("map<string,double>")
    size = lambda s: F.aggregate(F.split(s, ""), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.coalesce(F.try_element_at(table, c), F.lit(default))))
    state = "struct<done: array<string>, line: string>"
    put = lambda done, line: F.struct(done.cast("array<string>").alias("done"), line.alias("line")).cast(state)
    closed = lambda s: F.when(s["line"] != "", F.concat(s["done"], F.array(s["line"]))).otherwise(s["done"])

    def letter(s: Column, c: Column) -> Column:
        return F.when(size(F.concat(s["line"], c)) <= limit, put(s["done"], F.concat(s["line"], c))).otherwise(put(closed(s), c))

    def word(s: Column, w: Column) -> Column:
        both = F.trim(F.concat(s["line"], F.lit(" "), w))
        cut = F.aggregate(F.filter(F.split(w, ""), lambda c: c != ""), put(closed(s), F.lit("")), letter)
        return F.when(size(both) <= limit, put(s["done"], both)).when(size(w) <= limit, put(closed(s), w)).otherwise(cut)

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(F.aggregate(words, put(F.array(), F.lit("")), word, closed))


def write_tuning(path: str, best: int, train: dict, validation: dict) -> dict:
    """The tuned threshold with the scores behind it, as one JSON file; nothing reads it back."""
    out = {"document_agent": {"invoice_keyword_threshold": best}, "train_scores": train, "validation_scores": validation}
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")
    return out


def read_settings(path: str) -> dict:
    """Settings with defaults; a missing or corrupt file gives the defaults."""
    base = {"image_preprocessing_enabled": True, "theme": "light"}
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return base
    return base | {k: v for k, v in found.items() if k in base} if isinstance(found, dict) else base


def write_settings(path: str, **changes) -> dict:
    now = read_settings(path) | changes
    Path(path).write_text(json.dumps(now), encoding="utf-8")
    return now
