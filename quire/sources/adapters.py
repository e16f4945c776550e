"""Model-backed steps as pluggable adapters; the defaults do nothing, so the rest runs without them.

An adapter is a function from an iterator of Arrow batches to an iterator of Arrow batches.  It is made once a task,
so a model loads once.  Write gates (kind of document, settings) before an adapter: the optimiser can't move a filter below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Adapter = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ENTITIES = "doc_id long, page int, ord long, word string, label string, confidence double, box array<int>"
ASSISTED = "doc_id long, field_name string, value string, confidence string, source string, ord int"


def apply(rows: DataFrame, adapter: Adapter | None, schema: str | StructType | None = None) -> DataFrame:
    """Rows through an adapter; without one, as they are (same columns) or none (other columns)."""
    if adapter is None:
        return rows if schema is None else rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(adapter, schema or rows.schema)


def wants_preprocessing(path: Column, enabled: bool, mode: str) -> Column:
    """Whether an image file goes through preprocessing."""
    return F.lit(enabled and mode != "none") & F.lower(path).rlike(r"\.(jpg|jpeg|png|bmp|tif|tiff)$")


def recognise(files: DataFrame, adapter: Adapter | None, schema: str) -> DataFrame:
    """Files to recognised documents."""
    return apply(files, adapter, schema)


def correct(lines: DataFrame, adapter: Adapter | None = None) -> DataFrame:
    """Line by line text correction; identity without a model."""
    return apply(lines, adapter)


def tag(words: DataFrame, kinds: DataFrame, adapter: Adapter | None = None, *, chunk: int = 180) -> DataFrame:
    """Entity labels of the words of invoices and receipts, in chunks of words."""
    some = words.join(kinds.filter(F.col("document_type").isin("invoice", "receipt")).select("doc_id"), "doc_id", "left_semi")
    return apply(some.withColumn("chunk", F.floor((F.col("ord") - 1) / chunk)), adapter, ENTITIES)


def assist(docs: DataFrame, adapter: Adapter | None = None) -> DataFrame:
    """A language model's field candidates; none without a model."""
    return apply(docs, adapter, ASSISTED)


def assisted_fields(response: Column) -> Column:
    """Map of the fields in a model's reply: the object in it, else null."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return F.coalesce(F.from_json(F.get_json_object(body, "$.fields"), "map<string,string>"), F.from_json(body, "map<string,string>"))


def status(**adapters: Adapter | None) -> dict[str, str]:
    """Which adapters are there."""
    return {name: "ready" if a else "disabled" for name, a in adapters.items()}
