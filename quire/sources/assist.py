"""What surrounds a language model: its settings, what it is told, and the states of its analysis."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.adapters import ASSISTED, Adapter, apply, assisted_fields

#: (doc_id, response, error): a model's replies; error is null where it answered.
REPLIES = "doc_id long, response string, error string"


def env_file(path: str) -> dict[str, str]:
    """The KEY=value lines of a file, quotes taken off; no file gives nothing."""
    at = Path(path)
    lines = [x.strip() for x in at.read_text(encoding="utf-8").splitlines()] if at.exists() else []
    pairs = [x.split("=", 1) for x in lines if x and not x.startswith("#") and "=" in x]
    out: dict[str, str] = {}
    for k, v in pairs:
        out.setdefault(k.strip(), v.strip().strip('"').strip("'"))
    return out


def share(values: Mapping[str, str], key: str, default: float) -> float:
    """A setting between 0 and 1; the default where it isn't a number."""
    try:
        return max(0.0, min(float(values.get(key, default)), 1.0))
    except ValueError:
        return default


def at_least(values: Mapping[str, str], key: str, default: int, least: int = 32) -> int:
    """A whole-number setting that isn't below ``least``; the default where it isn't one."""
    try:
        return max(least, int(values.get(key, default)))
    except ValueError:
        return default


@dataclass(frozen=True)
class Assistant:
    """A language model: replies come from an adapter over (doc_id, context, text)."""

    provider: str = "none"
    model: str = ""
    adapter: Adapter | None = None
    clip: int = 6000

    @property
    def state(self) -> str:
        return "enabled" if self.adapter is not None and self.provider != "none" else "disabled" if self.provider == "none" else "unavailable"


def settings(path: str = ".env", environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings of the environment, with the file's where it has none."""
    return env_file(path) | dict(os.environ if environment is None else environment)


def context(analysed: DataFrame, *, pairs: int = 20) -> Column:
    """Compact JSON of what is known of a document: type, summary, fields' values and the first pairs."""
    fields = F.map_from_entries(F.transform("fields", lambda x: F.struct(x["field_name"], x["f"]["value"])))
    known = F.transform(F.slice("pairs", 1, pairs), lambda p: F.struct(p["label"].alias("label"), F.coalesce(p["display"], p["value"]).alias("value"), p["canonical"].alias("canonical")))
    return F.to_json(F.struct("document_type", "summary", fields.alias("fields"), known.alias("generic_key_values")), {"ignoreNullFields": "false"})


def analyse(analysed: DataFrame, model: Assistant | None = None) -> DataFrame:
    """(doc_id, status, llm_summary, corrected_text, llm_fields) for each document of analyze_text.

    status: disabled or unavailable without a model; skipped for empty texts, error where the model fails or its reply
    holds no JSON object, else ok.
    """
    model = model or Assistant()
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    if model.state != "enabled":
        none = F.lit(None).cast("string")
        return analysed.select("doc_id", F.lit(model.state).alias("status"), none.alias("llm_summary"), none.alias("corrected_text"), F.lit(None).cast("map<string,string>").alias("llm_fields"))
    asked = analysed.filter(~empty).select("doc_id", context(analysed).alias("context"), F.substring("text", 1, model.clip).alias("text"))
    got = apply(asked, model.adapter, REPLIES).withColumn("_body", F.regexp_extract(F.coalesce("response", F.lit("")), r"(?s)\{.*\}", 0))
    valid = F.col("error").isNull() & F.try_parse_json("_body").isNotNull() & (F.col("_body") != "")
    say = lambda *names: F.trim(F.coalesce(*[F.get_json_object("_body", f"$.{n}") for n in names], F.lit("")))
    replies = got.select("doc_id", F.when(valid, "ok").otherwise("error").alias("_s"), F.when(valid, say("summary")).alias("llm_summary"), F.when(valid, say("full_corrected_text", "corrected_text")).alias("corrected_text"), F.when(valid, assisted_fields(F.col("response"))).alias("llm_fields"))
    joined = analysed.select("doc_id", empty.alias("_empty")).join(replies, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("_empty"), "skipped").otherwise(F.coalesce("_s", F.lit("error"))).alias("status"), "llm_summary", "corrected_text", "llm_fields")


def candidates(analyses: DataFrame) -> DataFrame:
    """The analyses' fields as candidates for a merge: plain values, or objects with value, confidence and source."""
    each = analyses.filter(F.col("llm_fields").isNotNull()).select("doc_id", F.posexplode(F.map_entries("llm_fields")).alias("ord", "e"))
    value, plain = F.col("e.value"), ~F.col("e.value").startswith("{")
    part = lambda n: F.when(~plain, F.get_json_object("e.value", f"$.{n}"))
    rows = each.select("doc_id", F.col("e.key").alias("field_name"), F.when(plain, value).otherwise(part("value")).alias("value"), part("confidence").alias("confidence"), F.coalesce(part("source"), F.lit("llm:ocr_correction")).alias("source"), "ord")
    return rows.to(_schema(ASSISTED))


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
