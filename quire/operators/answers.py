"""Merging fields by precedence, and answers to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicon as L
from quire.functions.kernels import let, once
from quire.functions.text import assisted_confidence, confidence, currency, field_name, fold, has_any, parse_amount
from quire.operators.fields import FIELD, allowed, get_field, humanized, labelled, number_text, rejection, relevant_lines
from quire.operators.keyvalue import find_by_field, match_question

_ENTRY = f"array<struct<field_name: string, f: {FIELD}>>"


def best_entities(entities: DataFrame) -> DataFrame:
    """(doc_id, field_name, value, confidence, source): the surest entity of each mapped label, the first of equals."""
    names = F.create_map(*[F.lit(x) for kv in L.ENTITY_FIELDS.items() for x in kv])
    e = entities.withColumn("field_name", F.try_element_at(names, F.col("label"))).filter("field_name IS NOT NULL")
    w = Window.partitionBy("doc_id", "field_name").orderBy(F.desc("confidence"), F.asc_nulls_last("ord"))
    return e.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "field_name", "value", "confidence", F.concat(F.lit("layoutxlm:"), F.lower("label")).alias("source"))


def bio_entities(predictions: DataFrame) -> DataFrame:
    """(doc_id, page, label, ord, value, confidence, box) from (doc_id, page, ord, word, label, confidence, box). Words without a place come last, those of one place by their text."""
    w = Window.partitionBy("doc_id").orderBy("page", F.asc_nulls_last("ord"))
    kind, prefix = F.when(F.col("label").contains("-"), F.substring_index("label", "-", -1)), F.substring_index("label", "-", 1)
    p = predictions.withColumns({"kind": F.when(F.col("label") != "O", F.expr("substring(label, instr(label, '-') + 1)")).otherwise(None), "prefix": prefix})
    p = p.withColumn("kind", F.when(kind.isNotNull(), F.col("kind")))
    new = F.col("kind").isNotNull() & ((F.col("prefix") == "B") | F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | (F.lag("page").over(w) != F.col("page")))
    p = p.withColumn("g", F.sum(new.cast("int")).over(w)).filter("kind IS NOT NULL")
    side = lambda f, i: f(F.get("box", F.lit(i)))
    return p.groupBy("doc_id", "page", "kind", "g").agg(F.min("ord").alias("ord"), F.when(F.count("word") > 0, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").isNull(), "ord", "word"))), lambda x: x["word"]), " ")).alias("value"), F.bround(F.avg("confidence"), 4).alias("confidence"), F.array(side(F.min, 0), side(F.min, 1), side(F.max, 2), side(F.max, 3)).alias("box")).select("doc_id", "page", F.col("kind").alias("label"), "ord", "value", "confidence", "box")


def replaces_pair(name: Column, old: Column, pair: Column) -> Column:
    """Whether a pair from a block or a row takes the place of a field."""
    text, digit = F.coalesce(old["value"], F.lit("")), r"\d"
    party = name.isin("buyer", "seller", "shipping_address", "billing_address") & has_any(fold(text), L.LABEL_MARKERS)
    number = (name == "invoice_number") & pair["display"].rlike(digit) & ~text.rlike(digit)
    return pair["source"].rlike("^(section|layout):") & old["values"].isNull() & (pair["display"] != "") & ((text == "") | party | number)


def merge_pairs(fields: Column, pairs: Column, kind: Column) -> Column:
    """Fields with the pairs' values: new ones, and better ones by the rule above; a block's further lines are the address."""
    targets = ["buyer", "seller", "shipping_address", "billing_address", "invoice_number", "payment_method", "invoice_form", "invoice_symbol"]

    def entry(name: Column, value: Column, p: Column) -> Column:
        f = F.struct(value.alias("value"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("array<string>").alias("values"), p["confidence"].alias("confidence"), F.concat(F.lit("generic_kv:"), p["source"]).alias("source"), p["value"].alias("raw"), F.lit(None).cast("string").alias("currency"))
        return F.array(F.struct(name.alias("field_name"), f.alias("f"))).cast(_ENTRY)

    def step(state: Column, p: Column) -> Column:
        name = p["canonical"]
        old = F.get(F.filter(state, lambda x: x["field_name"] == name), F.lit(0))["f"]
        rest = F.filter(state, lambda x: x["field_name"] != name)
        lines = F.filter(F.split(p["value"], "\n"), lambda v: F.trim(v) != "")
        address = F.when(name.isin("buyer", "seller") & (F.size(lines) > 1) & ~F.exists(fields, lambda x: x["field_name"] == F.concat(name, F.lit("_address"))), entry(F.concat(name, F.lit("_address")), F.array_join(F.slice(lines, 2, 9), "\n"), p)).otherwise(F.array().cast(_ENTRY))
        plain = F.filter(rest, lambda x: (F.size(address) == 0) | (x["field_name"] != F.concat(name, F.lit("_address"))))
        return let(old, lambda o: F.when(o.isNull() | replaces_pair(name, o, p), F.concat(plain, entry(name, p["display"], p), address)).otherwise(state))

    usable = F.filter(pairs, lambda p: p["canonical"].isin(*targets) & allowed(p["canonical"], kind) & (p["display"] != ""))
    return F.aggregate(usable, fields.cast(_ENTRY), step)


def merge_model(old: DataFrame, candidates: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected) long fields: a model's candidate takes a field's place where it is much surer.

    old: doc_id, field_name, value, confidence, source; candidates: the same; kinds: doc_id, document_type.
    """
    c = candidates.join(kinds, "doc_id").filter(allowed(F.col("field_name"), F.col("document_type"))).withColumn("reason", rejection(F.col("field_name"), F.col("value")))
    bad = c.filter("reason IS NOT NULL").select("doc_id", "field_name", "value", F.col("reason").alias("rejection_reason"))
    value = F.when(F.col("field_name") == "total_amount", number_text(parse_amount(F.col("value")))).otherwise(F.col("value"))
    good = c.filter("reason IS NULL").select("doc_id", "field_name", value.alias("v"), confidence(F.col("confidence").cast("string"), 0.55).alias("c"), F.col("source").alias("s"))
    both = old.join(good, ["doc_id", "field_name"], "full")
    take = F.col("v").isNotNull() & (F.col("value").isNull() | ((F.col("c") >= 0.88) & (F.col("confidence") <= 0.72)) | (F.col("source").startswith("generic_kv:") & (F.col("c") >= F.col("confidence") + 0.08)))
    pick = lambda new, was: F.when(take, F.col(new)).otherwise(F.col(was)).alias(was)
    return both.select("doc_id", "field_name", pick("v", "value"), pick("c", "confidence"), pick("s", "source")), bad


def replaces_assisted(name: Column, value: Column, sure: Column, source: Column, new: Column, new_sure: Column) -> Column:
    """Whether a language model's value takes the place of a field."""
    label_like = ["date", "invoice", "invoice date", "due date", "no", "number"]
    number = (name == "invoice_number") & source.startswith("regex:") & new.rlike(r"\d") & (fold(value).isin(*label_like) | ~value.rlike(r"\d"))
    model = source.startswith("layoutxlm:") & (new_sure >= 0.55) & (rejection(name, value).isNotNull() | ((name == "total_amount") & (sure <= 0.8)) | (name.isin("primary_date", "invoice_number") & (sure <= 0.75)))
    return ((name == "total_amount") & (source == "regex:largest_amount")) | ((sure <= 0.56) & (new_sure >= 0.55)) | number | model | (source.startswith("llm:") & (new_sure >= sure))


def merge_assisted(old: DataFrame, candidates: DataFrame, kinds: DataFrame) -> DataFrame:
    """Long fields after a language model's: names are normalised, the first usable one of a name counts.

    candidates: doc_id, field_name (free form), value, confidence (text), source, ord.
    """
    c = candidates.withColumn("field_name", field_name(F.col("field_name"))).join(kinds, "doc_id").filter((F.col("field_name") != "") & allowed(F.col("field_name"), F.col("document_type")) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    amount = parse_amount(F.col("value"))
    c = c.filter((F.col("field_name") != "total_amount") | amount.isNotNull())
    c = c.select("doc_id", "field_name", F.when(F.col("field_name") == "total_amount", number_text(amount)).otherwise(F.col("value")).alias("v"), assisted_confidence(F.col("confidence")).alias("c"), F.coalesce("source", F.lit("llm:ocr_correction")).alias("s"), "ord")
    both = c.join(old, ["doc_id", "field_name"], "left")
    good = both.filter(F.col("value").isNull() | replaces_assisted(F.col("field_name"), F.col("value"), F.col("confidence"), F.col("source"), F.col("v"), F.col("c")))
    w = Window.partitionBy("doc_id", "field_name").orderBy("ord")
    first = good.withColumn("r", F.row_number().over(w)).filter("r = 1").select("doc_id", "field_name", F.col("v").alias("value"), F.col("c").alias("confidence"), F.col("s").alias("source"))
    return old.join(first, ["doc_id", "field_name"], "left_anti").select("doc_id", "field_name", "value", "confidence", "source").unionByName(first)


def assisted_currency(value: Column) -> Column:
    return currency(value)


def answer(rows: DataFrame) -> DataFrame:
    """Adds answer and matched_field.

    rows: question, text, lines (of the text), pairs, fields, summary, and llm_answer (null where there is none).
    Rules go in order; one whose question words match but that finds nothing passes on to the next.
    """
    rows = once(rows, "_q", fold(F.col("question")))
    rows = once(rows, "_kv", match_question(F.col("pairs"), F.col("question")))
    fields, lines, pairs, kv = F.col("fields"), F.col("lines"), F.col("pairs"), F.col("_kv")
    say = lambda text, name: F.struct(text.alias("answer"), (name if isinstance(name, Column) else F.lit(name)).alias("matched_field"))
    kv_name = F.coalesce(kv["canonical"], F.lit("generic_kv"))
    stages = []
    for words, name in L.QUESTION_FIELDS:
        direct = F.when(kv.isNotNull() & ((kv_name == name) | ((kv_name == "generic_kv") & F.lit(name in L.LOOSE_FIELDS))), say(kv["display"], kv_name))
        options = [direct]
        if name in L.FIELD_CANONICALS:
            options.append(let(find_by_field(pairs, F.lit(name)), lambda p, name=name: F.when(p.isNotNull(), say(p["display"], name))))
        if name in L.ANSWER_LABELS:
            options.append(let(labelled(lines, L.ANSWER_LABELS[name]), lambda v, name=name: F.when(v.isNotNull(), say(v["value"], name))))
        options.append(let(get_field(fields, name), lambda f, name=name: F.when(f.isNotNull(), say(humanized(F.lit(name), f), name))))
        stages.append(F.when(has_any(F.col("_q"), words), F.coalesce(*options)))
    stages.append(F.when(has_any(F.col("_q"), L.SUMMARY_QUESTIONS), say(F.col("summary"), "summary")))
    stages.append(F.when(kv.isNotNull(), say(kv["display"], kv_name)))
    stages.append(F.when(F.col("llm_answer").isNotNull(), say(F.col("llm_answer"), "llm_answer")))
    stages.append(let(relevant_lines(F.col("question"), F.col("text")), lambda a: F.when(F.size(a) > 0, say(F.array_join(a, "\n"), "text_search"))))
    out = once(rows, "_a", F.coalesce(*stages, say(F.lit(L.NO_ANSWER), F.lit(None).cast("string"))))
    return out.withColumns({"answer": F.col("_a.answer"), "matched_field": F.col("_a.matched_field")}).drop("_a", "_q", "_kv")
