"""Fields from a text's lines; every rule works inside a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import lexicon as L
from quire.functions.kernels import let, take_until
from quire.functions.text import U, currency, distinct_in_order, fold, has_any, hits, lines_of, matches, parse_amount, strip
from quire.operators.classify import _by_score

FIELD = "struct<value: string, number: double, values: array<string>, confidence: double, source: string, raw: string, currency: string>"


def field(value: Column, confidence, source, *, number=None, values=None, raw=None, money=None) -> Column:
    """A field, or null where its value is null."""
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    rest = lambda: [lit(values).cast("array<string>").alias("values"), lit(confidence).cast("double").alias("confidence"), lit(source).cast("string").alias("source"), lit(raw).cast("string").alias("raw"), lit(money).cast("string").alias("currency")]
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), lit(number).cast("double").alias("number"), *rest()).cast(FIELD)))


def many(found: Column, confidence: float, source: str) -> Column:
    return let(found, lambda x: F.when(F.size(x) > 0, field(F.array_join(x, " "), confidence, source, values=x)))


def dates(text: Column) -> Column:
    return distinct_in_order(matches(text, L.DATE))


def emails(text: Column) -> Column:
    return F.when(~text.contains("@"), F.array().cast("array<string>")).otherwise(distinct_in_order(matches(text, L.EMAIL)))


def phones(text: Column) -> Column:
    return distinct_in_order(F.filter(matches(text, L.PHONE), lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 9))


def tax_codes(lines: Column) -> Column:
    named = F.filter(lines, lambda x: has_any(x["norm"], L.TAX_WORDS))
    return distinct_in_order(F.flatten(F.transform(named, lambda x: matches(x["text"], L.TAX_CODE))))


def amounts(text: Column, confidence: Column, source: str) -> Column:
    """Array of (value, raw, currency, confidence, source) of the amounts that can be read."""
    found = F.transform(matches(text, L.AMOUNT), lambda x: F.struct(parse_amount(x).alias("value"), strip(x).alias("raw"), currency(x).alias("currency"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source")))
    return F.filter(found, lambda x: x["value"].isNotNull())


def largest(found: Column) -> Column:
    """The first of the largest values."""
    first = lambda a, top: F.get(F.filter(a, lambda x: x["value"] == top), F.lit(0))
    return let(found, lambda a: let(F.array_max(F.transform(a, lambda x: x["value"])), lambda top: first(a, top)))


def total_amount(lines: Column, text: Column) -> Column:
    """The largest amount on a line that speaks of a total, else the largest anywhere."""
    scored = F.filter(F.transform(lines, lambda x: F.struct(x["text"].alias("text"), hits(x["norm"], L.TOTAL_WORDS).alias("n"))), lambda x: x["n"] > 0)
    on_lines = F.flatten(F.transform(scored, lambda x: amounts(x["text"], _by_score(x["n"], L.TOTAL_CONFIDENCE), "line:total_keyword")))
    best = F.coalesce(largest(on_lines), largest(amounts(text, F.lit(0.55), "regex:largest_amount")))
    return let(best, lambda b: field(number_text(b["value"]), b["confidence"], b["source"], number=b["value"], raw=b["raw"], money=b["currency"]))


def number_text(x: Column) -> Column:
    """A number without a decimal point where it is whole."""
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def invoice_number(lines: Column) -> Column:
    """The first line's first pattern that matches, tax lines left out."""
    ok = F.filter(lines, lambda x: ~has_any(x["norm"], ["ma so thue", "mst"]) & has_any(x["norm"], L.INVOICE_NUMBER_LINES))
    first = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x["text"], p, 1), F.lit("")) for p in L.INVOICE_NUMBER])
    found = F.filter(F.transform(ok, lambda x: F.struct(strip(first(x)).alias("value"), x["text"].alias("line"))), lambda x: x["value"].isNotNull())
    return let(F.get(found, F.lit(0)), lambda one: field(one["value"], 0.72, "regex:invoice_number", raw=one["line"]))


def after_separator(text: Column) -> Column:
    """What follows the first colon, else hyphen, else dash; the whole text if there is none."""
    out = text
    for sign in ("–", "-", ":"):
        out = F.when(F.locate(sign, text) > 0, F.substring(text, F.locate(sign, text) + 1, F.length(text))).otherwise(out)
    return strip(out)


def without_label(text: Column, norm: Column, labels: list[str]) -> Column:
    """What follows the longest label that the text holds; empty if none does."""
    out = F.lit("")
    for label in sorted(labels, key=len):
        at = F.locate(label, norm)
        out = F.when(at > 0, strip(F.substring(text, at + len(label), F.length(text)), r" :\-–")).otherwise(out)
    return out


def next_value(lines: Column, i: Column) -> Column:
    """The first of the next three lines unless it looks like a label."""
    following = take_until(F.slice(lines, i + 2, F.lit(3)), lambda x: has_any(x["norm"], L.NEXT_LINE_STOPS))
    return F.coalesce(F.get(following, F.lit(0))["text"], F.lit(""))


def labelled(lines: Column, labels: list[str]) -> Column:
    """(value, line) of the first line that holds a label and yields a value; null if none."""

    def read(x: Column, i: Column) -> Column:
        cut = let(after_separator(x["text"]), lambda c: F.when((c == "") | (fold(c) == x["norm"]), without_label(x["text"], x["norm"], labels)).otherwise(c))
        value = let(cut, lambda v: F.when(v == "", next_value(lines, i)).otherwise(v))
        return F.when(has_any(x["norm"], labels), let(value, lambda v: F.when(v != "", F.struct(v.alias("value"), x["text"].alias("line")))))

    return F.get(F.filter(F.transform(lines, read), lambda x: x.isNotNull()), F.lit(0))


def allowed(name: Column, kind: Column) -> Column:
    """Whether a document of the kind may have the field."""
    return F.when(name.isin(*L.INVOICE_ONLY), kind == "invoice").when(name.isin(*L.FINANCIAL), kind.isin("invoice", "receipt")).otherwise(F.lit(True))


def extract_fields(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Adds ``fields``: array of (field_name, f) of the fields found; needs ``document_type``.

    All rules sit in one expression, so each runs once a row and nothing is shuffled.
    """

    def every(row: Column) -> Column:
        text, kind, lines, days = row["text"], row["kind"], row["lines"], row["days"]
        invoice, financial = kind == "invoice", kind.isin("invoice", "receipt")
        party_confidence = F.when(kind.isin("contract", "invoice"), 0.68).otherwise(0.58)
        made = {
            "primary_date": field(F.get(days, F.lit(0)), 0.76, "regex:date"), "dates": many(days, 0.7, "regex:date"), "emails": many(emails(text), 0.88, "regex:email"),
            "phone_numbers": many(phones(text), 0.75, "regex:phone"), "tax_codes": F.when(invoice, many(tax_codes(lines), 0.82, "regex:tax_code")),
            "total_amount": F.when(financial, total_amount(lines, text)), "invoice_number": F.when(invoice, invoice_number(lines)),
        }
        for name, labels in L.PARTY_LABELS.items():
            made[name] = let(labelled(lines, labels), lambda got, name=name: field(got["value"], party_confidence, f"line:{name}"))
        for name, (labels, confidence, source) in L.LOCAL_LABELS.items():
            late = F.when(invoice, let(labelled(lines, labels), lambda got, c=confidence, o=source: field(got["value"], c, o)))
            made[name] = F.coalesce(made[name], late) if name in made else late
        return F.filter(F.array(*[F.struct(F.lit(n).alias("field_name"), made[n].alias("f")) for n in NAMES]), lambda x: x["f"].isNotNull())

    row = let(F.coalesce(F.col(text_col), F.lit("")), lambda t: F.struct(t.alias("text"), F.col("document_type").alias("kind"), lines_of(t).alias("lines"), dates(t).alias("days")))
    return docs.withColumn("fields", let(row, every))


NAMES = ["primary_date", "dates", "emails", "phone_numbers", "tax_codes", "invoice_number", "total_amount", "party_a", "party_b", "seller", "buyer", "invoice_form", "invoice_symbol", "payment_method", "amount_in_words", "seller_address", "buyer_address"]


def get_field(fields: Column, name: str) -> Column:
    return F.get(F.filter(fields, lambda x: x["field_name"] == name), F.lit(0))["f"]


def long_fields(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each field found: keys, field_name and the field's parts."""
    return docs.select(*keys, F.explode("fields").alias("x")).select(*keys, "x.field_name", "x.f.*")


def present(fields: Column) -> Column:
    """Names of the fields that a row has."""
    return F.transform(fields, lambda x: x["field_name"])


def missing_required(kind: Column, have: Column) -> Column:
    none = F.array().cast("array<string>")
    needed = lambda k: F.when(k == "invoice", F.array(*map(F.lit, L.REQUIRED["invoice"]))).when(k == "receipt", F.array(*map(F.lit, L.REQUIRED["receipt"]))).when(k == "contract", F.array(*map(F.lit, L.REQUIRED["contract"]))).otherwise(none)
    return F.array_except(let(kind, needed), have)


def warnings(kind: Column, have: Column, text: Column, low_words: Column) -> Column:
    """Array of (type, severity, detail). ``low_words``: (value, confidence) of words below the limit, in order."""
    w = lambda name, severity, detail=None: F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))

    def single(row: Column) -> Column:
        kind, lacks = row["kind"], lambda name: ~F.array_contains(row["have"], name)
        return F.filter(
            F.array(
                F.when(row["blank"], w("empty_text", "high")), F.when(kind.isin("invoice", "receipt") & lacks("total_amount"), w("missing_total_amount", "medium")),
                F.when((kind == "invoice") & lacks("tax_codes"), w("missing_tax_code", "low")), F.when((kind == "invoice") & lacks("invoice_number"), w("missing_invoice_number", "medium")),
            ), lambda x: x.isNotNull(),
        )

    low = F.transform(F.slice(low_words, 1, 8), lambda x: w("low_confidence_word", "medium", F.concat(x["value"], F.lit(" "), F.format_number(x["confidence"], 2))))
    return F.concat(let(F.struct(kind.alias("kind"), have.alias("have"), (strip(text) == "").alias("blank")), single), low)


def summary(kind: Column, text: Column, primary_date: Column, total: Column, number: Column) -> Column:
    """A sentence from type, date, total and number; without any of them, the first two lines."""
    labels = F.create_map(*[F.lit(x) for kv in L.SUMMARY_LABELS.items() for x in kv])

    def say(row: Column) -> Column:
        label, total = F.coalesce(F.element_at(labels, row["kind"]), F.lit("Tài liệu văn bản")), row["total"]
        money = F.trim(F.concat(F.lit("tổng tiền "), total["value"], F.lit(" "), F.coalesce(total["currency"], F.lit(""))))
        parts = F.filter(F.array(F.concat(F.lit("ngày "), row["day"]["value"]), money, F.concat(F.lit("số "), row["number"]["value"])), lambda x: x.isNotNull())
        preview = F.substring(F.array_join(F.slice(F.transform(lines_of(row["text"]), lambda x: x["text"]), 1, 2), " "), 1, 220)
        short = let(preview, lambda p: F.when(p != "", p).otherwise(F.concat(label, F.lit("."))))
        return let(parts, lambda p: F.when(F.size(p) > 0, F.concat(label, F.lit(", "), F.array_join(p, ", "), F.lit("."))).otherwise(short))

    return let(F.struct(kind.alias("kind"), text.alias("text"), primary_date.alias("day"), total.alias("total"), number.alias("number")), say)


def looks_like_date(text: Column) -> Column:
    norm = fold(text)
    return text.rlike(L.DATE) | norm.rlike(rf"\b\d{{1,2}}\s+(?:{L.MONTHS})\s+\d{{2,4}}\b") | norm.rlike(rf"\b(?:{L.MONTHS})\s+\d{{1,2}},?\s+\d{{2,4}}\b") | norm.rlike(r"\b\d{1,2}\s+thang\s+\d{1,2}\s+\d{2,4}\b")


def rejection(name: Column, value: Column) -> Column:
    """Why a model's candidate isn't taken; null for one that is."""
    text = strip(F.coalesce(value, F.lit("")))
    letters = F.length(F.regexp_replace(text, rf"{U}[^\p{{L}}]", ""))
    amount = parse_amount(text)
    return (
        F.when(text == "", "empty_value")
        .when(fold(text).isin(*L.MODEL_LABEL_VALUES), "label_like_value")
        .when((name == "primary_date") & ~looks_like_date(text), "invalid_date_format")
        .when((name == "total_amount") & (amount.isNull() | (amount <= 0)), "invalid_amount")
        .when((name == "invoice_number") & ((F.length(text) < 2) | ~text.rlike(r"[\p{L}\p{N}]")), "invalid_invoice_number")
        .when(name.isin(*L.PARTY_FIELDS) & ((F.length(text) < 3) | (letters < 2)), "too_short_or_numeric")
    )


def box_ids(boxes: Column, lookup: Column) -> Column:
    """The first five boxes whose label holds the text or is held by it. ``boxes``: array of (id, label)."""
    want = fold(F.coalesce(lookup, F.lit("")))
    near = F.filter(boxes, lambda b: (fold(b["label"]) != "") & (fold(b["label"]).contains(want) | F.contains(want, fold(b["label"]))))
    return F.when(want == "", F.array().cast("array<string>")).otherwise(F.slice(F.transform(near, lambda b: b["id"].cast("string")), 1, 5))


def relevant_lines(question: Column, text: Column, limit: int = 5) -> Column:
    """Lines that hold a word of four letters or more of the question."""
    words = F.filter(matches(fold(question), "[A-Za-z0-9_]+"), lambda x: F.length(x) >= 4)
    return F.slice(F.transform(F.filter(lines_of(text), lambda x: F.exists(words, lambda w: F.contains(x["norm"], w))), lambda x: x["text"]), 1, limit)


def humanized(name: Column, f: Column) -> Column:
    """A field's value for reading, with currency and confidence in percent."""
    shown = F.when(f["values"].isNotNull(), F.array_join(f["values"], ", ")).otherwise(f["value"])
    shown = F.when((name == "total_amount") & f["currency"].isNotNull(), F.concat(shown, F.lit(" "), f["currency"])).otherwise(shown)
    return F.concat(shown, F.coalesce(F.concat(F.lit(" (độ tin cậy "), F.bround(f["confidence"] * 100).cast("int").cast("string"), F.lit("%)")), F.lit("")))
