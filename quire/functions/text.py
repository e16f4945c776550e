"""Scalar text functions as Column to Column; all stay in the JVM."""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from quire.functions.kernels import let

#: Word characters count in any script, and so does white space.
U = "(?U)"


@cache
def _folding() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and those base letters."""
    pairs = []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    pairs.append(("đ", "d"))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents; white space stays."""
    accents = lambda x: F.regexp_replace(F.translate(x, *_folding()), r"\p{Mn}", "")
    return let(F.lower(c), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(accents(x)))


def squeeze(c: Column) -> Column:
    """fold, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(fold(c), rf"{U}\s+", " "))


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without the characters of a class at both ends."""
    return F.regexp_replace(c, rf"{U}^[{chars}]+|[{chars}]+$", "")


def has_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring."""

    def each(x: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | x.contains(w)
        return out

    return let(c, each)


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words are substrings."""
    return let(c, lambda x: sum((x.contains(w).cast("int") for w in words), F.lit(0)))


def has_phrase(c: Column, phrase: str) -> Column:
    """Whether the phrase stands between characters other than a-z and 0-9."""
    return c.contains(phrase) & c.rlike(rf"(?<![a-z0-9])\Q{phrase}\E(?![a-z0-9])")


def literal_start(pattern: str) -> str:
    """Letters that any match of a pattern has after its word boundary; empty where that isn't plain."""
    found = re.match(r"\\b(?:\(\?:([a-z |]+)\)|([a-z ]+))", pattern)
    if not found:
        return ""
    letters = os.path.commonprefix((found[1] or found[2]).split("|"))
    return letters[:-1] if pattern[found.end() : found.end() + 1] in {*"?*{|"} else letters


def matched(c: Column, pattern: str) -> Column:
    """Whether the pattern is found; its first letters are sought before."""
    return c.contains(literal_start(pattern)) & c.rlike(pattern)


def distinct_in_order(values: Column) -> Column:
    """Trimmed values that aren't blank, the first of each folded form."""

    def first(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda x: x["k"])
        return F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x["k"]) == i + 1), lambda x: x["v"])

    trimmed = F.filter(F.transform(values, lambda x: strip(x)), lambda x: x != "")
    return let(F.transform(trimmed, lambda x: F.struct(x.alias("v"), fold(x).alias("k"))), first)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def parse_amount(raw: Column) -> Column:
    """A number from digits, commas and points: the last sign decides which are decimals; null if none."""

    def read(kept: Column) -> Column:
        comma, point = kept.contains(","), kept.contains(".")
        after_comma, after_point = F.length(F.substring_index(kept, ",", -1)), F.length(F.substring_index(kept, ".", -1))
        plain = lambda sign: F.replace(kept, F.lit(sign), F.lit(""))
        number = (
            F.when(comma & point & (after_comma < after_point), F.replace(plain("."), F.lit(","), F.lit(".")))
            .when(comma & point, plain(","))
            .when(comma & (after_comma == 3), plain(","))
            .when(comma, F.replace(kept, F.lit(","), F.lit(".")))
            .when(point & ((F.size(F.split(kept, r"\.")) > 2) | (after_point == 3)), plain("."))
            .otherwise(kept)
        )
        return F.when(kept.isin("", "-", ".", ","), None).otherwise(number.try_cast("double"))

    return let(F.regexp_replace(raw, r"[^\d,.\-]", ""), read)


def currency(raw: Column) -> Column:
    dollar, dong = raw.contains("$"), F.lower(raw).contains("đ")
    return let(fold(raw), lambda f: F.when(f.contains("usd") | dollar, "USD").when(f.contains("vnd") | dong, "VND"))


def lines_of(text: Column) -> Column:
    """Array of (ord, text, norm) of the lines that aren't blank; ord counts blank lines too."""
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x, i: F.struct(i.alias("ord"), strip(x).alias("text")))
    full = F.filter(rows, lambda x: x["text"] != "")
    return F.transform(full, lambda x: F.struct(x["ord"].alias("ord"), x["text"].alias("text"), fold(x["text"]).alias("norm")))


#: Words that say nothing about a label.
STOP_WORDS = ["la", "gi", "ai", "cua", "trong", "nay", "what", "is", "the", "of", "this"]


def tokens(normalized: Column) -> Column:
    """Distinct tokens of two characters or more that aren't stop words."""
    found = F.array_distinct(matches(normalized, "[a-z0-9_#]+"))
    return F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS))


def field_name(c: Column) -> Column:
    """A name for a free-form label: folded, words joined by underscores, 80 characters at most."""
    kept = F.regexp_replace(fold(c), rf"{U}[^\w\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(kept, rf"{U}[\s-]+", "_"), "^_+|_+$", ""), 1, 80)


def confidence(c: Column, default: float = 0.62) -> Column:
    """A number between 0 and 1 with two decimals; what isn't a number is the default."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.coalesce(c.try_cast("double"), F.lit(default)), F.lit(1.0))), 2)


def value_text(value: Column, kind: DataType) -> Column:
    """Text of a value of any shape: items of arrays, and names and values of structs and maps, by spaces."""
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(value, lambda x: value_text(x, kind.elementType)), " ")
    if isinstance(kind, MapType):
        return F.array_join(F.transform(F.map_entries(value), lambda e: F.concat_ws(" ", e["key"].cast("string"), value_text(e["value"], kind.valueType))), " ")
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.concat_ws(" ", *[F.concat_ws(" ", F.lit(f.name), value_text(value[f.name], f.dataType)) for f in kind.fields]))
    return value.cast("string")


def assisted_confidence(c: Column, default: float = 0.62) -> Column:
    """As confidence; zero counts as not given."""
    return F.when(confidence(c, default) <= 0, default).otherwise(confidence(c, default))


def rate(c: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))), 4)


def clip(c: Column, n: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def eval_normal(c: Column) -> Column:
    """For comparing a value with its label: no commas, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit(","), F.lit(""))), rf"{U}\s+", " "))
