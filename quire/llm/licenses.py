"""Licence scans by sentence rules, with DataFrame functions alone.

Texts are cut into sentences, once with a line end as a sentence's end, once with line ends as spaces
(licence texts are often wrapped), and once with blank lines alone as ends (titles and copyright lines have
no full stop).  A normalised sentence (lower case, letters and digits, single spaces) that is known has an
identifier.  The identifiers of a document, in order, are matched against rules, each an ordered run of
identifiers.  ``PIECES`` holds what the cutting makes of sentences with a colon, semicolon or full stop inside.

Defined cases: a null or empty text has no sentences and no licence; repeated rows and null ids come
back as they are; an empty table gives no rows; other columns pass through, and a column named like an
output gives way.  Whole texts are scanned, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of the usual notices, normalised.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy-at": "you may obtain a copy of the license at",
    "apache-url": "http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-title-short": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-short": "licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-notice": "licensed under cc0 1 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# SPDX names and the ordered runs of sentences that show them.
RULES = {
    "Apache-2.0": [["apache-notice"], ["apache-notice-the", "apache-may-not"], ["apache-as-is", "apache-see"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]],
    "CC-BY-4.0": [["cc-by-notice"], ["cc-by-work"]],
    "CC-BY-NC-4.0": [["cc-by-nc-notice"], ["cc-by-nc-work"]],
    "CC-BY-SA-4.0": [["cc-by-sa-notice"], ["cc-by-sa-work"]],
    "CC0-1.0": [["cc0-notice"]],
    "GPL-2.0-or-later": [["gpl2-free", "gpl-hope", "gpl-see"]],
    "GPL-3.0-only": [["gpl3-notice"], ["gpl3-notice-short"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-hope", "gpl-see"]],
    "ISC": [["isc-grant", "isc-as-is"]],
    "MIT": [["mit-notice"], ["mit-notice-licensed"], ["mit-grant", "mit-keep", "mit-as-is", "mit-liable"]],
    "MPL-2.0": [["mpl-subject"]],
    "Unlicense": [["unlicense-free", "unlicense-anyone"]],
}
# Sentences that the cutting makes of the notices of the GPL and MPL, and a second form of the ISC's; not in the SQL.
PIECES = {
    "gpl-free-head": "this program is free software",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-either-2": "either version 2 of the license or at your option any later version",
    "gpl-either-3": "either version 3 of the license or at your option any later version",
    "gpl-terms-2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-terms-3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope-head": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-hope-rest": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl-subject-head": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-version": "2 0",
    "isc-as-is-isc": "the software is provided as is and isc disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
}
_GPL_REST = ["gpl-hope-head", "gpl-hope-rest", "gpl-see"]
PIECE_RULES = {
    "GPL-2.0-or-later": [["gpl-free-head", "gpl-terms", "gpl-either-2", *_GPL_REST], ["gpl-free-head", "gpl-terms-2", *_GPL_REST]],
    "GPL-3.0-or-later": [["gpl-free-head", "gpl-terms", "gpl-either-3", *_GPL_REST], ["gpl-free-head", "gpl-terms-3", *_GPL_REST]],
    "ISC": [["isc-grant", "isc-as-is-isc"]],
    "MPL-2.0": [["mpl-subject-head", "mpl-version"]],
}
_NUMBER = {name: i + 1 for i, name in enumerate(SENTENCES | PIECES)}
_BREAK, _LIST_MARK = r"[.!?:;]+(?:\s+|$)", r"(?m)^\s*(?:[0-9]{1,2}[.)]|[*-])\s+"
_BLANK = r"\n(?:[^a-z0-9\n]*\n)+"


def _runs(lines: Column) -> Column:
    """',3,4,0,7,': the identifiers of normalised sentences, 0 for one that isn't known."""
    known = F.create_map(*[F.lit(x) for name, s in (SENTENCES | PIECES).items() for x in (s, str(_NUMBER[name]))])
    return F.concat(F.lit(","), F.array_join(F.transform(lines, lambda s: F.coalesce(F.try_element_at(known, F.trim(s)), F.lit("0"))), ","), F.lit(","))


def _found(runs: list[Column], rules: list[list[str]]) -> Column:
    out = F.lit(False)
    for rule in rules:
        for r in runs:
            out = out | r.contains("," + ",".join(str(_NUMBER[x]) for x in rule) + ",")
    return out


def _plain(text: Column) -> Column:
    """Lower-case letters and digits, with line ends and a bar where a sentence ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _LIST_MARK, "\n"), _BREAK, "|"), r"[^a-z0-9\n|]+", " ")


def _unwrapped(plain: Column) -> Column:
    return _runs(F.split(F.regexp_replace(plain, r"[\n ]+", " "), r"\|[| ]*"))


def scan_licenses(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All rows with licenses (sorted SPDX names), n_license_sentences and has_license."""
    docs = docs.drop(*[c for c in ("licenses", "n_license_sentences", "has_license") if c in docs.columns])
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    out = docs.withColumn("_quire_plain", _plain(text)).withColumn("_quire_lines", _runs(F.split("_quire_plain", r"[\n|][\n| ]*")))
    out = out.withColumn("_quire_wrapped", _unwrapped(F.col("_quire_plain")))
    # without a blank line the paragraphs are what is wrapped
    out = out.withColumn("_quire_paragraphs", F.when(text.rlike(_BLANK), _unwrapped(_plain(F.regexp_replace(text, _BLANK, "|\n")))).otherwise(F.lit("")))
    runs = [F.col("_quire_lines"), F.col("_quire_wrapped"), F.col("_quire_paragraphs")]
    names = F.filter(F.array(*[F.when(_found(runs, r + PIECE_RULES.get(name, [])), F.lit(name)) for name, r in RULES.items()]), lambda x: x.isNotNull())
    n = F.greatest(*[F.regexp_count(r, F.lit("[1-9][0-9]*")) for r in runs])
    return out.withColumns({"licenses": names, "n_license_sentences": n, "has_license": F.size(names) > 0}).drop("_quire_plain", "_quire_lines", "_quire_wrapped", "_quire_paragraphs")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the licences that each document names or carries."""
    docs = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_license_sentences", "has_license")


def _sql() -> str:
    known = ", ".join(f"'{s}': '{_NUMBER[n]}'" for n, s in SENTENCES.items())
    runs = {"a": r"regexp_split_to_array(p, '[\n|][\n| ]*')", "b": r"regexp_split_to_array(regexp_replace(p, '[\n ]+', ' ', 'g'), '\|[| ]*')"}
    cols = ", ".join(f"concat(',', array_to_string(list_transform({x}, lambda s: coalesce(m[trim(s)], '0')), ','), ',') AS {k}" for k, x in runs.items())
    named = ", ".join("CASE WHEN " + " OR ".join(f"contains({k}, ',{','.join(str(_NUMBER[x]) for x in r)},')" for r in rules for k in "ab") + f" THEN '{name}' END" for name, rules in RULES.items())
    return rf"""
WITH k AS (SELECT MAP {{{known}}} AS m),
p AS (SELECT doc_id, m, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{_LIST_MARK}', e'\n', 'g'), '[.!?:;]+(?:\s+|$)', '|', 'g'), '[^a-z0-9\n|]+', ' ', 'g') AS p FROM documents, k),
r AS (SELECT doc_id, {cols} FROM p),
n AS (SELECT doc_id, list_filter([{named}], lambda x: x IS NOT NULL) AS l, greatest(len(regexp_extract_all(a, '[1-9][0-9]*')), len(regexp_extract_all(b, '[1-9][0-9]*')))::INT AS n FROM r)
SELECT doc_id, array_to_string(l, ',') AS licenses, n AS n_license_sentences, len(l) > 0 AS has_license FROM n
"""


SQL = _sql()
