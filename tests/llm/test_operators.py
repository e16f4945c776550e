"""The dealt operators against brute force, on small tables with the odd cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, decontamination, licenses, lm, mixing, near_dup, quality, sharding, substring_dedup, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, score string, spans string, position string"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = make(120), make(30)
    out = [(i, make(r.randint(5, 90)), f"s{i % 3}") for i in range(40)]
    out += [(40 + i, base, "s0") for i in range(15)]
    for i in range(25):
        w = base.split()
        w[r.randrange(len(w))] = f"new{i}"
        out.append((60 + i, " ".join(w), "s0"))
    out += [(90 + i, f"{make(10)} {passage} {make(10)}", "s1") for i in range(6)]
    out += [(100, None, "s1"), (101, "", None), (102, " \n\t ", "s2"), (103, "one", "s2"), (104, "one two", None), (105, "One TWO", "s1"), (106, make(6000), "s2")]
    out += [(107, "Released under the MIT License.", "s1"), (108, "It.\nLicensed under the Apache\nLicense, Version 2.0. And", "s1"), (109, "This program is free. Released under the MIT License, no.", "s1")]
    out += [(110, "x " * 50, "s2"), (-3, "one two", "s0"), (111, "It's <|endoftext|> I'LL 12 ½ ΣΑΣ é", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    data = [(i, t, "en", s, len(t or ""), "a", "b", "c", "d", "e") for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, null everything."""
    data = [(None, "one two three four", None)] * 2 + [(5, "one two three four", "s")] * 2 + [(5, "other text of five words", "s"), (None, None, None), (7, None, "s")]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_mixing(docs, rows, odd, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by, taken, size = defaultdict(int), defaultdict(int), defaultdict(int)
    text = {i: (t, s) for i, t, s in rows}
    for r in got:
        t, s = text[r.doc_id]
        assert r["size"] == len(words(t)) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        by[s] += r["size"]
        taken[s] += r.taken
        size[s] = max(size[s], r["size"])
    names = sorted((s for s in by if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, left, free = {}, 1.5 * sum(by.values()), set(names)
    while True:
        total = sum(weights[s] for s in free)
        capped = {s for s in free if left * weights[s] / total >= 2 * by[s]}
        if not capped:
            goal |= {s: left * weights[s] / total for s in free}
            break
        for s in capped:
            goal[s] = 2.0 * by[s]
            left -= goal[s]
        free -= capped
    for r in got:
        s = text[r.doc_id][1]
        assert r.source_size == by[s] and r.target == pytest.approx(goal[s])
    for s in names:
        assert abs(taken[s] - goal[s]) <= size[s] + 1
    order = [r.position for r in got if r.position is not None]
    assert order == sorted(order)
    assert sorted(map(str, mixing.mix(docs.repartition(2)).collect())) == sorted(map(str, got))
    assert mixing.mix(odd).count() == 7 and mixing.mix(empty).count() == 0
    copies = mixing.repeated(docs)
    assert copies.count() == sum(r.copies for r in got)


@pytest.mark.parametrize("doc_id", ["cast(7 as long)", "cast(null as long)"])
def test_mixing_of_equal_rows(spark, doc_id):
    """Rows that agree in everything outgrow a part and are dealt over several; targets hold as for others."""
    same = spark.range(3000).select(F.expr(doc_id).alias("doc_id"), F.lit("three words here").alias("text"), F.lit("a").alias("source"))
    rest = spark.range(600).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "b").alias("source"))
    rows = same.unionByName(rest)
    got = mixing.mix(rows, rows_per_part=10).collect()
    again = mixing.mix(rows, rows_per_part=10).collect()
    assert len(got) == 3600 and Counter(map(str, got)) == Counter(map(str, again))
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine) + 1
    plain = mixing.mix(rows).collect()
    assert {s: sum(r.taken for r in plain if r.source == s) for s in ("a", "b", None)} == {s: sum(r.taken for r in got if r.source == s) for s in ("a", "b", None)}


def test_mixing_inverts_schedules():
    plan = mixing.ramp(2.0, 0.5)
    assert mixing.integral(plan) == pytest.approx(2.0)
    assert mixing.targets([10, 100, 100], [3, 1, 2], 210, 2) == [20.0, pytest.approx(190 / 3), pytest.approx(380 / 3)]


def test_sharding(docs, rows, odd, empty):
    got = sharding.shard(docs, 8).collect()
    assert len(got) == len(rows)
    slots, fill, where = defaultdict(list), Counter(), defaultdict(set)
    text = {i: t for i, t, _ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        fill[r.shard] += len((text[r.doc_id] or "").encode()) + 16
        where[text[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    largest = max(len((t or "").encode()) + 16 for t in text.values())
    assert max(fill.values()) <= sum(fill.values()) / 8 + largest
    assert sorted(map(str, sharding.shard(docs.repartition(5), 8).collect())) == sorted(map(str, got))
    assert sharding.shard(odd, 3).count() == 7 and sharding.shard(empty, 3).count() == 0


def test_sharding_splits_one_hot_group(spark):
    same = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    fill = sharding.shard(same, 4).groupBy("shard").agg(F.sum(F.length("text") + 16).alias("b")).collect()
    assert len(fill) == 4 and max(r.b for r in fill) < 1.1 * min(r.b for r in fill)


@pytest.mark.parametrize("doc_id", ["cast(7 as long)", "cast(null as long)"])
def test_sharding_splits_equal_rows(spark, doc_id):
    """Rows that no key tells apart: alone, and as a third of a table; wholly equal ones and ones with other columns."""
    same = spark.range(400).select(F.expr(doc_id).alias("doc_id"), F.lit("same text").alias("text"), F.lit("old").alias("shard"), (F.col("id") % 3).alias("other")).repartition(5)
    for t in (same.drop("other"), same):
        got = sharding.shard(t, 8).collect()
        assert sorted(Counter(r.shard for r in got).values()) == [50] * 8
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(50)) for s in range(8))
        if t is same:
            assert sorted(Counter(r.other for r in got).values()) == [133, 133, 134]
    mixed = same.drop("other", "shard").unionByName(spark.range(800).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text")))
    got = sharding.shard(mixed, 8).collect()
    fill = Counter()
    for r in got:
        fill[r.shard] += len(r.text) + 16
    assert len(got) == 1200 and len(fill) == 8 and max(fill.values()) < 1.05 * min(fill.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got).items())
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in mixed.collect())


def test_sharding_query_keeps_its_law(spark, tmp_path):
    import duckdb

    sharding.query(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/out")
    sql = """
    WITH r AS (SELECT * FROM read_parquet('{0}/out/*.parquet')), d AS (SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size FROM '/root/testdata/sf0.001/documents.parquet'),
    s AS (SELECT shard, sum(size) AS b, count(*) AS n, count(DISTINCT slot) AS slots, min(slot) AS lo, max(slot) AS hi FROM r GROUP BY shard)
    SELECT (SELECT count(*) FROM r JOIN d USING (doc_id, size)) = (SELECT count(*) FROM d) AND (SELECT count(*) FROM r) = (SELECT count(*) FROM d),
           (SELECT bool_and(n = slots AND lo = 0 AND hi = n - 1 AND shard BETWEEN 0 AND 39) FROM s),
           (SELECT max(b) - sum(b) / 40 FROM s) <= (SELECT max(size) FROM d),
           (SELECT bool_and(law = 'bytes' AND grown_shard IS NULL) FROM r)
    """.format(tmp_path)
    assert duckdb.sql(sql).fetchall() == [(True, True, True, True)]
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_lm_scores(spark, docs, rows, odd, empty):
    import public_tokenizers

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    shape = lm.Shape(units=128, clusters=8, epochs=1, least=1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in lm.score(docs, ~held, path, shape=shape).collect()}
    train = [(i, t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for _, t in train for w in words(lower(t or "")))
    total, distinct = sum(count.values()) + len(train), len(count) + 1
    for i, t, _ in rows:
        w = words(lower(t or ""))
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [count[x] for x in w] + [len(train)])
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, total)
        assert r.base_score == pytest.approx(base) and math.isfinite(r.score) and r.score < 0
    assert lm.score(empty, F.lit(True), path, shape=shape).count() == 0
    # null ids and repeated rows: train as often as they stand, and rows that outgrow a group are dealt over several
    small = [lm.score(odd, F.lit(None).cast("boolean"), path, shape=shape, group_bytes=n).orderBy("doc_id", "n_tokens").collect() for n in (1 << 24, 30)]
    for got in small:
        assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(None, 1, 1, 28), (None, 5, 5, 28), (None, 5, 5, 28), (5, 5, 5, 28), (5, 5, 5, 28), (5, 6, 6, 28), (7, 1, 1, 28)]
        assert got[1].score == pytest.approx(got[2].score) == pytest.approx(got[3].score)
    none = lm.score(odd, F.lit(False), path, shape=shape).collect()
    assert len(none) == 7 and all(r.n_known == r.train_tokens == 0 and math.isfinite(r.score) for r in none)


def test_lm_beats_counts_on_unseen_texts(spark):
    """Held-out log10 a token of the test table, against add-one counts of words."""
    got = lm.query(spark, "/root/testdata/sf0.01").groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("model"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).collect()
    assert len(got) == 2 and all(r.model > r.base + 0.05 for r in got)


def test_lm_chances_add_up_and_windows_cover(spark):
    import public_tokenizers
    import pyarrow as pa

    shape = lm.Shape(units=16, clusters=4, dim=4, hidden=4, window=6, stride=3, epochs=1, least=1)
    pieces = lm.Pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = lm.train(pa.chunked_array([["a b c a b d e f"] * 9]), pieces, shape)
    hidden = model.forward(np.array([[0, 3, 4, 5, 3, 4]]), np.zeros((1, 6)))[0][0]
    for h in hidden:
        every = model.log10(np.repeat(h[None], 16, axis=0), np.arange(16))
        assert (10**every).sum() == pytest.approx(1, abs=1e-4)
    assert (10 ** model.rare[model.piece_unit == 2]).sum() == pytest.approx(1, abs=1e-6)
    units = np.array([3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 1, 3, 1], np.int32)
    whole = model.score(units, np.array([0, 11, 13]))
    total, before = 0.0, np.r_[0, units[:10]]
    for start in (0, 3, 6, 9):  # a window's last three units, with the three before them in sight
        at = np.arange(start - 3, min(start + 3, 11))
        pad = 6 - len(at)
        ids, text = np.array([*np.where(at < 0, 0, before[at]), *[1] * pad]), np.array([*np.where(at < 0, -1, 0), *[0] * pad])
        state = model.forward(ids[None], text[None])[0][0][: 3 - pad]
        total += model.log10(state, units[start : start + 3 - pad]).sum()
    assert whole[0] == pytest.approx(total, rel=1e-4)
    assert model.score(units[11:], np.array([0, 2]))[0] == pytest.approx(whole[1], rel=1e-5)


def unit_ids(model, pieces, texts):
    """Units of each text."""
    import pyarrow as pa

    data, offsets = lm.text_bytes(pa.chunked_array([texts]))
    start, end, doc = lm.word_bounds(data, offsets)
    _, first, word = np.unique(lm.word_hashes(data, start, end, lower=True), return_index=True, return_inverse=True)
    flat, edge, _ = model.units(data, start, end, first, pieces)
    units, cut = lm.spread(flat, edge, word, doc, len(texts))
    return [tuple(units[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def test_lm_units_tell_word_breaks():
    import public_tokenizers
    import pyarrow as pa

    pieces = lm.Pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = ["un happiness", "unhappiness", "u n happiness", "a bc", "ab c", "abc", "a b c", "12 3", "123", "x$ y", "x $y", "x$y", "it 's", "it's", "é é", "éé"]
    model = lm.train(pa.chunked_array([texts]), pieces, lm.Shape(units=256, clusters=4, dim=4, hidden=4, window=6, stride=3, epochs=1, least=1))
    assert len(set(unit_ids(model, pieces, texts))) == len(texts)
    encode = pieces._code
    for w in ("unhappiness", "x$y", "12½", "家é"):
        assert encode.decode(pieces.ids([w.encode()])[0].tolist()) == " " + w
    r = random.Random(3)
    odd = ["".join(r.choice("abc'sT1½!é家\x85\u00a0\u2003\x1c") for _ in range(r.randint(1, 9))) for _ in range(400)]
    for some in (odd, [w for w in odd if len(w.split()) == 1 and w.split()[0] == w], texts, []):
        some = [w for t in some for w in words(t)]
        ids, lens = pieces.ids([w.encode() for w in some], at_once=50)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [encode.encode_ordinary(" " + w) for w in some] or not some


def test_lm_chunks_hold_every_unit_once():
    import public_tokenizers
    import pyarrow as pa

    pieces = lm.Pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [" ".join(f"w{i % 7}" for i in range(50)), "", None, "one", "Tab\tand\nline  é end"]
    column = pa.chunked_array([texts])
    model = lm.train(column, pieces, lm.Shape(units=64, clusters=4, dim=4, hidden=4, window=6, stride=3, epochs=1, least=1))
    data, offsets = lm.text_bytes(column)
    start, end, doc = lm.word_bounds(data, offsets)
    lines = lm._chunks(data, offsets, start, end, doc, np.ones(5, bool), np.arange(5), 1.0, 4)
    assert len(lines) == 13 + 1 + 1 + 1 + 2
    before, after, run = lm._chunk_units(lines, model, pieces)
    whole = unit_ids(model, pieces, texts)
    assert Counter(zip(before.tolist(), after.tolist(), strict=True)) == Counter(p for u in whole for p in zip((0, *u), u, strict=False))
    assert len(set(run.tolist())) == len(lines) and len(run) == len(after)


def test_lm_learns_from_more_when_there_is_more(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 8))) for _ in range(200)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in [6000] + [40] * 300]
    seen, fitted, outline, fit = [], [], lm._outline, lm._fitted
    monkeypatch.setattr(lm, "_outline", lambda docs, s, shape: seen.append(s) or outline(docs, s, shape))
    monkeypatch.setattr(lm, "_fitted", lambda *a: fitted.append(fit(*a)))
    shape = lm.Shape(units=32, clusters=4, dim=4, hidden=4, window=6, stride=3, epochs=1, least=1, chunk=8)
    for copies in (1, 4):
        data = [(i + 1000 * c, t) for c in range(copies) for i, t in enumerate(texts)]
        d = spark.createDataFrame(data, "doc_id long, text string")
        assert lm.score(d, F.lit(True), path, shape=shape, fit_share=4, fit_bytes=1, part_bytes=4000, group_bytes=20_000).count() == len(data)
        pieces = lm.Pieces(path)
        expected = np.zeros(pieces.size)
        for w, c in Counter(w for _, t in data for w in words(t)).items():
            np.add.at(expected, pieces.ids([w.encode()])[0], c)
        assert (seen[-1] == expected).all()
    assert 3 < fitted[1] / fitted[0] < 5


def test_lm_gradient():
    import public_tokenizers
    import pyarrow as pa

    shape = lm.Shape(units=16, clusters=4, dim=4, hidden=5, window=6, stride=4, epochs=1, least=1)
    model = lm.train(pa.chunked_array([["a b c a b d e f"] * 9]), lm.Pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), shape)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    ids, text = np.array([[0, 9, 8, 9, 10, 3], [4, 5, 0, 7, 3, 3]]), np.array([[1, 1, 1, 1, 1, 1], [1, 1, 2, 2, 2, 2]])
    target, counts = np.array([[8, 9, 10, 3], [7, 3, 3, 1]]), np.array([[1, 1, 1, 1], [1, 1, 1, 0]], bool)
    grad = lm._gradient(model, ids, text, target, counts)

    def loss():
        total = 0.0
        for h, t, real in zip(model.forward(ids, text)[0].reshape(-1, 4), target.ravel(), counts.ravel(), strict=True):
            k = model.cluster[t]
            a, b = model.w["cluster"] @ h + model.w["cluster_b"], model.w["unit"][k] @ h + model.w["unit_b"][k]
            total -= real * (a[k] - np.log(np.exp(a).sum()) + b[model.within[t]] - np.log(np.exp(b).sum()))
        return total / counts.sum()

    assert set(grad) == set(model.w)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-5
        up = loss()
        model.w[name][at] = old - 1e-5
        down = loss()
        model.w[name][at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=2e-3, abs=1e-6), name


def test_groups_have_a_partition_each(spark):
    from quire.llm import common

    n = 37
    names = spark.createDataFrame([(int(x),) for x in common.lanes(n)], "x int")
    assert [r[0] for r in names.select(F.pmod(F.hash("x"), F.lit(n))).collect()] == list(range(n))


def test_licenses(docs, odd, empty):
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}
    assert got.pop(107) == ["MIT"] and got.pop(108) == ["Apache-2.0"]
    assert not any(got.values())
    assert licenses.scan_licenses(odd).count() == 7 and licenses.scan_licenses(empty).count() == 0


def test_licenses_need_the_whole_rule_in_order(spark):
    s = licenses.SENTENCES
    mit = [s[x] for x in ("mit-grant", "mit-keep", "mit-as-is", "mit-liable")]
    bsd = [s[x] for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    texts = [". ".join(mit).upper() + ".", ". ".join(mit[::-1]), ". ".join(mit[:3]), ":\n\n".join(bsd), ". ".join(bsd[:3]), bsd[0] + ":\n 1. " + bsd[1] + ";\n 2. " + bsd[2] + "."]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == [["MIT"], [], [], ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"], ["BSD-2-Clause"]]


WRAPPED = {
    "Apache-2.0": """   Copyright 2020 Some One

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "CC-BY-4.0": "My Notes\n\nThis work is licensed under a Creative Commons Attribution 4.0\nInternational License.\n",
    "CC-BY-NC-4.0": "My Notes\n\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.\n",
    "CC-BY-SA-4.0": "My Notes\n\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.\n",
    "CC0-1.0": "My Notes\n\nLicensed under\nCC0 1.0\n\nSome One",
    "GPL-2.0-or-later": """Copyright (C) 2020  Some One

    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "GPL-3.0-only": "My Notes\n\nThis work is licensed under the GNU General Public\nLicense, version 3.\n",
    "GPL-3.0-or-later": """/*
 * Copyright (C) 2020  Some One
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 */
""",
    "ISC": """ISC License

Copyright (c) 2004-2010 by Internet Systems Consortium, Inc. ("ISC")

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS.
""",
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
""",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"].replace("2-Clause", "3-Clause").replace(
    "\nTHIS SOFTWARE",
    """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE""",
)


def test_licenses_of_wrapped_texts(spark):
    assert set(WRAPPED) == set(licenses.RULES)
    data = [(n, e.join(t.split("\n"))) for n, t in WRAPPED.items() for e in ("\n", "\r\n")]
    got = [(r.name, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(data, "name string, text string")).collect()]
    assert len(got) == 28
    assert got == [(n, ["BSD-2-Clause", n] if n == "BSD-3-Clause" else [n]) for n, _ in got]


def brute_groups(rows, width, percent):
    sets = {}
    for i, t, _ in rows:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, width, percent):
    got = near_dup.near_duplicates(docs, width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(rows, width, percent)
    kept = near_dup.dedupe(docs, width=width, percent=percent)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in brute_groups(rows, width, percent).items() if v[2]}


def test_near_duplicates_odd_tables(odd, empty):
    got = near_dup.near_duplicates(odd, width=3, percent=85).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles == 2} == {(None, 5), (5, 5)}
    assert sorted(str(r.doc_id) for r in near_dup.dedupe(odd, width=3, percent=85).collect()) == ["5", "5", "7", "None"]
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.dedupe(empty).count() == 0


def test_near_duplicate_chain(spark):
    """Each text is near the next alone: one component without a common leader."""
    w = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 100]), "") for i in range(11)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"), width=3, percent=85).collect()
    assert {r.component_id for r in got} == {0}


def test_circulant_signatures_estimate_jaccard():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(7919), np.arange(200, 1200, dtype=np.uint64) * np.uint64(7919)
    s = near_dup.signatures([a, b], 512)
    assert (s[0] == s[1]).mean() == pytest.approx(800 / 1200, abs=0.08)


def test_token_counts(docs, rows, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in tokens.count_tokens(docs, path).collect()}
    for i, text, _ in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 2048)
    assert tokens.count_tokens(odd, path).count() == 7 and tokens.count_tokens(empty, path).count() == 0


def test_token_counts_of_odd_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), tokens.TokenCounter(path)
    r = random.Random(1)
    texts = ["a" * 3000, "ab" * 999, "<|startoftext|><|endoftext|>", "x<|endoftext|>y", "\x1c\x1d \x85 　", "ｶﾞ é ΣΑΣ İ", "👩‍👩‍👧 家", "a b " * 300_000]
    texts += ["".join(r.choice("abé 'sT1½!<|>\n\t家Σ") for _ in range(60)) for _ in range(300)]
    assert c.count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ann_recall_and_ties(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16)).astype(np.float32)
    x[200:300] = x[7]
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 3, 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for q in ann.search(v, v.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    right = total = 0
    y = x.astype(float)
    assert set(got) == set(range(0, 600, 20))
    for i in got:
        s = y @ y[i]
        best = sorted((-s[j], j) for j in range(600) if j != i)[:20]
        assert len(got[i]) == 20 and all(b == pytest.approx(s[a]) for a, b in got[i])
        assert got[i] == sorted(got[i], key=lambda z: (-z[1], z[0]))
        right += len({j for _, j in best} & {a for a, _ in got[i]})
        total += 20
    assert right / total >= 0.9
    assert ann.search(v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id in (0, 1, 2)")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 2


def test_ann_recall_in_a_dense_group(spark):
    """A third of the rows within 1 % of each other, more of them in a part than are ranked exactly at first."""
    r = np.random.default_rng(6)
    x = r.standard_normal((9000, 32))
    x[:3000] = x[0] / np.linalg.norm(x[0]) + 0.01 / math.sqrt(32) * r.standard_normal((3000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for q in ann.search(v, v.filter("vec_id < 3000 and vec_id % 100 = 0"), cells=4, probes=4).collect():
        got[q.query_id].add(q.vec_id)
    y, right = x.astype(float), 0
    for i in range(0, 3000, 100):
        s = y @ y[i]
        s[i] = -np.inf
        right += len(set(np.argsort(-s)[:20].tolist()) & got[i])
    assert len(got) == 30 and right >= 0.99 * 600


def test_ann_gives_k_whenever_there_are_candidates(spark):
    """Cells that one probe misses hold nearly all vectors; many blocks of queries and parts of few rows give the same."""
    x = np.random.default_rng(1).standard_normal((100, 16))
    x[8:] = x[8]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    for options in ({"probes": 1}, {"probes": 1, "cells": 5}, {"cells": 5, "probes": 5, "part_rows": 2, "block_rows": 10}):
        got = defaultdict(list)
        for r in ann.search(v, v.filter("vec_id < 50"), **options).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id))
        assert len(got) == 50 and all([a for a, _ in g] == list(range(1, 21)) for g in got.values())
    for i in range(50):  # all cells visited: exact
        s = np.round(x @ x[i], 9)
        assert [j for _, j in got[i]] == sorted((j for j in range(100) if j != i), key=lambda j: (-s[j], j))[:20]
    twice = v.filter("vec_id < 30").unionByName(spark.createDataFrame([(0, (-x[2]).tolist()), (3, x[3].tolist())], "vec_id long, embedding array<double>"))
    got = ann.search(twice, twice.filter("vec_id = 0"), probes=1).collect()
    assert len(got) == 20 and all(r.vec_id != 0 for r in got)
    with pytest.raises(ValueError):
        ann.search(v.withColumn("vec_id", F.col("vec_id").cast("string")), v)


def test_ann_recall_on_the_test_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), float)
    got, right = defaultdict(list), 0
    for r in ann.query(spark, "/root/testdata/sf0.01").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(got) == {ids[i] for i in asked} and all(len(g) == 20 for g in got.values())
    place = {int(v): i for i, v in enumerate(ids)}
    for i in asked:
        s = x @ x[i]
        assert all(c == pytest.approx(s[place[b]], abs=1e-12) for _, b, c in got[ids[i]])
        s[i] = -np.inf
        right += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & {b for _, b, _ in got[ids[i]]})
    assert right >= 0.95 * 20 * len(asked)


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, rows, odd, empty):
    r = random.Random(9)
    items = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(25))) for i in range(6)] + [(7, None), (8, ""), (9, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    dirty, expected = [], {}
    for n in range(60):
        k, text = r.choice(items[:6])
        s = list(text)
        for _ in range(r.randint(0, len(text) // 7)):
            p = r.randrange(len(s))
            s[p : p + 1] = r.choice([["z"], [], [s[p], "z"]])
        made = "prefix words here " + "".join(s) + " suffix\nwords"
        dirty.append((n, made))
        expected[n] = {j for j, t in items[:6] if edit_distance_within(t, made.replace("\n", " ")) <= int(0.1 * len(t))}
    got = {x.doc_id: {s.item_id for s in x.spans} for x in decontamination.find_items(spark.createDataFrame(dirty, "doc_id long, text string"), bench).collect()}
    assert got == expected and any(expected.values()) and not all(expected.values())
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert decontamination.find_items(odd, bench).count() == 7 and decontamination.find_items(empty, bench).count() == 0
    assert decontamination.find_items(docs, bench.limit(0)).filter(F.size("spans") > 0).count() == 0
    whole = decontamination.find_items(spark.createDataFrame(dirty, "doc_id long, text string"), bench)
    for size in (450, 300, 60):  # some blocks of two or three items, then of one
        small = decontamination.find_items(spark.createDataFrame(dirty, "doc_id long, text string"), bench, block_bytes=size)
        assert sorted(map(str, small.collect())) == sorted(map(str, whole.collect()))
    named = decontamination.find_items(spark.createDataFrame(dirty, "doc_id long, text string"), bench.withColumn("item_id", F.concat(F.lit("item "), "item_id")), block_bytes=300)
    assert {x.doc_id: {int(s.item_id[5:]) for s in x.spans} for x in named.collect()} == expected


def test_banded_alignment():
    r = random.Random(12)
    for _ in range(400):
        item = [r.randrange(3) for _ in range(r.randint(1, 12))]
        text = [r.randrange(3) for _ in range(r.randint(0, 20))]
        low, width, k = r.randint(-6, 12), r.randint(1, 9), r.randint(0, 5)
        best = None
        cost = {(0, j): 0 for j in range(len(text) + 1) if low <= j < low + width}
        for i in range(1, len(item) + 1):
            for j in range(max(0, i + low), min(len(text), i + low + width - 1) + 1):
                ways = [cost[i - 1, j - 1] + (item[i - 1] != text[j - 1])] if (i - 1, j - 1) in cost else []
                ways += [cost[x] + 1 for x in ((i - 1, j), (i, j - 1)) if x in cost]
                if ways:
                    cost[i, j] = min(ways)
        best = min((c for (i, _), c in cost.items() if i == len(item)), default=None)
        got = decontamination.align(np.array(item, np.uint8), np.array(text, np.uint8), low, width, k)
        if got is None:
            assert best is None or best > k or not text
        else:
            assert got[0] == best <= k and edit_distance_within(item, text[got[1] : got[2]]) <= best and 0 <= got[1] <= got[2] <= len(text)


def test_short_items_match_whole_words(spark):
    bench = spark.createDataFrame([(1, "art"), (2, "artful dodger"), (3, "é"), (4, "家")], "item_id long, text string")
    texts = ["start", "starting an artful dodgers", "the start of Art.", "parts art3", "“art”", "an artful dodgers, artful dodger", "café", "a é b", "国家人", "art", "xartful dodger", "arté éart", ""]
    got = decontamination.find_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    found = {r.doc_id: {s.item_id for s in r.spans} for r in got}
    assert found == {0: set(), 1: set(), 2: {1}, 3: set(), 4: {1}, 5: {2}, 6: set(), 7: {3}, 8: {4}, 9: {1}, 10: set(), 11: set(), 12: set()}
    assert [(s.item_id, s.start, s.end) for r in got if r.doc_id in (2, 5) for s in r.spans] == [(1, 13, 16), (2, 19, 32)]


def brute_substrings(rows, window):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [20, 7])
def test_substrings(docs, rows, window):
    got = substring_dedup.dedupe_substrings(docs, window=window, group_bytes=4000, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substrings(rows, window)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed


@pytest.mark.parametrize("group_bytes", [1 << 24, 30])
def test_substrings_odd_tables(odd, empty, group_bytes):
    """With 30 bytes a group, equal rows outgrow one and are dealt over several."""
    got = substring_dedup.dedupe_substrings(odd, window=4, group_bytes=group_bytes).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("5", 0), ("5", 0), ("5", 0), ("7", 0), ("None", 0), ("None", 4), ("None", 4)]
    assert substring_dedup.dedupe_substrings(empty).count() == 0


def test_quality(spark, docs, rows, odd, empty):
    r = random.Random(3)
    good = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(40))
    bad = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) + "$$$" for _ in range(40))
    data = [(i, good() if i % 3 else bad()) for i in range(400)]
    d = spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 3 > 0), 0) for i in range(300)), (5, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(d, quality.fit(d, labels)).collect()}
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in range(300, 400)]) > 0.97
    assert 0 <= got[900].score == got[901].score <= 1
    part = quality.fit(d, labels)
    assert quality.score(docs, part).count() == len(rows) and quality.score(odd, part).count() == 7 and quality.score(empty, part).count() == 0
    assert {x.score for x in quality.score(odd, quality.fit(d, labels.limit(0))).collect()} == {0.5}


def test_pipeline(spark, tmp_path):
    import shutil

    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sharding":
            assert kept.columns == docs.columns
        if name == "near_dup":
            rows = [(r.doc_id, r.text, "") for r in before.collect()]
            assert {r.doc_id for r in kept.collect()} == {i for i, v in brute_groups(rows, 5, 80).items() if v[2]}
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, ran.select(sorted(ran.columns)).collect())) == sorted(map(str, kept.select(sorted(ran.columns)).collect()))


def test_quality_learns_in_a_task(spark, monkeypatch):
    """Training's memory isn't the driver's."""
    d = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    here = os.getpid()
    monkeypatch.setattr(quality, "train", lambda texts, marks, shape: np.array([float(os.getpid() == here), len(texts), sum(marks)]))
    assert quality.fit(d, labels).tolist() == [0.0, 20.0, 10.0]


def test_lm_learns_from_every_unit(spark, monkeypatch):
    """Clusters and weights come from all training texts, of any size, and packed chunks come out as they went in."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    pieces, fitted, fit = lm.Pieces(path), [], lm._fitted
    monkeypatch.setattr(lm, "_fitted", lambda *a: fitted.append(fit(*a)))
    r = random.Random(5)
    texts = [" ".join(r.choice(["alpha", "béta", "gamma", "x1", "delta"]) for _ in range(n)) for n in [0, 1, 900] + [37] * 60]
    shape = lm.Shape(units=32, clusters=4, dim=4, hidden=4, window=6, stride=3, epochs=3, least=1, enough=1, chunk=8)
    d = spark.createDataFrame([(i, t, i % 5 > 0) for i, t in enumerate(texts)], "doc_id long, text string, learned boolean")
    assert lm.score(d, F.col("learned"), path, shape=shape, fit_bytes=1, part_bytes=700, group_bytes=4000).count() == len(texts)
    assert fitted == [sum(sum(len(pieces.ids([w.encode()])[0]) for w in words(t)) + 1 for i, t in enumerate(texts) if i % 5)]
    model = lm.train(pa.chunked_array([texts]), pieces, shape)
    data, offsets = lm.text_bytes(pa.chunked_array([texts]))
    lines = lm._chunks(data, offsets, *lm.word_bounds(data, offsets), np.ones(len(texts), bool), np.arange(len(texts)), 1.0, 8)
    rows = [tuple(x) for x in lm._packed(lines, model, pieces)]
    assert len(rows) == 8
    for got, want in zip(lm._unpacked(rows, shape)[:2], lm._chunk_units(lines, model, pieces)[:2], strict=True):
        assert got.tolist() == want.tolist()
    assert lm._rounds(lm.Shape(), 100_000_000) == (9, 3) and lm._rounds(lm.Shape(), 1_000_000) == (6, 1)
