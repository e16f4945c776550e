"""Recognised documents and texts with known results."""

import decimal
import json

import pytest
from pyspark.sql import functions as F

from quire.functions import lexicon as L
from quire.functions import text as X
from quire.functions.kernels import clusters, nearest_rank
from quire.operators import answers as A
from quire.operators import fields as E
from quire.operators import keyvalue as K
from quire.operators import layout as Y
from quire.operators import monitoring as M
from quire.operators import pages as P
from quire.operators import pairing
from quire.operators import reading as R
from quire.operators import tables as T
from quire.operators.classify import classify
from quire.plans import pipeline, registry
from quire.sources import adapters, assist, datasets, sinks, synthetic
from quire.streaming import monitor


def line(text, x1, y1, x2, y2, split=True):
    words = text.split(" ") if split else [text]
    w = (x2 - x1) / len(words)
    return {"geometry": {"x1": x1, "y1": y1, "x2": x2, "y2": y2}, "words": [{"value": t, "confidence": 0.95, "geometry": {"x1": x1 + i * w, "y1": y1, "x2": x1 + i * w + w * 0.85, "y2": y2}} for i, t in enumerate(words)]}


def document(spark, lines, doc_id=1):
    pages = [{"dimensions": {"height": 1000.0, "width": 1000.0}, "blocks": [{"lines": lines}]}]
    return spark.createDataFrame([(json.dumps({"doc_id": doc_id, "pages": pages}),)], "j string").select(F.from_json("j", datasets.DOCUMENT).alias("d")).select("d.*")


def analysed(spark, text):
    return pipeline.analyze_text(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def fields_of(spark, text):
    row = analysed(spark, text).first()
    return row.document_type, {x.field_name: x.f for x in row.fields}, row


def test_invoice_fields(spark):
    kind, f, _ = fields_of(spark, "HOA DON VAT\nSo: HD-00123\nNgay 10/06/2026\nMST: 0312345678\nTong tien thanh toan: 1.250.000 VND\nbilling@example.com")
    assert kind == "invoice"
    assert f["invoice_number"].value == "HD-00123" and f["tax_codes"]["values"] == ["0312345678"]
    assert f["primary_date"].value == "10/06/2026" and f["total_amount"].number == 1250000 and f["total_amount"].value == "1250000"
    assert f["emails"]["values"] == ["billing@example.com"]


def test_mentions_are_not_invoices(spark):
    kind, f, row = fields_of(spark, "Status report\nNo: ABC123\nTotal participants: 1,000")
    assert kind == "general_document" and "invoice_number" not in f and "total_amount" not in f and not row.warnings
    assert fields_of(spark, "We process invoices, receipts and bank statements every day.")[0] == "general_document"


def test_local_invoice(spark):
    text = "HÓA ĐƠN GIÁ TRỊ GIA TĂNG\nMẫu số: 01GTKT0/001\nKý hiệu: AA/26E\nSố hóa đơn: 0000123\nĐơn vị bán hàng: Công ty A\nHọ tên người mua hàng: Nguyễn Văn B\nHình thức thanh toán: TM/CK\nMã số thuế: 0312345678\nTổng cộng tiền thanh toán: 2.227.000"
    kind, f, _ = fields_of(spark, text)
    assert kind == "invoice" and f["invoice_form"].value == "01GTKT0/001" and f["invoice_symbol"].value == "AA/26E" and f["invoice_number"].value == "0000123"
    assert f["buyer"].value == "Nguyễn Văn B" and f["seller"].value == "Công ty A" and f["payment_method"].value == "TM/CK" and f["total_amount"].number == 2227000


def test_value_on_the_next_line(spark):
    _, f, _ = fields_of(spark, "HOA DON\nNguoi mua hang:\nTran Thi C\nMa so thue: 0312345678")
    assert f["buyer"].value == "Tran Thi C"


def test_answers(spark):
    a = analysed(spark, "Bien lai\nTong cong: 300,000 VND\nReference Code\nZX-42").withColumn("doc_id", F.lit(1).cast("long"))
    q = spark.createDataFrame([(1, 1, "Tong tien la bao nhieu?"), (2, 1, "What is the reference code?"), (3, 1, "summary"), (4, 1, "zzz")], "question_id int, doc_id long, question string")
    got = {r.question_id: r for r in pipeline.answer_questions(a, q).collect()}
    assert "300" in got[1].answer and got[2].answer == "ZX-42" and got[2].matched_field == "generic_kv"
    assert got[3].matched_field == "summary" and got[4].matched_field is None


def test_pairs_from_lines(spark):
    p = {x.label: x for x in analysed(spark, "Reference Code\nZX-42\nPrepared By\nLan").first().pairs}
    assert p["Reference Code"].value == "ZX-42" and p["Prepared By"].value == "Lan"
    block = analysed(spark, "Bill To\nMs. Mary D. Dunton\n12 Main Street\nShip To\nElsewhere").first().pairs[0]
    assert block.canonical == "buyer" and block.display == "Ms. Mary D. Dunton" and block.value.endswith("12 Main Street")


TABLE = [
    line("#", 0.05, 0.2, 0.065, 0.214), line("Item & Description", 0.11, 0.2, 0.3, 0.214), line("Qty", 0.52, 0.2, 0.56, 0.214), line("Rate", 0.64, 0.2, 0.69, 0.214), line("Amount", 0.8, 0.2, 0.88, 0.214),
    line("1", 0.05, 0.25, 0.065, 0.264), line("Camera", 0.11, 0.25, 0.2, 0.264), line("1.00", 0.52, 0.25, 0.56, 0.264), line("$ 899.00", 0.64, 0.25, 0.7, 0.264), line("899.00", 0.8, 0.25, 0.86, 0.264), line("DSLR camera", 0.11, 0.27, 0.3, 0.284),
    line("2", 0.05, 0.32, 0.065, 0.334), line("Tripod", 0.11, 0.32, 0.2, 0.334), line("2.00", 0.52, 0.32, 0.56, 0.334), line("$20.00", 0.64, 0.32, 0.7, 0.334), line("40.00", 0.8, 0.32, 0.86, 0.334),
    line("Sub Total", 0.64, 0.4, 0.74, 0.414), line("939.00", 0.8, 0.4, 0.86, 0.414),
]


def test_table(spark):
    t = T.extract_tables(P.pages(document(spark, TABLE))).first()
    assert t.headers == ["#", "Item & Description", "Qty", "Rate", "Amount"]
    assert t.rows == [["1", "Camera DSLR camera", "1.00", "$899.00", "899.00"], ["2", "Tripod", "2.00", "$20.00", "40.00"]]
    local = [line(x, a, 0.2, b, 0.214) for x, a, b in (("STT", 0.05, 0.09), ("Tên hàng hóa", 0.11, 0.3), ("Số lượng", 0.52, 0.6), ("Thành tiền", 0.8, 0.9))]
    rows = [line("1", 0.05, 0.25, 0.065, 0.264), line("Bàn", 0.11, 0.25, 0.2, 0.264), line("3", 0.52, 0.25, 0.54, 0.264), line("90.000", 0.8, 0.25, 0.86, 0.264)]
    t = T.extract_tables(P.pages(document(spark, local + rows))).first()
    assert t.headers == ["STT", "Tên hàng hóa, dịch vụ", "Số lượng", "Thành tiền"] and t.rows == [["1", "Bàn", "3", "90.000"]]


def test_layout(spark):
    lines = [line("INVOICE", 0.4, 0.04, 0.52, 0.08), *TABLE, line("Authorized signature", 0.6, 0.7, 0.8, 0.714), line("Page 1", 0.45, 0.95, 0.5, 0.964)]
    r = {x.type: x for x in Y.regions(P.pages(document(spark, lines))).collect()}
    assert {"title", "table", "total", "signature", "footer"} <= set(r) and "Camera" in r["table"].text and r["title"].confidence == 0.78


def test_reading_order(spark):
    lines = [line("second row", 0.1, 0.3, 0.3, 0.32), line("right part", 0.5, 0.1, 0.7, 0.12), line("left part", 0.1, 0.1, 0.3, 0.12)]
    p = P.reading_order(P.pages(document(spark, lines)))
    assert P.document_text(p).first().text == "left part right part\nsecond row"
    b = P.boxes(p).orderBy(F.col("id").cast("int")).collect()
    assert [x.label for x in b] == ["left part", "right part", "second row"] and b[0].id == "1"


def test_all_rows_are_spaced_by_their_gaps(spark):
    lines = [line("second row", 0.1, 0.3, 0.3, 0.32), line("right part", 0.5, 0.1, 0.7, 0.12), line("left part", 0.1, 0.1, 0.3, 0.12)]
    p = P.reading_order(P.pages(document(spark, lines)))
    # words are 0.085 wide; 0.215 lies between left and right: more than 2.2 widths, two spaces
    assert P.spaced_rows(p).first().text == "left part  right part\nsecond row"
    assert P.spaced_rows(P.reading_order(P.pages(document(spark, [])))).first().text == ""


def test_row_spacing_has_every_word_of_the_page(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.text for r in registry.QUERIES["row_spacing_text"](spark, sf).collect()}
    words = synthetic.ocr_words(spark, sf).groupBy("doc_id").agg(F.collect_list("text").alias("w"), F.countDistinct("y1").alias("rows")).collect()
    assert len(got) == len(words) and all(sorted(got[r.doc_id].split()) == sorted(r.w) and len(got[r.doc_id].split("\n")) == r.rows for r in words)
    assert any("  " in t for t in got.values())


def test_page_pairs_by_row(spark):
    lines = [line("Invoice Number", 0.6, 0.1, 0.75, 0.114), line("INV-7", 0.8, 0.1, 0.88, 0.114), line("Bill To", 0.06, 0.2, 0.13, 0.214), line("Company Name", 0.06, 0.23, 0.2, 0.244), line("Street 1", 0.06, 0.25, 0.2, 0.264)]
    p = K.page_pairs(P.pages(document(spark, lines))).first().pairs
    got = {(x.label, x.source): x for x in p}
    assert got["Invoice Number", "layout:same_row"].value == "INV-7"
    assert got["Bill To", "section:next_lines"].value == "Company Name\nStreet 1"


def test_empty_documents(spark):
    assert P.pages(spark.createDataFrame([], datasets.DOCUMENT)).count() == 0
    kind, f, row = fields_of(spark, "")
    assert kind == "general_document" and not f and [w.type for w in row.warnings] == ["empty_text"]
    assert pipeline.analyze_text(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().document_type == "general_document"
    bare = {"geometry": None, "words": [{"value": "alone", "confidence": None, "geometry": None}]}
    p = P.reading_order(P.pages(document(spark, [bare])))
    assert P.document_text(p).first().text == "alone" and P.boxes(p).count() == 0 and P.raw_boxes(p).first().width == 100.0


def test_model_merges(spark):
    kinds = spark.createDataFrame([(1, "invoice")], "doc_id long, document_type string")
    row = "doc_id long, field_name string, value string, confidence double, source string"
    old = spark.createDataFrame([(1, "total_amount", "19191", 0.55, "regex:largest_amount"), (1, "buyer", "X Ltd", 0.7, "line:buyer")], row)
    new = spark.createDataFrame([(1, "primary_date", "1", 0.9, "layoutxlm:date"), (1, "seller_address", "456", 0.9, "layoutxlm:address"), (1, "buyer", "Y Ltd", 0.9, "layoutxlm:company")], row)
    merged, bad = A.merge_model(old, new, kinds)
    assert {r.field_name: r.rejection_reason for r in bad.collect()} == {"primary_date": "invalid_date_format", "seller_address": "too_short_or_numeric"}
    assert {r.field_name: r.value for r in merged.collect()}["buyer"] == "Y Ltd"
    llm = spark.createDataFrame([(1, "Total amount", "154.06", "0", None, 1), (1, "custom-reference", "ZX-42", None, None, 2)], "doc_id long, field_name string, value string, confidence string, source string, ord int")
    got = {r.field_name: r for r in A.merge_assisted(old, llm, kinds).collect()}
    assert got["total_amount"].value == "154.06" and got["total_amount"].confidence == 0.62 and got["custom_reference"].value == "ZX-42"


def test_scalars(spark):
    amounts = {"1.250.000": 1250000.0, "1,250.50": 1250.5, "1.250,50": 1250.5, "12,5": 12.5, "-": None, "1,2,34": None, "100,200": 100200.0}
    d = spark.createDataFrame(list(amounts.items()), "raw string, want double")
    assert d.filter(~X.parse_amount(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
    one = spark.createDataFrame([([0.1, 0.105, 0.3, 0.31],)], "k array<double>").select(clusters(F.col("k"), F.lit(0.02)).alias("g")).first().g
    assert [x.members for x in one] == [[0, 1], [2, 3]]
    n = spark.createDataFrame([([5.0],), ([1.0, 2.0],), ([float(i) for i in range(20)],), ([],)], "v array<double>").select(nearest_rank(F.col("v"), 95).alias("p")).collect()
    assert [x.p for x in n] == [5.0, 2.0, 18.0, 0.0]
    c = spark.createDataFrame([("0",), (None,), ("7",), ("0.456",)], "c string").select(X.assisted_confidence(F.col("c")).alias("c")).collect()
    assert [x.c for x in c] == [0.62, 0.62, 1.0, 0.46]
    assert spark.createDataFrame([("ĐƠN Đề nghị é",)], "t string").select(X.fold(F.col("t")).alias("t")).first().t == "don de nghi e"


def test_monitoring(spark):
    rows = [(i, i, "/a" if i % 2 else "/b", 500 if i % 4 == 0 else 200, float(i)) for i in range(501)]
    r = spark.createDataFrame(rows, "ts long, ord long, path string, status_code int, latency_ms double")
    s = M.api_summary(r).first()
    assert s.requests_total == 500 and s.errors_total == 125 and s.error_rate == 0.25 and s.max_ms == 500.0
    q = spark.createDataFrame([(False, 4, 2, "invoice", [], [], True, True, False)], "blank boolean, word_count int, low_count int, document_type string, missing array<string>, warnings array<struct<severity: string>>, llm_ok boolean, corrected boolean, model_ok boolean")
    x = M.quality(q).first()
    assert x.raw_error_rate == 0.5 and x.after_ai_error_rate == 0.275 and x.quality_level == "degraded"


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(f"2026-01-01 00:0{i}:00", i, "GET", "/x", 200, 1.0 * i) for i in range(5)], "ts string, ord long, method string, path string, status_code int, latency_ms double")
    rows.withColumn("ts", F.to_timestamp("ts")).write.json(f"{tmp_path}/in")
    monitor.ingest(monitor.requests(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", seconds=None).awaitTermination()
    assert monitor.snapshot(spark, f"{tmp_path}/t", keep=3).first().requests_total == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"file_path": "a.png", "document_type": "invoice", "fields": {"total_amount": "154.0"}}\n\n{"path": "b.pdf"}\n')
    assert [r.source_path for r in datasets.manifest(spark, str(tmp_path / "m.jsonl")).orderBy("source_path").collect()] == ["a.png", "b.pdf"]
    (tmp_path / "u").mkdir()
    for n in ("x.png", "y.txt"):
        (tmp_path / "u" / n).write_bytes(b"1")
    good, bad = datasets.files(spark, str(tmp_path / "u"))
    assert good.count() == 1 and bad.count() == 1 and good.select(datasets.data_uri(F.col("content")).alias("d")).first().d.endswith("base64,MQ==")
    assert sinks.read_settings(str(tmp_path / "none")) == {"image_preprocessing_enabled": True, "theme": "light"}
    assert sinks.write_settings(str(tmp_path / "s.json"), theme="dark")["theme"] == "dark"
    assert adapters.assist(spark.range(1)).count() == 0 and adapters.correct(spark.range(3)).count() == 3 and adapters.status(ocr=None) == {"ocr": "disabled"}
    reply = spark.createDataFrame([('x {"fields": {"a": "1"}} y',), ('{"b": "2"}',), ("none",)], "r string").select(adapters.assisted_fields(F.col("r")).alias("m")).collect()
    assert [x.m for x in reply] == [{"a": "1"}, {"b": "2"}, None]
    rows = sinks.export_rows(P.reading_order(P.pages(document(spark, TABLE)))).collect()
    assert len(rows) == len(TABLE)


def test_manifest_order_and_bad_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"path": "z.png"}\n\n{"path": "a.png"}\n{"path": "m.png"}\n')
    assert [r.source_path for r in datasets.manifest(spark, str(tmp_path / "m.jsonl"), max_documents=2).collect()] == ["z.png", "a.png"]
    (tmp_path / "bad.jsonl").write_text('{"path": "z.png"}\n\n{"path": \n[1]\n')
    assert [(r.line, r.text) for r in datasets.malformed(spark, str(tmp_path / "bad.jsonl")).orderBy("line").collect()] == [(3, '{"path": '), (4, "[1]")]


def test_label_folder_and_split(spark, tmp_path):
    for d in ("labels", "a", "b"):
        (tmp_path / d).mkdir()
    (tmp_path / "labels" / "gt_7.txt").write_text("1,2,30,2,30,20,1,20,hello, world\n1,2,3\n0,0,5,0,5,5,0,5,###\n")
    (tmp_path / "labels" / "gt_8.txt").write_text("1,2,30,2,30,20,1,20,none\n")
    (tmp_path / "labels" / "other.txt").write_text("1,2,30,2,30,20,1,20,none\n")
    for d in ("a", "b"):
        (tmp_path / d / "im0007.jpg").write_bytes(d.encode())
    got = datasets.labelled_images(spark, str(tmp_path / "labels"), [str(tmp_path / "b"), str(tmp_path / "a")])
    assert [(r.number, r.image.split("/")[-2:], r.label, r.xmin, r.ymax) for r in got.collect()] == [(7, ["b", "im0007.jpg"], "hello, world", 1, 20)]
    rows = datasets.split(spark.createDataFrame([(f"{i}.jpg", f"t{i}", b"x") for i in range(60)], "name string, label string, content binary"), "name")
    datasets.write_split(rows, str(tmp_path / "out"), name="name")
    counts = {r.split: r.n for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    for part, n in counts.items():
        labels = datasets.label_map(spark, str(tmp_path / "out"), part).first().labels
        assert len(labels) == n and all(v == "t" + k[:-4] for k, v in labels.items())
    assert spark.read.parquet(f"{tmp_path}/out/images").count() == 60


def test_wrapped_lines(spark):
    rows = spark.createDataFrame([("one two three",), ("abcdefgh ij",), ("",), (None,), ("iiii ww",)], "t string")
    got = [r.w for r in rows.select(sinks.wrap(F.col("t"), {"i": 0.5}, 5.0).alias("w")).collect()]
    assert got == [["one", "two", "three"], ["abcde", "fgh", "ij"], [""], [""], ["iiii ww"]]


def test_tuning_and_model_settings(spark, tmp_path):
    written = sinks.write_tuning(str(tmp_path / "t" / "t.json"), 5, {"5": 1.0}, {})
    assert json.loads((tmp_path / "t" / "t.json").read_text()) == written and written["document_agent"]["invoice_keyword_threshold"] == 5
    (tmp_path / ".env").write_text("# c\nA = '1.5'\nA=2\nB=x\nbad\n")
    env = assist.settings(str(tmp_path / ".env"), {"C": "7"})
    assert env == {"A": "1.5", "B": "x", "C": "7"}
    assert assist.share(env, "A", 0.5) == 1.0 and assist.share(env, "B", 0.5) == 0.5 and assist.share(env, "D", 0.5) == 0.5
    assert assist.at_least(env, "C", 180) == 32 and assist.at_least(env, "B", 180) == 180


def test_language_model_states_and_merges(spark):
    docs = spark.createDataFrame([(1, "INVOICE\nInvoice No: INV-77\nDate: 2026-01-05\nTotal: 154.00 USD\nBill To: Acme"), (2, " "), (3, "notes"), (4, "fail")], "doc_id long, text string")
    done = pipeline.analyze_text(docs).cache()

    def model(batches):
        import pyarrow as pa

        for b in batches:
            say = []
            for i, c in zip(b.column("doc_id").to_pylist(), b.column("context").to_pylist(), strict=True):
                known = json.loads(c)
                assert i != 1 or "question" in known or (known["document_type"] == "invoice" and known["fields"]["invoice_number"])
                say.append({1: '{"summary": "s", "corrected_text": "t", "fields": {"Purchase Order": {"value": "PO-9", "confidence": 0.9}, "note": "n"}}', 3: "no json", 9: '{"answer": "Blue"}'}.get(i))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(say, pa.string()), pa.array([None if s else "down" for s in say], pa.string())], names=["doc_id", "response", "error"])

    on = assist.Assistant("local", "m", model)
    assert {r.status for r in assist.analyse(done).collect()} == {"disabled"} and {r.status for r in assist.analyse(done, assist.Assistant("x")).collect()} == {"unavailable"}
    assert {r.doc_id: r.status for r in assist.analyse(done, on).collect()} == {1: "ok", 2: "skipped", 3: "error", 4: "error"}
    entities = spark.createDataFrame([(1, 1, "INVOICE_NUMBER", "INV-78", 0.5)], "doc_id long, ord long, label string, value string, confidence double")
    out = pipeline.merge_all(done, entities=entities, assistant=on)
    got = {r.field_name: r.value for r in out["fields"].filter("doc_id = 1").collect()}
    assert got["purchase_order"] == "PO-9" and got["note"] == "n" and got["invoice_number"] == "INV-77"
    plain = pipeline.merge_all(done)
    assert plain["rejected"] is None and {r.field_name for r in plain["fields"].filter("doc_id = 1").collect()} == set(got) - {"purchase_order", "note"}
    asked = spark.createDataFrame([(9, 3, "What colour?"), (10, 4, "What colour?")], "question_id long, doc_id long, question string")
    answers = {r.question_id: (r.answer, r.matched_field) for r in pipeline.answer_questions(done, asked, assistant=on).collect()}
    assert answers[9] == ("Blue", "llm_answer") and answers[10][1] is None


def test_chosen_text_boxes_and_numbers(spark):
    docs = document(spark, TABLE)
    special = docs.select("doc_id")
    plain, straight = P.raw_text(docs).first().text, P.raw_text(docs, special).first().text
    assert plain.split("\n")[0] == " ".join(w["value"] for w in TABLE[0]["words"]) and straight == P.document_text(P.reading_order(P.pages(docs))).first().text
    pages = P.reading_order(P.pages(docs))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(P.chosen_boxes(pages)) == rows(P.raw_boxes(pages)) and rows(P.chosen_boxes(pages, special)) == rows(P.boxes(pages))
    texts = docs.select("doc_id", F.lit("x\n\ny").alias("text")).unionByName(spark.createDataFrame([(2, "a\nb")], "doc_id long, text string"))
    lines = {r.doc_id: r.lines for r in pipeline.chosen_lines(texts, docs).collect()}
    assert lines[2] == ["a", "b"] and len(lines[1]) == len(TABLE)
    assert {r.doc_id: r.lines for r in pipeline.chosen_lines(texts).collect()}[1] == ["x", "y"]
    parts = pipeline.analyze_structured(docs)
    assert [r.table_id for r in parts["tables"].collect()] == ["table_1"]
    ids = [r.region_id for r in parts["regions"].orderBy("page", "ord").collect()]
    assert ids == [f"region_{i + 1}" for i in range(len(ids))]
    boxed = parts["pairs"].collect()
    assert all(0 <= r.bbox.x <= 100 and r.bbox.width > 0 for r in boxed)
    images = spark.createDataFrame([(1, 1, b"i"), (1, 2, b"j")], "doc_id long, page int, content binary")
    assert datasets.page_images(pages, images).count() == 1
    assert P.suggest_tables(P.pages(docs), least=len(TABLE)).first().n_lines == len(TABLE)


def test_value_text(spark):
    row = spark.sql("SELECT named_struct('a', array(1, 2), 'b', map('k', 'v'), 'c', null) AS v")
    assert row.select(X.value_text(F.col("v"), row.schema["v"].dataType).alias("t")).first().t == "a 1 2 b k v c"


def test_entry_point_works_without_the_training_part(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    for gone in ("quire.llm", "quire.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delattr("quire.llm", raising=False)
    bare = importlib.reload(entry)
    assert bare.queries() and not any(q == "pipeline" or q[:2] == "op" and q[2].isdigit() for q in bare.queries())
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    expected = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    want = sorted(repr(_plain([r[i] for i in sorted(range(len(names)), key=names.__getitem__)])) for r in expected.fetchall())
    got = registry.QUERIES[name](spark, at)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(_plain(list(r))) for r in got.select(sorted(got.columns)).collect()) == want


def _plain(value):
    """Values as both engines give them: numbers rounded, rows and arrays as lists."""
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(f"{float(value):.8g}") + 0.0
    return str(value)


def test_nested_form_exchanges_items_only(spark, tmp_path):
    """The nested form has the rows of ocr_words, also where cells take the numbers of the lines below the table, and no word is exchanged."""
    parts = [(k, f"part {k} of three", 10.0 + k) for k in range(3)]
    items = [(1, k % 3, k % 7, 1.0 + k, 1000.5 * k) for k in range(95)] + [(2, 1, 1, 2.0, None), (3, 99, 1, 2.0, 5.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    nested = synthetic.structured(spark, str(tmp_path))
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning(doc_id" in plan and plan.count("Exchange") <= 3
    w = nested.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.posexplode(F.flatten(F.transform("p.blocks", lambda b: b["lines"]))).alias("n", "l")).select("doc_id", "n", F.posexplode("l.words").alias("i", "w"))
    got = [tuple(r) for r in w.select("doc_id", "n", "i", "w.value", "w.confidence", "w.geometry.x1", "w.geometry.y1", "w.geometry.x2", "w.geometry.y2").collect()]
    by_line = {}
    for r in synthetic.ocr_words(spark, str(tmp_path)).collect():
        by_line.setdefault((r.doc_id, r.line), []).append((r.word, r.text, r.confidence, (r.x1, r.y1, r.x2, r.y2)))
    lines = {d: sorted(n for k, n in by_line if k == d) for d in (1, 2, 3)}
    want = [(d, lines[d].index(n), i, t, c, *g) for (d, n), ws in by_line.items() for i, (_, t, c, g) in enumerate(sorted(ws))]
    assert sorted(got) == sorted(want) and len(got) > 95 * 7


def test_nested_form_of_odd_items(spark, tmp_path):
    """Orders that lie in several Arrow batches, a missing key, and orders whose items have no part or no price."""
    spark.createDataFrame([(1, "a  b", 1.5), (2, None, 2.0)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    items = [(d, 1 + k % 3, k, 1.0, 0.125 * k) for d, n in ((-5, 40), (None, 3), (7, 1), (8, 30)) for k in range(n)] + [(9, 3, 1, 1.0, None)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {}
    for most in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            made[most] = {r.doc_id: r.pages for r in synthetic.structured(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made["7"] == made["10000"] and set(made["7"]) == {-5, None, 7, 8, 9}
    lines = {d: [[w.value for w in x.words] for x in p[0].blocks[0].lines] for d, p in made["7"].items()}
    assert lines[9] == [["INVOICE"], ["Bill", "To"], ["Invoice", "No", "INV-9"], ["#"], ["Item", "&", "Description"], ["Qty"], ["Rate"], ["Amount"], ["Sub", "Total"], ["Authorized", "signature"], "Thank you for your business and see you again soon friend".split(), ["Page", "1"]]
    assert ["a", "", "b"] in lines[7] and ["Invoice", "No", "INV-9"] not in lines[None] and made["7"][None][0].blocks[0].lines[0].words[0].confidence is None


def test_page_rules_without_words(spark):
    """Slim pages have the same lines, counts and low words as full ones, and no word is copied with its line."""
    box = lambda x, y: {"x1": x, "y1": y, "x2": x + 0.1, "y2": y + 0.01}
    word = lambda t, c, g: {"value": t, "confidence": c, "geometry": g}
    lines = [
        {"geometry": None, "words": [word("Ünï", 0.3, box(0.1, 0.1)), word(" ", 0.1, box(0.2, 0.1)), word(" x ", 0.2, box(0.3, 0.1))]},
        {"geometry": box(0.5, 0.5), "words": [word("none", 0.1, None), word(None, 0.1, box(0.1, 0.1)), word("sure", None, box(0.1, 0.2))]}, {"geometry": None, "words": None}, {"geometry": box(0.1, 0.9), "words": [word("\t", 0.0, box(0.1, 0.9))]},
    ]
    docs = spark.createDataFrame([(1, [{"dimensions": {"height": 0.0, "width": 9.0}, "blocks": [{"lines": lines}]}]), (2, [{"dimensions": None, "blocks": []}])], f"doc_id long, pages {synthetic.PAGES}")
    full, slim = P.pages(docs), P.pages(docs, words=False)
    assert "words" not in slim.schema["lines"].dataType.elementType.names and "words" not in slim.columns
    plain = lambda df: sorted((r.doc_id, r.page, r.page_width, r.n_lines, [[x[c] for c in slim.schema["lines"].dataType.elementType.names] for x in r.lines]) for r in df.collect())
    assert plain(full) == plain(slim)
    assert sorted(r.n_words for r in slim.collect()) == sorted(len(r.words) for r in full.collect()) == [0, 3]
    assert sorted(P.words_below(docs).collect()) == sorted(P.low_confidence(full).collect()) and P.words_below(docs).count() == 2
    assert sorted(P.suggest_tables(P.sheets(docs), 4).collect()) == sorted(P.suggest_tables(full, 4).collect())


def test_texts_are_dealt_over_all_parts(spark):
    """Few bytes of orders become much work, so their parts aren't merged."""
    assert synthetic.ocr_text(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_labels_are_folded_once(spark):
    """A label is folded once for all aliases, not once for each."""
    plan = spark.createDataFrame([(1, "Bill To: A")], "doc_id long, text string").select(K.canonical(X.squeeze(F.col("text"))).alias("c"), X.hits(X.fold(F.col("text")), ["a", "b", "c"]).alias("h"), X.has_any(X.fold(F.col("text")), ["a", "b", "c"]).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("translate(") <= 3


def test_patterns_are_sought_by_their_letters(spark):
    """A pattern's first letters decide most texts; what is found is as by the pattern alone."""
    assert [X.literal_start(p) for p in (r"\binvoice\s*#(?=\s|$)", r"\b(?:bill|billed|billing)\s+to\b", r"\binvoices?\b", r"x|y")] == ["invoice", "bill", "invoice", ""]
    d = spark.createDataFrame([("billed  to a",), ("rebill to b",), ("invoice# 1",), ("invoices",), ("sub total",), ("",), (None,)], "n string")
    patterns = [*L.STRONG_INVOICE, *L.MEDIUM_INVOICE, *L.REFERENCE_LISTS]
    got = d.select(F.array(*[X.matched(F.col("n"), p) for p in patterns]).alias("a"), F.array(*[F.col("n").rlike(p) for p in patterns]).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a.count(True) for r in got) > 4


def _both(spark, name, at, items):
    """A query's rows and its SQL's over lineitem in the given order of rows, with the folder's parts."""
    import duckdb

    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.mode("overwrite").parquet(f"{at}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(at))
    found = con.sql(registry.ORACLE_SQL[name]).to_arrow_table().select(got.columns).to_pylist()
    order = lambda rows: sorted(repr(_plain(list(r.values()))) for r in rows)
    return order(r.asDict() for r in got.collect()), order(found)


def test_layout_table_has_its_last_items(spark, tmp_path):
    """A table of 19 items or more goes further below its head than elsewhere a page's table may; elsewhere that rule stays."""
    spark.createDataFrame([(k, f"part {k}", 10.0 + k) for k in range(3)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    items = [(n, k % 3, k % 7, 1.0 + k, 10.5 * k) for n in (17, 18, 19, 20, 26) for k in range(n)]
    got, want = _both(spark, "layout_table", tmp_path, items)
    assert got == want and len(got) == 5
    ends = Y.regions(P.pages(synthetic.structured(spark, str(tmp_path)))).filter("type = 'table'").select("doc_id", F.size(F.split("text", "\n")).alias("n")).collect()
    assert {r.doc_id: r.n for r in ends} == {n: 5 + 5 * min(n, 18) for n in (17, 18, 19, 20, 26)}


def test_best_entity_where_its_sql_leaves_the_order_open(spark, tmp_path):
    """Two items of an order can share a place if part keys go beyond a million; the SQL's value then hangs on the rows' order, ours doesn't."""
    spark.createDataFrame([(7, "a", 1.0)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    one, two, other = (1, 1000007, 1, 1.0, 1.0), (1, 7, 2, 1.0, 1.0), (2, 1000007, 1, 1.0, 1.0)
    a, b = _both(spark, "best_entity_field", tmp_path, [one, two, other]), _both(spark, "best_entity_field", tmp_path, [two, one, other])
    assert a[0] == b[0] and a[0] in (a[1], b[1]) and a[1] != b[1]


def _odd_documents(spark, some=("a", "Total", "boxless", " ", "", f"{chr(0xA0)}x{chr(0x2003)}", None, "Đơn", f"{chr(0x1C)}y"), most=6):
    """Tilted, blank, boxless and tied lines, several pages and blocks, missing sizes and pages."""
    import random

    rng, docs = random.Random(5), []
    word = lambda t, x, y, w, h: {"value": t, "confidence": 0.5, "geometry": None if t == "boxless" else {"x1": x, "y1": y, "x2": x + w, "y2": y + h}}
    for k in range(60):
        pages = []
        for _ in range(k % 4):
            blocks = []
            for _ in range(rng.randint(0, 3)):
                lines = []
                for _ in range(rng.randint(0, 9)):
                    x, y, tilt = rng.choice([0.1, 0.1, rng.random()]), rng.choice([0.2, 0.21, rng.random()]), rng.choice([0, 0.05, -0.1, 1.0])
                    words = [word(rng.choice(some), x + i * 0.06, y + tilt * i * 0.06, rng.choice([0.0, 0.01, 0.05]), rng.choice([0.0, 0.01, 0.02])) for i in range(rng.randint(0, most))]
                    lines.append({"geometry": rng.choice([None, None, {"x1": x, "y1": y, "x2": x + 0.3, "y2": y + 0.0125}]), "words": rng.choice([words, words, words[::-1]])})
                blocks.append({"lines": lines})
            pages.append({"dimensions": rng.choice([{"height": 1000.0, "width": 700.0}, {"height": 0.0, "width": 5.0}, None]), "blocks": blocks})
        docs.append({"doc_id": k, "pages": pages if k else None})
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.from_json("j", datasets.DOCUMENT).alias("d")).select("d.*").coalesce(1)


def test_reading_order_in_batches_is_that_of_rows(spark):
    """Boxes and spaced rows of Arrow batches are those of the array functions, on odd documents too."""
    docs = _odd_documents(spark).cache()
    by_row = P.reading_order(P.pages(docs)).cache()
    plain = lambda df: sorted(map(repr, df.collect()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    want, got = plain(P.boxes(by_row)), plain(docs.mapInArrow(R.boxes, f"doc_id {kind}, {R.BOXES}"))
    assert got == want and len(got) > 200
    want, got = plain(P.spaced_rows(by_row)), plain(docs.mapInArrow(R.spaced, f"doc_id {kind}, {R.SPACED}"))
    assert got == want and len(got) == 90 and any("   " in x for x in got)


LABELS = [
    "Bill To", "Ship To", "Invoice No", "Invoice#", "Total", "Sub Total", "Date:", "Người mua hàng", "Mẫu số:", "Item & Description", "Qty", "Rate Amount", "Payment method", "Email: a@b.c", "A# 7", "No 5  six", "#", "-", ":", " : ", "12.5", "$1,200.00", "99%",
    "Company", "from", "date  12/3", "Mã số：", "Mã số： 5", f"so{chr(0xA0)}hd", "Thank you for your business and see you again soon", "boxless", "", None, "İnvoice", "x" * 50, "Tax code 5", "tax\tcode", "Invoice:  ", "a:b", "ab  cd", "Status#\tok", f"no{chr(0x301)}",
]


def test_pairs_in_batches_are_those_of_rows(spark):
    """Pairs of Arrow batches are those of the array functions, on odd documents too."""
    plain = lambda df: sorted(map(repr, df.collect()))
    for most in (1, 3):
        docs = _odd_documents(spark, LABELS, most).cache()
        p = K.page_pairs(P.pages(docs)).select("doc_id", F.explode("pairs").alias("p")).select("doc_id", "p.label", "p.value", "p.canonical", "p.source", "p.confidence")
        want, got = plain(p), plain(docs.mapInArrow(pairing.pairs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {pairing.PAIRS}"))
        assert got == want and all(sum(s in x for x in got) > 3 for s in ("inline:", "layout:", "section:"))


def test_rules_on_labels_are_those_of_rows(spark):
    texts = [t for t in LABELS if t is not None] + [f"{a} {b}" for a in LABELS[:14] for b in LABELS[8:24]]
    t = F.col("t")
    d = spark.createDataFrame([(x,) for x in texts], "t string").select(
        t, K.is_row_label(t).alias("row"), F.coalesce(K.is_standalone(t), F.lit(False)).alias("alone"), K.is_stop(t).alias("stop"), K.is_table_head(t).alias("head"), X.squeeze(t).alias("norm"), K.canonical(X.squeeze(t)).alias("canonical"), K.split_inline(t).alias("cut"), K.is_label(t).alias("label"),
    )
    for r in d.collect():
        q = pairing.rules(r.t)
        got = (q.row, q.alone, q.stop, q.head, *pairing.named(r.t), pairing.split_inline(r.t), pairing.is_label(r.t))
        assert got == (r.row, r.alone, r.stop, r["head"], r.norm, r.canonical, r.cut and tuple(r.cut), r.label), r.t


def test_doubles_are_rounded_as_in_the_jvm(spark):
    import numpy as np

    x = [0.1 + 0.2, 1.0000005, 2.0000015, 0.0000025, -1.0000005, 1e15 + 0.3, 123456.7890125, -0.0, 1e-9, 33.3333335, float("inf"), 14.2857145]
    want = [r.r for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("r")).collect()]
    assert R.rounded(np.array(x), 6).tolist() == want


def test_best_entity_with_long_orders_and_missing_places(spark, tmp_path):
    """A place is a whole number of eight bytes; words without one come last, and a value without words is missing."""
    spark.createDataFrame([(7, "a", 1.0)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    items = [(1, k, n, 1.0, 1.0) for n, k in ((2147, 6), (2148, 7), (3000, 11), (1, 8), (None, 9), (2, None))] + [(2, None, 1, 1.0, 1.0), (None, 1, 1, 1.0, 1.0), (None, 2, 2, 1.0, 1.0), (3, 6, None, 1.0, 1.0), (3, 6, 1, 1.0, 1.0)]
    for name in ("best_entity_field", "bio_entities"):
        got, want = _both(spark, name, tmp_path, items)
        assert got == want and len(got) >= 5


def test_items_are_dealt_by_their_bytes(spark, monkeypatch):
    """Many items go to more parts than a small session setting says, and are never sorted by part; the rows stay the same."""
    at = "/root/testdata/sf0.001"
    want = sorted(map(repr, synthetic.structured(spark, at).collect()))
    monkeypatch.setattr(synthetic, "PART_BYTES", 1 << 12, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = synthetic.structured(spark, at)
        plan = nested._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and plan.count("Sort [") == 1 and nested.rdd.getNumPartitions() > 4
        assert sorted(map(repr, nested.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_regions_of_one_type(spark):
    """Regions of one type are those among all regions, and the detectors after that type's are not run."""
    lines = [line("INVOICE", 0.4, 0.04, 0.52, 0.08), *TABLE, line("Authorized signature", 0.6, 0.7, 0.8, 0.714), line("Page 1", 0.45, 0.95, 0.5, 0.964)]
    pages = P.pages(document(spark, lines)).cache()
    everything = Y.regions(pages).drop("ord").collect()
    for kind in ("title", "table", "header", "total", "signature"):
        assert Y.regions(pages, only=kind).drop("ord").collect() == [r for r in everything if r.type == kind]
    assert len({r.type for r in everything}) > 3
    plan = registry.QUERIES["layout_title"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "layout_rule:title" in plan and not any(x in plan for x in ("layout_rule:table_header", "layout_rule:top_before_table", "layout_rule:bottom_or_footer_keywords"))
