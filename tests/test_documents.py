import json
import zlib

import pytest
from pyspark.sql import functions as F

from citeframe import schema, settings
from citeframe.operators import documents, facts, pages, score, validate
from citeframe.plans import extraction
from citeframe.sources import ingest, pdf, writers

LEAF = lambda v: {"value": v, "source": None if v is None else {"kind": "paragraph", "quote": "q", "page": None, "ref": "para:1"}, "confidence": "low", "reason": None if v is not None else "none"}


def _doc(**changes):
    """A whole document as JSON text: every leaf null but those of `changes`."""
    def made(kind):
        if documents.is_leaf(kind):
            return LEAF(None)
        if kind.typeName() == "array":
            return []
        return {f.name: made(f.dataType) for f in kind.fields}
    return json.dumps({f.name: made(f.dataType) for f in schema.DOCUMENT.fields} | changes, ensure_ascii=False)


def _rows(spark, docs):
    return ingest.parse_golden(spark.createDataFrame(list(docs.items()), "doc_id int, json string"))


def test_score_document(spark):
    date = lambda t, d: {"type": LEAF(t), "date_be": LEAF(d), "time": LEAF(None), "location": LEAF(None)}
    expected = _rows(spark, {
        1: _doc(project_name=LEAF("a  b"), budget_amount=LEAF(2.0), key_dates=[date("x", "1"), date(None, "2")], risk_flags=[]),
        2: _doc(required_documents=[LEAF("form"), LEAF(None)]), 3: _doc(),
    })
    actual = _rows(spark, {
        1: _doc(project_name=LEAF("so a b it is"), budget_amount=LEAF(2.001), project_id=LEAF("p"), key_dates=[date("x", "9")], risk_flags=[{"text": "t", "origin": "model", "source": None}]),
        2: _doc(required_documents=None), 4: _doc(),
    })
    got = {(r.doc_id, r.path): [] for r in documents.score_document(expected, actual).collect()}
    for r in documents.score_document(expected, actual).collect():
        got[r.doc_id, r.path].append(r.verdict)
    assert {k for k, _ in got} == {1, 2}  # documents without a prediction are no part of it
    assert got[1, "project_name"] == ["exact"] and got[1, "budget_amount"] == ["exact"] and got[1, "project_id"] == ["hallucinated"]
    # an item without a partner: its null leaves are exact, the others missed
    assert sorted(got[1, "key_dates[].date_be"]) == ["missed", "wrong"] and sorted(got[1, "key_dates[].type"]) == ["exact", "exact"] and got[1, "key_dates[].time"] == ["exact"] * 2
    assert sorted(got[2, "required_documents[]"]) == ["exact", "missed"]
    assert not any("risk_flags" in p for _, p in got)
    assert [tuple(r) for r in documents.risk_flag_counts(expected, actual).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 0)]
    few = actual.select("doc_id", "project_name")  # parts the prediction lacks altogether
    assert {r.verdict for r in documents.score_document(expected, few).filter("path = 'budget_amount' and doc_id = 1").collect()} == {"missed"}
    assert documents.score_document(expected.limit(0), actual).count() == 0


def test_plan_is_all_or_nothing(spark):
    docs = spark.createDataFrame([(k, "docx", 0) for k in range(5)] + [(9, None, 0)], "doc_id int, kind string, n_images int")
    whole = json.loads(_doc())
    rows = []
    for k in range(5):
        for name, kind in schema.GROUPS.items():
            good = json.dumps({f.name: whole[f.name] for f in kind.fields}, ensure_ascii=False)
            first = {1: "{not json", 2: good.replace('"confidence": "low"', '"confidence": "sure"'), 3: None}.get(k, good) if name == "bonds" else good
            rows += [(k, name, 1, first, "timeout" if k == 3 and name == "bonds" else None), (k, name, 2, "[]" if k == 2 else good, None)]
    answers = spark.createDataFrame(rows, "doc_id int, name string, attempt int, json string, error string").selectExpr("*", "'anthropic' as provider", "'claude-haiku-4-5' as model", "attempt * 1000000L as input_tokens", "0L as output_tokens", "0L as cache_write_tokens", "0L as cached_read_tokens", "5L as duration_ms")
    none = spark.createDataFrame([], "name string, provider string, model string")
    done, rejects = extraction.extract_documents(docs, answers, extraction.resolve(extraction.groups(spark), none, "anthropic", "claude-haiku-4-5"), extraction.providers(spark), extraction.kind_rules(spark))
    assert {r.doc_id: (r.provider, r.usd, r.duration_ms) for r in done.collect()} == {0: ("anthropic", 6.0, 30), 1: ("anthropic", 7.0, 30), 4: ("anthropic", 6.0, 30)}
    assert {r.doc_id: (r.stage, r.code, r.status) for r in rejects.collect()} == {2: ("bonds", "validation", 502), 3: ("bonds", "timeout", 504), 9: ("rules", "validation", 502)}
    assert extraction.merge_groups(answers.filter("attempt = 1")).count() == 3  # malformed JSON is no document of nulls
    blind = extraction.extract_documents(docs.withColumn("n_images", F.lit(1)), answers, extraction.resolve(extraction.groups(spark), spark.createDataFrame([("misc", "openai_compat", "m")], "name string, provider string, model string"), "anthropic", "m"), extraction.providers(spark), extraction.kind_rules(spark))
    assert blind[0].count() == 0 and {(r.stage, r.detail) for r in blind[1].filter("doc_id < 9").collect()} == {("gate", "misc: sees no images")}


def test_settings():
    s = settings.load({})
    assert (s.provider, s.has_key, s.fx_rate, s.kinds, s.compat_vision, s.max_upload_bytes) == ("anthropic", False, 36.5, ("pdf", "docx"), False, 50 << 20)
    s = settings.load({"TOR_PROVIDER": "mine", "TOR_PROVIDER_API_KEY": "k", "USD_THB_RATE": "30", "TOR_ENABLE_XLSX": "on", "CORS_ORIGINS": "a, ,b", "TOR_GROUP_MISC": "openai:o", "MAX_UPLOAD_MB": "1"})
    assert (s.has_key, s.fx_rate, s.kinds, s.origins, s.overrides, s.max_upload_bytes) == (True, 30.0, ("pdf", "docx", "xlsx"), ("a", "b"), (("TOR_GROUP_MISC", "openai:o"),), 1 << 20)


def _pdf(*objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1))


def test_pdf_fonts_and_object_streams():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0E01> endbfchar 2 beginbfrange <0010> <0011> <0041> <0020> <0021> [<0078> <0079007A>] endbfrange"
    text = b"BT /F 10 Tf 1 0 0 1 50 700 Tm [<00030010> -300 <0011>] TJ 0 -12 Td <00200021> Tj ET q 2 0 0 2 0 0 cm /X Do Q BI /W 1 ID \x00\xff EI"
    form = b"BT /F 5 Tf 10 100 Td <0003> Tj ET"
    inner = b"<< /Type /Catalog /Pages 2 0 R >> << /Kids [3 0 R] /MediaBox [0 0 100 100] >>"
    packed = zlib.compress(b"20 0 2 %d " % len(b"<< /Type /Catalog /Pages 2 0 R >> ") + inner)
    head = len(b"20 0 2 %d " % len(b"<< /Type /Catalog /Pages 2 0 R >> "))
    stream = lambda d, more=b"": b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(d), more, d)
    # object 1 is the object stream; 2 and 20 are within it
    content = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in [
        (1, stream(packed, b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % head)),
        (3, b"<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F 5 0 R >> /XObject << /X 7 0 R >> >> >>"), (4, stream(text)),
        (5, b"<< /Type /Font /Subtype /Type0 /BaseFont /Thai /ToUnicode 6 0 R >>"), (6, stream(cmap)), (7, stream(form, b"/Subtype /Form")),
    ])
    (page,) = pdf.pages(content)
    assert [b[4] for b in page.blocks if b[5] == 0] == ["ก" + "A B\nxyz", "ก"] and sum(b[5] for b in page.blocks) == 1
    assert page.fonts == [("Thai", True)] and page.area == 10_000
    assert [v for v in (pdf.Lexer(b"(a\\(b\\051\\\\ (in) ) /A#42 <4> [1 -2.5 3 0 R null] << /K true >>")).next() for _ in range(0)] == []
    lexer = pdf.Lexer(b"(a\\(b\\051 (in)) /A#42 <4> [1 -2.5 3 0 R null] << /K true >>")
    assert [lexer.next() for _ in range(5)] == [b"a(b) (in)", "AB", b"@", [1, -2.5, 3, None], {"K": True}]


@pytest.mark.parametrize("content", [b"%PDF-1.4", _pdf(b"<< /Type /Catalog >>") + b"trailer << /Encrypt 9 0 R >>", b"%PDF-1.4\n1 0 obj (unclosed"])
def test_broken_pdf_is_refused(spark, content):
    got = ingest.dispatch(spark.createDataFrame([("d", bytearray(content))], "doc_id string, content binary"), kinds=["pdf"]).collect()
    assert [r.status for r in got] == [400]


def test_pdf_without_pages(spark):
    empty = writers.pdf([])
    got = ingest.dispatch(spark.createDataFrame([("d", bytearray(empty)), ("n", None)], "doc_id string, content binary"), kinds=["pdf"]).collect()
    assert sorted((r.doc_id, r.status, r.seq) for r in got) == [("d", 200, None), ("n", 400, None)]


def test_dispatch_caps_and_pages(spark):
    many = writers.docx([f"line {k}" for k in range(3001)])
    wide = writers.xlsx([("s", [[k for k in range(100)] for _ in range(51)])])
    ok = writers.pdf([(["x" * 30], True), ([], True), (["x" * 30], False)])
    files = spark.createDataFrame([("a", bytearray(many)), ("b", bytearray(wide)), ("c", bytearray(ok))], "doc_id string, content binary")
    got = ingest.dispatch(files, kinds=list(ingest.KINDS))
    assert {r.doc_id: (r.status, r.n) for r in got.groupBy("doc_id", "status").agg(F.count("seq").alias("n")).collect()} == {"a": (422, 0), "b": (422, 0), "c": (200, 2)}
    report = pages.report(ingest.pdf_pages(files.filter("doc_id = 'c'")))
    assert [(r.page, r.status) for r in report.orderBy("page").collect()] == [(1, "mixed"), (2, "image_only"), (3, "text")]
    assert [tuple(r) for r in pages.to_render(report).collect()] == [("c", 2)]
    raw = spark.createDataFrame([("d", 1, 1, 0, " ๑ "), ("d", 1, 2, 1, "image"), ("d", 1, 3, 0, "  ")], "doc_id string, page int, seq int, type int, text string")
    assert [r.text.strip() for r in pages.text_blocks(raw).collect()] == ["1"]


def test_actuals_and_lines(spark, tmp_path):
    docs = spark.createDataFrame([("a", "m1", 1), ("b", "m2", None)], "doc_id string, model string, v int")
    facts.write_actuals(docs, str(tmp_path / "out"))
    back = spark.read.option("basePath", str(tmp_path / "out")).text(str(tmp_path / "out")).collect()
    assert sorted((r.model, r.value) for r in back) == [("m1", '{"doc_id":"a","v":1}'), ("m2", '{"doc_id":"b","v":null}')]
    lines = spark.createDataFrame([(2, "", "c"), (1, "b", "b"), (1, "a", "a")], "part int, rank string, line string")
    documents.write_lines(lines, str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b", "c"]
    (tmp_path / "golden").mkdir()
    (tmp_path / "golden" / "one.json").write_text(_doc(project_name=LEAF("p")))
    assert [(r.doc_id, r.project_name.value) for r in ingest.golden(spark, str(tmp_path / "golden")).collect()] == [("one", "p")]


def test_sources_and_rejects(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"one two")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    found = ingest.files(spark, f"file://{tmp_path}/*.txt", max_bytes=50)
    assert [r.length for r in found.collect()] == [7]
    monkeypatch.setattr(ingest, "READERS", dict(ingest.READERS))
    ingest.register("pdf", lambda content: iter([("text_page", 7, None, content.decode())]))
    got = ingest.dispatch(spark.createDataFrame([("d", bytearray(b"%PDF mine"))], "doc_id string, content binary"), kinds=["pdf"]).first()
    assert (got.page, got.text, got.status) == (7, "%PDF mine", 200)
    (tmp_path / "r.json").write_text('{"doc_id": "d", "name": "misc", "attempt": 1, "json": "{}", "input_tokens": 5}\n{"doc_id": "d", "name": "misc", "attempt": 2, "error": "auth"}')
    answers = extraction.checked(ingest.responses(spark, str(tmp_path / "r.json")))
    assert [(r.attempt, r.error, r.detail.split(" ")[-1]) for r in answers.orderBy("attempt").collect()] == [(1, "validation", "confidence"), (2, "auth", "")]
    told = validate.rejects(answers, "doc_id", "misc", F.col("error"), F.col("detail")).collect()
    assert sorted((r.stage, r.code) for r in told) == [("misc", "auth"), ("misc", "validation")]
    lists = spark.createDataFrame([(["abc", "zzz"], ["q", "abc"])], "e array<string>, a array<string>")
    pairs = score.greedy_match(F.col("e"), F.col("a"))
    assert tuple(lists.select(score.unmatched(F.col("e"), pairs, "i"), score.unmatched(F.col("a"), pairs, "j")).first()) == ([1], [0])
