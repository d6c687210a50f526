import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeframe import catalog, surface
from citeframe.functions import text as X
from citeframe.operators import blocks, documents, score
from citeframe.plans import extraction

LEAF = "struct<value:string,source:string,confidence:string,reason:string>"


def _docs(spark, ids, value="x"):
    return spark.createDataFrame([(k,) for k in ids], "doc_id int").select("doc_id", F.struct(*[F.lit(v).cast("string").alias(n) for n, v in (("value", value), ("source", None), ("confidence", "high"), ("reason", None))]).alias("project_name"), F.array().cast("array<string>").alias("risk_flags"))


def test_report_of_nothing(spark):
    expected = _docs(spark, range(6))
    runs = spark.createDataFrame([(k, k != 4) for k in range(5)], "doc_id int, crashed boolean")
    assert documents.report(expected, _docs(spark, [4]), runs).filter("part = 0").first().line == "# Evaluation of 1 document(s)"
    with pytest.raises(documents.NothingScored, match="4 crashed, 1 without a run, 1 without a result"):
        documents.report(expected, _docs(spark, [9]), runs)
    with pytest.raises(documents.NothingScored, match="0 crashed, 0 without a run"):
        documents.report(expected.filter("false"), _docs(spark, [1]), runs)


def test_report_has_few_exchanges(spark):
    rows = documents.report(_docs(spark, range(50)), _docs(spark, range(50), "y"), spark.createDataFrame([(k, False) for k in range(50)], "doc_id int, crashed boolean"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4
    assert [r.line for r in rows.filter("part in (1, 2)").orderBy("part").collect()] == ["| project_name | 0 | 50 | 0 | 0 |", "| total | 0 | 50 | 0 | 0 |"]


def test_crashed_documents_are_told_in_part(spark):
    runs = spark.createDataFrame([("p", m, k, m == "a" or k == 3, 0.5) for m in "abc" for k in range(30) if (m, k) != ("c", 3)], "provider string, model string, doc_id int, crashed boolean, usd double")
    tallies = score.tally(spark.createDataFrame([("p", "b", "exact")], "provider string, model string, verdict string"), "provider", "model")
    got = {r.model: (r.crashed, r.cost) for r in score.provider_summary(tallies, runs, told=3).collect()}
    assert got == {"a": ("0, 1, 10 and 27 more", "$15.0000"), "b": ("3", "$15.0000"), "c": ("none", "$14.5000")}
    assert score.crashed_documents(runs).count() == 31
    plan = score.provider_summary(tallies, runs)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "WindowGroupLimit" in plan


def test_a_provider_that_nobody_supplies(spark):
    own = spark.createDataFrame([("misc", "nobody", "m")], "name string, provider string, model string")
    resolved = extraction.resolve(extraction.groups(spark), own, "anthropic", "m")
    docs = spark.createDataFrame([(1, "pdf", 0)], "doc_id int, kind string, n_images int")
    answers = spark.createDataFrame([], "doc_id int, name string, attempt int, error string, json string, provider string, model string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cached_read_tokens bigint, duration_ms bigint")
    with pytest.raises(extraction.UnresolvedProvider, match="group 'misc' overrides its provider to 'nobody'"):
        extraction.extract_documents(docs, answers, resolved, extraction.providers(spark), extraction.kind_rules(spark))


# ---- grids ---------------------------------------------------------------------------------------------------

def test_grid_of_any_sheet(spark):
    cells = [("a", "B2", "x"), ("a", "AA1", "y"), ("a", "A1", None), ("a", "B2", "w"), ("a", "no ref", "z"), ("a", "a1", "z"), ("b", "C10", "q"), ("b", "C9", "p")]
    got = sorted(map(tuple, blocks.grid_rows(spark.createDataFrame(cells, "sheet string, ref string, value string"), ["sheet"]).collect()))
    assert got == [("a", ["A", "B", "AA"], 1, [None, None, "y"]), ("a", ["A", "B", "AA"], 2, [None, "x", None]), ("b", ["C"], 9, ["p"]), ("b", ["C"], 10, ["q"])]
    assert blocks.grid_rows(spark.createDataFrame([], "sheet string, ref string, value string"), ["sheet"]).count() == 0


def test_one_sheet_with_most_rows(spark):
    cells = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 300).cast("string"))).alias("sheet"), F.concat(F.chr(65 + F.col("id") % 7), (F.floor(F.col("id") / 7) + 1).cast("string")).alias("ref"), F.col("id").cast("string").alias("value"))
    got = {(r.sheet, r.row): r["values"] for r in blocks.grid_rows(cells, ["sheet"]).collect()}
    want = {}
    for r in cells.collect():
        want.setdefault((r.sheet, int(r.ref[1:])), {})[r.ref[0]] = r.value
    assert {k: [v for v in vs if v] for k, vs in got.items()} == {k: [v[c] for c in sorted(v)] for k, v in want.items()}


# ---- merged answers ------------------------------------------------------------------------------------------

def test_merged_as_later_groups_win(spark):
    groups = {"one": StructType.fromDDL("a string, b struct<x:int>"), "two": StructType.fromDDL("a string, c array<double>")}
    document = StructType.fromDDL("a string, b struct<x:int>, c array<double>")
    rows = [
        (1, "one", {"a": "first", "b": {"x": 1, "y": 2}, "c": "undeclared"}), (1, "two", {"a": "second", "c": [1, 2.5], "b": None}),
        (2, "one", {"a": "first", "b": {"x": 1}}), (2, "two", {"c": []}),  # what a group declares and lacks is null, and replaces
        (3, "one", {"a": "first", "b": {"x": "many"}}), (3, "two", {"a": "s", "c": ["no"]}),
        (4, "one", [1]), (4, "two", {"a": "s"}), (5, "two", {"a": "s", "c": [1]}), (6, "other", {"a": "s"}), (None, "one", {}),
        (8, "one", {"b": [1]}), (8, "two", {"a": "s", "c": 5}), (9, "one", {"b": {"x": None}}), (9, "two", {"a": "s", "c": [None, 1]}),
    ]
    answers = spark.createDataFrame([(d, n, json.dumps(j)) for d, n, j in rows] + [(7, "one", None), (7, "two", "{")], "doc_id int, name string, json string")
    merged, errors = extraction.merge_variants(answers, groups, document)
    assert [(r.doc_id, r.a, r.b.x, r.c) for r in merged.orderBy("doc_id").collect()] == [(1, "second", 1, [1.0, 2.5]), (9, "s", None, [None, 1.0])]
    assert sorted((r.doc_id, r.path, r.code) for r in errors.collect()) == [
        (2, "a", "missing"), (3, "b.x", "not_valid"), (3, "c[]", "not_valid"), (4, "one", "malformed"), (5, "b", "missing"), (7, "one", "malformed"), (7, "two", "malformed"),
        (8, "b", "not_valid"), (8, "c", "not_valid")]


# ---- SQL -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sql(spark):
    session = spark.newSession()
    surface.register(session)
    surface.register(session)  # again
    return session


def test_table_function(spark, sql):
    rows = [(1, "a\n\n b \t\nc", "k"), (2, None, "k"), (3, "", None), (1, "z", "k")]
    sql.createDataFrame(rows, "doc_id int, text string, more string").createOrReplaceTempView("docs")
    got = sql.sql("select * from cite_blocks(table(docs) partition by doc_id)")
    assert got.columns == ["doc_id", "more", "seq", "kind", "ref", "block"]
    want = blocks.paragraphs(spark.createDataFrame(rows, "doc_id int, text string, more string")).collect()
    assert sorted((r.doc_id, r.seq, r.kind, r.ref, r.block) for r in got.collect()) == sorted(map(tuple, want))
    for bad in ("select * from cite_blocks(1)", "select * from cite_blocks(table(select 1 as doc_id))", "select * from cite_blocks(table(select 't' as text, 1 as seq))"):
        with pytest.raises(Exception, match="cite_blocks"):
            sql.sql(bad).collect()


def test_scalar_functions(sql):
    pairs = [("a  b", "a b"), ("", "x"), (None, "x"), ("x", None), (None, None), ("abc", "xabcx"), ("abcd", "abce"), ("a", "a"), ("ก ข", "ก ข")]
    rows = sql.createDataFrame(pairs, "e string, a string")
    rows.createOrReplaceTempView("pairs")
    got = sql.sql("select e, a, cite_verdict(e, a) as v, cite_similarity(e, a) as s from pairs").collect()
    want = rows.select("e", "a", X.verdict(F.col("e"), F.col("a")).alias("v"), X.similarity(F.col("e"), F.col("a")).alias("s")).collect()
    assert got == want
    refs = [("text_page", 3, None), ("vision_page", 4, None), ("paragraph", None, "para:7"), ("table_cell_docx", None, "t1:r2:c3"), ("cell_xlsx", None, "S!1!B2"), (None, None, "x"), ("other", None, None)]
    cites = sql.createDataFrame(refs, "kind string, page int, ref string")
    cites.createOrReplaceTempView("cites")
    got = sql.sql("select cite_locator(kind, page, ref) as l, cite_sheet(ref) as s, cite_cell(ref) as c from cites").collect()
    assert got == cites.select(X.locator(F.col("kind"), F.col("page"), F.col("ref")).alias("l"), X.cell_sheet(F.col("ref")).alias("s"), X.cell_ref(F.col("ref")).alias("c")).collect()


# ---- fixed cases of what the queries run over tables -----------------------------------------------------------

def test_settings_and_schemas(spark):
    from citeframe import catalog, schema, settings
    from citeframe.functions import thai

    words = spark.createDataFrame(list(catalog._QUIRKS.items()), "words string, n bigint")
    assert all(r.n == r.parsed for r in words.select("n", thai.number_words(F.col("words")).alias("parsed")).collect())
    env = spark.createDataFrame([("TOR_GROUP_BONDS", "gemini:g:1"), ("TOR_GROUP_MISC", "openai:o"), ("TOR_GROUP_X", "openai:"), ("TOR_GROUP_Y", ":m"), ("OTHER", "a:b")], "key string, value string")
    assert sorted(map(tuple, extraction.parse_overrides(env).collect())) == [("bonds", "gemini", "g:1"), ("misc", "openai", "o")]
    own = spark.createDataFrame([("bonds", "openai_compat", "local"), ("misc", "nobody", "g")], "name string, provider string, model string")
    resolved = extraction.resolve(extraction.groups(spark), own, "anthropic", "m")
    assert {(r["name"], r.provider, r.model) for r in resolved.collect()} == {(n, *{"bonds": ("openai_compat", "local"), "misc": ("nobody", "g")}.get(n, ("anthropic", "m"))) for n in schema.GROUPS}
    assert [r["name"] for r in extraction.capability_gate(resolved, extraction.providers(spark)).collect()] == ["misc"]
    assert [tuple(r) for r in extraction.unresolved(resolved, "anthropic", ["openai_compat"]).collect()] == [("misc", "nobody")]
    able = extraction.providers(spark, settings.load({"TOR_OPENAI_COMPAT_VISION": " Yes "}).compat_vision)
    probes = spark.createDataFrame([("openai_compat", "no schema"), ("openai_compat", None), ("anthropic", None)], "provider string, error string")
    assert {r.provider: (r.structured, r.vision) for r in extraction.probed(able, probes).collect()} == {"anthropic": (True, True), "gemini": (True, True), "openai": (True, True), "openai_compat": (False, True)}
    assert [settings.key_name(p) for p in (*extraction.PROVIDERS, "else")] == ["ANTHROPIC_API_KEY", "OPENAI_API_KEY", "GEMINI_API_KEY", "TOR_PROVIDER_API_KEY", "TOR_PROVIDER_API_KEY"]


def test_long_lists_are_paired_by_joins(spark):
    """The same leaves and lengths whichever way lists are paired."""
    from citeframe.catalog_documents import _documents, _predicted

    d = "/root/testdata/sf0.001"
    expected, actual = _documents(spark, d), _predicted(spark, d)
    assert documents.long_lists(expected, actual) is None
    partners = documents.long_lists(expected, actual, in_row=20).checkpoint()
    assert {r.path for r in partners.select("path").distinct().collect()} <= {"key_dates", "deliverables"} and partners.count() > 20
    told = lambda rows: sorted(map(tuple, rows.collect()))
    assert told(documents.score_document(expected, actual, partners)) == told(documents.score_document(expected, actual))
    assert told(documents.list_lengths(expected, actual, partners)) == told(documents.list_lengths(expected, actual))


@pytest.fixture(scope="module")
def many_customers(spark, tmp_path_factory):
    """4,000 customers, of whom 80 crash, 40 of them or more for a model."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.range(4000).select(F.col("id").alias("c_custkey")).write.parquet(f"{folder}/customer.parquet")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").write.parquet(f"{folder}/orders.parquet")
    return folder, ", ".join(sorted(str(k) for k in range(4000) if k % 50 == 0))


def test_provider_comparison_names_every_crashed_document(spark, many_customers):
    folder, names = many_customers
    assert {r.model: r.crashed for r in catalog.queries()["provider_comparison"](spark, folder).collect()} == {"a": names, "b": "none"}


def test_comparison_report_names_every_crashed_document(spark, many_customers):
    folder, names = many_customers
    assert {r["rank"]: r.line.split(" | ")[5] for r in catalog.queries()["comparison_report"](spark, folder).collect()} == {"anthropic/a": names, "anthropic/b": "none"}
