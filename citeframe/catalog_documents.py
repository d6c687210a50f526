"""Queries of whole documents: files in, extraction plans, scoring, reports and what a reader sees; each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe import schema as S
from citeframe import settings
from citeframe.functions import text as X
from citeframe.functions import thai
from citeframe.operators import blocks, derive, documents, facts, pages, pricing, score, validate
from citeframe.plans import extraction
from citeframe.shipping import ship
from citeframe.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- files ---------------------------------------------------------------------------------------------------

def _written(rows: DataFrame, make: str) -> DataFrame:
    """(doc_id, content): a file of each row (doc_id, parts array<array<string>>), made by a writer."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from citeframe.sources import writers

        for frame in frames:
            out = []
            for doc_id, parts in zip(frame["doc_id"], frame["parts"], strict=True):
                lines = [[x for x in p] for p in parts]
                if make == "docx":  # the first part as paragraphs, the others as the rows of a table between
                    content = writers.docx([*lines[0][:1], lines[1:], *lines[0][1:]])
                elif make == "xlsx":
                    content = writers.xlsx([("first", lines[::2]), ("second", lines[1::2]), ("third", [])])
                else:  # each part a page; an empty one is covered by an image
                    content = writers.pdf([(p, not p) for p in lines])
                out.append((doc_id, content))
            yield pd.DataFrame(out, columns=["doc_id", "content"])

    return rows.select("doc_id", "parts").mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, content binary")


def _lines(spark, d) -> DataFrame:
    """doc_id and the lines of documents, without what XML can't hold."""
    plain = F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    return _t(spark, d, "documents").select("doc_id", F.split(plain, "\n").alias("lines"))


_CLEAN = "regexp_replace(line, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
_LINES = f"""l as (select doc_id, pos, trim({_CLEAN}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(133)) as t from (
    select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents))"""


@_query(f"""with {_LINES}, p as (select doc_id, row_number() over (partition by doc_id order by pos) as n, t from l where t <> ''),
    c as (select doc_id, 1 as r, 1 as c, 'key' as t from documents union all select doc_id, 1, 2, cast(doc_id as varchar) from documents union all select doc_id, 2, 2, 'source' from documents)
    select cast(doc_id as varchar) as doc_id, 'paragraph' as kind, 'para:' || n as ref, t as text from p
    union all select cast(doc_id as varchar), 'table_cell', 't1:r' || r || ':c' || c, t from c""")
def docx_scan(spark, d):
    rows = _lines(spark, d).withColumn("parts", F.array("lines", F.array(F.lit("key"), F.col("doc_id").cast("string")), F.array(F.lit(" "), F.lit("source"))))
    return ingest.blocks(_written(rows, "docx"), cap=10**9).select("doc_id", "kind", "ref", "text")


def _sheets(spark, d) -> DataFrame:
    """Parts by brand: a row for each, of key, name and price."""
    row = F.struct("p_partkey", F.array(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_retailprice").cast("string")).alias("row"))
    return _t(spark, d, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.sort_array(F.collect_list(row))["row"].alias("parts"))


_CELLS = """p as (select *, row_number() over (partition by p_brand order by p_partkey) - 1 as n from part),
    c as (select p_brand as doc_id, case when n % 2 = 0 then 'first' else 'second' end as sheet, n // 2 + 1 as r, unnest([1, 2, 3]) as k, unnest([cast(p_partkey as varchar), p_name, cast(p_retailprice as varchar)]) as text from p)"""


@_query(f"""with {_CELLS} select doc_id, sheet, cast(r as int) as "row", cast(k as int) as col, chr(cast(64 + k as int)) || r as ref, text from c
    union all select p_brand, 'third', 0, 0, null, null from p group by 1
    union all select p_brand, 'second', 0, 0, null, null from p group by 1 having count(*) = 1""")
def xlsx_cells(spark, d):
    return ingest.cells(_written(_sheets(spark, d), "xlsx"), cap=10**9).select("doc_id", "sheet", "row", "col", "ref", "text")


@_query(f"""with {_CELLS}, l as (select doc_id, s, string_agg('[' || chr(cast(64 + k as int)) || r || '] ' || text, chr(10) order by r, k) as t from c join (values ('first', 0), ('second', 1)) as o(sheet, s) using (sheet) group by all),
    h as (select doc_id, s, chr(10) || '[ชีท: ' || ['first', 'second', 'third'][s + 1] || ']' as h from (select distinct p_brand as doc_id from part), (values (0), (1), (2)) as o(s))
    select doc_id, string_agg(h || coalesce(chr(10) || t, ''), chr(10) order by s) as document_text from h left join l using (doc_id, s) group by doc_id""")
def addressed_sheets(spark, d):
    rows = ingest.cells(_written(_sheets(spark, d), "xlsx"), cap=10**9)
    sheets = rows.select("doc_id", "sheet_idx", "sheet").distinct()
    return blocks.addressed_sheets(sheets, rows.filter("text is not null").select("doc_id", "sheet_idx", "row", "col", "ref", "text"))


def _paged(spark, d) -> DataFrame:
    """Conversations as PDF files: a page for each turn, of its ASCII lines; every fifth is an image only."""
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^\\x20-\\x7e\n]", "")
    line = F.filter(F.transform(F.split(ascii_, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    page = F.when(F.col("n") % 5 == 4, F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("turn "), F.col("n").cast("string"))), line))
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    numbered = turns.select(F.col("conv_id").alias("doc_id"), F.posexplode("t").alias("n", "x")).select("doc_id", "n", F.col("x.text").alias("text"))
    return numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", page.alias("p"))))["p"].alias("parts"))


_PAGED = """t as (select conv_id as doc_id, row_number() over (partition by conv_id order by turn, text) - 1 as n, regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e\\n]', '', 'g') as text from conversations),
    b as (select doc_id, n, 0 as k, 'turn ' || n as t from t where n % 5 <> 4 union all
        select doc_id, n, k, t from (select doc_id, n, trim(unnest(string_split(text, chr(10)))) as t, generate_subscripts(string_split(text, chr(10)), 1) as k from t where n % 5 <> 4) where t <> '')"""


@_query(f"""with {_PAGED} select cast(doc_id as varchar) as doc_id, cast(n + 1 as int) as page, t as text, cast(row_number() over (partition by doc_id order by n, k) as int) as seq from b""")
def pdf_scan(spark, d):
    return ingest.blocks(_written(_paged(spark, d), "pdf"), kind="pdf", cap=10**9).select("doc_id", "page", "text", "seq")


@_query(f"""with {_PAGED}, p as (select t.doc_id, t.n, case when t.n % 5 = 4 then 0 else (select length(string_agg(b.t, chr(10))) from b where b.doc_id = t.doc_id and b.n = t.n) end as chars from t),
    s as (select doc_id, n + 1 as page, chars, case when chars < 20 then 'image_only' else 'text' end as status from p)
    select cast(doc_id as varchar) as doc_id, count(*) as page_count, round(count(*) filter (status = 'text') / count(*), 4) as usable_text_page_ratio,
        coalesce(string_agg(page, ',' order by page) filter (status = 'image_only'), '') as image_only, cast(sum(chars) as bigint) as chars,
        case when bool_or(n % 5 = 4) then 1 else 0 end as covered, 'Helvetica' as fonts
    from s join (select doc_id as doc, n, n + 1 as pg from p) q on q.doc = s.doc_id and q.pg = s.page group by doc_id""")
def pdf_page_report(spark, d):
    report = pages.report(ingest.pdf_pages(_written(_paged(spark, d), "pdf")))
    more = report.groupBy("doc_id").agg(F.sum("text_chars").cast("bigint").alias("chars"), F.max((F.col("image_ratio") > 0.6).cast("int")).alias("covered"))
    meta = pages.pdf_meta(report).select("doc_id", "page_count", "usable_text_page_ratio", F.array_join(F.col("image_only_pages").cast("array<string>"), ",").alias("image_only"))
    return meta.join(more, "doc_id").join(pages.fonts_union(report).select("doc_id", F.array_join("fonts", ",").alias("fonts")), "doc_id")


@_query(f"""with {_PAGED}, p as (select t.doc_id, t.n, case when t.n % 5 = 4 then 0 else (select length(string_agg(b.t, chr(10))) from b where b.doc_id = t.doc_id and b.n = t.n) end as chars from t)
    select cast(doc_id as varchar) as doc_id, cast(n + 1 as int) as page from p where chars < 20""")
def pages_to_render(spark, d):
    return pages.to_render(pages.report(ingest.pdf_pages(_written(_paged(spark, d), "pdf"))))


@_query(f"""with {_PAGED} select cast(doc_id as varchar) as doc_id, cast(count(*) as bigint) as n_blocks, cast(0 as bigint) as n_anomalies, cast(1 as int) as n_fonts,
    string_agg('[p.' || (n + 1) || '] ' || t, chr(10) order by n, k) filter (rk <= 10) as lines
    from (select *, row_number() over (partition by doc_id order by n, k) as rk from b) group by doc_id""")
def scan_summary(spark, d):
    files = _written(_paged(spark, d), "pdf")
    report = pages.report(ingest.pdf_pages(files))
    made = pages.scan_summary(report, ingest.blocks(files, kind="pdf", cap=10**9).select("doc_id", "page", "seq", "text"))
    return made.select("doc_id", "n_blocks", "n_anomalies", "n_fonts", F.array_join("lines", "\n").alias("lines"))


def _uploads(spark, d) -> DataFrame:
    """Documents as files of several kinds, broken and empty ones among them."""
    k = F.col("doc_id") % 9
    rows = _lines(spark, d)
    some = lambda n, make, part: _written(rows.filter(k == n).withColumn("parts", part), make)
    one = F.array(F.lit("word"), F.col("doc_id").cast("string"))
    good = some(0, "pdf", F.array(one)).unionByName(some(1, "docx", F.array(one))).unionByName(some(2, "xlsx", F.array(one)))
    raw = F.when(k == 3, F.lit(b"")).when(k == 4, F.lit(b"plain text")).when(k == 5, F.lit(b"%PDF-1.7 and nothing more")).when(k == 6, F.lit(b"PK\x03\x04 not a zip")).when(k == 7, F.rpad(F.lit("%PDF"), 2000, "x").cast("binary"))
    return good.unionByName(rows.filter(k > 2).select("doc_id", raw.alias("content")))


@_query("""select cast(doc_id as varchar) as doc_id, case doc_id % 9 when 0 then 200 when 1 then 200 when 2 then 415 when 3 then 400 when 4 then 415 when 5 then 400 when 6 then 415 when 7 then 413 else 400 end as status,
    case doc_id % 9 when 0 then 'pdf' when 1 then 'docx' when 2 then 'xlsx' when 5 then 'pdf' end as document_kind, cast(case when doc_id % 9 < 1 then 2 when doc_id % 9 = 1 then 2 else 0 end as bigint) as n_blocks from documents""")
def document_dispatch(spark, d):
    found = ingest.dispatch(_uploads(spark, d), kinds=["pdf", "docx"], max_bytes=1900)
    return found.groupBy("doc_id").agg(F.max("status").alias("status"), F.max("document_kind").alias("document_kind"), F.count("seq").alias("n_blocks"))


@_query("""select cast(doc_id as varchar) as doc_id, case doc_id % 9 when 0 then 'pdf' when 1 then 'docx' else 'xlsx' end as document_kind,
    case doc_id % 9 when 0 then chr(10) || '[หน้า 1]' || chr(10) || 'word' || chr(10) || doc_id when 1 then '[para:1] word' || chr(10) || '[para:2] ' || doc_id
    else chr(10) || '[ชีท: first]' || chr(10) || '[A1] word' || chr(10) || '[B1] ' || doc_id || chr(10) || chr(10) || '[ชีท: second]' || chr(10) || chr(10) || '[ชีท: third]' end as document_text
    from documents where doc_id % 9 < 3""")
def dispatched_text(spark, d):
    return ingest.document_text(ingest.dispatch(_uploads(spark, d), kinds=list(ingest.KINDS)))


@_query("""select cast(doc_id as varchar) as doc_id, case doc_id % 9 when 0 then 'pdf' when 1 then 'docx' else 'xlsx' end as document_kind, cast(case when doc_id % 9 = 1 then 2 end as bigint) as paragraph_count,
    case when doc_id % 9 = 2 then 'first,second,third' end as sheet_names from documents where doc_id % 9 < 3""")
def ingest_meta(spark, d):
    made = ingest.meta(ingest.dispatch(_uploads(spark, d), kinds=list(ingest.KINDS)))
    return made.select("doc_id", "document_kind", "paragraph_count", F.array_join("sheet_names", ",").alias("sheet_names"))


# ---- documents -----------------------------------------------------------------------------------------------

def _documents(spark, d) -> DataFrame:
    from citeframe.catalog import _extracted

    return _extracted(spark, d)


def _predicted(spark, d) -> DataFrame:
    """The documents of _documents, with some values changed, lost, or added."""
    k = F.col("doc_id")
    changed = lambda leaf, value: leaf.withField("value", value)
    kept = F.filter("deliverables", lambda x, i: i % 3 != 1)
    return _documents(spark, d).withColumns({
        "project_name": changed(F.col("project_name"), F.when(k % 4 == 1, "something else").when(k % 4 != 2, F.col("project_name.value"))),
        "project_id": changed(F.col("project_id"), F.when(k % 5 == 0, "P")),
        "budget_amount": changed(F.col("budget_amount"), F.col("budget_amount.value") + F.when(k % 3 == 0, 0.001).when(k % 3 == 1, 1.0).otherwise(0.0)),
        "bid_bond": F.col("bid_bond").withField("accepted_forms.value", F.when(k % 2 == 0, F.array(F.lit("cash"))).otherwise(F.col("bid_bond.accepted_forms.value"))),
        "key_dates": F.when(k % 2 == 0, F.slice("key_dates", 2, 1_000_000)).otherwise(F.col("key_dates")),
        "deliverables": F.transform(kept, lambda x: x.withField("days_from_signing.value", x["days_from_signing"]["value"] + x["days_from_signing"]["value"] % 2)),
        "risk_flags": F.filter(F.array(F.when(k % 6 == 0, F.struct(F.lit("look").alias("text"), F.lit("model").alias("origin"), F.lit(None).cast(S.SOURCE).alias("source")))), lambda f: f.isNotNull()),
    })


_FIXED = ("agency", "announcement_date", "procurement_method", "median_price", "bid_bond.amount", "bid_bond.percent_stated", *[f"{b}.{f}" for b in ("contract_bond", "warranty_bond") for f in ("amount", "percent_stated", "accepted_forms")],
          "penalty.rate_percent_per_day", "penalty.cap_percent", "required_documents[]", *[f"evaluation_criteria.{f}" for f in ("method", "price_weight", "technical_weight", "sub_criteria")], *[f"contact.{f}" for f in ("name_redacted", "department", "phone", "email")])
_WALKED = f"""o as (select o_custkey as doc_id, o_orderkey as key, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, year(o_orderdate) as y, o_orderpriority as p, count(*) over (partition by o_custkey) as n from orders),
    c as (select c_custkey as k from customer where c_custkey in (select o_custkey from orders)),
    dates as (select a.doc_id, a.i, a.y, case when a.doc_id % 2 = 0 then b.y else a.y end as z, a.doc_id % 2 = 0 and a.i = a.n - 1 as alone from o a left join o b on b.doc_id = a.doc_id and b.i = a.i + 1),
    er as (select *, row_number() over (partition by doc_id, p order by i) as r from o), ar as (select *, row_number() over (partition by doc_id, p order by i) as r from o where i % 3 <> 1),
    items as (select e.doc_id, e.key, a.key as other from er e left join ar a using (doc_id, p, r)),
    v as (select k as doc_id, unnest({list(_FIXED)!r}) as path, 'exact' as verdict from c
        union all select k, 'project_name', case k % 4 when 1 then 'wrong' when 2 then 'missed' else 'exact' end from c
        union all select k, 'project_id', case when k % 5 = 0 then 'hallucinated' else 'exact' end from c
        union all select k, 'budget_amount', case when k % 3 = 1 then 'wrong' else 'exact' end from c
        union all select k, 'bid_bond.accepted_forms', case when k % 2 = 0 then 'wrong' else 'exact' end from c
        union all select doc_id, unnest(['key_dates[].type', 'key_dates[].date_be', 'key_dates[].time', 'key_dates[].location']), unnest([case when alone then 'missed' else 'exact' end, case when alone then 'missed' when y = z then 'exact' else 'wrong' end, 'exact', 'exact']) from dates
        union all select doc_id, unnest(['deliverables[].phase', 'deliverables[].description', 'deliverables[].days_from_signing', 'deliverables[].payment_percent']),
            unnest([case when other is null then 'missed' else 'exact' end, 'exact', case when other is null then 'missed' when other + other % 2 = key then 'exact' else 'wrong' end, 'exact']) from items)"""
_TALLY = ", ".join(f"cast(count(*) filter (verdict = '{v}') as bigint) as {v}" for v in score.VERDICTS)


@_query(f"with {_WALKED} select doc_id, path, {_TALLY} from v group by all")
def score_document(spark, d):
    return score.tally(documents.score_document(_documents(spark, d), _predicted(spark, d)), "doc_id", "path")


_LENGTHS = """e as (select doc_id, count(*) as n, count(*) filter (i % 3 <> 1) as m from o group by doc_id),
    g as (select doc_id, count(*) as missed from items where other is null group by doc_id),
    s as (select doc_id, 'deliverables' as path, n, m, coalesce(missed, 0) as missed, m - (n - coalesce(missed, 0)) as extra from e left join g using (doc_id)
        union all select doc_id, 'key_dates', n, n - 1, 1, 0 from e where doc_id % 2 = 0)"""


@_query(f"""with {_WALKED}, {_LENGTHS} select doc_id, path, cast(n as int) as n_expected, cast(m as int) as n_actual, cast(missed as int) as missed, cast(extra as int) as extra from s where missed > 0 or extra > 0""")
def list_lengths(spark, d):
    return documents.list_lengths(_documents(spark, d), _predicted(spark, d))


@_query("""select c_custkey as doc_id, 0 as expected, case when c_custkey % 6 = 0 then 1 else 0 end as actual from customer where c_custkey in (select o_custkey from orders)""")
def risk_flags_compared(spark, d):
    return documents.risk_flag_counts(_documents(spark, d), _predicted(spark, d))


def _runs(spark, d) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 8 == 0).alias("crashed")).filter("doc_id % 9 <> 1")


@_query("""select c_custkey as doc_id, case when c_custkey % 9 = 1 then 'skipped' when c_custkey % 8 = 0 then 'crashed' else 'scored' end as status from customer where c_custkey in (select o_custkey from orders)""")
def run_status(spark, d):
    return documents.run_status(_documents(spark, d).select("doc_id"), _runs(spark, d))


@_query(f"""with {_WALKED}, {_LENGTHS}, f as (select * from v where doc_id % 9 <> 1 and doc_id % 8 <> 0), t as (select path, {_TALLY} from f group by path),
    q as (select *, row_number() over (order by wrong + missed + hallucinated desc, path desc) as place from t)
    select 0 as part, cast(1 as bigint) as place, '# Evaluation of ' || count(distinct doc_id) || ' document(s)' as line from f
    union all select 1, place, '| ' || path || ' | ' || exact || ' | ' || wrong || ' | ' || missed || ' | ' || hallucinated || ' |' from q
    union all select 2, 1, '| total | ' || sum(exact) || ' | ' || sum(wrong) || ' | ' || sum(missed) || ' | ' || sum(hallucinated) || ' |' from q
    union all select 3, row_number() over (order by cast(k as varchar)), '| ' || k || ' | 0 | ' || case when k % 6 = 0 then 1 else 0 end || ' |' from c where k % 9 <> 1 and k % 8 <> 0
    union all select 4, row_number() over (order by cast(doc_id as varchar), path), '- ' || doc_id || ': ' || path || ': ' || n || ' expected, ' || m || ' actual, ' || missed || ' missed, ' || extra || ' extra (not penalised)'
        from s where (missed > 0 or extra > 0) and doc_id % 9 <> 1 and doc_id % 8 <> 0
    union all select 5, 1, 'cost $0.0400 (~฿1.46 @ 36.5, prices as of 2026-09-02)'""")
def evaluation_report(spark, d):
    from pyspark.sql import Window

    usage = spark.createDataFrame([("anthropic", "claude-haiku-4-5", 15_000, 5_000, 0, 0)], "provider string, model string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cached_read_tokens bigint")
    lines = documents.report(_documents(spark, d), _predicted(spark, d), _runs(spark, d), pricing.cost(usage))
    return lines.select("part", F.row_number().over(Window.partitionBy("part").orderBy("rank")).cast("bigint").alias("place"), "line")


@_query("""select 'anthropic/' || m as rank, '| anthropic/' || m || ' | ' || count(*) filter (v = 'exact') || ' | ' || count(*) filter (v = 'wrong') || ' | 0 | 0 | ' || coalesce(string_agg(o, ', ' order by o) filter (x), 'none') || ' | ' || case m when 'a' then '$' || printf('%.4f', 0.25 * count(*) filter (not x)) else 'unknown' end || ' |' as line
    from (select case when c_custkey % 2 = 0 then 'a' else 'b' end as m, cast(c_custkey as varchar) as o, c_custkey % 50 = 0 as x, case when c_custkey % 3 = 0 then 'wrong' else 'exact' end as v from customer) group by m""")
def comparison_report(spark, d):
    c = _t(spark, d, "customer").select(F.lit("anthropic").alias("provider"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("model"), F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 50 == 0).alias("crashed"), F.when(F.col("c_custkey") % 3 == 0, "wrong").otherwise("exact").alias("verdict"))
    runs = c.withColumn("usd", F.when((F.col("model") == "a") & ~F.col("crashed"), 0.25))
    return documents.comparison_lines(score.provider_summary(score.tally(c, "provider", "model"), runs, told=None)).select("rank", "line")


# ---- extraction ----------------------------------------------------------------------------------------------

def _answers(spark, d) -> DataFrame:
    """Two recorded answers for each group of each document, some malformed, broken or refused."""
    k, name, n = F.col("doc_id"), F.col("name"), F.col("attempt")
    made = F.array(*[F.struct(F.lit(g).alias("name"), F.to_json(F.struct(*[F.col(f.name) for f in t.fields])).alias("json")) for g, t in S.GROUPS.items()])
    rows = _documents(spark, d).select("doc_id", F.inline(made)).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    json = (
        F.when((name == "bonds") & ((n == 1) & (k % 5 == 0) | (k % 10 == 0)), "{not json")
        .when((name == "misc") & (n == 1) & (k % 7 == 0), F.replace("json", F.lit('"confidence":"high"'), F.lit('"confidence":"sure"')))
        .when((name == "qualifications") & (n == 1) & (k % 4 == 3), '{"qualifications": null}').otherwise(F.col("json"))
    )
    model = F.when(name == "bonds", "claude-opus-5").when(name == "misc", "gemini-3.6-flash").otherwise("claude-haiku-4-5")
    rows = rows.filter(~((k % 19 == 0) & (name == "misc")))
    return rows.select("doc_id", "name", "attempt", F.when(name == "misc", "gemini").otherwise("anthropic").alias("provider"), model.alias("model"), json.alias("json"), F.when((name == "key_dates") & (n == 1) & (k % 11 == 0), "auth").alias("error"), (n * 4000).cast("bigint").alias("input_tokens"), F.lit(400).cast("bigint").alias("output_tokens"), F.lit(0).cast("bigint").alias("cache_write_tokens"), F.lit(0).cast("bigint").alias("cached_read_tokens"), (n * 10).cast("bigint").alias("duration_ms"))


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("doc_id")
    docs = _documents(spark, d).select("doc_id", F.when(k % 13 == 0, "odt").otherwise("docx").alias("kind"), F.when(k % 17 == 0, 1).otherwise(0).alias("n_images"))
    own = spark.createDataFrame([("bonds", "anthropic", "claude-opus-5"), ("misc", "gemini", "gemini-3.6-flash")], "name string, provider string, model string")
    resolved = extraction.resolve(extraction.groups(spark), own, "anthropic", "claude-haiku-4-5")
    able = extraction.providers(spark).withColumn("vision", F.col("provider") != "gemini")
    return extraction.extract_documents(docs, _answers(spark, d), resolved, able, extraction.kind_rules(spark))


_OUTCOME = """c as (select c_custkey as k, c_name from customer where c_custkey in (select o_custkey from orders)),
    r as (select k, c_name, case when k % 13 = 0 then 'rules' when k % 17 = 0 then 'gate' when k % 11 = 0 then 'key_dates' when k % 10 = 0 then 'bonds' when k % 19 = 0 then 'misc' end as stage from c)"""


@_query(f"""with {_OUTCOME}, a as (select *, case when k % 5 = 0 then 2 else 1 end as b, case when k % 7 = 0 then 2 else 1 end as m, case when k % 4 = 3 then 2 else 1 end as q from r where stage is null)
    select k as doc_id, c_name as project_name, (select count(*) from orders where o_custkey = k) as n_dates, 'mixed' as provider, 'anthropic/claude-haiku-4-5,anthropic/claude-opus-5,gemini/gemini-3.6-flash' as model,
    cast(4000 * (3 + b + m + q) as bigint) as input_tokens, cast(10 * (3 + b + m + q) as bigint) as duration_ms, cast(4000 * (3 + q) * 1 + 4 * 400 * 5 + 4000 * b * 5 + 400 * 25 + 3000 * m + 1500 as bigint) as micro_usd from a""")
def extract_documents(spark, d):
    done, _ = _plan(spark, d)
    return done.select("doc_id", F.col("project_name.value").alias("project_name"), F.size("key_dates").cast("bigint").alias("n_dates"), "provider", "model", "input_tokens", "duration_ms", F.round(F.col("usd") * 1_000_000).cast("bigint").alias("micro_usd"))


@_query(f"""with {_OUTCOME} select k as doc_id, stage, case stage when 'rules' then 'validation' when 'gate' then 'unsupported' when 'key_dates' then 'auth' when 'bonds' then 'validation' else 'api' end as code,
    case stage when 'key_dates' then 500 else 502 end as status, case stage when 'rules' then 'no rules for odt' when 'gate' then 'misc: sees no images' when 'key_dates' then '' when 'bonds' then 'bonds malformed' else 'no answer' end as detail from r where stage is not null""")
def rejects(spark, d):
    return _plan(spark, d)[1].select("doc_id", "stage", "code", "status", "detail")


@_query("""with o as (select o_custkey as doc_id, count(*) as n from orders group by 1)
    select doc_id, 'key_dates[].type' as path, 'not_allowed' as code, n from o where doc_id % 3 = 0 union all select doc_id, 'contact.phone', 'reason_missing', 1 from o where doc_id % 4 = 0
    union all select doc_id, 'risk_flags[]', 'page_missing', 1 from o where doc_id % 5 = 0 union all select doc_id, 'deliverables', 'missing', 1 from o where doc_id % 7 = 0""")
def leaf_errors(spark, d):
    k = F.col("doc_id")
    page = F.struct(F.lit("text_page").alias("kind"), F.lit("q").alias("quote"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("ref"))
    broken = _documents(spark, d).withColumns({
        "key_dates": F.transform("key_dates", lambda x: x.withField("type.value", F.when(k % 3 == 0, "someday").otherwise(x["type"]["value"]))),
        "contact": F.col("contact").withField("phone.reason", F.when(k % 4 == 0, "").otherwise("not told")),
        "risk_flags": F.array(F.struct(F.lit("t").alias("text"), F.lit("model").alias("origin"), F.when(k % 5 == 0, page).alias("source"))),
        "deliverables": F.when(k % 7 != 0, F.col("deliverables")),
    })
    return extraction.leaf_errors(broken).groupBy("doc_id", "path", "code").agg(F.count("*").alias("n"))


@_query("""select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'xlsx' else 'odt' end as kind, case doc_id % 4 when 0 then 'page' when 1 then 'block' when 2 then 'cell' end as rules from documents""")
def source_rules(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("pdf", "docx", "xlsx", "odt")])
    return extraction.rules_for(_t(spark, d, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind")), extraction.kind_rules(spark)).select("doc_id", "kind", "rules")


@_query("""with e as (select 'p' || user_id % 30 as provider, user_id % 30 as u, event_id % 400 = 0 as failed from events)
    select provider, not bool_or(failed) as structured, u % 2 = 0 as vision from e group by provider, u""")
def capability_probe(spark, d):
    provider = F.concat(F.lit("p"), (F.col("user_id") % 30).cast("string")).alias("provider")
    probes = _t(spark, d, "events").select(provider, F.when(F.col("event_id") % 400 == 0, "no schema").alias("error"))
    able = _t(spark, d, "events").select(provider, F.lit(True).alias("structured"), (F.col("user_id") % 30 % 2 == 0).alias("vision")).distinct()
    return extraction.probed(able, probes).select("provider", "structured", "vision")


@_query("""with e as (select 'p' || user_id % 4 as provider, 'g' || event_id % 3 as name, case when event_id % 5 = 0 then 'api' when event_id % 7 = 0 then 'crash' end as error from events)
    select provider, name, case when bool_or(error = 'crash') then 'FAILED' when bool_or(error = 'api') then 'REJECTED' else 'OK' end as outcome from e group by all""")
def schema_ceiling(spark, d):
    error = F.when(F.col("event_id") % 5 == 0, "api").when(F.col("event_id") % 7 == 0, "crash")
    return extraction.schema_ceiling(_t(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"), F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("name"), error.alias("error")))


@_query("""select 'anthropic' as vendor, event_id, 10 + event_id % 7 as i, 5 + event_id % 3 as o, event_id % 5 as w, event_id % 4 as r from events where event_id % 4 = 0
    union all select 'openai', event_id, 10 + event_id % 7, 5 + event_id % 3, event_id % 5, event_id % 4 from events where event_id % 4 = 1
    union all select 'gemini', event_id, 10 + event_id % 7, 5 + event_id % 3 + event_id % 11, 0, event_id % 4 from events where event_id % 4 = 2
    union all select 'openai_compat', event_id, 10 + event_id % 7, 5 + event_id % 3, 0, 0 from events where event_id % 4 = 3""")
def usage_vendors(spark, d):
    k = F.col("event_id")
    i, o, w, r, t = 10 + k % 7, 5 + k % 3, k % 5, k % 4, k % 11
    counters = lambda **c: F.create_map(*[x for n, v in c.items() for x in (F.lit(n), v.cast("bigint"))])
    vendor = F.element_at(F.array(*[F.lit(x) for x in extraction.PROVIDERS]), (k % 4 + 1).cast("int"))
    raw = (
        F.when(k % 4 == 0, counters(input_tokens=i, output_tokens=o, cache_creation_input_tokens=w, cache_read_input_tokens=r))
        .when(k % 4 == 1, counters(prompt_tokens=i, completion_tokens=o, cache_write_tokens=w, cached_tokens=r))
        .when(k % 4 == 2, counters(prompt_token_count=i, candidates_token_count=o, thoughts_token_count=t, cached_content_token_count=r))
        .otherwise(counters(prompt_tokens=i, completion_tokens=o))
    )
    rows = _t(spark, d, "events").select(vendor.alias("vendor"), "event_id", extraction.usage(vendor, raw).alias("u"))
    return rows.select("vendor", "event_id", F.col("u.input_tokens").alias("i"), F.col("u.output_tokens").alias("o"), F.col("u.cache_write_tokens").alias("w"), F.col("u.cached_read_tokens").alias("r"))


@_query("""select doc_id, md5(concat('rules|true', case when doc_id % 3 <> 0 then '#kind|true' else '' end, case when text <> '' then '#' || text || '|true' else '' end, '#do', case when doc_id % 2 = 0 then chr(10) || chr(10) || 'error' else '' end, '|false')) as told from documents""")
def prompt_contents(spark, d):
    b = extraction.prompt_blocks(F.lit("rules"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("kind"), F.col("text"), F.lit("do"), F.when(F.col("doc_id") % 2 == 0, "error"))
    return _t(spark, d, "documents").select("doc_id", F.md5(F.array_join(F.transform(b, lambda x: F.concat(x["text"], F.lit("|"), x["cacheable"].cast("string"))), "#")).alias("told"))


@_query("""select doc_id, string_agg('[หน้า ' || (doc_id + p) || ' — ภาพหน้าเอกสารที่สแกน]|', '' order by p) filter (p < doc_id % 4) as captions, cast(2 * (doc_id % 4) + 1 as int) as n, cast(case when doc_id % 4 > 0 then 1 else 0 end as int) as cached
    from documents, (values (0), (1), (2)) as t(p) group by doc_id""")
def image_content(spark, d):
    images = F.transform(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda p: p < F.col("doc_id") % 4), lambda p: F.struct((F.col("doc_id") + p).alias("page"), F.lit("image/jpeg").alias("media_type"), F.lit(b"x").alias("content")))
    rows = _t(spark, d, "documents").select("doc_id", extraction.user_content(images, F.lit("do it")).alias("b"))
    told = F.transform(F.filter("b", lambda x: x["text"].startswith("[")), lambda x: F.concat(x["text"], F.lit("|")))
    return rows.select("doc_id", F.nullif(F.array_join(told, ""), F.lit("")).alias("captions"), F.size("b").alias("n"), F.size(F.filter("b", lambda x: x["cacheable"])).alias("cached"))


# ---- facts and what is shown ---------------------------------------------------------------------------------

@_query("""with o as (select o_custkey as doc_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as i, year(o_orderdate) as y, o_orderpriority as p from orders),
    c as (select c_custkey as doc_id, c_name from customer where c_custkey in (select o_custkey from orders)), gone as (select 'ไม่พบ — not in text' as g),
    r as (select doc_id, 'basic_info' as section, 'project_name' as label, c_name as shown, true as clickable, 'high' as confidence from c
    union all select doc_id, 'basic_info', 'budget_amount', format('{:,}', doc_id * 8), true, 'high' from c
    union all select doc_id, 'basic_info', unnest(['project_id', 'agency', 'announcement_date', 'procurement_method', 'median_price']), g, false, 'high' from c, gone
    union all select doc_id, 'key_dates', '[' || i || '] type', 'ประกาศผล', true, 'high' from o union all select doc_id, 'key_dates', '[' || i || '] date_be', (y + 543) || '-01-02', true, 'high' from o
    union all select doc_id, 'key_dates', '[' || i || '] date_ce', y || '-01-02', false, 'คำนวณโดยระบบ' from o union all select doc_id, 'key_dates', '[' || i || '] ' || unnest(['time', 'location']), g, false, 'high' from o, gone
    union all select doc_id, b, 'amount', case when doc_id % 3 = 0 then g else format('{:,}', doc_id * n) end, doc_id % 3 <> 0, 'high' from c, gone, (values ('bid_bond', 1), ('contract_bond', 2), ('warranty_bond', 4)) as t(b, n)
    union all select doc_id, b, 'percent_stated', g, false, 'high' from c, gone, (values ('bid_bond'), ('contract_bond'), ('warranty_bond')) as t(b)
    union all select doc_id, b, 'accepted_forms', 'cash, bank''s', true, 'high' from c, (values ('bid_bond'), ('contract_bond'), ('warranty_bond')) as t(b)
    union all select doc_id, b, 'percent_of_budget_calculated', case when doc_id % 3 = 0 then 'คำนวณไม่ได้ — คำนวณไม่ได้ (ไม่มี amount หรือ budget_amount)' else n || '%' end, false, 'คำนวณโดยระบบ' from c, (values ('bid_bond', '12.5'), ('contract_bond', '25'), ('warranty_bond', '50')) as t(b, n)
    union all select doc_id, 'deliverables', '[' || i || '] phase', p, true, 'high' from o union all select doc_id, 'deliverables', '[' || i || '] days_from_signing', format('{:,}', o_orderkey), true, 'high' from o
    union all select doc_id, 'deliverables', '[' || i || '] ' || unnest(['description', 'payment_percent']), g, false, 'high' from o, gone
    union all select doc_id, 'required_documents', '[1] document', 'form', true, 'high' from c
    union all select doc_id, 'penalty', unnest(['rate_percent_per_day', 'cap_percent']), g, false, 'high' from c, gone
    union all select doc_id, 'evaluation_criteria', unnest(['method', 'price_weight', 'technical_weight', 'sub_criteria']), g, false, 'high' from c, gone
    union all select doc_id, 'contact', unnest(['name_redacted', 'department', 'phone', 'email']), g, false, 'high' from c, gone)
    select *, case when clickable then 'ย่อหน้าที่ 1' else '' end as place from r""")
def result_table(spark, d):
    return facts.result_table(facts.flatten(derive.assemble(_documents(spark, d)))).drop("seq")


@_query("""with o as (select o_custkey as doc_id, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as varchar) as i, year(o_orderdate) as y, o_orderpriority as p from orders),
    c as (select c_custkey as doc_id, c_name from customer where c_custkey in (select o_custkey from orders)), bonds as (select * from (values ('bid_bond', 1, '12.5'), ('contract_bond', 2, '25.0'), ('warranty_bond', 4, '50.0')) as t(b, n, pc)),
    r as (select doc_id, 'basic_info' as section, '' as "index", 'project_name' as field, c_name as value, 1 as how from c
    union all select doc_id, 'basic_info', '', 'budget_amount', cast(cast(doc_id * 8 as double) as varchar), 1 from c
    union all select doc_id, 'basic_info', '', unnest(['project_id', 'agency', 'announcement_date', 'procurement_method', 'median_price']), '', 0 from c
    union all select doc_id, 'key_dates', i, unnest(['type', 'date_be', 'time', 'location', 'date_ce']), unnest(['ประกาศผล', (y + 543) || '-01-02', '', '', y || '-01-02']), unnest([1, 1, 0, 0, 2]) from o
    union all select doc_id, b, '', 'amount', case when doc_id % 3 = 0 then '' else cast(cast(doc_id * n as double) as varchar) end, case when doc_id % 3 = 0 then 0 else 1 end from c, bonds
    union all select doc_id, b, '', 'percent_stated', '', 0 from c, bonds union all select doc_id, b, '', 'accepted_forms', '[''cash'', "bank''s"]', 1 from c, bonds
    union all select doc_id, b, '', 'percent_of_budget_calculated', case when doc_id % 3 = 0 then '' else pc end, case when doc_id % 3 = 0 then 3 else 2 end from c, bonds
    union all select doc_id, 'deliverables', i, unnest(['phase', 'description', 'days_from_signing', 'payment_percent']), unnest([p, '', cast(cast(o_orderkey as double) as varchar), '']), unnest([1, 0, 1, 0]) from o
    union all select doc_id, 'required_documents', '0', 'document', 'form', 1 from c
    union all select doc_id, 'penalty', '', unnest(['rate_percent_per_day', 'cap_percent']), '', 0 from c
    union all select doc_id, 'evaluation_criteria', '', unnest(['method', 'price_weight', 'technical_weight', 'sub_criteria']), '', 0 from c
    union all select doc_id, 'contact', '', unnest(['name_redacted', 'department', 'phone', 'email']), '', 0 from c)
    select doc_id, section, "index", field, value, case when how = 1 then 'paragraph' else '' end as locator_kind, case when how = 1 then 'ย่อหน้าที่ 1' else '' end as locator, case when how = 1 then 'q' else '' end as quote,
    case when how < 2 then 'high' else '' end as confidence, case how when 0 then 'not in text' when 3 then 'คำนวณไม่ได้ (ไม่มี amount หรือ budget_amount)' else '' end as reason from r""")
def facts_csv_cells(spark, d):
    return facts.csv_rows(facts.flatten(derive.assemble(_documents(spark, d)))).drop("seq")


@_query("""select page_id, cast(length(url) as bigint) as pinned, cast(length(url) + case when page_id % 3 = 0 then 1 else 0 end as bigint) as found from pages where page_id % 3 = 0""")
def size_drift(spark, d):
    rows = _t(spark, d, "pages").select("page_id", F.length("url").cast("bigint").alias("pinned"), (F.length("url") + F.when(F.col("page_id") % 3 == 0, 1).otherwise(0)).cast("bigint").alias("found"))
    return ingest.size_drift(rows.select("page_id", "pinned"), rows.select("page_id", "found"), "page_id")


@_query("""select o_custkey as doc_id, cast(n as bigint) as flags, cast(n + 1 as bigint) as with_model, 'ราคากลาง: ตัวเลข (' || format('{:,.2f}', a) || ') กับจำนวนที่สะกดเป็นตัวอักษร (' || format('{:,.2f}', a - 2) || ') ในข้อความเดียวกันไม่ตรงกัน — ต้องตรวจสอบกับต้นฉบับ' as told
    from (select o_custkey, 1 as n, (o_custkey + 12)::double as a from orders group by o_custkey) where o_custkey % 2 = 0
    union all select o_custkey, cast(0 as bigint), cast(1 as bigint), null from orders where o_custkey % 2 = 1 group by o_custkey""")
def assembled_flags(spark, d):
    k = F.col("doc_id")
    words = thai.words_of((k + 10).cast("bigint"))
    price = F.col("median_price").withField("value", (k + 10 + F.when(k % 2 == 0, 2).otherwise(1)).cast("double")).withField("source", F.struct(F.lit("paragraph").alias("kind"), F.concat(F.lit("("), words, F.lit("บาทถ้วน)")).alias("quote"), F.lit(None).cast("int").alias("page"), F.lit("para:2").alias("ref")))
    own = F.array(F.struct(F.lit("of the model").alias("text"), F.lit("model").alias("origin"), F.lit(None).cast(S.SOURCE).alias("source")))
    flags = derive.assemble(_documents(spark, d).withColumns({"median_price": price, "risk_flags": own})).select("doc_id", "risk_flags")
    derived = F.filter("risk_flags", lambda f: f["origin"] == "derived")
    return flags.select("doc_id", F.size(derived).cast("bigint").alias("flags"), F.size("risk_flags").cast("bigint").alias("with_model"), F.get(derived, F.lit(0))["text"].alias("told"))


@_query("""select doc_id, 'token: input ' || format('{:,}', doc_id * 1000) || ' · output ' || format('{:,}', doc_id) || ' · cache write 0 · cache read 0' as tokens,
    'ค่าใช้จ่ายประมาณการ: $' || case when doc_id % 2 = 0 then printf('%.4f', doc_id / 100.0) else '0.0000' end || ' (~฿' || case when doc_id % 2 = 0 then printf('%.2f', doc_id * 1.0) else '0.00' end || ' @ ' || case when doc_id % 2 = 0 then '36.5 ณ 2026-08-28' else '0 ณ ' end || ') · p/m · ' || printf('%.1f', doc_id % 1000 + 0.5) || ' วินาที' as cost,
    'docx' as document_kind, cast(n_chars as bigint) as paragraph_count, case when doc_id % 2 = 0 then '2026-09-02' else 'unknown' end as pricing_as_of from documents""")
def usage_footer(spark, d):
    k = F.col("doc_id")
    known = lambda x: F.when(k % 2 == 0, x)
    docs = _t(spark, d, "documents").select("doc_id", F.lit("p").alias("provider"), F.lit("m").alias("model"), known(F.lit("2026-09-02")).alias("pricing_as_of"), (k % 1000 * 1000 + 500).cast("bigint").alias("duration_ms"), (k * 1000).alias("input_tokens"), k.alias("output_tokens"), F.lit(0).alias("cache_write_tokens"), F.lit(0).alias("cached_read_tokens"), known(k / 100.0).alias("usd"), known(k * 1.0).alias("thb"), known(F.lit(36.5)).alias("usd_thb_rate"), known(F.lit("2026-08-28")).alias("rate_source_date"))
    meta = derive.ingest_meta("docx", _t(spark, d, "documents"), paragraph_count=F.col("n_chars"))
    done = derive.with_meta(docs, meta, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    m = F.col("extraction_meta")
    return facts.usage_footer(done).join(done.select("doc_id", m["document_kind"].alias("document_kind"), m["paragraph_count"].alias("paragraph_count"), m["pricing_as_of"].alias("pricing_as_of")), "doc_id")


@_query("""select c_custkey as doc_id, '{"doc_id":' || c_custkey || ',"name":"' || c_name || '","segment":' || case when c_custkey % 3 = 0 then 'null' else '"' || c_mktsegment || '"' end || ',"forms":["a","b"]}' as json from customer""")
def json_sink(spark, d):
    return facts.json_rows(_t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.array(F.lit("a"), F.lit("b")).alias("forms")))


@_query("""select c_custkey as doc_id, case when c_custkey % 7 = 0 then null else c_name end as project_name, case when c_custkey % 7 = 0 then null else cast(c_custkey as double) end as budget, case when c_custkey % 7 = 0 then null else cast(2 as int) end as documents, case when c_custkey % 7 <> 0 then 1.5::double end as percent from customer""")
def golden_parse(spark, d):
    k = F.col("c_custkey")
    leaf = lambda v: F.concat(F.lit('{"value": '), v, F.lit(', "source": {"page": 1, "quote": "q"}, "confidence": "high", "reason": null}'))
    json = F.concat(F.lit('{"project_name": '), leaf(F.concat(F.lit('"'), F.col("c_name"), F.lit('"'))), F.lit(', "budget_amount": '), leaf(k.cast("string")), F.lit(', "required_documents": ['), leaf(F.lit('"a"')), F.lit(","), leaf(F.lit('"b"')), F.lit('], "bid_bond_percent_of_budget": 1.5}'))
    rows = ingest.parse_golden(_t(spark, d, "customer").select(k.alias("doc_id"), F.when(k % 7 != 0, json).alias("json")))
    return rows.select("doc_id", F.col("project_name.value").alias("project_name"), F.col("budget_amount.value").alias("budget"), F.when(F.col("required_documents").isNotNull(), F.size("required_documents")).alias("documents"), F.col("bid_bond_percent_of_budget").alias("percent"))


@_query("""select 1 as doc_id, 'S' || (p_partkey % 3) as sheet, 'A,B,AA' as columns, cast(count(*) as bigint) as n_rows, cast(min(p_partkey // 3) as int) as first from part group by all""")
def grid_axes(spark, d):
    from citeframe.catalog import _cells

    return blocks.grid_axes(_cells(spark, d), ["doc_id", "sheet"]).select("doc_id", "sheet", F.array_join("columns", ",").alias("columns"), F.size("rows").cast("bigint").alias("n_rows"), F.element_at("rows", 1).alias("first"))


@_query("""select 'S' || (p_partkey % 3) as sheet, cast(p_partkey // 3 as int) as "row", cast(p_partkey as varchar) as "A", p_name as "B", case when p_retailprice = floor(p_retailprice) then cast(cast(p_retailprice as bigint) as varchar) else cast(p_retailprice as varchar) end as "AA" from part""")
def grid_columns(spark, d):
    from citeframe.catalog import _cells

    return blocks.grid(_cells(spark, d), ["sheet"], ["AA", "B", "A"])


@_query("""select p_partkey as seq, case p_partkey % 4 when 0 then 'Sheet!' || p_partkey % 3 when 3 then null else 'S' || p_partkey % 3 end as sheet, case when p_partkey % 4 = 1 then 'ZZ9' when p_partkey % 4 = 3 then null else 'A' || p_partkey // 3 end as cell,
    p_partkey % 4 in (1, 2) as sheet_found, p_partkey % 4 = 2 as resolved from part""")
def cell_citations(spark, d):
    from citeframe.catalog import _cells

    k = F.col("p_partkey")
    here = F.concat(F.lit("S"), (k % 3).cast("string"))
    own = F.concat(F.lit("A"), F.floor(k / 3).cast("string"))
    ref = F.when(k % 4 == 0, F.concat(F.lit("Sheet!"), (k % 3).cast("string"), F.lit("!"), own)).when(k % 4 == 1, F.concat(here, F.lit("!ZZ9"))).when(k % 4 == 2, F.concat(here, F.lit("!"), own)).otherwise("no mark")
    cited = _t(spark, d, "part").select(F.lit(1).alias("doc_id"), k.alias("seq"), F.lit("cell_xlsx").alias("kind"), ref.alias("ref"))
    return facts.resolve_cells(cited, _cells(spark, d)).select("seq", "sheet", "cell", "sheet_found", "resolved")


@_query("""select p_brand as doc_id, p_partkey as seq, min(p_partkey) over (partition by p_brand, p_partkey % 5, case p_partkey % 5 when 0 then p_partkey % 3 when 1 then p_partkey % 3 else p_partkey % 2 end) as class from part where p_partkey % 6 <> 0""")
def source_classes(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in S.SOURCE_KINDS]), (k % 5 + 1).cast("int"))
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("doc_id"), k.alias("seq"), F.when(k % 6 != 0, kind).alias("kind"), F.when(k % 5 < 2, (k % 3).cast("int")).alias("page"), F.when(k % 5 >= 2, F.concat(F.lit("r"), (k % 2).cast("string"))).alias("ref"), F.lit("the same").alias("quote"))
    return facts.source_classes(rows)


@_query("""select o_orderkey, case when m = 3 then null else 'x' end as known, cast(case when m = 3 then 0 else round((i * [5, 1, 3][m + 1] + r * [5, 1, 3][m + 1] // 10 + o * [25, 5, 15][m + 1]) * 41 / 1000000.0, 2) * 100 end as bigint) as satang, case when m = 3 then '' else '2030-01-01' end as told
    from (select o_orderkey, o_orderkey % 4 as m, o_orderkey % 1000 * 1000 as i, o_orderkey % 100 * 1000 as o, o_orderkey % 10 * 10000 as r from orders)""")
def baht_cost(spark, d):
    from citeframe.catalog import _usage

    at = settings.load({"USD_THB_RATE": "41", "USD_THB_RATE_DATE": "2030-01-01"})
    rows = pricing.with_default(pricing.cost(_usage(spark, d), at.fx_rate, at.fx_date))
    return rows.select("o_orderkey", F.when(F.col("pricing_as_of") != "unknown", "x").alias("known"), F.round(F.round("thb", 2) * 100).cast("bigint").alias("satang"), F.col("rate_source_date").alias("told"))


@_query("""select o_orderkey, format('{:,}', o_orderkey * 1000 + 1) as number, 'a, b' as list, case when o_orderkey % 2 = 0 then '' else 'v' end as text, case o_orderkey % 3 when 0 then 'result' when 1 then 'refused' else 'error' end as notice, 'x|y' as origins from orders""")
def shown_values(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(F.lit(200), F.lit(422), F.lit(415)), (k % 3 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", X.view_value("num", k * 1000.0 + 1).alias("number"), X.view_value("arr", F.array(F.lit("a"), F.lit("b"))).alias("list"), X.view_value("str", F.when(k % 2 == 1, "v")).alias("text"), X.notice(status).alias("notice"), F.array_join(X.split_list(F.lit(" x ,, y,")), "|").alias("origins"))


@_query("""select s_suppkey, ['anthropic', 'openai', 'gemini', 'openai_compat', s_name][s_suppkey % 5 + 1] as provider, ['ANTHROPIC_API_KEY', 'OPENAI_API_KEY', 'GEMINI_API_KEY', 'TOR_PROVIDER_API_KEY', 'TOR_PROVIDER_API_KEY'][s_suppkey % 5 + 1] as name from supplier""")
def key_names(spark, d):
    provider = F.get(F.array(*[F.lit(p) for p in extraction.PROVIDERS], F.col("s_name")), (F.col("s_suppkey") % 5).cast("int"))
    named = F.create_map(*[F.lit(x) for p in extraction.PROVIDERS for x in (p, settings.key_name(p))])
    return _t(spark, d, "supplier").select("s_suppkey", provider.alias("provider"), F.coalesce(F.try_element_at(named, provider), F.lit(settings.key_name("else"))).alias("name"))


@_query("""select doc_id, cast(pages as bigint) as pages, cast(bytes as bigint) as bytes from (select source as doc_id, count(*) as pages, sum(octet_length(encode(text))) as bytes from documents group by source) where pages > 20 or bytes > 20971520""")
def vision_caps(spark, d):
    return blocks.vision_over_cap(_t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.encode("text", "UTF-8").alias("content"))).select("doc_id", "pages", F.col("bytes").cast("bigint").alias("bytes"))


@_query("""with c as (select count(distinct o_custkey) as n from orders join customer on c_custkey = o_custkey)
    select name, cast(properties as int) as properties, true as strict, n as answers from c, (values ('basic_info', 7), ('key_dates', 1), ('bonds', 3), ('qualifications', 1), ('deliverables', 1), ('misc', 5)) as t(name, properties)""")
def strict_schema(spark, d):
    """Each group's JSON Schema, and how many documents' answers have just its properties."""
    def strict(node: dict) -> bool:
        inner = [*node.get("properties", {}).values(), *([node["items"]] if "items" in node else [])]
        return all(map(strict, inner)) and (node["type"] != "object" or (node["additionalProperties"] is False and node["required"] == list(node["properties"])))

    made = {n: S.json_schema(t) for n, t in S.GROUPS.items()}
    own = lambda n: F.struct(F.lit(n).alias("name"), F.lit(len(made[n]["properties"])).alias("properties"), F.lit(strict(made[n])).alias("strict"), F.array(*[F.lit(p) for p in made[n]["properties"]]).alias("keys"), F.json_object_keys(F.to_json(F.struct(*[F.col(f.name) for f in S.GROUPS[n].fields]), {"ignoreNullFields": "false"})).alias("given"))
    rows = _documents(spark, d).select(F.inline(F.array(*[own(n) for n in made])))
    return rows.groupBy("name", "properties", "strict").agg(F.count_if(F.col("keys") == F.col("given")).alias("answers"))


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
