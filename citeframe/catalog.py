"""Queries of the base library over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe import catalog_documents, catalog_flows
from citeframe.functions import text as X
from citeframe.functions import thai
from citeframe.operators import blocks, derive, facts, highlight, matching, pages, pricing, score, validate
from citeframe.plans import extraction
from citeframe.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODELS = "['claude-opus-5', 'claude-haiku-4-5', 'claude-sonnet-4-6', 'unknown-model']"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def queries() -> dict[str, Query]:
    return _Q | catalog_documents.queries() | catalog_flows.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | catalog_documents.oracle_sql() | catalog_flows.oracle_sql()


# ---- sources -------------------------------------------------------------------------------------------------

@_query("select page_id, case when page_id % 3 = 0 then 'pdf' else 'unsupported' end as kind from pages")
def sniff_kind(spark, d):
    from citeframe.sources.ingest import sniff

    ship(spark)
    rows = _t(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("%PDF-1.7"), "url")).otherwise(F.col("url")).cast("binary").alias("content"))
    return rows.select("page_id", sniff(F.col("content")).alias("kind"))


@_query("select doc_id, case doc_id % 3 when 0 then 'pdf' when 1 then 'docx' else 'xlsx' end as kind, doc_id % 3 <> 2 as enabled from documents")
def kind_dispatch_gate(spark, d):
    from citeframe.sources.ingest import supported

    kind = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("xlsx")), (F.col("doc_id") % 3 + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", kind.alias("kind"), kind.isin(*supported({})).alias("enabled"))


@_query("""select doc_id, case when doc_id % 11 = 0 then 500 when n_chars > 5000 then 413 when n_chars < 50 then 400
    when doc_id % 7 = 0 then 415 when doc_id % 5 = 0 then 415 when doc_id % 13 > 11 then 422 when doc_id % 17 = 1 then 400 else 200 end as status from documents""")
def upload_guards(spark, d):
    i = F.col("doc_id")
    size = F.when(F.col("n_chars") < 50, 0).otherwise(F.col("n_chars"))
    kind = F.when(i % 7 == 0, "unsupported").otherwise("pdf")
    status = extraction.upload_status(i % 11 != 0, size, kind, i % 5 != 0, i % 13, F.lit(11), i % 17 != 1, 5000)
    return _t(spark, d, "documents").select("doc_id", status.alias("status"))


@_query("""select doc_id, cast(row_number() over (partition by doc_id order by pos) as int) as seq, 'para:' || row_number() over (partition by doc_id order by pos) as ref, t as text
    from (select doc_id, pos, trim(line) as t from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)) where t <> ''""")
def docx_blocks(spark, d):
    return blocks.paragraphs(_t(spark, d, "documents")).select("doc_id", "seq", "ref", "text")


@_query("""select doc_id, string_agg('[para:' || seq || '] ' || t, chr(10) order by seq) as document_text from (
    select doc_id, row_number() over (partition by doc_id order by pos) as seq, t from (
    select doc_id, pos, trim(line) as t from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)) where t <> '') group by doc_id""")
def docx_document_text(spark, d):
    return blocks.paragraph_text(_t(spark, d, "documents"))


@_query("""with r as (select conv_id as doc_id, turn, text, turn // 2 + 1 as page, lag(turn // 2 + 1) over (partition by conv_id order by turn, text) as before
    from conversations where trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
    select doc_id, string_agg(case when before = page then '' else chr(10) || '[หน้า ' || page || ']' || chr(10) end || text, chr(10) order by turn, text) as document_text from r group by doc_id""")
def document_text(spark, d):
    return pages.marked_text(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), (F.floor(F.col("turn") / 2) + 1).alias("page"), "text"))


def _cells(spark, d):
    p = _t(spark, d, "part")
    name = F.col("p_partkey").cast("string")
    return p.select(F.lit(1).alias("doc_id"), F.concat(F.lit("S"), (F.col("p_partkey") % 3).cast("string")).alias("sheet"), F.floor(F.col("p_partkey") / 3).cast("int").alias("row"), F.explode(F.arrays_zip(F.array(F.lit("A"), F.lit("B"), F.lit("AA")).alias("col"), F.array(name, F.col("p_name"), X.number_text(F.col("p_retailprice"))).alias("value"))).alias("c")).select("doc_id", "sheet", "row", F.col("c.col").alias("col"), F.concat("c.col", F.col("row").cast("string")).alias("ref"), F.col("c.value").alias("value"))


@_query("""with c as (select 'S' || (p_partkey % 3) as sheet, p_partkey // 3 as r, unnest(['A', 'AA', 'B']) as c from part)
    select sheet, c || r as ref, count(*) over (partition by sheet) > 20 as truncated from c qualify row_number() over (partition by sheet order by r, c) <= 20""")
def preview_truncate(spark, d):
    return blocks.preview(_cells(spark, d), 20).select("sheet", "ref", "truncated")


@_query("""select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then case when o_orderkey % 8 = 1 then 'TRUE' else 'FALSE' end
    when o_orderkey % 4 = 2 then cast(o_orderkey as varchar) else cast(cast(o_orderkey as double) + 0.5 as varchar) end as text from orders""")
def cell_to_text(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 1, X.bool_text(k % 8 == 1)).when(k % 4 == 2, X.number_text(k.cast("double"))).when(k % 4 == 3, X.number_text(k.cast("double") + 0.5)).alias("text"))


@_query("""select doc_id, cast(n as bigint) as units from (select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as n from documents) where n > 20""")
def size_caps(spark, d):
    return blocks.over_cap(blocks.paragraphs(_t(spark, d, "documents")), 20)


# ---- Thai text -----------------------------------------------------------------------------------------------

@_query("select doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) as h from documents")
def nfc_normalize(spark, d):
    ship(spark)
    return _t(spark, d, "documents").select("doc_id", F.md5(thai.nfc(F.replace("text", F.lit("é"), F.lit("é")))).alias("h"))


@_query("select o_orderkey, cast(o_orderkey as varchar) as digits from orders")
def thai_digits(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", thai.arabic_digits(F.translate(F.col("o_orderkey").cast("string"), "0123456789", thai.THAI_DIGITS)).alias("digits"))


@_query("""select o_orderkey, case when o_orderkey % 10 = 0 then '' else 'x' || year(o_orderdate) || '-03-15 2569' end as date_ce from orders""")
def be_to_ce_date(spark, d):
    y = F.year("o_orderdate") + thai.ERA
    raw = F.when(F.col("o_orderkey") % 10 == 0, F.lit("1999")).otherwise(F.concat(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, F.translate(y.cast("string"), "0123456789", thai.THAI_DIGITS)).otherwise(y.cast("string")), F.lit("-03-15 2569")))
    # Thai digits are made Arabic before dates are read, as everywhere in the pipeline
    return _t(spark, d, "orders").select("o_orderkey", F.coalesce(thai.be_date_to_ce(thai.arabic_digits(raw)), F.lit("")).alias("date_ce"))


@_query("""select p_partkey, cast(case p_partkey % 4 when 0 then 0 when 1 then 1 when 2 then 0 else 2 end as int) as n from part""")
def glyph_anomalies(spark, d):
    rows = F.element_at(F.array(F.lit("้ำกลุ่ม"), F.lit("น ้าทิ้ง"), F.lit("น้ำ ที่"), F.lit("a่b ี")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", thai.glyph_anomaly_count(rows).alias("n"))


_TOKENS = 7
_FOLD = """list_reduce(list_prepend({'t': 0::bigint, 's': 0::bigint, 'd': null::bigint, 'v': 0::bigint}, list_transform(k, lambda i: {'t': 0::bigint, 's': 0::bigint, 'd': null::bigint, 'v': vals[i]})), lambda a, x:
    case when x.v < 10 then {'t': a.t, 's': a.s, 'd': x.v, 'v': 0::bigint} when x.v < 1000000 then {'t': a.t, 's': a.s + coalesce(a.d, 1) * x.v, 'd': null::bigint, 'v': 0::bigint}
    else {'t': a.t + case when a.s + coalesce(a.d, 0) = 0 then 1 else a.s + coalesce(a.d, 0) end * 1000000, 's': 0::bigint, 'd': null::bigint, 'v': 0::bigint} end)"""


@_query(f"""with w as (select {list(thai.NUMBER_WORDS)!r} as names, {list(thai.NUMBER_WORDS.values())!r}::bigint[] as vals),
    k as (select o_orderkey, list_transform(range(1, {_TOKENS + 1}), lambda i: cast((o_orderkey * (i + 3) * 7919 // (i * i)) % len(names) + 1 as int)) as k, names, vals from orders, w),
    f as (select o_orderkey, 'จำนวน ' || array_to_string(list_transform(k, lambda i: names[i]), ' ') || ' บาทถ้วน' as words, {_FOLD} as r from k)
    select o_orderkey, words, r.t + r.s + coalesce(r.d, 0) as parsed from f""")
def number_words(spark, d):
    names = F.array(*[F.lit(x) for x in thai.NUMBER_WORDS])
    word = F.transform(F.sequence(F.lit(1), F.lit(_TOKENS)), lambda i: F.element_at(names, (F.floor(F.col("o_orderkey") * (i + 3) * 7919 / (i * i)).cast("bigint") % F.size(names) + 1).cast("int")))
    words = F.concat(F.lit("จำนวน "), F.array_join(word, " "), F.lit(" บาทถ้วน"))
    return _t(spark, d, "orders").select("o_orderkey", words.alias("words"), thai.number_words(words).alias("parsed"))


@_query("""select o_orderkey, cast(o_orderkey * 37 + 1 as bigint) as n, cast(o_orderkey * 37 + 1 as bigint) as parsed from orders""")
def number_words_composed(spark, d):
    n = (F.col("o_orderkey") * 37 + 1).cast("bigint")
    return _t(spark, d, "orders").select("o_orderkey", n.alias("n"), thai.number_words(F.concat(F.lit("จำนวน "), thai.words_of(n), F.lit("บาทถ้วน"))).alias("parsed"))


_QUIRKS = {"สามารถ": 3, "พันธบัตร": 1000, "ยี่ห้อ": 2, "หนึ่งล้านล้าน": 2_000_000, "ศูนย์ล้าน": 1_000_000, "ร้อยละ 5 (ห้าหมื่น)": 100, "ยี่สิบเอ็ด": 21, "ไม่มี": None}


@_query(f"select o_orderkey, ({list(_QUIRKS)!r})[o_orderkey % 8 + 1] || repeat(' x', o_orderkey % 3) as words, ([3, 1000, 2, 2000000, 1000000, 100, 21, null]::int[])[o_orderkey % 8 + 1] as n from orders")
def number_words_quirks(spark, d):
    k = F.col("o_orderkey")
    words = F.concat(F.get(F.array(*[F.lit(w) for w in _QUIRKS]), k % 8), F.repeat(F.lit(" x"), (k % 3).cast("int")))
    return _t(spark, d, "orders").select("o_orderkey", words.alias("words"), thai.number_words(words).cast("int").alias("n"))


# ---- pages ---------------------------------------------------------------------------------------------------

@_query("""select doc_id, case when n_chars % 50 < 20 then 'image_only' when doc_id % 10 < 3 then 'text' else 'mixed' end as status from documents""")
def page_classify(spark, d):
    return _t(spark, d, "documents").select("doc_id", pages.page_status(F.col("n_chars") % 50, (F.col("doc_id") % 10) / 10.0).alias("status"))


@_query("""with p as (select source as doc_id, case when n_chars % 50 < 20 then 'image_only' when doc_id % 10 < 3 then 'text' else 'mixed' end as status from documents)
    select doc_id, count(*) as page_count, count(*) filter (status = 'text') as text_pages, count(*) filter (status = 'mixed') as mixed_pages,
    count(*) filter (status = 'image_only') as image_only_pages, count(*) filter (status <> 'image_only') / count(*) as usable_ratio from p group by doc_id""")
def scan_report(spark, d):
    rows = _t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), pages.page_status(F.col("n_chars") % 50, (F.col("doc_id") % 10) / 10.0).alias("status"))
    return pages.summary(rows).drop("image_only_list")


@_query("""select p_partkey, least(1.0::double, (greatest(0.0::double, 50.0 - p_partkey % 60)::double * 40.0 + greatest(0.0::double, (p_partkey % 7)::double) * 10.0) / 1000.0) as ratio from part""")
def image_coverage(spark, d):
    k = F.col("p_partkey")
    box = lambda x0, y0, x1, y1: F.struct(*[v.cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])
    boxes = F.array(box(k % 60, F.lit(0), F.lit(50), F.lit(40)), box(F.lit(0), F.lit(0), k % 7, F.lit(10)))
    return _t(spark, d, "part").select("p_partkey", pages.image_ratio(boxes, F.lit(1000.0)).alias("ratio"))


# ---- derivations and cost ------------------------------------------------------------------------------------

@_query("select o_orderkey, case when o_orderkey % 9 = 0 then null else o_orderkey % 9 * 12.5::double end as percent from orders")
def bond_percent(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", derive.bond_percent((k % 9 * 50).cast("double"), F.when(k % 9 != 0, F.lit(400.0)).otherwise(0.0)).alias("percent"))


@_query("select o_orderkey, o_orderkey % 4 > 1 as flagged from orders")
def amount_cross_check(spark, d):
    n = (F.col("o_orderkey") + 10).cast("bigint")
    quote = F.concat(n.cast("string"), F.lit(" บาท ("), thai.words_of(n), F.lit("บาทถ้วน)"))
    leaf = F.struct((n + F.col("o_orderkey") % 4).cast("double").alias("value"), F.struct(F.lit("text_page").alias("kind"), quote.alias("quote"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("ref")).alias("source"))
    return _t(spark, d, "orders").withColumn("leaf", leaf).select("o_orderkey", derive.amount_flag("ราคากลาง", F.col("leaf")).isNotNull().alias("flagged"))


def _usage(spark, d):
    k = F.col("o_orderkey")
    model = F.element_at(F.array(*[F.lit(m) for m in ("claude-opus-5", "claude-haiku-4-5", "claude-sonnet-4-6", "unknown-model")]), (k % 4 + 1).cast("int"))
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.lit("anthropic").alias("provider"), model.alias("model"), (k % 1000 * 1000).alias("input_tokens"), (k % 100 * 1000).alias("output_tokens"), F.lit(0).alias("cache_write_tokens"), (k % 10 * 10000).alias("cached_read_tokens"))


_USAGE = f"""u as (select o_custkey as doc_id, o_orderkey, {MODELS}[o_orderkey % 4 + 1] as model, o_orderkey % 1000 * 1000 as i, o_orderkey % 100 * 1000 as o, o_orderkey % 10 * 10000 as r from orders),
    p as (select * from (values ('claude-opus-5', 5, 25), ('claude-haiku-4-5', 1, 5), ('claude-sonnet-4-6', 3, 15)) as t(model, pi, po))"""


@_query(f"with {_USAGE} select o_orderkey, cast(i * pi + r * pi // 10 + o * po as bigint) as micro_usd from u left join p using (model)")
def usage_cost(spark, d):
    return pricing.cost(_usage(spark, d)).select("o_orderkey", F.round(F.col("usd") * 1_000_000).cast("bigint").alias("micro_usd"))


@_query(f"""with {_USAGE}, g as (select doc_id, model, sum(i) as i, sum(o) as o, sum(r) as r from u group by all)
    select doc_id, case when count(*) = 1 then 'anthropic' else 'mixed' end as provider,
    case when count(*) = 1 then max(model) else string_agg('anthropic/' || model, ',' order by model) end as model,
    cast(case when bool_or(pi is null) then null else sum(i * pi + r * pi // 10 + o * po) end as bigint) as micro_usd from g left join p using (model) group by doc_id""")
def mixed_cost(spark, d):
    return pricing.mixed_cost(pricing.cost(pricing.usage_by_pair(_usage(spark, d)))).select("doc_id", "provider", "model", F.round(F.col("usd") * 1_000_000).cast("bigint").alias("micro_usd"))


@_query("select o_orderkey, case when o_orderkey % 4 = 3 then 'unknown' else '2026-09-02' end as pricing_as_of, case when o_orderkey % 4 = 3 then 0.0 else 36.5 end::double as usd_thb_rate from orders")
def unknown_cost_default(spark, d):
    return pricing.with_default(pricing.cost(_usage(spark, d))).select("o_orderkey", "pricing_as_of", "usd_thb_rate")


@_query("""select user_id, count(*) * 10 as input_tokens, cast(sum(5 + case when event_id % 2 = 0 then 7 else 0 end) as bigint) as output_tokens from events group by user_id""")
def usage_mapping(spark, d):
    even = F.col("event_id") % 2 == 0
    raw = F.when(even, F.create_map(F.lit("prompt_token_count"), F.lit(10), F.lit("candidates_token_count"), F.lit(5), F.lit("thoughts_token_count"), F.lit(7))).otherwise(F.create_map(F.lit("input_tokens"), F.lit(10), F.lit("output_tokens"), F.lit(5)))
    rows = _t(spark, d, "events").select("user_id", extraction.usage(F.when(even, "gemini").otherwise("anthropic"), raw).alias("u"))
    return rows.groupBy("user_id").agg(F.sum("u.input_tokens").alias("input_tokens"), F.sum("u.output_tokens").alias("output_tokens"))


# ---- citations and facts -------------------------------------------------------------------------------------

@_query("""select p_partkey, 'Sheet!' || (p_partkey % 5) as sheet, chr(cast(65 + p_partkey % 26 as int)) || p_partkey as cell from part""")
def parse_cell_ref(spark, d):
    ref = F.concat(F.lit("Sheet!"), (F.col("p_partkey") % 5).cast("string"), F.lit("!"), F.chr(65 + F.col("p_partkey") % 26), F.col("p_partkey").cast("string"))
    return _t(spark, d, "part").select("p_partkey", X.cell_sheet(ref).alias("sheet"), X.cell_ref(ref).alias("cell"))


def _sources(spark, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text_page", "vision_page", "paragraph", "table_cell_docx", "cell_xlsx")]), (k % 5 + 1).cast("int"))
    page = F.when(k % 5 < 2, (k % 40).cast("int"))
    ref = F.when(k % 5 == 2, F.concat(F.lit("para:"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("t1:r"), k.cast("string"), F.lit(":c2"))).when(k % 5 == 4, F.concat(F.lit("S1!B"), k.cast("string")))
    return _t(spark, d, "part").select("p_partkey", kind.alias("kind"), page.alias("page"), ref.alias("ref"), F.lit("q").alias("quote"))


@_query("""select p_partkey, case p_partkey % 5 when 0 then 'หน้า ' || (p_partkey % 40) when 1 then 'หน้า ' || (p_partkey % 40) || ' (อ่านจากภาพสแกน)' when 2 then 'ย่อหน้าที่ ' || p_partkey
    when 3 then 'ตารางที่ 1 แถว ' || p_partkey || ' คอลัมน์ 2' else 'S1!B' || p_partkey end as exported,
    case p_partkey % 5 when 1 then 'หน้า ' || (p_partkey % 40) || ' (ภาพสแกน)' when 0 then 'หน้า ' || (p_partkey % 40) when 2 then 'ย่อหน้าที่ ' || p_partkey
    when 3 then 'ตารางที่ 1 แถว ' || p_partkey || ' คอลัมน์ 2' else 'S1!B' || p_partkey end as viewed, p_partkey % 5 < 2 as is_page, p_partkey % 5 = 1 as is_vision from part""")
def locator_format(spark, d):
    k, p, r = F.col("kind"), F.col("page"), F.col("ref")
    return _sources(spark, d).select("p_partkey", X.locator(k, p, r).alias("exported"), X.locator(k, p, r, viewer=True).alias("viewed"), X.is_page(k).alias("is_page"), X.is_vision(k).alias("is_vision"))


@_query("""select p_partkey, case when p_partkey % 7 = 0 then 'kind_unknown' when p_partkey % 5 < 2 and p_partkey % 6 = 1 then 'ref_on_page'
    when p_partkey % 5 >= 2 and p_partkey % 6 = 1 then 'ref_malformed' when p_partkey % 5 < 2 and p_partkey % 6 = 2 then 'page_missing'
    when p_partkey % 5 >= 2 and p_partkey % 6 = 2 then 'ref_missing' when p_partkey % 5 >= 2 and p_partkey % 6 = 3 then 'page_on_ref' end as code from part""")
def source_validate(spark, d):
    k = F.col("p_partkey")
    s = _sources(spark, d).withColumns({
        "kind": F.when(k % 7 == 0, "other").otherwise(F.col("kind")),
        "ref": F.when(k % 6 == 1, "no such place").when((k % 6 != 2) | (k % 5 < 2), F.col("ref")),
        "page": F.when((k % 6 == 3) & (k % 5 >= 2), 9).when(~((k % 6 == 2) & (k % 5 < 2)), F.col("page")),
    })
    return s.select("p_partkey", validate.source_error(F.struct("kind", "quote", "page", "ref")).alias("code"))


@_query("""select p_partkey, case when p_partkey % 5 = 0 then 'confidence' when p_partkey % 4 = 1 then 'reason_missing' when p_partkey % 4 = 2 then 'source_missing' end as code from part""")
def sourced_validate(spark, d):
    k = F.col("p_partkey")
    good = F.struct(F.lit("text_page").alias("kind"), F.lit("").alias("quote"), F.lit(0).alias("page"), F.lit(None).cast("string").alias("ref"))
    leaf = F.struct(F.when(~(k % 4).isin(0, 1), k).alias("value"), F.when(k % 4 != 2, good).alias("source"), F.when(k % 5 != 0, "high").alias("confidence"), F.when(k % 4 == 0, "not told").otherwise("").alias("reason"))
    return _t(spark, d, "part").withColumn("leaf", leaf).select("p_partkey", validate.sourced_error(F.col("leaf")).alias("code"))


def _extracted(spark, d):
    """Customers and their orders as nested documents."""
    from citeframe import schema as S

    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")))).alias("orders"))
    c = _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    none = F.lit(None).cast("string")

    source = "struct<kind:string,quote:string,page:int,ref:string>"
    src = F.struct(F.lit("paragraph"), F.lit("q"), F.lit(None), F.lit("para:1")).cast(source)
    gone, nothing, high, why = F.lit(True), F.lit(None), F.lit("high"), F.lit("not in text")

    def leaf(v, t, null=None):
        parts = (nothing, nothing, high, why) if null is gone else (v, src, high, nothing) if null is None else (F.when(~null, v), F.when(~null, src), high, F.when(null, why))
        return F.struct(*parts).cast(f"struct<value:{t},source:{source},confidence:string,reason:string>")

    bond = lambda n: F.struct(leaf(F.col("c_custkey") * n, "double", F.col("c_custkey") % 3 == 0).alias("amount"), leaf(none, "double", gone).alias("percent_stated"), leaf(F.array(F.lit("cash"), F.lit("bank's")), "array<string>").alias("accepted_forms"))
    fields = {f.name: leaf(none, f.dataType["value"].dataType.simpleString(), gone) for f in S.GROUPS["basic_info"].fields}
    fields |= {"project_name": leaf(F.col("c_name"), "string"), "budget_amount": leaf(F.col("c_custkey") * 8, "double")}
    fields |= {"key_dates": F.transform("orders", lambda x: F.struct(leaf(F.lit("ประกาศผล"), "string").alias("type"), leaf(F.concat((x["y"] + 543).cast("string"), F.lit("-01-02")), "string").alias("date_be"), leaf(none, "string", gone).alias("time"), leaf(none, "string", gone).alias("location")))}
    fields |= {b: bond(n) for b, n in zip(S.BONDS, (1, 2, 4), strict=True)}
    fields |= {"qualifications": F.array().cast(f"array<{S.QUALIFICATION.simpleString()}>")}
    fields |= {"deliverables": F.transform("orders", lambda x: F.struct(leaf(x["p"], "string").alias("phase"), leaf(none, "string", gone).alias("description"), leaf(x["o_orderkey"], "int").alias("days_from_signing"), leaf(none, "double", gone).alias("payment_percent")))}
    misc = S.GROUPS["misc"]
    for name in ("penalty", "evaluation_criteria", "contact"):
        fields[name] = F.struct(*[leaf(none, f.dataType["value"].dataType.simpleString(), gone).alias(f.name) for f in misc[name].dataType.fields])
    fields |= {"required_documents": F.array(leaf(F.lit("form"), "string")), "risk_flags": F.array().cast(f"array<{S.RISK_FLAG.simpleString()}>")}
    return c.select(F.col("c_custkey").alias("doc_id"), *[v.alias(k) for k, v in fields.items()])


@_query("""with o as (select o_custkey as doc_id, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as idx, year(o_orderdate) as y, o_orderpriority as p from orders),
    c as (select c_custkey as doc_id, c_name from customer where c_custkey in (select o_custkey from orders))
    select doc_id, 'basic_info' as section, null::int as idx, 'project_name' as field, c_name as v from c
    union all select doc_id, 'basic_info', null, 'budget_amount', cast(doc_id * 8 as varchar) from c
    union all select doc_id, 'key_dates', idx, 'date_be', (y + 543) || '-01-02' from o union all select doc_id, 'key_dates', idx, 'date_ce', y || '-01-02' from o
    union all select doc_id, 'key_dates', idx, 'type', 'ประกาศผล' from o
    union all select doc_id, b, null, 'amount', cast(doc_id * n as varchar) from c, (values ('bid_bond', 1), ('contract_bond', 2), ('warranty_bond', 4)) as t(b, n) where doc_id % 3 <> 0
    union all select doc_id, b, null, 'percent_of_budget_calculated', cast(n as varchar) from c, (values ('bid_bond', '12.5'), ('contract_bond', '25'), ('warranty_bond', '50')) as t(b, n) where doc_id % 3 <> 0
    union all select doc_id, b, null, 'accepted_forms', '[''cash'', "bank''s"]' from c, (values ('bid_bond'), ('contract_bond'), ('warranty_bond')) as t(b)
    union all select doc_id, 'deliverables', idx, 'phase', p from o union all select doc_id, 'deliverables', idx, 'days_from_signing', cast(o_orderkey as varchar) from o
    union all select doc_id, 'required_documents', 0, 'document', 'form' from c""")
def flatten_facts(spark, d):
    rows = facts.flatten(derive.assemble(_extracted(spark, d)))
    value = F.coalesce("v_str", X.list_text(F.col("v_arr")), X.number_text(F.col("v_num")))
    return rows.select("doc_id", "section", "idx", "field", value.alias("v")).filter("v is not null")


@_query("""with n as (select c_custkey as doc_id, (select count(*) from orders where o_custkey = c_custkey) as k from customer)
    select doc_id, cast(29 + 5 * k + 4 * k + 1 as bigint) as n_rows, cast(3 as bigint) as lists from n where k > 0""")
def facts_csv_rows(spark, d):
    rows = facts.csv_rows(facts.flatten(derive.assemble(_extracted(spark, d))))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value").startswith("[")).alias("lists"))


def _cited(spark, d):
    b = blocks.paragraphs(_t(spark, d, "documents"))
    f = b.select("doc_id", "seq", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("para:"), (F.col("seq") + 100000).cast("string"))).otherwise(F.col("ref")).alias("ref"), F.when(F.col("seq") % 3 == 0, F.lit("\u0001")).otherwise(F.col("text")).alias("quote"))
    return f, b


@_query("""with b as (select source, doc_id, row_number() over (partition by doc_id order by pos) as seq from (select source, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) where trim(line) <> '')
    select source, count(*) as citations, count(*) filter (seq % 5 <> 0) as resolved, count(*) filter (seq % 5 <> 0 and seq % 3 <> 0) as quoted from b group by source""")
def citation_resolves(spark, d):
    f, b = _cited(spark, d)
    by = _t(spark, d, "documents").select("doc_id", "source")
    return facts.resolve(f, b).join(by, "doc_id").groupBy("source").agg(F.count("*").alias("citations"), F.count_if("resolved").alias("resolved"), F.count_if("quoted").alias("quoted"))


@_query("""with b as (select doc_id, trim(line) as text, row_number() over (partition by doc_id order by pos) as seq from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) where trim(line) <> ''),
    q as (select doc_id, seq, b.text, case when seq % 3 = 0 then coalesce(m.text, '') else replace(b.text, ' ', '  ') end as quote from b left join benchmark m on m.item_id = seq % 50),
    s as (select doc_id, seq, trim(regexp_replace('a  ' || quote || ' z', '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as quote, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as text from q)
    select doc_id, cast(seq as int) as seq, text <> '' and contains(quote, text) as hit from s""")
def quote_highlight_blocks(spark, d):
    ship(spark)
    b = blocks.paragraphs(_t(spark, d, "documents"))
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("of"), F.col("text").alias("other"))
    quoted = b.join(items, F.col("seq") % 50 == F.col("of"), "left")
    quote = F.when(F.col("seq") % 3 == 0, F.coalesce("other", F.lit(""))).otherwise(F.replace("text", F.lit(" "), F.lit("  ")))
    return quoted.select("doc_id", F.col("seq").cast("int").alias("seq"), X.highlights(F.concat(F.lit("a  "), quote, F.lit(" z")), F.col("text")).alias("hit"))


_PLAIN = "trim(regexp_replace({}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@_query(f"""with b as (select doc_id, trim(line) as text, row_number() over (partition by doc_id order by pos) as seq from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) where trim(line) <> ''),
    q as (select doc_id, seq, {_PLAIN.format("case when seq % 4 = 0 then substr(text, 1, 40) else text || ' ' || coalesce(lead(text) over (partition by doc_id order by seq), '') end")} as quote from b),
    i as (select doc_id, generate_subscripts(string_split(text, '.'), 1) - 1 as item, {_PLAIN.format("unnest(string_split(text, '.'))")} as t from documents)
    select q.doc_id, cast(q.seq as bigint) as quote, string_agg(i.item, ',' order by i.item) as marked from q join i on i.doc_id = q.doc_id and i.t <> '' and contains(q.quote, i.t) group by all""")
def highlight_items(spark, d):
    docs = _t(spark, d, "documents")
    items = docs.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("item", "text"))
    # a paragraph with the next one, or the beginning of one
    told = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda s: X.strip(s)), lambda s: s != ""), lambda s: F.replace(s, F.lit(" "), F.lit("  ")))
    rows = docs.select("doc_id", told.alias("t")).select("doc_id", "t", F.posexplode("t").alias("k", "s"))
    text = F.when((F.col("k") + 1) % 4 == 0, F.substring(F.replace("s", F.lit("  "), F.lit(" ")), 1, 40)).otherwise(F.concat("s", F.lit("\t"), F.coalesce(F.get("t", F.col("k") + 1), F.lit(""))))
    quotes = rows.select("doc_id", (F.col("k") + 1).alias("quote"), text.alias("text"))
    found = highlight.highlight_items(items, quotes)
    return found.filter(F.size("marked") > 0).select("doc_id", "quote", F.array_join(F.col("marked").cast("array<string>"), ",").alias("marked"))


# ---- extraction ----------------------------------------------------------------------------------------------

@_query("""select 'TOR_GROUP_P' || p_partkey as key, 'p' || p_partkey as name, case when p_partkey % 4 = 0 then 'gemini' else 'openai' end as provider, case when p_partkey % 4 = 0 then 'g:1' else p_name end as model
    from part where p_partkey % 4 < 2""")
def override_parse(spark, d):
    k = F.col("p_partkey")
    value = F.when(k % 4 == 0, "gemini:g:1").when(k % 4 == 1, F.concat(F.lit("openai:"), F.col("p_name"))).when(k % 4 == 2, "openai:").otherwise(":m")
    env = _t(spark, d, "part").select(F.concat(F.lit("TOR_GROUP_P"), k.cast("string")).alias("key"), value.alias("value"))
    other = _t(spark, d, "part").select(F.concat(F.lit("OTHER_"), k.cast("string")).alias("key"), F.lit("a:b").alias("value"))
    return extraction.parse_overrides(env.unionByName(other)).select(F.concat(F.lit("TOR_GROUP_"), F.upper("name")).alias("key"), "name", "provider", "model")


def _part_groups(spark, d):
    """Parts as groups, some of which override the provider: (groups, overrides)."""
    p = _t(spark, d, "part")
    k, name = F.col("p_partkey"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("name")
    provider = F.get(F.array(*[F.lit(x) for x in ("openai_compat", "nobody", "gemini")]), (F.floor(k / 3) % 3).cast("int"))
    return p.select(k.cast("int").alias("ordinal"), name, F.lit(8000).alias("max_tokens")), p.filter(k % 3 == 0).select(name, provider.alias("provider"), F.col("p_brand").alias("model"))


_RESOLVED = "select 'g' || p_partkey as name, case when p_partkey % 3 > 0 then 'anthropic' else ['openai_compat', 'nobody', 'gemini'][p_partkey // 3 % 3 + 1] end as provider, case when p_partkey % 3 > 0 then 'm' else p_brand end as model from part"


def _overrides(spark):
    return spark.createDataFrame([("bonds", "openai_compat", "local"), ("misc", "gemini", "g")], "name string, provider string, model string")


@_query(_RESOLVED)
def resolve_groups(spark, d):
    return extraction.resolve(*_part_groups(spark, d), "anthropic", "m").select("name", "provider", "model")


@_query("""select doc_id, 'bonds' as "group" from documents where doc_id % 4 = 0""")
def vision_gate(spark, d):
    resolved = extraction.resolve(extraction.groups(spark), _overrides(spark), "anthropic", "m")
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, 2).otherwise(0).alias("n_images"))
    return extraction.vision_gate(docs, resolved, extraction.providers(spark))


@_query(f"select name, provider from ({_RESOLVED}) where provider = 'nobody'")
def capability_gate(spark, d):
    return extraction.capability_gate(extraction.resolve(*_part_groups(spark, d), "anthropic", "m"), extraction.providers(spark)).select("name", "provider")


@_query(f"select name, provider from ({_RESOLVED}) where provider in ('nobody', 'gemini')")
def unresolved_groups(spark, d):
    return extraction.unresolved(extraction.resolve(*_part_groups(spark, d), "anthropic", "m"), "anthropic", ["openai_compat"])


def _responses(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    error = F.when((k + n) % 5 == 0, "validation").when((k + n) % 7 == 0, "auth")
    return _t(spark, d, "lineitem").select(k.alias("doc_id"), F.lit("g").alias("name"), n.alias("attempt"), error.alias("error"), F.lit(10).alias("duration_ms"))


@_query("""with r as (select l_orderkey as doc_id, l_linenumber as attempt, case when (l_orderkey + l_linenumber) % 5 = 0 then 'validation' when (l_orderkey + l_linenumber) % 7 = 0 then 'auth' end as error,
      row_number() over (partition by l_orderkey order by l_linenumber) as n from lineitem),
    s as (select *, coalesce(max(case when error = 'auth' then 1 else 0 end) over (partition by doc_id order by attempt rows between unbounded preceding and 1 preceding), 0) as stop from r)
    select doc_id, cast(min(attempt) as bigint) as attempt from s where n <= 2 and stop = 0 and error is null group by doc_id""")
def retry_select(spark, d):
    return extraction.select_attempts(_responses(spark, d)).select("doc_id", F.col("attempt").cast("bigint").alias("attempt"))


@_query("""select o_custkey as doc_id, count(*) * 10 as duration_ms from orders group by o_custkey having count(distinct o_orderpriority) = 5""")
def all_or_nothing(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name"), F.lit(10).alias("duration_ms"))
    return extraction.complete(rows, 5)


@_query("""select o_custkey as doc_id, o_orderpriority as key, arg_max(o_orderstatus || o_orderkey, o_orderkey) as value from orders group by all""")
def group_merge(spark, d):
    return extraction.merge_keys(_t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("key"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("value")))


@_query("""select event_id, case event_id % 7 when 0 then 504 when 1 then 502 when 2 then 500 when 3 then 429 when 4 then 502 when 5 then 502 end as status from events""")
def error_status(spark, d):
    names = F.array(*[F.lit(x) for x in ("timeout", "validation", "auth", "rate_limit", "unsupported", "api", "none")])
    return _t(spark, d, "events").select("event_id", extraction.error_status(F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("status"))


# ---- scoring -------------------------------------------------------------------------------------------------

def _leaves(spark, d):
    k = F.col("o_orderkey")
    e = F.when(k % 5 != 0, F.concat(F.lit(" a  b "), F.col("o_orderpriority")))
    a = F.when(k % 7 != 0, F.when(k % 3 == 0, F.lit("other")).when(k % 3 == 1, F.concat(F.lit("a b "), F.col("o_orderpriority"), F.lit(" and more"))).otherwise(F.concat(F.lit("a b "), F.col("o_orderpriority"))))
    return _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("path"), X.verdict(e, a).alias("verdict"))


_VERDICT = """v as (select o_orderkey, o_custkey, o_orderpriority as path, case when o_orderkey % 35 = 0 then 'exact' when o_orderkey % 5 = 0 then 'hallucinated' when o_orderkey % 7 = 0 then 'missed'
    when o_orderkey % 3 = 0 then 'wrong' else 'exact' end as verdict from orders)"""
_TALLY = ", ".join(f"cast(count(*) filter (verdict = '{v}') as bigint) as {v}" for v in score.VERDICTS)


@_query(f"with {_VERDICT} select o_orderkey, verdict from v")
def leaf_verdict(spark, d):
    return _leaves(spark, d).select("o_orderkey", "verdict")


@_query(f"with {_VERDICT} select o_custkey, path, {_TALLY} from v group by all")
def score_tally(spark, d):
    return score.tally(_leaves(spark, d), "o_custkey", "path")


@_query(f"with {_VERDICT} select path, {_TALLY} from v group by all")
def tally_merge(spark, d):
    return score.merge(score.tally(_leaves(spark, d), "o_custkey", "path"), "path")


@_query(f"with {_VERDICT}, t as (select path, {_TALLY} from v group by all) select *, wrong + missed + hallucinated as bad from t order by bad desc, path desc")
def worst_first(spark, d):
    return score.worst_first(score.tally(_leaves(spark, d), "path"))


@_query(f"with {_VERDICT} select {_TALLY} from v")
def grand_total(spark, d):
    return score.merge(score.tally(_leaves(spark, d), "path"))


@_query("""with t as (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as s from benchmark), p as (select a.item_id as i, b.item_id as j, a.s as x, b.s as y from t a join t b on b.item_id = a.item_id + 1),
    g as (select *, list_distinct(list_transform(range(1, length(x)), lambda k: substring(x, k, 2))) as u, list_distinct(list_transform(range(1, length(y)), lambda k: substring(y, k, 2))) as w from p)
    select i, j, case when contains(x, y) or contains(y, x) then 1.0 else len(list_intersect(u, w))::double / (len(u) + len(w) - len(list_intersect(u, w))) end as sim from g""")
def bigram_similarity(spark, d):
    b = _t(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return b.join(other, "item_id").select(F.col("item_id").alias("i"), (F.col("item_id") + 1).alias("j"), X.similarity(F.col("text"), F.col("next")).alias("sim"))


def _lists(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select(F.col("conv_id").alias("doc_id"), F.lit("turns").alias("path"), F.col("t.text").alias("expected"), F.reverse(F.filter("t.text", lambda x, i: i % 3 != 1)).alias("actual"))


def _matched(expected: str, actual: str) -> str:
    """CTEs for greedy matching of x(doc, i, s) and y(doc, j, s): pairs are taken one by one in their order, the lists of taken positions as state."""
    grams = "case when length(s) = 1 then [s] else list_distinct(list_transform(range(1, length(s)), lambda k: substring(s, k, 2))) end as g"
    squeezed = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as s"
    return f"""x as materialized (select *, {grams} from (select doc, i, {squeezed} from ({expected}))), y as materialized (select *, {grams} from (select doc, j, {squeezed} from ({actual}))),
    scored as (select x.doc, i, j, case when x.s = '' or y.s = '' then 0.0::double when contains(x.s, y.s) or contains(y.s, x.s) then 1.0::double
        else len(list_intersect(x.g, y.g))::double / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) end as sim from x join y using (doc)),
    ranked as materialized (select *, row_number() over (partition by doc order by sim desc, i, j) as k from scored where sim >= 0.3),
    step as (select distinct doc, 0::bigint as k, []::bigint[] as di, []::bigint[] as dj, false as took, 0::bigint as i, 0::bigint as j from x
        union all select s.doc, r.k, case when f then list_append(s.di, r.i) else s.di end, case when f then list_append(s.dj, r.j) else s.dj end, f, r.i, r.j
        from step s join ranked r on r.doc = s.doc and r.k = s.k + 1, lateral (select not list_contains(s.di, r.i) and not list_contains(s.dj, r.j) as f) t),
    pairs as materialized (select doc, i, j, row_number() over (partition by doc order by k) - 1 as n from step where took)"""


_TURNS = "select conv_id as doc, text, row_number() over (partition by conv_id order by turn, text) - 1 as i from conversations"
_KEPT = f"select doc, text, row_number() over (partition by doc order by i desc) - 1 as j from ({_TURNS}) where i % 3 <> 1"


@_query(f"with recursive {_matched(_TURNS, _KEPT)} select doc as doc_id, cast(n as int) as n, cast(i as int) as i, cast(j as int) as j from pairs")
def greedy_match(spark, d):
    return _lists(spark, d).select("doc_id", F.posexplode(score.greedy_match(F.col("expected"), F.col("actual"))).alias("n", "p")).select("doc_id", "n", "p.i", "p.j")


@_query(f"""with recursive {_matched(_TURNS, _KEPT)}, c as (select doc, (select count(*) from x where x.doc = d.doc) as e, (select count(*) from y where y.doc = d.doc) as a, (select count(*) from pairs where pairs.doc = d.doc) as p
    from (select distinct doc from x) d)
    select doc as doc_id, 'turns' as path, cast(e as int) as n_expected, cast(a as int) as n_actual, cast(e - p as int) as missed, cast(a - p as int) as extra from c where e > p or a > p""")
def list_mismatch_report(spark, d):
    return score.list_report(_lists(spark, d))


_NAMES = "select p_brand as doc, p_name || ' ' || lower(p_type) as text, row_number() over (partition by p_brand order by p_partkey) - 1 as i from part"
_OTHERS = "select p_brand as doc, case p_partkey % 4 when 0 then p_name when 1 then lower(p_type) || ' ' || p_name else p_name || ' ' || lower(p_type) end as text, row_number() over (partition by p_brand order by p_partkey desc) - 1 as j from part where p_partkey % 3 <> 1"


@_query(f"with recursive {_matched(_NAMES, _OTHERS)} select doc as doc_id, cast(i as int) as i, cast(j as int) as j from pairs")
def list_pairs(spark, d):
    from pyspark.sql import Window

    p = _t(spark, d, "part")
    by = Window.partitionBy("p_brand")
    whole = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    changed = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat(F.lower("p_type"), F.lit(" "), F.col("p_name"))).otherwise(whole)
    expected = p.select(F.col("p_brand").alias("doc_id"), (F.row_number().over(by.orderBy("p_partkey")) - 1).alias("i"), whole.alias("text"))
    actual = p.filter("p_partkey % 3 <> 1").select(F.col("p_brand").alias("doc_id"), (F.row_number().over(by.orderBy(F.desc("p_partkey"))) - 1).alias("j"), changed.alias("text"))
    return matching.match_lists(expected, actual, keys=("doc_id",)).drop("similarity")


_ACTUAL = "select doc, text, role, row_number() over (partition by doc order by turn, text, role) - 1 as j from (select conv_id as doc, turn, text, role from conversations where turn % 3 <> 1)"
_EXPECTED = "select conv_id as doc, text, role, row_number() over (partition by conv_id order by turn, text, role) - 1 as i from conversations"


@_query(f"""with recursive {_matched(_EXPECTED, _ACTUAL)}, ex as ({_EXPECTED}), ac as ({_ACTUAL}),
    l as (select e.text as te, e.role as re, a.text as ta, a.role as ra from ex e left join pairs p on p.doc = e.doc and p.i = e.i left join ac a on a.doc = p.doc and a.j = p.j),
    leaf as (select 'turns[].role' as path, re as e, ra as a from l union all select 'turns[].text', te, ta from l),
    v as (select path, case when e is null and a is null then 'exact' when e is null then 'hallucinated' when a is null then 'missed'
        when q = b or (q <> '' and contains(b, q)) or (b <> '' and contains(q, b)) then 'exact' else 'wrong' end as verdict
        from (select *, trim(regexp_replace(e, '\\s+', ' ', 'g')) as q, trim(regexp_replace(a, '\\s+', ' ', 'g')) as b from leaf))
    select path, {", ".join(f"count(*) filter (verdict = '{v}') as {v}" for v in score.VERDICTS)} from v group by path""")
def score_lists(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("turns").alias("path"), F.col("turn").alias("idx"), "text", F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text")).alias("leaves"))
    return score.tally(score.score_lists(c, c.filter("idx % 3 <> 1")), "path")


@_query(f"""with {_VERDICT}, t as (select o_custkey % 2 as m, {_TALLY} from v group by 1),
    c as (select c_custkey % 2 as m, string_agg(c_custkey::varchar, ', ' order by c_custkey::varchar) filter (c_custkey % 50 = 0) as crashed from customer group by 1)
    select 'anthropic' as provider, case when c.m = 0 then 'a' else 'b' end as model, coalesce(crashed, 'none') as crashed, 'unknown' as cost, {", ".join(score.VERDICTS)} from c left join t using (m)""")
def provider_comparison(spark, d):
    model = lambda c: F.when(F.col(c) % 2 == 0, "a").otherwise("b")
    tallies = score.tally(_leaves(spark, d).withColumns({"provider": F.lit("anthropic"), "model": model("o_custkey")}), "provider", "model")
    runs = _t(spark, d, "customer").select(F.lit("anthropic").alias("provider"), model("c_custkey").alias("model"), F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 50 == 0).alias("crashed"), F.when(F.col("c_custkey") % 3 != 0, 0.25).alias("usd"))
    return score.provider_summary(tallies, runs, told=None)


@_query("""select page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped, 'f' || page_id as stem from pages""")
def viewer_text(spark, d):
    return _t(spark, d, "pages").select("page_id", X.html_escape(F.col("url")).alias("escaped"), X.strip_extension(F.concat(F.lit("f"), F.col("page_id").cast("string"), F.lit(".PDF"))).alias("stem"))
