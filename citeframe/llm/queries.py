"""One query for each training-data operator: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm import audit, bpe, chat, curriculum, decontam, hosts, langid, neardup, quality, secretscan, sharding, topk, whitening
from citeframe.llm.common import dealt, read

SHARDS = 40
#: (action, host/path)
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
ODD_TEXT = r"\### Assistant: </turn> ok"


def language_model(docs: DataFrame) -> langid.Model | None:
    return langid.fit(docs.filter(dealt("doc_id", 3) != 1).select("text", "lang", F.col("doc_id").alias("key")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", spread=True)
    found = langid.predict(docs, language_model(docs), ["doc_id"])
    return found.select("doc_id", (dealt("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(read(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(read(spark, sf_dir, "documents", spread=True))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secretscan.scan(read(spark, sf_dir, "documents", spread=True), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def coded(rows: DataFrame) -> DataFrame:
    """The digests of ids and decoded."""
    return rows.withColumns({"n_tokens": F.size("ids").cast("bigint"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), "decoded_sha256": F.sha2("decoded", 256)})


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.round_trip(read(spark, sf_dir, "documents", spread=True), bpe.vocabulary_path(), ["doc_id"])
    return coded(rows).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    odd = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    messages = chat.from_turns(read(spark, sf_dir, "conversations").select(*columns).unionByName(odd.select(*columns)))
    rows = chat.read_back(chat.format_paths(messages, unique=True))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.expr("try_cast(key as bigint)").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", spread=True)
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).filter(dealt("doc_id", 5) != 0)
    rows = quality.score(docs, quality.fit(docs, labels), ["doc_id"])
    return rows.select("doc_id", (dealt("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.find(read(spark, sf_dir, "documents", spread=True), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.text_filters(read(spark, sf_dir, "documents", spread=True), read(spark, sf_dir, "labels"))
    return audit.audit(rows, audit.FILTERS, ["good", "toxic"])


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.plan(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", F.size("copies").alias("copies"), F.get("copies", F.lit(0))["when"].alias("position"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sharding, op3_near_dup, op4_secret_scan, op5_bpe, op6_url_filter, op7_chat_format, op8_quality, op9_topk, op10_decontaminate, op11_filter_audit, op12_mixing, op13_whitening)}


def _extra(column: str, letters: str) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{x}', '')))" for x in letters)


def _host_sql() -> str:
    """The rules, and the beta-binomial bound of each host, level by level as hosts.reputation has them."""
    rules = " ".join(
        f"when (host = '{n}' or ends_with(host, '.{n}')) and starts_with(path, '/{r}') then '{t}'"
        for t in sorted((t for _, t in URL_RULES), key=lambda t: (-len(t), t)) for n, _, r in [t.partition("/")])
    blocked = ", ".join(f"'{t}'" for a, t in URL_RULES if a == "block")
    twos = ", ".join(f"'{x}'" for x in hosts.SUFFIXES)

    def strength(level: str) -> str:
        return f"""m_{level} as (select sum(n)::double as n, sum(k)::double as k, count(*) as m, sum(n::double * n) as nn, sum(k::double * k / n) as kk from {level}s where n > 0),
    a_{level} as (select *, (coalesce(k, 0) + 0.5) / (coalesce(n, 0) + 1) as p, n - nn / n - (m - 1) as size, kk - n * (k / n) * (k / n) - (m - 1) * (coalesce(k, 0) + 0.5) / (coalesce(n, 0) + 1) * (1 - (coalesce(k, 0) + 0.5) / (coalesce(n, 0) + 1)) as between_ from m_{level}),
    r_{level} as (select p, case when m < 2 then null when size > 0 then between_ / (size * p * (1 - p)) else 0.5 end as rho from a_{level}),
    s_{level} as (select p, case when rho is null then 2.0 when rho <= 1 / 10001.0 then 10000.0 else greatest(0.5, least(10000.0, 1 / rho - 1)) end::double as s from r_{level})"""

    return f"""
            with u as (select page_id, case when contains(coalesce(url, ''), '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
            h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
            q as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
            w as (select *, case {rules} end as rule from q),
            l as (select *, case when rule is null then null when rule in ({blocked}) then 1 else 0 end as bad from w),
            b as (select host, count(bad) as n, coalesce(sum(bad), 0) as k, regexp_replace(host, '(^.*@)|(:[0-9]*$)', '', 'g') as bare from l group by host),
            d as (select *, string_split(bare, '.') as x, array_to_string(string_split(bare, '.')[-2:], '.') in ({twos}) as two, regexp_matches(bare, '^[0-9.]*$') or contains(bare, ':') as address from b),
            hosts as (select host, n, k, case when address then bare when two then array_to_string(x[-3:], '.') else array_to_string(x[-2:], '.') end as domain,
                case when address then '' when two then array_to_string(x[-2:], '.') else x[-1] end as suffix from d),
            domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all), suffixs as (select suffix, sum(n) as n, sum(k) as k from domains group by suffix),
            {strength("suffix")}, {strength("domain")}, {strength("host")},
            up as (select suffix, (k + s * p) / (n + s) as p from suffixs, s_suffix), mid as (select domain, suffix, (k + s * up.p) / (n + s) as p from domains join up using (suffix), s_domain),
            post as (select host, (k + s * mid.p) / (n + s) as rate, n + s as size from hosts join mid using (domain, suffix), s_host),
            low as (select host, greatest(0.0, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1))) as low from post)
            select page_id, host, path, rule, case when bad = 1 then 'block' when bad = 0 then 'allow' when low >= 0.5 then 'block' else 'allow' end as verdict from l join low using (host)"""


def _audit_sql() -> str:
    """Every order of the filters, step by step, over the counts of rows by what they fail."""
    bit = "(1 << (ascii({}) - 65))"
    steps = " union all ".join(f"select o, {j + 1} as step, o[{j + 1}] as f, {' + '.join(bit.format(f'o[{i + 1}]') for i in range(j)) or '0'} as before from orders" for j in range(5))
    return f"""
            with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
            l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id),
            m as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
                + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from d left join l using (doc_id)),
            c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
            a as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
            orders as (select p.x || q.x || r.x || s.x || t.x as o from a p, a q, a r, a s, a t where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
            steps as ({steps}), s as (select *, {bit.format('f')} as own from steps),
            k as (select part, o, step, f, sum(case when mask & (before | own) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & own > 0 then n else 0 end) as removed,
                sum(case when mask & before > 0 and mask & own > 0 then n else 0 end) as redundant, sum(case when mask = own then n else 0 end) as unique_fails,
                sum(case when mask & before = 0 and mask & own > 0 then good else 0 end) as good_lost, sum(case when mask & before = 0 and mask & own > 0 then toxic else 0 end) as toxic_lost from c, s group by all)
            select part, o as filter_order, step::int as step, {", ".join(f"{x}::bigint as {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, (sum(removed) over (partition by part, f))::bigint as shapley from k"""


def _mixing_sql() -> str:
    """Targets by filling up, places by a running sum in the seeded order, times by the inverse of the schedule's integral."""
    made = [curriculum._pieces(s) for s in curriculum.SCHEDULES]

    def solved(t: float, w: float, g: float, a: float) -> str:
        rest = f"greatest(u - {a}::double, 0::double)"
        root = f"({w}::double + sqrt(greatest({w}::double * {w}::double + {g}::double * 2.0::double * {rest}, 0::double)))"
        return f"case when {root} > 0 then {t}::double + {rest} * 2.0::double / {root} else {t}::double end"

    when = " ".join(f"when {k} then case " + " ".join(f"when u >= {p[3]}::double then {solved(*p)}" for p in reversed(pieces)) + " end" for k, (pieces, _) in enumerate(made))
    area = " ".join(f"when {k} then {a}::double" for k, (_, a) in enumerate(made))
    weight = " ".join(f"when {k} then {float(w)}::double" for k, w in enumerate(curriculum.WEIGHTS))
    return f"""
            with d as (select doc_id, source, case when source is null then '1' else '0' || source end as s, coalesce(text, '') as t from documents),
            u as (select *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as size, md5(concat_ws('|', '23', coalesce(doc_id::varchar, ''), md5(t))) as h from d),
            e as (select *, row_number() over (partition by s, doc_id, h) - 1 as i from u),
            g as (select *, case when i < {curriculum.PARCEL} then h else md5(h || (i // {curriculum.PARCEL})) end as g from e),
            p as (select *, coalesce(sum(size) over (partition by s order by g, doc_id, i rows between unbounded preceding and 1 preceding), 0)::bigint as begun from g),
            z as (select s, sum(size)::bigint as source_size, row_number() over (order by s) - 1 as place from u group by s),
            w as (select *, case place % 3 {weight} end as w, source_size * 2.0::double as cap, (sum(source_size) over ())::double * 1.5::double as everything from z),
            f as (select *, coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0) + cap / w * sum(w) over (order by cap / w, place rows between current row and unbounded following) <= everything as full_ from w),
            o as (select *, case when full_ then cap else w * ((everything - sum(case when full_ then cap else 0 end) over ()) / nullif(sum(case when full_ then 0 else w end) over (), 0)) end as target from f),
            q as (select p.*, source_size, place, target, least(floor(target + 0.5::double), floor(source_size * 2.0::double))::bigint as quota from p join o using (s)),
            t as (select *, greatest(least(quota - begun, size), 0)::bigint as one, greatest(least(quota - begun - source_size, size), 0)::bigint as two from q),
            n as (select *, case when one > 0 then (begun + one / 2.0::double) / quota * case place % 3 {area} end end as u from t)
            select doc_id, source, size::bigint as size, source_size, target, one + two as taken, (one > 0)::int + (two > 0)::int as copies, case when u is not null then least(case place % 3 {when} end, 1.0::double) end as position from n"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_filter_audit": _audit_sql(),
        "op12_mixing": _mixing_sql(),
        "op6_url_filter": _host_sql(),
        "op7_chat_format": rf"""
            with c as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, 0, 'user', '{ODD_TEXT}' union all select -7, 1, 'assistant', '{ODD_TEXT}')
            select conv_id, count(*) as n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
                cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
                sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
                cast(sum(14 + length(role) + length(text) + {_extra("role", chr(92) + "<#:")} + {_extra("text", chr(92) + "<#")}) as bigint) as formatted_chars
            from c group by conv_id""",
        "op9_topk": """
            with v as (
                select vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)) as q from embeddings
                where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            s as (
                select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
                from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
            select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    }
