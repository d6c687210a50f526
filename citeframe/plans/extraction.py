"""Extraction as a plan over recorded responses: resolving providers, gates, retries, merging, guards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from citeframe import schema
from citeframe.functions.text import override_part
from citeframe.operators import pricing
from citeframe.operators.documents import bound
from citeframe.operators.validate import ERRORS, node_errors

MAX_ATTEMPTS = 2
#: Errors that allow another attempt; others end the document at once.
RETRYABLE = ("validation", "api")
STATUS = {"timeout": 504, "validation": 502, "auth": 500, "rate_limit": 429, "unsupported": 502, "api": 502}
DEFAULT_MAX_TOKENS, MISC_MAX_TOKENS = 8_000, 16_000
#: (native structured output, vision input, prompt caching, reports token usage); the last provider sees images only if told so.
PROVIDERS = {"anthropic": (True, True, True, True), "openai": (True, True, False, True), "gemini": (True, True, False, True), "openai_compat": (True, False, False, True)}
#: Names of the rules that tell a model how to cite each kind of document.
KIND_RULES = {"pdf": "page", "docx": "block", "xlsx": "cell"}


class UnresolvedProvider(LookupError):
    """A group's provider that no one supplies."""


def groups(spark: SparkSession) -> DataFrame:
    rows = [(k, n, MISC_MAX_TOKENS if n == "misc" else DEFAULT_MAX_TOKENS) for k, n in enumerate(schema.GROUPS)]
    return spark.createDataFrame(rows, "ordinal int, name string, max_tokens int")


def providers(spark: SparkSession, compat_vision: bool = False) -> DataFrame:
    rows = [(p, c[0], c[1] or (compat_vision and p == "openai_compat"), *c[2:]) for p, c in PROVIDERS.items()]
    return spark.createDataFrame(rows, "provider string, structured boolean, vision boolean, caching boolean, reports_usage boolean")


def parse_overrides(env: DataFrame, prefix: str = "TOR_GROUP_") -> DataFrame:
    """(name, provider, model) from (key, value) settings such as PREFIX + NAME = provider:model; malformed ones are left out."""
    rows = env.filter(F.col("key").startswith(prefix)).select(F.lower(F.substring("key", len(prefix) + 1, 1000)).alias("name"), override_part(F.col("value"), 1).alias("provider"), override_part(F.col("value"), 2).alias("model"))
    return rows.filter("name <> '' and provider is not null and model is not null")


def resolve(groups: DataFrame, overrides: DataFrame, provider: str, model: str) -> DataFrame:
    """Each group's provider and model: its override's, else the default."""
    o = overrides.select("name", F.col("provider").alias("_p"), F.col("model").alias("_m"))
    return groups.join(o, "name", "left").select("ordinal", "name", "max_tokens", F.coalesce("_p", F.lit(provider)).alias("provider"), F.coalesce("_m", F.lit(model)).alias("model"))


def unresolved(resolved: DataFrame, provider: str, available: list[str]) -> DataFrame:
    """(name, provider) of groups whose override names a provider that nobody supplies."""
    return resolved.filter((F.col("provider") != provider) & ~F.col("provider").isin(*available)).select("name", "provider")


def kind_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KIND_RULES.items()), "kind string, rules string")


def rules_for(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """docs (doc_id, kind) with the rules of their kind; null where there are none, and then the document is refused."""
    return docs.join(F.broadcast(rules), "kind", "left")  # one row for each kind of document


def probed(providers: DataFrame, probes: DataFrame) -> DataFrame:
    """providers whose structured output is as recorded probes (provider, error) found it: any error means there is none."""
    failed = probes.filter("error is not null").select("provider", F.lit(True).alias("_failed")).distinct()
    return providers.join(failed, "provider", "left").withColumn("structured", F.col("structured") & F.col("_failed").isNull()).drop("_failed")


def schema_ceiling(probes: DataFrame) -> DataFrame:
    """(provider, name, outcome) of one stub call for each group: OK, REJECTED by the provider, or FAILED otherwise.  probes: (provider, name, error)."""
    known = F.col("error").isin(*[e for e in STATUS if e != "timeout"])
    outcome = F.when(F.col("error").isNull(), 1).when(known, 2).otherwise(3)
    names = F.array(F.lit("OK"), F.lit("REJECTED"), F.lit("FAILED"))
    return probes.groupBy("provider", "name").agg(F.element_at(names, F.max(outcome)).alias("outcome"))


def capability_gate(resolved: DataFrame, providers: DataFrame) -> DataFrame:
    """Groups whose provider is unknown or has no native structured output."""
    return resolved.join(providers.filter("structured").select("provider"), "provider", "left_anti")


def vision_gate(docs: DataFrame, resolved: DataFrame, providers: DataFrame) -> DataFrame:
    """Documents with images (doc_id, n_images) that must be refused, with the first group that can't see."""
    blind = resolved.join(providers.filter("vision").select("provider"), "provider", "left_anti")
    first = blind.agg(F.min_by("name", "ordinal").alias("group")).filter(F.col("group").isNotNull())  # one row at most
    return docs.filter("n_images > 0").select("doc_id").withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one").select("doc_id", "group")


def tried_attempts(responses: DataFrame) -> DataFrame:
    """The attempts of each (doc_id, name) that count, numbered as _n: up to MAX_ATTEMPTS, none after a success or an error that forbids a retry."""
    order = Window.partitionBy("doc_id", "name").orderBy("attempt")
    ends = F.col("error").isNull() | ~F.col("error").isin(*RETRYABLE)
    before = F.coalesce(F.max(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return responses.withColumn("_n", F.row_number().over(order)).withColumn("_stop", before).filter((F.col("_n") <= MAX_ATTEMPTS) & (F.col("_stop") == 0)).drop("_stop")


def select_attempts(responses: DataFrame) -> DataFrame:
    """The first valid attempt of each (doc_id, name), of the attempts that count: up to MAX_ATTEMPTS, none after an error that forbids a retry."""
    order = Window.partitionBy("doc_id", "name").orderBy("attempt")
    before = F.coalesce(F.max(F.when(F.col("error").isNotNull() & ~F.col("error").isin(*RETRYABLE), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = responses.withColumn("_n", F.row_number().over(order)).withColumn("_stop", before).filter((F.col("_n") <= MAX_ATTEMPTS) & (F.col("_stop") == 0))
    good = tried.filter("error is null").withColumn("_k", F.row_number().over(order))
    return good.filter("_k = 1").drop("_n", "_stop", "_k")


def complete(selected: DataFrame, n_groups: int = len(schema.GROUPS)) -> DataFrame:
    """Documents all of whose groups succeeded; any other has no result at all."""
    return selected.groupBy("doc_id").agg(F.count_distinct("name").alias("n"), F.sum("duration_ms").alias("duration_ms")).filter(F.col("n") == n_groups).select("doc_id", "duration_ms")


def _parsed(json: Column, kind: StructType) -> Column:
    """JSON as a group's struct, with the raw text in _corrupt where it doesn't fit."""
    return F.from_json(json, StructType([*kind.fields, StructField("_corrupt", StringType())]), {"columnNameOfCorruptRecord": "_corrupt"})


def _group_errors(name: str, kind: StructType) -> Callable[[Column], Column]:
    """What is wrong with a group's parsed answer."""
    broken = F.array(F.struct(F.lit(name).alias("path"), F.lit("malformed").alias("code")))

    def errors(got: Column) -> Column:
        every = F.concat(*[node_errors(got[f.name], f.dataType, f.name) for f in kind.fields])
        return F.when(got.isNull() | got["_corrupt"].isNotNull(), broken).otherwise(every)

    return errors


def checked(responses: DataFrame) -> DataFrame:
    """responses with error `validation`, and detail, where an answer without error is malformed or breaks an invariant in any leaf."""
    found = F.array().cast(ERRORS)
    for name, kind in schema.GROUPS.items():
        # parsed once, however often it is used
        errors = F.element_at(F.transform(F.array(_parsed(F.col("json"), kind)), _group_errors(name, kind)), 1)
        found = F.when((F.col("name") == name) & F.col("error").isNull(), errors).otherwise(found)
    first = F.get(F.col("_found"), F.lit(0))
    rows = responses.withColumn("_found", found)
    return rows.withColumns({"error": F.when(F.size("_found") > 0, "validation").otherwise(F.col("error")), "detail": F.concat_ws(" ", first["path"], first["code"])}).drop("_found")


def merge_groups(selected: DataFrame) -> DataFrame:
    """One nested row for each complete document, from the valid JSON of its groups (doc_id, name, json); malformed JSON is no success."""
    good = selected
    for name, kind in schema.GROUPS.items():
        got = _parsed(F.col("json"), kind)
        good = good.filter(~((F.col("name") == name) & F.coalesce(got.isNull() | got["_corrupt"].isNotNull(), F.lit(True))))
    parts = good.groupBy("doc_id").agg(*[F.max(F.when(F.col("name") == g, F.col("json"))).alias(g) for g in schema.GROUPS])
    whole = parts.filter(" and ".join(f"{g} is not null" for g in schema.GROUPS))
    parsed = whole.select("doc_id", *[F.from_json(g, t).alias(g) for g, t in schema.GROUPS.items()])
    return parsed.select("doc_id", *[F.col(g)[f.name].alias(f.name) for g, t in schema.GROUPS.items() for f in t.fields])


def extract_documents(docs: DataFrame, responses: DataFrame, resolved: DataFrame, providers: DataFrame, rules: DataFrame, fx: tuple[float, str] = (pricing.USD_THB, pricing.USD_THB_DATE)) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, kind, n_images) by recorded answers: (extracted, rejects).

    extracted: doc_id, the nested columns, provider, model, the four token counters, duration_ms, usd, thb.
    rejects: doc_id, stage (rules, gate or the group), code, detail, status.  A document is refused before any call if
    its kind has no rules, if a group's provider has no structured output, or if it has images that a provider can't see;
    else by its first group, in their order, of which no attempt is valid.  It is one or the other, never in part.
    A group that names a provider which isn't in `providers` is an error before anything runs.
    """
    supplied = [r.provider for r in providers.select("provider").collect()]  # a few names, and a few groups
    lost = unresolved(resolved, "", supplied).orderBy("name").collect()
    if lost:
        raise UnresolvedProvider("; ".join(f"group '{r.name}' overrides its provider to '{r.provider}', which nobody supplies" for r in lost))
    known = rules_for(docs, rules)
    blind = resolved.join(providers.filter("vision").select("provider"), "provider", "left_anti").agg(F.min_by("name", "ordinal").alias("_blind"))
    mute = capability_gate(resolved, providers).agg(F.min_by("name", "ordinal").alias("_mute"))
    gates = known.withColumn("_one", F.lit(1)).join(F.broadcast(blind.withColumn("_one", F.lit(1))), "_one").join(F.broadcast(mute.withColumn("_one", F.lit(1))), "_one")  # one row each
    refusal = (
        F.when(F.col("rules").isNull(), F.struct(F.lit("rules").alias("stage"), F.lit("validation").alias("code"), F.concat(F.lit("no rules for "), F.coalesce("kind", F.lit("null"))).alias("detail")))
        .when(F.col("_mute").isNotNull(), F.struct(F.lit("gate").alias("stage"), F.lit("unsupported").alias("code"), F.concat(F.col("_mute"), F.lit(": no structured output")).alias("detail")))
        .when((F.col("n_images") > 0) & F.col("_blind").isNotNull(), F.struct(F.lit("gate").alias("stage"), F.lit("unsupported").alias("code"), F.concat(F.col("_blind"), F.lit(": sees no images")).alias("detail")))
    )
    gated = gates.select("doc_id", refusal.alias("refusal"))
    open_ = gated.filter("refusal is null").select("doc_id")
    tokens = ("input_tokens", "output_tokens", "cache_write_tokens", "cached_read_tokens")
    attempt = F.struct("attempt", "name", "error", "detail", "json", "provider", "model", *tokens, "duration_ms")
    # the answers of a document meet in one row, once; what follows happens there
    answers = checked(responses).groupBy("doc_id").agg(F.sort_array(F.collect_list(attempt)).alias("all"))
    told = open_.join(answers, "doc_id", "left").select("doc_id", F.transform(F.array(*[F.lit(g) for g in schema.GROUPS]), _outcome).alias("groups"))
    bad = F.get(F.filter("groups", lambda g: g["good"].isNull()), F.lit(0))
    refused = F.struct(bad["name"].alias("stage"), F.coalesce(bad["last"]["error"], F.lit("api")).alias("code"), F.coalesce(bad["last"]["detail"], F.lit("no answer")).alias("detail"))
    failed = told.filter(bad.isNotNull()).select("doc_id", refused.alias("refusal"))
    rejects = gated.filter("refusal is not null").unionByName(failed).select("doc_id", "refusal.*").withColumn("status", error_status(F.col("code")))
    good = told.filter(bad.isNull()).select("doc_id", F.transform("groups", lambda g: g["good"]).alias("good"))
    used = good.select("doc_id", F.inline("good")).select("doc_id", "provider", "model", *tokens)
    cost = pricing.mixed_cost(pricing.cost(pricing.usage_by_pair(used), *fx))
    total = lambda c: F.aggregate("good", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x[c].cast("bigint"), F.lit(0))).alias(c)
    parsed = good.select("doc_id", *[total(c) for c in (*tokens, "duration_ms")], *[F.from_json(F.get("good", F.lit(k))["json"], t).alias(f"_{n}") for k, (n, t) in enumerate(schema.GROUPS.items())])
    nested = parsed.select("doc_id", *[F.col(f"_{n}")[f.name].alias(f.name) for n, t in schema.GROUPS.items() for f in t.fields], *tokens, "duration_ms")
    return nested.join(cost, "doc_id"), rejects


def _outcome(name: Column) -> Column:
    """name, good (the first valid attempt that counts, or null) and last (the last that counts) of one group, from the sorted attempts of a document in `all`."""
    def told(mine: Column) -> Column:
        first = F.get(mine, F.lit(0))
        second = F.when(first["error"].isin(*RETRYABLE), F.get(mine, F.lit(1)))
        valid = lambda x: F.when(x.isNotNull() & x["error"].isNull(), x)
        return F.struct(name.alias("name"), F.coalesce(valid(first), valid(second)).alias("good"), F.coalesce(second, first).alias("last"))

    return bound(F.filter("all", lambda x: x["name"] == name), told)


def merge_keys(parts: DataFrame) -> DataFrame:
    """(doc_id, key, value) from parts (doc_id, ordinal, key, value): the later group wins a key."""
    return parts.groupBy("doc_id", "key").agg(F.max_by("value", "ordinal").alias("value"))


def _unfit(v: Column, kind: DataType, path: str) -> Column:
    """array<string>: the paths under which a variant, not null, doesn't hold what its type says; nulls fit everywhere, items of a list share `path[]`."""
    here, none = F.array(F.lit(path)), F.array().cast("array<string>")
    inner = lambda x, k, p: F.when(x.isNull() | F.is_variant_null(x), none).otherwise(_unfit(x, k, p))
    if isinstance(kind, StructType):
        field = lambda f: bound(F.try_variant_get(v, f"$['{f.name}']", "variant"), lambda x: inner(x, f.dataType, f"{path}.{f.name}"))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.concat(*[field(f) for f in kind.fields])).otherwise(here)
    if isinstance(kind, ArrayType):
        items = lambda a: F.when(a.isNull(), here).otherwise(F.array_distinct(F.flatten(F.transform(a, lambda x: inner(x, kind.elementType, f"{path}[]")))))
        return bound(F.try_variant_get(v, "$", "array<variant>"), items)
    return F.when(F.try_variant_get(v, "$", kind.simpleString()).isNull(), here).otherwise(none)


def merge_variants(answers: DataFrame, groups: dict[str, StructType] = schema.GROUPS, document: StructType = schema.DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """Answers (doc_id, name, json) to (documents, errors): the keys of all groups merged, the later group's where several give one.

    documents: doc_id and the fields of `document`, of documents without an error.  errors: doc_id, path, code.  Of an
    answer, only the keys that its group declares count; a declared key that it lacks counts as null, and may so
    replace a value.  Groups rank in the order of `groups`; an answer of another group is passed over, and so is a
    null doc_id.  An answer that isn't a JSON object is `malformed`; the merged whole is then held against `document`, path
    by path: a field that no group gives, or gives as null, is `missing`, anything in it of another type `not_valid`.
    Answers to one group are expected once; of several the largest text counts.
    """
    order = F.create_map(*[F.lit(x) for k, n in enumerate(groups) for x in (n, k)])
    declared = F.create_map(*[x for n, kind in groups.items() for x in (F.lit(n), F.array(*[F.lit(f) for f in kind.fieldNames()]))])
    mine = answers.filter(F.col("name").isin(*groups) & F.col("doc_id").isNotNull())
    once = mine.groupBy("doc_id", "name").agg(F.max("json").alias("json")).withColumn("v", F.try_parse_json("json"))
    broken = ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    once = once.withColumn("broken", broken)
    each = once.filter(~F.col("broken")).select("doc_id", order[F.col("name")].alias("ordinal"), "v", F.explode(declared[F.col("name")]).alias("key"))
    # which key, and so which path, is known with the row only
    given = each.withColumn("value", F.try_variant_get("v", F.concat(F.lit("$['"), F.col("key"), F.lit("']")), "variant"))
    fields = document.fields
    last = given.groupBy("doc_id").agg(*[F.max_by("value", F.when(F.col("key") == f.name, F.col("ordinal"))).alias(f.name) for f in fields if any(f.name in k.fieldNames() for k in groups.values())])
    last = once.groupBy("doc_id").agg(F.bool_or("broken").alias("_broken"), F.array_sort(F.collect_set(F.when(F.col("broken"), F.col("name")))).alias("_names")).join(last, "doc_id", "left")
    have = lambda f: f.name in last.columns
    typed = [(F.try_variant_get(f.name, "$", f.dataType.simpleString()) if have(f) else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
    told = lambda paths, code: F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(code).alias("code")))
    gone = lambda f: F.col(f.name).isNull() | F.is_variant_null(f.name) if have(f) else F.lit(True)
    wrong = [F.when(gone(f), told(F.array(F.lit(f.name)), "missing")).otherwise(told(_unfit(F.col(f.name), f.dataType, f.name), "not_valid") if have(f) else F.array().cast(ERRORS)) for f in fields]
    found = last.select("doc_id", F.struct(*typed).alias("doc"), F.when(F.col("_broken"), told(F.col("_names"), "malformed")).otherwise(F.concat(*wrong)).alias("errors"))
    return found.filter(F.size("errors") == 0).select("doc_id", "doc.*"), found.select("doc_id", F.inline_outer("errors")).filter("path is not null")


def leaf_errors(docs: DataFrame) -> DataFrame:
    """Broken invariants of every leaf of extracted documents: (doc_id, path, code); items of a list share `path[]`."""
    return docs.select("doc_id", F.inline(F.concat(*[node_errors(F.col(f.name), f.dataType, f.name) for f in schema.DOCUMENT.fields if f.name in docs.columns])))


def upload_status(has_key: Column, size: Column, kind: Column, enabled: Column, units: Column, cap: Column, parsed: Column, max_bytes: int) -> Column:
    """The HTTP status of an upload; the guards are tried in this order."""
    return (
        F.when(~has_key, 500).when(size > max_bytes, 413).when(size == 0, 400).when(kind.isNull() | (kind == "unsupported"), 415)
        .when(~enabled, 415).when(units > cap, 422).when(~parsed, 400).otherwise(200)
    )


def error_status(error: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (k, v)])
    return F.try_element_at(pairs, error)


def usage(provider: Column, raw: Column) -> Column:
    """Four neutral counters from a provider's own (a map of names to numbers)."""
    get = lambda *names: F.coalesce(*[F.try_element_at(raw, F.lit(n)) for n in names], F.lit(0).cast("bigint"))
    thinking = F.when(provider == "gemini", get("thoughts_token_count")).otherwise(F.lit(0))
    hits = F.when(provider != "openai_compat", get("cache_read_input_tokens", "cached_content_token_count", "cached_tokens")).otherwise(F.lit(0))
    return F.struct(
        get("input_tokens", "prompt_token_count", "prompt_tokens").cast("bigint").alias("input_tokens"),
        (get("output_tokens", "candidates_token_count", "completion_tokens") + thinking).cast("bigint").alias("output_tokens"),
        get("cache_creation_input_tokens", "cache_write_tokens").cast("bigint").alias("cache_write_tokens"), hits.cast("bigint").alias("cached_read_tokens"),
    )


def prompt_blocks(shared: Column, kind_rules: Column, document: Column, instruction: Column, error: Column | None = None) -> Column:
    """The prompt in the order that keeps its prefix cacheable; a retry tells the error before.  Empty blocks go."""
    last = instruction if error is None else F.concat(instruction, F.coalesce(F.concat(F.lit("\n\n"), error), F.lit("")))
    block = lambda t, c: F.struct(t.alias("text"), F.lit(c).alias("cacheable"))
    return F.filter(F.array(block(shared, True), block(kind_rules, True), block(document, True), block(last, False)), lambda b: F.coalesce(b["text"], F.lit("")) != "")


def image_caption(page: Column) -> Column:
    """What is said before the image of a page."""
    return F.concat(F.lit("[หน้า "), page.cast("string"), F.lit(" — ภาพหน้าเอกสารที่สแกน]"))


def user_content(images: Column, message: Column) -> Column:
    """The user's turn: for each image (page, media_type, content) its caption and itself, then the message; without images the message alone.

    The last image ends the part that may be cached.
    """
    block = lambda kind, text=None, media=None, data=None, cached=False: F.struct(F.lit(kind).alias("kind"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if media is None else media).cast("string").alias("media_type"), (F.lit(None) if data is None else data).cast("string").alias("data"), (F.lit(cached) if isinstance(cached, bool) else cached).alias("cacheable"))
    each = F.transform(images, lambda x, i: F.array(block("text", image_caption(x["page"])), block("image", None, x["media_type"], F.base64(x["content"]), i == F.size(images) - 1)))
    return F.concat(F.coalesce(F.flatten(each), F.array().cast("array<struct<kind:string,text:string,media_type:string,data:string,cacheable:boolean>>")), F.array(block("text", message)))
