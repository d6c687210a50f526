"""Whole documents: scoring a nested prediction against a nested annotation, and what is told about it.

Both sides are nested tables with one row for each document.  They are joined once; all leaves, list matching
included, are compared within the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StringType, StructType

from citeframe.functions.text import number_verdict, primary_text, verdict
from citeframe.operators import score
from citeframe.shared import settle

_LEAF = {"value", "source", "confidence", "reason"}
#: Fields that stand for a list item, the first that isn't empty.
_PRIMARY = ("text", "phase", "type", "description")
_LISTS = "array<struct<path:string,n_expected:int,n_actual:int,missed:int,extra:int>>"


def is_leaf(kind: DataType | None) -> bool:
    return isinstance(kind, StructType) and _LEAF <= set(kind.fieldNames())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def item_text(item: Column, kind: DataType) -> Column:
    """What a list item is matched by."""
    if is_leaf(kind):
        return F.coalesce(_told(item["value"], kind["value"].dataType), F.lit(""))
    if isinstance(kind, StructType):
        leaves = [f for f in kind.fields if is_leaf(f.dataType)]
        first = [item[n]["value"] for n in _PRIMARY if any(f.name == n for f in leaves)]
        return primary_text(*first, rest=[item[f.name]["value"] for f in leaves if not isinstance(f.dataType["value"].dataType, ArrayType)])
    return _told(item, kind)


def _told(value: Column, kind: DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (ArrayType, StructType)) else value.cast("string")


_PAIR = "struct<path:string,text:boolean,es:string,as:string,ed:double,ad:double,en:boolean,an:boolean,same:boolean>"


def _pair(path: str, kind: DataType, e: Column, a: Column) -> Column:
    """The two values of a leaf, in the columns of its kind; what they come to is told once for all leaves, by _judged."""
    none = F.lit(None)
    text, number = isinstance(kind, StringType), isinstance(kind, (DoubleType, FloatType))
    values = [F.lit(path), F.lit(text), *((e, a) if text else (none, none)), *((e, a) if number else (none, none)), e.isNull(), a.isNull(), none if text or number else e == a]
    return F.struct(*values).cast(_PAIR)


def _judged(x: Column) -> Column:
    """path and verdict of such a pair."""
    other = F.when(x["en"] & x["an"], "exact").when(x["en"], "hallucinated").when(x["an"], "missed").when(x["same"], "exact").otherwise("wrong")
    found = F.when(x["text"], verdict(x["es"], x["as"])).when(x["ed"].isNotNull() & x["ad"].isNotNull(), number_verdict(x["ed"], x["ad"])).otherwise(other)
    return F.struct(x["path"].alias("path"), found.alias("verdict"))


def _field(kind: DataType | None, name: str) -> DataType | None:
    return kind[name].dataType if isinstance(kind, StructType) and name in kind.fieldNames() else None


def _texts(items: Column, of: DataType) -> Column:
    return F.transform(items, lambda x: item_text(x, of))


def _partners(e: Column, a: Column, kind: DataType, other: DataType) -> Column:
    """array<int>: for each item of a list the position of its partner in the other one, null if it has none."""
    of = lambda pairs: F.transform(e, lambda x, i: F.get(F.filter(pairs, lambda q: q["i"] == i), F.lit(0))["j"])
    return bound(score.greedy_match(_texts(e, kind), _texts(a, other)), of)


def _walk(path: str, e: Column, a: Column | None, kind: DataType, other: DataType | None, partners: Column | None = None) -> Column:
    """The pairs of everything under one node; a is None where the prediction has no such part.  partners: those of a list's items, if they are known."""
    told = lambda value, e, a: F.array(_pair(path, value, e, F.lit(None).cast(value) if a is None else a))
    if is_leaf(kind):
        return told(kind["value"].dataType, e["value"], None if a is None or not is_leaf(other) else a["value"])
    if isinstance(kind, StructType):
        return F.concat(*[_walk(f"{path}.{f.name}", e[f.name], None if a is None or _field(other, f.name) is None else a[f.name], f.dataType, _field(other, f.name)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        inner = other.elementType if isinstance(other, ArrayType) else kind.elementType
        none = F.array().cast(ArrayType(inner))
        have = none if a is None or not isinstance(other, ArrayType) else F.coalesce(a, none)

        def items(p: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                return bound(F.get(p["a"], F.get(p["of"], i)), lambda y: _walk(f"{path}[]", x, y, kind.elementType, inner))

            return F.flatten(F.transform(p["e"], one))

        matched = lambda x: _partners(x["e"], x["a"], kind.elementType, inner) if partners is None else partners
        empty = F.array().cast(f"array<{_PAIR}>")
        lists = F.struct(F.coalesce(e, F.array().cast(kind)).alias("e"), have.alias("a"))
        return F.coalesce(bound(lists, lambda x: bound(F.struct(x["e"].alias("e"), x["a"].alias("a"), matched(x).alias("of")), items)), empty)
    return told(kind, e, a)


def _both(expected: DataFrame, actual: DataFrame) -> DataFrame:
    pack = lambda d, n: d.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in d.columns if c != "doc_id"]).alias(n))
    return pack(expected, "e").join(pack(actual, "a"), "doc_id")


def _scored(expected: DataFrame) -> Iterator:
    return (f for f in expected.schema.fields if f.name != "doc_id" and f.name not in score.EXCLUDED)


def _listed(expected: DataFrame, kind: StructType) -> list:
    """The top-level lists that both sides have."""
    return [f for f in _scored(expected) if isinstance(f.dataType, ArrayType) and isinstance(_field(kind, f.name), ArrayType)]


def long_lists(expected: DataFrame, actual: DataFrame, in_row: int = score.IN_ROW) -> DataFrame | None:
    """(doc_id, path, of): the partners (see _partners) of the top-level lists that have more than `in_row` pairs, found by joins; None if there are none.

    For evaluation, score_document and list_lengths, which pair the other lists within the row.
    """
    from citeframe.operators.matching import match_lists

    both = _both(expected, actual)
    kind = both.schema["a"].dataType
    fields = _listed(expected, kind)
    if not fields:
        return None
    item = lambda side, f, of: F.coalesce(_texts(F.col(side)[f.name], of), F.array().cast("array<string>"))
    size = lambda side, f: F.coalesce(F.size(F.col(side)[f.name]), F.lit(0)).cast("bigint")
    each = [F.when(size("e", f) * size("a", f) > in_row, F.struct(F.lit(f.name).alias("path"), item("e", f, f.dataType.elementType).alias("e"), item("a", f, _field(kind, f.name).elementType).alias("a"))) for f in fields]
    long = settle(both.select("doc_id", F.explode_outer(F.array(*each)).alias("x")).filter("x is not null").select("doc_id", "x.*"))
    if long.isEmpty():
        return None
    e, a = long.select("doc_id", "path", F.posexplode("e").alias("i", "text")), long.select("doc_id", "path", F.posexplode("a").alias("j", "text"))
    found = e.select("doc_id", "path", "i").join(match_lists(e, a).select("doc_id", "path", "i", "j"), ["doc_id", "path", "i"], "left")
    return found.groupBy("doc_id", "path").agg(F.sort_array(F.collect_list(F.struct("i", "j")))["j"].alias("of"))


def evaluation(expected: DataFrame, actual: DataFrame, *told: str, partners: DataFrame | None = None) -> DataFrame:
    """All that is told of documents (doc_id, nested columns) that both sides have, one row for each, found in one pass.

    doc_id; leaves: array<struct<path, verdict>>; expected_flags and actual_flags, how many risk flags each has; lists:
    array<struct<path, n_expected, n_actual, missed, extra>> of the top-level lists that don't pair up whole.  Lists are
    paired once for both, within the row but for those of `partners` (see long_lists).  told: only these columns beside doc_id.
    """
    wanted = told or ("leaves", "expected_flags", "actual_flags", "lists")
    both = _both(expected, actual)
    kind = both.schema["a"].dataType
    fields, listed = list(_scored(expected)), _listed(expected, kind)
    if partners is not None:
        both = both.join(partners.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "of"))).alias("of")), "doc_id", "left")
    whole = lambda side, name: F.coalesce(F.col(side)[name], F.array().cast(both.schema[side].dataType[name].dataType))

    def made(m: Column) -> Column:
        """The result's columns, from the partners of all lists."""
        parts = [_walk(f.name, F.col("e")[f.name], F.col("a")[f.name] if f.name in kind.fieldNames() else None, f.dataType, _field(kind, f.name), m[f.name] if f in listed else None) for f in fields if "leaves" in wanted]
        n = lambda side, f: F.size(whole(side, f.name))
        paired = lambda f: F.size(F.array_compact(m[f.name]))
        uneven = [F.struct(F.lit(f.name).alias("path"), n("e", f).alias("n_expected"), n("a", f).alias("n_actual"), (n("e", f) - paired(f)).alias("missed"), (n("a", f) - paired(f)).alias("extra")) for f in listed if "lists" in wanted]
        lists = F.filter(F.array(*uneven), lambda x: (x["missed"] > 0) | (x["extra"] > 0)) if uneven else F.array().cast(_LISTS)
        # a missing list has none
        flags = lambda side: F.greatest(F.coalesce(F.size(F.col(side)["risk_flags"]), F.lit(0)), F.lit(0)) if "risk_flags" in both.schema[side].dataType.fieldNames() else F.lit(0)
        leaves = F.transform(F.concat(*parts) if parts else F.array().cast(f"array<{_PAIR}>"), _judged)
        return F.struct(*[c.alias(n) for n, c in {"leaves": leaves, "expected_flags": flags("e"), "actual_flags": flags("a"), "lists": lists}.items() if n in wanted])

    within = lambda f: _partners(whole("e", f.name), whole("a", f.name), f.dataType.elementType, _field(kind, f.name).elementType)
    known = lambda f: F.when(F.map_contains_key("of", f.name), F.try_element_at("of", F.lit(f.name)))
    matched = [(within(f) if partners is None else F.when(known(f).isNull(), within(f)).otherwise(known(f))).alias(f.name) for f in listed]
    return both.select("doc_id", bound(F.struct(*matched, F.lit(0).alias("")), made).alias("x")).select("doc_id", "x.*")


def _each(rows: DataFrame, column: str) -> DataFrame:
    """A row for each item.  An inner explosion would first be filtered by the array's size, and so have all of it computed again."""
    return rows.select("doc_id", F.inline_outer(column)).filter("path is not null")


def score_document(expected: DataFrame, actual: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """doc_id, path and verdict of every leaf of the annotation, of documents (doc_id, nested columns) that both sides have.

    Only what the annotation holds is walked: further columns of the prediction are ignored, missing ones are nulls.
    Items of a list are paired by likeness and pooled under `path[]`; an item without a partner is compared with
    nothing, so its null leaves are exact and the others missed.  Risk flags are counted, not scored.
    partners: those of lists too long for a row, from long_lists.
    """
    return _each(evaluation(expected, actual, "leaves", partners=partners), "leaves")


def list_lengths(expected: DataFrame, actual: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, n_expected, n_actual, missed, extra) of the top-level lists that don't pair up whole."""
    return _each(evaluation(expected, actual, "lists", partners=partners), "lists")


def risk_flag_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """doc_id and how many risk flags each side has; a missing list has none."""
    count = lambda d, name: d.select("doc_id", F.when(F.col("risk_flags").isNull(), 0).otherwise(F.size("risk_flags")).alias(name))
    return count(expected, "expected").join(count(actual, "actual"), "doc_id")


def run_status(expected: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id and status of every annotated document: scored, crashed, or skipped where it has no run.  runs: (doc_id, crashed)."""
    status = F.when(F.col("crashed").isNull(), "skipped").when(F.col("crashed"), "crashed").otherwise("scored")
    return expected.select("doc_id").join(runs.select("doc_id", "crashed"), "doc_id", "left").select("doc_id", status.alias("status"))


class NothingScored(ValueError):
    """A run of an evaluation in which no document was scored."""


def report(expected: DataFrame, actual: DataFrame, runs: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """The evaluation report (see report_lines) of annotated documents whose run, (doc_id, crashed), didn't crash.

    What is told of each document is found in one pass and kept in the shared folder; the same pass counts the
    documents.  None scored is an error, which says how many crashed and how many had no run.
    """
    scored = run_status(expected.select("doc_id"), runs).filter("status = 'scored'").select("doc_id")
    seen = Observation()
    actual = actual.join(scored, "doc_id", "left_semi")
    told = settle(evaluation(expected, actual, partners=long_lists(expected, actual)).observe(seen, F.count("*").alias("n")))
    n = seen.get.get("n", 0)
    if not n:
        status = {r.status: r.n for r in run_status(expected.select("doc_id"), runs).groupBy("status").agg(F.count("*").alias("n")).collect()}  # three at most
        raise NothingScored(f"nothing was scored: {status.get('crashed', 0)} crashed, {status.get('skipped', 0)} without a run, {status.get('scored', 0)} without a result")
    flags = told.select("doc_id", F.col("expected_flags").alias("expected"), F.col("actual_flags").alias("actual"))
    return report_lines(_each(told, "leaves"), flags, _each(told, "lists"), cost, n)


def report_lines(leaves: DataFrame, flags: DataFrame, lists: DataFrame, cost: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """The evaluation report as rows (part, rank, line), to be written in that order.

    leaves: (doc_id, path, verdict); flags: risk_flag_counts; lists: list_lengths; cost: (usd, thb, usd_thb_rate,
    pricing_as_of); n: how many documents there are, by default the rows of flags.  Counts by path and of all leaves
    are grouping sets of one pass.  Rows may be as many as the documents, so nothing comes to the driver.
    """
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[x.cast("string") for x in c]), F.lit(" |"))
    rank = lambda *c: F.concat_ws("\u0001", *c)
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in score.VERDICTS]
    # a row without a path, so that there is a total even where nothing has leaves
    none = leaves.sparkSession.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("verdict"))
    tallies = leaves.select("path", "verdict").unionByName(none).groupingSets([[F.col("path")], []], F.col("path")).agg(*counts, F.grouping_id().alias("whole")).filter("whole = 1 or path is not null")
    bad = F.col("wrong") + F.col("missed") + F.col("hallucinated")
    # the worst first, then the last path first: a descending order as an ascending text
    upside = F.lpad((F.lit(10**15) - bad).cast("string"), 16, "0")
    backwards = F.translate(F.hex(F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("00")))), "0123456789ABCDEF", "FEDCBA9876543210")
    total = F.col("whole") == 1
    titled = lambda x: F.concat(F.lit("# Evaluation of "), x.cast("string"), F.lit(" document(s)"))
    title = leaves.sparkSession.range(1).select(titled(F.lit(n)).alias("line")) if n is not None else flags.agg(titled(F.count("*")).alias("line"))
    parts = [
        title.select(F.lit(0).alias("part"), F.lit("").alias("rank"), "line"),
        tallies.select(F.when(total, 2).otherwise(1).alias("part"), F.when(total, "").otherwise(rank(upside, backwards)).alias("rank"), cells(F.when(total, "total").otherwise(F.col("path")), *[F.col(v) for v in score.VERDICTS]).alias("line")),
        flags.select(F.lit(3).alias("part"), F.col("doc_id").cast("string").alias("rank"), cells(F.col("doc_id"), F.col("expected"), F.col("actual")).alias("line")),
        lists.select(F.lit(4).alias("part"), rank(F.col("doc_id").cast("string"), F.col("path")).alias("rank"), F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(": "), F.col("path"), F.format_string(": %d expected, %d actual, %d missed, %d extra (not penalised)", "n_expected", "n_actual", "missed", "extra")).alias("line")),
    ]
    if cost is not None:
        parts.append(cost.select(F.lit(5).alias("part"), F.lit("").alias("rank"), F.when(F.col("usd").isNull(), F.lit("cost unknown")).otherwise(F.concat(F.lit("cost $"), F.format_string("%.4f", "usd"), F.lit(" (~฿"), F.format_string("%.2f", "thb"), F.lit(" @ "), F.col("usd_thb_rate").cast("string"), F.lit(", prices as of "), F.col("pricing_as_of"), F.lit(")"))).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def comparison_lines(summary: DataFrame) -> DataFrame:
    """One table row for each provider and model of score.provider_summary, as (part, rank, line)."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", F.concat_ws("/", "provider", "model"), *[F.coalesce(F.col(v), F.lit(0)).cast("string") for v in score.VERDICTS], "crashed", "cost"), F.lit(" |"))
    return summary.select(F.lit(1).alias("part"), F.concat_ws("/", "provider", "model").alias("rank"), cells.alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines as text files in order."""
    lines.orderBy("part", "rank").select("line").write.text(path)
