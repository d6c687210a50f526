"""Scoring predictions against annotations: greedy list matching, verdicts, tallies, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions.text import MATCH_THRESHOLD, prepared, prepared_similarity, verdict

VERDICTS = ("exact", "wrong", "missed", "hallucinated")
#: Parts of a document that aren't scored.
EXCLUDED = ("risk_flags",)
#: Lists of more pairs are matched by joins.
IN_ROW = 10_000
#: Crashed documents that a summary names.
CRASHED_TOLD = 20


def greedy_match(expected: Column, actual: Column, threshold: float = MATCH_THRESHOLD) -> Column:
    """array<struct<i, j>>: items of two lists paired one to one, the most similar first, ties by i, then j.

    Lists are those of one document and stay inside the row; of all pairs only those that reach the threshold are kept.
    """
    pair = lambda e, i, a, j: F.struct((-prepared_similarity(e, a)).alias("s"), i.alias("i"), j.alias("j"))
    # both lists are bound as one struct, or the inner one would be prepared again for every outer item
    lists = F.array(F.struct(prepared(expected).alias("e"), prepared(actual).alias("a")))
    near = lambda p: lambda e, i: F.filter(F.transform(p["a"], lambda a, j: pair(e, i, a, j)), lambda x: -x["s"] >= threshold)
    ranked = F.array_sort(F.flatten(F.flatten(F.transform(lists, lambda p: F.transform(p["e"], near(p))))))
    taken = lambda acc, x: F.exists(acc, lambda p: (p["i"] == x["i"]) | (p["j"] == x["j"]))
    none = F.array().cast("array<struct<i:int,j:int>>")
    return F.aggregate(ranked, none, lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.concat(acc, F.array(F.struct(x["i"].alias("i"), x["j"].alias("j"))))))


def unmatched(items: Column, pairs: Column, side: str) -> Column:
    """Positions of the items that no pair has."""
    every = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda k: ~F.exists(pairs, lambda p: p[side] == k))


def tally(leaves: DataFrame, *keys: str) -> DataFrame:
    """Counts of each verdict by keys, from leaves (keys, verdict)."""
    return leaves.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def merge(tallies: DataFrame, *keys: str) -> DataFrame:
    return tallies.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in VERDICTS])


def worst_first(tallies: DataFrame) -> DataFrame:
    bad = F.col("wrong") + F.col("missed") + F.col("hallucinated")
    return tallies.withColumn("bad", bad).orderBy(F.desc("bad"), F.desc("path"))


def list_report(lists: DataFrame) -> DataFrame:
    """lists (doc_id, path, expected, actual) with sizes and unmatched counts, where anything is unmatched."""
    # a filter on plain columns would be pushed down and match the lists again, so the counts are exploded from a filtered array
    n = F.size(greedy_match(F.col("expected"), F.col("actual")))
    counts = F.transform(F.array(n), lambda k: F.struct((F.size("expected") - k).alias("missed"), (F.size("actual") - k).alias("extra")))
    rows = lists.select("doc_id", "path", F.size("expected").alias("n_expected"), F.size("actual").alias("n_actual"), F.explode(F.filter(counts, lambda c: (c["missed"] > 0) | (c["extra"] > 0))).alias("c"))
    return rows.select("doc_id", "path", "n_expected", "n_actual", "c.missed", "c.extra")


def _within_row(both: DataFrame) -> DataFrame:
    """(doc_id, path, i, j, leaves, other) of lists that are paired within the row."""
    nothing = F.coalesce("a", F.expr("slice(e, 1, 0)"))
    both = both.withColumn("a", nothing).withColumn("pairs", greedy_match(F.col("e.text"), F.col("a.text")))
    item = both.select("doc_id", "path", "a", "pairs", F.posexplode("e").alias("i", "item"))
    j = F.filter("pairs", lambda p: p["i"] == F.col("i"))
    item = item.withColumn("j", F.when(F.size(j) > 0, F.element_at(j, 1)["j"]))
    return item.select("doc_id", "path", "i", "j", "item.leaves", F.when(F.col("j").isNotNull(), F.element_at("a", F.col("j") + 1)["leaves"]).alias("other"))


def _by_joins(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The same of lists that are paired by joins, item by item."""
    from citeframe.operators.matching import match_lists

    order = Window.partitionBy("doc_id", "path").orderBy("idx", "text", "leaves")  # the items of one list
    numbered = lambda d, n: d.select("doc_id", "path", "idx", "text", F.map_entries("leaves").alias("leaves")).withColumn(n, (F.row_number().over(order) - 1).cast("int"))
    e, a = numbered(expected, "i"), numbered(actual, "j")
    pairs = match_lists(e.select("doc_id", "path", "i", "text"), a.select("doc_id", "path", "j", "text")).select("doc_id", "path", "i", "j")
    items = e.select("doc_id", "path", "i", "leaves").join(pairs, ["doc_id", "path", "i"], "left")
    return items.join(a.select("doc_id", "path", "j", F.col("leaves").alias("other")), ["doc_id", "path", "j"], "left").select("doc_id", "path", "i", "j", "leaves", "other")


def score_lists(expected: DataFrame, actual: DataFrame, in_row: int = IN_ROW) -> DataFrame:
    """Leaves of matched list items.

    Both sides: (doc_id, path, idx, text, leaves map<string,string>).  An item without a partner is compared with
    nothing: its null leaves are exact, the others missed.  Lists of up to `in_row` pairs are paired within the row,
    longer ones by joins; the pairs are the same.
    """
    count = lambda d, n: d.groupBy("doc_id", "path").agg(F.count("*").alias(n))
    long = count(expected, "n").join(count(actual, "m"), ["doc_id", "path"]).filter(F.col("n") * F.col("m") > in_row).select("doc_id", "path")
    gather = lambda d, n: d.groupBy("doc_id", "path").agg(F.sort_array(F.collect_list(F.struct("idx", "text", F.map_entries("leaves").alias("leaves")))).alias(n))
    rows = lambda e, a: _within_row(gather(e, "e").join(gather(a, "a"), ["doc_id", "path"], "left"))
    if long.isEmpty():
        item = rows(expected, actual)
    else:
        short = lambda d, how: d.join(long, ["doc_id", "path"], how)
        item = rows(short(expected, "left_anti"), short(actual, "left_anti")).unionByName(_by_joins(short(expected, "left_semi"), short(actual, "left_semi")))
    leaf = item.withColumn("other", F.map_from_entries("other")).select("doc_id", "path", "i", "j", "other", F.explode("leaves").alias("leaf"))
    return leaf.select("doc_id", F.concat("path", F.lit("[]."), "leaf.key").alias("path"), "i", verdict(F.col("leaf.value"), F.try_element_at("other", F.col("leaf.key"))).alias("verdict"))


def crashed_documents(runs: DataFrame) -> DataFrame:
    """(provider, model, doc_id) of every crashed document."""
    return runs.filter("crashed").select("provider", "model", "doc_id")


def provider_summary(tallies: DataFrame, runs: DataFrame, told: int | None = CRASHED_TOLD) -> DataFrame:
    """Totals by (provider, model) with the crashed documents and the cost; `none` and `unknown` where there are none.

    tallies: (provider, model, verdict counts); runs: (provider, model, doc_id, crashed, usd).  Of the crashed
    documents, the first `told` by id as text are named, and how many more there are; all if `told` is None, which
    makes one text of all names of a provider and model.  crashed_documents has a row for each.
    """
    total = merge(tallies, "provider", "model")
    usd = F.when(F.bool_or(F.col("usd").isNull() & ~F.col("crashed")), "unknown").otherwise(F.concat(F.lit("$"), F.format_string("%.4f", F.coalesce(F.sum("usd"), F.lit(0.0)))))
    about = runs.groupBy("provider", "model").agg(F.count_if("crashed").alias("n"), usd.alias("cost"))
    first = crashed_documents(runs).select("provider", "model", F.col("doc_id").cast("string").alias("id"))
    more = F.lit("")
    if told is not None:
        # ranks up to a limit are cut before the shuffle, so what meets is `told` names from each task
        rank = F.row_number().over(Window.partitionBy("provider", "model").orderBy("id"))
        first = first.withColumn("k", rank).filter(F.col("k") <= told)
        more = F.when(F.col("n") > told, F.concat(F.lit(" and "), (F.col("n") - told).cast("string"), F.lit(" more"))).otherwise("")
    names = first.groupBy("provider", "model").agg(F.expr("listagg(id, ', ') within group (order by id)").alias("names"))
    about = about.join(names, ["provider", "model"], "left").select("provider", "model", F.when(F.col("n") == 0, "none").otherwise(F.concat("names", more)).alias("crashed"), "cost")
    return about.join(total, ["provider", "model"], "left")
