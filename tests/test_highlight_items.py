import random

from pyspark.sql import functions as F

from citeframe.functions import text as X
from citeframe.operators import highlight

ITEM, QUOTE = "doc_id int, item bigint, text string", "doc_id int, quote bigint, text string"


def _both(spark, items, quotes):
    got = {(r.doc_id, r.quote): r.marked for r in highlight.highlight_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(quotes, QUOTE)).collect()}
    pairs = spark.createDataFrame(items, ITEM).withColumnRenamed("text", "t").join(spark.createDataFrame(quotes, QUOTE), "doc_id").filter(X.highlights(F.col("text"), F.col("t")))
    want = {}
    for r in pairs.collect():
        want.setdefault((r.doc_id, r.quote), []).append(r.item)
    return got, {k: sorted(v) for k, v in want.items()}


def test_same_as_pair_by_pair(spark):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("ab กé\n ") for _ in range(rnd.randint(0, n)))
    items = [(d, k, rnd.choice((text(3), None))) for d in range(4) for k in range(60)]
    quotes = [(d, k, rnd.choice((text(30), text(5), None))) for d in range(5) for k in range(40)]
    got, want = _both(spark, items, quotes)
    assert set(got) == {q[:2] for q in quotes}  # a row for every quote
    assert {k: v for k, v in got.items() if v} == want and len(want) > 50


def test_forms_and_ends(spark):
    items = [(1, 0, "é"), (1, 1, "é  x"), (1, 2, " "), (1, 3, "é"), (1, 4, None), (1, 5, "xy"), (1, 6, "x"), (None, 7, "q")]
    got, _ = _both(spark, items, [(1, 0, "é\tx"), (1, 1, "xyx"), (1, 2, ""), (1, 3, None), (2, 0, "x"), (None, 0, "qq")])
    assert got == {(1, 0): [0, 1, 3, 6], (1, 1): [5, 6], (1, 2): [], (1, 3): [], (2, 0): [], (None, 0): [7]}


def test_quotes_of_a_large_document_are_dealt_out(spark):
    items = [(1, k, f"w{k} ") for k in range(50)] + [(2, 0, "w1")]
    quotes = [(1, k, f"a w{k % 60} b") for k in range(5000)] + [(2, 0, "w10")]
    found = highlight.highlight_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(quotes, QUOTE))
    got = {(r.doc_id, r.quote): r.marked for r in found.collect()}
    assert len(got) == 5001 and got[2, 0] == [0]
    for _, k, q in quotes[:-1]:
        assert got[1, k] == [i for _, i, t in items[:-1] if t.strip() in q]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so little is one task
    found = highlight.highlight_items(spark.createDataFrame(items, ITEM), spark.createDataFrame(quotes, QUOTE))
    sizes = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1600


def test_nothing(spark):
    none = spark.createDataFrame([], ITEM)
    assert highlight.highlight_items(none, spark.createDataFrame([(1, 0, "x")], QUOTE)).collect()[0].marked == []
    assert highlight.highlight_items(none, spark.createDataFrame([], QUOTE)).count() == 0
