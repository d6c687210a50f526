"""Greedy matching of two long lists as joins: the same pairs as score.greedy_match, without all pairs of a list.

Items of equal text are one class.  A class is known by its bigrams, rarest first within its document, so what can be
similar is found by joins on bigrams:

- similarity 1: who holds a text holds its rarest bigram, and so does who has the same bigrams;
- similarity t or more (Jaccard): both share one of the rarest n - ceil(t n) + 1 of their n bigrams, and their
  numbers of bigrams differ by a factor of t at most.  A pair is made at its first common one only.

The greedy choice goes from high to low, so it runs by falling bands of similarity, and only items that are still free
go on to the next one, where more has to be compared.  Within a band, the pairs of classes come sorted to the task
that has their document and are taken as they pass; what the task holds is the document's free positions.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.functions.text import MATCH_THRESHOLD, bigrams, squeeze
from citeframe.shared import settle
from citeframe.shipping import ship

#: Lower ends of the bands between 1 and the threshold.
BANDS = (0.8, 0.6, 0.45)
_TAKEN = "_doc string, x int, y int, i int, j int, similarity double"


def _classes(items: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(_doc, c, t, at): a row for each distinct text that isn't empty, named by its first position; keys become one column."""
    text = squeeze(F.coalesce(F.col("text"), F.lit("")))
    rows = items.select(F.to_json(F.struct(*keys)).alias("_doc"), F.col(position).cast("int").alias("p"), text.alias("t")).filter("t <> ''")
    return rows.groupBy("_doc", "t").agg(F.sort_array(F.collect_list("p")).alias("at")).withColumn("c", F.element_at("at", 1))


def _ranked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides' classes with g: the ranks of their bigrams by rarity within the document, rising."""
    from pyspark.sql import Window

    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    each = both.select("_doc", "side", "c", F.explode(bigrams(F.col("t"))).alias("gram"))
    rank = F.row_number().over(Window.partitionBy("_doc").orderBy("n", "gram"))  # the bigrams of one document
    known = each.groupBy("_doc", "gram").agg(F.count("*").alias("n")).withColumn("r", rank).select("_doc", "gram", "r")
    grams = each.join(known, ["_doc", "gram"]).groupBy("_doc", "side", "c").agg(F.sort_array(F.collect_list("r")).alias("g"))
    return both.join(grams, ["_doc", "side", "c"])


def _side(rows: DataFrame, side: int, name: str, *more: Column) -> DataFrame:
    return rows.filter(F.col("side") == side).select("_doc", F.col("c").alias(name), *[F.col(c).alias(c + name) for c in ("t", "g")], *more)


def _same(rows: DataFrame) -> DataFrame:
    """(_doc, x, y): classes of similarity 1: one text holds the other, or they have the same bigrams."""
    x, y = _side(rows, 0, "x"), _side(rows, 1, "y")
    rarest = lambda n: F.get(f"g{n}", F.lit(0)).alias("r")
    every = lambda n: F.explode(f"g{n}").alias("r")
    inside = F.col("ty").contains(F.col("tx")) | (F.col("gx") == F.col("gy"))
    up = x.select("*", rarest("x")).join(y.select("*", every("y")), ["_doc", "r"]).filter(inside)
    down = x.select("*", every("x")).join(y.select("*", rarest("y")), ["_doc", "r"]).filter(F.col("tx").contains(F.col("ty")) & ~inside)
    # a single character is no bigram of a longer text
    letters = lambda n: F.explode(F.array_distinct(F.split(f"t{n}", ""))).alias("letter")
    one = lambda d, n: d.filter(F.length(f"t{n}") == 1).select("*", F.col(f"t{n}").alias("letter"))
    long = lambda d, n: d.filter(F.length(f"t{n}") > 1).select("*", letters(n))
    single = one(x, "x").join(long(y, "y"), ["_doc", "letter"]).unionByName(long(x, "x").join(one(y, "y"), ["_doc", "letter"]))
    return up.select("_doc", "x", "y").unionByName(down.select("_doc", "x", "y")).unionByName(single.select("_doc", "x", "y")).withColumn("similarity", F.lit(1.0))


def _alike(rows: DataFrame, least: float) -> DataFrame:
    """(_doc, x, y, similarity): classes whose bigrams have a Jaccard similarity of `least` or more."""
    # rounding mustn't shorten a prefix
    prefix = F.slice("g", F.lit(1), (F.size("g") - F.ceil(F.size("g") * least - 1e-9) + 1).cast("int"))
    rows = rows.withColumn("prefix", prefix)
    probe = lambda s, n: _side(rows, s, n, F.col("prefix").alias(f"p{n}"), F.explode("prefix").alias("r"))
    a, b = F.size("gx"), F.size("gy")
    near = (a >= b * least - 1e-9) & (b >= a * least - 1e-9) & (F.get(F.array_intersect("px", "py"), F.lit(0)) == F.col("r"))
    found = probe(0, "x").join(probe(1, "y"), ["_doc", "r"]).filter(near)
    common = F.size(F.array_intersect("gx", "gy"))
    return found.select("_doc", "x", "y", a.alias("a"), b.alias("b"), common.alias("n")).select("_doc", "x", "y", (F.col("n") / (F.col("a") + F.col("b") - F.col("n")).cast("double")).alias("similarity")).filter(F.col("similarity") >= least)


class _Document:
    """The free positions of one document's classes, and the pairs taken."""

    def __init__(self) -> None:
        self.free: tuple[dict, dict] = ({}, {})
        self.pairs: list[tuple] = []

    def level(self, edges: list[tuple[int, int]], similarity: float) -> None:
        """Pairs of one similarity: by rising i, each with the smallest j that is free."""
        left, right = self.free
        near = defaultdict(list)
        for x, y in edges:
            if left.get(x) and right.get(y):
                near[x].append(y)
        heap = [(left[x][-1], x) for x in near]
        heapq.heapify(heap)
        while heap:
            i, x = heap[0]
            open_ = [y for y in near[x] if right[y]]
            near[x] = open_
            if not open_:
                heapq.heappop(heap)
                continue
            y = min(open_, key=lambda y: right[y][-1])
            self.pairs.append((x, y, i, right[y].pop(), similarity))
            left[x].pop()
            if left[x]:
                heapq.heapreplace(heap, (left[x][-1], x))
            else:
                heapq.heappop(heap)


def _take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document: its classes (side 0 and 1), then their pairs (side 2) by falling similarity."""
    now, doc, edges, last = None, _Document(), [], 0.0

    def told() -> Iterator[pa.RecordBatch]:
        if edges:
            doc.level(edges, last)
        if doc.pairs:
            x, y, i, j, s = zip(*doc.pairs, strict=True)
            ints = [pa.array(v, pa.int32()) for v in (x, y, i, j)]
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(s)), *ints, pa.array(s, pa.float64())], names=["_doc", "x", "y", "i", "j", "similarity"])

    for batch in batches:
        names = batch.column("_doc").to_pylist()
        side, x, y, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "x", "y", "similarity"))
        at = batch.column("at")
        for k in range(batch.num_rows):
            if names[k] != now:
                yield from told()
                now, doc, edges, last = names[k], _Document(), [], 0.0
            if side[k] < 2:
                doc.free[side[k]][int(x[k])] = at[k].as_py()[::-1]
            else:
                if s[k] != last and edges:
                    doc.level(edges, last)
                    edges = []
                last = float(s[k])
                edges.append((int(x[k]), int(y[k])))
    yield from told()


def match_lists(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("doc_id", "path"), threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """keys, i, j and similarity: items paired one to one within keys, the most similar first, ties by i, then j.

    expected: (keys, i, text), actual: (keys, j, text); i and j are distinct within keys.  Items without a text (null,
    empty or white space) are similar to none.  A document's lists of texts needn't fit a task, its positions have to.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    spark = expected.sparkSession
    ship(spark)
    named = list(keys)
    rows = settle(_ranked(_classes(expected, named, "i"), _classes(actual, named, "j")))
    free = rows.select("_doc", "side", F.col("c").alias("x"), "at")
    found: DataFrame | None = None
    for least in (1.0, *[b for b in BANDS if threshold < b < 1], *([threshold] if threshold < 1 else [])):
        open_ = rows.drop("at").join(free.select("_doc", "side", F.col("x").alias("c")), ["_doc", "side", "c"], "left_semi")
        edges = _same(open_) if least == 1 else _alike(open_, least)
        stream = free.select("_doc", "side", "x", F.lit(0).alias("y"), F.lit(2.0).alias("similarity"), "at").unionByName(
            edges.select("_doc", F.lit(2).alias("side"), "x", "y", "similarity", F.lit(None).cast("array<int>").alias("at")))
        taken = settle(stream.repartition("_doc").sortWithinPartitions("_doc", "side", F.desc("similarity"), "x", "y").mapInArrow(_take, _TAKEN))
        found = taken if found is None else found.unionByName(taken)
        gone = lambda c, p, side: taken.groupBy("_doc", F.col(c).alias("x")).agg(F.collect_list(p).alias("gone")).withColumn("side", F.lit(side))  # noqa: E731, B023
        both = gone("x", "i", 0).unionByName(gone("y", "j", 1))
        left = F.when(F.col("gone").isNull(), F.col("at")).otherwise(F.array_except("at", F.coalesce("gone", F.array().cast("array<int>"))))
        free = settle(free.join(both, ["_doc", "side", "x"], "left").select("_doc", "side", "x", left.alias("at")).filter(F.size("at") > 0))
    kind = expected.select(*named).schema
    return found.select(F.from_json("_doc", kind).alias("k"), "i", "j", "similarity").select("k.*", "i", "j", "similarity")
