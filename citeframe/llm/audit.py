"""Audit of how filters interact: what each removes in every order in which they could be applied.

What a row's filters say is one mask, so all orders of a part follow from its few counts by mask (cells).  The
orders are visited by swaps of neighbours (Steinhaus, Johnson and Trotter): a swap changes what two steps see, so
only these two are counted anew from the cells, and each filter's Shapley sum grows by what it removes in the order
just reached.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.llm.common import frequent, hot_join, prepare, settle

FILTERS = "ABCDE"
#: Parts that are walked at once.
_PARTS = 64
_COUNTS = ("kept", "removed", "redundant", "unique_fails")
# What the filters look at.
_WHITE = " \t\n\x0b\x0c\r"
_SPACE, _UPPER, _ODD = r"[\x20\x09-\x0D]+", "[A-Z]", "[#$%&*|]"


def swaps(n: int) -> Iterator[int]:
    """The places j at which (j, j + 1) are swapped, one after the other, so that all n! orders are visited once."""
    order, step = list(range(n)), [-1] * n  # each item looks to the left at first
    while True:
        free = [x for i, x in enumerate(order) if 0 <= i + step[x] < n and order[i + step[x]] < x]
        if not free:
            return
        x = max(free)
        i = order.index(x)
        j = i + step[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            step[y] = -step[y]
        yield min(i, j)


def walk(cells: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of the filters, what each step of them removes, and the Shapley sums.

    cells: for each part, 2^k masks (bit f: fails filter f) and each measure, a count.  Removed: for each part, order,
    step and measure; sums: for each part and filter, of the first measure.
    """
    k = int(cells.shape[1]).bit_length() - 1
    masks = np.arange(1 << k)

    def takes(before: int, f: int) -> np.ndarray:
        return cells[:, (masks & before == 0) & (masks >> f & 1 == 1)].sum(axis=1)

    order = list(range(k))
    now = np.stack([takes(sum(1 << g for g in order[:j]), order[j]) for j in range(k)], axis=1)
    orders, removed = [tuple(order)], [now.copy()]
    sums = now[:, :, 0].copy()
    for j in swaps(k):
        both = now[:, j] + now[:, j + 1]  # the two together remove the same rows either way
        order[j], order[j + 1] = order[j + 1], order[j]
        now[:, j] = takes(sum(1 << g for g in order[:j]), order[j])
        now[:, j + 1] = both - now[:, j]
        orders.append(tuple(order))
        removed.append(now.copy())
        sums[:, order] += now[:, :, 0]
    return orders, np.stack(removed, axis=1), sums


def audit(rows: DataFrame, filters: Sequence[str], marks: Sequence[str] = (), *, part: str = "part") -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley.

    rows: the part (null: empty string), `filters` (booleans, true: the row fails; null: it doesn't; names of one
    letter), `marks` (numbers of rows to be counted among those removed) and, if there is one, a column `n` of how
    many rows each stands for.  Steps count from 1.  Redundant: fails the step's filter but is gone already.
    shapley: what the filter removes, summed over all orders.  A table without rows has no parts.
    """
    prepare(rows.sparkSession)
    names = list(filters)
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    mask = sum((F.when(F.col(f), 1 << j).otherwise(0) for j, f in enumerate(names)), F.lit(0))
    each = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), n.cast("bigint").alias("n"), *[F.coalesce(F.col(m).cast("bigint"), F.lit(0)).alias(m) for m in marks])
    counted = each.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *marks)])
    # at most 2^k cells for a part
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", F.array("n", *marks).alias("counts"))).alias("cells"))
    made = [*_COUNTS, *[f"{m}_lost" for m in marks], "shapley"]
    size, width = 1 << len(names), 1 + len(marks)

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("cells")
        at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        table = np.zeros((batch.num_rows, size, width), np.int64)
        table[at, flat.field("mask").to_numpy()] = flat.field("counts").flatten().to_numpy().reshape(-1, width)
        orders, removed, shapley = walk(table)
        by = np.array(orders)
        everything = table[:, :, 0].sum(axis=1)
        fails = np.stack([table[:, np.arange(size) >> f & 1 == 1, 0].sum(axis=1) for f in range(len(names))], axis=1)
        alone = np.stack([table[:, 1 << f, 0] for f in range(len(names))], axis=1)
        columns = [everything[:, None, None] - np.cumsum(removed[..., 0], axis=2), removed[..., 0], fails[:, by] - removed[..., 0], alone[:, by], *[removed[..., m] for m in range(1, width)], shapley[:, by]]
        rounds = len(orders) * len(names)
        words = pa.array(["".join(names[f] for f in o) for o in orders])
        return pa.RecordBatch.from_arrays(
            [
                batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), rounds))),
                words.take(pa.array(np.tile(np.repeat(np.arange(len(orders)), len(names)), batch.num_rows))),
                pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), batch.num_rows * len(orders))),
                *[pa.array(c.reshape(-1)) for c in columns],
            ],
            names=["part", "filter_order", "step", *made],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PARTS):
                yield told(batch.slice(at, _PARTS))

    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in made))


def text_filters(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Which of the five filters documents fail: rows of part, A to E, n (rows that these stand for), good and toxic.

    A: under 200 words; B: under half of the words are distinct; C: over 2 % of the code points are A-Z; D: holds one
    of #$%&*|; E: a smaller key of the table has the same text (by SHA-256).  A null text is empty.  A row without a
    key comes after all others, but fails E only by... no row: keys that aren't there are neither smaller nor larger.
    labels (key, quality, toxic): of repeated labels one that says 1 is enough; those without a key are passed over.
    """
    whole = docs.select(F.col(key).alias("id"), F.col(part).cast("string").alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # apart from the rest, so that the words of a text are found once
    cut = whole.withColumn("words", F.split(F.btrim("t", F.lit(_WHITE)), _SPACE))
    bare = F.btrim("t", F.lit(_WHITE)) == ""
    words = F.when(bare, 0).otherwise(F.size("words"))
    distinct = F.when(bare, 0).otherwise(F.size(F.array_distinct("words")))
    own = {
        "A": words < 200, "B": distinct * 100 < words * 50,
        "C": F.regexp_count("t", F.lit(_UPPER)).cast("bigint") * 100 > F.length("t").cast("bigint") * 2, "D": F.col("t").rlike(_ODD),
    }
    rows = settle(cut.select("id", "part", *[c.alias(f) for f, c in own.items()], F.unhex(F.sha2("t", 256)).alias("same")))
    counts = rows.groupBy("same").agg(F.count("*").alias("c"), F.min("id").alias("first")).filter("c > 1")
    again = settle(counts)
    often = frequent(again.select("same", "c"), ["same"], rows.count())
    rows = hot_join(rows, again.select("same", "first"), ["same"], often)
    rows = rows.withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    # repeated ids meet here, before they meet their labels
    rows = settle(rows.groupBy("id", "part", *FILTERS).agg(F.count("*").alias("n")))
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0))
    marked = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(said("quality").alias("good"), said("toxic").alias("toxic")).filter("good + toxic > 0")
    lost = rows.join(marked, "id").select("part", *FILTERS, F.lit(0).cast("bigint").alias("n"), (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    none = F.lit(0).cast("bigint")
    return rows.select("part", *FILTERS, "n", none.alias("good"), none.alias("toxic")).unionByName(lost)
