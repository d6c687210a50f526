"""Mixing sources to target weights, along a curriculum that changes in time.

Each source has a target in words: its share by weight of all that is to be taken, but no more than a multiple of its
own size; what a source can't give is shared out among the others.  Over the time of training, from 0 to 1, each
source's weight follows a schedule, a line through some points.  Its integral, scaled to the target, is the demand for
the source's words up to any time.  A source's documents stand in a seeded order; the words before a document, put
into the inverse of the demand, give its time, and all documents are sorted by these times by range.

Running sums of a source are made by bucket of the seeded order, and within a bucket by a window, so that no source
comes to one task.  Rows that are equal in source, key and text are counted first and dealt out in parcels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeframe.llm.common import settle

#: Buckets are made to hold about so many rows, and are no more than the second number for a source.
BUCKET_ROWS = 2048
MOST_BUCKETS = 1 << 16
#: Equal rows that stay together.
PARCEL = 1000
WEIGHTS = (3, 1, 2)
#: (time, weight) of each source in turn: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, *, supply: float = 1.5, most: float = 2) -> DataFrame:
    """(_s, size) of each source to _s, source_size, _place (from 0, by _s) and target.

    Sources have the weights in turn, by _s, and share `supply` times all sizes.  Targets stop at `most` times the
    source's size, the excess being shared anew by weight until none is above.  Sources are sorted by how soon they
    stop, so what is left when each stops follows from two running sums: one row a source, in one task.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_place", (F.row_number().over(Window.orderBy("_s")) - 1).cast("int")).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({
        "_all": F.sum("source_size").over(everything) * F.lit(float(supply)),
        "_before": F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_left": F.sum("_w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    rows = rows.withColumn("_full", F.col("_before") + F.col("_cap") / F.col("_w") * F.col("_left") <= F.col("_all"))
    rows = rows.withColumns({"_given": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everything), "_open": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everything)})
    share = F.col("_w") * ((F.col("_all") - F.col("_given")) / F.nullif(F.col("_open"), F.lit(0.0)))
    return rows.select("_s", "source_size", "_place", F.when(F.col("_full"), F.col("_cap")).otherwise(share).alias("target"))


def _pieces(points: Sequence[tuple[float, float]]) -> tuple[list[tuple[float, float, float, float]], float]:
    """A schedule's stretches as (time, weight, slope, area before), and its whole area."""
    if len(points) < 2 or points[0][0] != 0 or points[-1][0] != 1 or any(w < 0 for _, w in points) or any(t >= u for (t, _), (u, _) in zip(points, points[1:], strict=False)):
        raise ValueError("a schedule runs from time 0 to 1, forwards, and its weights aren't negative")
    out, area = [], 0.0
    for (t, v), (u, w) in zip(points, points[1:], strict=False):
        out.append((float(t), float(v), (w - v) / (u - t), area))
        area += (u - t) * (v + w) / 2
    if area <= 0:
        raise ValueError("a schedule has a positive weight somewhere")
    return out, area


def when_due(place: Column, part: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which `part` (0 to 1) of a source's demand is met; place: the source's, schedules being had in turn."""
    made = [_pieces(s) for s in schedules]
    lists = F.array(*[F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, ("t", "w", "g", "a"), strict=True)]) for p in pieces]) for pieces, _ in made])
    which = (place % len(made) + 1).cast("int")
    areas = F.element_at(F.array(*[F.lit(a) for _, a in made]), which)

    def solved(p: Column, u: Column) -> Column:
        """The integral over a stretch, w s + g s^2 / 2, solved for s."""
        r = F.greatest(u - p["a"], F.lit(0.0))
        root = p["w"] + F.sqrt(F.greatest(p["w"] * p["w"] + p["g"] * 2.0 * r, F.lit(0.0)))
        return F.when(root > 0, p["t"] + r * 2.0 / root).otherwise(p["t"])

    bound = F.transform(F.array(part * areas), lambda u: F.struct(u.alias("u"), F.element_at(F.filter(F.element_at(lists, which), lambda p: p["a"] <= u), -1).alias("p")))
    return F.least(F.element_at(F.transform(bound, lambda x: solved(x["p"], x["u"])), 1), F.lit(1.0))


def plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, *, supply: float = 1.5, most: float = 2, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    key: str = "doc_id", stratum: str = "source", text: str = "text", seed: int = 23,
) -> DataFrame:
    """key, source, size, source_size, target, taken and copies (array of when, words) of every row, sorted by the time of its first copy.

    size: number of words of the whole text, null having none.  Sources are ordered by code point, null last.  A
    source's words are taken in its seeded order, over and over, until its target (rounded) is met: whole documents,
    but the last copy that fits in part gives the words still lacking, so the sum is the target.  Documents without
    words, or that aren't reached, take nothing, have no copies, and come last.  Rows equal in source, key and text
    are interchangeable and counted like others.  An empty table gives no rows; if no row has a word, all targets are 0.
    """
    name = F.coalesce(F.concat(F.lit("0"), F.col(stratum).cast("string")), F.lit("1"))
    own = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(name.alias("_s"), F.col(key).alias("_key"), size.alias("size"), own.alias("_h"))
    buckets = max(1, min(MOST_BUCKETS, docs.count() // BUCKET_ROWS))
    equal = rows.groupBy("_s", "_key", "size", "_h").agg(F.count("*").alias("_n"))
    parcel = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / PARCEL)))
    units = equal.withColumn("_k", parcel).select(
        "_s", "_key", "size", F.when(F.col("_k") == 0, F.col("_h")).otherwise(F.md5(F.concat("_h", F.col("_k").cast("string")).cast("binary"))).alias("_h"), F.least(F.lit(PARCEL), F.col("_n") - F.col("_k") * PARCEL).alias("_n"))
    units = settle(units.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") * buckets / (1 << 32))))
    each = units.groupBy("_s", "_b").agg(F.sum(F.col("size") * F.col("_n")).alias("_words"))
    sources = targets(each.groupBy("_s").agg(F.sum("_words").alias("source_size")), weights, supply=supply, most=most)
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = each.withColumn("_start", before).select("_s", "_b", "_start").join(sources, "_s")
    within = Window.partitionBy("_s", "_b").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("_at", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(within), F.lit(0))).join(starts, ["_s", "_b"])
    placed = placed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1))).withColumn("_at", F.col("_start") + F.col("_at") + F.col("_i") * F.col("size"))
    quota = F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * F.lit(float(most))))
    placed = placed.withColumn("_quota", quota.cast("bigint"))

    def copy(times: int) -> Column:
        first = F.col("_at") + F.col("source_size") * times
        words = F.greatest(F.least(F.col("_quota") - first, F.col("size")), F.lit(0)).cast("bigint")
        middle = (first + words / 2.0) / F.nullif(F.col("_quota"), F.lit(0))
        return F.when(words > 0, F.struct(when_due(F.col("_place"), middle, schedules).alias("when"), words.alias("words")))

    copies = F.filter(F.array(*[copy(k) for k in range(-int(-most // 1))]), lambda c: c.isNotNull())
    placed = placed.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"])
    first = F.get("copies", F.lit(0))["when"]
    return placed.orderBy(first.asc_nulls_last(), "_s", "_h", "_i").select(
        F.col("_key").alias(key), F.when(F.col("_s").startswith("0"), F.substring("_s", 2, 1 << 30)).alias("source"), "size", "source_size", "target", taken.alias("taken"), "copies")


def sequence(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The training order: key, copy (from 1), words and when of every copy that plan() takes, sorted by when."""
    each = planned.select(key, "source", F.posexplode("copies").alias("_k", "_c"))
    return each.select(key, "source", (F.col("_k") + 1).alias("copy"), F.col("_c.words").alias("words"), F.col("_c.when").alias("when")).orderBy("when", "source", key, "copy")
