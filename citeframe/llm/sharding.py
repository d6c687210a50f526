"""Proportional stratified interleaving of documents into shards.

Rows are shuffled by a seeded hash and ranked within their source; a row's place is its rank, shifted by a seeded
offset of its source, as a fraction of the source's size.  Rows in the order of these fractions run through all
sources in proportion, so cutting the order into runs of equal length gives shards that match the mixture.

Neither a source nor the whole table is ranked in one task: rows are counted by (source, bucket of the hash) and
then by bucket of the fraction, ranks within a bucket come from a window over that bucket alone, and the running
sums of the counts - bounded tables - give the rest.  Rows that share a key with many others, as those without one do,
share their hash; they come last in their bucket, in parts of their own by checksum, equal rows being counted first
and dealt out in parcels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.llm.common import frequent, settle

#: Buckets are made to hold about so many rows, and are no more than the second number for a source or all rows.
BUCKET_ROWS = 2048
MOST_BUCKETS = 1 << 16
_SPAN = 1 << 40


def _units(rows: DataFrame, count: int, buckets: int) -> DataFrame:
    """_s, _h, _key, size, text_crc32, the bucket (_b, _sub) and _n, how many equal rows this stands for (at most BUCKET_ROWS)."""
    often = F.broadcast(frequent(rows.groupBy("_h").agg(F.count("*").alias("c")), ["_h"], count))
    placed = rows.withColumn("_b", F.floor(F.col("_h") * buckets / _SPAN))
    few = placed.join(often, "_h", "left_anti").withColumns({"_sub": F.lit(0), "_n": F.lit(1).cast("bigint")})
    many = placed.join(often, "_h").groupBy("_s", "_h", "_key", "size", "text_crc32", "_b").agg(F.count("*").alias("_n"))
    many = many.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / BUCKET_ROWS))))
    parts = F.lit(max(1, min(MOST_BUCKETS, count // BUCKET_ROWS)))
    many = many.select("_s", "_h", "_key", "size", "text_crc32", "_b", (F.pmod(F.xxhash64("text_crc32", "size", "_k"), parts) + 1).cast("int").alias("_sub"), F.least(F.lit(BUCKET_ROWS), F.col("_n") - F.col("_k") * BUCKET_ROWS).alias("_n"))
    return few.select(*many.columns).unionByName(many)


def assign(docs: DataFrame, shards: int = 40, *, stratum: str = "source", key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row; shards' counts of rows differ by one at most.

    size: UTF-8 bytes of the text and 16; a null text has none and the checksum 0.  Null strata are one stratum.
    Repeated and null keys are rows like any others: rows that are equal in key, size and checksum are
    interchangeable, so the result is the same whichever comes first.  An empty table gives no rows.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("n"))
    tie = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = settle(docs.select(
        F.col(key).alias("_key"), (F.octet_length(text_) + 16).cast("bigint").alias("size"), F.crc32(text_.cast("binary")).alias("text_crc32"), name.alias("_s"),
        F.pmod(F.xxhash64(tie, F.lit(seed)), F.lit(_SPAN)).alias("_h"),
    ))
    count = rows.count()
    buckets = max(1, min(MOST_BUCKETS, count // BUCKET_ROWS))
    units = _units(rows, count, buckets)
    each = units.groupBy("_s", "_b", "_sub").agg(F.sum("_n").alias("_c"))
    total = each.groupBy("_s").agg(F.sum("_c").alias("_all"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_s").orderBy("_b", "_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = each.withColumn("_start", before).join(total, "_s").select("_s", "_b", "_sub", "_start", "_all")
    within = Window.partitionBy("_s", "_b", "_sub").orderBy("_h", "_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.withColumn("_r", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(start, ["_s", "_b", "_sub"])
    ranked = ranked.withColumn("_r", F.explode(F.sequence(F.col("_r"), F.col("_r") + F.col("_n") - 1))).withColumnRenamed("_key", key)
    shift = F.pmod(F.xxhash64("_s", F.lit(seed + 1)), F.lit(_SPAN)) / F.lit(float(_SPAN))
    place = (F.col("_start") + F.col("_r") + shift) / F.col("_all")
    ranked = settle(ranked.select(key, "size", "text_crc32", "_s", place.alias("_f")).withColumn("_b", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1))))
    counts = ranked.groupBy("_b").agg(F.count("*").alias("_n"))
    # at most MOST_BUCKETS rows
    starts = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    order = Window.partitionBy("_b").orderBy("_f", "_s", F.col(f"`{key}`"), "text_crc32", "size")
    placed = ranked.withColumn("_r", F.row_number().over(order) - 1).join(F.broadcast(starts), "_b").withColumn("_p", F.col("_start") + F.col("_r"))
    # exact in integers: shard j takes the positions p with j * count <= p * shards < (j + 1) * count
    shard = F.expr(f"cast((_p * {shards}L) div {max(count, 1)}L as int)")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(cast(shard as bigint) * {max(count, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(key, "size", "text_crc32", "shard", (F.col("_p") - first).cast("bigint").alias("slot"))
