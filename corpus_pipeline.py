"""The corpus pipeline: documents in, tokens out, one operator after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next one's docs.  All but the last return the columns of docs, whatever these are.

The stages lower the number of rows in a batch for Python, for as long as the session lasts, if it is Spark's default.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeframe.llm import bpe, decontam, langid, neardup, secretscan
from citeframe.llm.common import discard, id_filter, read, settle, shared_folder, small_batches, split_by
from citeframe.llm.queries import coded, language_model

#: Documents whose sets of word shingles have a Jaccard of so many percent or more are near copies.
NEAR = 80
#: No SQL expresses the trained and hashed stages.
ORACLE_SQL = None


def _row(docs: DataFrame) -> DataFrame:
    """The whole row as one column beside the text, so that no name of docs clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, as do null and letterless texts."""
    small_batches(spark)
    return langid.predict(_row(docs), language_model(docs), ["__row"]).filter(~F.col("rejected")).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies stays, and once only.

    Rows are told apart by id and text, so that repeated or null ids are compared like all others; null is the last id.
    """
    small_batches(spark)
    key = F.xxhash64("doc_id", "text")
    found = neardup.cluster(docs.select(key.alias("doc_id"), "text"), percent=NEAR)
    each = found.groupBy(F.col("doc_id").alias("__key")).agg(F.count("*").alias("__rows"), F.first("component_id").alias("__group"))
    each = settle(each.join(docs.select(key.alias("__key"), F.col("doc_id").alias("__id")).dropDuplicates(["__key"]), "__key"))
    first = each.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "__key"))["__key"].alias("__key"))
    each = settle(each.join(first.withColumn("__stays", F.lit(True)), "__key", "left").select("__key", "__rows", F.coalesce("__stays", F.lit(False)).alias("__stays")))
    # what doesn't simply stay is marked, so that the other texts, most of them, need no shuffle
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), key.alias("__key"))
    rows = split_by(keyed, F.col("__key"), id_filter(each.filter("__rows > 1 or not __stays"), "__key"))
    some = rows.filter("__maybe").join(each.filter("__stays"), "__key")
    out = rows.filter("not __maybe").select("__row").unionByName(some.filter("__rows = 1").select("__row"))
    if each.filter("__stays and __rows > 1").limit(1).count():  # repeated rows
        out = out.unionByName(some.filter("__rows > 1").dropDuplicates(["__key"]).select("__row"))
    return out.select("__row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    return decontam.find(_row(docs), read(spark, sf_dir, "benchmark"), ["__row"]).filter(F.col("n_hit") == 0).select("__row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows where there is such a column."""
    small_batches(spark)
    rows = secretscan.scan(_row(docs), ["__row"], redact="__masked")
    new = {"text": F.col("__masked"), "n_chars": F.when(F.size("spans") > 0, F.length("__masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if c in new else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with the digests of ids and decoded text."""
    small_batches(spark)
    return coded(bpe.round_trip(docs, bpe.vocabulary_path(), ["doc_id"])).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language), ("near_dup", near_duplicates), ("decontaminate", decontaminate), ("secret_scan", secrets), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Between two, the rows are a table in the shared folder, which goes when the next one is written; the last stays, as the result reads it."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents", spread=True), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
