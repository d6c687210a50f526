import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeframe.llm import bpe, queries

D = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dup", "decontaminate", "secret_scan", "bpe"]
    for name in list(stages)[:-1]:
        assert stages[name](spark, docs, "/root/testdata/sf0.01").columns == docs.columns
    masked = stages["secret_scan"](spark, docs, D)
    assert masked.filter(F.col("text").rlike("(?i)token = .?[0-9a-f]{16,}")).count() == 0
    assert masked.count() == docs.count() and masked.filter(F.length("text") != F.col("n_chars")).count() == docs.filter(F.length("text") != F.col("n_chars")).count()


def test_odd_rows(spark, odd, none):
    wide = odd.withColumns({"n_words": F.lit(1), "spans": F.lit("x"), "ids": F.lit(2), "__id": F.lit(3), "n": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, D).columns == wide.columns, name
        assert stage(spark, none, D).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, wide, D).collect()
    assert sorted((r.doc_id or 0, r.text is None) for r in kept) == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (8, False)]


def test_run(spark):
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, D).collect()}
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert 0.5 * docs.count() < len(rows) <= docs.count()
    v = bpe.Vocabulary.load(bpe.vocabulary_path())
    text = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, docs, D).collect()}
    for i, r in rows.items():
        assert r.ids == v.encode([text[i]])[0] and r.n_tokens == len(r.ids)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "pages", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.queries()[name](spark, D)
    columns = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[k] for k in at)) for r in rel.fetchall())


def test_each_stage_against_brute_force(spark, tmp_path):
    """Which documents each stage lets go, and what it makes of the others, stage after stage."""
    from test_table_ops import _brute_groups
    from test_text_ops import _brute_leaks

    from citeframe.llm import langid, secretscan

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        was, got = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}
        assert len(got) == after.count()
        if name == "language_id":
            judged = langid.predict(docs, queries.language_model(docs), ["doc_id"]).collect()
            want = {r.doc_id: was[r.doc_id] for r in judged if not r.rejected}
            assert {r.lang_pred for r in judged if not r.rejected} == {r.lang for r in was.values() if r.lang} and len(want) > 0.9 * len(was)
        elif name == "near_dup":
            groups = _brute_groups([(i, r.text) for i, r in was.items()], 80)
            want = {i: r for i, r in was.items() if groups[i][1] == i}
            assert 0.3 * len(was) < len(want) < len(was)
        elif name == "decontaminate":
            leaks = _brute_leaks([(i, r.text) for i, r in was.items()], bench)
            want = {i: r for i, r in was.items() if not leaks[i][1]}
            assert 0 < len(was) - len(want) < 0.2 * len(was)
        else:
            masked = {i: secretscan.redacted(r.text, secretscan.spans(r.text)) for i, r in was.items()}
            assert any(masked[i] != r.text for i, r in was.items())
            want = {i: type(r)(**{**r.asDict(), "text": masked[i], "n_chars": len(masked[i]) if masked[i] != r.text else r.n_chars}) for i, r in was.items()}
        assert {i: r.asDict() for i, r in got.items()} == {i: r.asDict() for i, r in want.items()}, name
        docs = after


def test_batches_for_python_are_small(spark):
    import pyarrow as pa

    from citeframe.llm import common

    def largest(session):
        rows = session.range(6000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint")
        return max(r.n for r in rows.collect())

    session = spark.newSession()
    session.conf.unset(common.BATCH)
    assert largest(session) == 6000
    corpus_pipeline.language(session, session.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint"), D)
    assert largest(session) == common.BATCH_ROWS == 500
    session.conf.set(common.BATCH, "700")  # the user's own
    common.small_batches(session)
    assert largest(session) == 700
