from citeframe.llm import topk


def test_queries_larger_than_candidates(spark):
    kind = "vec_id bigint, embedding array<double>"
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.0])], kind)
    asked = spark.createDataFrame([(10, [1000.0, 0.0]), (11, [0.0, 50.0]), (12, [1.0, 1.0]), (13, [1.0])], kind)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(rows, asked, 2, scale=1).collect())
    assert got == [(10, 1, 2, 2000), (10, 2, 1, 1000), (11, 1, 1, 100), (11, 2, 2, 50), (12, 1, 1, 3), (12, 2, 2, 3)]
    assert topk.search(rows, asked.filter("vec_id = 13"), 2, scale=1).count() == 0
