from citeframe import catalog


def test_highlights_miss_and_hit(spark):
    rows = catalog.queries()["quote_highlight_blocks"](spark, "/root/testdata/sf0.001").groupBy("hit").count().collect()
    assert {r.hit for r in rows} == {True, False}
