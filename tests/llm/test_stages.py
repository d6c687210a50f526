"""What the pipeline's stages find."""

import random

import corpus_pipeline
from test_table_ops import _brute_groups


def test_near_copies_from_80(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(400).collect()]
    rnd = random.Random(5)
    top = max(i for i, _ in rows) + 1
    for k in range(60):  # copies of a Jaccard of 0.80 to 0.85
        w = [f"v{rnd.randrange(10**9)}" for _ in range(204)]
        rows += [(top + 2 * k, " ".join(w)), (top + 2 * k + 1, " ".join(w[: 182 + k % 4]))]
        rows[-1] = (rows[-1][0], " ".join([*rows[-1][1].split(), *[f"y{rnd.randrange(10**9)}" for _ in range(22 - k % 4)]]))
    want = _brute_groups(rows, 80)
    assert sum(want[top + 2 * k + 1][1] == top + 2 * k for k in range(60)) == 60
    assert sum(g == i for i, (_, g) in _brute_groups(rows, 85).items()) > sum(g == i for i, (_, g) in want.items()) + 50
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, (_, g) in want.items() if g == i)


def test_repeated_and_null_ids(spark):
    rnd = random.Random(7)
    text = lambda: [f"v{rnd.randrange(10**9)}" for _ in range(200)]
    near = lambda w: " ".join([*w[:195], *text()[:5]])
    a, b, c, d = text(), text(), text(), text()
    one = " ".join
    rows = [
        (1, one(a)), (2, near(a)), (2, one(b)),  # the second text of id 2 stays, its copy of 1 goes
        (3, one(c)), (3, near(c)),  # near copies of one id
        (None, near(b)), (None, one(d)), (None, near(d)), (None, one(text())),
    ]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()]
    assert len(got) == 5 and set(got) < set(rows)
    assert rows[0] in got and rows[2] in got and rows[8] in got
    assert sum(r in got for r in rows[3:5]) == 1 and sum(r in got for r in rows[6:8]) == 1
