import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeframe.llm import chat, hosts, neardup, queries, sharding, topk
from citeframe.llm.common import id_filter, split_by

D = "/root/testdata/sf0.01"


def _brute_groups(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    par = list(range(len(rows)))
    def root(x):
        while par[x] != x:
            x = par[x]
        return x
    inv = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in inv[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                par[root(i)] = root(j)
        for g in s:
            inv[g].append(i)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    return {d: (len(sets[i]), min(low[root(i)])) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("options", [{}, {"leaf": 20, "most": 3000}])
def test_near_duplicates(docs, options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in neardup.cluster(docs, **options).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == _brute_groups(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_dense_group(spark):
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):  # near copies that differ from the base, some chains, some far ones
        w = list(base)
        for _ in range(rnd.choice([1, 2, 5, 12, 30])):
            w[rnd.randrange(400)] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.cluster(spark.createDataFrame(rows, "doc_id bigint, text string"), leaf=10, most=4000).collect()}
    assert got == _brute_groups(rows)


def test_near_duplicates_odd(odd, none):
    rows = neardup.cluster(odd).collect()
    assert len(rows) == 10
    of = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert of[1] == of[1][:1] + (1, True) and of[1][0] == 0 and of[3] == (0, 3, True) and of[4] == (1, 4, True)
    assert of[6][1:] == (6, True) and of[7][1:] == (6, False) and of[None][1:] == (6, False)
    assert neardup.cluster(none).count() == 0


def test_sharding(spark, docs, odd, none):
    got = queries.op2_sharding(spark, D).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert len(got) == docs.count() and set(got["shard"]) == set(range(40))
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (by.sub(by.sum(axis=1) / 40, axis=0)).abs().max().max() < 3
    import zlib

    assert all(s == len(t.encode()) + 16 and c == zlib.crc32(t.encode()) for s, c, t in zip(got["size"], got["text_crc32"], got["text"], strict=True))
    again = queries.op2_sharding(spark, D).toPandas().set_index("doc_id").sort_index()
    assert (again["shard"] == got.set_index("doc_id").sort_index()["shard"]).all()
    rows = sharding.assign(odd, 3).collect()
    assert sorted(collections.Counter(r.shard for r in rows).values()) == [3, 3, 4] and sum(r["size"] == 16 for r in rows) == 2
    assert sharding.assign(none, 3).count() == 0


def test_topk(spark):
    rnd = np.random.default_rng(3)
    x = np.round(rnd.normal(size=(300, 8)), 1)
    x[50:120] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [1.0] * 8), (1200, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for k in (1, 5, 400):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, df.filter("vec_id % 50 = 0"), k).collect())
        v = np.floor(256 * x.astype(np.float32).astype(float)).astype(int)
        want = []
        for q in range(0, 300, 50):
            s = v @ v[q]
            best = sorted((-s[j], j) for j in range(300) if j != q)[:k]
            want += [(q, n, j, -m) for n, (m, j) in enumerate(best, 1)]
        assert got == sorted(want)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [-3e7, 5.0])], "vec_id bigint, embedding array<double>")
    assert {(r.query_id, r.vec_id): r.score for r in topk.search(big, big, 1, scale=1).collect()} == {(0, 1): 9 * 10**14 + 2, (1, 0): 9 * 10**14 + 2, (2, 1): 10 - 9 * 10**14}


def test_topk_at_64_bits(spark):
    rnd = random.Random(9)
    x = [[rnd.choice([-1, 1]) * rnd.randrange(2 ** rnd.choice([3, 20, 31, 40, 62])) for _ in range(5)] for _ in range(60)]
    a = np.array(x, np.int64)
    want = [[max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(r, t, strict=True)))) for t in x] for r in x]
    assert topk.products(a, a).tolist() == want and sum(abs(v) < 2**63 - 1 for r in want for v in r) > 200
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    exact = [[int(float(v)) for v in r] for r in x]
    want = [[max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(r, t, strict=True)))) for t in exact] for r in exact]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(rows, rows, 7, scale=1).collect())
    assert got == sorted((i, n, j, -m) for i in range(60) for n, (m, j) in enumerate(sorted((-want[i][j], j) for j in range(60) if j != i)[:7], 1))
    long = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(20_000)]) for i in range(5)], "vec_id bigint, embedding array<double>")
    assert topk.search(long, long, 2).count() == 10


def test_urls(spark):
    urls = ["http://A.Example.com/en/7x?y#z", "https://x.net/de/1", "ftp://example.net/de/8#a", "nothing", None, "://", "http://com/en/", "http://notexample.org/es", "http://q.org/es/?a", "http://host?q=/en/"]
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in hosts.judge(pages, queries.URL_RULES).collect()}
    assert [got[k].host for k in range(10)] == ["a.example.com", "x.net", "example.net", "", "", "", "com", "notexample.org", "q.org", "host"]
    assert [got[k].path for k in range(10)] == ["/en/7x", "/de/1", "/de/8", "", "", "", "/en/", "/es", "/es/", ""]
    assert [got[k].rule for k in range(10)] == ["example.com/en/7", "net/de/", "example.net/de/8", None, None, None, "com/en/", None, "org/es/", None]
    assert got[0].verdict == "allow" and got[1].verdict == "block" and set(r.verdict for r in got.values()) == {"allow", "block"}
    labels = spark.createDataFrame([("bad.example.com", 1)] * 60 + [("good.example.com", 0)] * 60 + [("one.example.com", 1)], "host string, bad int")
    r = {x.host: x for x in hosts.reputation(labels).collect()}
    assert r["bad.example.com"].low > 0.9 and r["good.example.com"].rate < 0.1
    assert r["good.example.com"].rate < r["one.example.com"].rate < r["bad.example.com"].rate  # shrunk
    assert hosts.judge(pages.limit(0), queries.URL_RULES).count() == 0
    assert hosts.judge(spark.read.parquet(f"{D}/pages.parquet"), queries.URL_RULES).count() == 250


def test_reply_trees(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "a #<\\b"), ("t", 3, 1, 5.0, "assistant", None), ("t", 4, 2, 9.0, "user", "more"), ("t", 5, 99, None, "us:er", "orphan"), ("u", 1, None, None, None, "solo")]
    m = spark.createDataFrame(rows, "key string, node bigint, parent bigint, score double, role string, text string")
    made = chat.read_back(chat.format_paths(m)).orderBy("key", "rank").collect()
    got = [(r.key, r.leaf, r["rank"], [(t.role, t.text) for t in r.turns], r.learned) for r in made]
    assert got == [
        ("t", 4, 1, [("user", "q"), ("assistant", "a #<\\b"), ("user", "more")], "a #<\\b"),
        ("t", 3, 2, [("user", "q"), ("assistant", "")], ""),
        ("t", 5, 3, [("us:er", "orphan")], ""),
        ("u", 1, 1, [("", "solo")], ""),
    ]
    assert chat.format_paths(m, branches=1).count() == 2
    chain = spark.range(1, 101).select(F.lit("c").alias("key"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    assert [t.text for t in chat.read_back(chat.format_paths(chain)).first().turns] == [str(k) for k in range(1, 101)]
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([("k", 1, 2), ("k", 2, 1), ("k", 3, 1)], "key string, node bigint, parent bigint"))
    assert chat.format_paths(m.limit(0)).count() == 0


def test_chat_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "user", "x"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.key: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_paths(chat.from_turns(c), unique=True)).collect()}
    assert got == {"1": [("user", "a"), ("user", "b"), ("assistant", "")], "null": [("user", "x")], "2": [("user", "same")] * 2}


def test_id_filter(spark):
    ids = spark.createDataFrame([(None,), *[(i * 7919,) for i in range(-50, 3000)]], "id bigint")
    rows = ids.unionByName(spark.range(10**9, 10**9 + 3000)).withColumn("__row", F.lit(1))
    got = split_by(rows, F.col("id"), id_filter(ids, "id"))
    assert got.columns == ["id", "__row", "__maybe"] and got.count() == rows.count()
    assert got.filter("id is null or id < 1000000000").filter("not __maybe").count() == 0
    assert got.filter("id >= 1000000000").filter("__maybe").count() < 400  # few others
    assert split_by(rows, F.col("id"), id_filter(ids.limit(0), "id")).filter("__maybe").count() == 0


def test_sharding_of_rows_that_share_a_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    # half without an id, of these half with one text; an eighth with one id
    k = F.col("id")
    rows = spark.range(8000).select(F.when(k % 2 == 1, F.when(k % 8 == 1, 5).otherwise(k)).alias("doc_id"), F.when(k % 4 == 0, "the same").otherwise(F.concat(F.lit("t"), k.cast("string"))).alias("text"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"))
    units = sharding._units(rows.select(F.col("doc_id").alias("_key"), F.octet_length("text").cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col("source").alias("_s"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 40) - 1)).alias("_h")), 8000, 80)
    sizes = [r.n for r in units.groupBy("_s", "_b", "_sub").agg(F.sum("_n").alias("n")).collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 400
    got = sharding.assign(rows, 7).collect()
    assert sorted(collections.Counter(r.shard for r in got).values()) == [1142, 1143, 1143, 1143, 1143, 1143, 1143]
    for shard in range(7):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    want = collections.Counter((r.doc_id, len(r.text) + 16) for r in rows.collect())
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == want
    assert sorted(map(tuple, sharding.assign(rows.repartition(5), 7).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_url_filter_with_one_host(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, None).otherwise(F.concat(F.lit("http://h"), (F.col("id") % 50).cast("string"), F.lit(".example.com/en/"), F.col("id").cast("string"))).alias("url"))
    got = hosts.judge(pages, queries.URL_RULES)
    assert got.count() == 4000 and got.filter("host = ''").count() == 2000 and got.filter("rate is null").count() == 0
    assert "left_anti" in got._jdf.queryExecution().analyzed().toString().lower() or "LeftAnti" in got._jdf.queryExecution().analyzed().toString()


def test_url_filter_equals_sql_where_hosts_hold_line_breaks(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    urls = ["http://b@c\rd@example.com/de/😀?a#b", "http://COM/e%6e/?a", "http://.?x=/en/", "https://./\n#?", "mailto:a.\\en/7?a", "http://good27.example.com:80/de/81#b", "//../EN/?a#b", "😀://./es/#b", "https://example.com\n/en/7?x#?", "HTTP://example.com\\/e%6e//x://y",
        "http://example.com\n/es/", "HTTP://../de/😀?a", "HTTP://a.co.uk/#b", "HTTP://example.com\\/de/81?a", "http://good27.example.com:80\\en/7?a#b", "HTTP://b@c\rd@example.com/e%6e/?a", "HTTP://good27.example.com:80/\n?a", "HTTP://com;x#/en/#?", None, "HTTP://b@c\rd@example.com/en/\n#b"]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op6_url_filter"]).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in queries.op6_url_filter(spark, str(tmp_path)).collect())
    parts = hosts.domain_suffix(F.col("host"))
    named = lambda host: tuple(spark.createDataFrame([(host,)], "host string").select(*parts).first())
    assert named("a.net:80\n") == ("a.net:80\n", "") and named("c\rd@example.com") == ("example.com", "com") and named("1.2\n") == ("1.2\n", "2\n")
