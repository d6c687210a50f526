"""How many near copies are found: planted pairs that share deep nodes with thousands of unlike documents."""

import random

import pytest

from citeframe.llm import neardup


def _planted(rnd, pairs, others, own=30, common=130, kept=11):
    """Rows (id, text) over one common passage, pairs first: two documents of a pair have a Jaccard of 0.85 to 0.88, any others 0.66 to 0.75."""
    base = [f"c{k}" for k in range(common)]
    new = lambda n: [f"u{rnd.randrange(10**12)}" for _ in range(n)]
    out = []
    for _ in range(pairs):
        mine = new(own)
        out += [base + mine, base + mine[:kept] + new(rnd.randrange(2, 5))]
    return [(k, " ".join(w)) for k, w in enumerate(out + [base + new(own) for _ in range(others)])]


def _jaccard(a, b):
    x, y = (set(zip(*[t.split()[j:] for j in range(5)], strict=False)) for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_in_deep_nodes(spark):
    rows = _planted(random.Random(8), 500, 1500)
    assert all(0.85 <= _jaccard(rows[k][1], rows[k + 1][1]) < 0.88 for k in range(0, 1000, 2))
    assert max(_jaccard(rows[k][1], rows[k + 1][1]) for k in range(1000, 2499)) < 0.8
    got = {r.doc_id: r.component_id for r in neardup.cluster(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), leaf=40).collect()}
    assert all(got[k] == k for k in [*range(0, 1000, 2), *range(1000, 2500)])
    assert sum(got[k + 1] != k for k in range(0, 1000, 2)) <= 1


@pytest.mark.parametrize("depth", [4, 8, 12])
@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_trees(threshold, depth):
    import numpy as np

    n, size = 3000, 200
    trees = neardup.trees_for(threshold, depth)
    rng = np.random.default_rng(4)
    common = round(size * threshold)
    x = rng.integers(0, 2**63, (n, size), dtype=np.uint64)
    half = (size + common) // 2
    pairs = np.stack([x[:, :half], np.concatenate([x[:, :common], x[:, half : half + half - common]], axis=1)], axis=1)
    sig = neardup._tokens(pairs.reshape(-1), np.arange(0, 2 * n * half + 1, half), trees * neardup.POOL)
    assert abs((sig[::2] == sig[1::2]).mean() - threshold) < 0.005
    met = np.zeros(n, bool)
    for tree in range(trees):
        key, of, row = np.full(2 * n, tree + 1, np.uint64), np.full(2 * n, tree), np.arange(2 * n)
        for _ in range(depth):
            key, of, row = neardup._descend(key, of, sig, row, threshold)
        first, second = set(zip(key[row % 2 == 0].tolist(), (row[row % 2 == 0] // 2).tolist())), set(zip(key[row % 2 == 1].tolist(), (row[row % 2 == 1] // 2).tolist()))
        met[[k for _, k in first & second]] = True
    assert (~met).mean() <= 2 * neardup.MISS
    ruled_out = (sig[::2] == sig[1::2]).sum(axis=1) < neardup.least_equal(threshold, trees * neardup.POOL)
    assert ruled_out.mean() <= 0.002  # RULED_OUT, within what 3000 pairs can tell


def test_filter_that_lets_all_through(spark, docs, monkeypatch):
    """Beyond the ids that a filter is sized for, all texts meet the exact joins: the result is the same."""
    from citeframe.llm import common

    want = sorted(tuple(r) for r in neardup.cluster(docs).collect())
    monkeypatch.setattr(common, "MOST_SLOTS", 1 << 6)
    assert sorted(tuple(r) for r in neardup.cluster(docs).collect()) == want


@pytest.mark.parametrize("span", [3, 1 << 20])
def test_components(spark, monkeypatch, span):
    """Chains, stars and cycles over many parts and over one."""
    monkeypatch.setattr(neardup, "SPAN_EDGES", span)
    rnd = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(k, 300 + (k - 299) % 20) for k in range(300, 320)] + [(500, 500)]
    edges += [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(150)]
    rnd.shuffle(edges)
    par = {}
    def root(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        par[y] = x
    got = neardup.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(8))
    assert {r.rid: r.comp for r in got.collect()} == {k: root(k) for a, b in edges if a != b for k in (a, b)}
    more = neardup.components(spark.createDataFrame([(7, 100)], "a bigint, b bigint"), got)
    assert {r.comp for r in more.filter("rid < 300 and rid >= 100").collect()} == {7}
