import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeframe.llm import audit, curriculum, queries, whitening

D = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fails(rows):
    """Masks of the five filters by brute force; rows: (doc_id, text)."""
    first = {}
    for d, t in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        out.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and t in first and d > first[t]))
    return out


def _audited(rows, labels):
    """rows: (doc_id, text, part), labels: id to (quality, toxic)."""
    parts = collections.defaultdict(list)
    for (d, _, p), f in zip(rows, _fails([r[:2] for r in rows]), strict=True):
        parts[p or ""].append((f, *labels.get(d, (0, 0))))
    out = {}
    for p, items in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = items
            for step, f in enumerate(order):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                fails = sum(x[0][f] for x in items)
                alone = sum(x[0][f] and sum(x[0]) == 1 for x in items)
                shapley[f] += len(gone)
                out[p, "".join("ABCDE"[x] for x in order), step + 1] = [len(left), len(gone), fails - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (q, o, s), v in out.items():
            if q == p:
                v.append(shapley["ABCDE".index(o[s - 1])])
    return out


def _told(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for j in audit.swaps(n):
        order[j], order[j + 1] = order[j + 1], order[j]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_walk_of_random_cells():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 50, (3, 16, 2))
    orders, removed, sums = audit.walk(cells)
    for p in range(3):
        want = np.zeros(4, int)
        for o, got in zip(orders, removed[p], strict=True):
            gone = 0
            for s, f in enumerate(o):
                here = [m for m in range(16) if m >> f & 1 and not m & gone]
                assert (got[s] == cells[p, here].sum(axis=0)).all()
                want[f] += cells[p, here, 0].sum()
                gone |= 1 << f
        assert (sums[p] == want).all()


def test_audit_of_documents(spark, docs):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = _audited(rows, {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in labels.collect()})
    assert _told(queries.op11_filter_audit(spark, D)) == want
    assert len(want) == 600 * len({r[2] for r in rows})


def test_audit_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (1, 1, None)], "doc_id bigint, quality int, toxic int")
    got = _told(audit.audit(audit.text_filters(odd, labels), "ABCDE", ["good", "toxic"]))
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert got == _audited(rows, {6: (1, 1), 7: (0, 1), 1: (1, 0)})
    assert audit.audit(audit.text_filters(none, labels), "ABCDE", ["good", "toxic"]).count() == 0


def test_audit_of_many_copies(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same").otherwise(F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit(1).alias("n"), F.lit("x").alias("part"))
    got = _told(audit.audit(audit.text_filters(rows, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")), "ABCDE", ["good", "toxic"]))
    assert got["s", "EABCD", 1][:2] == [2001, 999]  # of 1,000 copies with an id one stays, and those without one do
    assert got["s", "EABCD", 2][:2] == [0, 2001]


# ---- mixing --------------------------------------------------------------------------------------------------

def _filled(sizes, weights, supply=1.5, most=2):
    """Targets by sharing out the excess round after round."""
    left, open_ = supply * sum(sizes), dict(enumerate(sizes))
    out = {}
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        share = {i: left * weights[i % len(weights)] / total for i in open_}
        over = [i for i in open_ if share[i] >= most * sizes[i]]
        if not over:
            return out | share
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
            del open_[i]
    return out


@pytest.mark.parametrize("sizes", [[5, 5, 5], [100, 1, 1, 1], [0, 0, 7], [0], [3, 900, 20, 1, 1, 4000, 30], [10] * 25])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"{k:03d}", n) for k, n in enumerate(sizes)], "_s string, source_size bigint")
    got = {r["_place"]: r.target for r in curriculum.targets(rows).collect()}
    assert got == pytest.approx(_filled(sizes, curriculum.WEIGHTS))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_times_invert_the_demand(spark):
    schedules = [*curriculum.SCHEDULES, [(0, 0), (0.25, 2), (0.5, 0), (0.75, 0), (1, 1)]]
    rows = spark.range(len(schedules) * 101).select((F.col("id") % len(schedules)).alias("p"), (F.floor(F.col("id") / len(schedules)) / 100.0).alias("u"))
    for r in rows.select("p", "u", curriculum.when_due(F.col("p"), F.col("u"), schedules).alias("t")).collect():
        fine = np.linspace(0, 1, 200_001)
        w = np.interp(fine, *zip(*schedules[r.p], strict=True))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.interp(r.t, fine, area / area[-1]) == pytest.approx(r.u, abs=1e-4)


@pytest.mark.parametrize("bad", [[(0, 1)], [(0, 1), (0.5, 1)], [(0, 0), (1, 0)], [(0, 1), (0, 2), (1, 1)], [(0, -1), (1, 3)]])
def test_schedules_that_make_no_sense(bad):
    with pytest.raises(ValueError):
        curriculum._pieces(bad)


def test_mixture_of_documents(spark, docs, monkeypatch):
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 40)  # several buckets
    got = queries.op12_mixing(spark, D).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in got} == sizes
    want = _filled([sum(r["size"] for r in by[s]) for s in sorted(by)], curriculum.WEIGHTS)
    for k, s in enumerate(sorted(by)):
        assert all(r.target == pytest.approx(want[k]) and r.source_size == sum(x["size"] for x in by[s]) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - want[k]) <= 0.5
        assert all(0 <= r.taken <= 2 * r["size"] for r in by[s])
        assert sum(r.taken % r["size"] != 0 for r in by[s] if r["size"]) <= 1  # one document is cut
    when = [r.position for r in got if r.position is not None]
    assert when == sorted(when) and all(0 <= w <= 1 for w in when) and all(r.position is None for r in got[len(when):])
    again = sorted(queries.op12_mixing(spark, D).collect(), key=lambda r: r.doc_id)
    assert again == sorted(got, key=lambda r: r.doc_id)


def test_curriculum_follows_its_schedules(spark):
    """Of a source that tapers from 1.5 to 0.5, 5/8 of the words come in the first half; of its opposite 3/8."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("ten words are in this text of ten words here").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    order = curriculum.sequence(curriculum.plan(rows, weights=(1, 1, 1), supply=1.0, schedules=[((0, 1.5), (1, 0.5)), ((0, 1), (1, 1)), ((0, 0.5), (1, 1.5))])).collect()
    early = collections.Counter(r.source for r in order if r.when < 0.5)
    assert [round(early[f"s{k}"] / 2000, 2) for k in range(3)] == [0.62, 0.5, 0.38]
    assert [r.when for r in order] == sorted(r.when for r in order)


def test_sequence_tells_every_copy(spark, docs):
    planned = curriculum.plan(docs)
    assert curriculum.sequence(planned).agg(F.sum("words")).first()[0] == planned.agg(F.sum("taken")).first()[0]


def test_mixture_of_odd_rows(spark, odd, none, monkeypatch):
    got = curriculum.plan(odd).collect()
    assert len(got) == odd.count()
    words = collections.Counter()
    for r in odd.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert {r.source: r.source_size for r in got} == dict(words)
    assert {round(r.target, 6) for r in got if r.source is None} == {round(_filled([words["a"], words["b"], words[None]], curriculum.WEIGHTS)[2], 6)}
    assert curriculum.plan(none).count() == 0
    empty = odd.select("doc_id", F.lit(" ").alias("text"), "source", F.lit(1).alias("size"), F.lit(2).alias("target"))
    assert {(r["size"], r.target, r.taken, len(r.copies)) for r in curriculum.plan(empty).collect()} == {(0, 0.0, 0, 0)}


def test_mixture_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "PARCEL", 7)
    monkeypatch.setattr(curriculum, "BUCKET_ROWS", 20)
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("w "), F.col("id").cast("string"))).otherwise("five words in this one").alias("text"), F.lit("s").alias("source"))
    got = curriculum.plan(rows).collect()
    assert len(got) == 400 and sum(r.taken for r in got) == 1.5 * (200 * 2 + 200 * 5)
    assert all(r.taken <= 2 * r["size"] for r in got)


# ---- whitening -----------------------------------------------------------------------------------------------

def _whitened(vectors, k=16):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    trace = (c * c).sum() / n
    good = e > 1e-11 * e[0]
    return n, (((n * x - s) ** 2).sum(axis=1)).tolist(), ((n * x - s) / n) @ u[:, good] / np.sqrt(e[good]), e[good] / trace


def _check(got, vectors, k=16):
    n, deviation, z, share = _whitened(list(vectors.values()), k)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == z.size
    for j in range(z.shape[1]):
        mine = np.array([table[v, j + 1].whitened for v in vectors])
        assert min(np.abs(mine - z[:, j]).max(), np.abs(mine + z[:, j]).max()) < 1e-7
    for v, d in zip(vectors, deviation, strict=True):
        r = table[v, 1]
        assert (r.n, r.deviation, r.explained) == (n, d, pytest.approx(share[0], rel=1e-9)) and r.identity_error < 1e-9


def test_whitening_of_embeddings(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
    _check(queries.op13_whitening(spark, D).collect(), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = {k: rng.normal(size=3).tolist() for k in range(40)}
    vectors[40] = vectors[0]  # once in the fit
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, float("nan"), 2.0]), (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1.0, 2.0])]
    rows = spark.createDataFrame([*vectors.items(), *bad], "vec_id bigint, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("a"), "label": F.lit(1)})
    got = whitening.whiten(rows)
    _check(got.collect(), vectors)
    assert whitening.whiten(rows.filter("vec_id = 50")).count() == 0
    assert whitening.whiten(rows.filter("vec_id in (0, 40)")).count() == 0  # one distinct vector has no variance
    with pytest.raises(ValueError):
        whitening.whiten(rows, columns=("vec_id", "n"))
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id bigint, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}  # noise isn't a component


def test_subspace_iteration_without_widening_to_all():
    """Far fewer columns than dimensions suffice where eigenvalues fall."""
    rng = np.random.default_rng(5)
    u = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    e = 0.7 ** np.arange(300)
    widths = []

    def product(q):
        widths.append(q.shape[1])
        return (u * e) @ (u.T @ q)

    vectors, values, residual, _ = whitening.subspace(product, 300, 6)
    assert max(widths) < 100 and residual < 1e-11
    assert values == pytest.approx(e[:6]) and np.abs(np.abs((vectors * u[:, :6]).sum(axis=0)) - 1).max() < 1e-9


def test_subspace_iteration_on_a_flat_spectrum():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(400, 64))
    v = a.T @ a / 400
    vectors, values, residual, passes = whitening.subspace(lambda q: v @ q, 64, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert values == pytest.approx(want, rel=1e-12) and passes <= 6 and np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-11


def test_exact_sums_beyond_64_bits():
    x = np.array([[2**52, -(2**52)], [3, 5]])
    n, sums = 10**6, [2**62, -(2**62)]
    apart = whitening.centred(x, n, sums)
    assert apart.tolist() == [[10**6 * 2**52 - 2**62, -(10**6) * 2**52 + 2**62], [3 * 10**6 - 2**62, 5 * 10**6 + 2**62]]
    assert whitening.deviations(apart) == [None, None]
    assert whitening.deviations(np.array([[3, 4]])) == [25]
