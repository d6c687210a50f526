"""Exact top-k search by distributed histogram selection.

Vectors are turned into integers and packed into blocks.  Every block of queries meets every block of
candidates through an equi-join on the query block's number, and a task scores a whole pair of blocks with one
matrix product.  Pass by pass, each pair of blocks counts its scores into BINS equal bins of the range that may
still hold a query's k-th value (scores under the block's own k-th can't); the counts are summed over all blocks, and the bin with the k-th value becomes
the next range, until it is a single score.  A last pass keeps the scores above that value and, of those equal to
it, each block's k smallest ids; the ranks then come from at most k rows of each block and query.

Integers are packed as narrow as a block's components allow.  Scores that may pass 53 bits are built from products of 21-bit
digits, so they are exact up to 64 bits, where they stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.llm.common import settle
from citeframe.shipping import ship

BINS = 4096
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
#: So many blocks of candidates meet one copy of a block of queries.
PER_SALT = 4
_TOP = 2**63 - 1


def quantise(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components times `scale`, rounded down, as integers; they stay at 64 bits.

    Rows whose id or vector is null, or that hold a null or non-finite component, are left out.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks within each partition, by dimension: (dim, ids, width, data), width the bytes of a component."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dim), strict=True)
            x = np.concatenate(data)
            lo, hi = int(x.min(initial=0)), int(x.max(initial=0))
            width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= lo and hi < 1 << 8 * w - 1)
            columns = [pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dim", "ids", "width", "data"])

        for batch in batches:
            v = batch.column("v")
            flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
            for k, i in enumerate(batch.column("vec_id").to_pylist()):
                x = flat[ends[k] : ends[k + 1]]
                held.setdefault(len(x), []).append((i, x))
                if len(held[len(x)]) == size:
                    yield out(len(x))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, ids binary, width int, data binary")


def _ids(b) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def _matrix(data, width: int, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(rows, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; exact, but that they stay at the limits of 64 bits."""
    dim = a.shape[1]
    most = max(map(abs, (int(a.min(initial=0)), int(a.max(initial=0))))) * max(map(abs, (int(b.min(initial=0)), int(b.max(initial=0))))) * max(dim, 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    sums = [np.zeros((len(a), len(b)), np.int64) for _ in range(5)]  # of digits of weight 2 ** (21 * k)
    for at in range(0, dim, 1024):  # so that a product of digits, of 22 bits each, stays below 2 ** 53
        x, y = (_digits(m[:, at : at + 1024].astype(np.int64)) for m in (a, b))
        for i in range(3):
            for j in range(3):
                sums[i + j] += (x[i] @ y[j].T).astype(np.int64)
    for k in range(4):
        carry = sums[k] >> 21
        sums[k] -= carry << 21
        sums[k + 1] += carry
    low = (sums[2] << 42) + (sums[1] << 21) + sums[0]
    out = np.where(sums[4] < 0, -_TOP - 1, _TOP)
    fits = (sums[4] == 0) & (sums[3] == 0)
    out[fits] = low[fits]
    fits = (sums[4] == -1) & (sums[3] == 2**21 - 1)
    out[fits] = low[fits] + (-_TOP - 1)
    return out


def _digits(x: np.ndarray) -> list[np.ndarray]:
    return [(x & (2**21 - 1)).astype(np.float64), ((x >> 21) & (2**21 - 1)).astype(np.float64), (x >> 42).astype(np.float64)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    `queries` are rows of the same shape (vec_id, embedding).  Candidates are all rows with another id than the
    query's and as many dimensions; a repeated candidate row counts once for each time, a repeated query once (its
    smallest vector, if they differ).  Scores beyond 64 bits count as the limit there.
    """
    ship(vectors.sparkSession)
    base = settle(_pack(quantise(vectors, scale), CANDIDATE_BLOCK))
    asked = quantise(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    packed = settle(_pack(asked, QUERY_BLOCK).withColumn("bid", F.monotonically_increasing_id()))
    dense = Window.partitionBy("dim").orderBy("bid")  # over the blocks' numbers only, one row for QUERY_BLOCK queries
    numbers = packed.select("dim", "bid").withColumn("no", F.row_number().over(dense) - 1)
    packed = settle(packed.join(numbers.select("bid", "no"), "bid").withColumn("qb", F.struct("dim", "no")).drop("no", "bid", "dim"))
    dims = numbers.groupBy("dim").agg(F.count("*").alias("blocks"))
    # each candidate block meets every query block of its dimension; salts spread the candidates of one query block over as many tasks as they need
    salts = max(1, -(-base.count() // PER_SALT))
    met = base.join(dims, "dim").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).withColumn("qb", F.explode(F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda i: F.struct(F.col("dim").alias("dim"), i.alias("no")))))
    salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = met.select("qb", "salt", "dim", "ids", "width", "data").join(salted.select("qb", "salt", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data")), ["qb", "salt"])

    def peak(batches):
        for batch in batches:
            for dim, width, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "width", "data")), strict=True):
                x = np.frombuffer(data, f"<i{width}")
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([float(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))))])], ["dim", "m"])

    most = lambda rows, name: rows.mapInArrow(peak, "dim int, m double").groupBy("dim").agg(F.max("m").alias(name))
    peaks = most(base.select("dim", "width", "data"), "c").join(most(packed.select(F.col("qb.dim").alias("dim"), "width", "data"), "q"), "dim")
    top = peaks.agg(F.max(F.col("c") * F.col("q") * F.col("dim"))).first()[0]
    if top is None:
        return base.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    edge = min(int(top * 1.001) + 1, _TOP)
    # of each query: the range lo to hi that holds its k-th value, and how many scores lie above it
    state = settle(packed.select("qb", "ids").mapInArrow(_spread, "qb struct<dim:int,no:int>, q bigint").select("qb", "q", F.lit(-edge - 1).cast("bigint").alias("lo"), F.lit(edge).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("above")))
    width = 2 * edge + 2
    wide = "decimal(38,0)"  # sums that may pass 64 bits on the way
    while width > 1:
        step = -(-width // BINS)
        counts = _joined(met, state).mapInPandas(_counter(step, k), "q bigint, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = state.join(counts, "q").withColumn("upto", F.col("above") + F.sum("n").over(down))
        # the first bin from above with k scores or more; queries with fewer scores than k keep their lowest bin
        kth = seen.groupBy("q").agg(
            F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("bin"))), F.min("bin")).alias("at"),
            F.first("qb").alias("qb"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
            F.first("above").alias("above"), F.collect_list(F.struct("bin", "n")).alias("all"),
        )
        new_lo = F.col("lo").cast(wide) + F.col("at").cast(wide) * F.lit(str(step)).cast(wide)
        new_hi = F.least(F.col("hi").cast(wide), new_lo + F.lit(str(step - 1)).cast(wide))
        more = F.aggregate("all", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["bin"] > F.col("at"), x["n"]).otherwise(0))
        state = settle(kth.select("qb", "q", new_lo.cast("bigint").alias("lo"), new_hi.cast("bigint").alias("hi"), (F.col("above") + more).alias("above")))
        width = step
    found = _joined(met, state).mapInPandas(_keeper(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _spread(batches):
    for batch in batches:
        for k, ids in enumerate(batch.column("ids").to_pylist()):
            q = _ids(ids)
            yield pa.RecordBatch.from_arrays([batch.column("qb").take(pa.array(np.full(len(q), k))), pa.array(q)], ["qb", "q"])


def _joined(met: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs of blocks with the state of the block's queries, which are QUERY_BLOCK at most."""
    each = state.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("q", "lo", "hi"))).alias("state"))
    return met.join(each, "qb").select("dim", "ids", "width", "data", "q_ids", "q_width", "q_data", "state")


def _pairs(frame: pd.DataFrame):
    """Of each pair of blocks: query ids, candidate ids, scores, which pairs count, and the ends of the queries' ranges."""
    for r in frame.itertuples(index=False):
        qi, ci = _ids(r.q_ids), _ids(r.ids)
        s = products(_matrix(r.q_data, r.q_width, r.dim, len(qi)), _matrix(r.data, r.width, r.dim, len(ci)))
        st = {x["q"]: (x["lo"], x["hi"]) for x in r.state}
        rows = [j for j, q in enumerate(qi.tolist()) if q in st]
        lo = np.array([st[qi[j]][0] for j in rows], np.int64)
        hi = np.array([st[qi[j]][1] for j in rows], np.int64)
        qi = qi[rows]
        yield qi, ci, s[rows], qi[:, None] != ci[None, :], lo, hi


def _counter(step: int, k: int):
    def run(frames):
        for frame in frames:
            for qi, ci, s, counts, lo, hi in _pairs(frame):
                ok = counts & (s >= lo[:, None]) & (s <= hi[:, None])
                if len(ci) > k:  # what lies under the block's own k-th score isn't a k-th of all
                    own = np.where(ok, s, -_TOP - 1)
                    ok &= s >= np.partition(own, len(ci) - k, axis=1)[:, [len(ci) - k]]
                row, col = np.nonzero(ok)
                bin_ = (s[row, col].view(np.uint64) - lo[row].view(np.uint64)) // np.uint64(step)  # differences may take 64 bits
                key, n = np.unique(row * BINS + bin_.astype(np.int64), return_counts=True)
                yield pd.DataFrame({"q": qi[key // BINS], "bin": (key % BINS).astype(np.int32), "n": n.astype(np.int64)})

    return run


def _keeper(k: int):
    def run(frames):
        for frame in frames:
            for qi, ci, s, counts, lo, _ in _pairs(frame):
                by_id = np.argsort(ci, kind="stable")
                ci, s, counts = ci[by_id], s[:, by_id], counts[:, by_id]
                over = counts & (s > lo[:, None])
                ties = counts & (s == lo[:, None])
                ties &= np.cumsum(ties, axis=1) <= k  # any answer takes k of them at most, the smallest ids first
                row, col = np.nonzero(over | ties)
                yield pd.DataFrame({"query_id": qi[row], "vec_id": ci[col], "score": s[row, col]})

    return run
