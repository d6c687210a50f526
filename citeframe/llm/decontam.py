"""Benchmark decontamination by winnowing.

Words are hashed; of every WINDOW consecutive words, that is WINDOW - GRAM + 1 consecutive GRAM-grams, the
smallest gram hash is kept as the window's fingerprint, in benchmark items and in documents alike.  Two texts that share
WINDOW words therefore share the fingerprint kept for that window, so joining the fingerprints finds every
shared window.  A hit is extended to all windows around it that keep the same fingerprint: the join compares 128 bits of
each whole window along with its fingerprint.  An item shorter than a window is one window itself, and its own fingerprint.

Each side counts a window once for a text, with all the places where it stands, so a text of n equal words has one
row and not n, and its hits are not paired place by place.  Before the join, documents drop the windows whose fingerprint or hash is
surely none of the benchmark's: a filter of FILTER_BITS bits, whatever the benchmark's size, is all that is sent to every task.  Both
sides of the join are ordinary tables; the benchmark is never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.llm import kernel
from citeframe.llm.common import arrow_pass, grown, id_filter, settle, split_by, whole_groups

WINDOW = 10
GRAM = 5
#: Bits (2 MB) of the filter of the benchmark's fingerprints and window hashes.  A fuller one lets more windows through to the join.
FILTER_BITS = 1 << 24


def fingerprints(h: np.ndarray, ptr: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every window that lies in one text."""
    g, _ = kernel.grams(h, ptr, gram)
    span = window - gram + 1
    m = len(g) - span + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = g[:m].copy()
    for j in range(1, span):
        np.minimum(low, g[j : j + m], out=low)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    first = np.flatnonzero(doc[:m] == doc[window - 1 : window - 1 + m])
    return first, low[first]


def spelled(h: np.ndarray, first: np.ndarray, n: int, salt: int) -> np.ndarray:
    """The hash of the n words from each of `first` on."""
    out = np.zeros(len(first), np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD1B54A32D192ED03) + kernel.mix(h[first + j], salt)
    return kernel.mix(out, salt + n)


def windows(w: kernel.Words, short: list[int] | None, window: int, gram: int, bits: np.ndarray | None = None):
    """(first words, length, fingerprints, two hashes) of the windows of texts.

    With `short`, the lengths of short items, these are taken everywhere; without, a text of fewer words than `window` is one window.
    `bits` drops what is not in the filter.
    """
    first, print_ = fingerprints(w.hash, w.ptr, window, gram)
    if bits is not None:
        keep = _known(bits, print_)
        first, print_ = first[keep], print_[keep]
    found = [(first, window, print_)]
    n = np.diff(w.ptr)
    doc = w.doc()
    for k in short if short is not None else sorted(set(n[(n > 0) & (n < window)].tolist())):
        at = w.ptr[:-1][n == k] if short is None else np.flatnonzero(doc[: max(len(doc) - k + 1, 0)] == doc[k - 1 :])
        found.append((at, k, None))
    for at, k, low in found:
        a = spelled(w.hash, at, k, 11)
        keep = np.ones(len(at), bool) if bits is None else _known(bits, a)
        at, a = at[keep], a[keep]
        yield at, k, a if low is None else low[keep], a, spelled(w.hash, at, k, 12)


def _place(x: np.ndarray, size: int) -> np.ndarray:
    return (kernel.mix(x, 8) % np.uint64(size)).astype(np.int64)


def _known(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = _place(x, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def benchmark_windows(benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(n, fp, w1, w2, item): the distinct windows of benchmark (item_id, text); null texts and texts without words have none."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = kernel.words(*kernel.buffers(batch.column("text")), kernel.ALNUM)
        doc = w.doc()
        got = list(windows(w, None, window, gram))
        item = batch.column("item").take(pa.array(np.concatenate([doc[at] for at, *_ in got]) if len(doc) else np.empty(0, np.int64)))
        columns = [_signed(np.concatenate([x[c] for x in got])) for c in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([x[1] for x in got], [len(x[0]) for x in got]).astype(np.int32)), *columns, item], ["n", "fp", "w1", "w2", "item"])

    have = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.col("text").isNotNull() & F.col("item").isNotNull())
    return arrow_pass(have, work, "n int, fp bigint, w1 bigint, w2 bigint, item string").distinct()


def _bits(known: DataFrame, size: int) -> np.ndarray:
    """The filter of the fingerprints and hashes of `known`: each task makes one of `size` bits, of which as many are joined as there are groups."""

    def run(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            for c in ("fp", "w1"):
                bits[_place(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), size)] = True
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    at = known.select("fp", "w1").mapInArrow(run, "at bigint")
    page = 1 << 15
    rows = at.select(F.floor(F.col("at") / page).alias("page"), F.pmod("at", F.lit(page)).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():  # size / 8 bytes at most, whatever the benchmark
        out[r["page"] * page // 8 : (r["page"] + 1) * page // 8] = np.frombuffer(r["bits"], np.uint8)[: page // 8]
    return out


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(t1, t2, n_hit, items, spans) of each distinct text of docs that is hit; t1 and t2 are the text's hashes."""
    known = settle(benchmark_windows(benchmark, window, gram))
    short = sorted(r["n"] for r in known.filter(F.col("n") < window).select("n").distinct().collect())  # fewer than `window`
    shared = docs.sparkSession.sparkContext.broadcast(_bits(known, filter_bits))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = kernel.words(*kernel.buffers(batch.column("text")), kernel.ALNUM)
        doc = w.doc()
        out = []
        for at, n, fp, a, b in windows(w, short, window, gram, shared.value):
            d = doc[at]
            order = np.lexsort((at, b, a, d))
            at, d, fp, a, b = at[order], d[order], fp[order], a[order], b[order]
            new = np.ones(len(at), bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array((at - w.ptr[:-1][d]).astype(np.int32)))
            text = pa.array(d[head])
            out.append(pa.RecordBatch.from_arrays([batch.column("t1").take(text), batch.column("t2").take(text), pa.array(np.full(len(head), n, np.int32)), _signed(fp[head]), _signed(a[head]), _signed(b[head]), places], ["t1", "t2", "n", "fp", "w1", "w2", "places"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else out[0]

    met = arrow_pass(docs.select(*_key(F.col("text")), "text"), work, "t1 bigint, t2 bigint, n int, fp bigint, w1 bigint, w2 bigint, places array<int>")
    met = met.dropDuplicates(["t1", "t2", "n", "fp", "w1", "w2"]).join(known, ["n", "fp", "w1", "w2"]).select("t1", "t2", "n", "places", "item")

    def sum_up(batches):
        for got in whole_groups(batches, "t1"):
            t1, t2, n = (got.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2", "n"))
            at = np.flatnonzero(np.concatenate([[True], (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]))
            items, places = got.column("item").to_pylist(), got.column("places")
            flat, ends = places.values.to_numpy(), places.offsets.to_numpy()
            rows = []
            for lo, hi in zip(at, np.append(at[1:], len(t1)), strict=True):
                first = flat[ends[lo] : ends[hi]].astype(np.int64)
                size = np.repeat(n[lo:hi], np.diff(ends[lo : hi + 1]))
                edge = np.zeros(int((first + size).max()) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + size, -1)
                on = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
                begin, end = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
                rows.append((t1[lo], t2[lo], int((end - begin).sum()), sorted(set(items[lo:hi])), [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS), strict=True)], ["t1", "t2", "n_hit", "items", "spans"])

    return met.repartition("t1").sortWithinPartitions("t1", "t2").mapInArrow(sum_up, "t1 bigint, t2 bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, columns: list[str], *, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """`columns` of docs, then n_words, n_hit, items (ids as strings, sorted), spans (word ranges, end exclusive).

    A null or wordless document has no words and no hits; repeated documents get equal rows, repeated item ids
    count once, items without an id are none; with an empty benchmark nothing is hit.  docs is read twice.
    """
    found = settle(hits(docs, benchmark, window=window, gram=gram, filter_bits=filter_bits))
    have = docs.select(*columns, *[c.alias(f"__{n}") for c, n in zip(_key(F.col("text")), ("t1", "t2"), strict=True)], F.col("text").alias("__text"))
    schema = grown(have, [*columns, "__t1", "__t2"], "n_words bigint")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = kernel.count_words(*kernel.buffers(batch.column("__text")), kernel.ALNUM)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*columns, "__t1", "__t2")], pa.array(n)], schema.names)

    # what is surely not hit, most of it, needs no shuffle
    rows = split_by(have, F.col("__t1"), id_filter(found.select("t1").distinct(), "t1"))
    clear, some = (arrow_pass(rows.filter(on).drop("__maybe"), count, schema, "__text") for on in ("not __maybe", "__maybe"))
    some = some.join(found.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), *[F.col(c).alias(f"__{c}") for c in ("n_hit", "items", "spans")]), ["__t1", "__t2"], "left")
    told = {"n_hit": "bigint", "items": "array<string>", "spans": "array<struct<start:bigint,end:bigint>>"}
    empty = {"n_hit": F.lit(0).cast("bigint"), "items": F.array().cast(told["items"]), "spans": F.array().cast(told["spans"])}
    out = some.select(*columns, "n_words", *[F.coalesce(F.col(f"__{c}"), empty[c]).alias(c) for c in told])
    return clear.select(*columns, "n_words", *[empty[c].alias(c) for c in told]).unionByName(out)
