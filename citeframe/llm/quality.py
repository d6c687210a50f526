"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE consecutive words; its label belongs to the bag.  Every passage is
described by surface statistics (character classes, word lengths, repetition) and hashed words, a tanh layer
encodes it, gated attention - softmax of w . (tanh(V h) * sigmoid(U h)) over the bag - weighs the encodings, and
a logistic unit scores their weighted mean.  All weights are learned from document labels by gradient descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.llm import kernel
from citeframe.llm.common import arrow_pass, grown

PASSAGE = 64
HASHED = 32
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "#$%&*@^~|", "\"'()[]{}<>", "-_/\\=+:;`"]
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(x) for x in _g]] = _k
_CLASS[0x80:] = len(_GROUPS) + 1
N_CLASSES = len(_GROUPS) + 2
WIDTH = N_CLASSES + 8 + HASHED


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the bounds of each document's; every document has one at least."""
    w = kernel.words(data, bounds, kernel.SPACED)
    docs = len(bounds) - 1
    n_words = np.diff(w.ptr)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    ptr = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(ptr[-1])
    doc = w.doc()
    of = ptr[doc] + (np.arange(len(doc)) - w.ptr[doc]) // PASSAGE  # passage of each word
    first = np.searchsorted(of, np.arange(total), side="left")
    # bytes from a passage's first word to the next one's; a document without words is one passage
    begin = np.repeat(bounds[:-1], n_pass)
    later = np.ones(total, bool)
    later[ptr[:-1]] = False
    begin[later] = w.start[first[later]]
    edges = np.append(begin, len(data))
    out = np.zeros((total, WIDTH), np.float32)
    key = np.repeat(np.arange(total), np.diff(edges)) * N_CLASSES + _CLASS[data]
    out[:, :N_CLASSES] = np.bincount(key, minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    size = out[:, :N_CLASSES].sum(axis=1, keepdims=True)
    out[:, :N_CLASSES] = np.sqrt(out[:, :N_CLASSES] / np.maximum(size, 1))
    count = np.bincount(of, minlength=total)
    long = (w.end - w.start).astype(float)
    safe = np.maximum(count, 1)
    mean = np.bincount(of, long, total) / safe
    at = N_CLASSES
    out[:, at] = np.log1p(count)
    out[:, at + 1] = np.log1p(mean)
    out[:, at + 2] = np.log1p(np.sqrt(np.maximum(0, np.bincount(of, long * long, total) / safe - mean * mean)))
    order = np.lexsort((w.hash, of))
    again = np.zeros(len(of), bool)
    if len(of):
        again[order[1:]] = (w.hash[order[1:]] == w.hash[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    out[:, at + 3] = np.bincount(of, again, total) / safe
    for k, lag in enumerate((1, 2)):
        same = np.zeros(len(of), bool)
        same[lag:] = (w.hash[lag:] == w.hash[:-lag]) & (of[lag:] == of[:-lag])
        out[:, at + 4 + k] = np.bincount(of, same, total) / safe
    last = _CLASS[data[w.end - 1]] if len(of) else np.empty(0, np.uint8)
    out[:, at + 6] = np.bincount(of, (last >= 7) & (last <= 8), total) / safe
    out[:, at + 7] = np.repeat(np.log1p(n_pass), n_pass)
    at += 8
    hashed = np.bincount(of * HASHED + (w.hash % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
    out[:, at:] = np.sqrt(hashed / safe[:, None])
    return out, ptr


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, ptr: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["w1"] + p["b1"])
        v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (v * u) @ p["a"]
        doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        a = np.exp(e - np.maximum.reduceat(e, ptr[:-1])[doc])
        a /= np.add.reduceat(a, ptr[:-1])[doc]
        z = np.add.reduceat(h * a[:, None], ptr[:-1], axis=0)
        return {"h": h, "v": v, "u": u, "att": a, "doc": doc, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        x, ptr = passages(data, bounds)
        return self._forward((x - self.mean) / self.scale, ptr)["score"]


def train(x: np.ndarray, ptr: np.ndarray, y: np.ndarray, weight: np.ndarray, *, dim: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
    """x: passage features with document bounds ptr; y: 0 or 1 and a weight for each document.  Adam on the weighted log loss."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"w1": init(x.shape[1], dim), "b1": np.zeros(dim), "v": init(dim, gate), "u": init(dim, gate), "a": init(gate), "c": init(dim), "b": np.zeros(1)}
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, p)
    x = (x - model.mean) / model.scale
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            sizes = ptr[rows + 1] - ptr[rows]
            sub = np.concatenate([[0], np.cumsum(sizes)])
            xs = x[np.repeat(ptr[rows] - sub[:-1], sizes) + np.arange(sub[-1])]
            f = model._forward(xs, sub)
            d = (f["score"] - y[rows]) * weight[rows] / len(rows)
            dz = d[:, None] * p["c"][None, :]
            dh = dz[f["doc"]] * f["att"][:, None]
            da = (dz[f["doc"]] * f["h"]).sum(axis=1)
            de = f["att"] * (da - np.add.reduceat(f["att"] * da, sub[:-1])[f["doc"]])
            dg = de[:, None] * p["a"][None, :]
            dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
            dh = (dh + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
            grad = {"w1": xs.T @ dh, "b1": dh.sum(axis=0), "v": f["h"].T @ dv, "u": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ d, "b": np.array([d.sum()])}
            t += 1
            for k, g in grad.items():
                g = g + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, **options) -> Model | None:
    """Train on `docs` (doc_id, text) joined to `labels` (doc_id, label); None without labels.

    About `per_class` documents of each class are used at most, picked by the hash of their id, and weighted so
    that the classes keep their shares; only that bounded sample is broadcast, and only its passage features come
    to the driver.  Several labels of one document: the highest counts.
    """
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, per_class / n))) for k, n in counts.items()])
    picked = one.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * per_class * len(counts))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, ptr = passages(*kernel.buffers(batch.column("text")))
        raw = [x[ptr[k] : ptr[k + 1]].astype(np.float32).tobytes() for k in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(raw, pa.binary())], ["doc_id", "label", "x"])

    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    rows = sorted((r["doc_id"], r["label"], bytes(r["x"])) for r in arrow_pass(joined, work, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, x binary").collect())
    if not rows:
        return None
    x = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    y = np.array([r[1] for r in rows], float)
    got = {k: max(1, int((y == k).sum())) for k in counts}
    weight = np.array([counts[int(k)] / got[int(k)] for k in y])
    return train(np.concatenate(x).astype(float), np.concatenate([[0], np.cumsum([len(v) for v in x])]), y, weight / weight.mean(), **options)


def score(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """`columns` of docs and score, the probability of label 1.

    A null text counts as empty, an empty text is one passage without words; without a model every score is 0.5.
    """
    have = docs.select(*columns, F.col("text").alias("__text"))
    schema = grown(have, columns, "score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = np.full(batch.num_rows, 0.5) if m is None else m.scores(*kernel.buffers(batch.column("__text")))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(s, pa.float64())], [*columns, "score"])

    return arrow_pass(have, work, schema, "__text")
