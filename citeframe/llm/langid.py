"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the mean of the embeddings of its hashed byte 3- and 4-grams (case folded, everything but
letters turned into spaces, which thereby mark word ends), and a linear softmax over the mean gives the
languages; it has no bias, so that text of unseen n-grams stays near the uniform distribution.  Embeddings and softmax are trained together by stochastic gradient descent in numpy.  A
separate part of the labelled sample calibrates: cut to runs of a few words, where languages are still mistaken, it fits the temperature
of the softmax; and the score under which a prediction is rejected.

As the softmax is linear, embedding times weights is one small table, so whole corpora are scored by table
look-ups and sums; the table holds integers, which makes a score independent of how rows were batched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.llm import kernel
from citeframe.llm.common import arrow_pass, give_back, grown

ORDERS = (3, 4)
BITS = 17  # buckets of each order
UNKNOWN = "und"
SNIPPETS = 5  # of each text that calibrates
_MULTIPLIER = {3: np.uint32(2654435761), 4: np.uint32(2246822519)}
_POINT = 1 << 16  # fixed point of the scoring table

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True


def _letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of each document between two spaces, in one buffer with its bounds."""
    n, docs = len(data), len(bounds) - 1
    folded = kernel.FOLD[data]
    if n > 1:  # the Latin-1 capitals, but the multiplication sign, are two bytes from C3 80 to C3 9E
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][upper] += 0x20
    folded[~_LETTER[folded]] = 0x20
    out = np.full(n + 2 * docs, 0x20, dtype=np.uint8)
    out[np.arange(n) + np.repeat(2 * np.arange(docs) + 1, np.diff(bounds))] = folded
    return out, bounds + 2 * np.arange(docs + 1)


def features(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each byte (0: none, or no letter), with the documents' bounds."""
    text, at = _letters(data, bounds)
    out = []
    for k, order in enumerate(ORDERS):
        m = len(text) - order + 1
        code, any_letter = np.zeros(max(m, 0), np.uint32), np.zeros(max(m, 0), bool)
        for j in range(order):
            code = (code << np.uint32(8)) | text[j : j + m]
            any_letter |= text[j : j + m] != 0x20
        bucket = ((code * _MULTIPLIER[order]) >> np.uint32(32 - BITS)).astype(np.int32) + (1 + (k << BITS))
        bucket[~any_letter] = 0
        full = np.zeros(len(text), np.int32)
        full[: max(m, 0)] = bucket
        over = (at[1:, None] - np.arange(1, order)[None, :]).ravel()  # n-grams that would reach into the next document
        full[over[over >= 0]] = 0
        out.append((full, at))
    return out


BUCKETS = 1 + (len(ORDERS) << BITS)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # languages x BUCKETS, fixed point
    temperature: float
    reject_below: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, documents x languages."""
        total = np.zeros((len(bounds) - 1, len(self.langs)), np.int64)
        count = np.zeros(len(bounds) - 1, np.int64)
        for bucket, at in features(data, bounds):
            for k in range(len(self.langs)):
                total[:, k] += np.add.reduceat(self.table[k].take(bucket), at[:-1])
            count += np.add.reduceat((bucket > 0).astype(np.int64), at[:-1])
        logits = total / (_POINT * np.maximum(count, 1))[:, None]
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def snippet(text: str, rng: np.random.Generator) -> str:
    """A run of 1 to 16 words of a text; the whole text if it has no more."""
    words = text.split()
    n = int(rng.choice([1, 2, 4, 8, 16]))
    at = int(rng.integers(0, max(1, len(words) - n + 1)))
    return " ".join(words[at : at + n])


def train(texts: list[str], langs: list[str], *, dim: int = 16, steps: int = 400, rate: float = 30.0, batch: int = 32, miss: float = 0.002, most: float = 0.5, seed: int = 7) -> Model:
    """Fit on four fifths of the rows; the rest calibrates: several snippets of each fit the temperature, by the least log loss.
    `miss` is the share of right predictions of whole texts there that rejection may lose, and `most` the highest score that may be rejected."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    fit, held = order[: max(1, len(order) * 4 // 5)], order[len(order) * 4 // 5 :]

    def count(t: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        ids = np.concatenate([b for b, _ in features(raw, np.array([0, len(raw)]))])
        ids, n = np.unique(ids[ids > 0], return_counts=True)
        return ids, (n / max(1, n.sum())).astype(np.float32)

    counted = [count(t) for t in texts]
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    w = np.zeros((dim, len(names)), np.float32)
    share = np.bincount(y[fit], minlength=len(names)) / len(fit)
    weight = (1 / (len(names) * np.maximum(share, 1e-9))).clip(0, 10)

    def packed(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([ids for ids, _ in some]), np.concatenate([v for _, v in some]), np.concatenate([[0], np.cumsum([len(ids) for ids, _ in some])])

    def mean(ids: np.ndarray, v: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return kernel.by_doc(emb[ids] * v[:, None], ptr, empty=0.0)

    epochs = max(2, -(-steps * batch // max(1, len(fit))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            ids, v, ptr = packed([counted[r] for r in rows])
            z = mean(ids, v, ptr)
            d = softmax(z @ w)
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= (weight[y[rows]] / len(rows))[:, None]
            dz = d @ w.T
            w -= 0.02 * step * (z.T @ d).astype(np.float32)
            back = np.repeat(dz, np.diff(ptr), axis=0) * v[:, None]
            np.add.at(emb, ids, (-step * back).astype(np.float32))
        rng.shuffle(fit)
    table = np.ascontiguousarray(np.round(emb @ w * _POINT).astype(np.int64).T)
    table[:, 0] = 0
    model = Model(names, table, 1.0, 0.0)
    if not len(held):
        model.reject_below = most
        return model
    short = [(count(snippet(texts[r], rng)), y[r]) for r in held for _ in range(SNIPPETS)]
    short = [x for x in short if len(x[0][0])]
    if short:
        logits, of = mean(*packed([x for x, _ in short])) @ w, np.array([k for _, k in short])
        options = np.geomspace(0.02, 20, 121)
        loss = [-np.log(softmax(logits / t)[np.arange(len(of)), of] + 1e-12).mean() for t in options]
        model.temperature = float(options[int(np.argmin(loss))])
    p = softmax(mean(*packed([counted[r] for r in held])) @ w / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    model.reject_below = float(min(most, np.quantile(right, miss))) if len(right) else most
    return model


def fit(docs: DataFrame, *, per_lang: int = 400, most_rows: int = 40_000, **options) -> Model | None:
    """Train on `docs` (text, lang, key); None if no row has both.

    About `per_lang` rows of each language are used, fewer each if that made more than `most_rows` in all, picked by the
    hash of the key; languages of few rows bring all of theirs.  So the sample on the driver is bounded by the two
    parameters; its rows are whole texts.
    """
    rows = docs.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = min(per_lang, max(1, most_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    picked = rows.filter(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)).filter(F.col("text").rlike(r"\p{L}"))
    sample = sorted((r["key"], r["lang"], r["text"]) for r in picked.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "lang", "text").limit(2 * each * len(counts)).collect())
    model = train([t for _, _, t in sample], [x for _, x, _ in sample], **options) if sample else None
    del sample
    give_back()
    return model


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """`columns` of docs, then lang_pred, score and rejected.

    Null, empty and letterless texts: `und`, score 0, rejected.  Without a model the rest is `und` with score 0,
    but not rejected.
    Repeated rows get equal results; a tie between languages goes to the first by name.
    """
    extra = "lang_pred string, score double, rejected boolean"
    have = docs.select(*columns, F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = grown(have, columns, extra)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed: BUCKETS x languages

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, m = batch.num_rows, shared.value
        letter = batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
        if m is None:
            lang, score, out = [UNKNOWN] * n, np.zeros(n), ~letter
        else:
            p = m.scores(*kernel.buffers(batch.column("__text")))
            best = p.argmax(axis=1)
            score = np.where(letter, p[np.arange(n), best], 0.0)
            lang = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)]
            out = ~letter | (score < m.reject_below)
        kept = [batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(out)], [*columns, "lang_pred", "score", "rejected"])

    return arrow_pass(have, work, schema, "__text")
