import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from citeframe.llm import bpe, decontam, kernel, langid, quality, queries, secretscan

D = "/root/testdata/sf0.01"


def test_words_and_slices():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aB \t\x1cé0!\n") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for table, pattern in ((kernel.SPACED, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = kernel.words(data, bounds, table)
        name = {}
        for d, t in enumerate(texts):
            want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t))
            assert len(want) == w.ptr[d + 1] - w.ptr[d]
            for x, h in zip(want, w.hash[w.ptr[d] : w.ptr[d + 1]].tolist(), strict=True):
                assert name.setdefault(x, h) == h
        assert len(set(name.values())) == len(name)


def test_language(spark, docs, odd, none):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, D).collect()}
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.98
    assert np.mean([r.rejected for r in got.values()]) < 0.02
    model = queries.language_model(docs)
    rows = langid.predict(odd, model, ["doc_id", "source"]).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3, 8} and all(r.rejected for r in rows if r.lang_pred == "und")
    other = spark.createDataFrame([(1, "это русский текст о погоде и природе, написанный для проверки")], "doc_id bigint, text string")
    assert langid.predict(other, model, ["doc_id"]).first().rejected
    assert langid.fit(none.withColumn("key", F.col("doc_id"))) is None
    assert not langid.predict(odd, None, ["doc_id"]).filter("doc_id = 6 and rejected").count()
    assert langid.predict(none, model, ["doc_id"]).count() == 0


def test_quality(spark, odd, none):
    got = {r.doc_id: r for r in queries.op8_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.98
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    assert [r.score for r in quality.score(odd, None, ["doc_id"]).collect()] == [0.5] * 10
    x, ptr = quality.passages(np.empty(0, np.uint8), np.array([0, 0, 0]))
    assert x.shape == (2, quality.WIDTH) and np.isfinite(x).all()
    model = quality.train(np.random.default_rng(0).normal(size=(40, quality.WIDTH)), np.arange(0, 41, 2), np.arange(20) % 2.0, np.ones(20), epochs=2)
    assert quality.score(none, model, ["doc_id"]).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model, ["doc_id"]).collect())


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality.WIDTH))
    y = np.array([0.0, 1.0] * 10)
    x[::3][: len(y)] += y[:, None] * 2  # one passage of each three tells the label
    m = quality.train(x, np.arange(0, 61, 3), y, np.ones(20), epochs=60)
    p = m._forward((x - m.mean) / m.scale, np.arange(0, 61, 3))["score"]
    assert ((p >= 0.5) == y).all()


def test_secrets(spark, docs, odd, none):
    base = [("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    def brute(t):
        found = [(k, m.start(), m.end()) for k, p, g, n in base for m in re.finditer(p, t or "") if len(m[g]) >= n]
        return sorted(found, key=lambda s: (s[1], secretscan.KINDS.index(s[0])))
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["token", "=", " ", "API_KEY", ": ", '"', "AKIA", "ABCDEF0123", "0123456789abcdef", "x", "ſecret", "password=token:", "é"]) for _ in range(40)) for _ in range(300)]
    for t in [*texts, *[r.text for r in docs.select("text").collect()]]:
        assert [s for s in secretscan.spans(t) if s[0] != "random"] == brute(t)
    text = "see 7dKq2ZxP0vLmW9sYtB4nRj8HcE5uGfA1 and chapter_2_of_the_report_2024_final_version here"
    assert [(k, text[a:b]) for k, a, b in secretscan.spans(text)] == [("random", "7dKq2ZxP0vLmW9sYtB4nRj8HcE5uGfA1")]
    assert secretscan.spans("zzzzzzzzzzzzzzzzzzzzzzzzzzzzz1") == []
    assert secretscan.redacted("a token = abcdefabcdef0123456789 b", [("assign", 2, 32), ("hex", 10, 32)]) == "a <secret> b"
    r = {x.doc_id: x for x in queries.op4_secret_scan(spark, D).collect()}
    for d in docs.select("doc_id", "text").collect():
        want = brute(d.text)
        assert r[d.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r[d.doc_id].n_hex == sum(k == "hex" for k, *_ in want)
    assert secretscan.scan(odd, ["doc_id", "score"], redact="masked").count() == 10 and secretscan.scan(none, ["doc_id"]).count() == 0


def test_bpe(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    v = bpe.Vocabulary.load(bpe.vocabulary_path())
    rnd = random.Random(1)
    pool = "abcXYZ éÉÀßſKİΣς'\"!#<|>endoftext 0123٣ⅷ日本語ё́̈ \x1c\x85\n\t😀👍ﬁ한국"
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>x<|startoftext|>", "don't", "!" * 3000, "ab" * 900, ""]
    for text, ids, want in zip(texts, v.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == want.ids and v.decode(ids) == t.decode(ids, skip_special_tokens=False), text
    got = {r.doc_id: r for r in queries.op5_bpe(spark, D).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text, add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.round_trip(odd, bpe.vocabulary_path(), ["doc_id", "score"]).collect()
    assert len(rows) == 10 and [r.ids for r in rows if r.doc_id == 1] == [[]]
    assert bpe.round_trip(none, bpe.vocabulary_path(), ["doc_id"]).count() == 0


def _brute_leaks(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= x
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    want = _brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    for bits in (decontam.FILTER_BITS, 1 << 16):  # a clear filter, and a full one
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.find(docs, bench, ["doc_id"], filter_bits=bits).collect()}
        assert got == want
    assert sum(v[1] > 0 for v in want.values()) > 10
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    d = [(k, text(rnd.randint(0, 60))) for k in range(200)]
    b = [(k, text(rnd.randint(0, 14))) for k in range(40)] + [(99, None), (3, "a b c")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.find(spark.createDataFrame(d, "doc_id int, text string"), spark.createDataFrame(b, "item_id int, text string"), ["doc_id"]).collect()}
    assert got == _brute_leaks(d, b)
    assert decontam.find(odd, bench, ["doc_id", "score"]).count() == 10 and decontam.find(none, bench, ["doc_id"]).count() == 0
    assert decontam.find(odd, bench.limit(0), ["doc_id"]).filter("n_hit > 0").count() == 0


def test_decontamination_of_equal_words(spark):
    n = 20_000  # pairing places would make 400 million rows
    d = spark.createDataFrame([(1, "la " * n), (2, "la " * 9), (3, "x " + "la " * 12 + "y"), (3, "x " + "la " * 12 + "y")], "doc_id int, text string")
    b = spark.createDataFrame([(7, "la " * n), (8, "la " * n), (9, "y")], "item_id int, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontam.find(d, b, ["doc_id"]).collect())
    assert got == [(1, n, n, ["7", "8"], [(0, n)]), (2, 9, 0, [], []), *[(3, 14, 13, ["7", "8", "9"], [(1, 14)])] * 2]
