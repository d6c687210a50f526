"""The battery against a plain form of it, run by run, and what it finds."""

import math
import random
import re
import string
import time

import numpy as np
import pytest

from citeframe.llm import secretscan as S


def _tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def _plain_uniformity(body, alphabet):
    n, size = len(body), len(alphabet)
    x = [alphabet.index(c) for c in body]
    e = n / size
    chi = sum((x.count(s) - e) ** 2 / e for s in range(size))
    p = [_tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    high = [v >= size / 2 for v in x]
    a, b = sum(high), n - sum(high)
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p.append(2 * _tail(abs(1 + sum(u != v for u, v in zip(high, high[1:], strict=False)) - mean) / spread))
    else:
        p.append(2.0 ** (1 - n))
    mu = sum(x) / n
    var = sum((v - mu) ** 2 for v in x)
    r = sum((u - mu) * (v - mu) for u, v in zip(x, x[1:], strict=False)) / var if var else 1.0
    p.append(2 * _tail(abs(r + 1 / n) * math.sqrt(n)))
    f = -sum(math.log(max(v, 1e-300)) for v in p)
    return math.exp(-f) * (1 + f + f * f / 2)


def _kind(c):
    return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3


def _plain_ordinary(body, alphabet):
    best = -math.inf
    for letters in S._LETTERS:
        for steps in S._FOLLOWS:
            log, before = 0.0, 0
            for c in body:
                log += math.log(steps[before][_kind(c)]) + (math.log(letters[ord(c.lower()) - 97] / sum(letters)) if c.isalpha() else math.log(0.1) if c.isdigit() else math.log(S._SIGNS[c]))
                before = _kind(c) + 1
            best = max(best, log)
    return math.exp(min(0.0, best + len(body) * math.log(len(alphabet))))


def _plain(run):
    body = run.rstrip("=")
    alphabet = next((a for a in S._ALPHABETS if set(body) <= set(a)), None)
    if alphabet is None or len(body) < 8:
        return 1.0, 0.0
    return (_plain_ordinary(body, alphabet) if any(c.isalpha() for c in body) else 1.0), _plain_uniformity(body, alphabet)


def _plain_random(text, rate=S.RATE, least=S.LEAST_RANDOM):
    """Spans found to be random, one candidate after the other."""
    classes = {}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", text):
        classes.setdefault(min(len(m[0]), 20) // 4, []).append((*_plain(m[0]), m.span()))
    out = []
    for some in classes.values():
        m = len(some)
        fits = sorted((f, p, at) for p, f, at in some)
        cut = max((k for k in range(1, m + 1) if fits[k - 1][0] <= least * k / m), default=0)
        rest = sorted((p, at) for _, p, at in fits[cut:])
        out += [at for _, at in rest[: max((k for k in range(1, len(rest) + 1) if rest[k - 1][0] <= rate * k / m), default=0)]]
    return sorted(out)


ALPHABETS = {"62": string.ascii_letters + string.digits, "32": string.ascii_uppercase + "234567", "64": string.ascii_letters + string.digits + "+/", "36": string.digits + string.ascii_lowercase, "url": string.ascii_letters + string.digits + "-_"}


def _run(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(n))


def test_battery_as_one_by_one():
    rnd = random.Random(1)
    runs = [_run(rnd, rnd.choice([*ALPHABETS.values(), "ab", "z", string.ascii_lowercase]), rnd.randint(8, 60)) + "=" * rnd.choice((0, 0, 1)) for _ in range(600)]
    runs += ["getElementById", "INTERNATIONAL", "internationalization", "20240229", "--------", "a/b-c_d+e", "=" * 20, "aaaaaaa==", "Geschwindigkeit"]
    got = S.battery(runs)
    for run in runs:
        assert got[run] == pytest.approx(_plain(run), rel=1e-9, abs=1e-290), run


def test_spans_as_one_by_one(docs):
    rnd = random.Random(2)
    texts = [r.text for r in docs.select("text").collect() if r.text]
    texts += [f"{t[:900]} {_run(rnd, rnd.choice(list(ALPHABETS.values())), rnd.randint(10, 30))} {t[900:2000]} {_run(rnd, ALPHABETS['62'], 24)}" for t in texts[:150]]
    for text, found in zip(texts, S.all_spans(texts), strict=True):
        shapes = [(a, b) for k, a, b in found if k != "random"]
        assert [(a, b) for k, a, b in found if k == "random"] == [at for at in _plain_random(text) if not S._covered(*at, sorted(shapes))]


def test_every_candidate_is_tested(docs, monkeypatch):
    texts = [r.text for r in docs.select("text").collect() if r.text]
    every = {m for t in texts for m in re.findall(r"[A-Za-z0-9+/_=-]{8,}", t)}
    tested = set()
    battery = S.battery
    monkeypatch.setattr(S, "_REMEMBERED", {})
    monkeypatch.setattr(S, "battery", lambda runs: (tested.update(runs), battery(runs))[1])
    sizes = []
    uniformity = S.uniformity
    monkeypatch.setattr(S, "uniformity", lambda x, size: (sizes.append(len(x)), uniformity(x, size))[1])
    found = S.all_spans(texts)
    assert tested == every and sum(sizes) > 0.95 * len(every)  # the others fit no alphabet
    assert sum(k == "random" for f in found for k, *_ in f) <= 2  # these texts hold none


@pytest.mark.parametrize(("name", "length"), [(a, n) for a in ("62", "32", "64") for n in (16, 20, 32)])
def test_recall_in_ordinary_documents(docs, name, length):
    rnd = random.Random(length)
    texts = [r.text for r in docs.select("text").collect() if r.text and 500 < len(r.text) < 5000][:300]
    planted = []
    for t in texts:
        at = t.rfind(" ", 0, rnd.randrange(len(t))) + 1
        planted.append((t[:at] + _run(rnd, ALPHABETS[name], length) + " " + t[at:], at))
    hits = [any(a <= at and at + length <= b for _, a, b in f) for f, (_, at) in zip(S.all_spans([t for t, _ in planted]), planted, strict=True)]
    assert np.mean(hits) >= 0.9


def test_many_known_and_random_spans():
    rnd = random.Random(8)
    text = " ".join(f"{_run(rnd, '0123456789abcdef', 20)} {_run(rnd, ALPHABETS['62'], 30)}" for _ in range(20_000))
    began = time.time()
    found = S.spans(text)
    assert time.time() - began < 30 and sum(k == "hex" for k, *_ in found) == 20_000 and sum(k == "random" for k, *_ in found) > 19_000
