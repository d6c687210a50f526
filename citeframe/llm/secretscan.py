"""Secret scans: known shapes, and a battery of randomness tests for everything else.

The known shapes are three patterns.  All other runs of LEAST or more letters, digits and + / _ = - are candidates, and
each one is tested.  The narrowest encoding that has all its characters is inferred, and its characters as numbers of
that alphabet face three tests of being uniform and independent: chi-squared over the alphabet, runs above and below
the middle, and serial correlation.  Their p-values are combined by Fisher's method.  The candidates of a batch are
tested together, those of one alphabet and length as a matrix.

False-discovery control goes both ways, over all candidates of like length (_stratum) of a document, by Benjamini-Hochberg.
First the battery's p-values: the candidates that it finds not to be random are dropped, at an expected share of `least`
of random ones among them.  Passing proves little for a short run, so one more p-value asks how likely ordinary text is
to look like that: by Markov's inequality the ratio of the run's probability as ordinary text (letters of four languages,
and how often small letters, capitals, digits and signs follow each other) to that under its alphabet is one, and it
falls exponentially with the run's length.  The findings are those that hold the expected share of ordinary text among
them under `rate`: long runs pass on their own and don't pay for the many short words, short ones pass only where they
are extreme.  A run without letters is a number, and one that fits no alphabet a path or the like: digits of ordinary
numbers are uniform too, so their p-value as text is 1.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import string
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.llm.common import arrow_pass, grown

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Maximal runs, so asking for the least length here drops just the matches that are too short.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: The battery's least length.
LEAST = 8
#: Expected shares: of ordinary text among the findings, and of random runs among those dropped.
RATE, LEAST_RANDOM = 0.005, 0.001
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

_ALPHABETS = [
    "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase,
    string.digits + string.ascii_letters, string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
]
_SETS = [frozenset(a) for a in _ALPHABETS]
#: Letters of ordinary text in English, Spanish, French and German, in percent, a to z.
_LETTERS = [
    [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074],
    [11.5, 2.2, 4.0, 5.0, 12.2, 0.7, 1.8, 0.7, 6.2, 0.5, 0.01, 5.0, 3.2, 6.7, 8.7, 2.5, 0.9, 6.9, 8.0, 4.6, 2.9, 1.1, 0.02, 0.2, 1.0, 0.5],
    [7.6, 0.9, 3.3, 3.7, 14.7, 1.1, 0.9, 0.7, 7.5, 0.6, 0.05, 5.5, 3.0, 7.1, 5.8, 2.5, 1.4, 6.7, 7.9, 7.2, 6.3, 1.8, 0.05, 0.4, 0.1, 0.3],
    [6.5, 1.9, 2.7, 5.1, 16.4, 1.7, 3.0, 4.6, 6.6, 0.3, 1.4, 3.4, 2.5, 9.8, 2.6, 0.7, 0.02, 7.0, 7.3, 6.2, 4.2, 0.8, 1.9, 0.03, 0.04, 1.1],
]
#: How often ordinary text goes from small letters, capitals, digits and signs (rows; the first is a run's start) to each of these; mixed, and all in capitals.
_FOLLOWS = [
    [[0.62, 0.25, 0.10, 0.03], [0.93, 0.02, 0.015, 0.035], [0.42, 0.50, 0.03, 0.05], [0.05, 0.03, 0.77, 0.15], [0.45, 0.15, 0.20, 0.20]],
    [[0.05, 0.82, 0.10, 0.03], [0.60, 0.30, 0.05, 0.05], [0.01, 0.93, 0.025, 0.035], [0.02, 0.06, 0.77, 0.15], [0.05, 0.55, 0.20, 0.20]],
]
_SIGNS = {"-": 0.35, "/": 0.35, "_": 0.15, "=": 0.10, "+": 0.05}
_CLASSES = [string.ascii_lowercase, string.ascii_uppercase, string.digits, "".join(_SIGNS)]


def _by_byte(values: dict[str, float]) -> np.ndarray:
    out = np.zeros(128)
    out[[ord(c) for c in values]] = list(values.values())
    return out


_CLASS = _by_byte({c: float(k) for k, cs in enumerate(_CLASSES) for c in cs}).astype(np.int64)
#: Logarithms of the characters' probabilities within their class, by language.
_TEXTS = np.stack([_by_byte({c: math.log(p / sum(letters)) for cs in _CLASSES[:2] for c, p in zip(cs, letters, strict=True)} | dict.fromkeys(string.digits, math.log(0.1)) | {c: math.log(p) for c, p in _SIGNS.items()}) for letters in _LETTERS])
_STEPS = np.log(np.array(_FOLLOWS))
_PLACES = [_by_byte({c: float(k) for k, c in enumerate(a)}).astype(np.int64) for a in _ALPHABETS]


def _tails(z: np.ndarray) -> np.ndarray:
    return np.fromiter((0.5 * math.erfc(v) for v in (z / math.sqrt(2)).tolist()), np.float64, len(z))


def _alphabet(body: str) -> int:
    """The narrowest alphabet that has all characters, -1 if there is none."""
    have = set(body)
    return next((k for k, s in enumerate(_SETS) if have <= s), -1)


def uniformity(x: np.ndarray, size: int) -> np.ndarray:
    """The combined p-value of the three tests, for each row of numbers under `size`."""
    rows, n = x.shape
    expected = n / size
    counts = np.bincount((np.arange(rows)[:, None] * size + x).ravel(), minlength=rows * size).reshape(rows, size)
    chi = ((counts - expected) ** 2 / expected).sum(axis=1)
    p = [_tails((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    high = x >= size / 2
    a = high.sum(axis=1)
    b = n - a
    mean = 1 + 2 * a * b / n
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    changes = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    p.append(np.where((a > 0) & (b > 0), 2 * _tails(np.abs(changes - mean) / spread), 2.0 ** (1 - n)))
    apart = x - x.mean(axis=1, keepdims=True)
    var = (apart**2).sum(axis=1)
    r = np.where(var > 0, (apart[:, 1:] * apart[:, :-1]).sum(axis=1) / np.where(var > 0, var, 1), 1.0)
    p.append(2 * _tails(np.abs(r + 1 / n) * math.sqrt(n)))
    fisher = -sum(np.log(np.maximum(v, 1e-300)) for v in p)  # half of a chi-squared value with 6 degrees of freedom
    return np.exp(-fisher) * (1 + fisher + fisher * fisher / 2)


def ordinary(codes: np.ndarray, size: int) -> np.ndarray:
    """The p-value as ordinary text, of whichever language and case it resembles most, for each row of character codes."""
    kind = _CLASS[codes]
    before = np.concatenate([np.zeros((len(codes), 1), np.int64), kind[:, :-1] + 1], axis=1)
    letters = _TEXTS[:, codes].sum(axis=2).max(axis=0)
    steps = _STEPS[:, before, kind].sum(axis=2).max(axis=0)
    return np.exp(np.minimum(0.0, letters + steps + codes.shape[1] * math.log(size)))


def battery(runs: Iterable[str]) -> dict[str, tuple[float, float]]:
    """The p-values of each run as ordinary text and by the three tests; (1, 0) for what fits no alphabet or is too short without its padding."""
    alike = defaultdict(list)
    out = {}
    for run in runs:
        body = run.rstrip("=")
        k = _alphabet(body) if len(body) >= LEAST else -1
        if k < 0:
            out[run] = (1.0, 0.0)
        else:
            alike[k, len(body)].append((run, body))
    for (k, n), some in alike.items():
        codes = np.frombuffer("".join(body for _, body in some).encode(), np.uint8).reshape(-1, n)
        size = len(_ALPHABETS[k])
        worded = (_CLASS[codes] < 2).any(axis=1)
        text = np.where(worded, ordinary(codes, size), 1.0).tolist()
        out.update(zip([run for run, _ in some], zip(text, uniformity(_PLACES[k][codes], size).tolist(), strict=True), strict=True))
    return out


def _stratum(run: str) -> int:
    return min(len(run), 20) // 4


#: P-values of short runs that were tested before; they start anew when there are so many, of 200 bytes or so each.
_REMEMBERED: dict[str, tuple[float, float]] = {}
_MOST = 100_000


def _tested(texts: list[list[str]]) -> dict[str, tuple[float, float]]:
    """The p-values of all candidates of some texts."""
    every = set().union(*texts)
    new = battery(every - _REMEMBERED.keys())
    known = new | {run: _REMEMBERED[run] for run in every - new.keys()}
    short = {run: p for run, p in new.items() if len(run) <= 32}
    if len(_REMEMBERED) + len(short) > _MOST:
        _REMEMBERED.clear()
    _REMEMBERED.update(itertools.islice(short.items(), _MOST))
    return known


def _discoveries(p: list[float], rate: float, of: int) -> int:
    """How many of the sorted p-values of `of` tests Benjamini and Hochberg reject."""
    return max((k for k, v in enumerate(p, 1) if v <= rate * k / of), default=0)


def _covered(start: int, end: int, known: list[tuple[int, int]], first: int = 0) -> bool:
    """Whether the spans, sorted, cover all from start to end; those before the first one are known not to."""
    for k in range(first, len(known)):
        a, b = known[k]
        if a > start:
            break
        start = max(start, b)
    return start >= end


def _joined(known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that touch or overlap, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(known):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _random(text: str, candidates: list[str], known: dict[str, tuple[float, float]], rate: float, least: float) -> list[tuple[int, int]]:
    """The candidates found to be random, by false-discovery control among all of like length."""
    if not any(known[run][0] <= rate for run in candidates):  # none can be found
        return []
    tested = defaultdict(list)
    for m in _CANDIDATE.finditer(text):
        p, fit = known[m[0]]
        tested[_stratum(m[0])].append((fit, p, m.span()))
    out = []
    for some in tested.values():
        some.sort()
        kept = sorted((p, at) for _, p, at in some[_discoveries([fit for fit, *_ in some], least, len(some)) :])
        out += [at for _, at in kept[: _discoveries([p for p, _ in kept], rate, len(some))]]
    return out


def spans(text: str, rate: float = RATE, least: float = LEAST_RANDOM) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind.  Random runs that known shapes cover entirely are not told again."""
    return all_spans([text], rate, least)[0]


def all_spans(texts: list[str], rate: float = RATE, least: float = LEAST_RANDOM) -> list[list[tuple[str, int, int]]]:
    """The spans of each text; the candidates of all are tested together."""
    candidates = [_CANDIDATE.findall(t) for t in texts]
    known = _tested(candidates)
    out = []
    for text, mine in zip(texts, candidates, strict=True):
        found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        shapes = _joined([(a, b) for _, a, b in found])
        random = _random(text, mine, known, rate, least)
        found += [("random", *at) for at in random if not _covered(*at, shapes, max(0, bisect.bisect_right(shapes, (at[0], math.inf)) - 1))]
        out.append(sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def redacted(text: str, found: Iterable[tuple[str, int, int]], mark: str = "<secret>") -> str:
    out, at = [], 0
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, columns: list[str], *, redact: str | None = None) -> DataFrame:
    """`columns` of docs and spans; with `redact`, also a column of that name with the text, its spans masked.

    A null or empty text has no spans, and a null one stays null; equal texts give equal rows.
    """
    have = docs.select(*columns, F.col("text").alias("__text"))
    schema = grown(have, columns, "spans array<struct<kind:string,start:bigint,end:bigint>>" + f", `{redact}` string" * (redact is not None))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("__text").to_pylist()
        found = all_spans([t or "" for t in texts])
        cols = [*[batch.column(c) for c in columns], pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f] for f in found], _SPANS)]
        if redact is not None:
            cols.append(pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(cols, [*columns, "spans", *[redact] * (redact is not None)])

    return arrow_pass(have, work, schema, "__text")
