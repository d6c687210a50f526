"""BPE encoding and decoding with a contiguous rank array.

A word is held as the row of its parts and, next to it, the row of the ranks of adjacent parts.  The smallest
rank (the leftmost, if equal) is found by a scan, the boundary there is deleted by shifting both rows, and the
two neighbouring ranks are looked up again, until no pair has a rank.  All short words of a batch that are not
in the cache go through this together, as the rows of two arrays; longer ones (over SHORT parts), for which
repeated scans would be quadratic, through a heap with the same order of merges.

The vocabulary is a JSON file of the kind with word ends: NFC, lower case, split into words, bytes written as
letters.  Its strings of special tokens are found in the raw text first, as they are.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeframe.llm.common import arrow_pass, grown

SHORT = 48
#: Short words remembered by a Python worker, at 150 bytes or so each; the cache starts anew when full.
CACHE = 200_000
_NONE = np.int32(2**31 - 1)
#: Unicode white space.
_SPACE = r"\t-\r \u0085   -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + rest.index(b)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]  # by id
    single: np.ndarray  # id of each byte
    final: np.ndarray  # id of each byte as a word's last part
    keys: np.ndarray  # hash table of pairs, left << 16 | right; 0 is never a pair of a merge and marks a free slot
    ranks: np.ndarray
    merged: np.ndarray  # id made by each rank
    special: dict[str, int]
    cache: dict[str, bytes] = field(default_factory=dict)  # ids of each word as 32-bit integers

    _MULT = np.uint32(0x9E3779B1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in [*vocab.items(), *special.items()]:
            tokens[i] = t
        letters = byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        size = 1 << (len(merges) * 4).bit_length()
        keys, ranks = np.zeros(size, np.uint32), np.full(size, _NONE, np.int32)
        shift = 33 - size.bit_length()
        for rank, (a, b) in enumerate(merges):
            key = vocab[a] << 16 | vocab[b]
            at = ((key * int(cls._MULT)) & 0xFFFFFFFF) >> shift
            while keys[at] and keys[at] != key:
                at = (at + 1) % size
            if not keys[at]:
                keys[at], ranks[at] = key, rank
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        return cls(tokens, np.array([vocab[x] for x in letters], np.int32), np.array([vocab[x + "</w>"] for x in letters], np.int32), keys, ranks, merged, special)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; negative ids and unknown pairs have none."""
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = (key[todo] * self._MULT) >> np.uint32(33 - len(self.keys).bit_length())
        while len(todo):
            seen = self.keys[at]
            found = seen == key[todo]
            out[todo[found]] = self.ranks[at[found]]
            on = ~found & (seen != 0)
            todo, at = todo[on], (at[on] + np.uint32(1)) & np.uint32(len(self.keys) - 1)
        return out

    def _short(self, words: list[bytes]) -> list[bytes]:
        out = [b""] * len(words)
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 4096):  # words of about the same length together
            rows = order[lo : lo + 4096]
            n, width = size[rows], int(size[rows[-1]])
            flat = np.frombuffer(b"".join(words[r] for r in rows), np.uint8)
            parts = np.full((len(rows), width + 1), -1, np.int32)
            col = np.arange(width + 1)
            parts[col[None, :] < n[:, None]] = self.single[flat]
            ends = np.cumsum(n) - 1
            parts[np.arange(len(rows)), n - 1] = self.final[flat[ends]]
            ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(rows), width)
            live = np.arange(len(rows))
            p, r = parts, ranks
            while len(live):
                at = r.argmin(axis=1)
                each = np.arange(len(live))
                best = r[each, at]
                go = best != _NONE
                for k in np.flatnonzero(~go):
                    row = p[k]
                    out[rows[live[k]]] = row[: n[live[k]]].tobytes()
                live, p, r, at, best = live[go], p[go], r[go], at[go], best[go]
                if not len(live):
                    break
                each = np.arange(len(live))
                n[live] -= 1
                right = col[None, :] > at[:, None]
                step = np.minimum(col[None, :] + right, width)
                p = np.take_along_axis(p, step, axis=1)  # delete the boundary
                p[each, n[live]] = -1
                p[each, at] = self.merged[best]
                r = np.take_along_axis(r, np.minimum(step[:, :-1], width - 1), axis=1)
                r[each, np.maximum(n[live] - 1, 0)] = _NONE
                r[each, at] = self.rank(p[each, at], p[each, np.minimum(at + 1, width)])  # refresh its neighbours
                before = at > 0
                b = each[before]
                r[b, at[before] - 1] = self.rank(p[b, at[before] - 1], p[b, at[before]])
                shrink = int(n[live].max())
                if shrink + 1 < p.shape[1] * 3 // 4:
                    p, r, col, width = p[:, : shrink + 1], r[:, :shrink], col[: shrink + 1], shrink
        return out

    def _long(self, word: bytes) -> bytes:
        ids = [*self.single[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        n = len(ids)
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0:
                    q = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if q != _NONE:
                        heapq.heappush(heap, (q, x, ids[x], ids[y]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = nxt[i]
        return np.array(out, np.int32).tobytes()

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text as 32-bit integers; null counts as empty."""
        special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        pieces = []  # of each text: lists of words, and ids of special tokens
        for t in texts:
            if not t:
                pieces.append([])
            elif special is None or not any(s in t for s in self.special):
                pieces.append([_words(t)])
            else:
                pieces.append([np.int32(self.special[x]).tobytes() if x in self.special else _words(x) for x in special.split(t) if x])
        new = set().union(*[x for p in pieces for x in p if not isinstance(x, bytes)])
        missing = [w for w in new if w not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = list(new)
        raw = [w.encode("utf-8", "replace") for w in missing]
        short = [k for k, b in enumerate(raw) if len(b) <= SHORT]
        self.cache.update(zip([missing[k] for k in short], self._short([raw[k] for k in short]), strict=True))
        long = {missing[k]: self._long(b) for k, b in enumerate(raw) if len(b) > SHORT}  # not remembered, so that the cache's bytes are bounded too
        get = self.cache.__getitem__ if not long else lambda w: long[w] if w in long else self.cache[w]
        return [b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in p]) for p in pieces]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; null counts as empty."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between each two, as a vocabulary without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _words(text: str) -> list[str]:
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower case letter by letter: no final sigma
    return _SPLIT.findall(text.lower())


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pass(df: DataFrame, path: str, columns: list[str], new: str, text: str, work: Callable) -> DataFrame:
    have = df.select(*columns, F.col(text).alias("__in"))
    schema = grown(have, columns, new)
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path))  # as large as the vocabulary file

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = work(shared.value, batch.column("__in"))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made.values()], [*columns, *made])

    return arrow_pass(have, run, schema, "__in")


def round_trip(docs: DataFrame, path: str, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of docs, then ids (array<int>) and decoded (the ids turned back into a string).

    Null and empty texts have no ids and decode to the empty string; equal texts give equal rows.
    """

    def work(v: Vocabulary, column: pa.Array) -> dict[str, pa.Array]:
        ids = v.packed(column.to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), np.int32)
        return {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "decoded": pa.array([v.decode(np.frombuffer(x, np.int32).tolist()) for x in ids], pa.string())}

    return _pass(docs, path, columns, "ids array<int>, decoded string", text, work)
