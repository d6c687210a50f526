"""MinHash near-duplicates by a chosen-path set similarity join.

1. Every text becomes the set of its distinct word shingles (64-bit hashes).  Documents of equal sets form a class;
   one of its rows stands for it, with POOL minwise tokens for each tree.
2. In each of several trees, independent as each draws on its own tokens only, a class starts at the root; at a node, one of the tree's tokens
   is chosen by the node's hash - and with probability 1 / threshold - 1 a second one - and the class moves on
   to the child named by the node and its token there.  So the expected number of paths that two classes at the
   threshold share stays 1 at every depth, while unlike ones part.  Nodes of more than `leaf` classes
   branch on, level by level, up to `deepest`.
3. The classes of a node are compared exhaustively by all their minwise tokens.  Two whose share of equal tokens a pair at the
   threshold would fall under with a probability of RULED_OUT at most are candidates.  A node gives a spanning forest of its candidates,
   and only between classes that no forest of an earlier round connects.  Rows are narrow here: no texts.
4. What the forests connect is a candidate group.  Each class is in one group at most, so its text is joined once; within a group all
   pairs not yet linked are compared on full sets, again but for those that their tokens rule out.
5. Nodes and groups that are too large for a task are dealt out in slices: at first each slice with
   a few pivots, which connects a dense one in linear work; what is still apart after that
   is compared slice by slice, every slice of all but the largest component with every slice.
6. Connected components, in 3 and at the end, by forests of each part of the edges, then label propagation with pointer jumping.

Nothing is capped: large nodes and groups have the exact way of step 5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeframe.llm import kernel
from citeframe.llm.common import arrow_pass, frequent, give_back, hot_join, id_filter, prepare, settle, split_by, starts, whole_groups

SHINGLE = 5
#: Minwise tokens, 8 bits each, that one tree draws on and no other.
POOL = 12
#: So rarely two documents at the threshold may miss each other in all trees, where all their nodes branch to the deepest level.
MISS = 0.001
#: So rarely two documents at the threshold may be ruled out by their tokens.
RULED_OUT = 0.0001
#: A task compares two slices of about so many shingles (8 bytes each) each.
MOST_SHINGLES = 400_000
#: A task spans about so many edges, 16 bytes each.
SPAN_EDGES = 1 << 20
#: Each slice of a large node or group is compared with about so many of its members, the same for all slices, before all others.
PIVOTS = 16


def trees_for(threshold: float, depth: int, miss: float = MISS) -> int:
    """How many trees hold `miss` at this depth: two documents at the threshold are compared where a tree's branching process survives.

    How many of a tree's tokens agree is binomial; no tree's tokens are another's, so the trees' chances multiply.
    """
    extinct = 0.0
    for agree in range(POOL + 1):
        gone = 0.0
        for _ in range(depth):
            child = 1 - agree / POOL * (1 - gone)
            gone = child * (1 - (1 / threshold - 1) * (1 - child))
        extinct += math.comb(POOL, agree) * threshold**agree * (1 - threshold) ** (POOL - agree) * gone
    return max(1, math.ceil(math.log(miss) / math.log(extinct))) if extinct > 0 else 1


def least_equal(threshold: float, tokens: int, miss: float = RULED_OUT) -> int:
    """The number of equal tokens that two documents at the threshold stay under with a probability of `miss` at most."""
    below, at = 0.0, 0
    while True:
        below += math.comb(tokens, at) * threshold**at * (1 - threshold) ** (tokens - at)
        if below > miss:
            return at
        at += 1


def _tokens(value: np.ndarray, ptr: np.ndarray, size: int) -> np.ndarray:
    """`size` minwise tokens of each set, from as many orders of its values; 0 for the empty set."""
    odd = np.random.default_rng(31).integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    sig = np.zeros((size, len(ptr) - 1), np.uint8)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        base = (kernel.mix(value, 6) >> np.uint64(32)).astype(np.uint32)
        x = np.empty_like(base)
        for j, a in enumerate(odd):
            np.multiply(base, a, out=x)
            sig[j, full] = (np.minimum.reduceat(x, ptr[full]) >> np.uint32(8)).astype(np.uint8)
    return np.ascontiguousarray(sig.T)


def shingles(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, with the documents' bounds."""
    w = kernel.words(data, bounds, kernel.SPACED)
    g, valid = kernel.grams(w.hash, w.ptr, k)
    doc = w.doc()
    n = np.diff(w.ptr)
    value, of = g[valid], doc[: len(g)][valid]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):  # the whole sequence is the one shingle
        value = np.concatenate([value, np.array([kernel.sequence(w.hash[w.ptr[d] : w.ptr[d + 1]]) for d in few], np.uint64)])
        of = np.concatenate([of, few])
    order = np.argsort(value)
    order = order[np.argsort(of[order], kind="stable")]
    value, of = value[order], of[order]
    if len(value):
        keep = np.concatenate([[True], (value[1:] != value[:-1]) | (of[1:] != of[:-1])])
        value, of = value[keep], of[keep]
    return value, np.searchsorted(of, np.arange(len(bounds)))


def describe(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """doc_id and row of docs, n (set size), s1 and s2 (128 bits that name the set), sig (each tree's minwise tokens)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        value, ptr = shingles(*kernel.buffers(batch.column("text")), k)
        n = np.diff(ptr)
        s1 = kernel.by_doc(kernel.mix(value, 1), ptr).view(np.int64)
        s2 = kernel.by_doc(kernel.mix(value, 2), ptr).view(np.int64)
        sig = _tokens(value, ptr, trees * POOL)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(s1), pa.array(s2), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "row", "n", "s1", "s2", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_pass(docs.select("doc_id", "row", "text"), work, f"doc_id {kind}, row bigint, n bigint, s1 bigint, s2 bigint, sig binary")


def _signatures(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def _descend(key: np.ndarray, tree: np.ndarray, sig: np.ndarray, row: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level down: (keys, trees, rows) of the children that the rows at the nodes `key` of `tree` choose."""
    r1, r2 = kernel.mix(key, 3), kernel.mix(key, 4)
    first = (r1 % np.uint64(POOL)).astype(np.int64)
    second = ((first + 1 + ((r2 >> np.uint64(40)) % np.uint64(POOL - 1)).astype(np.int64)) % POOL).astype(np.int64)
    also = (r2 & np.uint64(0xFFFFFF)) < np.uint64(int((1 / threshold - 1) * (1 << 24)))
    child = lambda k, t, r, c: kernel.mix(k * np.uint64(0x9E3779B97F4A7C15) + (c.astype(np.uint64) << np.uint64(32)) + sig[r, t * POOL + c], 5)
    return np.concatenate([child(key, tree, row, first), child(key[also], tree[also], row[also], second[also])]), np.concatenate([tree, tree[also]]), np.concatenate([row, row[also]])


_PATH = "tree int, node bigint, rid bigint"


def _told(of: np.ndarray, key: np.ndarray, rid: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(key.view(np.int64)), rid], ["tree", "node", "rid"])


def paths(classes: DataFrame, trees: range, depth: int, threshold: float) -> DataFrame:
    """(tree, node, rid) for the nodes at `depth` of each tree that the classes (rid, sig) reach."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                sig = _signatures(part.column("sig"))
                for tree in trees:
                    row = np.arange(len(sig))
                    key = np.full(len(sig), tree + 1, np.uint64)
                    of = np.full(len(sig), tree, np.int64)
                    for _ in range(depth):
                        key, of, row = _descend(key, of, sig, row, threshold)
                    yield _told(of, key, part.column("rid").take(pa.array(row)))

    return classes.select("rid", "sig").mapInArrow(run, _PATH)


def deeper(members: DataFrame, classes: DataFrame, threshold: float, levels: int) -> DataFrame:
    """Let the members (tree, node, rid) of some nodes branch on by `levels`."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                sig = _signatures(part.column("sig"))
                key, row = part.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.arange(len(sig))
                of = part.column("tree").to_numpy(zero_copy_only=False).astype(np.int64)
                for _ in range(levels):
                    key, of, row = _descend(key, of, sig, row, threshold)
                yield _told(of, key, part.column("rid").take(pa.array(row)))

    return members.join(classes.select("rid", "sig"), "rid").select("tree", "node", "rid", "sig").mapInArrow(run, _PATH)


def _forest(rid: np.ndarray, comp: np.ndarray, side: np.ndarray, sig: np.ndarray, least: int, confirm=None) -> list[tuple]:
    """A spanning forest of the pairs of one block that have `least` equal tokens, and that confirm(row, others) holds true, among
    rows that `comp` doesn't connect yet.  side 0 is compared with all, side 1 with side 0 only."""
    label = np.unique(comp, return_inverse=True)[1]
    done = np.zeros(len(rid), bool)
    out = []
    for p in np.lexsort((rid, side)):
        if side[p]:
            break
        done[p] = True
        others = np.flatnonzero(~done & (label != label[p]))
        if len(others):
            others = others[(sig[others] == sig[p]).sum(axis=1) >= least]
        if len(others) and confirm is not None:
            others = others[confirm(p, others)]
        for q in others:
            if label[q] != label[p]:
                out.append((rid[p], rid[q]))
                label[label == label[q]] = label[p]
    return out


def candidates(blocks: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Stars (a, b) that connect the candidates within blocks (block, rid, comp, side)."""

    def run(batches):
        yield from _spanning(found(batches))

    def found(batches):
        for got in whole_groups(batches, "block"):
            at = np.append(starts(got.column("block")), got.num_rows)
            rid, comp, side = (got.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "comp", "side"))
            sig = _signatures(got.column("sig"))
            size = np.diff(at)
            head = np.repeat(at[:-1], size)  # each block's first row with all others, of all blocks at once
            near = ((sig == sig[head]).sum(axis=1) >= least) & ((side == 0) | (side[head] == 0))
            apart = near & (comp != comp[head])
            a, b = [rid[head[apart]]], [rid[apart]]
            comp = np.where(near, comp[head], comp)
            open_ = np.flatnonzero(np.add.reduceat(~near, at[:-1]) > 0)
            for g in open_[size[open_] > 2]:
                cut = slice(at[g], at[g + 1])
                more = _forest(rid[cut], comp[cut], side[cut], sig[cut], least)
                if more:
                    x, y = zip(*more, strict=True)
                    a.append(np.array(x))
                    b.append(np.array(y))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    have = blocks.join(classes.select("rid", "sig"), "rid").select("block", "rid", "comp", "side", "sig")
    return have.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def confirmed(blocks: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Stars (a, b) that connect the links on full sets within blocks (block, rid, comp, side); texts: rid, text.  Only texts that a block needs are shuffled."""
    blocks = settle(blocks)
    texts = split_by(texts, F.col("rid"), id_filter(blocks.select("rid").distinct(), "rid")).filter("__maybe").groupBy("rid").agg(F.first("text").alias("text"))

    def run(batches):
        yield from _spanning(linked(batches))
        give_back()

    def linked(batches):
        for got in whole_groups(batches, "block", "text"):
            at = np.append(starts(got.column("block")), got.num_rows)
            rid, comp, side = (got.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "comp", "side"))
            sig = _signatures(got.column("sig"))
            value, ptr = shingles(*kernel.buffers(got.column("text")), k)
            a, b = [], []
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                for x, y in _linked(rid[lo:hi], comp[lo:hi], side[lo:hi], sig[lo:hi], value[ptr[lo] : ptr[hi]], ptr[lo : hi + 1] - ptr[lo], percent, least):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    have = blocks.join(classes.select("rid", "sig"), "rid").join(texts, "rid").select("block", "rid", "comp", "side", "sig", "text")
    return have.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def _linked(rid, comp, side, sig, value, ptr, percent, least) -> list[tuple]:
    """The forest of links of one block, whose rows have the sets value[ptr[i]:ptr[i + 1]]."""
    size = np.diff(ptr)
    state: dict = {}

    def confirm(p: int, others: np.ndarray) -> np.ndarray:
        others_n = size[others]
        able = 100 * np.minimum(others_n, size[p]) >= percent * np.maximum(others_n, size[p])
        if not able.any():
            return able
        if "code" not in state:
            universe, state["code"] = np.unique(value, return_inverse=True)
            state["mark"] = np.zeros(len(universe), bool)
        code, mark = state["code"], state["mark"]
        mark[code[ptr[p] : ptr[p + 1]]] = True
        n = others_n[able]
        at = np.repeat(ptr[others[able]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inter = np.add.reduceat(mark[code[at]], np.cumsum(n) - n, dtype=np.int64)
        mark[code[ptr[p] : ptr[p + 1]]] = False
        able[able] = 100 * inter >= percent * (n + size[p] - inter)
        return able

    return _forest(rid, comp, side, sig, least, confirm)


def _spanning(batches: Iterator[pa.RecordBatch], both: bool = False) -> Iterator[pa.RecordBatch]:
    """The edges of some batches at a time as stars around the smallest id of each component; with `both`, each edge both ways."""

    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("a", "b"))
        ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = code[: len(a)], code[len(a) :]
        label = np.arange(len(ids))
        while True:
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            np.minimum.at(new, label[x], label[y])  # the roots follow
            np.minimum.at(new, label[y], label[x])
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = label != np.arange(len(ids))
        hub, ray = ids[label[far]], ids[far]
        if both:
            hub, ray = np.concatenate([hub, ray]), np.concatenate([ray, hub])
        return pa.RecordBatch.from_arrays([pa.array(hub), pa.array(ray)], ["a", "b"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(p.num_rows for p in kept) > SPAN_EDGES:
            yield stars(kept)
            kept = []
    if any(p.num_rows for p in kept):
        yield stars(kept)


def components(edges: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(rid, comp): the smallest id reachable over the edges (a, b), which are computed once, and over what `before` (rid, comp) connects."""
    stars = settle(edges.select("a", "b"))
    n = stars.count()
    if before is not None:
        old = before.filter(F.col("rid") != F.col("comp")).select(F.col("comp").alias("a"), F.col("rid").alias("b"))
        stars, n = stars.unionByName(old), n + old.count()
    # parts of SPAN_EDGES: the fewer parts, the fewer steps of propagation are left
    spanned = stars.coalesce(max(1, -(-n // SPAN_EDGES))).mapInArrow(partial(_spanning, both=True), "a bigint, b bigint")
    both = settle(spanned.distinct())
    label = both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.col("a")).alias("comp"))
    hubs = frequent(both.groupBy("b").agg(F.count("*").alias("c")), ["b"], both.count())
    while True:
        near = hot_join(both, label.select(F.col("rid").alias("b"), F.col("comp").alias("there")), ["b"], hubs).groupBy(F.col("a").alias("rid")).agg(F.min("there").alias("there"))
        hop = label.join(near, "rid", "left").select("rid", F.col("comp").alias("old"), F.least("comp", "there").alias("comp"))
        up = label.select(F.col("rid").alias("comp"), F.col("comp").alias("top"))
        new = settle(hop.join(up, "comp", "left").select("rid", "old", F.least("comp", "top").alias("comp")))
        changed = new.filter(F.col("old") != F.col("comp")).limit(1).count()
        label = new.select("rid", "comp")
        if not changed:
            return label


def _alive(nodes: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members (node, rid, w, comp, c) of the nodes that hold more than one component; c is the sum of w."""
    if comp is None:
        nodes = nodes.select("node", "rid", "w").withColumn("comp", F.col("rid"))
    else:
        nodes = nodes.select("node", "rid", "w").join(comp, "rid", "left").select("node", "rid", "w", F.coalesce("comp", "rid").alias("comp"))
    each = nodes.groupBy("node").agg(F.sum("w").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return nodes.join(each.filter(F.col("lo") != F.col("hi")).drop("lo", "hi"), "node")


def _slot(of: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(of), F.lit(77)), parts)


def _star(alive: DataFrame, most: int) -> DataFrame:
    """Blocks of whole small nodes, and slices of large ones with the same pivots in each: some PIVOTS members, of a quarter of a slice at most."""
    parts = F.ceil(F.col("c") / most)
    rows = alive.withColumn("block", F.xxhash64("node", _slot("rid", parts)))
    chance = F.least(F.lit(PIVOTS), F.lit(most) / 4 / F.col("w")) * F.col("w") / F.col("c")
    large = alive.filter((F.col("c") > most) & (F.pmod(F.xxhash64("rid", F.lit(99)), F.lit(1 << 30)) < chance * (1 << 30)))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda s: s != _slot("rid", parts))
    pivots = large.withColumn("s", F.explode(others)).withColumn("block", F.xxhash64("node", F.col("s")))
    return rows.select("block", "rid", "comp", F.lit(0).alias("side")).unionByName(pivots.select("block", "rid", "comp", F.lit(0).alias("side")))


def _exact(alive: DataFrame, most: int) -> DataFrame:
    """Blocks that hold, between them, every pair of a node that isn't connected: slices of all but the largest component, with all slices."""
    each = alive.groupBy("node", "comp").agg(F.sum("w").alias("k"))
    heavy = each.groupBy("node").agg(F.max_by("comp", F.struct("k", "comp")).alias("heavy"), F.max("k").alias("k_heavy"))
    rows = alive.join(heavy, "node").withColumn("main", F.col("comp") == F.col("heavy"))
    rest = F.greatest(F.lit(1), F.ceil((F.col("c") - F.col("k_heavy")) / most)).cast("bigint")
    main = F.greatest(F.lit(1), F.ceil(F.col("k_heavy") / most)).cast("bigint")
    rows = rows.withColumn("slot", F.when(F.col("main"), -1 - _slot("rid", main)).otherwise(_slot("rid", rest)))
    zero = F.lit(0).cast("bigint")
    first = rows.filter(~F.col("main")).withColumn("t", F.explode(F.concat(F.sequence(F.col("slot"), rest - 1), F.sequence(-main, F.lit(-1).cast("bigint")))))
    first = first.select(F.xxhash64("node", "slot", "t").alias("block"), "rid", "comp", F.lit(0).alias("side"))
    second = rows.withColumn("i", F.explode(F.when(F.col("main"), F.sequence(zero, rest - 1)).when(F.col("slot") > 0, F.sequence(zero, F.col("slot") - 1))))
    second = second.select(F.xxhash64("node", "i", "slot").alias("block"), "rid", "comp", F.lit(1).alias("side"))
    return first.unionByName(second)


def candidate_groups(classes: DataFrame, percent: int, depth: int, leaf: int, deepest: int, rounds: tuple[int, ...]) -> DataFrame:
    """(rid, comp): what the candidates of all trees connect; only classes (rid, sig) that have one."""
    threshold = percent / 100
    least = least_equal(threshold, sum(rounds) * POOL)
    several = lambda df: df.groupBy("node").agg(F.count("*").alias("c"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter(F.col("lo") != F.col("hi")).select("node", "c")
    nodes = paths(classes, range(sum(rounds)), depth, threshold)
    nodes = settle(nodes.join(several(nodes), "node"))
    for _ in range(depth, deepest, 4):
        big = nodes.filter(F.col("c") > leaf)
        if big.limit(1).count() == 0:
            break
        below = deeper(big.select("tree", "node", "rid"), classes, threshold, 4)
        nodes = settle(nodes.filter(F.col("c") <= leaf).unionByName(below.join(several(below), "node")))
    nodes = nodes.withColumn("w", F.lit(1).cast("bigint"))
    comp: DataFrame | None = None
    at = 0
    for trees in rounds:
        now = nodes.filter((F.col("tree") >= at) & (F.col("tree") < at + trees))
        at += trees
        comp = components(candidates(_star(_alive(now, comp), leaf), classes, least), comp)
        large = now.filter(F.col("c") > leaf)
        if large.limit(1).count() and (large := settle(_alive(large, comp))).limit(1).count():
            comp = components(candidates(_exact(large, leaf), classes, least), comp)
    return comp


def cluster(docs: DataFrame, *, k: int = SHINGLE, percent: int = 85, depth: int = 4, leaf: int = 2000, deepest: int = 12, rounds: tuple[int, ...] | None = None, most: int = MOST_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null, empty and wordless texts have an empty set, which is linked with nothing.  Equal rows get equal results;
    rows that repeat a doc_id with another text follow their own text.  A row without doc_id takes the smallest id
    of its copies and their links, or null, and is kept only if there is none.
    docs is read twice, so it should be a stored table.  `rounds` gives how many trees each round adds; by default two and then the others of so many
    that two documents at the threshold miss each other in all of them with a probability of at most MISS, be their nodes as deep as `deepest`.
    `leaf` is the number of classes, and `most` the number of shingles, of a slice that one task compares.
    """
    prepare(docs.sparkSession)
    threshold = percent / 100
    if rounds is None:
        rounds = (2, max(1, trees_for(threshold, max(depth, deepest)) - 2))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = settle(describe(keyed, k, sum(rounds)))
    classes = settle(rows.filter(F.col("n") > 0).groupBy("n", "s1", "s2").agg(F.min("row").alias("rid"), F.min("doc_id").alias("first"), F.first("sig").alias("sig"), F.count("*").alias("c")))
    group = candidate_groups(classes, percent, depth, leaf, deepest, rounds)
    members = settle(group.join(classes.select("rid", F.col("n").alias("w")), "rid").select(F.col("comp").alias("node"), "rid", "w"))
    texts = keyed.select(F.col("row").alias("rid"), "text")
    least = least_equal(threshold, sum(rounds) * POOL)
    alive = _alive(members, None)
    comp = components(confirmed(_star(alive, most), classes, texts, k, percent, least))
    large = alive.filter(F.col("c") > most).select("node", "rid", "w")
    if large.limit(1).count() and (large := settle(_alive(settle(large), comp))).limit(1).count():
        comp = components(confirmed(_exact(large, most), classes, texts, k, percent, least), comp)
    linked = classes.join(comp, "rid").select("n", "s1", "s2", "comp", "first")
    linked = linked.join(linked.groupBy("comp").agg(F.min("first").alias("together")), "comp").select("n", "s1", "s2", "together")
    own = settle(classes.select("n", "s1", "s2", "first", "c").join(linked, ["n", "s1", "s2"], "left").select("n", "s1", "s2", "c", F.coalesce("together", "first").alias("component_id")))
    key = ["n", "s1", "s2"]
    of = hot_join(rows.select("doc_id", *key), own.drop("c"), key, frequent(own, key, rows.count()))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return of.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
