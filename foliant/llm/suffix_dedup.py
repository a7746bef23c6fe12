"""Removing repeated passages: every byte of a string of `length` bytes that also starts earlier.

1. Each document is cut into runs of consecutive window starts whose least hashed
   k-gram (minimizer, the leftmost of equal ones) is the same; no window occurs
   twice in a run. Equal windows have equal minimizers, so only
   runs of one minimizer can share a window, and a minimizer met once is done.
2. Of runs with equal content all but the first are repeats as a whole. A task
   settles those among its own rows before anything is shuffled, so a passage
   found in a third of all documents sends one row from each task.
3. First runs that share a minimizer but not their content meet with their bytes.
   Their suffixes are sorted deep-shallow: multikey quicksort over eight-byte
   characters to a shallow depth, then blind tries for the groups that still
   share a prefix. Equal suffixes, cut at `length`, repeat the first of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

LENGTH = 100
GRAM = 32
#: Bytes that the multikey quicksort looks at; longer common prefixes go to tries.
SHALLOW = 32
#: More than the window starts of a run, which has its minimizer in each; start and count share a LONG.
RUN_CAP = 4095
#: Runs that a task gathers before it settles repeats among them.
GATHER = 1_000_000
#: Suffixes sorted at once.
SORT_AT_ONCE = 400_000

_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of `gram` (a power of two) bytes, by doubling."""
    with np.errstate(over="ignore"):
        h, base, m = (data.astype(np.uint64) + np.uint64(1)) * _SCRAMBLE, np.uint64(0xD6E8FEB86659FD93), 1
        while m < gram:
            h = h[:-m] * base + h[m:]
            base, m = base * base, m * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def minimizer_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, start, count) of the runs of window starts of data; none if it is shorter than a window."""
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = h = gram_hashes(data, gram)
    width, m = length - gram + 1, 1
    while m * 2 <= width:
        h, m = np.minimum(h[:-m], h[m:]), m * 2
    if m < width:
        h = np.minimum(h[: len(h) - (width - m)], h[width - m :])
    # the leftmost minimum moves if a lesser one enters, or if it was the gram that leaves
    moves = (h[1:] != h[:-1]) | (grams[: len(h) - 1] == h[:-1])
    edge = np.concatenate(([0], np.flatnonzero(moves) + 1, [len(h)]))
    sizes = np.diff(edge)
    return h[edge[:-1]], edge[:-1], sizes


def merged(d: np.ndarray, t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of (doc_id, tie, place) with those that follow one another joined, as far as a place can hold."""
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order]
    s, n = p // (RUN_CAP + 1), p % (RUN_CAP + 1)
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1] + n[:-1])
    heads = np.flatnonzero(new)
    piece = (s - s[heads][np.cumsum(new) - 1]) // (RUN_CAP // 2) if len(s) else s
    new[1:] |= piece[1:] != piece[:-1]
    heads = np.flatnonzero(new)
    return d[heads], t[heads], s[heads] * (RUN_CAP + 1) + (np.add.reduceat(n, heads) if len(heads) else n)


RUNS = "m long, h long, doc_id long, tie long, place long, whole boolean"


def _cut_documents(length: int):
    """Arrow kernel (doc_id, tie, text) -> runs; repeats among a task's own runs come out as whole."""
    from xxhash import xxh3_64_intdigest

    def settle(held):
        m, h, d, t, p = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((p, t, d, h, m))
        m, h, d, t, p = (x[order] for x in (m, h, d, t, p))
        again = np.zeros(len(m), dtype=bool)
        again[1:] = (m[1:] == m[:-1]) & (h[1:] == h[:-1])
        first = ~again
        yield from _batches(m[first], h[first], d[first], t[first], p[first], np.zeros(first.sum(), dtype=bool))
        d, t, p = merged(d[again], t[again], p[again])
        with np.errstate(over="ignore"):  # any key does for these; this one spreads them
            m = (d + p) * _SCRAMBLE.astype(np.int64)
        yield from _batches(m, np.zeros(len(m), np.int64), d, t, p, np.ones(len(m), dtype=bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                m, s, c = minimizer_runs(np.frombuffer(raw, np.uint8), length)
                h = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(s.tolist(), (s + c + (length - 1)).tolist())), np.uint64, len(s))
                held.append((m.view(np.int64), h.view(np.int64), np.full(len(s), doc_id), np.full(len(s), tie), s * (RUN_CAP + 1) + c))
                n += len(s)
                if n >= GATHER:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _batches(*cols, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(cols[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=["m", "h", "doc_id", "tie", "place", "whole"])


def _settle_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel over runs sorted by (m, h, position): repeats as whole, first runs of contested minimizers as not.

    Of a minimizer's first runs only the latest is held until another shows up.
    """
    last, pending = None, None
    for batch in batches:
        m, h, d, t, p, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        yield from _batches(*(x[w] for x in (m, h, d, t, p, w)))
        m, h, d, t, p = (x[~w] for x in (m, h, d, t, p))
        if not len(m):
            continue
        first = np.ones(len(m), dtype=bool)
        first[1:] = (m[1:] != m[:-1]) | (h[1:] != h[:-1])
        if last is not None and last == (m[0], h[0]):
            first[0] = False
        last = (m[-1], h[-1])
        yield from _batches(*(x[~first] for x in (m, h, d, t, p)), np.ones((~first).sum(), dtype=bool))
        m, h, d, t, p = (x[first] for x in (m, h, d, t, p))
        if not len(m):
            continue
        lone = True
        if pending is not None:
            m, h, d, t, p = (np.concatenate(([a], x)) for a, x in zip(pending[0], (m, h, d, t, p)))
            lone = pending[1]
        same = m[1:] == m[:-1]
        shared = np.zeros(len(m), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        if pending is not None and not lone:
            shared[0] = False  # it went out with its minimizer's earlier ones
        final = shared[-1] or (len(m) == 1 and not lone)
        yield from _batches(*(x[shared] for x in (m, h, d, t, p)), np.zeros(shared.sum(), dtype=bool))
        pending = (tuple(x[-1] for x in (m, h, d, t, p)), not final)


class BlindTrie:
    """Strings of equal length by position and value of the bytes that tell them apart.

    To add a string, go down by the bytes at the nodes' positions without looking at
    what lies between, compare with any string found there, and branch where they
    first differ.
    """

    def __init__(self):
        self.root = None  # a leaf (string, members) or a node [position, {byte: child}]

    def add(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = (string, [member])
            return
        node = self.root
        while type(node) is list:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        found = node[0]
        if found == string:
            node[1].append(member)
            return
        x = int.from_bytes(found, "big") ^ int.from_bytes(string, "big")
        at = len(string) - (x.bit_length() + 7) // 8
        parent, node = None, self.root
        while type(node) is list and node[0] < at:
            parent, node = node, node[1][string[node[0]]]
        leaf = (string, [member])
        if type(node) is list and node[0] == at:
            node[1][string[at]] = leaf
            return
        new = [at, {found[at]: node, string[at]: leaf}]
        if parent is None:
            self.root = new
        else:
            parent[1][string[parent[0]]] = new

    def leaves(self) -> Iterator[list[int]]:
        """Members of each leaf, in the order of their strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def _words(buf: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one number; the largest first byte weighs most."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    out = np.zeros(len(buf), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(buf)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def repeated_suffixes(buf: np.ndarray, ptr: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Whether each suffix buf[ptr : ptr + length] equals an earlier one of its group; group is ascending."""
    repeat = np.zeros(len(ptr), dtype=bool)
    words = _words(buf)
    ids = np.arange(len(ptr))
    seg = np.concatenate(([0], np.cumsum(group[1:] != group[:-1])))
    depth = np.zeros(int(seg[-1]) + 1 if len(seg) else 0, dtype=np.int64)
    deep: list[tuple[np.ndarray, np.ndarray]] = []  # members and sizes of groups
    while len(ids):
        sizes = np.bincount(seg, minlength=len(depth))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        # settle what is alone or has reached the shallow depth
        done = (sizes == 1) | (depth >= shallow)
        if done.any():
            shared = done & (sizes > 1)
            deep.append((ids[shared[seg]], sizes[shared]))
            keep = ~done[seg]
            ids, seg = ids[keep], (np.cumsum(~done) - 1)[seg[keep]]
            depth = depth[~done]
            if not len(ids):
                break
            sizes = np.bincount(seg, minlength=len(depth))
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        key = words[ptr[ids] + depth[seg]]
        a, b, c = key[starts], key[starts + sizes // 2], key[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        # a stable three-way partition of every segment at once
        counts = np.bincount(seg * 3 + side, minlength=3 * len(depth))
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        place = np.empty(len(ids), dtype=np.int64)
        for k in range(3):
            of = side == k
            n = np.cumsum(of)
            before = n[starts] - of[starts]
            place[of] = begin[seg[of] * 3 + k] + (n[of] - 1 - before[seg[of]])
        moved = np.empty_like(ids)
        moved[place] = ids
        ids = moved
        live = counts > 0
        seg = np.repeat(np.arange(live.sum()), counts[live])
        depth = (np.repeat(depth, 3) + np.tile([0, 8, 0], len(depth)))[live]
    _order_deep(deep, buf, ptr, words, length, shallow, repeat)
    return repeat


def _order_deep(deep: list[tuple[np.ndarray, np.ndarray]], buf: np.ndarray, ptr: np.ndarray, words: np.ndarray, length: int, shallow: int, repeat: np.ndarray) -> None:
    """Blind tries for groups that share a shallow prefix. What equals its group's first string goes to that leaf at once."""
    if not deep:
        return
    ids, sizes = (np.concatenate(x) for x in zip(*deep))
    if not len(ids):
        return
    head = np.repeat(ids[np.concatenate(([0], np.cumsum(sizes)[:-1]))], sizes)
    same = np.ones(len(ids), dtype=bool)
    steps = [*range(shallow // 8 * 8, length - 7, 8), length - 8]
    for d in steps:
        same &= words[ptr[ids] + d] == words[ptr[head] + d]
    repeat[ids[same & (ids != head)]] = True
    group = np.repeat(np.arange(len(sizes)), sizes)
    rest, of = ids[~same], group[~same]
    raw = buf.tobytes()
    edge = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])) if len(of) else [0]
    for i, j in zip(edge[:-1], edge[1:]):
        if j - i == 1:
            continue
        trie = BlindTrie()
        for x in rest[i:j].tolist():
            trie.add(raw[ptr[x] + shallow : ptr[x] + length], x)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                repeat[leaf[1:]] = True


def _sort_contested(length: int):
    """Arrow kernel over (m, doc_id, tie, place, bytes) sorted by (m, position): repeated windows as runs."""

    def solve(held):
        m, d, t, p, raws = held
        start, count = p // (RUN_CAP + 1), p % (RUN_CAP + 1)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        buf = np.frombuffer(b"".join(raws), np.uint8)
        total = np.concatenate(([0], np.cumsum(count)))
        owner = np.repeat(np.arange(len(count)), count)
        at = np.arange(total[-1]) - total[owner]
        again = repeated_suffixes(buf, base[owner] + at, m[owner], length)
        edge = again.copy()
        edge[1:] &= ~(again[:-1] & (owner[1:] == owner[:-1]))
        first = np.flatnonzero(edge)
        if not len(first):
            return None
        n = np.diff(np.concatenate(([0], np.cumsum(again)))[np.concatenate((first, [len(again)]))])
        o = owner[first]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[o], t[o], (start[o] + at[first]) * (RUN_CAP + 1) + n)], names=["doc_id", "tie", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]] + [batch.column(4).to_pylist()]
            held = new if held is None else [*(np.concatenate((a, b)) for a, b in zip(held[:4], new[:4])), held[4] + new[4]]
            windows += int((new[3] % (RUN_CAP + 1)).sum())
            while windows >= SORT_AT_ONCE and held[0][0] != held[0][-1]:
                # whole minimizers only; the last one may go on in the next batch
                upto = np.cumsum(held[3] % (RUN_CAP + 1))
                bounds = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
                k = bounds[min(np.searchsorted(upto[bounds - 1], SORT_AT_ONCE), len(bounds) - 1)]
                out = solve([*(x[:k] for x in held[:4]), held[4][:k]])
                held = [*(x[k:] for x in held[:4]), held[4][k:]]
                windows -= int(upto[k - 1])
                if out:
                    yield out
        if held is not None and len(held[0]):
            out = solve(held)
            if out:
                yield out

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text): a null doc_id comes before all others, and texts that share a doc_id differ by tie."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if twice.isEmpty():
        return ids.select("doc_id", F.lit(0).cast("long").alias("tie"), "text")
    return ids.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tie, place): runs of window starts in keyed docs that repeat; place = start * 4096 + count."""
    ship(docs.sparkSession)
    cut = docs.mapInArrow(_cut_documents(length), RUNS)
    dealt = cut.repartition("m").sortWithinPartitions("m", "h", "doc_id", "tie", "place")
    found = materialise(dealt.mapInArrow(_settle_sorted, RUNS).select("m", "doc_id", "tie", "place", "whole"), "runs")
    wanted = found.where("not whole").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("m", "place")).alias("runs"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, tie, text, runs in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    s, n = divmod(r["place"], RUN_CAP + 1)
                    out.append((r["m"], doc_id, tie, r["place"], raw[s : s + n + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(),) * 4 + (pa.binary(),))], names=["m", "doc_id", "tie", "place", "raw"])

    fetched = docs.join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "text", "runs").mapInArrow(fetch, "m long, doc_id long, tie long, place long, raw binary")

    sorted_runs = fetched.repartition("m").sortWithinPartitions("m", "doc_id", "tie", "place")
    inside = sorted_runs.mapInArrow(_sort_contested(length), "doc_id long, tie long, place long")
    return found.where("whole").select("doc_id", "tie", "place").unionByName(inside)


def spans_of(places: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes [start, end) that the windows at places cover."""
    out: list[list[int]] = []
    for start, end in sorted((p // (RUN_CAP + 1), p // (RUN_CAP + 1) + p % (RUN_CAP + 1) + length - 1) for p in places):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


DEDUPED = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: byte runs [start, end) that go, and the bytes left, joined.

    A byte goes if some string of `length` bytes over it also starts earlier: in a
    smaller doc_id, or in the same document before. Matches are judged on the input
    and never cross documents. Null text is empty; null doc_ids come before all
    others and stay null. Different texts under one doc_id are ordered by a hash of
    theirs; rows equal in both are one document and show the same result. What is
    left need not be valid UTF-8, so it comes as binary. No rows in, no rows out.
    """
    ship(docs.sparkSession)
    base = keyed(docs)
    runs = repeated_runs(base, length).groupBy("doc_id", "tie").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for doc_id, text, places in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                    raw = text.encode("utf-8", "surrogatepass")
                    spans = spans_of(places or [], length)
                    edges = [0, *(x for s in spans for x in s), len(raw)]
                    kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
                    rows.append((None if doc_id == -(1 << 63) else doc_id, len(raw), [{"start": s, "end": e} for s, e in spans], kept))
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), spans_type, pa.binary()))], names=["doc_id", "n_bytes", "spans", "kept"])

    return base.join(runs, ["doc_id", "tie"], "left").select("doc_id", "text", "places").mapInArrow(run, DEDUPED)
