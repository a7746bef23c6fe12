"""SimHash near-duplicate detection with pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints at no more than `radius` differing
bits agree on at least `blocks - radius` of their blocks, so each is filed once
for each choice of that many blocks and only fingerprints filed together are
compared. What a bucket yields is a spanning forest of its links instead of all
pairs: as many edges as members at most, with the same connected components.

The keep-one stage links by the similarity of shingle sets itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, ship
from .components import connected_components, linked_groups

SEED = 42
#: Shingles counted at a time, to bound memory for very long texts.
CHUNK = 1 << 16
#: Buckets with more members than this are dealt to several tasks.
HOT_BUCKET = 20_000
#: Fingerprints to a key, on average, from which more blocks are used.
CROWD, CROWD_WIDE = 8, 2048
#: Jaccard similarity of shingle sets from which the keep-one stage takes texts for near duplicates.
SIMILARITY = 0.8
#: Shingles by which the stage files a text, and bits in which near duplicates may differ there; unrelated texts differ in 32 on average.
STAGE_KEYS, STAGE_RADIUS = 16, 22


def fingerprint(text: str | None, width: int) -> int:
    """Unsigned 64-bit SimHash of text's word shingles.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text
    of fewer words than width is one shingle, and one without words, or null, has
    fingerprint 0. Repeated shingles count as often as they occur.
    """
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes, n = xxh64_digest(joined, SEED), 1
        return int.from_bytes(hashes, "big")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, CHUNK):
        j = min(n, i + CHUNK)
        hashes = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts[i:j].tolist(), (ends[i + width - 1 : j + width - 1] - 1).tolist())])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed LONG, one row per row of docs.

    Null and empty texts have fingerprint 0; other columns of docs are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in (x.as_py() for x in batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks - radius blocks."""
    sizes = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    at = np.concatenate(([0], np.cumsum(sizes))).tolist()
    parts = [((1 << sizes[i]) - 1) << at[i] for i in range(blocks)]
    masks = [sum(x) for x in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def choose_blocks(n: int, radius: int) -> int:
    """The fewest blocks with no more than CROWD of n fingerprints to a key, on average.

    A radius over 4 takes many blocks, and so many more filings for each one added
    that larger buckets cost less.
    """
    crowd = CROWD if radius <= 4 else CROWD_WIDE
    return next((b for b in range(radius + 1, radius + 5) if n <= crowd * 2 ** (64 * (b - radius) // b)), radius + 4)


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fps at radius bits or fewer."""
    if fps.size <= 256:  # most buckets hold no link; one look at all pairs tells
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        if near.sum() == fps.size:
            return []
        fps = fps[near.sum(axis=1) > 1]
    edges, rest = [], fps
    while rest.size:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            p = queue.pop()
            near = np.bitwise_count(rest ^ p) <= radius
            if near.any():
                found = rest[near]
                edges += [(p, q) for q in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _bucket_edges(radius: int):
    """Arrow kernel over rows (bucket columns..., fp) sorted by bucket: the forest of each bucket."""

    def groups(batches):
        """Whole buckets: arrays of fps and of the buckets' bounds in them."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate((a, b)) for a, b in zip(held, cols)]
            new = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:-1]:
                new[1:] |= c[1:] != c[:-1]
            bounds = np.concatenate(([0], np.flatnonzero(new)))
            last = bounds[-1]
            held = [c[last:].copy() for c in cols]
            if len(bounds) > 1:
                yield cols[-1][:last].view(np.uint64), bounds
        if held is not None:
            yield held[-1].view(np.uint64), np.array([0, len(held[-1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, bounds in groups(batches):
            sizes = np.diff(bounds)
            a, b = [], []
            two = bounds[:-1][sizes == 2]
            near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius
            a.append(fps[two][near]), b.append(fps[two + 1][near])
            for i in np.flatnonzero(sizes > 2):
                edges = forest(np.unique(fps[bounds[i] : bounds[i + 1]]), radius)
                if edges:
                    x = np.array(edges, dtype=np.uint64)
                    a.append(x[:, 0]), b.append(x[:, 1])
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def hamming_links(fps: DataFrame, radius: int, blocks: int | None = None, hot: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links at radius bits or fewer.

    fps has a column fp of distinct signed LONGs. A bucket with more than `hot`
    members is split into parts, and each pair of parts meets in a task of its own.
    """
    ship(fps.sparkSession)
    blocks = blocks or choose_blocks(fps.count(), radius)
    filed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, radius)])).alias("t", "k"))
    crowded = filed.groupBy("t", "k").count().where(F.col("count") > hot).select("t", "k", F.ceil(F.col("count") / hot).cast("int").alias("parts"))
    crowded = materialise(crowded, "crowded")
    if not crowded.isEmpty():
        filed = filed.join(crowded, ["t", "k"], "left")
        part = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
        filed = filed.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        filed = filed.select("t", "k", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp")
    else:
        filed = filed.select("t", "k", "fp")
    keys = filed.columns[:-1]
    dealt = filed.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_bucket_edges(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest doc_id linked to it.

    Rows link when their fingerprints differ in radius bits or fewer, and links
    chain. Equal fingerprints are joined before anything is compared, so exact
    copies cost one row. Null and empty texts share fingerprint 0 and link like
    any other; a null doc_id keeps its row and counts only if its whole component
    has no other. No rows in, no rows out.
    """
    prints = materialise(fingerprints(docs, width), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(hamming_links(classes.select("fp"), radius))
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of text's word shingles, in order; words and shingles are those of fingerprint()."""
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return np.frombuffer(xxh64_digest(joined, SEED) if words else b"", dtype=np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    hashes = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())])
    return np.unique(np.frombuffer(hashes, dtype=np.int64))


def _sets(docs: DataFrame, width: int, keys: int | None) -> DataFrame:
    """(doc_id, id, n, fp, keys): a hash of each row's shingle set, its size, its SimHash, and its `keys` least shingles, or all."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest

        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # to bound memory
                part = batch.slice(i, 256)
                sets = [shingles(t.as_py(), width) for t in part.column(1)]
                ids = np.frombuffer(b"".join(xxh64_digest(x.tobytes(), SEED) for x in sets), dtype=np.int64)
                sizes = np.array([x.size for x in sets], dtype=np.int64)
                fps = np.array([_majority(x) for x in sets], dtype=np.int64)
                sets = [x[:keys] for x in sets]
                ends = np.cumsum([0] + [x.size for x in sets])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids), pa.array(sizes), pa.array(fps), lists], ["doc_id", "id", "n", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, id long, n long, fp long, keys array<long>")


def _majority(hashes: np.ndarray) -> int:
    """SimHash of distinct hashes, as a signed number."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, hashes.size, CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size).view(np.int64)[0])


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): for each row the smallest doc_id linked to it.

    Rows link when their shingle sets have a Jaccard similarity of `similarity` or
    more, and links chain. Sets are filed by their STAGE_KEYS least hashes of
    shingles; each of these is in both sets with a probability of the similarity, so
    that at 0.8 about one pair in 10^11 has none in common. Those filed together are
    compared by their SimHashes, which differ in STAGE_RADIUS bits at most, and then
    by their whole sets. Rows of equal sets are one node.
    """
    prints = materialise(_sets(docs, width, STAGE_KEYS), "sets")
    slots = [f"key{i}" for i in range(STAGE_KEYS)]
    known = prints.select("doc_id", "id", "n", "fp", *[F.get("keys", F.lit(i)).alias(c) for i, c in enumerate(slots)])
    classes = known.groupBy("id").agg(F.min("doc_id").alias("first_id"), *[F.max(c).alias(c) for c in ("n", "fp", *slots)])
    classes = materialise(classes, "classes")
    filed = classes.select(F.explode(F.array(*slots)).alias("key"), F.col("id").alias("v"), "n", "fp").where("key is not null")
    near = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - 1e-9
    near = near & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= STAGE_RADIUS)

    def similar(pairs):
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = classes.join(ids, "id", "left_semi").select("first_id", F.col("id").alias("of"))
        texts = docs.join(wanted.select("first_id").distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("first_id")), "left_semi")
        sets = materialise(_sets(texts, width, None).join(ids, "id", "left_semi").dropDuplicates(["id"]), "shingles")
        one, two = (sets.select(F.col("id").alias(x), F.col("keys").alias(f"k{x}")) for x in "ab")
        both = F.size(F.array_intersect("ka", "kb"))
        return pairs.join(one, "a").join(two, "b").where(both >= similarity * (F.size("ka") + F.size("kb") - both) - 1e-9).select("a", "b")

    roots = linked_groups(filed, near, similar).withColumnRenamed("node", "id")
    labelled = classes.select("id", "first_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.select("doc_id", "id").join(labelled.join(least, "root").select("id", "component_id"), "id").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates, that of the smallest doc_id, in docs' columns.

    Of rows that share a doc_id one stays at most; rows without a doc_id stay only
    if their group has no other, one of them: that of the smallest hash of its
    columns, so that reruns agree. Texts without words are one group.
    """
    with scratch(docs.sparkSession, keep="firsts"):
        found = similar_documents(docs, width, similarity)
        firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first_id")).distinct()
        firsts = materialise(firsts, "firsts")
    left = docs.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    tie = left.select(F.col("doc_id").alias("tie_id"), F.xxhash64(*[F.to_json(F.struct(c)) for c in left.columns]).alias("tie"))
    repeated = materialise(tie.groupBy("tie_id").agg(F.min("tie").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated")
    if repeated.isEmpty():
        return left
    marked = left.select("doc_id", F.struct(*[left[c] for c in left.columns]).alias("row"), F.xxhash64(*[F.to_json(F.struct(c)) for c in left.columns]).alias("tie"))
    marked = marked.join(repeated, F.col("doc_id").eqNullSafe(F.col("tie_id")), "left").where("least is null or tie = least")
    marked = marked.dropDuplicates(["doc_id"])  # those left are equal
    return marked.select(*[F.col("row")[c].alias(c) for c in docs.columns])
