"""Phrases whose words come together more often than by chance, counted in two passes over the texts.

  1. mappers count words, pairs and triples by hashed buckets in NumPy arrays; only
     whether a bucket reaches the least count matters, so arrays hold counts up to it
     in bytes, and they are added up in a tree;
  2. phrases whose bucket, and the buckets of all phrases within them, reach the
     least count are candidates: no frequent phrase is lost (Apriori), whatever
     buckets are shared. Mappers add up each candidate's occurrences as far as they
     can hold candidates, and Spark adds up what they tell, by language and phrase.
The parts of frequent phrases are frequent too, so cuts are read by joins of these.

Two passes are enough for any number of candidates. A mapper tells phrases apart by a
hash of 128 bits of language and words; of 10^10 phrases two share one with a
probability of 10^-19. Minimal perfect hash functions (`build`, `Slots`) give keys
slots with the key stored, for callers whose keys fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

LEAST, WIDEST, TOP = 10, 3, 2000
#: Share in per cent of a candidate's occurrences within a longer one that drops it.
WITHIN = 50
#: Buckets by which phrases of a length are counted: a power of two, one for each 32 bytes or more, within these bounds. 3 * 2^28 bits are 96 MB at most.
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 20, 1 << 28
#: Bytes of text of one mapper at least, where there are enough for all cores: the more it sees, the fewer phrases are told twice.
MAPPER = 1 << 26
#: Entries of an array that make up a row.
RUN = 1 << 16
#: Rows that a mapper puts out at once, and candidates that it holds: some 60 bytes each.
PART, PASS = 1 << 17, 1 << 21
#: Words that are looked at together, those that a worker knows by number, and the bytes that are taken apart at once.
WORDS, KNOWN, SLICE = 1 << 18, 1 << 18, 1 << 20
#: Buckets of a length that a task gathers before it counts them.
GATHERED = 1 << 22
#: Arrays that one task adds up at a level of the tree.
FAN = 32

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_FLAT = bytes.maketrans(_SEPARATORS + b"\t", b"\n" * len(_SEPARATORS) + b" ")
BREAK = 0


class Numbers(dict):
    """Words by number, from 0, the break between pieces; 1 is the empty string. hashes has two hashes of each."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update({b"\n": BREAK, b"": 1})
        self.words, self.hashes, self.hashed = [b"\n", b""], np.zeros((2, 1 << 12), np.uint64), 2

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.words.append(word)
        return n

    def hash_new(self) -> None:
        new = self.words[self.hashed :]
        if len(self.words) > self.hashes.shape[1]:
            more = np.zeros((2, 2 * len(self.words)), np.uint64)
            more[:, : self.hashed] = self.hashes[:, : self.hashed]
            self.hashes = more
        if new:
            self.hashes[:, self.hashed : len(self.words)] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in new), np.uint64).reshape(-1, 2).T
        self.hashed = len(self.words)

    def of(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, with BREAK between its pieces."""
        flat, found, at = text.lower().translate(_FLAT), [], 0
        while at < len(flat):
            end = len(flat) if len(flat) - at <= SLICE else max(flat.rfind(b" ", at, at + SLICE), flat.rfind(b"\n", at, at + SLICE)) + 1 or len(flat)
            words = flat[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
            found.append(ids[ids != 1])
            at = end
        self.hash_new()
        return np.concatenate(found) if found else np.empty(0, np.int32)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys_of(ids: np.ndarray, numbers: Numbers, lang: str, widest: int = WIDEST) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to `widest`: whether a phrase starts at each word (the last ones that are too near to the end left out), and the two halves of its key."""
    seed = np.frombuffer(xxhash.xxh3_128_digest(lang.encode()), np.uint64).reshape(2, 1)
    words = numbers.hashes[:, ids]
    whole, keys = ids != BREAK, _mix(_mix(seed.copy()) * np.uint64(0x9E3779B97F4A7C15) + words)
    found = [(whole, keys)]
    for k in range(2, widest + 1):
        whole = whole[:-1] & (ids[k - 1 :] != BREAK) if len(whole) else whole
        keys = _mix(keys[:, : len(whole)] * np.uint64(0x9E3779B97F4A7C15) + words[:, k - 1 :])
        found.append((whole, keys))
    return found


def stretches(batches: Iterator[pa.RecordBatch], numbers: Numbers) -> Iterator[tuple[str, np.ndarray, int]]:
    """(lang, ids, own): numbers of words of texts (lang, text); phrases that start at one of the first `own` are told here, what follows completes the last ones."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if text:
                own = held.setdefault(lang, [])
                own += [numbers.of(text), np.zeros(1, np.int32)]
                if sum(map(len, own[-64:])) > WORDS or len(own) > 1 << 16:
                    yield from _split(lang, own)
                    own.clear()
        for lang, own in held.items():
            yield from _split(lang, own)
        if len(numbers) > KNOWN:
            numbers.reset()


def _split(lang: str, parts: list[np.ndarray]) -> Iterator[tuple[str, np.ndarray, int]]:
    ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
    for at in range(0, len(ids), WORDS):
        part = ids[at : at + WORDS + WIDEST - 1]
        yield lang, part, min(WORDS, len(ids) - at)


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


# Arrays in rows, added up in a tree

ARRAY = "k int, run int, tier int, data binary"
_ARRAY = [("k", pa.int32()), ("run", pa.int32()), ("tier", pa.int32()), ("data", pa.binary())]


def _array_rows(k: int, run: int, values: np.ndarray) -> tuple:
    return k, run, TaskContext.get().partitionId(), zstandard.compress(values.tobytes(), 1)


def tree_sum(arrays: DataFrame, tasks: int, add: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """One row for each (k, run) of arrays: the sum of those of all tiers, which were made by so many tasks.

    Rows come in order, so that a task holds one array; at each level it adds up
    those of FAN tiers, so that no task gets more at any number of tasks.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            done = []
            for k, run, tier, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(zstandard.decompress(data), kind)
                if (k, run, tier) == at:
                    total = add(total, own)
                else:
                    if at is not None:
                        done.append((*at, zstandard.compress(total.tobytes(), 1)))
                    at, total = (k, run, tier), own
            yield _rows(done, _ARRAY)
        if at is not None:
            yield _rows([(*at, zstandard.compress(total.tobytes(), 1))], _ARRAY)

    tiers = tasks
    while tiers > 1:
        arrays = arrays.withColumn("tier", F.floor(F.col("tier") / FAN).cast("int") if tiers > FAN else F.lit(0))
        arrays = arrays.repartition("k", "run", "tier").sortWithinPartitions("k", "run", "tier").mapInArrow(summed, ARRAY)
        tiers = -(-tiers // FAN)
    if tasks <= 1:
        arrays = arrays.repartition("k", "run").sortWithinPartitions("k", "run", "tier").withColumn("tier", F.lit(0)).mapInArrow(summed, ARRAY)
    return arrays


# Pass 1: buckets that reach the least count


def bucket_bits(texts: DataFrame, buckets: int, least: int) -> np.ndarray:
    """(lengths, buckets / 8) bytes: the bits of buckets in which phrases of each length occur `least` times or more.

    texts is (lang, text). Least counts of over 255 are taken as 255, which lets more buckets through.
    """
    top = min(least, 255)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, size = Numbers(), [[] for _ in range(WIDEST)], 0
        for lang, ids, own in stretches(batches, numbers):
            for k, (whole, keys) in enumerate(keys_of(ids, numbers, lang)):
                held[k].append((keys[0, :own][whole[:own]] & np.uint64(buckets - 1)).astype(np.uint32))
            size += own
            if size >= GATHERED:
                yield from told(held)
                size = 0
        yield from told(held)

    def told(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Arrays of what was gathered, which is then forgotten."""
        for k, gathered in enumerate(held):
            if gathered:
                at = np.sort(np.concatenate(gathered))
                gathered.clear()
                ends, rows = np.searchsorted(at, np.arange(0, buckets + RUN, RUN)), []
                for run in np.flatnonzero(np.diff(ends)):
                    values = np.bincount(at[ends[run] : ends[run + 1]] - np.uint32(run * RUN), minlength=RUN)
                    rows.append(_array_rows(k, int(run), np.minimum(values, top).astype(np.uint8)))
                yield _rows(rows, _ARRAY)

    add = lambda a, b: np.minimum(a.astype(np.uint16) + b, top).astype(np.uint8)
    arrays = tree_sum(texts.mapInArrow(counted, ARRAY), texts.rdd.getNumPartitions(), add, "u1")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(k, run, 0, np.packbits(np.frombuffer(zstandard.decompress(d), np.uint8) >= top, bitorder="little").tobytes()) for k, run, _, d in zip(*(c.to_pylist() for c in batch.columns))], _ARRAY)

    bits = np.zeros((WIDEST, buckets // 8), np.uint8)
    for r in arrays.mapInArrow(packed, ARRAY).select("k", "run", "data").toLocalIterator():
        bits[r["k"], r["run"] * RUN // 8 : (r["run"] + 1) * RUN // 8] = np.frombuffer(r["data"], np.uint8)
    return bits


def passing(found: list[tuple[np.ndarray, np.ndarray]], bits: np.ndarray) -> list[np.ndarray]:
    """For each length whether the phrase at each word, and all phrases within it, have buckets that reach the least count."""
    out: list[np.ndarray] = []
    for k, (whole, keys) in enumerate(found):
        at = keys[0] & np.uint64(bits.shape[1] * 8 - 1)
        good = whole & ((bits[k][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        if k:
            good &= out[-1][: len(good)] & out[-1][1 : len(good) + 1]
        out.append(good)
    return out


# Pass 2: candidates and their counts

COUNTED = "lang string, phrase string, n long"


class Tally:
    """Counts by keys of 128 bits, sorted by the first half; phrases and counts are in the order in which keys came."""

    def __init__(self):
        self.keys, self.place, self.counts = np.empty((2, 0), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.phrases: list[tuple[str, pa.Array]] = []

    def __len__(self) -> int:
        return len(self.counts)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Count keys; for each that is new, in order, where it is among keys. One whose first half is another's may come as new again."""
        order = np.argsort(keys[0])
        keys = keys[:, order]
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(order) else order
        counts, keys = np.diff(np.append(starts, len(order))), keys[:, starts]
        at = np.searchsorted(self.keys[0], keys[0])
        known = at < len(self)
        known[known] = (self.keys[:, at[known]] == keys[:, known]).all(axis=0)
        np.add.at(self.counts, self.place[at[known]], counts[known])
        new = ~known
        self.place = np.insert(self.place, at[new], np.arange(len(self), len(self) + new.sum()))
        self.keys = np.insert(self.keys, at[new], keys[:, new], axis=1)
        self.counts = np.append(self.counts, counts[new])
        return order[starts[new]]

    def rows(self, most: int) -> Iterator[pa.RecordBatch]:
        start = 0
        for lang, phrases in self.phrases:
            for at in range(0, len(phrases), most):
                own = phrases.slice(at, most)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(own)), own, pa.array(self.counts[start + at : start + at + len(own)])], names=["lang", "phrase", "n"])
            start += len(phrases)


def candidate_counts(texts: DataFrame, bits: np.ndarray, part: int = PART, pass_: int = PASS) -> DataFrame:
    """(lang, phrase, n): the occurrences of each candidate, and for each language with the empty phrase its words."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, tally, totals = Numbers(), Tally(), {}
        for lang, ids, own in stretches(batches, numbers):
            found = keys_of(ids, numbers, lang)
            totals[lang] = totals.get(lang, 0) + int(found[0][0][:own].sum())
            words = numbers.words
            for k, ((_, keys), good) in enumerate(zip(found, passing(found, shared.value)), 1):
                at = np.flatnonzero(good[:own])
                at = at[tally.add(keys[:, at])]
                phrases = [b" ".join([words[i] for i in p]) for p in ids[at[:, None] + np.arange(k)].tolist()]
                tally.phrases.append((lang, pa.array(phrases, pa.binary()).cast(pa.string())))
            if len(tally) >= pass_:
                yield from tally.rows(part)
                tally = Tally()
        yield from tally.rows(part)
        schema = [("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]
        yield _rows([(lang, "", n) for lang, n in totals.items()], schema)

    # Dealt out first: a mapper tells a candidate seldom twice, so that partial sums before the shuffle would not pay.
    return texts.mapInArrow(counted, COUNTED).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# Slots of keys that fit in memory


def build(hi: np.ndarray, lo: np.ndarray, spread: float = 1.5) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, words of all levels' bits, slots of the keys): a minimal perfect hash function of distinct keys.

    At each level the keys left are hashed to bits, those alone on theirs are
    settled, and the others go on. A key's slot is the number of bits set before its own.
    """
    sizes, words, left = [], [], np.arange(len(hi))
    place = np.zeros(len(hi), np.int64)
    base = 0
    while len(left):
        if len(sizes) > 200:
            raise ValueError("keys are not distinct")
        size = max(64, -(-int(spread * len(left)) // 64) * 64)
        at = _level(hi[left], lo[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        place[left[settled]] = base + at[settled]
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        base += size
        left = left[~settled]
    words = np.concatenate(words) if words else np.empty(0, np.uint64)
    return sizes, words, _rank(words, _before(words), place) if len(hi) else place


def _level(hi: np.ndarray, lo: np.ndarray, level: int, size) -> np.ndarray:
    return (_mix(hi * np.uint64(2 * level + 3) + (lo ^ np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1))) % np.asarray(size, np.uint64)).astype(np.int64)


def _before(words: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))


def _rank(words: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
    word, bit = place >> 6, (place & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class Slots:
    """The functions of the parts that are counted in one pass, one after another in the arrays, with the keys stored by slot."""

    def __init__(self, parts: int, built: list[tuple[int, list[int], bytes, bytes]]):
        levels = max((len(sizes) for _, sizes, _, _ in built), default=0)
        self.parts, self.base, self.sizes = parts, np.zeros((levels, parts), np.int64), np.zeros((levels, parts), np.int64)
        words, keys, at = [], [], 0
        for part, sizes, bits, stored in built:
            for level, size in enumerate(sizes):
                self.base[level, part], self.sizes[level, part] = at, size
                at += size
            words.append(np.frombuffer(bits, np.uint64))
            keys.append(np.frombuffer(stored, np.uint64).reshape(2, -1))
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.before = _before(self.words)
        self.keys = np.concatenate(keys, axis=1) if keys else np.empty((2, 0), np.uint64)

    def __len__(self) -> int:
        return self.keys.shape[1]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are not stored."""
        slots = np.full(keys.shape[1], -1, np.int64)
        part = (keys[1] % np.uint64(self.parts)).astype(np.int64)
        left = np.arange(keys.shape[1])
        for level in range(len(self.sizes)):
            size = self.sizes[level][part]
            if not size.all():
                left, part, size = left[size > 0], part[size > 0], size[size > 0]
            if not len(left):
                break
            place = self.base[level][part] + _level(keys[0, left], keys[1, left], level, size)
            settled = (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            slots[left[settled]] = _rank(self.words, self.before, place[settled])
            left, part = left[~settled], part[~settled]
        known = slots >= 0
        known[known] = (self.keys[:, slots[known]] == keys[:, known]).all(axis=0)
        return np.where(known, slots, -1)


def frequent(texts: DataFrame, least: int, part: int, pass_: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases that occur `least` times or more, and (lang, n)."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = FEWEST_BUCKETS
    while buckets < MOST_BUCKETS and buckets < size / 32:  # about a sixth of the words
        buckets *= 2
    mappers = max(2 * spark.sparkContext.defaultParallelism, -(-size // MAPPER))
    texts = texts.coalesce(mappers)
    found = candidate_counts(texts, bucket_bits(texts, buckets, least), part, pass_)
    found = materialise(found.where((F.col("n") >= least) | (F.col("phrase") == "")), "frequent")
    return found.where("phrase <> ''").withColumnRenamed("n", "a"), found.where("phrase = ''").select("lang", "n")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1,000,000 a a / (l r)), exactly for counts of under 10^15."""
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big(a, 15) * big(a, 15), big(l, 18) * big(r, 18))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, within: int = WITHIN, part: int = PART, pass_: int = PASS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two and three words of each language (null: und).

    Texts (null: empty) are in lower case for A-Z, cut into pieces at .,;:!? and line
    ends, and into words at spaces and tabs; phrases lie within pieces. a counts all
    occurrences, overlapping ones too. Of phrases with a of `least` or more, each cut
    into a first part, l times there, and a rest, r times, scores
    floor(1,000,000 a a / (l r)); the lowest counts, of equal ones the first cut's.
    A phrase goes if a longer one that contains it has `within` per cent of its
    occurrences or more. n counts the words of the language. Ranks go by score, then
    a, both from the highest, then by phrase in UTF-8 order. Repeated rows count as
    often as they are there; no rows give no rows; columns but lang and text are not read.

    What reaches the driver and each worker is bounded, and so are the passes over
    the texts: bits of buckets, and in a worker `pass_` candidates with their counts,
    which it puts out in rows of `part` when it holds as many.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found, totals = frequent(texts, least, part, pass_)
    rows = found.withColumn("k", F.size(F.split("phrase", " "))).where("k > 1")
    cuts = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    side = lambda words: F.call_function("substring_index", "phrase", F.lit(" "), words)
    cuts = cuts.select("*", side(F.col("cut")).alias("head"), side(F.col("cut") - F.col("k")).alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    low = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("low")
    rows = cuts.groupBy("lang", "phrase", "k", "a").agg(low).select("lang", "phrase", "k", "a", "low.l", "low.r", "low.score")
    rows = materialise(rows, "scored")
    words = F.split("phrase", " ")
    longer = rows.where("k = 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = rows.join(most, ["lang", "phrase"], "left").where(f"inside is null or 100 * inside < {within} * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of op13's contract.
ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS MATERIALIZED (
    SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM split WHERE len(w) > 0)
), totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
counts AS MATERIALIZED (
    SELECT lang, w1, NULL AS w2, NULL AS w3, w1 AS p, CAST(count(*) AS HUGEINT) AS f FROM places GROUP BY lang, w1 HAVING count(*) >= 10
    UNION ALL
    SELECT lang, w1, w2, NULL, w1 || ' ' || w2, CAST(count(*) AS HUGEINT) FROM places WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10
    UNION ALL
    SELECT lang, w1, w2, w3, w1 || ' ' || w2 || ' ' || w3, CAST(count(*) AS HUGEINT) FROM places WHERE w2 IS NOT NULL AND w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10
), cuts AS (
    SELECT lang, p, f, 1 AS cut, w1 AS head, CASE WHEN w3 IS NULL THEN w2 ELSE w2 || ' ' || w3 END AS rest FROM counts WHERE w2 IS NOT NULL
    UNION ALL
    SELECT lang, p, f, 2, w1 || ' ' || w2, w3 FROM counts WHERE w3 IS NOT NULL
), scored AS (
    SELECT cuts.lang, cuts.p, cuts.f, cut, x.f AS l, y.f AS r, CAST(1000000 * cuts.f * cuts.f // (x.f * y.f) AS BIGINT) AS score
    FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.p = head JOIN counts y ON y.lang = cuts.lang AND y.p = rest
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS nth FROM scored),
inside AS (
    SELECT lang, p, max(f) AS most FROM (
        SELECT lang, w1 || ' ' || w2 AS p, f FROM counts WHERE w3 IS NOT NULL UNION ALL SELECT lang, w2 || ' ' || w3 AS p, f FROM counts WHERE w3 IS NOT NULL
    ) GROUP BY lang, p
), kept AS (
    SELECT lowest.lang, lowest.p AS phrase, f AS a, l, r, score
    FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.p = lowest.p WHERE nth = 1 AND (most IS NULL OR 100 * most < 50 * f)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
