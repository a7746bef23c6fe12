"""Finding benchmark passages in documents with one Aho-Corasick automaton over words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let, ship

#: Words of a window.
WINDOW = 10
#: Windows and characters of them that one automaton takes; a benchmark of more is dealt over several, each of which scans all documents.
AUTOMATON_WINDOWS, AUTOMATON_CHARS = 250_000, 1 << 25
#: Bytes of a text that are taken apart at once, and words that are handed to the automaton at once.
SLICE, STRETCH = 1 << 22, 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that are no part of a word as a space, letters in lower case. All bytes beyond ASCII are of words.
_WORDS = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, win): every `window` neighbouring words of each item's text, space-joined; all words of an item of fewer, none of one without."""
    words = F.filter(F.split(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    cut = lambda w: F.when(F.size(w) <= window, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.slice(w, i, window)))
    found = benchmark.select(F.col("item_id").cast("string").alias("item"), let(words, lambda w: F.when(F.size(w) > 0, cut(w))).alias("wins"))
    return found.select("item", F.explode("wins").alias("win")).select("item", F.array_join("win", " ").alias("win")).distinct()


class Scanner:
    """An automaton over the windows of some items, whose letters are words by number.

    A word that no window has takes the automaton to its root, so only stretches of
    known words are handed to it, and of these only such as hold a whole window.
    """

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[set] = []
        self.shortest = 1 << 30
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        places: dict[str, int] = {}
        for item, win in rows:
            at = places.setdefault(win, len(places))
            if at == len(self.items):
                words = win.encode().split(b" ")
                self.items.append(set())
                self.shortest = min(self.shortest, len(words))
                self.automaton.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), (at, len(words)))
            self.items[at].add(item)
        if rows:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        """(words, words hit, items found, places hit): places are maximal ranges of code points of the text as it is, from one to before the other."""
        flat = text.translate(_WORDS)
        ids, at = [], 0
        while at < len(flat):
            end = len(flat) if len(flat) - at <= SLICE else flat.rfind(b" ", at, at + SLICE) + 1 or len(flat)
            words = flat[at:end].split()
            ids.append(np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words)))
            at = end
        ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        edges = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        lengths = np.diff(edges) - 1
        change, windows = None, set()
        for j in np.flatnonzero(lengths >= self.shortest):
            start = int(edges[j]) + 1
            stop, walk = start + int(lengths[j]), self.automaton.iter(())
            for s in range(start, stop, STRETCH):
                walk.set(tuple(ids[s : min(s + STRETCH, stop)].tolist()), False)
                for last, (window, length) in walk:
                    if change is None:
                        change = np.zeros(len(ids) + 1, np.int64)
                    change[start + last + 1 - length] += 1
                    change[start + last + 1] -= 1
                    windows.add(window)
        if change is None:
            return len(ids), 0, [], []
        hit = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
        runs = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
        letters = np.concatenate(([False], np.frombuffer(flat, np.uint8) != 32, [False]))
        bounds = np.flatnonzero(letters[1:] != letters[:-1]).reshape(-1, 2)
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        places = list(zip(points[bounds[runs[:, 0], 0]].tolist(), points[bounds[runs[:, 1] - 1, 1]].tolist()))
        items = set().union(*(self.items[w] for w in windows))
        return len(ids), int(hit.sum()), sorted(items - {None}), places


SCANNED = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_scanners: dict[str, Scanner] = {}


def _scanned(rows: DataFrame, names: list[str], windows: list[tuple[str | None, str]]) -> DataFrame:
    """rows with the columns SCANNED for the last one, a text; the windows go to each worker, which makes its automaton of them once."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    key = uuid.uuid4().hex
    schema = StructType(rows.select(*names).schema.fields + StructType.fromDDL(SCANNED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(shared.value)
        scanner = _scanners[key]
        for batch in batches:
            found = [scanner.scan(t or b"") for t in batch.column(len(names)).cast(pa.binary()).to_pylist()]
            n, hit, items, places = zip(*found) if found else ((), (), (), ())
            spans = [[{"start": a, "end": b} for a, b in p] for p in places]
            columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*names, "n_words", "n_hit", "items", "spans"])

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WINDOWS) -> DataFrame:
    """docs' columns but text, with n_words, n_hit, items and spans of each whole text.

    Words are runs of ASCII letters in lower case, of digits and of all characters
    beyond ASCII. A document's words inside an occurrence of any window of an item
    are hit: n_hit counts them, spans are their maximal runs as ranges of the
    original text's code points (from the first word's first character to after the
    last word's last), items the ids of the items with such windows, as sorted
    strings. A null text has no words, and neither has an item's; an item without an
    id marks words but is not listed, and items that share an id are one. Repeated
    documents are scanned row by row. Columns of docs with the new names are replaced.

    The windows are counted first. Up to `most`, one automaton has them all and each
    task scans what it reads, with no shuffle. Beyond, they are dealt by a hash over
    as many automata as it takes, so that no worker holds more; each scans all
    documents, and what they find is brought together by document.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "items", "spans")]
    wins = windows_of(benchmark, window)
    size = wins.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("win")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // most), -(-size["chars"] // AUTOMATON_CHARS))
    rows = docs.select(*names, F.col("text").cast("string").alias("text"))
    if blocks == 1:
        return _scanned(rows, names, [tuple(r) for r in wins.collect()])
    wins = wins.withColumn("block", F.pmod(F.xxhash64("item", "win"), F.lit(blocks)))
    texts = docs.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), F.col("text").cast("string").alias("text"))
    parts = []
    for block in range(blocks):
        own = [tuple(r) for r in wins.where(F.col("block") == block).select("item", "win").collect()]
        parts.append(_scanned(texts, ["k1", "k2"], own).where("n_hit > 0"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _joined(rows, names, found)


def _joined(rows: DataFrame, names: list[str], found: DataFrame) -> DataFrame:
    """rows with what several automata have found in their texts (k1, k2)."""
    united = found.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"))
    # Ranges that overlap, or that follow one another with no word between, are one.
    keyed = rows.select(F.struct(*names).alias("row"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    both = keyed.join(united, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def touch(last, s):
        between = F.substring(F.col("text"), last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
        return (s["start"] <= last["end"]) | ~between.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(done) == 0, F.array(s)).when(touch(last, s), grown).otherwise(F.concat(done, F.array(s)))

    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    spans = F.aggregate(F.coalesce("all", empty), empty, add)
    inside = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + F.regexp_count(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]), F.lit(word)))
    done = both.select("row", "text", F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))
    n = F.coalesce(F.regexp_count("text", F.lit(word)), F.lit(0)).cast("long")
    return done.select("row.*", n.alias("n_words"), inside(F.col("spans")).alias("n_hit"), "items", "spans")


#: DuckDB SQL of op11's contract.
ORACLE_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL
), sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM item_words WHERE len(w) > 0),
starts AS (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized),
wins AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM starts),
doc_words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), ends AS (SELECT DISTINCT k, split_part(win, ' ', 1) AS head, split_part(win, ' ', k) AS tail FROM wins),
places AS (SELECT doc_id, unnest(w) AS head, generate_subscripts(w, 1) AS i FROM doc_words),
likely AS (
    SELECT a.doc_id, a.i, ends.k FROM places a JOIN ends ON ends.head = a.head JOIN places b ON b.doc_id = a.doc_id AND b.i = a.i + ends.k - 1 AND b.head = ends.tail
), found AS (
    SELECT l.doc_id, l.i, l.k, wins.item_id
    FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win FROM likely JOIN doc_words USING (doc_id)) l JOIN wins USING (k, win)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
