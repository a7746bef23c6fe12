"""Language of whole texts, and of the spans of mixed ones.

A model has a log-probability for each word in each language, from labelled
texts; a word it does not know is scored by its letter trigrams. The scripts of a
text's letters narrow the languages to those met in such scripts. Viterbi decoding
over the words, with a penalty for each switch, labels spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ship

#: Labelled texts that a model learns from, at most about so many; a hash of doc_id chooses.
LABELLED = 8_000
#: Words a model keeps for each language, the most frequent ones.
WORDS = 50_000
#: What a switch of language costs, in units of log-probability.
SWITCH = 12.0
#: Words whose scores a worker remembers.
CACHE_WORDS = 1_000_000
#: The most that one word may speak for a language over another.
CLIP = 8.0

#: First and last code points of scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)


#: Runs of letters, and of what counts as part of a word but is no digit.
_WORD = re.compile(r"[^\W\d_]+")


@cache
def script_of(c: str) -> str | None:
    """Script of a letter; None for other characters."""
    if not c.isalpha():
        return None
    return next((name for name, low, high in SCRIPTS if low <= ord(c) <= high), unicodedata.name(c, "other").split()[0].lower())


def letters_only(word: str) -> str:
    """The word in lower case without what is no letter."""
    word = word.lower()
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


class Model:
    """Scores of words by language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        """counts: for each language the counts of its words (letters_only) in labelled texts."""
        self.langs = sorted(counts)
        n = len(self.langs)
        self.scripts: dict[str, set[int]] = {}
        grams: dict[str, np.ndarray] = {}
        words: dict[str, np.ndarray] = {}
        totals = np.zeros(n)
        for i, lang in enumerate(self.langs):
            kept = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:WORDS]
            for word, k in kept:
                words.setdefault(word, np.zeros(n))[i] += k
                totals[i] += k
                for g in self.grams(word):
                    grams.setdefault(g, np.zeros(n))[i] += k
        # row 0 of the scores is that of a trigram never met
        met = np.array([np.zeros(n), *grams.values()])
        self.gram_ids = {g: i for i, g in enumerate(grams, 1)}
        self.gram_scores = np.log((met + 0.5) / (met.sum(axis=0) + 0.5 * max(1, len(grams))))
        self.word_scores = {w: np.log((v + 0.1) / (totals + 0.1 * len(words))) for w, v in words.items() if v.sum() >= 2}
        script_words: dict[str, np.ndarray] = {}
        for w, v in words.items():
            s = script_of(w[0]) if w else None
            if s:
                script_words.setdefault(s, np.zeros(n))
                script_words[s] += v
        for s, v in script_words.items():
            self.scripts[s] = {i for i in range(n) if v[i] > 0.01 * totals[i] or v[i] == v.max()}
        self.narrow = any(len(v) < n for v in self.scripts.values())
        self.known: dict[str, int] = {}
        self._clear()

    @staticmethod
    def grams(word: str) -> list[str]:
        padded = f"^{word}$"
        return [padded[i : i + 3] for i in range(len(padded) - 2)]

    def _clear(self) -> None:
        """Number 0 is a word without letters; it speaks for nothing."""
        self.known.clear()
        self.table, self.weights = np.zeros((1, len(self.langs)), np.float32), np.zeros(1, np.int64)

    def _scores(self, letters: list[str]) -> np.ndarray:
        """Scores of words of letters: their own, or the sum of their trigrams'; the best language's is 0."""
        split = [self.grams(w) for w in letters]
        ids = np.fromiter((self.gram_ids.get(g, 0) for grams in split for g in grams), np.int64, sum(map(len, split)))
        starts = np.concatenate(([0], np.cumsum([len(x) for x in split])[:-1]))
        scores = np.add.reduceat(self.gram_scores[ids], starts, axis=0)
        for i, w in enumerate(letters):
            own = self.word_scores.get(w)
            if own is not None:
                scores[i] = own
        scores = np.clip(scores - scores.max(axis=1, keepdims=True), -CLIP, 0)
        if self.narrow:
            for i, w in enumerate(letters):
                allowed = set().union(*(self.scripts.get(s, set()) for s in {script_of(c) for c in w}))
                if allowed:
                    scores[i, [k for k in range(len(self.langs)) if k not in allowed]] = -CLIP
        return scores

    def learn(self, words: set[str]) -> None:
        """Number the words not yet known, and add their scores to the table."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self._clear()
            new = list(words)
        letters = [letters_only(w) for w in new]
        some = [(w, x) for w, x in zip(new, letters) if x]
        self.known.update((w, 0) for w, x in zip(new, letters) if not x)
        if some and self.langs:
            n = len(self.table)
            self.known.update((w, n + i) for i, (w, _) in enumerate(some))
            self.table = np.concatenate((self.table, self._scores([x for _, x in some]).astype(np.float32)))
            self.weights = np.concatenate((self.weights, [len(x) for _, x in some]))
        elif some:
            self.known.update((w, 0) for w, _ in some)

    def label(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each text its words, the most likely language of each by number, and each word's letters."""
        split = [_WORD.findall(t.lower()) for t in texts]
        self.learn(set().union(*split))
        table, weights = self.table, self.weights
        for words in split:
            ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            yield words, best_path(table[ids]), weights[ids]


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The states with the greatest sum of scores less switch for each change of state (Viterbi).

    If no stretch of words gains more than a switch over the state that is best
    overall, no path through other states pays, and that state is the answer; this
    settles texts in one language with a few passes over an array.
    """
    n, k = scores.shape
    if n == 0:
        return np.empty(0, np.int64)
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0)
    lowest = np.minimum.accumulate(np.vstack((np.zeros(k), gain)), axis=0)[:-1]
    if (gain - lowest).max() <= switch:
        return np.full(n, best)
    back = np.empty((n, k), dtype=np.int16)
    value = scores[0].copy()
    own = np.arange(k)
    for i in range(1, n):
        top = int(value.argmax())
        jump = value[top] - switch
        stay = value >= jump
        back[i] = np.where(stay, own, top)
        value = np.where(stay, value, jump) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def learn(docs: DataFrame, labelled: int = LABELLED) -> Model:
    """A model of the rows of docs (doc_id, text, lang) that have a lang and a text.

    If there are more than `labelled`, a hash of doc_id leaves about so many. Their
    words are counted by language on the executors, and of each language the most
    frequent ones reach the driver, at most WORDS.
    """
    ship(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null")
    n = rows.count()
    if n > labelled:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * labelled / n))
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = rows.select("lang", word.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    found: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= WORDS).collect():
        found.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return Model(found)


IDENTIFIED = "lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"


def identify(docs: DataFrame, model: Model, undetermined: str = "und") -> DataFrame:
    """docs' columns but text, with lang_pred, score and spans of each whole text.

    lang_pred is the language of most letters, score its share of them. spans are
    the runs of words of one language: start and end count words, which are runs of letters. A text that is
    null or has no letter is `undetermined` with score 0 and no spans, and so is any
    other if the model knows no language. Columns of docs with these names are
    replaced. Each row is worked on alone, so there is no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "spans")]
    rows = docs.select(*names, F.col("text").cast("string").alias("text"))
    schema = StructType(rows.drop("text").schema.fields + StructType.fromDDL(IDENTIFIED).fields)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                preds, scores, spans = [], [], []
                for words, path, weights in own.label([t or "" for t in part.column(len(names)).to_pylist()]):
                    total = int(weights.sum())
                    if not total or not own.langs:
                        preds.append(undetermined), scores.append(0.0), spans.append([])
                        continue
                    share = np.bincount(path, weights, len(own.langs)) / total
                    preds.append(own.langs[int(share.argmax())]), scores.append(float(share.max()))
                    edge = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
                    spans.append([{"start": i, "end": j, "lang": own.langs[path[i]]} for i, j in zip(edge, edge[1:])])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], names=[*names, "lang_pred", "score", "spans"])

    return rows.mapInArrow(run, schema)
