"""Words that were run together, split where the parts are likeliest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of up to so many characters stay as they are.
LONGEST = 15
#: Words that a lexicon has at most, by which its size in every worker is bounded.
LEXICON_WORDS = 200_000

_TOKEN = re.compile(r"\w+|\W")
_PIECE = re.compile(r"[A-Za-z0-9']+")
INFINITE = float("inf")


def ranked_lexicon(texts: DataFrame, words: int = LEXICON_WORDS, longest: int = LONGEST) -> DataFrame:
    """(word, cost): the most frequent words of texts (text), in lower case and of up to `longest` characters, with Zipf costs by their rank.

    The word of rank r of n costs ln(r ln n); equally frequent words go by their letters.
    """
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("[a-z0-9']+"), F.lit(0))).alias("word"))
    counted = found.where(F.char_length("word") <= longest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    few = counted.orderBy(F.col("n").desc(), "word").limit(min(words, LEXICON_WORDS))
    ranked = few.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "word"))).crossJoin(F.broadcast(few.agg(F.count(F.lit(1)).alias("of"))))
    return ranked.select("word", F.log(F.col("rank") * F.log(F.greatest(F.col("of"), F.lit(2)))).alias("cost"))


class Lexicon:
    def __init__(self, costs: dict[str, float]):
        self.costs, self.longest = costs, max(map(len, costs), default=1)

    def split(self, word: str) -> list[str]:
        """The parts of a word, of least cost in all, between characters that are no letter, digit or apostrophe, which go."""
        return [part for piece in _PIECE.findall(word) for part in self._parts(piece)]

    def _parts(self, piece: str) -> list[str]:
        low, best, step = piece.lower(), [0.0], [0]
        for end in range(1, len(piece) + 1):
            options = ((best[end - k] + self.costs.get(low[end - k : end], INFINITE), k) for k in range(1, min(end, self.longest) + 1))
            cost, k = min(options)
            best.append(cost), step.append(k)
        parts, end = [], len(piece)
        while end:
            part, end = piece[end - step[end] : end], end - step[end]
            follows = parts and (parts[-1] == "'s" or (part[-1].isdigit() and parts[-1][0].isdigit()))
            if follows and part != "'":
                parts[-1] = part + parts[-1]
            else:
                parts.append(part)
        return parts[::-1]

    def split_text(self, text: str, longest: int) -> str:
        return "".join(" ".join(self.split(t)) if len(t) > longest else t for t in _TOKEN.findall(text))


def collected(lexicon: DataFrame) -> dict[str, float]:
    """lexicon (word, cost) as a dict; more than LEXICON_WORDS rows are an error, as every worker holds it."""
    rows = lexicon.where("word is not null and cost is not null").limit(LEXICON_WORDS + 1).collect()
    if len(rows) > LEXICON_WORDS:
        raise ValueError(f"a lexicon has {LEXICON_WORDS} words at most")
    return {r["word"]: float(r["cost"]) for r in rows}


def words_split(spark: SparkSession, text: Column, lexicon: DataFrame, longest: int = LONGEST) -> Column:
    """text with each word of over `longest` characters split into words of the lexicon, a space between them.

    Words are runs of letters, digits and underscores. Of all ways to cut a word into
    parts the one whose costs add up to least is taken, of equal ones the one with
    the shortest last part; parts are looked up in lower case. A part that the
    lexicon does not have makes a way infinitely dear, so that a word with such a
    part in all its ways comes apart into single characters up to there, as a word
    of an empty lexicon does. Digits that follow digits stay together, and 's stays
    with the word before it. Characters of long words other than ASCII letters,
    digits and apostrophes go, so texts should be in a language without any. Null
    text stays null.
    """
    shared = spark.sparkContext.broadcast(collected(lexicon))

    @F.arrow_udf("string")
    def split(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Lexicon(shared.value)
        for batch in texts:
            yield pa.array([None if t is None else words.split_text(t, longest) for t in batch.to_pylist()], pa.string())

    return split(text)
