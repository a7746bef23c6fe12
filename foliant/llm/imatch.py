"""I-Match fingerprints of documents, with DataFrame functions only.

A text's distinct terms within a band of inverse document frequency are sorted,
and hashed by randomised subsets of the lexicon. One hash over all terms would
change with any of them; a small subset often keeps its terms, so the share of
equal subset hashes tells how alike two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

#: Terms are kept whose ln(documents / documents with the term) lies in this band.
IDF_LOW, IDF_HIGH = 3.5, 11.0
#: Terms are counted by this many hash values, which bounds the lexicon whatever the corpus.
LEXICON_BITS = 20
#: Subsets of a level, and levels: a level's subsets hold a quarter of the terms of the one before.
SUBSETS, LEVELS = 16, 5
#: Subsets that must hold terms for a level to tell about likeness.
ENOUGH = 6
EMPTY = "0000"


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the terms of text: words in lower case without ASCII punctuation."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\s\p{Punct}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << LEXICON_BITS) - 1))


def lexicon(docs: DataFrame, low: float = IDF_LOW, high: float = IDF_HIGH) -> Column:
    """A literal array of LONGs, whose bits tell which hash values of terms are within the band.

    Documents are counted for each of 2 ** LEXICON_BITS hash values, over all rows,
    with partial counts before the shuffle; 16,384 numbers come back at most.
    """
    slots = docs.select(F.explode(F.array_distinct(F.transform(term_hashes(F.col("text")), _slot))).alias("slot"))
    counts = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(1, docs.count()))) / F.col("df"))
    inside = counts.where((idf >= low) & (idf <= high))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int")))
    words = [0] * ((1 << LEXICON_BITS) // 64)
    for r in inside.groupBy((F.col("slot") / 64).cast("int").alias("at")).agg(bits.alias("bits")).collect():
        words[r["at"]] = r["bits"]
    return F.expr(f"cast(split('{','.join(map(str, words))}', ',') as array<bigint>)")


def fingerprint(text: Column, known: Column) -> Column:
    """LEVELS * SUBSETS groups of four hex digits; a subset that holds no term of text has 0000."""

    def inside(h):
        word = F.get(known, F.shiftright(_slot(h), 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    # the lexicon looks at a hash's low bits, the subsets at its high ones
    def subset(h):
        return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SUBSETS - 1).cast("long"))

    def code(terms):
        return F.when(F.size(terms) == 0, EMPTY).otherwise(F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(terms), F.lit(65535)) + 1), 4, "0")))

    def level(terms, k):
        own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: code(F.filter(terms, lambda h: subset(h) == j))), "")
        if k + 1 == LEVELS:
            return own
        rest = F.filter(terms, lambda h: F.shiftrightunsigned(h, 36 + 2 * k).bitwiseAND(F.lit(3).cast("long")) == 0)
        return F.concat(own, let(rest, lambda r: level(r, k + 1)))

    return let(F.array_sort(F.filter(term_hashes(text), inside)), lambda terms: level(terms, 0))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1: the share of equal subsets of those that hold terms of either.

    It is that of the best level with ENOUGH such subsets, else that of all levels
    together; without any term on either side the texts are alike.
    """

    def cell(f, j):
        return F.substring(f, j * 4 + 1, F.lit(4))

    def held(first, last):
        return F.filter(F.sequence(F.lit(first), F.lit(last)), lambda j: (cell(a, j) != EMPTY) | (cell(b, j) != EMPTY))

    def share(js):
        return F.size(F.filter(js, lambda j: cell(a, j) == cell(b, j))) / F.size(js)

    levels = [let(held(k * SUBSETS, (k + 1) * SUBSETS - 1), lambda js: F.when(F.size(js) >= ENOUGH, share(js))) for k in range(LEVELS)]
    overall = let(held(0, LEVELS * SUBSETS - 1), lambda js: F.when(F.size(js) > 0, share(js)).otherwise(F.lit(1.0)))
    return F.coalesce(F.greatest(*levels), overall)


def with_next(rows: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """rows (doc_id, tie, ...) with next_<column> of the next row by (doc_id, tie); after the last comes the first.

    Rows are dealt by ranges of doc_id, whose bounds are approximate quantiles, and
    each range also gets a copy of the row that begins the next one. So a window
    never holds more than a range, and one shuffle does for all.
    """
    first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    bounds = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000) if parts > 1 else F.lit(None)).first()[0]
    bounds = F.lit(sorted(set(bounds))) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("part", F.size(F.filter(bounds, lambda b: b <= first)))
    begins = rows.groupBy("part").agg(F.min(F.struct(first.alias("doc_id"), "tie")).alias("b")).orderBy("part").collect()
    if not begins:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("part")
    before = {begins[i]["part"]: begins[i - 1]["part"] for i in range(len(begins))}
    copy = F.create_map(*[F.lit(x) for r in begins for x in (r["part"], before[r["part"]])])
    starts = F.create_map(*[x for r in begins for x in (F.lit(r["part"]), F.struct(F.lit(r["b"]["doc_id"]).alias("doc_id"), F.lit(r["b"]["tie"]).alias("tie")))])
    copied = rows.where(F.struct(first.alias("doc_id"), F.col("tie")) == F.element_at(starts, F.col("part"))).withColumn("part", F.element_at(copy, F.col("part")))
    both = rows.withColumn("copy", F.lit(False)).unionByName(copied.withColumn("copy", F.lit(True)))
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").asc_nulls_first(), "tie")
    return both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("not copy").drop("part", "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fingerprint), one row per row of docs; null text is empty, and so is its fingerprint's every subset."""
    known = lexicon(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("fingerprint", fingerprint(F.col("text"), known))


def edited_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, fingerprint, edited, edited_fingerprint, near_edited, near_next), one row per row of docs.

    edited is text with its last quarter of code points, rounded down, replaced by as
    many of the next row's first, or all it has. The next row is that of the next
    doc_id, null first; rows that share one follow each other by a hash of their
    text. A sole row is its own next. Null text is empty.
    """
    known = lexicon(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"), known))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(rows, ["text", "fingerprint"], min(parts, 10_000))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    paired = paired.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))).drop("next_text")
    paired = paired.withColumn("edited_fingerprint", fingerprint(F.col("edited"), known))
    near = [likeness(F.col("fingerprint"), F.col(c)).cast("double").alias(a) for c, a in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return paired.select("doc_id", "text", "fingerprint", "edited", "edited_fingerprint", *near)
