"""Quality rules whose cutoffs come with a guarantee, with DataFrame functions only.

A rule rejects a document whose score is above the cutoff of the document's
stratum. Labelled documents are the holdout: for a stratum, a rule and a cutoff,
the good documents that the rule would reject are a binomial count, and the cutoff
is safe if so few would be seen with a probability of at most ERROR / tests, were
the true rate of false rejection above RISK / rules. Cutoffs are tested from the
mildest to the strictest, up to the first that fails, so that only rules and
strata count as tests (Bonferroni). Then, with a confidence of 1 - ERROR, no
stratum loses more than RISK of its good documents to the rules together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, let, materialise, text_words

RISK = 0.03
ERROR = 0.05
#: Successes up to which all terms of a binomial tail are added, from the first one on.
ALL_TERMS = 1000

#: Scores are whole numbers; a rule's cutoffs in the order from strict to mild.
RULES: dict[str, tuple[int, ...]] = {
    "symbols": (10, 20, 50, 100, 150, 200, 300, 500, 700, 1000, 1500, 2000),
    "duplicate_lines": (1, 2, 5, 10, 15, 20, 30, 40, 60, 80, 100, 150),
    "repeated_words": (25, 50, 75, 100, 150, 200, 250, 300, 350, 400, 450, 475),
    "word_length": (5500, 5750, 6000, 6250, 6500, 6750, 7000, 7500, 8000, 9000, 12000, 20000),
}


def score(rule: str, n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column) -> Column:
    """A rule's score: a count per 1000 words, rounded down."""
    count = {"symbols": n_symbols, "duplicate_lines": n_dup_lines, "repeated_words": n_repeat_words, "word_length": word_chars}[rule]
    return F.floor(F.lit(1000) * count / F.greatest(n_words, F.lit(1))).cast("long")


def _repeated_words(words: Column) -> Column:
    """Number of words in windows of three that occur twice or more, of an array of words.

    Windows are compared by a 64-bit hash. If all differ, that is settled by a hash
    set; else equal ones meet by sorting, and the words they cover are counted once.
    """

    def window(i):
        return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(hashes):
        def at_twins(s):
            twin = lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(twin(e, k), F.get(s, k - 1)["h"] == e["h"], F.get(s, k + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        add = lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"), (i + 3).alias("end"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.aggregate(let(pairs, at_twins), start, add, lambda acc: acc["n"]))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, covered))


def features(docs: DataFrame) -> DataFrame:
    """docs' doc_id and lang with the base counts of each row's text, and base_failed.

    Null text has no words and no lines, and fails; an empty one does too.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = let(
        text_words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select("doc_id", "lang", counts.alias("c"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    counted = counted.select("doc_id", "lang", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _scores() -> list[Column]:
    cols = [F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return [score(rule, *cols) for rule in RULES]


def _log_mass(n: Column, k: Column, p: float) -> Column:
    """Logarithm of the probability of k successes in n tries, for large k and n - k, by Stirling's series in a form without cancellation."""

    def rest(x):
        return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)

    def deviance(x, mean):
        return x * F.log1p((x - mean) / mean) + mean - x

    n, k = n.cast("double"), k.cast("double")
    spread = F.log(n / (2 * math.pi * k * (n - k))) / 2
    return spread + rest(n) - rest(k) - rest(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p))


def log_tail(n: Column, k: Column, p: float) -> Column:
    """Logarithm of the probability of k successes or fewer in n tries at p each; k is below n * p if over ALL_TERMS.

    Terms follow from one another, and are added as logarithms, so that nothing
    underflows. Up to ALL_TERMS they start from 0 successes; beyond, they go down
    from k, and 10 * sqrt(k) of them are added: the term t below that of k is at most
    exp(-t * (t - 1) / 2k) of it, so the rest is below the precision of a DOUBLE.
    """
    odds = F.log(F.lit(p / (1 - p)))

    def add(acc, term):
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    def tail(first, terms, ratio):
        return F.aggregate(terms, F.struct(first.alias("term"), first.alias("total")), lambda acc, i: add(acc, acc["term"] + ratio(i)), lambda acc: acc["total"])

    terms = F.when(k > 0, F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    up = tail(n * F.log(F.lit(1 - p)), terms, lambda i: F.log((n - i) / (i + 1)) + odds)
    down = tail(_log_mass(n, k, p), F.sequence(F.lit(0).cast("long"), F.least(k - 1, F.ceil(10 * F.sqrt(k)))), lambda t: F.log((k - t) / (n - k + t + 1)) - odds)
    return F.when(k <= ALL_TERMS, up).otherwise(down)


def safe_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, cutoffs): a map from rule to its strictest safe cutoff, for strata that have any.

    counted is from features(); a stratum is a lang, and null is one too. A document
    is good if none of its labels has another quality than 1. Documents that fail
    the base rules do not count, as these reject them whatever the cutoffs.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counted.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").withColumnRenamed("lang", "stratum")
    rows = held.select("stratum", *[s.alias(f"s{i}") for i, s in enumerate(_scores())])
    grids = F.array(*[F.array(*[F.lit(c).cast("long") for c in grid]) for grid in RULES.values()])
    scored = rows.select("stratum", F.posexplode(F.array(*[f"s{i}" for i in range(len(RULES))])).alias("rule", "score"))
    above = F.size(F.filter(F.get(grids, F.col("rule")), lambda c: c < F.col("score")))
    levels = scored.groupBy("stratum", "rule", above.alias("above")).count()
    # one row per stratum and rule from here on
    sums = levels.groupBy("stratum", "rule").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("above", "count"))).alias("by"))
    width = len(next(iter(RULES.values())))
    rejected = lambda j: F.aggregate(F.sequence(j + 1, F.lit(width)), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(F.element_at("by", b), F.lit(0)))
    tests = F.count(F.lit(1)).over(Window.partitionBy())
    p = risk / len(RULES)
    sums = sums.withColumn("limit", F.log(F.lit(error) / tests))
    cut = sums.select("stratum", "rule", "n", "limit", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("j"), "by").withColumn("k", rejected(F.col("j")))
    passes = F.when(F.col("k") >= F.col("n") * p, False).otherwise(log_tail(F.col("n"), F.col("k"), p) <= F.col("limit"))
    cut = cut.withColumn("passes", passes)
    worst = cut.groupBy("stratum", "rule").agg(F.coalesce(F.max(F.when(~F.col("passes"), F.col("j"))), F.lit(-1)).alias("failed"))
    chosen = worst.where(F.col("failed") < width - 1)
    value = F.get(F.get(grids, F.col("rule")), F.col("failed") + 1)
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", value))).alias("cutoffs"))


def verdicts(counted: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """counted with kept: false if base_failed or if a rule's score is above its stratum's cutoff."""
    cutoffs = materialise(cutoffs, "cutoffs")
    known = join_small(counted, cutoffs, "lang", "stratum", "left")
    rejects = [F.coalesce(s > F.element_at("cutoffs", F.lit(i)), F.lit(False)) for i, s in enumerate(_scores())]
    broken = F.col("base_failed")
    for r in rejects:
        broken = broken | r
    return known.withColumn("kept", ~broken).drop("cutoffs")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, base counts, base_failed, kept), one row per row of docs.

    Rows that share a doc_id share its labels; a null doc_id has none. Without
    labels, or too few for a guarantee, only the base rules reject.
    """
    counted = materialise(features(docs), "features")
    return verdicts(counted, safe_cutoffs(counted, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, in docs' columns.

    Texts are counted once for the cutoffs and once beside their row, instead of
    being shuffled to their verdict.
    """
    cutoffs = safe_cutoffs(materialise(features(docs), "features"), labels)
    rows = docs.withColumn("doc_id", F.struct("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row")))
    counted = features(rows.select("doc_id", "lang", "text"))
    # explode() keeps the optimiser from putting the counts once more into the filter on verdicts
    once = counted.select(F.explode(F.array(F.struct(*counted.columns))).alias("c")).select("c.*")
    known = once.select(F.col("doc_id.row").alias("row"), *[c for c in counted.columns if c != "doc_id"])
    kept = verdicts(known, cutoffs).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    values = [f"({i}, {j}, {c})" for i, grid in enumerate(RULES.values()) for j, c in enumerate(grid)]
    counts = {"symbols": "n_symbols", "duplicate_lines": "n_dup_lines", "repeated_words": "n_repeat_words", "word_length": "word_chars"}
    scores = " UNION ALL ".join(f"SELECT doc_id, lang, {i} AS rule, CAST(floor(1000 * {counts[r]} / greatest(n_words, 1)) AS BIGINT) AS score FROM base WHERE NOT base_failed" for i, r in enumerate(RULES))
    p, width = RISK / len(RULES), len(next(iter(RULES.values())))
    return rf"""
WITH worded AS (
    SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
twins AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twins, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
counted AS (
    SELECT x.doc_id, lang, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
             - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words
    FROM worded x LEFT JOIN covered c ON x.doc_id = c.doc_id),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
scores AS ({scores}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT s.* FROM scores s JOIN good USING (doc_id)),
grid(rule, j, cutoff) AS (VALUES {", ".join(values)}),
sums AS (SELECT lang, rule, count(*) AS n FROM held GROUP BY lang, rule),
cuts AS (
    SELECT s.lang, s.rule, s.n, g.j, g.cutoff, (SELECT count(*) FROM sums) AS tests,
           (SELECT count(*) FROM held h WHERE h.lang IS NOT DISTINCT FROM s.lang AND h.rule = s.rule AND h.score > g.cutoff) AS k
    FROM sums s JOIN grid g ON g.rule = s.rule),
tested AS (
    SELECT *, k < n * {p} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p})))
                               FROM range(0, k + 1) AS t(i)) <= {ERROR} / tests AS passes
    FROM cuts),
chosen AS (
    SELECT c.lang, c.rule, c.cutoff FROM tested c
    JOIN (SELECT lang, rule, coalesce(max(j) FILTER (NOT passes), -1) AS failed FROM tested GROUP BY lang, rule) f
      ON f.lang IS NOT DISTINCT FROM c.lang AND f.rule = c.rule AND c.j = f.failed + 1),
rejected AS (
    SELECT DISTINCT s.doc_id FROM scores s JOIN chosen c ON c.lang IS NOT DISTINCT FROM s.lang AND c.rule = s.rule WHERE s.score > c.cutoff)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM base
"""


ORACLE_SQL = _oracle()
