"""Every operator on null, empty, long, tied and repeated rows, on no rows, and beside columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, fim, html_extract, imatch, langid, license_scan, line_dedup, mixing, packing, phrases, quality, simhash, suffix_dedup
from foliant.llm.queries import tokenizer_path

LONG = " ".join(f"w{i % 977}" for i in range(20_000))
TEXT = "The quick brown fox jumps over the lazy dog while seven other animals look on from the hill, and none of them says a word about it."
ROWS = [
    (1, TEXT, "en", "a"),
    (2, TEXT, "en", "a"),
    (2, TEXT, "en", "a"),
    (3, None, None, None),
    (None, TEXT + " more", "en", None),
    (None, None, "en", "b"),
    (4, "", "en", "b"),
    (5, " \n\t ", "de", "b"),
    (6, LONG, "en", "c"),
    (7, "a\nb\na", "de", "c"),
    (8, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (9, "中文 \U0001f600 x", None, "d"),
]
CLASHES = ["h1", "k1", "text_", "id", "cuts", "form", "items", "n", "rank", "row", "size", "fp", "draw", "target", "lines", "flags", "flag_id", "part", "tie", "copy", "slot", "epochs", "kept", "component_id", "stratum", "cutoffs", "spans", "words", "plan_source", "n_removed"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


def packed(spark, docs):
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def items(spark):
    return spark.createDataFrame([(1, TEXT[20:90]), (2, None), (None, "a b a"), (3, "")], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.scan(d, items(s)),
    "decontaminate_blocks": lambda s, d: decontaminate.scan(d, items(s), most=1),
    "fim": lambda s, d: fim.transform(d),
    "fim_chunks": lambda s, d: fim.transform(d, 64),
    "phrases": lambda s, d: phrases.collocations(d, 2),
    "mix": lambda s, d: mixing.mix(d),
    "repeat": lambda s, d: mixing.repeat(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "pack": packed,
    "license": lambda s, d: license_scan.scan(d),
    "simhash": lambda s, d: simhash.near_duplicates(d, 4, 4),
    "keep_one": lambda s, d: simhash.keep_one(d),
    "lang": lambda s, d: langid.identify(d, langid.learn(d)),
    "imatch": lambda s, d: imatch.edited_pairs(d, 3),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d),
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "keep_good": lambda s, d: quality.keep_good(d, labels(s)),
    "html": lambda s, d: html_extract.extract(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "row")),
}
ONE_PER_ROW = {"decontaminate", "decontaminate_blocks", "fim", "fim_chunks", "mix", "lines", "simhash", "lang", "imatch", "suffix", "quality", "html"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_messy_rows(spark, name):
    got = OPERATORS[name](spark, table(spark)).collect()
    if name in ONE_PER_ROW:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, table(spark).where(F.lit(False))).collect() == []


def test_results_of_messy_rows(spark):
    docs = table(spark)
    groups = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs, 4, 4).collect()]
    assert (2, 1) in groups and (4, 3) in groups and (5, 3) in groups and (None, 3) in groups
    assert sum(r["doc_id"] == 1 for r in simhash.keep_one(docs).collect()) == 1
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels(spark)).collect()}
    assert judged[4]["base_failed"] and judged[3]["n_words"] == 0 and not judged[6]["n_symbols"]
    langs = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert langs[3]["lang_pred"] == "und" and langs[4]["score"] == 0.0 and langs[1]["lang_pred"] in ("de", "en")
    cut = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect() if r["doc_id"]}
    assert cut[7]["text"] == "a\nb" and cut[3]["text"] is None and cut[5]["text"] == " \n\t "
    bytes_ = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert bytes_[3]["n_bytes"] == 0 and bytes_[2]["kept"] == b"" and bytes_[1]["kept"] == b""
    found = license_scan.scan(docs).collect()
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in found] == [(8, "Apache-2.0-notice", 1.0)]
    pieces = packed(spark, docs).collect()
    assert sum(r["doc_id"] == 3 for r in pieces) == 1 and max(r["length"] for r in pieces) == 2048
    assert html_extract.main_text(None) == "" and html_extract.main_text("<p") == ""
