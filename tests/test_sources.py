"""Readers, writers, streaming and translation on small files."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as t
from foliant.operators import translate
from foliant.sources import readers, sinks
from foliant.streaming import ingest


def test_files_and_ranges(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"hello world")
    (tmp_path / "b.md").write_text(" \n")
    row = readers.binary_files(spark, str(tmp_path), "*.pdf").select("*", readers.byte_range(F.col("content"), 6, 3).alias("part")).first()
    assert row["length"] == 11 and bytes(row["part"]) == b"wor" and row["md5"] == "5EB63BBBE01EEED093CB22BB8F5ACDC3"
    assert readers.text_files(spark, str(tmp_path)).first()["error"] == "no text"


def test_records_and_detections(spark, tmp_path):
    page = {"page_info": {"page_no": 0, "height": 10, "width": 10}, "layout_dets": [{"category_id": 1, "poly": [1, 2, 5, 2, 5, 8, 1, 8], "score": 0.5}, {"category_id": 2, "bbox": [0, 0, 3, 4], "score": 0.9}]}
    (tmp_path / "r.jsonl").write_text(json.dumps({"path": "s3://b/k", "bookid": "7", "doc_layout_result": [page]}) + "\n")
    r = readers.records(spark, str(tmp_path))
    assert r.select("location", "file_id").first() == ("s3://b/k", "7")
    got = [tuple(x) for x in readers.detections(r, "file_id").select("ord", "x0", "y0", "x1", "y1").orderBy("ord").collect()]
    assert got == [(1, 1, 2, 5, 8), (2, 0, 0, 3, 4)]


def test_json_round_trip(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert sinks.unpacked_json(sinks.packed_json(df, "doc_id", "text"), "doc_id long, text string").collect() == df.collect()


def test_stream_of_sessions(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00', 1.0D), (1, timestamp'2024-01-01 00:10:00', 2.0D), (1, timestamp'2024-01-02 00:00:00', 4.0D) AS t(user_id, ts, value)")
    df.write.parquet(str(tmp_path / "in"))
    query = ingest.sessions(ingest.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("s").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT n, value FROM s").collect()] == [(2, 3.0)]
    batch = ingest.per_batch(ingest.read_events(spark, str(tmp_path / "in")), lambda b: b.select("value"), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("value")).first()[0] == 7.0


def test_translation_keeps_what_fails(spark):
    def service(text):
        if "bad" in text:
            raise ValueError("no")
        return text.upper()

    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["errors"]) for r in translate.joined(translate.translate(translate.chunks(docs, 100), service)).collect()}
    assert got == {1: ("GOOD", 0), 2: ("bad", 1)}


@pytest.mark.parametrize("latex,want", [(r"x ^ { 2 } + y", r"x^{2}+y"), (r"\operatorname { s i n } x", r"\operatorname{sin}x"), (r"\mathrm { d } t", r"\mathrm{d}t")])
def test_latex(spark, latex, want):
    assert spark.createDataFrame([(latex,)], "s string").select(t.tidy_latex(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text", ["a\u0001b see https://x.org/a and https://y.org/b end", "<PH>URL_0</PH> and https://x.org", "no <b>mask</b> $x$ `y` ![i](p.png)", ""])
def test_masks_come_back(spark, text):
    masked = translate.mask(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert "https" not in masked.first()["text"] and "<b>" not in masked.first()["text"]
    assert translate.restore(masked).first()["text"] == text


def test_latex_against_rules_gone_through_until_nothing_changes(spark):
    import random
    import re

    def plain(s):
        group, other = r"(\\(?:operatorname|mathrm|text|mathbf)\s?\*? {.*?})", r"[\W_^\d]"
        s = re.sub(group, lambda m: m[0].replace(" ", ""), s)
        while True:
            before = s
            for left, right in ((rf"(?!\\ )({other})", f"({other})"), (rf"(?!\\ )({other})", "([a-zA-Z])"), ("([a-zA-Z])", f"({other})")):
                s = re.sub(left + r"\s+?" + right, r"\1\2", s)
            if s == before:
                return s

    rng = random.Random(1)
    parts = ["\\", " ", " ", " ", "a", "B", "1", "_", "^", "{", "}", ",", "é", "中", "\\mathrm {", "\\text", "\t", "\\, ", "\\ ", "   "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(3000)] + [r"\ A", r"\mathrm { d } x \, y", "", " . " * 50, "a" + " " * 99 + "b"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in texts], "s string").coalesce(1).select(t.tidy_latex(F.col("s"))).collect()]
    wrong = [(s, g, plain(s)) for s, g in zip(texts, got) if g != plain(s)]
    assert not wrong, wrong[:5]
    assert plain(r"\ A") == r"\ A" and plain(r"\mathrm { d } x \, y") == r"\mathrm{d}x\,y"
