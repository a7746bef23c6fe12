"""Benchmark passages, fill-in-middle and phrases against brute force, on edge cases, and when their bounds are small."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import decontaminate, fim, phrases

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Decontamination


def hits(text, items, window):
    """(words, words hit, item ids, hit words' places), by looking for every window at every word."""
    spans = [(m.start(), m.end()) for m in _WORD.finditer(lower(text))]
    words, hit, found = [lower(text)[a:b] for a, b in spans], set(), set()
    for item, t in items:
        own = _WORD.findall(lower(t))
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found), spans, hit


def made_up(rng, n_docs):
    vocabulary = ["a", "B2", "Ünï", "cat", "the", "x", "中文", "dog"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "\x00"]) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 3, 7, 9]))) for i in range(12)] + [(None, say(4)), (3, say(5)), (50, None), (51, "?!")]
    docs = [(i, say(rng.randrange(60)) + rng.choice(items)[1].__str__() + say(3)) for i in range(n_docs)] + [(None, "A b2"), (7, None), (8, ""), (8, "")]
    return items, docs


@pytest.mark.parametrize("most", [1000, 5])
def test_decontamination_against_every_window(spark, most):
    items, docs = made_up(random.Random(4), 40)
    table = spark.createDataFrame([(*d, 1, [2]) for d in docs], "doc_id long, text string, n_hit int, spans array<int>")
    got = decontaminate.scan(table, spark.createDataFrame(items, "item_id long, text string"), window=3, most=most).collect()
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t)
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in docs)
    for r in got:
        wanted = []
        for t in texts[r["doc_id"]]:
            n, n_hit, found, spans, hit = hits(t, items, 3)
            edges = [i for i in sorted(hit) if i - 1 not in hit], [i for i in sorted(hit) if i + 1 not in hit]
            wanted.append((n, n_hit, found, [(spans[a][0], spans[b][1]) for a, b in zip(*edges)]))
        assert (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) in wanted


def test_no_benchmark_and_no_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.scan(docs, items.limit(0)).collect()] == [(1, 2, 0, [], [])]
    assert decontaminate.scan(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in decontaminate.scan(docs, items).collect()] == [(1, 2, 2, ["1"], [(0, 3)])]


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 64), monkeypatch.setattr(decontaminate, "STRETCH", 5)
    rng = random.Random(9)
    words = [rng.choice("abc") for _ in range(3000)]
    wins = {" ".join(words[i : i + 10]) for i in range(500, 900)}
    n, n_hit, items, places = decontaminate.Scanner([("i", w) for w in wins]).scan(" ".join(words).encode())
    hit = {j for i in range(len(words) - 9) if " ".join(words[i : i + 10]) in wins for j in range(i, i + 10)}
    assert (n, n_hit, items) == (3000, len(hit), ["i"]) and sum((b - a + 1) // 2 for a, b in places) == len(hit)


# Fill-in-middle

_TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def filled(doc_id, text):
    text = text or ""
    tokens = _TOKEN.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    return len(tokens), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1 << 16, 5, 1])
def test_fill_in_middle_against_tokens(spark, chunk):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab", "P", "<", ">", "S", " ", "é", "中", "\U0001f600", "\n", "Mz"]) for _ in range(rng.randrange(40))) for _ in range(120)]
    docs = [*enumerate(texts), (1000, None), (None, "a b c"), (3, texts[3]), (1001, "x" * 300), (1002, "<<P><S" * 3), (1003, "\r\n<M>")]
    got = fim.transform(spark.createDataFrame([(*d, 5, "k") for d in docs], "doc_id long, text string, n int, cuts string"), chunk)
    got = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    rows = sorted([(str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"], r["cuts"]) for r in got], key=str)
    assert rows == sorted([(str(i), *filled(i, t), t or "", "k") for i, t in docs], key=str)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_functions_of_chunks_compose():
    rng = random.Random(8)
    for _ in range(300):
        classes = np.array([rng.randrange(5) for _ in range(rng.randrange(12))], np.uint8)
        whole = fim.chunk_function(classes)
        for entry in range(fim.STATES):
            state, count = entry, 0
            for c in classes:
                count += not (state in (1, 3, 5) and c in (1, 2))
                state = int(fim._STEP[state, c])
            assert (whole[0][entry], whole[1][entry]) == (state, count)
        at = rng.randrange(len(classes) + 1)
        parts = fim.compose(fim.chunk_function(classes[:at]), fim.chunk_function(classes[at:]))
        assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()


def test_fill_in_middle_of_nothing(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Phrases


def mined(docs, least, top, within=50):
    counts, totals = {}, {}
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] = totals.get(lang, 0) + len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least and not any(b >= least and 100 * b >= within * a and p in (q[:2], q[1:]) for (m, q), b in counts.items() if m == lang and len(q) == 3 and len(p) == 2):
            score, cut = min((10**6 * a * a // (counts[lang, p[:c]] * counts[lang, p[c:]]), c) for c in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]]))
    return sorted((lang, i, p.decode(), -a, left, r, totals[lang], -s) for lang, rows in found.items() for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize(("part", "pass_", "slices"), [(1 << 17, 1 << 22, None), (7, 21, 40)])
def test_phrases_against_counting(spark, monkeypatch, part, pass_, slices):
    rng = random.Random(2)
    vocabulary = ["the", "Of", "new", "york", "ünder", "中", " ", "q", "<b>", "a-b"]
    text = lambda: "".join(rng.choices(vocabulary, [9, 5, 3, 3, 2, 2, 1, 1, 1, 1])[0] + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", ""]) for _ in range(rng.randrange(120)))
    docs = [(rng.choice(["en", "de", None]), text()) for _ in range(60)] + [("fr", None), ("en", ""), ("it", "one two three"), ("und", "new york " * 30)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "lang string, text string, rank int").repartition(3)
    got = phrases.collocations(table, least=4, top=25, part=part, pass_=pass_)
    assert sorted(tuple(r) for r in got.collect()) == mined(docs, 4, 25)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).collect() == []


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    parts, built = 3, []
    for p in range(parts):
        own = keys[:, keys[1] % np.uint64(parts) == p]
        sizes, words, slots = phrases.build(*own)
        assert sorted(slots.tolist()) == list(range(own.shape[1]))
        stored = np.empty_like(own)
        stored[:, slots] = own
        built.append((p, sizes, words.tobytes(), stored.tobytes()))
    table = phrases.Slots(parts, built)
    assert sorted(table.find(keys).tolist()) == list(range(5000)) and (table.keys[:, table.find(keys)] == keys).all()
    assert (table.find(rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)) == -1).all()


def test_words_in_slices(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(5000)).encode() + b"\n. tail"
    whole = phrases.Numbers().of(text)
    monkeypatch.setattr(phrases, "SLICE", 100)
    assert (phrases.Numbers().of(text) == whole).all()
    monkeypatch.setattr(phrases, "WORDS", 64)
    parts = list(phrases._split("en", [whole]))
    assert sum(own for _, _, own in parts) == len(whole) and all(len(ids) <= own + 2 for _, ids, own in parts)


def test_phrases_take_two_passes(spark):
    """op13: texts are read once for their size and twice to count, however many candidates there are and however few a worker holds."""
    seen = spark.sparkContext.accumulator(0)

    def read(text: str) -> str:
        seen.add(1)
        return text

    rng = random.Random(4)
    table = spark.createDataFrame([("en", " ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=60))) for _ in range(40)], "lang string, text string")
    table = table.select("lang", F.udf(read, "string")("text").alias("text"))
    assert phrases.collocations(table, least=2, part=7, pass_=21).count() > 40
    assert seen.value <= 3 * 40


def test_tally_adds_up_by_both_halves():
    tally, rng = phrases.Tally(), np.random.default_rng(1)
    keys, want = rng.integers(0, 4, (2, 6000)).astype(np.uint64), {}
    for part in np.split(keys, 6, axis=1):
        new = tally.add(part)
        tally.phrases.append(("en", phrases.pa.array([f"{a} {b}" for a, b in part[:, new].T.tolist()])))
    for batch in tally.rows(5):
        for phrase, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            want[phrase] = want.get(phrase, 0) + n
    assert want == {f"{a} {b}": int(((keys[0] == a) & (keys[1] == b)).sum()) for a in range(4) for b in range(4)}
