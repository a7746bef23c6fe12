"""Fill-in-middle: texts cut at tokens and put in another order, with the cuts found by a parallel scan of an automaton.

A token is a run of ASCII letters or one other character. The automaton over code
points tells where tokens start and whether a marker occurs. A chunk of text gives,
for each state that it may be entered in, the state it is left in and the tokens
that start in it. These functions compose, and composition is associative, so chunks
are scanned apart, their functions are folded into the state that each is entered in
and the tokens before it, and only the chunks with a cut are looked into once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

#: Code points of a chunk; the chunks of longer texts are dealt over tasks.
CHUNK = 1 << 16
#: Shares in per cent: documents that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

#: States: at the start or after any character but a letter (0), after a letter (1), "<" (2), "<P", "<S" or "<M" (3); a marker was found, and the last is no letter (4) or one (5).
STATES, FOUND = 6, 4
_IN_LETTERS = np.array([False, True, False, True, False, True])
#: The state after each, by classes: other (0), letter (1), P, S or M (2), "<" (3), ">" (4).
_STEP = np.array([[0, 1, 1, 2, 0], [0, 1, 1, 2, 0], [0, 1, 3, 2, 0], [0, 1, 1, 2, 4], [4, 5, 5, 4, 4], [4, 5, 5, 4, 4]])
_CLASS = np.zeros(128, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[ord(c) for c in "PSM"]] = 2
_CLASS[ord("<")], _CLASS[ord(">")] = 3, 4

#: The states that a chunk is left in and the tokens that start in it, by the state that it is entered in.
Function = tuple[np.ndarray, np.ndarray]


def classes_of(text: bytes) -> np.ndarray:
    """The class of each code point of a UTF-8 text."""
    raw = np.frombuffer(text, np.uint8)
    first = raw[(raw & 0xC0) != 0x80]
    return np.where(first < 128, _CLASS[first & 127], 0).astype(np.uint8)


def starts_of(classes: np.ndarray, in_letters: bool) -> np.ndarray:
    """Whether a token starts at each character of a chunk that is entered after a letter or not."""
    letter = (classes == 1) | (classes == 2)
    return ~(letter & np.concatenate(([in_letters], letter[:-1])))


def chunk_function(classes: np.ndarray) -> Function:
    """The function of one chunk.

    What the first two characters leave depends on the entry only by whether a
    marker was found, so each state is led through these two, and the rest, with
    all markers that begin in the chunk, is scanned once for all states.
    """
    exits, counts = np.arange(STATES), np.zeros(STATES, np.int64)
    for c in classes[:2]:
        counts += ~(_IN_LETTERS[exits] & (c in (1, 2)))
        exits = _STEP[exits, c]
    if len(classes) > 2:
        counts += int(starts_of(classes, False)[2:].sum())
        marked = ((classes[:-2] == 3) & (classes[1:-1] == 2) & (classes[2:] == 4)).any()
        last = _STEP[_STEP[0, classes[-2]], classes[-1]]
        exits = np.where((exits >= FOUND) | marked, FOUND + int(_IN_LETTERS[last]), last)
    return exits, counts


def compose(first: Function, then: Function) -> Function:
    """The function of two pieces of text, one after the other."""
    return then[0][first[0]], first[1] + then[1][first[0]]


def entries(functions: list[Function]) -> tuple[list[tuple[int, int]], tuple[int, int]]:
    """(state, tokens before) that each chunk is entered with, and those after the last, from the start of a text."""
    at, done = (np.arange(STATES), np.zeros(STATES, np.int64)), []
    for f in functions:
        done.append((int(at[0][0]), int(at[1][0])))
        at = compose(at, f)
    return done, (int(at[0][0]), int(at[1][0]))


def cut_tokens(h1: int, h2: int, n: int) -> tuple[int, int]:
    return tuple(sorted((h1 % (n + 1), h2 % (n + 1))))


def cuts_of(text: bytes, h1: int, h2: int) -> tuple[int, bool, int, int]:
    """(tokens, whether a marker occurs, code points before the first cut, before the second) of a text of one chunk."""
    classes = classes_of(text)
    _, (state, n) = entries([chunk_function(classes)])
    starts = np.append(np.flatnonzero(starts_of(classes, False)), len(classes))
    first, second = cut_tokens(h1, h2, n)
    return n, state >= FOUND, int(starts[first]), int(starts[second])


CUTS = "struct<n: long, marked: boolean, first: long, second: long>"
_CUTS = pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("first", pa.int64()), ("second", pa.int64())])
_FUNCTION = "id long, pos int, exits array<int>, counts array<long>"


def _local_cuts(text: Column, h1: Column, h2: Column) -> Column:
    @F.arrow_udf(CUTS)
    def cut(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        found = [cuts_of(t or b"", a, b) for t, a, b in zip(texts.cast(pa.binary()).to_pylist(), firsts.to_pylist(), seconds.to_pylist())]
        return pa.array([dict(zip(("n", "marked", "first", "second"), x)) for x in found], _CUTS)

    return cut(text, h1, h2)


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of each chunk (id, pos, chunk)."""
    for batch in batches:
        found = [chunk_function(classes_of(c)) for c in batch.column(2).cast(pa.binary()).to_pylist()]
        exits, counts = ([f[i].tolist() for f in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "pos", "exits", "counts"])


_FOLDED = "id long, n long, marked boolean, picks array<struct<pos: int, state: int, token: long>>"
_PICKS = pa.list_(pa.struct([("pos", pa.int32()), ("state", pa.int32()), ("token", pa.int64())]))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (id, h1, h2, chunks in order): its tokens, and for both cuts the chunk, the state it is entered in and the token within it."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            at, (state, n) = entries([(np.array(c["exits"]), np.array(c["counts"])) for c in r["chunks"]])
            before = [b for _, b in at]
            picks = []
            for token in cut_tokens(r["h1"], r["h2"], n):
                pos = int(np.searchsorted(before, token, "right")) - 1
                picks.append({"pos": pos, "state": at[pos][0], "token": token - before[pos]})
            rows.append((r["id"], n, state >= FOUND, picks))
        ids, ns, marks, picked = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(marks, pa.bool_()), pa.array(picked, _PICKS)], names=["id", "n", "marked", "picks"])


def _offset(chunk: Column, pick: Column, size: int) -> Column:
    """Code points before the picked token, from the start of the text; a token beyond the chunk's last starts where the chunk ends."""

    @F.arrow_udf("long")
    def select(chunks: pa.Array, states: pa.Array, tokens: pa.Array) -> pa.Array:
        found = []
        for c, state, token in zip(chunks.cast(pa.binary()).to_pylist(), states.to_pylist(), tokens.to_pylist()):
            classes = classes_of(c)
            found.append(int(np.append(np.flatnonzero(starts_of(classes, bool(_IN_LETTERS[state]))), len(classes))[token]))
        return pa.array(found, pa.int64())

    return pick["pos"].cast("long") * size + select(chunk, pick["state"], pick["token"])


def _dealt_cuts(giants: DataFrame, size: int) -> DataFrame:
    """giants (row, text, h1, h2) with cuts, each text's chunks being scanned in tasks of their own."""
    giants = materialise(giants.withColumn("id", F.monotonically_increasing_id()), "giants")
    chunks = giants.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("pos", "chunk"))
    functions = chunks.repartition("id", "pos").mapInArrow(_functions, _FUNCTION)
    listed = functions.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "exits", "counts"))).alias("chunks"))
    folded = giants.select("id", "h1", "h2").join(listed, "id").select("id", "h1", "h2", "chunks").mapInArrow(_fold, _FOLDED)
    both = giants.join(folded, "id")
    chunk_of = lambda pick: F.substring("text", pick["pos"] * size + 1, F.lit(size))
    first, second = (_offset(chunk_of(F.col("picks")[i]), F.col("picks")[i], size) for i in (0, 1))
    return both.select("row", "text", "h3", "h4", F.struct("n", "marked", first.alias("first"), second.alias("second")).alias("cuts"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: the three parts between the markers, in their first order."""
    return F.when(form == "plain", output).otherwise(_parts(F.split(output, "<[PSM]>", -1), form))


def _parts(parts: Column, form: Column) -> Column:
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def transform(docs: DataFrame, chunk: int = CHUNK, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs' columns but text, with n, form, prefix_chars, middle_chars and output of each whole text.

    n counts the tokens of the text (null: empty). Four draws of a document are the
    first four 8-digit groups of the hex SHA-256 of "1:" and its decimal doc_id (a
    null one: nothing), so reruns agree. The prefix ends after the smaller of draw 1
    and draw 2 modulo n + 1 tokens, the middle after the larger. An empty text, one
    that contains a marker, and `plain` per cent of the others stay as they are, in
    form plain, with null prefix_chars and middle_chars; of the rest `suffix_first`
    per cent get form spm and the others psm. As no text of these forms contains a
    marker, restore() gets the exact text back.

    Texts of up to `chunk` code points are worked on where they are read, with no
    shuffle. The chunks of longer ones are scanned by tasks of their own, at some
    hundred bytes a chunk to be folded by text. Repeated rows are worked on row by
    row; columns of docs with the new names are replaced; no rows give no rows.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "n", "form", "prefix_chars", "middle_chars", "output")]
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *draws)
    short, giant = F.char_length("text") <= chunk, F.char_length("text") > chunk
    near = rows.where(short).select("row", "text", "h3", "h4", _local_cuts(F.col("text"), F.col("h1"), F.col("h2")).alias("cuts"))
    cut = near.unionByName(_dealt_cuts(rows.where(giant), chunk))
    stays = (F.col("text") == "") | F.col("cuts.marked") | (F.col("h3") % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.select("row", "text", "cuts", form.alias("form"))
    first, second = F.col("cuts.first").cast("int"), F.col("cuts.second").cast("int")
    prefix, middle = F.substring("text", F.lit(1), first), F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.lit((1 << 31) - 1))
    psm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle)
    spm = F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    kept = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select(
        "row.*", F.col("cuts.n").alias("n"), "form", kept(F.col("cuts.first")).alias("prefix_chars"),
        kept(F.col("cuts.second") - F.col("cuts.first")).alias("middle_chars"), output.alias("output"),
    )


#: DuckDB SQL of op12's contract; the exact round trip is stated by the text itself.
ORACLE_SQL = r"""
WITH tokens AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS k, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), draws AS (
    SELECT doc_id, t, k, len(k) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM tokens
), cuts AS (
    SELECT doc_id, t, k, n, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM draws
), parts AS (
    SELECT doc_id, t, n, form, coalesce(array_to_string(list_slice(k, 1, c1), ''), '') AS p, coalesce(array_to_string(list_slice(k, c1 + 1, c2), ''), '') AS m,
        coalesce(array_to_string(list_slice(k, c2 + 1, n), ''), '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
