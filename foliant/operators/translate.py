"""Masking, chunking, translating and restoring of markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is not to be translated, in the order in which it is masked.
MASKS = (
    ("MARK", r"</?PH>"),
    ("HTML", r"<(?!/?PH>)[^<>]+>"),
    ("YAML", r"\A---\n[\s\S]*?\n---\n"),
    ("COMMENT", r"<!--[\s\S]*?-->"),
    ("CODE", r"```[\s\S]*?```"),
    ("TABLE", r"(?m)^\|[^\n]*\|$(?:\n\|[^\n]*\|$)*"),
    ("DISPLAY", r"\$\$[\s\S]+?\$\$"),
    ("INLINE", r"\$[^$\n]+\$"),
    ("INLINECODE", r"`[^`\n]+`"),
    ("IMAGE", r"!\[[^\]]*\]\([^)]*\)"),
    ("URL", r"https?://[^\s)<>]+"),
)


def mask(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with masked text, and masks: what was taken out, as (placeholder, original) in order.

    A placeholder names its kind and its number within the document, so runs agree.
    """
    empty = F.array().cast("array<struct<placeholder:string,original:string>>")
    state = F.struct(F.col("text").alias("text"), empty.alias("masks"))
    for kind, pattern in MASKS:
        state = _once(state, _masking(kind, pattern))
    return docs.withColumn("_state", state).withColumn("text", F.col("_state.text")).withColumn("masks", F.col("_state.masks")).drop("_state")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _masking(kind: str, pattern: str) -> Callable[[Column], Column]:
    return lambda s: _masked(s["text"], s["masks"], kind, pattern)


def _masked(text: Column, masks: Column, kind: str, pattern: str) -> Column:
    name = lambda i: F.concat(F.lit(f"<PH>{kind}_"), i.cast("string"), F.lit("</PH>"))

    def replaced(found):
        parts = F.split(text, pattern)  # as many as finds, and one more
        numbered = F.transform(parts, lambda p, i: F.when(i < F.size(found), F.concat(p, name(i))).otherwise(p))
        new = F.transform(found, lambda x, i: F.struct(name(i).alias("placeholder"), x.alias("original")))
        return F.struct(F.when(F.size(found) > 0, F.array_join(numbered, "")).otherwise(text).alias("text"), F.concat(masks, new).alias("masks"))

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replaced)


def restore(masked: DataFrame) -> DataFrame:
    """masked with its placeholders replaced again, the last first, so that masks within masks come back."""
    back = F.aggregate(F.reverse("masks"), F.col("text"), lambda acc, m: F.replace(acc, m["placeholder"], m["original"]))
    return masked.withColumn("text", back)


def token_count(text: Column) -> Column:
    """About as many tokens as a text has: one for four characters."""
    return F.ceil(F.char_length(text) / 4).cast("int")


def chunk_size(tokens: Column, most: int) -> Column:
    """Tokens to a chunk, if a text is dealt evenly over as few chunks of at most `most` as hold it."""
    chunks = F.greatest(F.ceil(tokens / most), F.lit(1))
    return F.floor(tokens / chunks + F.ceil((tokens % most) / chunks)).cast("int")


#: Where a text may be cut, in order of preference: before headings, after blank lines, after sentences.
CUTS = (r"(?m)(?=^#{1,6} )", r"(?<=\n\n)", r"(?<=[.!?。！？])(?=\s)")


def chunks(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, chunk_idx, chunk): texts in pieces of about `most` tokens, which joined give the text again.

    Parts are cut at headings, then blank lines, then sentence ends, and gathered
    until the next would make a chunk longer than most.
    """
    parts = F.flatten(F.transform(F.split("text", CUTS[0]), lambda a: F.flatten(F.transform(F.split(a, CUTS[1]), lambda b: F.split(b, CUTS[2])))))

    def gather(acc, part):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (token_count(F.concat(last, part)) <= most)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, part)))).otherwise(F.concat(acc, F.array(part)))

    gathered = F.aggregate(parts, F.array().cast("array<string>"), gather)
    return docs.select("doc_id", F.posexplode(F.filter(gathered, lambda c: c != "")).alias("chunk_idx", "chunk"))


def translate(chunked: DataFrame, translator: Callable[[str], str] = lambda text: text, attempts: int = 5) -> DataFrame:
    """chunked with translated and error. A translator that raises is asked again; then error says why.

    The default gives the text back: a service is for the caller to plug in.
    """

    def ask(text: str) -> tuple[str | None, str | None]:
        for k in range(attempts):
            try:
                return translator(text), None
            except Exception as e:  # noqa: BLE001  a service's failure is a value here
                failed = f"{type(e).__name__}: {e}"
        return None, failed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [ask(c) for c in batch["chunk"]]
            yield batch.assign(translated=[a for a, _ in answers], error=[e for _, e in answers])

    return chunked.mapInPandas(run, "doc_id long, chunk_idx int, chunk string, translated string, error string")


def joined(translated: DataFrame) -> DataFrame:
    """(doc_id, text, errors): chunks in order, and how many failed; those keep their own text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", F.coalesce("translated", "chunk").alias("c")))), lambda s: s["c"])
    return translated.groupBy("doc_id").agg(F.array_join(parts, "").alias("text"), F.count("error").alias("errors"))
