"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that the rules below look for.
CITATION = r"^\[?\d+(?:\s*[-,–]\s*\d+)*\]?$|^[a-z]\s*-\s*[a-z]$"
NUMBERED = r"^(?:第[一二三四五六七八九十]+[章节]|[一二三四五六七八九十]+、|\d+(?:\.\d+)*[.、)\s]|[IVXLC]+\.|\(\d+\)|[A-Z]\.|[a-z]\))"
FIGURE = r"^(?:fig|figure|scheme)"
TABLE = r"^table\s*\d+|^表"
GARBLED = r"\(cid:\d+\)"
#: Bits of a font's flags.
FONT_FLAGS = {"superscript": 0, "italic": 1, "serif": 2, "monospaced": 3, "bold": 4}


def upper_md5(data: Column) -> Column:
    return F.upper(F.md5(data))


def escape_markdown(text: Column) -> Column:
    """text with the marks of emphasis, code, strike-through and formulas escaped."""
    for mark in ("*", "`", "~", "$"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))


def latin_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z]"))


def chinese_or_english(text: Column) -> Column:
    """zh or en by which letters are more; null if as many."""
    zh, en = cjk_count(text), latin_count(text)
    return F.when(zh > en, "zh").when(en > zh, "en")


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.regexp_replace(p, "/+$", "") for p in parts])


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def is_citation(text: Column) -> Column:
    """A mark such as [2-3], 2,3 or a-b."""
    return F.btrim(text, F.lit(" \t")).rlike(CITATION)


def remove_citations(text: Column) -> Column:
    """text without bracketed citation numbers after a word or a stop."""
    return F.regexp_replace(text, r"(\w[.,;]?)\s?\[\d+(?:\s*[-,]\s*\d+)*\]", "$1")


def font_flag(flags: Column, name: str) -> Column:
    return F.getbit(flags, F.lit(FONT_FLAGS[name])) == 1


def rgb(colour: Column) -> Column:
    """r, g and b of a colour in one number."""
    at = lambda shift: F.shiftright(colour, shift).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(at(16).alias("r"), at(8).alias("g"), at(0).alias("b"))


def is_white(colour: Column) -> Column:
    return colour == 0xFFFFFF


#: Groups that lose their spaces, and the characters beside which spaces go: all but letters and numerals other than digits.
OPERATOR = r"\\(?:operatorname|mathrm|text|mathbf)\s?\*? \{.*?\}"
NO_LETTER = r"[^\p{L}\p{Nl}\p{No}]"


def tidy_latex(text: Column) -> Column:
    r"""LaTeX without the spaces that a recogniser leaves between tokens.

    A group that names an operator or a font loses its spaces, if one stands before
    its brace. Then white space goes that is between two of the characters of
    NO_LETTER, or between one and an ASCII letter, but for the space of `\ `. White
    space counts as such a character itself, so that of a longer run one is left
    between letters, and two between other letters.

    This is what the rules come to when they are gone through until nothing changes:
    runs, but for a first space after a backslash, are first cut to two, which leaves as much, and places are looked at without
    taking up the character after them, so a pass settles every one of its run; the
    second pass settles runs of two, the third what a settled run was beside.
    """
    groups, pieces = F.regexp_extract_all(text, F.lit(OPERATOR), F.lit(0)), F.split(text, OPERATOR, -1)
    text = F.array_join(F.zip_with(pieces, groups, lambda p, x: F.concat(p, F.coalesce(F.replace(x, F.lit(" "), F.lit("")), F.lit("")))), "")
    text = F.regexp_replace(text, r"(?U)(?<!\\)(\s)\s+(\s)", "$1$2")
    for _ in range(3):
        for before, after in ((rf"(?!\\ )({NO_LETTER})", NO_LETTER), (rf"(?!\\ )({NO_LETTER})", "[a-zA-Z]"), ("([a-zA-Z])", NO_LETTER)):
            text = F.regexp_replace(text, rf"(?U){before}\s+?(?={after})", "$1")
    return text


def is_numbered_title(text: Column) -> Column:
    return text.rlike(NUMBERED)


def is_figure_caption(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(" \t\n"))).rlike(FIGURE)


def is_table_caption(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(" \t\n"))).rlike(TABLE)


def punctuation_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{Punct}]")) / F.greatest(F.char_length(text), F.lit(1))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the prefix that two strings share."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i))
    return F.when(n == 0, 0).otherwise(F.size(same))


def alike_fonts(a: Column, b: Column, share: float = 0.3) -> Column:
    return common_prefix(a, b) >= F.floor(F.least(F.char_length(a), F.char_length(b)) * share)


def garbled_share(text: Column) -> Column:
    """Share of undecoded glyphs among a text's characters, a glyph counting as one."""
    glyphs = F.regexp_count(text, F.lit(GARBLED))
    rest = F.char_length(F.regexp_replace(text, GARBLED, ""))
    return glyphs / F.greatest(glyphs + rest, F.lit(1))


def span_text(content: Column, image_path: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), image_path, F.lit(""))


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd-HH:mm:ss")


def long_words(text: Column, least: int = 16) -> Column:
    """The words of text that are long enough to be several run together."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.char_length(w) >= least)


def s3_parts(path: Column) -> Column:
    """bucket, key, offset and length of s3://bucket/key?bytes=offset,length; the last two are null without a range."""
    one = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    return F.struct(
        one(r"^s3[an]?://([^/]+)").alias("bucket"),
        one(r"^s3[an]?://[^/]+/([^?]*)").alias("key"),
        one(r"\?bytes=(\d+),\d+").cast("long").alias("offset"),
        one(r"\?bytes=\d+,(\d+)").cast("long").alias("length"),
    )


def crop_name(doc_md5: Column, kind: str, page: Column, box: list[Column]) -> Column:
    """Name of the image that a box is cropped to."""
    name = F.concat_ws("_", page.cast("string"), *[F.floor(c).cast("int").cast("string") for c in box])
    return F.concat(F.sha2(F.concat_ws("/", doc_md5, F.lit(kind), name), 256), F.lit(".jpg"))
