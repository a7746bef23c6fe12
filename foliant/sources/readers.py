"""Readers: files, byte ranges, records and page models, from any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

MODEL_PAGES = "array<struct<page_info: struct<page_no: int, height: int, width: int>, layout_dets: array<struct<category_id: int, poly: array<double>, bbox: array<double>, score: double, latex: string, html: string, text: string>>>>"


def binary_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, content, md5): whole files, by name pattern; md5 in upper case names a document."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return read.load(path).select("path", "length", "content", t.upper_md5(F.col("content")).alias("md5"))


def text_files(spark: SparkSession, path: str, charset: str = "UTF-8", pattern: str = "*.md") -> DataFrame:
    """(path, text, error): whole texts; one of white space has an error. Spark lists no files without bytes."""
    files = binary_files(spark, path, pattern)
    files = files.select("path", F.decode("content", charset).alias("text"))
    return files.withColumn("error", F.when(~F.col("text").rlike(r"\S"), "no text"))


def byte_range(content: Column, offset: int, length: int | None = None) -> Column:
    """Bytes of a file's content from an offset on; the second number is a length."""
    return F.substring(content, offset + 1, length if length is not None else 2**31 - 1)


def listing(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, length): files below a path, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").orderBy("path")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(location, file_id, source, pdf_type, pages) of JSON lines, whichever of their names the fields have."""
    schema = f"file_location string, path string, file_id string, bookid string, original_file_id string, data_source string, file_source string, _pdf_type string, doc_layout_result {MODEL_PAGES}"
    r = spark.read.schema(schema).json(path)
    return r.select(
        F.coalesce("file_location", "path").alias("location"),
        F.coalesce("file_id", "original_file_id", "bookid").alias("file_id"),
        F.coalesce("data_source", "file_source").alias("source"),
        F.col("_pdf_type").alias("pdf_type"),
        F.col("doc_layout_result").alias("pages"),
    )


def model_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, pages) of files that hold a JSON list of pages each."""
    page = MODEL_PAGES.removeprefix("array<").removesuffix(">")
    schema = page.removeprefix("struct<").removesuffix(">")
    rows = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("path", F.input_file_name())
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_info", "layout_dets"))).alias("pages"))


def detections(paged: DataFrame, key: str) -> DataFrame:
    """One row per detection of (key, pages): page_idx, ord, category_id, score, box and recognised content.

    A detection's box is its bbox, or two corners of its poly.
    """
    pages = paged.select(F.col(key).alias("doc_id"), F.explode("pages").alias("p"))
    dets = pages.select("doc_id", F.col("p.page_info.page_no").alias("page_idx"), F.posexplode("p.layout_dets").alias("i", "d"))
    corner = lambda b, q: F.coalesce(F.get("d.bbox", F.lit(b)), F.get("d.poly", F.lit(q)))
    box = [corner(b, q).alias(n) for n, b, q in (("x0", 0, 0), ("y0", 1, 1), ("x1", 2, 4), ("y1", 3, 5))]
    return dets.select("doc_id", "page_idx", (F.col("i") + 1).alias("ord"), "d.category_id", "d.score", *box, "d.latex", "d.html", "d.text")


def object_store(spark: SparkSession, endpoint: str, access_key: str, secret_key: str, attempts: int = 5) -> None:
    """Set up s3a:// for this session."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in (("endpoint", endpoint), ("access.key", access_key), ("secret.key", secret_key), ("attempts.maximum", str(attempts))):
        conf.set(f"fs.s3a.{k}", v)
