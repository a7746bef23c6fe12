"""Writers of the pipeline's results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(df: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Write rows in a format of Spark's, in folders by a column if wanted."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(by) if by else writer).save(path)


def write_texts(df: DataFrame, path: str, text: str = "markdown") -> None:
    """One line of JSON per document, (doc_id, text), which keeps line ends in texts apart from those of the file."""
    df.select("doc_id", F.col(text).alias("text")).write.mode("overwrite").json(path)


def write_artifacts(path: str, **tables: DataFrame) -> None:
    """Each table in a folder of its name, as Parquet."""
    for name, df in tables.items():
        write_documents(df, f"{path}/{name}")


def packed_json(df: DataFrame, *columns: str) -> DataFrame:
    """df's columns as one base64 text of JSON; unpacked_json() undoes it."""
    return df.select(F.base64(F.encode(F.to_json(F.struct(*columns)), "UTF-8")).alias("packed"))


def unpacked_json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json(F.decode(F.unbase64("packed"), "UTF-8"), schema).alias("row")).select("row.*")
