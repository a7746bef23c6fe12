"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java/RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"
SPACES_PATTERN = f"[{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own; a
    cluster without the setting is an error, since no local folder is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="foliant-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Open scratch() blocks, outermost first: the paths that each drops.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession, keep: str) -> Iterator[None]:
    """What is materialised within goes at the end of the block, but for what is named `keep`, which a block around this one drops.

    No frame that is used later may read what goes.
    """
    outer = _scopes.get()
    own: list[str] = []
    token = _scopes.set((*outer, own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            if not path.endswith(f"-{keep}"):
                _drop(spark, path)
            elif outer:
                outer[-1].append(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that its lineage ends there.

    The files go when the innermost scratch() block ends, or else when the session's driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended already
        pass


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in parts:
        env["PYTHONPATH"] = os.pathsep.join([home, *parts])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body, which may use it any number of times.

    A plain reference could be inlined into a lambda and evaluated for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    """Number of words in text as LONG; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def text_words(text: Column) -> Column:
    """The words of text as an array; none for null."""
    return F.coalesce(F.filter(F.split(text, SPACES_PATTERN), lambda w: w != ""), F.array().cast("array<string>"))


#: A side of more rows than this is never broadcast; rows are then dealt over salts.
BROADCAST_ROWS = 20_000
SALTS = 64


def join_small(rows: DataFrame, small: DataFrame, key: str, small_key: str, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row per key, null matching null; small_key is dropped.

    The table is counted: a small one is broadcast, and of a larger one each row
    goes to every salt, so that a hot key of rows does not land in one task. A row's
    salt is a hash of it, so that a task run again deals it out as before.
    """
    same = F.col(small_key).eqNullSafe(F.col(key))
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), same, how).drop(small_key)
    dealt = rows.withColumn("_row_salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if "map<" not in t]), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, same & (F.col("_salt") == F.col("_row_salt")), how).drop(small_key, "_salt", "_row_salt")
