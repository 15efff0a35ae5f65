"""Shared plumbing: table access, shared-folder tables, sized broadcasts, word counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.session import ship

#: Rows up to which a lookup side may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 100_000

#: Whitespace that separates words; spelled out so that every engine agrees on it.
WORD = "[^ \\t\\n\\r\\f\\x0B]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a test folder where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    folder = tempfile.mkdtemp(prefix="tarifold-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _delete(path: str) -> None:
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), True)
    elif os.path.isdir(path):
        shutil.rmtree(path, True)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; local ones are removed when the driver exits."""
    path = f"{shared_dir(spark)}/tarifold-{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, path)
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    It cuts the lineage like checkpoint() does, is columnar and compressed,
    and outlives any executor.
    """
    spark = df.sparkSession
    ship(spark)
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_lookup(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a lookup table: broadcast after its rows were counted, shuffled when too many.

    The count reads a table that is already in the shared folder, so it costs
    one metadata read.
    """
    small = lookup.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(lookup) if small else lookup, on, how)


def columns_of(df: DataFrame) -> list[Column]:
    """df's own columns, whatever their names hold (dots, backquotes)."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def words(text: Column) -> Column:
    """Whitespace-separated words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
