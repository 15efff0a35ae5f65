"""Token counts as delta-maintained rollups.

The store keeps totals (documents, tokens) by source, language and tokenizer
version. They change only by committed batches of signed rows: an insert adds
(+1, +tokens), a delete adds (-1, -tokens), a revised count is a delete of the
old count and an insert of the new one. Sums commute, so batches may come in
any order, and a batch is aggregated map-side before anything is shuffled.

A commit is idempotent: the batch's sums are written to a staging folder of
the shared file system and renamed to deltas/<batch id>@<attempt>; a batch that
is there is not applied again, and a failed attempt leaves nothing that counts.
Should two writers commit one batch at once, one of the two folders counts.
compact() folds committed deltas into a base that lists the batches it holds;
deltas of listed batches no longer count, so that a crash at any point of a
compaction changes no total.

Defined results for odd input:

* null, empty texts: 0 tokens, the document counts; very long texts: counted whole;
* null source or language: the group named "";
* null doc_id: an ordinary row of its group;
* repeated rows: each is a change of its own (equal texts are what deletes are
  for); ties among equal texts: the least doc_id is the one that stays;
* groups whose sums are all 0: not shown; empty batches: committed, change nothing;
* extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm import tokens as bpe
from tarifold.llm.common import join_lookup, new_path, stash, table

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["documents", "tokens"]
FIRST, REVISED = "byte_bpe_50k", "byte_bpe_multi_50k"


def token_counter(name: str, folder: str = bpe.VOCABULARY_DIR):
    """An Arrow-batched function text -> number of tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = bpe.encoder(name, folder)
        for texts in batches:
            yield pd.Series(np.fromiter((bpe.encode(enc, t).size if t else 0 for t in texts), np.int64, len(texts)))

    return count


def signed(rows: DataFrame, sign: int, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    """Signed rows of the counts in rows (source, lang and a tokens column)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select(name("source"), name("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (F.coalesce(F.col(tokens), F.lit(0)).cast("long") * sign).alias("tokens"))


def revised(rows: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Signed rows that replace old counts by new ones; (tokenizer, column) each."""
    return signed(rows, -1, *old).unionByName(signed(rows, 1, *new))


class Rollup:
    """The store at a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))) if self._there(folder) else []

    def _state(self) -> tuple[str | None, set[str], dict[str, str]]:
        """The base that counts (none at first), the batches it holds, and the folder of every other batch."""
        bases = self._names("base")
        base = bases[-1] if bases else None
        held = set(self._names(f"base/{base}/batches")) if base else set()
        deltas: dict[str, str] = {}
        for name in self._names("deltas"):
            batch = name.split("@")[0]
            if batch not in held:
                deltas.setdefault(batch, name)  # of two writers of one batch the first name counts
        return base, held, deltas

    def committed(self) -> set[str]:
        """Ids of all batches applied, compacted ones included."""
        _, held, deltas = self._state()
        return held | set(deltas)

    def commit(self, batch_id: str, rows: DataFrame) -> bool:
        """Apply a batch of signed rows once; False if it has been applied before."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"unusable batch id {batch_id!r}")
        if batch_id in self.committed():
            return False
        name = f"{batch_id}@{uuid.uuid4().hex}"
        staged = f"{self.path}/staging/{name}"
        rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.path}/deltas"))
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/deltas/{name}")):
            raise OSError(f"batch {batch_id} could not be committed")
        return True

    def totals(self) -> DataFrame:
        base, _, deltas = self._state()
        return self._sums(base, deltas)

    def _sums(self, base: str | None, deltas: dict[str, str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, documents long, tokens long"
        parts = [f"{self.path}/deltas/{name}" for name in deltas.values()] + ([f"{self.path}/base/{base}/sums"] if base else [])
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all deltas into a new base. Ids are remembered, so replays stay without effect.

        The new base and the list of the batches in it appear together, by one
        rename; from then on their deltas don't count, whether they are still
        there or not. One compaction runs at a time; commits may go on, reads
        that began before may have to be repeated.
        """
        base, held, deltas = self._state()
        staged = f"{self.path}/staging/base-{uuid.uuid4().hex}"
        self._sums(base, deltas).write.parquet(f"{staged}/sums")
        for batch in sorted(held | set(deltas)):
            self._fs.mkdirs(self._path(f"{staged}/batches/{batch}"))
        self._fs.mkdirs(self._path(f"{self.path}/base"))
        number = int(base) + 1 if base else 0
        if not self._fs.rename(self._path(staged), self._path(f"{self.path}/base/{number:08d}")):
            raise OSError("the new base could not be put in place")
        self._sweep()

    def _sweep(self) -> None:
        """Remove what no longer counts: folded deltas and bases before the last."""
        _, _, deltas = self._state()
        for name in set(self._names("deltas")) - set(deltas.values()):
            self._fs.delete(self._path(f"{self.path}/deltas/{name}"), True)
        for name in self._names("base")[:-1]:
            self._fs.delete(self._path(f"{self.path}/base/{name}"), True)


def counted(docs: DataFrame, folder: str = bpe.VOCABULARY_DIR) -> DataFrame:
    """doc_id, source, lang, a digest of the text, and its tokens under both vocabularies."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"),
        token_counter(FIRST, folder)(text).alias("tokens"), token_counter(REVISED, folder)(text).alias("revised"),
    )


def maintain(store: Rollup, docs: DataFrame, folder: str = bpe.VOCABULARY_DIR) -> DataFrame:
    """Totals after four batches over docs: load, removal of exact copies, recount, and a replay of the removal.

    load inserts every row under the first tokenizer; copies deletes all rows
    of a text but those of its least doc_id; recount revises the remaining rows
    to the second tokenizer.
    """
    rows = stash(counted(docs, folder), "counted")
    least = stash(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    tagged = stash(join_lookup(rows, least, ["digest"]).withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("digest", "least"), "tagged")
    copies = signed(tagged.filter("copy"), -1, FIRST)
    store.commit("load", signed(tagged, 1, FIRST))
    store.commit("copies", copies)
    store.commit("recount", revised(tagged.filter(~F.col("copy")), (FIRST, "tokens"), (REVISED, "revised")))
    store.commit("copies", copies)
    return store.totals()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: totals of the whole documents table after its batches."""
    return maintain(Rollup(spark, new_path(spark, "rollup")), table(spark, sf_dir, "documents"))
