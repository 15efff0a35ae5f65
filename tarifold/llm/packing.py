"""Sequence packing: shortest-pack-first over the length histogram.

Texts are cut in pieces of at most CONTEXT byte-pair tokens of VOCABULARY. Only
the histogram of piece lengths (at most CONTEXT numbers, whatever the corpus
size) reaches the driver, which places lengths longest first, each into the pack
that is shortest so far if it fits there, and counts packs by pattern instead of
keeping them one by one. Patterns come back to the pieces by rank: the i-th
piece of a length takes the i-th slot of that length. Ranks come from counts per
(length, bucket) and an order inside each bucket, so that a frequent length
never meets in one task. The slots of one length are ranges of ranks; a piece
finds its own by binary search in the sorted ranges, a batch at a time.

Defined results for odd input:

* null and empty texts: no piece, no row; blank texts: their white space has tokens;
* very long texts: as many pieces as their tokens need, the whole text;
* ties: pieces of one length are alike; the order is bucket, doc_id, piece, and the
  number of buckets grows with the corpus, so which of two pieces of one length
  takes which slot may differ between corpora;
* repeated rows: packed each for itself; null doc_id: packed, id null;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifold.llm import tokens as bpe
from tarifold.llm.common import stash, table
from tarifold.llm.token_rollup import token_counter

CONTEXT, VOCABULARY = 2048, "byte_bpe_50k"
#: Pieces aimed at in a bucket; the number of buckets grows with the corpus.
BUCKET_PIECES = 1_000_000


def shortest_pack_first(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in the order placed) and how many packs follow each."""
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, space: int) -> None:
        if space == 0:
            done.append((pattern, count))
            return
        if not open_packs.get(space):
            open_packs[space] = []
            heapq.heappush(spaces, -space)
        open_packs[space].append((pattern, count))

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        todo = histogram[length]
        while todo:
            if not spaces or -spaces[0] < length:
                # each new pack stays the shortest until it is full of this length
                each = context // length
                if todo >= each:
                    put((length,) * each, todo // each, context - each * length)
                if todo % each:
                    put((length,) * (todo % each), 1, context - todo % each * length)
                break
            space = -spaces[0]
            pattern, count = open_packs[space].pop()
            if not open_packs[space]:
                del open_packs[space]
                heapq.heappop(spaces)
            used = min(count, todo)
            if count > used:
                put(pattern, count - used, space)
            put((*pattern, length), used, space - length)
            todo -= used
    for space in sorted(open_packs):
        done.extend(open_packs[space])
    return done


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its slots (first rank, first pack, offset, pattern), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    first_pack = 0
    for number, (pattern, count) in enumerate(patterns):
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((given.get(length, 0), first_pack, offset, number))
            given[length] = given.get(length, 0) + count
            offset += length
        first_pack += count
    return out


def pieces(docs: DataFrame, context: int = CONTEXT, folder: str = bpe.VOCABULARY_DIR) -> DataFrame:
    """doc_id, piece, start and length of every piece, in tokens."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_counter(VOCABULARY, folder)(F.col("text").cast("string")).alias("tokens"))
    # no filter on tokens: it would be pushed below the projection and count them a second time
    cut = counted.withColumn("piece", F.explode(F.when(F.col("tokens") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {context}")))))
    start = F.col("piece") * context
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(context).cast("long"), F.col("tokens") - start).cast("int").alias("length"))


def slot_finder(of_length: dict[int, list[tuple[int, int, int, int]]]):
    """An Arrow-batched function (length, rank) -> (pack, offset, pattern).

    The sorted ranges go to the workers as five plain arrays; their number
    depends on the patterns, not on the number of pieces.
    """
    flat = [(length, *slot) for length, own in sorted(of_length.items()) for slot in own]
    lengths, ranks, packs, offsets, patterns = (np.array(c, np.int64) for c in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 5
    starts = (lengths << 48) | ranks

    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy(np.int64)
        at = np.searchsorted(starts, (length.to_numpy(np.int64) << 48) | rank, "right") - 1
        return pd.DataFrame({"pack": packs[at] + rank - ranks[at], "offset": offsets[at], "pattern": patterns[at]})

    return F.pandas_udf(find, "pack long, offset int, pattern int")


def pack(docs: DataFrame, context: int = CONTEXT, folder: str = bpe.VOCABULARY_DIR) -> DataFrame:
    """doc_id, piece, start, length, pack, offset, pattern: one row per piece."""
    cut = stash(pieces(docs, context, folder), "pieces")
    total = cut.count()
    buckets = max(1, -(-total // BUCKET_PIECES))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = stash(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `context` rows
    of_length = slots(shortest_pack_first(histogram, context))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")).cast("long") - 1)
    # the base joins on the window's own partitioning
    found = ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    return found.select("doc_id", "piece", "start", "length", slot_finder(of_length)("length", "rank").alias("slot")).select("doc_id", "piece", "start", "length", "slot.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every piece of every document in its pack."""
    return pack(table(spark, sf_dir, "documents"))
