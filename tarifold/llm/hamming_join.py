"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's signature holds SYMBOLS b-bit minhashes (b = 8) of its word pairs,
packed in five longs. The distance of two signatures is the number of symbols
in which they differ; its expectation is about SYMBOLS * (1 - Jaccard).

The signature is cut into m chunks. If two signatures differ in at most
``max_distance`` < 2 m symbols, some chunk has at most one error (pigeonhole).
Every chunk is therefore indexed once per allowed error position, that symbol
masked out: four symbols, 32 bits, are left to meet under. Two signatures that
meet under a key are compared in full, and the pair is emitted only under the
first key where the two can meet, so no distinct is needed afterwards. The index
holds each distinct signature once. The query returns one row a document: the
least document of its connected component, and its number of links, which are
all other documents whose signatures are within the distance. Links are counted
from pairs of distinct signatures and numbers of holders, so copies are never
expanded into pairs; near_pairs lists the pairs themselves. Nothing is capped
and nothing left out.

Defined results for odd input:

* null, empty or blank text: no signature, in no pair: a class of its own with no
  links; dedup keeps it;
* one word: the word itself is the only shingle;
* very long text: whole text is hashed, a block at a time, in memory that does not grow with it;
* repeated rows (equal doc_id): one document, which never pairs with itself; with
  several texts it pairs by the nearest of them, joins their classes and counts
  each partner once; dedup keeps one row of a group even where its rows share an id;
* null doc_id: in no pair and no row of the query; dedup takes such rows as documents of their own, after
  all with an id;
* equal signatures: pairs at distance 0; ties in dedup: the least doc_id stays;
* empty table: empty result;
* extra columns are ignored (and carried by dedup, dotted names too).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm.common import columns_of, join_lookup, stash, table

SYMBOLS = 40
LANES = SYMBOLS // 8
CHUNKS = 8
MAX_DISTANCE = 2 * CHUNKS - 1
SEED = 20_240_117

#: Bytes of a text that are hashed at once; bounds the memory, whatever the text's length.
BLOCK = 1 << 18

_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_table() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for the places of a block."""
    if not _powers:
        for base in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(BLOCK + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def _word_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """Hashes of the text's words in order, a block of the text at a time.

    They come from differences of one running polynomial hash, so a block is
    treated in numpy without a loop over words. A word that goes on in the next
    block is carried there: the base to its length so far shifts the rest.
    """
    up, down = _power_table()
    carried, length = np.zeros(1, np.uint64), 0
    for at in range(0, len(raw), BLOCK):
        data = np.frombuffer(raw, np.uint8, min(BLOCK, len(raw) - at), at)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        lower = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << np.uint8(5)
        running = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
        value = (running[ends] - running[starts]) * down[starts]
        before = length
        if length and not space[0]:
            value[:1] = carried + value[:1] * np.uint64(pow(_P, length, 1 << 64))
        elif length:
            value, before = np.concatenate((carried, value)), 0
        length = 0
        if not space[-1] and at + BLOCK < len(raw):
            length = int(ends[-1] - starts[-1]) + (before if len(starts) == 1 else 0)
            carried, value = value[-1:], value[:-1]
        yield _mix(value)


def text_signature(raw: bytes) -> np.ndarray | None:
    """The b-bit minhashes of one UTF-8 text, or None if it has no word."""
    a, b = _multipliers_cached()
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    last, words = np.zeros(0, np.uint64), 0
    for word in _word_hashes(raw):
        words += len(word)
        word = np.concatenate((last, word))
        last = word[-1:]
        shingle = _mix(word[:-1] * np.uint64(3) + word[1:] * np.uint64(0xA0761D6478BD642F))
        for i in range(0, len(shingle), 2048):
            part = shingle[i : i + 2048]
            np.minimum(low, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=low)
    if words == 0:
        return None
    if words == 1:
        low = a * last + b
    return (_mix(low) >> np.uint64(56)).astype(np.uint8)


_cached: list[tuple[np.ndarray, np.ndarray]] = []


def _multipliers_cached() -> tuple[np.ndarray, np.ndarray]:
    if not _cached:
        _cached.append(_multipliers())
    return _cached[0]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"s{i}" for i in range(LANES))]
    for batch in batches:
        ids, lanes = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            sig = text_signature(text.as_buffer().to_pybytes()) if text.is_valid else None
            if sig is not None:
                ids.append(doc_id)
                lanes.append(sig.view(np.int64))
        grid = np.array(lanes, dtype=np.int64).reshape(-1, LANES)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(grid[:, i]) for i in range(LANES))], names=names)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and the signature's lanes s0..s4, one row for each row with a word."""
    own = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_sign, "doc_id long, " + ", ".join(f"s{i} long" for i in range(LANES)))


def _chunk_symbols(chunks: int = CHUNKS) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(np.arange(SYMBOLS), chunks)]


def _lane_mask(symbols: list[int]) -> dict[int, int]:
    """Bytes of the given symbols, by lane, as signed longs."""
    masks: dict[int, int] = {}
    for s in symbols:
        masks[s // 8] = masks.get(s // 8, 0) | 0xFF << 8 * (s % 8)
    return {lane: m - (1 << 64) if m >> 63 else m for lane, m in masks.items()}


def _keys() -> Column:
    """An array of the masked chunk keys: hash of the symbols left, its lowest six bits replaced by the key's number."""
    out, number = [], 0
    for chunk in _chunk_symbols():
        for wrong in chunk:
            kept = [F.col(f"s{lane}").bitwiseAND(F.lit(m)) for lane, m in sorted(_lane_mask([s for s in chunk if s != wrong]).items())]
            out.append(F.xxhash64(*kept).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(number)))
            number += 1
    return F.array(*out)


def _error_bits(lane: int) -> Column:
    """One bit for each differing symbol of a lane, at the symbol's lowest bit."""
    x = F.col(f"a.s{lane}").bitwiseXOR(F.col(f"b.s{lane}"))
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3F3F3F3F3F3F3F3F), (1, 0x7F7F7F7F7F7F7F7F)):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask)))
    return x.bitwiseAND(F.lit(0x0101010101010101))


def _error_set() -> Column:
    """The symbols in which two signatures differ, as the bits of one long: symbol s at bit s."""
    out = F.lit(0).cast("long")
    for lane in range(LANES):
        x = _error_bits(lane)
        for shift, mask in ((7, 0x0003000300030003), (14, 0x0000000F0000000F), (28, 0xFF)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(x, 8 * lane))
    return out


def _first_key(errors: Column) -> Column:
    """Number of the first key under which two signatures with this set of errors meet; null if none."""
    number, cases = 0, []
    for chunk in _chunk_symbols():
        own = F.shiftright(errors, chunk[0]).bitwiseAND(F.lit((1 << len(chunk)) - 1).cast("long"))
        # at most one error, at its place; without one the chunk's first key
        cases.append((own.bitwiseAND(own - 1) == 0, F.lit(number) + F.bit_count(F.greatest(own - 1, F.lit(0).cast("long")))))
        number += len(chunk)
    out = F.lit(None).cast("int")
    for test, where in reversed(cases):
        out = F.when(test, where).otherwise(out)
    return out


def hamming_pairs(sigs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """All pairs doc_a < doc_b of distinct signatures at most max_distance symbols apart.

    One shuffle: rows (key, id, signature) by key. A hot key is an ordinary
    skewed join partition, which adaptive execution splits. The hint rules a
    broadcast out: Spark takes the exploded side for as large as the table of
    signatures, a fortieth of it, and would send it whole to every executor
    just below its threshold. The set of errors
    is a column of a projection of its own: __row, which is not deterministic,
    keeps the filter from being pushed below it, where the set would be worked
    out again for each of its uses, in more code than the JVM compiles.
    """
    if not 0 <= max_distance < 2 * CHUNKS:
        raise ValueError(f"the index guarantees distances up to {MAX_DISTANCE}")
    lanes = [f"s{i}" for i in range(LANES)]
    keyed = sigs.select("doc_id", *lanes, F.explode(_keys()).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    number = F.col("a.key").bitwiseAND(F.lit(63)).cast("int")
    met = met.select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), number.alias("number"), _error_set().alias("errors"), F.monotonically_increasing_id().alias("__row"))
    distance = F.bit_count("errors")
    near = met.filter((distance <= max_distance) & (_first_key(F.col("errors")) == F.col("number")) & (F.col("__row") >= 0))
    return near.select("doc_a", "doc_b", distance.cast("int").alias("distance"))


LANE_NAMES = [f"s{i}" for i in range(LANES)]


def _holders(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct signatures with their least and last holder, and (rep, doc_id) of those with several."""
    heads = stash(sigs.groupBy(*LANE_NAMES).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "heads")
    members = sigs.join(heads.filter("rep < last"), LANE_NAMES).select("rep", "doc_id").distinct()
    return heads, stash(members, "members")


def _rep_pairs(heads: DataFrame, max_distance: int) -> DataFrame:
    return hamming_pairs(heads.withColumnRenamed("rep", "doc_id").drop("last"), max_distance)


def _numbered(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct signatures with a number of their own, and (sid, doc_id) of all their holders."""
    heads = stash(sigs.select(*LANE_NAMES).distinct().withColumn("sid", F.monotonically_increasing_id()), "heads")
    return heads, stash(sigs.join(heads, LANE_NAMES).select("sid", "doc_id").distinct(), "members")


def _sid_pairs(heads: DataFrame, max_distance: int) -> DataFrame:
    return stash(hamming_pairs(heads.withColumnRenamed("sid", "doc_id"), max_distance), "sid_pairs")


def near_pairs(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """All near-duplicate pairs (doc_a, doc_b, distance), doc_a < doc_b, each once."""
    heads, members = _numbered(stash(signatures(docs), "signatures"))
    one, other = members.select(F.col("sid").alias("sid_a"), F.col("doc_id").alias("one")), members.select(F.col("sid").alias("sid_b"), F.col("doc_id").alias("other"))
    same = one.join(other, F.col("sid_a") == F.col("sid_b")).filter("one < other").select("one", "other", F.lit(0).alias("distance"))
    apart = _sid_pairs(heads, max_distance).toDF("sid_a", "sid_b", "distance").join(one, "sid_a").join(other, "sid_b")
    found = same.unionByName(apart.filter("one <> other").select("one", "other", "distance"))
    found = found.select(F.least("one", "other").alias("doc_a"), F.greatest("one", "other").alias("doc_b"), "distance")
    # only a document with several texts can meet another one twice
    return found if _several(members).isEmpty() else found.groupBy("doc_a", "doc_b").agg(F.min("distance").alias("distance"))


def _several(members: DataFrame) -> DataFrame:
    """The documents with more than one signature."""
    return members.groupBy("doc_id").count().filter("count > 1").select("doc_id")


def classes(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, class_id and links of each document: the least document it is connected with, and its number of partners."""
    heads, members = _numbered(stash(signatures(docs), "signatures"))
    pairs = _sid_pairs(heads, max_distance).toDF("sid", "other", "distance").drop("distance")
    around = pairs.unionByName(pairs.select(F.col("other").alias("sid"), F.col("sid").alias("other")))
    around = around.unionByName(heads.select("sid", F.col("sid").alias("other")))
    several = stash(_several(members), "several")
    mixed = not several.isEmpty()
    marked = members.join(several.withColumn("many", F.lit(1)), "doc_id", "left") if mixed else members.withColumn("many", F.lit(None).cast("int"))
    # weight: holders with no other signature; nearly all signatures have one
    weight = stash(marked.groupBy("sid").agg(F.sum(F.when(F.col("many").isNull(), 1).otherwise(0)).alias("weight")).filter("weight <> 1"), "weights")
    weighed = join_lookup(around, weight.withColumnRenamed("sid", "other"), ["other"]).withColumn("weight", F.coalesce("weight", F.lit(1)))
    near = weighed.groupBy("sid").agg(F.sum("weight").alias("near"))
    edges = pairs
    if mixed:  # partners of documents with several signatures are made distinct, in full
        held = members.join(several, "doc_id")
        reach = stash(held.join(weighed, "sid").select("doc_id", "other", "weight").distinct(), "reach")
        near = near.join(reach.groupBy(F.col("other").alias("sid")).agg(F.count("*").alias("more")), "sid", "left").select("sid", (F.col("near") + F.coalesce("more", F.lit(0))).alias("near"))
        mates = reach.join(held.select(F.col("doc_id").alias("mate"), F.col("sid").alias("other")), "other").filter("mate <> doc_id").select("doc_id", "mate").distinct()
        own = reach.groupBy("doc_id").agg(F.sum("weight").alias("own")).join(mates.groupBy("doc_id").agg(F.count("*").alias("mates")), "doc_id", "left")
        own = own.select("doc_id", (F.col("own") + F.coalesce("mates", F.lit(0))).alias("links"))
        edges = pairs.unionByName(held.join(held.groupBy("doc_id").agg(F.min("sid").alias("other")), "doc_id").filter("sid <> other").select("sid", "other"))
    placed = members.join(components(edges, "sid", "other").withColumnRenamed("doc_id", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    placed = stash(placed.join(near, "sid").select("doc_id", "root", (F.col("near") - 1).alias("links")), "placed")
    placed = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").drop("root")
    if mixed:
        placed = placed.join(several, "doc_id", "left_anti").unionByName(placed.select("doc_id", "class_id").distinct().join(own, "doc_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    return ids.join(placed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def links(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs that connect the same documents as near_pairs: the holders of a signature as a star around the least."""
    heads, members = _holders(stash(signatures(docs), "signatures"))
    star = members.filter("doc_id > rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    return star.unionByName(_rep_pairs(heads, max_distance).select("doc_a", "doc_b"))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Connected components (doc_id, root) of the nodes in pairs; root is the least node.

    Alternating large-star and small-star steps: a logarithmic number of rounds
    in practice, each of two shuffles of the edges only, each written to the
    shared folder.
    """
    edges = stash(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every edge points from the greater to the lesser end here
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = stash(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("root"))).distinct()
        last = now


def _lost(docs: DataFrame, max_distance: int) -> DataFrame:
    groups = components(links(docs, max_distance))
    return stash(groups.filter("doc_id <> root").select(F.col("doc_id").alias("__lost")), "lost")


def dedup(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs without the near duplicates: of every group the row with the least doc_id stays. All columns are kept.

    Where ids are null or repeat, rows are numbered first, in a written copy,
    so that of rows that share an id or have none one stays as well.
    """
    key = F.col("doc_id").cast("long")
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids")).first()
    if n["rows"] == n["ids"]:
        return join_lookup(docs.withColumn("__lost", key), _lost(docs, max_distance), ["__lost"], "left_anti").drop("__lost")
    rows = stash(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*columns_of(docs)).alias("row")), "rows")
    own = rows.select("number", F.col("row.doc_id").cast("long").alias("id"))
    groups = components(links(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), max_distance))
    placed = groups.join(own, groups["doc_id"] == own["number"]).select("number", "root", F.struct(F.col("id").isNull(), "id", "number").alias("place"))
    first = placed.groupBy("root").agg(F.min_by("number", "place").alias("first"))
    lost = stash(placed.join(first, "root").filter("number <> first").select("number"), "lost")
    return join_lookup(rows, lost, ["number"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: class and number of near duplicates of every document."""
    return classes(table(spark, sf_dir, "documents"))
