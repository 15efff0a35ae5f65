"""WARC fixity audit with Merkle trees.

Pages become WARC response records; a WARC file holds the records of SLOTS
consecutive page ids, in order, each at its byte offset. Per file a tree is
hashed bottom-up over ordered ranges: leaf = sha256 of one record's bytes, inner
node = sha256 over the digests and byte lengths of its FANOUT ordered children.
A parent speaks of lengths, not of absolute offsets, so one truncated record
does not spoil the hashes of its right neighbours; every node keeps the offset
range that it covers.

Two replicas are compared root against root; only the children of differing
nodes are looked at on the next level, down to the records. Trees are kept as a
table partitioned by level and by bundle (BUNDLE files side by side), so the
descent reads single levels and, of those, only bundles that hold a differing
node; the nodes found on each level are written, and a level's are read once.
One shuffle of digests (never of bytes), by bundle, builds each level.

Defined results for odd input:

* null url or html: recorded as empty; empty and very long html: hashed whole;
* null page_id: slot 0 of a file of its own, NO_FILE; negative ids: files below 0;
* repeated rows and ties (equal page_id): one slot with the hash over the
  sorted digests of its records, so that order and engine don't matter;
* a record, branch or file that one replica lacks: a mismatch with that
  side null, fault "missing" or "extra";
* empty tables: empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifold.llm.common import join_lookup, new_path, stash, table

SLOTS, FANOUT, LEVELS = 4096, 16, 3
#: Files of a bundle; the file of records without page_id, which no page_id can give.
BUNDLE, NO_FILE = 64, -(1 << 60)
CAPTURED = "2024-01-01T00:00:00Z"
#: The replica of the query: bit rot in one record of FLIP, a cut tail in one of CUT, a lost record in one of LOSE.
FLIP, CUT, LOSE = 997, 1499, 2003


def warc_records(pages: DataFrame) -> DataFrame:
    """page_id and the record: header lines, blank line, payload."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {CAPTURED}\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def faulty_copy(records: DataFrame) -> DataFrame:
    """A deterministic damaged replica, for audits of a store that has one copy."""
    text, key = F.col("record"), F.col("page_id")
    flipped = F.concat(F.substring(text, 1, 5), F.lit("0"), F.expr("substring(record, 7)"))
    cut = F.expr("substring(record, 1, length(record) - 9)")
    damaged = F.when(F.pmod(key, F.lit(FLIP)) == 13, flipped).when(F.pmod(key, F.lit(CUT)) == 7, cut).otherwise(text)
    return records.filter(F.coalesce(F.pmod(key, F.lit(LOSE)) != 5, F.lit(True))).select("page_id", damaged.alias("record"))


def _bundle() -> Column:
    return F.expr(f"(file - pmod(file, {BUNDLE})) div {BUNDLE}")


def _hash(parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", parts), 256)


def leaves(records: DataFrame) -> DataFrame:
    """file, slot, digest, bytes and offset of every slot."""
    key = F.coalesce(F.expr(f"(page_id - pmod(page_id, {SLOTS})) div {SLOTS}"), F.lit(NO_FILE)).cast("long")
    one = records.select(key.alias("file"), F.coalesce(F.pmod(F.col("page_id"), F.lit(SLOTS)), F.lit(0)).cast("int").alias("slot"), F.sha2("record", 256).alias("digest"), F.octet_length("record").cast("long").alias("bytes"))
    # one exchange, of digests, serves the slots, the offsets and the layout
    slots = one.repartition(_bundle()).groupBy("file", "slot").agg(F.count("*").alias("n"), F.min("digest").alias("first"), F.array_sort(F.collect_list("digest")).alias("all"), F.sum("bytes").alias("bytes"))
    digest = F.when(F.col("n") == 1, F.col("first")).otherwise(_hash(F.col("all")))
    slots = slots.select("file", "slot", digest.alias("digest"), "bytes")
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


NODES = "file long, node int, digest string, bytes long, offset long"


def tree(records: DataFrame) -> DataFrame:
    """The nodes of every file's tree as a stored table: level (0: records), bundle, file, node, digest, bytes, offset."""
    spark = records.sparkSession
    path = new_path(spark, "merkle")

    def store(nodes: DataFrame, number: int) -> DataFrame:
        nodes.withColumn("bundle", _bundle()).repartition("bundle").sortWithinPartitions("bundle", "file", "node").write.partitionBy("bundle").parquet(f"{path}/level={number}")
        return spark.read.schema(f"{NODES}, bundle long").parquet(f"{path}/level={number}")

    below = store(leaves(records).withColumnRenamed("slot", "node").select("file", "node", "digest", "bytes", "offset"), 0)
    for number in range(1, LEVELS + 1):
        child = F.struct("node", "digest", "bytes")
        up = below.groupBy("bundle", "file", F.expr(f"node div {FANOUT}").cast("int").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("kids"), F.sum("bytes").alias("bytes"), F.min("offset").alias("offset"))
        text = F.transform("kids", lambda k: F.concat_ws(":", k["node"].cast("string"), k["digest"], k["bytes"].cast("string")))
        below = store(up.select("file", F.col("up").alias("node"), _hash(text).alias("digest"), "bytes", "offset"), number)
    return spark.read.schema(f"{NODES}, level int, bundle long").parquet(path)


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Mismatching records of two trees: file, slot, offset, bytes, both digests and the fault."""

    def differing(level: int, found: DataFrame | None) -> DataFrame:
        sides = []
        for t in (ours, theirs):
            nodes = t.filter(F.col("level") == level).drop("level")
            if found is not None:
                # bundles are counted in millions of records: their list is short, and names the folders to read
                bundles = [r["bundle"] for r in found.select("bundle").distinct().collect()]
                under = found.select("file", F.col("node").alias("up"))
                nodes = join_lookup(nodes.filter(F.col("bundle").isin(bundles)).withColumn("up", F.expr(f"node div {FANOUT}").cast("int")), under, ["file", "up"], "left_semi").drop("up")
            sides.append(nodes)
        a, b = sides[0].alias("a"), sides[1].alias("b")
        both = a.join(b, (F.col("a.bundle") == F.col("b.bundle")) & (F.col("a.file") == F.col("b.file")) & (F.col("a.node") == F.col("b.node")), "full_outer")
        either = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        return both.filter(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(either("bundle"), either("file"), either("node"), either("offset"), either("bytes"), F.col("a.digest").alias("digest"), F.col("b.digest").alias("other"))

    found = None
    for level in range(LEVELS, -1, -1):
        found = stash(differing(level, found), f"differing-{level}")
    fault = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return found.select("file", F.col("node").alias("slot"), "offset", "bytes", "digest", "other", fault.alias("fault"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every damaged record of the pages' replica, found from the roots down."""
    records = warc_records(table(spark, sf_dir, "pages"))
    return audit(tree(records), tree(faulty_copy(records)))


def oracle() -> str:
    """The same faults by comparing all record digests directly."""
    return f"""with r as (select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Date: {CAPTURED}' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id::varchar || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record from pages),
d as (select page_id, record, case when page_id % {LOSE} = 5 then null when page_id % {FLIP} = 13 then substr(record, 1, 5) || '0' || substr(record, 7) when page_id % {CUT} = 7 then substr(record, 1, length(record) - 9) else record end as copy,
    sum(strlen(record)) over (partition by page_id // {SLOTS} order by page_id) - strlen(record) as pos from r)
select (page_id // {SLOTS})::bigint as file, (page_id % {SLOTS})::int as slot, pos::bigint as "offset", strlen(record)::bigint as bytes, sha256(record) as digest, sha256(copy) as other,
    case when copy is null then 'missing' else 'corrupt' end as fault from d where copy is distinct from record"""
