"""Versioned offers: snapshots, aliases, generation, publication, pointers, lookup.

State is a set of tables in a folder of any file system Spark can write to
(Store): Parquet directories that a driver-side transition replaces by writing a
new version and moving a pointer file to it, so readers see the old or the new
version, never a mixture. Every transition of a table holds that table's lock
from its first read to the move of the pointer. Offers have one directory an
artifact, so a lookup opens that artifact's only. The relational parts (alias
joins, lookups, as-of) are pure functions of frames.
"""

from __future__ import annotations

import json
import time as clock
import uuid
from contextlib import ExitStack, contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarifold import schemas, storage
from tarifold.functions.hashing import fingerprint
from tarifold.functions.text import unreviewed_alias

BLOCKED = "blocked_for_aggregation"
#: Dimension rows up to which a broadcast is asked for.
BROADCAST_ROWS = 200_000
#: Rows of a bin of time if all rows had one key and were spread evenly; rows of a partition that is sorted.
BIN_ROWS, SORT_ROWS = 50_000, 250_000
#: End of a pointer without end, in microseconds.
FOREVER = (1 << 63) - 1


class LifecycleError(ValueError):
    pass


def sized(dimension: DataFrame) -> DataFrame:
    """The dimension with a broadcast hint if it is small enough, without one otherwise."""
    return F.broadcast(dimension) if dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dimension


def alias_name() -> Column:
    """Name looked up for an item: its warehouse name, __default__ where that is missing or empty."""
    return F.coalesce(F.nullif(F.col("raw.supplier_warehouse_name"), F.lit("")), F.lit("__default__"))


def _offers(joined: DataFrame, artifact_id: str) -> DataFrame:
    return joined.select(
        F.lit(artifact_id).alias("artifact_id"), fingerprint(F.lit(artifact_id), F.col("id"), F.col("warehouse_key")).alias("offer_id"), F.col("id").alias("canonical_item_id"), "supplier_id", "warehouse_key",
        F.coalesce("raw.sku_candidate_key", F.lit("unknown_sku")).alias("sku_candidate_key"), F.nullif(F.col("raw.price"), F.lit("")).cast("decimal(38,6)").alias("price"), F.nullif(F.col("raw.qty"), F.lit("")).cast("int").alias("qty"),
        F.coalesce("raw.currency", F.lit("RUB")).alias("currency"), F.coalesce("quality_flags", F.array().cast("array<string>")).alias("quality_flags"),
    )


def offers_inner(items: DataFrame, aliases: DataFrame, artifact_id: str, unreviewed: bool = False) -> DataFrame:
    """Offers of mapped items; unmapped ones drop out, or get a marked key with unreviewed."""
    known = aliases.select("supplier_id", F.col("supplier_warehouse_name").alias("__name"), "warehouse_key")
    joined = items.withColumn("__name", alias_name()).join(sized(known), ["supplier_id", "__name"], "left" if unreviewed else "inner")
    if unreviewed:
        joined = joined.withColumn("warehouse_key", unreviewed_alias(F.col("warehouse_key"), F.col("raw.supplier_warehouse_name")))
    return _offers(joined, artifact_id)


def offers_fallback(items: DataFrame, aliases: DataFrame, keys: DataFrame, artifact_id: str) -> DataFrame:
    """Offers by alias, else by the warehouse key the item names itself."""
    known = aliases.select("supplier_id", F.col("supplier_warehouse_name").alias("__name"), F.col("warehouse_key").alias("__alias"))
    own = keys.select(F.col("warehouse_key").alias("__own")).distinct()
    joined = items.withColumn("__name", F.col("raw.supplier_warehouse_name")).join(sized(known), ["supplier_id", "__name"], "left").join(sized(own), F.col("raw.warehouse_key") == F.col("__own"), "left")
    return _offers(joined.withColumn("warehouse_key", F.coalesce("__alias", "__own")).filter("warehouse_key is not null"), artifact_id)


def unmapped(items: DataFrame, aliases: DataFrame) -> DataFrame:
    known = aliases.select("supplier_id", F.col("supplier_warehouse_name").alias("__name"))
    return items.withColumn("__name", alias_name()).join(sized(known), ["supplier_id", "__name"], "left_anti").drop("__name")


def live(items: DataFrame) -> DataFrame:
    """Items not blocked; unknown flags stay."""
    return items.filter(F.col("quality_flags").isNull() | ~F.array_contains("quality_flags", BLOCKED))


def offers_by_sku(offers: DataFrame, artifact_id: str, sku: str) -> DataFrame:
    """Offers of a key in an artifact; unknown flags drop out (three-valued logic)."""
    found = offers.filter((F.col("artifact_id") == artifact_id) & (F.col("sku_candidate_key") == sku) & ~F.array_contains("quality_flags", BLOCKED))
    return found.select("offer_id", "supplier_id", "warehouse_key", "price", "qty", "currency", "quality_flags")


def current_pointers(pointers: DataFrame, at: str | Column, keys: list[str]) -> DataFrame:
    """The pointer valid at a time, latest start first, one per key. Aggregation, no sort."""
    now = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    valid = pointers.filter((F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (F.col("valid_to") > now)))
    return valid.groupBy(*keys).agg(F.max_by("artifact_id", F.struct("valid_from", "artifact_id")).alias("artifact_id"), F.max("valid_from").alias("valid_from"))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _blocks(first: Column, last: Column, levels: int) -> Column:
    """The bins first to last as few dyadic blocks: array of (level, block), two a level at most; a block of level k covers 2**k bins."""
    empty = F.array().cast("array<struct<level:int,block:bigint>>")
    block = lambda level, n: F.struct(level.cast("int").alias("level"), n.alias("block"))

    def step(state: Column, level: Column) -> Column:
        a, z = state["a"], state["z"]
        odd = (a <= z) & (a % 2 == 1)
        low = a + odd.cast("bigint")
        even = (low <= z) & (z % 2 == 0)
        high = z - even.cast("bigint")
        more = F.concat(state["out"], F.when(odd, F.array(block(level, a))).otherwise(empty), F.when(even, F.array(block(level, z))).otherwise(empty))
        done = low > high
        return F.struct(F.when(done, F.lit(1 << 60)).otherwise(F.shiftright(low, 1)).alias("a"), F.when(done, F.lit(-1)).otherwise(F.shiftright(high, 1)).cast("bigint").alias("z"), more.alias("out"))

    start = F.struct(first.cast("bigint").alias("a"), last.cast("bigint").alias("z"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda state: state["out"])


def _div(number: Column, by: int) -> Column:
    """Whole quotient of a number that is not negative."""
    return F.call_function("div", number, F.lit(by))


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a null among their keys."""
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    return rows


def _width(first: int, last: int, rows: int, widest: int) -> int:
    """Microseconds of a bin: so many bins that one holds about BIN_ROWS rows, whatever the keys."""
    return max(1, min(widest, (last - first) // (rows // BIN_ROWS + 1) + 1))


def _sweep(keys: list[str]):
    """The step over rows sorted by (keys, bin, time, kind): pointers (kind 0) and probes (kind 1). A row (keys, __at, __found) a probe.

    The pointers started so far lie on a stack, the latest on top, each
    without those below that end no later; a probe takes off what has ended by
    its time, and the top is its pointer. Every pointer is put on once and
    taken off once.
    """

    def step(batches):
        import numpy as np
        import pyarrow as pa

        stack, group = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for name in (*keys, "__bin"):
                codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            ends = [tuple(batch.column(name)[at].as_py() for name in (*keys, "__bin")) for at in (0, batch.num_rows - 1)]
            new[0] = ends[0] != group
            group = ends[1]
            at, found = [], []
            rows = zip(new.tolist(), batch.column("__kind").to_pylist(), batch.column("__time").to_pylist(), batch.column("__to").to_pylist(), batch.column("__artifact").to_pylist())
            for i, (fresh, kind, time, to, artifact) in enumerate(rows):
                if fresh:
                    stack = []
                if kind:
                    while stack and stack[-1][0] <= time:
                        stack.pop()
                    at.append(i)
                    found.append(stack[-1][1] if stack else None)
                else:
                    while stack and stack[-1][0] <= to:
                        stack.pop()
                    stack.append((to, artifact))
            probed = batch.take(pa.array(at, pa.int64()))
            columns = [probed.column(k) for k in keys] + [probed.column("__time"), pa.array(found, batch.schema.field("__artifact").type)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "__at", "__found"])

    return step


def pointers_as_of(probes: DataFrame, pointers: DataFrame, keys: list[str], time: str, bin_seconds: int = 86_400) -> DataFrame:
    """For each probe the pointer in force at its time: of those started by then and not ended, the one that started last.

    Time is cut into bins (bin_seconds wide at most, narrower the more rows
    there are) that are treated apart, however few keys there are. A pointer
    comes into the bin where it starts and the one where it ends. Of those that
    cover a whole bin only the one that started last counts: they are spread as
    dyadic blocks of bins (about two a level, however long), the last start of
    each block is kept, and a bin looks at one block a level. Inside a bin
    sorted rows are swept once. So the work follows the rows (times the
    logarithm of the bins), not the pairs of probes and pointers.
    """
    at = _micros(time)
    reach = probes.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).first()
    first, last = reach["first"], reach["last"]
    kind = pointers.schema["artifact_id"].dataType
    if last is None:
        return probes.withColumn("artifact_id", F.lit(None).cast(kind))
    rows = reach["n"] + pointers.count()
    width = _width(first, last, rows, bin_seconds * 1_000_000)
    top = (last - first) // width
    levels = (top + 1).bit_length() + 1

    spans = _named(pointers, keys).select(*keys, F.col("artifact_id").alias("__artifact"), _micros("valid_from").alias("__from"), _micros("valid_to").alias("__to"))
    spans = spans.filter((F.col("__from") <= F.lit(last)) & (F.col("__to").isNull() | (F.col("__to") > F.greatest("__from", F.lit(first)))))
    low = F.when(F.col("__from") >= F.lit(first), _div(F.col("__from") - F.lit(first), width)).otherwise(F.lit(-1))
    high = F.when(F.col("__to") <= F.lit(last), _div(F.col("__to") - F.lit(first), width)).otherwise(F.lit(top + 1))
    spans = spans.select(*keys, "__artifact", "__from", F.coalesce("__to", F.lit(FOREVER)).alias("__to"), low.cast("bigint").alias("__low"), high.cast("bigint").alias("__high"))
    ends = F.array_compact(F.array(F.when(F.col("__low") >= 0, F.col("__low")), F.when((F.col("__high") <= top) & (F.col("__high") > F.col("__low")), F.col("__high"))))
    shape = [*keys, "__bin", "__time", "__kind", "__to", "__artifact"]
    part = spans.withColumn("__bin", F.explode(ends)).withColumns({"__time": F.col("__from"), "__kind": F.lit(0)}).select(*shape)

    asked = _named(probes, keys).withColumn("__time", at).filter("__time is not null").select(*keys, "__time").distinct()
    asked = asked.select("*", _div(F.col("__time") - F.lit(first), width).alias("__bin"), F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__to"), F.lit(None).cast(kind).alias("__artifact")).select(*shape)

    latest = F.max("__start").alias("__start")
    whole = spans.filter("__high - __low > 1").groupBy(*keys, (F.col("__low") + 1).alias("__low"), (F.col("__high") - 1).alias("__high")).agg(F.max(F.struct("__from", "__artifact")).alias("__start"))
    whole = whole.select(*keys, "__start", F.explode(_blocks(F.col("__low"), F.col("__high"), levels)).alias("__b")).groupBy(*keys, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block")).agg(latest)
    above = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("__bin", k).alias("block")) for k in range(levels)))
    bins = asked.select(*keys, "__bin").distinct().select(*keys, "__bin", F.explode(above).alias("__b")).select(*keys, "__bin", F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    over = bins.join(whole, [*keys, "__level", "__block"]).groupBy(*keys, "__bin").agg(latest)
    over = over.select(*keys, "__bin", F.col("__start.__from").alias("__time"), F.lit(0).alias("__kind"), F.lit(FOREVER).alias("__to"), F.col("__start.__artifact").alias("__artifact"))

    both = part.unionByName(over).unionByName(asked).repartition(rows // SORT_ROWS + 1, *keys, "__bin").sortWithinPartitions(*keys, "__bin", "__time", "__kind", "__artifact")
    answer = StructType([both.schema[k] for k in keys]).add("__at", "long").add("__found", kind)
    found = both.mapInArrow(_sweep(keys), answer)
    joined = probes.withColumn("__at", at).join(found, [*keys, "__at"], "left")
    return joined.select(*(F.col(c) for c in probes.columns), F.col("__found").alias("artifact_id"))


def current_counts(pointers: DataFrame, at: str | Column, keys: list[str]) -> DataFrame:
    """Per key the pointers valid at a time and whether it is exactly one; keys without a valid pointer count 0."""
    now = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    valid = (F.col("valid_from") <= now) & (F.col("valid_to").isNull() | (F.col("valid_to") > now))
    return pointers.groupBy(*keys).agg(F.count_if(valid).alias("n")).withColumn("exactly_one", F.col("n") == 1)


def pointer_intervals(log: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Validity intervals of a log of switches: each ends where the next begins.

    A long log is cut into bins of time, so that few keys do not make few
    partitions; a bin ends with a row for the first switch of the next bin.
    """
    reach = log.agg(F.min(_micros(time)).alias("first"), F.max(_micros(time)).alias("last"), F.count("*").alias("n")).first()
    if reach["n"] <= BIN_ROWS or reach["last"] is None:
        return log.withColumn("valid_to", F.lead(time).over(Window.partitionBy(*keys).orderBy(time, tie)))
    width = _width(reach["first"], reach["last"], reach["n"], reach["last"] - reach["first"] + 1)
    binned = log.withColumns({"__bin": F.coalesce(_div(_micros(time) - F.lit(reach["first"]), width), F.lit(-1)), "__end": F.lit(0)})
    own = binned.groupBy(*keys, "__bin").agg(F.min(time).alias(time))
    ends = own.withColumn("__bin", F.lag("__bin").over(Window.partitionBy(*keys).orderBy("__bin"))).filter("__bin is not null").withColumn("__end", F.lit(1))
    both = binned.unionByName(ends, allowMissingColumns=True)
    following = both.withColumn("valid_to", F.lead(time).over(Window.partitionBy(*keys, "__bin").orderBy("__end", time, tie)))
    return following.filter("__end = 0").drop("__bin", "__end")


def latest_per_key(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key as one max_by, which combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__r")).select(*keys, "__r.*")


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows beyond the first of each key; keys with nulls count too."""
    return rows.agg((F.count("*") - F.count_distinct(F.struct(*columns))).alias("duplicates"))


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent (foreign-key check)."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def items_from_lines(lines: DataFrame, snapshot_id: str) -> DataFrame:
    """Items of a snapshot from string-contract lines; ids are hashed, so that a repeated load is the same."""
    id_ = fingerprint(F.lit(snapshot_id), F.col("supplier_id"), F.col("_meta.source_row_1based").cast("string"), F.col("raw.supplier_warehouse_name"), F.col("raw.sku_candidate_key"))
    return lines.select(id_.alias("id"), F.lit(snapshot_id).alias("snapshot_id"), "supplier_id", F.struct("raw.supplier_warehouse_name", F.lit(None).cast("string").alias("warehouse_key"), "raw.sku_candidate_key", "raw.price", "raw.qty", "raw.currency").alias("raw"), "quality_flags")


#: Seconds that a transition waits for a table's lock.
PATIENCE = 60


class Store:
    """Tables of the offer life cycle under a folder."""

    TABLES = {"snapshots": schemas.SNAPSHOTS, "items": schemas.ITEMS, "warehouse_keys": schemas.WAREHOUSE_KEYS, "aliases": schemas.ALIASES, "artifacts": schemas.ARTIFACTS, "pointers": schemas.POINTERS, "offers": schemas.OFFERS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._held = spark, root.rstrip("/"), set()

    @contextmanager
    def _alone(self, name: str):
        """The lock of a table (or an artifact); nested uses by one Store hold it once."""
        if name in self._held:
            yield
            return
        until = clock.monotonic() + PATIENCE
        while True:
            lock = storage.exclusive(f"{self.root}/locks/{name}")
            try:
                lock.__enter__()
                break
            except FileExistsError:
                if clock.monotonic() > until:
                    raise
                clock.sleep(0.05)
        self._held.add(name)
        try:
            yield
        finally:
            self._held.discard(name)
            lock.__exit__(None, None, None)

    def _parts(self, name: str) -> list[str]:
        pointer = f"{self.root}/{name}.current"
        return json.loads(storage.read_text(pointer)) if storage.exists(pointer) else []

    def _load(self, name: str, parts: list[str]) -> DataFrame:
        schema = self.TABLES[name]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        return self._load(name, self._parts(name))

    def read_offers(self, artifact_id: str) -> DataFrame:
        """The offers of one artifact; no other artifact's files are opened."""
        return self._load("offers", [p for p in self._parts("offers") if p.startswith(f"{artifact_id}-")]).filter(F.col("artifact_id") == artifact_id)

    def _point(self, name: str, parts: list[str]) -> None:
        storage.write_text(f"{self.root}/{name}.current", json.dumps(parts))

    def _write(self, name: str, rows: DataFrame, part: str | None = None) -> str:
        part = f"{part or 'v'}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def replace(self, name: str, rows: DataFrame) -> None:
        with self._alone(name):
            self._point(name, [self._write(name, rows)])

    def append(self, name: str, rows: DataFrame) -> None:
        with self._alone(name):
            self._point(name, [*self._parts(name), self._write(name, rows)])

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those of equal keys: anti-join and union, written as one new version."""
        with self._alone(name):
            kept = self.read(name).join(rows.select(*keys), keys, "left_anti")
            self.replace(name, kept.unionByName(rows))

    def delete(self, name: str, test: Column) -> None:
        with self._alone(name):
            self.replace(name, self.read(name).filter(~F.coalesce(test, F.lit(False))))

    @contextmanager
    def transaction(self):
        """All tables as they were if the block fails. Versions are never changed, so going back moves the pointers.

        The block holds the locks of all tables, in one order.
        """
        with ExitStack() as locks:
            for name in sorted(self.TABLES):
                locks.enter_context(self._alone(name))
            before = {name: self._parts(name) for name in self.TABLES}
            try:
                yield self
            except BaseException:
                for name, parts in before.items():
                    if self._parts(name) != parts:
                        self._point(name, parts)
                raise

    def _artifact(self, artifact_id: str) -> dict | None:
        row = self.read("artifacts").filter(F.col("artifact_id") == artifact_id).first()
        return row.asDict() if row else None

    def open_snapshot(self, snapshot_id: str, parser_id: str = "seed") -> None:
        self.append("snapshots", self.spark.createDataFrame([(snapshot_id, parser_id, "open", datetime.now(UTC), None)], schemas.SNAPSHOTS))

    def seal(self, snapshot_id: str) -> None:
        hit = F.col("snapshot_id") == snapshot_id
        with self._alone("snapshots"):
            self.replace("snapshots", self.read("snapshots").withColumns({"status": F.when(hit, "sealed").otherwise(F.col("status")), "sealed_at": F.when(hit, F.current_timestamp()).otherwise(F.col("sealed_at"))}))

    def assert_can_generate(self, snapshot_id: str) -> None:
        if self.read("snapshots").filter((F.col("snapshot_id") == snapshot_id) & (F.col("status") == "sealed")).isEmpty():
            raise LifecycleError(f"snapshot {snapshot_id} is not sealed")
        if self.read("items").filter(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise LifecycleError(f"snapshot {snapshot_id} has no items")
        if self.read("warehouse_keys").isEmpty():
            raise LifecycleError("there are no warehouse keys")

    def generate(self, snapshot_id: str, version: str, artifact_id: str, resolution: str = "inner") -> int:
        """Offers of an artifact, replaced as a whole; the number of offers. Published artifacts are refused."""
        with self._alone(f"artifact-{artifact_id}"):
            self.assert_can_generate(snapshot_id)
            had = self._artifact(artifact_id)
            if had and had["status"] != "generated":
                raise LifecycleError(f"artifact {artifact_id} is {had['status']}")
            self._assert_version_free(snapshot_id, version, artifact_id)
            items = self.read("items").filter(F.col("snapshot_id") == snapshot_id)
            if resolution == "fallback":
                offers = offers_fallback(items, self.read("aliases"), self.read("warehouse_keys"), artifact_id)
            else:
                offers = offers_inner(items, self.read("aliases"), artifact_id, unreviewed=resolution == "unreviewed")
            part = self._write("offers", offers, artifact_id)
            n = self.spark.read.schema(schemas.OFFERS).parquet(f"{self.root}/offers/{part}").count()
            if n == 0:
                raise LifecycleError(f"no item of snapshot {snapshot_id} is mapped to a warehouse")
            with self._alone("artifacts"):
                self._assert_version_free(snapshot_id, version, artifact_id)
                with self._alone("offers"):
                    self._point("offers", [p for p in self._parts("offers") if not p.startswith(f"{artifact_id}-")] + [part])
                print_ = self.spark.range(1).select(fingerprint(F.lit(snapshot_id), F.lit(version), F.lit(artifact_id))).first()[0]
                row = (artifact_id, snapshot_id, version, print_, "generated", datetime.now(UTC), None, "generator")
                self.upsert("artifacts", self.spark.createDataFrame([row], schemas.ARTIFACTS), ["artifact_id"])
            return n

    def _assert_version_free(self, snapshot_id: str, version: str, artifact_id: str) -> None:
        """(snapshot_id, curated_version) is unique among artifacts."""
        same = self.read("artifacts").filter((F.col("snapshot_id") == snapshot_id) & (F.col("curated_version") == version) & (F.col("artifact_id") != artifact_id))
        if not same.isEmpty():
            raise LifecycleError(f"snapshot {snapshot_id} has an artifact of version {version}")

    def assert_integrity(self, artifact_id: str) -> None:
        had = self._artifact(artifact_id)
        if not had or had["status"] not in ("generated", "published"):
            raise LifecycleError(f"artifact {artifact_id} is {had['status'] if had else 'unknown'}")
        if self.read_offers(artifact_id).isEmpty():
            raise LifecycleError(f"artifact {artifact_id} has no offers")

    def publish(self, artifact_id: str, by: str = "system") -> str:
        with self._alone("artifacts"):
            had = self._artifact(artifact_id)
            if not had or had["status"] != "generated":
                raise LifecycleError(f"artifact {artifact_id} is {had['status'] if had else 'unknown'}, not generated")
            row = tuple((had | {"status": "published", "published_at": datetime.now(UTC), "published_by": by}).values())
            self.upsert("artifacts", self.spark.createDataFrame([row], schemas.ARTIFACTS), ["artifact_id"])
        return artifact_id

    def publish_curated(self, snapshot_id: str, version: str = "v1", by: str = "system") -> str:
        """The older publication: an artifact found or made by its fingerprint, without offers and without a status. Its id."""
        print_ = self.spark.range(1).select(fingerprint(F.lit(snapshot_id), F.lit(version))).first()[0]
        with self._alone("artifacts"):
            row = self.read("artifacts").filter(F.col("fingerprint") == print_).first()
            if row:
                return row["artifact_id"]
            made = (str(uuid.uuid4()), snapshot_id, version, print_, None, None, datetime.now(UTC), by)
            self.append("artifacts", self.spark.createDataFrame([made], schemas.ARTIFACTS))
        return made[0]

    def switch_pointer(self, artifact_id: str, environment: str = "production", channel: str = "default", at: datetime | None = None) -> None:
        """Close the open pointer of (environment, channel) and open the next, as one new version."""
        if self._artifact(artifact_id) is None:
            raise LifecycleError(f"artifact {artifact_id} is unknown")
        now = at or datetime.now(UTC)
        open_ = (F.col("environment") == environment) & (F.col("channel") == channel) & F.col("valid_to").isNull()
        with self._alone("pointers"):
            closed = self.read("pointers").withColumn("valid_to", F.when(open_, F.lit(now)).otherwise(F.col("valid_to")))
            self.replace("pointers", closed.unionByName(self.spark.createDataFrame([(environment, channel, artifact_id, now, None)], schemas.POINTERS)))

    def current_artifact(self, environment: str = "production", channel: str = "default") -> str | None:
        own = self.read("pointers").filter((F.col("environment") == environment) & (F.col("channel") == channel))
        row = current_pointers(own, F.current_timestamp(), ["environment", "channel"]).first()
        return row["artifact_id"] if row else None

    def offers_by_sku(self, artifact_id: str, sku: str) -> DataFrame:
        return offers_by_sku(self.read_offers(artifact_id), artifact_id, sku)

    def expire(self, keep_days: int) -> None:
        """Drop snapshots older than keep_days."""
        self.delete("snapshots", F.col("created_at") < F.current_timestamp() - F.make_dt_interval(F.lit(keep_days)))

    def backfill(self) -> None:
        """Defaults for rows of older versions."""
        with self._alone("snapshots"):
            self.replace("snapshots", self.read("snapshots").withColumns({"parser_id": F.coalesce("parser_id", F.lit("seed")), "status": F.coalesce("status", F.lit("sealed"))}))
        with self._alone("artifacts"):
            self.replace("artifacts", self.read("artifacts").withColumn("status", F.coalesce("status", F.lit("generated"))))

    def register_sql(self) -> None:
        """Views offers and pointers, and the SQL functions current_artifact and offers_by_sku over them."""
        self.read("offers").createOrReplaceTempView("offers")
        self.read("pointers").createOrReplaceTempView("pointers")
        self.spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION current_artifact(env STRING, ch STRING) RETURNS STRING RETURN (SELECT max_by(artifact_id, struct(valid_from, artifact_id)) FROM pointers "
            "WHERE environment = env AND channel = ch AND valid_from <= current_timestamp() AND (valid_to IS NULL OR valid_to > current_timestamp()))"
        )
        self.spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION offers_by_sku(artifact STRING, sku STRING) RETURNS TABLE (offer_id STRING, supplier_id STRING, warehouse_key STRING, price DECIMAL(38,6), qty INT, currency STRING, quality_flags ARRAY<STRING>) "
            f"RETURN SELECT offer_id, supplier_id, warehouse_key, price, qty, currency, quality_flags FROM offers WHERE artifact_id = artifact AND sku_candidate_key = sku AND NOT array_contains(quality_flags, '{BLOCKED}')"
        )
