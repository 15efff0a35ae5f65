"""Reports over rows: coverage, JSON array statistics, conflict audit and its roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.functions.hashing import core_key
from tarifold.sources.files import json_categories, json_kind


def field_coverage(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, filled and total of each field, in one pass."""
    counts = rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in fields.items()))
    return counts.select("total", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("filled")) for k in fields))).alias("f")).select("f.field", "f.filled", "total")


def extraction_report(rows: DataFrame) -> DataFrame:
    """One row of totals whose identities hold. rows: row_no, rejected, qty_values (array, null = none)."""
    with_qty = ~F.col("rejected") & (F.size(F.filter("qty_values", lambda q: q.isNotNull())) > 0)
    lines = F.sum(F.when(with_qty, F.size(F.filter("qty_values", lambda q: q.isNotNull()))).otherwise(0))
    one = rows.agg(F.count("*").alias("total_input_rows"), F.count_if("rejected").alias("rejected_input_rows"), F.count_if(with_qty).alias("rows_with_qty"), F.coalesce(lines, F.lit(0)).alias("canonical_rows"))
    one = one.withColumn("accepted_input_rows", F.col("total_input_rows") - F.col("rejected_input_rows"))
    return one.withColumns({"skipped_no_qty_rows": F.col("accepted_input_rows") - F.col("rows_with_qty"), "exploded_rows_count": F.col("canonical_rows") - F.col("rows_with_qty")})


def confidence_summary(mapped: DataFrame) -> DataFrame:
    """Mapped columns (file, column_index, confidence) by confidence: one row each of HIGH, MEDIUM and LOW, 0 where there is none."""
    levels = mapped.sparkSession.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "confidence string")
    return F.broadcast(levels).join(mapped.groupBy("confidence").agg(F.count("*").alias("n")), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def with_error_row(rows: DataFrame, failed: Column, message: str) -> DataFrame:
    """rows, and a row of nulls but for error where the aggregate test failed holds over all of them."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    error = rows.agg(failed.alias("__failed")).filter("__failed").select(*none, F.lit(message).alias("error"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(error)


def with_context(rows: DataFrame, context: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the runs that a context table names."""
    return rows.join(context.select(*on).distinct(), on)


def array_lengths(texts: DataFrame, column: str = "value") -> DataFrame:
    """key and number of elements of each top-level array."""
    parts = json_categories(texts, column).filter(json_kind(F.col("value")) == "array")
    return parts.select("key", F.size(F.from_json("value", "array<string>")).alias("items"))


def json_summary(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row over all top-level values: keys, arrays, objects, other values, elements and their floored average."""
    kind = json_kind(F.col("value"))
    size = F.when(kind == "array", F.size(F.from_json("value", "array<string>")))
    one = json_categories(texts, column).agg(
        F.count("*").alias("keys"), F.count_if(kind == "array").alias("arrays"), F.count_if(kind == "object").alias("objects"), F.count_if(F.coalesce(~kind.isin("array", "object"), F.lit(True))).alias("values"),
        F.coalesce(F.sum(size), F.lit(0)).alias("items"),
    )
    return one.withColumn("average", F.when(F.col("arrays") == 0, F.lit(0)).otherwise(F.expr("items div arrays")).cast("long"))


def conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Claims (item_id, field, value) of two levels that disagree: mismatch, l1_missing or l2_missing."""
    a, b = first.select("item_id", "field", F.col("value").alias("l1_value")), second.select("item_id", "field", F.col("value").alias("l2_value"))
    both = a.join(b, ["item_id", "field"], "full_outer")
    kind = F.when(F.col("l1_value").isNull(), "l1_missing").when(F.col("l2_value").isNull(), "l2_missing").when(F.col("l1_value") != F.col("l2_value"), "mismatch")
    return both.withColumn("conflict_type", kind).filter("conflict_type is not null")


def audited(found: DataFrame, rule_id: str) -> DataFrame:
    """Conflicts with their signature."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return found.withColumn("signature_core", core_key(F.col("field"), F.lit(rule_id), blank("l1_value"), blank("l2_value"), F.col("conflict_type"), F.lit("")))


def signature_rollup(audit: DataFrame) -> DataFrame:
    """Per signature: first and last seen, count, the number of suppliers and their set."""
    return audit.groupBy("signature_core").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("total_count"), F.count_distinct("supplier_id").alias("suppliers"), F.array_sort(F.collect_set("supplier_id")).alias("affected_suppliers"))


def accepted_only_once(runs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Runs not accepted before."""
    return runs.join(accepted.select("run_id"), "run_id", "left_anti")


def union_contracts(*lines: DataFrame) -> DataFrame:
    """Lines of several suppliers as one frame, by column name."""
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def content_checksum(items: DataFrame) -> DataFrame:
    """One row that tells whether two snapshots hold the same items: count and an order-free digest; ids don't count."""
    digest = F.xxhash64(F.to_json(F.struct("supplier_id", "raw", "quality_flags"), {"ignoreNullFields": "false"}))
    return items.agg(F.count("*").alias("items"), F.coalesce(F.sum(digest.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def reprocessed(items: DataFrame, snapshot_id: str, supplier_id: str | None = None, signatures: DataFrame | None = None) -> DataFrame:
    """Items of a new snapshot: of one supplier, or those with a given conflict signature (item_id)."""
    found = items if supplier_id is None else items.filter(F.col("supplier_id") == supplier_id)
    if signatures is not None:
        found = found.join(signatures.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi").select(*items.columns)
    return found.withColumns({"snapshot_id": F.lit(snapshot_id), "id": F.sha2(F.concat_ws("|", F.lit(snapshot_id), "id"), 256)})


def reviewed_flags(items: DataFrame, audit: DataFrame, states: DataFrame) -> DataFrame:
    """Items with needs_review where they have a conflict and the block flag where their supplier is blocked.

    states: supplier_id, state (normal, degraded, blocked), one row each.
    """
    doubted = audit.select(F.col("item_id").alias("id")).distinct().withColumn("__doubt", F.lit("needs_review"))
    joined = items.join(doubted, "id", "left").join(states.select("supplier_id", F.when(F.col("state") == "blocked", "blocked_for_aggregation").alias("__block")), "supplier_id", "left")
    flags = F.array_union(F.coalesce("quality_flags", F.array().cast("array<string>")), F.array_compact(F.array("__doubt", "__block")))
    return joined.withColumn("quality_flags", flags).select(*items.columns)
