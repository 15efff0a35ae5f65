"""Runs: emit -> gate -> accept once -> curate, and the batch over an inbox.

Accepting a run has a fixed order: segment, then manifest, then marker. The
marker's existence is the idempotency key; anything without it never happened.
The line files of one run are written by Spark side by side, in row order, and
joined to one file (a run is one price list); the fact store as a whole is read
by partition (supplier, parser, month).
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold import schemas, storage
from tarifold.functions.hashing import utc_month, utc_text
from tarifold.operators import contract, emit, gate
from tarifold.operators.dispatch import Plan, Registry
from tarifold.sources.files import read_json_category, read_lines, scan_inbox
from tarifold.sources.grid import read_grid
from tarifold.sources.mapping import hash_lf, load_mapping, mapping_bytes


class RunError(RuntimeError):
    """A failed run; code is the exit code of the command line."""

    def __init__(self, message: str, code: int):
        super().__init__(message)
        self.code = code


def dump(document: dict) -> str:
    """Canonical JSON: sorted keys, no blanks, text as it is."""
    return json.dumps(document, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


write_text = storage.write_text


def read_json(path: str) -> dict:
    return json.loads(storage.read_text(path))


def _sorted_struct(field):
    """A struct column's fields in alphabetical order, recursively, for canonical JSON."""

    def walk(c, kind):
        if kind.typeName() == "struct":
            return F.struct(*(walk(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return c

    return walk(F.col(field.name), field.dataType).alias(field.name)


def canonical_lines(lines: DataFrame, order: list[str] = ()) -> DataFrame:
    """One text column of canonical JSON lines, in the given order or as they come. Nulls are written out."""
    fields = sorted(lines.schema.fields, key=lambda f: f.name)
    if order:
        lines = lines.orderBy(*order)
    return lines.select(F.to_json(F.struct(*(_sorted_struct(f) for f in fields)), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A text frame as one file, complete or not there. Partitions are written side by side and joined in their order."""
    folder = f"{path}.parts"
    lines.write.mode("overwrite").option("compression", "none").text(folder)
    parts = [f"{folder}/{n}" for n in storage.names(folder) if n.startswith("part-")]
    if len(parts) == 1:
        storage.replace(parts[0], path)
    else:
        storage.join(parts, path)
    storage.delete(folder)


def emit_run(spark: SparkSession, source: str, mapping_path: str, effective_at: str, run_id: str, out_dir: str, supplier_id: str, parser_id: str, grid: DataFrame | None = None) -> dict:
    """Typed emitter over one workbook: good.ndjson, bad_rows.ndjson and stats.json in out_dir; the stats."""
    mapping = load_mapping(mapping_path)
    at = utc_text(effective_at)
    run = {"supplier_id": supplier_id, "parser_id": parser_id, "mapping_version": mapping.version, "mapping_hash": mapping.hash, "run_id": run_id, "effective_at": at}
    try:
        grid = read_grid(spark, source, mapping.sheet) if grid is None else grid
        lines = emit.emit_typed(emit.price_rows(grid, mapping).repartition("row_no"), mapping.price_scale).persist()
        stats = emit.stats_document(lines, run) | {"input_file": source}
    except Exception as e:
        write_text(f"{out_dir}/stats.json", dump(run | {"input_file": source, "file_readable": False, "structure_ok": False, "good_rows": 0, "bad_rows": 0, "exploded_lines": 0, "source_rows_read": 0, "explosion_factor_exact": "0", "flags_counts": {}, "bad_reasons_counts": {}}) + "\n")
        raise RunError(f"{source}: {e}", 2) from e
    write_lines(canonical_lines(emit.typed_contract(lines.orderBy("row_no", "wh_pos"), run)), f"{out_dir}/good.ndjson")
    bad = emit.bad_lines(lines.orderBy("row_no", "wh_pos")).select(
        *(F.lit(v).alias(k) for k, v in run.items()), F.struct(F.col("row_no").alias("source_row_number")).alias("_meta"), "reason_code",
        F.struct("article", "price_raw", "qty_raw", F.col("warehouse").alias("supplier_warehouse_name"), F.nullif(F.col("sku"), F.lit("")).alias("sku_candidate_key"), F.col("brand").alias("brand_raw"), F.col("name").alias("name_raw")).alias("raw"),
    )
    write_lines(canonical_lines(bad), f"{out_dir}/bad_rows.ndjson")
    lines.unpersist()
    write_text(f"{out_dir}/stats.json", dump(stats) + "\n")
    return stats


def _write_run(lines: DataFrame, stats: dict, out: str, stats_out: str) -> dict:
    write_lines(canonical_lines(lines), out)
    write_text(stats_out, dump(stats) + "\n")
    return stats


def string_run(spark: SparkSession, source: str, mapping_path: str, layout: str, run_id: str, out: str, stats_out: str, supplier_id: str, parser_id: str, grid: DataFrame | None = None) -> dict:
    """String contract of one workbook: lines in row order and stats. Any mapping dialect will do; warehouses take the header's names."""
    mapping = load_mapping(mapping_path, strict=False)
    try:
        grid = read_grid(spark, source, mapping.sheet) if grid is None else grid
        head = grid.filter(F.col("row_no") == mapping.header_row).first()
    except Exception as e:
        raise RunError(f"{source}: {e}", 2) from e
    lines = emit.emit_strings(emit.price_rows(grid, mapping, head["cells"] if head else None).repartition("row_no")).persist()
    stats = emit.string_stats(lines).first().asDict() | {"flags_counts": {r["flag"]: r["n"] for r in emit.string_flag_counts(lines).collect()}, "supplier_id": supplier_id, "parser_id": parser_id, "layout": layout, "run_id": run_id}
    _write_run(emit.string_contract(lines.orderBy("row_no", "wh_pos"), supplier_id, parser_id, run_id, mapping.currency), stats, out, stats_out)
    lines.unpersist()
    return stats


def headed_run(spark: SparkSession, source: str, sheet: str, layout: str, out: str, stats_out: str, supplier_id: str, at: str, header_row: int = 6, max_rows: int | None = None, grid: DataFrame | None = None) -> dict:
    """Item contract of a header-addressed sheet. A sheet without that header is skipped with empty output; a missing sheet is code 3."""
    if not layout.startswith("category:"):
        raise RunError(f"layout must be category:<key>, not {layout}", 2)
    category = layout.split(":", 1)[1]
    named = {"category_key": category, "sheet_name": sheet}
    try:
        grid = read_grid(spark, source, sheet) if grid is None else grid.filter(F.col("sheet") == sheet)
        rows, reason = emit.headed_rows(grid, header_row)
    except Exception as e:
        raise RunError(f"{source}: {e}", 3) from e
    if rows is None:
        empty, stats = skipped(spark, reason)
        return _write_run(empty, named | stats, out, stats_out)
    capped = emit.cap_rows(rows.withColumn("row_no", F.col("row_no") - header_row), max_rows)
    lines = emit.emit_headed(capped.repartition("row_no")).persist()
    stats = named | emit.headed_stats(lines).first().asDict() | {"status": "OK"}
    _write_run(emit.headed_contract(lines.orderBy("row_no"), supplier_id, category, sheet, at), stats, out, stats_out)
    lines.unpersist()
    return stats


def category_run(spark: SparkSession, source: str, layout: str, out: str, stats_out: str, supplier_id: str, at: str) -> dict:
    """Item contract of one category of a JSON dump; codes 2, 3 and 4 as read_json_category has them."""
    lines = emit.emit_category(read_json_category(spark, source, layout)).persist()
    counts = emit.category_stats(lines).first().asDict()
    category = layout.split(":", 1)[1]
    stats = counts | {"supplier_id": supplier_id, "parser_id": f"{supplier_id}__{category}__json_v1", "layout": layout, "category_key": category, "lines": counts["emitted_items"]}
    _write_run(emit.category_contract(lines.orderBy("pos"), supplier_id, category, at), stats, out, stats_out)
    lines.unpersist()
    return stats


SHEETS = {"tyres": emit.TYRES, "wheels": emit.WHEELS}


def sheet_run(spark: SparkSession, source: str, sheet: str, layout: str, run_id: str, out: str, stats_out: str, supplier_id: str, parser_id: str, warehouse: str, grid: DataFrame | None = None) -> dict:
    """String contract of a positional sheet (layout tyres or wheels); a missing sheet is code 1."""
    try:
        grid = read_grid(spark, source, sheet) if grid is None else grid.filter(F.col("sheet") == sheet)
        if grid.isEmpty():
            raise ValueError(f"sheet not found: {sheet}")
    except Exception as e:
        raise RunError(f"{source}: {e}", 1) from e
    lines = emit.emit_sheet(emit.sheet_rows(grid, SHEETS[layout]).repartition("row_no"), zero_price_apart=layout == "wheels").persist()
    fates = {r["fate"]: r["n"] for r in emit.fate_counts(lines).collect()}
    stats = {"lines": fates.pop("emit", 0), "fates": fates, "flags_counts": {r["flag"]: r["n"] for r in emit.sheet_flag_counts(lines).collect()}, "run_id": run_id, "parser_id": parser_id}
    _write_run(emit.sheet_contract(lines.orderBy("row_no"), supplier_id, parser_id, run_id, sheet, warehouse), stats, out, stats_out)
    lines.unpersist()
    return stats


def skipped(spark: SparkSession, reason: str) -> tuple[DataFrame, dict]:
    """Output of a sheet that is left out: no lines, and stats that say why."""
    return spark.createDataFrame([], schemas.ITEM_LINE), {"rows_seen": 0, "rows_emitted": 0, "reason": reason, "status": "SKIP"}


def execute_plan(spark: SparkSession, plan: Plan, out_dir: str, run_id: str, at: str) -> dict:
    """Run the emitter a plan names; outputs are <tag>.<run id>.ndjson and .stats.json (a folder of them for the typed one)."""
    path, base = plan.path.removeprefix("file:"), f"{out_dir}/{plan.tag}.{run_id}"
    if plan.emitter == "category":
        return category_run(spark, path, plan.layout, f"{base}.ndjson", f"{base}.stats.json", plan.supplier, at)
    if plan.emitter == "strings":
        return string_run(spark, path, plan.mapping, plan.layout, run_id, f"{base}.ndjson", f"{base}.stats.json", plan.supplier, f"{plan.supplier}_{plan.layout}_v1")
    return emit_run(spark, path, plan.mapping, at, run_id, base, plan.supplier, f"{plan.supplier}_{plan.layout}_v1")


def extraction_run(canonical: DataFrame, rejected: DataFrame, report: dict, out_dir: str, supplier: str) -> None:
    """The extractor's artifacts: canonical and rejected rows as sorted NDJSON, the report, and the canonical rows as a table.

    The table is laid out by supplier and sorted by article and warehouse, so
    that look-ups by these skip most of it, as by an index.
    """
    place = ["source_file", "source_table", "row_index", "qty_column_index"]
    write_lines(canonical_lines(canonical, place), f"{out_dir}/{supplier}/canonical.ndjson")
    write_lines(canonical_lines(rejected, ["row_index"]), f"{out_dir}/{supplier}/rejected.ndjson")
    write_text(f"{out_dir}/{supplier}/report.json", dump(report) + "\n")
    canonical.repartition("supplier").sortWithinPartitions("supplier", "article", "warehouse").write.mode("append").partitionBy("supplier").parquet(f"{out_dir}/canonical_items")


def combine_extractions(spark: SparkSession, out_dir: str) -> None:
    """All suppliers' canonical lines in one file, by supplier and then in their own order."""
    lines = read_lines(spark, f"{out_dir}/*/canonical.ndjson").filter(~F.col("file").endswith("/all/canonical.ndjson"))
    write_lines(lines.orderBy("file", "line_no").select("value"), f"{out_dir}/all/canonical.ndjson")


def gate_run(spark: SparkSession, stats_path: str, out: str | None = None, baseline_path: str | None = None) -> dict:
    baseline = read_json(baseline_path) if baseline_path and storage.exists(baseline_path) else None
    verdict = gate.gate_document(spark, read_json(stats_path), baseline)
    if out:
        write_text(out, dump(verdict) + "\n")
    return verdict


def ingest_run(spark: SparkSession, good: str, stats_path: str, verdict_path: str, root: str, mapping_path: str | None = None) -> dict:
    """Accept a run into the fact store, once."""
    stats, verdict = read_json(stats_path), read_json(verdict_path)
    run_id = stats["run_id"]
    if verdict["verdict"] == gate.FAIL or verdict.get("run_id", run_id) != run_id:
        raise RunError(f"run {run_id} did not pass the gate", 20)
    marker = f"{root}/accepted_runs/{run_id}.json"
    if storage.exists(marker):
        return {"status": "already_ingested", "run_id": run_id}
    try:
        with storage.exclusive(f"{root}/locks/{run_id}.lock"):
            expected = {k: str(stats[k]) for k in ("supplier_id", "parser_id", "run_id", "effective_at", "mapping_hash", "mapping_version")}
            lines = contract.parsed_lines(read_lines(spark, good)).select("line_no", "value", contract.contract_violation(expected=expected).alias("violation")).persist()
            bad = lines.filter("violation is not null").orderBy("line_no").select("line_no", "violation").first()
            if bad:
                raise RunError(f"line {bad['line_no']}: {bad['violation']}", 20)
            n = lines.count()
            if n != int(stats["good_rows"]):
                raise RunError(f"good_rows is {stats['good_rows']}, there are {n} lines", 20)
            segment = f"{root}/facts/{stats['supplier_id']}/{stats['parser_id']}/{utc_month(stats['effective_at'])}/{run_id}.ndjson"
            write_lines(lines.orderBy("line_no").select("value"), segment)
            lines.unpersist()
            now = utc_text(datetime.now(UTC).isoformat())
            manifest_path = f"{root}/manifests/{run_id}.json"
            manifest = expected | {
                "ingestion_version": "1.0.0", "counts": {"lines_written": n}, "ingested_at": now, "paths": {"segment": segment, "stats": stats_path, "verdict": verdict_path, "mapping": mapping_path, "accepted_marker": marker},
                "sha256": {k: storage.sha256(p) for k, p in {"segment": segment, "good_input": good, "stats": stats_path, "verdict": verdict_path}.items()} | {"mapping_lf": hash_lf(mapping_bytes(mapping_path)) if mapping_path else None},
            }
            write_text(manifest_path, dump(manifest))
            write_text(marker, dump({"status": "accepted", "run_id": run_id, "ingested_at": now, "manifest_ref": manifest_path}))
    except FileExistsError as e:
        raise RunError(f"run {run_id} is being ingested", 1) from e
    return {"status": "ingested", "run_id": run_id, "segment": segment, "manifest": manifest_path, "marker": marker}


def curate_run(spark: SparkSession, manifest_path: str, out_dir: str, max_dropped_samples: int = 50) -> dict:
    """Lines with stock to curated.ndjson, the first dropped ones to dropped_samples.ndjson, counts to curated.stats.json."""
    if not storage.exists(manifest_path):
        raise RunError(f"manifest not found: {manifest_path}", 1)
    manifest = read_json(manifest_path)
    segment = (manifest.get("paths") or {}).get("segment")
    if not segment or not storage.exists(segment):
        raise RunError(f"segment not found: {segment}", 1)
    checked = contract.parsed_lines(read_lines(spark, segment)).select("line_no", "value", contract.contract_violation(strict=False).alias("violation")).persist()
    rows = contract.typed_rows(checked.filter("violation is null")).withColumn("qty", F.col("parsed.qty"))
    counts = checked.agg(F.count("*").alias("input_lines"), F.count_if(F.col("violation") == "bad_json").alias("bad_json"), F.count_if(F.col("violation") != "bad_json").alias("bad_contract")).first().asDict()
    kept = contract.eligible(F.col("qty"))
    reason = F.when(~kept, contract.drop_reason(F.col("qty")))
    fates = rows.select("line_no", "effective_at", kept.alias("kept"), reason.alias("reason")).agg(F.count_if("kept").alias("kept_lines"), F.count_if(~F.col("kept")).alias("dropped_lines"), F.min_by("effective_at", "line_no").alias("effective_at"), *(F.count_if(F.col("reason") == r).alias(r) for r in contract.DROP_REASONS)).first().asDict()
    counts |= {"drop_counts": {r: n for r in contract.DROP_REASONS if (n := fates.pop(r))}} | fates
    base = f"{out_dir}/{manifest['run_id']}"
    write_lines(rows.filter(contract.eligible(F.col("qty"))).orderBy("line_no").select("value"), f"{base}/curated.ndjson")
    sample = contract.first_dropped(rows, ["line_no"], max_dropped_samples).select(
        F.lit(manifest["run_id"]).alias("run_id"), F.col("line_no").alias("seg_line_no"), F.struct("_meta.source_row_number").alias("_meta"), "sku_candidate_key", F.col("raw.supplier_warehouse_name").alias("supplier_warehouse_name"),
        "parsed", "quality_flags", "drop_reason", F.struct("raw.price_raw", "raw.qty_raw").alias("raw_snapshot"), F.col("line_no").alias("__n"),
    )
    samples = sample.orderBy("__n").select(F.to_json(F.struct(*sorted(c for c in sample.columns if c != "__n")), {"ignoreNullFields": "false"}).alias("value"))
    write_lines(samples, f"{base}/dropped_samples.ndjson")
    checked.unpersist()
    stats = counts | {"run_id": manifest["run_id"], "input_segment_sha256": storage.sha256(segment), "max_dropped_samples": max_dropped_samples}
    write_text(f"{base}/curated.stats.json", dump(stats))
    return stats


def full_run(spark: SparkSession, source: str, mapping_path: str, effective_at: str, run_id: str, root: str, supplier_id: str, parser_id: str, baseline_path: str | None = None, grid: DataFrame | None = None, revision: str | None = None) -> dict:
    """All steps of one price list and its run manifest. A WARN verdict is accepted. revision: of the code that runs."""
    work = f"{root}/runs/{run_id}"
    emit_run(spark, source, mapping_path, effective_at, run_id, work, supplier_id, parser_id, grid)
    verdict = gate_run(spark, f"{work}/stats.json", f"{work}/verdict.json", baseline_path)
    taken = ingest_run(spark, f"{work}/good.ndjson", f"{work}/stats.json", f"{work}/verdict.json", root, mapping_path)
    curated = curate_run(spark, f"{root}/manifests/{run_id}.json", f"{root}/curated")
    files = {"input": source, "good": f"{work}/good.ndjson", "bad": f"{work}/bad_rows.ndjson", "curated": f"{root}/curated/{run_id}/curated.ndjson"}
    digests = {k: storage.sha256(p) if storage.exists(p) else None for k, p in files.items()}
    digests |= {"mapping_lf": hash_lf(mapping_bytes(mapping_path)), "baseline": storage.sha256(baseline_path) if baseline_path and storage.exists(baseline_path) else None}
    document = {
        "run_id": run_id, "supplier_id": supplier_id, "parser_id": parser_id, "effective_at": utc_text(effective_at), "emitter_version": emit.EMITTER, "revision": revision, "verdict": verdict["verdict"], "ingest": taken["status"],
        "kept_lines": curated["kept_lines"], "paths": files | {"mapping": mapping_path, "baseline": baseline_path}, "sha256": digests,
    }
    write_text(f"{work}/run.manifest.json", dump(document))
    return document


def batch_run(spark: SparkSession, root: str, registry: Registry, execute, run_id: str, out: str, only_supplier: str | None = None, known_only: bool = False, at_once: int = 4) -> dict:
    """Plan every file of an inbox and execute the plans, some at once; failures are recorded and don't stop the batch.

    The file list is the unit of driver work, as in any scheduler; the content
    is read by the plans' Spark jobs, which share the cluster.
    """
    todo, unsupported = [], []
    for row in scan_inbox(spark, root).collect():
        if only_supplier and row["supplier"].lower() != only_supplier.lower():
            continue
        plans, reason = registry.plan(row["supplier"], row["path"])
        if reason:
            if not known_only or reason != "no adapter":
                unsupported.append({"file": row["path"], "supplier": row["supplier"], "reason": reason})
            continue
        todo += plans

    def one(plan: Plan) -> dict:
        head = {"file": plan.path, "layout": plan.layout, "tag": plan.tag}
        try:
            return head | {"rc": 0, "stats": execute(plan)}
        except Exception as e:
            return head | {"rc": getattr(e, "code", 1), "error": str(e)}

    with ThreadPoolExecutor(at_once) as pool:
        items = list(pool.map(one, todo))  # in the order of the plans
    report = {"run_id": run_id, "items": items, "unsupported": unsupported}
    write_text(out, dump(report))
    return report
