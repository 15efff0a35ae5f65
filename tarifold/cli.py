"""Command line of the emitters and of the steps after them. Exit codes are part of the interface.

emit 0/1/2/3, emit-strings 0/1/2/3, emit-headed 0/2/3, emit-category 0/2/3/4,
emit-sheet 0/1, dispatch 0/2 (2: a file that meets no rule or several), gate
0/10/20, ingest 0/1/20, curate 0/1, run, batch.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import yaml

from tarifold.functions.hashing import utc_text
from tarifold.operators import dispatch
from tarifold.plans import runs
from tarifold.sources.files import DumpError, dump_categories
from tarifold.sources.grid import read_grid
from tarifold.sources.mapping import MappingError


def session() -> SparkSession:
    return SparkSession.builder.appName("tarifold").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tarifold")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options: bool):
        p = sub.add_parser(name)
        for option, required in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", required=required)
        return p

    command("emit", input=True, mapping=True, effective_at=True, run_id=True, out_dir=True, supplier=True, parser=True)
    command("emit-strings", input=True, mapping=True, layout=True, run_id=True, out=True, stats_out=True, supplier=True, parser=True)
    headed = command("emit-headed", input=True, sheet=True, layout=True, out=True, stats_out=True, supplier=True)
    headed.add_argument("--max-rows", type=int)
    headed.add_argument("--header-row", type=int, default=6)
    command("emit-category", input=True, layout=True, out=True, stats_out=True, supplier=True)
    command("emit-sheet", input=True, sheet=True, layout=True, run_id=True, out=True, stats_out=True, supplier=True, parser=True, warehouse=True)
    command("dispatch", input=True, rules=True)
    command("gate", stats=True, out=False, baseline=False)
    command("ingest", good=True, stats=True, verdict=True, mapping=False, root=True)
    curate = command("curate", manifest=True, out_dir=True)
    curate.add_argument("--max-dropped-samples", default=50, type=int)
    command("run", input=True, mapping=True, effective_at=True, run_id=True, root=True, supplier=True, parser=True, baseline=False)
    command("batch", root=True, out=True, run_id=True, suppliers=True, effective_at=True, work=True, only_supplier=False).add_argument("--known-only", action="store_true")
    return top


def registry_of(path: str, spark: SparkSession) -> dispatch.Registry:
    """Adapters of a YAML list: names, kind (workbook or dump), for workbooks emitter and mappings by layout."""
    registry = dispatch.Registry()
    with open(path, encoding="utf-8") as file:
        for entry in yaml.safe_load(file) or []:
            supplier = entry["names"][0].lower()
            if entry["kind"] == "dump":
                made = dispatch.dump_adapter(supplier, lambda p: dump_categories(spark, p))
            else:
                made = dispatch.workbook_adapter(supplier, entry["mappings"], entry.get("emitter", "strings"))
            registry.add(tuple(entry["names"]), made)
    return registry


def dispatch_files(spark: SparkSession, path: str, rules_path: str) -> int:
    """Print each file's layout by its first two rows; 0 if every file meets exactly one rule, else 2."""
    with open(rules_path, encoding="utf-8") as file:
        listed = yaml.safe_load(file) or []
    rules = spark.createDataFrame([(r["rule"], r["layout"], r.get("cols"), r.get("row1", []), r.get("row2", [])) for r in listed], "rule string, layout string, cols int, row1_tokens array<string>, row2_tokens array<string>")
    pick = lambda n: F.max(F.when(F.col("row_no") == n, F.col("cells"))).alias(f"row{n}")
    heads = read_grid(spark, path).filter("row_no <= 2").groupBy(F.col("source_file").alias("file")).agg(F.max(F.size("cells")).alias("cols"), pick(1), pick(2))
    found = dispatch.match_rules(heads, rules).orderBy("file").collect()  # a row a file
    for r in found:
        print(json.dumps({"file": r["file"], "layouts": r["layouts"], "status": r["status"]}, ensure_ascii=False))
    return 0 if found and all(r["status"] == "OK" for r in found) else 2


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or session()
    try:
        if a.command == "emit":
            runs.emit_run(spark, a.input, a.mapping, a.effective_at, a.run_id, a.out_dir, a.supplier, a.parser)
        elif a.command == "emit-strings":
            runs.string_run(spark, a.input, a.mapping, a.layout, a.run_id, a.out, a.stats_out, a.supplier, a.parser)
        elif a.command == "emit-headed":
            runs.headed_run(spark, a.input, a.sheet, a.layout, a.out, a.stats_out, a.supplier, utc_text(datetime.now(UTC).isoformat()), a.header_row, a.max_rows)
        elif a.command == "emit-category":
            runs.category_run(spark, a.input, a.layout, a.out, a.stats_out, a.supplier, utc_text(datetime.now(UTC).isoformat()))
        elif a.command == "emit-sheet":
            runs.sheet_run(spark, a.input, a.sheet, a.layout, a.run_id, a.out, a.stats_out, a.supplier, a.parser, a.warehouse)
        elif a.command == "dispatch":
            return dispatch_files(spark, a.input, a.rules)
        elif a.command == "gate":
            return runs.gate_run(spark, a.stats, a.out, a.baseline)["exit_code"]
        elif a.command == "ingest":
            print(runs.dump(runs.ingest_run(spark, a.good, a.stats, a.verdict, a.root, a.mapping)), file=sys.stderr)
        elif a.command == "curate":
            runs.curate_run(spark, a.manifest, a.out_dir, a.max_dropped_samples)
        elif a.command == "run":
            runs.full_run(spark, a.input, a.mapping, a.effective_at, a.run_id, a.root, a.supplier, a.parser, a.baseline)
        else:
            execute = lambda plan: runs.execute_plan(spark, plan, a.work, a.run_id, a.effective_at)
            runs.batch_run(spark, a.root, registry_of(a.suppliers, spark), execute, a.run_id, a.out, a.only_supplier, a.known_only)
    except (runs.RunError, MappingError, DumpError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return e.code
    except ValueError as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 20 if a.command == "gate" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
