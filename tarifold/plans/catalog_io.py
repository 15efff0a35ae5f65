"""Queries over what the engine reads and writes: sources, sinks, runs, life cycle, streams, each with its DuckDB oracle.

A query writes its input in the form a source expects into the shared scratch
folder, lets the operators run on it and reads the outcome back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold import schemas, storage
from tarifold.functions.hashing import utc_month, utc_text
from tarifold.functions.text import signature_tokens
from tarifold.operators import contract, dispatch, emit, offers, reports
from tarifold.plans import catalog as base
from tarifold.plans import runs
from tarifold.session import scratch
from tarifold.sources import files
from tarifold.sources.grid import read_grid
from tarifold.streaming import inbox

RUN = {"supplier_id": "acme", "parser_id": "acme_v1", "mapping_version": "1", "mapping_hash": "h", "run_id": "r1", "effective_at": "2026-02-02T21:30:00Z"}


def _await(query) -> None:
    query.awaitTermination(600)
    if query.exception() is not None:
        raise query.exception()


# ---- text sources


def _event_file(spark: SparkSession, sf: str) -> str:
    """The defective JSON lines as one file, some preceded by a blank line."""
    path = f"{scratch(spark, 'lines')}/events.ndjson"
    blank = F.when(F.col("line_no") % 10 == 3, "\n").otherwise("")
    runs.write_lines(base._json_lines(spark, sf).orderBy("line_no").select(F.concat(blank, "value").alias("value")), path)
    return path


FILE_SQL = f"with {base.LINES_SQL}, placed as (select *, line_no + 1 + count(*) filter (line_no % 10 = 3) over (order by line_no) as physical from lines)"


def q_ndjson_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Physical line numbers of a split file with both contract checks."""
    lines = contract.parsed_lines(files.read_lines(spark, _event_file(spark, sf)))
    return lines.select("line_no", contract.contract_violation(base.NEEDED).alias("strict"), contract.contract_violation(base.NEEDED, strict=False).alias("permissive"))


def q_ndjson_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Permissive typed read: rows by whether they parse."""
    rows = files.read_ndjson(spark, _event_file(spark, sf), "k int")
    return rows.groupBy(F.col("_corrupt_record").isNotNull().alias("corrupt")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def _dump_file(spark: SparkSession, sf: str) -> str:
    """One JSON document: an array of parts whose ids are numbers, texts, "0", "false", 0, false, null and blank, and two other keys."""
    k = F.col("p_partkey")
    shown = k.cast("string")
    id_ = F.element_at(F.array(shown, F.concat(F.lit('" P'), shown, F.lit(' "')), F.lit('"0"'), F.lit('"false"'), F.lit("0"), F.lit("false"), F.lit("null"), F.lit('""')), (k % 8 + 1).cast("int"))
    stock = F.element_at(F.array(F.lit('"?"'), F.lit("0"), (k % 50).cast("string"), F.concat(F.lit('"'), (k % 9 + 1).cast("string"), F.lit('"'))), (k % 4 + 1).cast("int"))
    item = F.when(k % 31 == 0, "3").otherwise(F.concat(F.lit('{"id":'), id_, F.lit(',"stock":'), stock, F.lit(',"name":"'), F.col("p_name"), F.lit('","image":"","img_url":"u","price_minimum":'), F.when(k % 6 == 0, '"x"').otherwise(shown), F.lit("}")))
    rows = base._read(spark, sf, "part").select(F.struct(k.alias("k"), item.alias("item")).alias("r"))
    one = rows.agg(F.concat(F.lit('{"tyres":['), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["item"]), ","), F.lit('],"rims":[],"n":1}')).alias("value"))
    path = f"{scratch(spark, 'dump')}/stock.json"
    runs.write_lines(one, path)
    return path


DUMP_SQL = f"""with d0 as (select row_number() over (order by p_partkey) - 1 as pos, p_partkey as k, p_name as name from part),
d1 as (select *, k % 31 <> 0 as is_object, [k::varchar, ' P' || k || ' ', '0', 'false', '0', 'false', null, ''][k % 8 + 1] as id, (k % 8 in (4, 5, 6, 7)) or (k % 8 = 0 and k = 0) as no_id, case k % 4 when 0 then null when 1 then 0 when 2 then k % 50 else k % 9 + 1 end as q, case when k % 6 <> 0 then k::double end as p from d0),
dump as (select *, case when not is_object then 'no_object' when no_id then 'no_id' when q is null then 'bad_qty' when q <= 0 then 'qty_empty' else 'emit' end as fate from d1)"""


def q_json_category_scan(spark: SparkSession, sf: str) -> DataFrame:
    return emit.emit_category(files.read_json_category(spark, _dump_file(spark, sf), "category:tyres")).select("pos", "fate")


def q_category_run(spark: SparkSession, sf: str) -> DataFrame:
    """The item lines that a category run writes, read back by their contract."""
    out = scratch(spark, "category")
    runs.category_run(spark, _dump_file(spark, sf), "category:tyres", f"{out}/o.ndjson", f"{out}/o.json", "acme", RUN["effective_at"])
    return files.read_ndjson(spark, f"{out}/o.ndjson", schemas.CATEGORY_LINE).select("parser_id", "layout", "ts_ingested", "item.supplier_item_id", "item.name", "item.qty", "item.price_opt", "item.image", "raw.category_key")


def q_dump_plans(spark: SparkSession, sf: str) -> DataFrame:
    """The plans of a supplier of dumps: one for each top-level array."""
    made = dispatch.dump_adapter("acme", lambda p: files.dump_categories(spark, p))(_dump_file(spark, sf))
    return spark.createDataFrame([(p.supplier, p.layout, p.tag, p.emitter) for p in made], "supplier string, layout string, tag string, emitter string")


def _inbox(spark: SparkSession, sf: str) -> str:
    """A folder per region with a file per nation; nations of region 0 lie loose at the top."""
    root = scratch(spark, "inbox")
    rows = base._read(spark, sf, "nation").join(base._read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_regionkey", "r_name").collect()  # 25 rows
    for r in rows:
        kind = ["диски.json", "грузовые.csv", "x.csv"][r["n_nationkey"] % 3]
        storage.write_text(f"{root}/{'' if r['r_regionkey'] == 0 else r['r_name'] + '/'}{r['n_name']}-{kind}", r["n_name"])
    return root


INBOX_SQL = "with f as (select case when r_regionkey = 0 then 'UNKNOWN' else r_name end as supplier, n_name || '-' || ['диски.json', 'грузовые.csv', 'x.csv'][n_nationkey % 3 + 1] as name, n_name, n_nationkey as k from nation join region on n_regionkey = r_regionkey)"


def q_inbox_scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_inbox(spark, _inbox(spark, sf)).select("supplier", "name", "length")


def q_inbox_plans(spark: SparkSession, sf: str) -> DataFrame:
    """What the adapters make of every file: layout by name, or the reason why there is no plan."""
    registry = dispatch.Registry()
    registry.add(("Africa", "Asia"), dispatch.workbook_adapter("acme", {"truck": "t.yaml", "tyres": "b.yaml"}))
    registry.add(("EUROPE",), dispatch.dump_adapter("acme", lambda p: None))
    out = []
    for row in files.scan_inbox(spark, _inbox(spark, sf)).collect():  # the listing of an inbox
        plans, reason = registry.plan(row["supplier"], row["path"])
        out += [(row["name"], p.layout, p.mapping, None) for p in plans] or [(row["name"], None, None, reason)]
    return spark.createDataFrame(out, "name string, layout string, mapping string, reason string")


def q_batch_report(spark: SparkSession, sf: str) -> DataFrame:
    """A batch over the inbox in which some plans fail: the report's items."""
    registry = dispatch.Registry()
    registry.add(("*",), lambda path: dispatch.Plan(path, "acme", "l", path.rsplit("/", 1)[-1]))

    def execute(plan: dispatch.Plan) -> dict:
        if plan.path.endswith("x.csv"):
            raise runs.RunError("no", 3)
        return {"ok": 1}

    root = _inbox(spark, sf)
    report = runs.batch_run(spark, root, registry, execute, "b1", f"{scratch(spark, 'batch')}/report.json")
    return spark.createDataFrame([(i["tag"], i["rc"]) for i in report["items"]], "name string, rc int")


def q_file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """sha256 of the inbox's files, by the stream of new files."""
    root, out = _inbox(spark, sf), scratch(spark, "seen")
    found = inbox.new_files(spark, root).select(F.substring_index("path", "/", -1).alias("name"), "digest")
    _await(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start())
    return spark.read.schema("name string, digest string").parquet(out)


def _part_csv(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "csv")
    rows = base._read(spark, sf, "part").orderBy("p_partkey").select("p_partkey", F.concat(F.lit("a, "), F.col("p_name")).alias("p_name"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("p_brand"))
    rows.coalesce(1).write.option("header", True).csv(path)
    name = next(n for n in storage.names(path) if n.endswith(".csv"))
    return f"{path.removeprefix('file:')}/{name}".replace("///", "/")


def q_grid_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A delimited file through the workbook source: 1-based rows of cells."""
    return read_grid(spark, _part_csv(spark, sf), first_row=2).select("row_no", F.array_join("cells", "|").alias("cells"))


def q_csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_csv_grid(spark, _part_csv(spark, sf))


def q_xml_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "xml")
    base._read(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" & <co>")).alias("n_name")).write.format("xml").option("rowTag", "nation").save(path)
    return files.read_xml_rows(spark, path, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def q_columns_of(spark: SparkSession, sf: str) -> DataFrame:
    base._read(spark, sf, "part").createOrReplaceTempView("tarifold_part")
    names = files.columns_of(spark, "tarifold_part")
    missing = files.columns_of(spark, "tarifold_no_such_table")
    return spark.createDataFrame([(n, True) for n in sorted(names)] + [("-", missing is not None)], "name string, found boolean")


# ---- sinks and runs


def q_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    n = base._read(spark, sf, "nation")
    return runs.canonical_lines(n.select(F.struct(F.col("n_name").alias("z"), F.col("n_regionkey").alias("a")).alias("raw"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("key"), F.array(F.lit("é"), F.lit('"')).alias("flags")))


def q_typed_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Typed lines as canonical JSON text."""
    return runs.canonical_lines(emit.typed_contract(base.typed(spark, sf), RUN))


MAPPING = """mapping_version: "1"
format_hints: {sheet: TDSheet, header_row_1based: 1, data_start_row_1based: 3}
defaults: {price_scale: 100, currency: RUB}
columns:
  article_primary: {type: column_position, column: 2}
  article_fallback: {type: column_position, column: 3}
  brand: {type: column_position, column: 4}
  name: {type: column_position, column: 5}
  price: {type: column_position, column: 6}
warehouses: [{column: 7, warehouse_name: Main Store}, {column: 8, warehouse_name: "North  Depot"}, {column: 9, warehouse_name: " South Depot "}, {column: 10, warehouse_name: West}]
"""


def _price_grid(spark: SparkSession, sf: str) -> DataFrame:
    """PL as a workbook grid with two header rows; part k is row k + 3."""
    p = base.price_list(spark, sf)
    cells = F.array(F.lit("x"), "article_primary", "article_fallback", "brand", "name", "price_raw", *(F.col("warehouses")[i]["qty_raw"] for i in range(4)))
    rows = p.select(F.lit("f.xls").alias("source_file"), F.lit("TDSheet").alias("sheet"), (F.col("row_no") + 3).cast("int").alias("row_no"), cells.alias("cells"))
    return spark.createDataFrame([("f.xls", "TDSheet", 1, [*["h"] * 6, *base.WAREHOUSES]), ("f.xls", "TDSheet", 2, ["h"] * 10)], schemas.GRID).unionByName(rows)


def _mapping(spark: SparkSession) -> str:
    path = f"{scratch(spark, 'mapping')}/m.yaml"
    storage.write_text(path, MAPPING)
    return path


def _emitted(spark: SparkSession, sf: str) -> str:
    out = scratch(spark, "run")
    runs.emit_run(spark, "f.xls", _mapping(spark), "2026-02-03T00:30:00+03:00", "r1", out, "acme", "acme_v1", _price_grid(spark, sf))
    return out


def q_run_good(spark: SparkSession, sf: str) -> DataFrame:
    """good.ndjson of a run, line by line in file order."""
    lines = files.read_lines(spark, f"{_emitted(spark, sf)}/good.ndjson")
    return contract.typed_rows(lines).select("line_no", F.col("_meta.source_row_number").alias("row_no"), F.col("raw.supplier_warehouse_name").alias("warehouse"), F.col("sku_candidate_key").alias("sku"), "parsed.price", "parsed.qty", F.array_join("quality_flags", ",").alias("flags"))


def q_run_bad(spark: SparkSession, sf: str) -> DataFrame:
    """bad_rows.ndjson of a run: a source row's warehouses in column order."""
    shape = "reason_code string, _meta struct<source_row_number:int>, raw struct<supplier_warehouse_name:string,sku_candidate_key:string,qty_raw:string>"
    lines = files.read_lines(spark, f"{_emitted(spark, sf)}/bad_rows.ndjson")
    return lines.select("line_no", F.from_json("value", shape).alias("r")).select("line_no", F.col("r._meta.source_row_number").alias("row_no"), F.col("r.raw.supplier_warehouse_name").alias("warehouse"), F.col("r.raw.sku_candidate_key").alias("sku"), "r.reason_code")


def q_run_stats(spark: SparkSession, sf: str) -> DataFrame:
    """stats.json and the verdict of a run."""
    out = _emitted(spark, sf)
    verdict = runs.gate_run(spark, f"{out}/stats.json", f"{out}/verdict.json")
    s = runs.read_json(f"{out}/stats.json")
    row = (s["source_rows_read"], s["exploded_lines"], s["good_rows"], s["bad_rows"], s["effective_at"], verdict["verdict"], ",".join(r["code"] for r in verdict["reasons"]))
    return spark.createDataFrame([row], "source_rows_read long, exploded_lines long, good_rows long, bad_rows long, effective_at string, verdict string, codes string")


def _full(spark: SparkSession, sf: str) -> tuple[str, dict]:
    root = scratch(spark, "store")
    source = f"{root}/f.xls"
    storage.write_text(source, "x")
    args = (spark, source, _mapping(spark), "2026-02-03T00:30:00+03:00", "r1", root, "acme", "acme_v1")
    return root, runs.full_run(*args, grid=_price_grid(spark, sf))


def q_full_run(spark: SparkSession, sf: str) -> DataFrame:
    """Emit, gate, ingest and curate: the curated lines."""
    root, _ = _full(spark, sf)
    return contract.typed_rows(files.read_lines(spark, f"{root}/curated/r1/curated.ndjson")).select("line_no", F.col("_meta.source_row_number").alias("row_no"), F.col("sku_candidate_key").alias("sku"), "parsed.price", "parsed.qty")


def q_accepted_run(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of an accepted run: segment in its month, manifest, marker, and the answer to a second ingestion."""
    root, document = _full(spark, sf)
    work, manifest, marker = f"{root}/runs/r1", runs.read_json(f"{root}/manifests/r1.json"), runs.read_json(f"{root}/accepted_runs/r1.json")
    again = runs.ingest_run(spark, f"{work}/good.ndjson", f"{work}/stats.json", f"{work}/verdict.json", root)
    segment = manifest["paths"]["segment"]
    row = (segment.removeprefix(root), manifest["counts"]["lines_written"], storage.sha256(segment) == manifest["sha256"]["segment"] == manifest["sha256"]["good_input"], marker["status"], document["ingest"], again["status"])
    return spark.createDataFrame([row], "segment string, lines long, same_bytes boolean, marker string, first string, second string")


def _curated(spark: SparkSession, sf: str) -> tuple[str, dict]:
    """A curation of a segment with every kind of line: kept, dropped, broken JSON, broken contract."""
    root = scratch(spark, "curate")
    lines = base.typed(spark, sf).filter(~F.col("fate").startswith("bad:")).withColumn("fate", F.lit("good")).persist()  # a sort samples its rows first
    good = runs.canonical_lines(emit.typed_contract(lines.orderBy("row_no", "wh_pos"), RUN))
    odd = spark.createDataFrame([("{broken",), ("{}",)], "value string")
    runs.write_lines(odd.coalesce(1).unionByName(good), f"{root}/segment.ndjson")
    lines.unpersist()
    storage.write_text(f"{root}/manifest.json", runs.dump({"run_id": "r1", "paths": {"segment": f"{root}/segment.ndjson"}}))
    return root, runs.curate_run(spark, f"{root}/manifest.json", root, 40)


def q_curate_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of a curation, dropped lines by reason, and the first effective time."""
    _, s = _curated(spark, sf)
    row = (s["input_lines"], s["bad_json"], s["bad_contract"], s["kept_lines"], s["dropped_lines"], s["drop_counts"].get("qty_missing", 0), s["drop_counts"].get("qty_nonpositive", 0), s["effective_at"])
    return spark.createDataFrame([row], "input_lines long, bad_json long, bad_contract long, kept_lines long, dropped_lines long, qty_missing long, qty_nonpositive long, effective_at string")


def q_curate_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first dropped lines of a curation as they are written: in file order, with their line numbers."""
    root, _ = _curated(spark, sf)
    lines = files.read_lines(spark, f"{root}/r1/dropped_samples.ndjson")
    return lines.select("line_no", F.from_json("value", "seg_line_no long, drop_reason string, sku_candidate_key string").alias("r")).select("line_no", "r.*")


def q_latest_file(spark: SparkSession, sf: str) -> DataFrame:
    """The newest .json file of a folder; of equal times the first by path."""
    root = scratch(spark, "latest")
    for r in base._read(spark, sf, "nation").collect():  # 25 rows
        path = f"{root}/{r['n_name']}.{'json' if r['n_nationkey'] % 2 else 'csv'}"
        storage.write_text(path, "x")
        fs, p = storage._at(path)
        fs.setTimes(p, (1_700_000_000 + r["n_nationkey"] * 7 % 13) * 1000, -1)
    return spark.createDataFrame([(files.latest_file(spark, root).rsplit("/", 1)[-1],)], "name string")


def q_utc_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times with an offset as UTC texts and their months, by the driver's function."""
    keys = [r["n_nationkey"] for r in base._read(spark, sf, "nation").collect()]  # 25 rows
    shown = [(k, f"2026-{k % 12 + 1:02d}-01T0{k % 10}:30:00+0{k % 6}:00") for k in keys]
    return spark.createDataFrame([(k, utc_text(t), utc_month(t)) for k, t in shown], "n_nationkey int, at string, month string")


def q_column_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that the column rules find in headers made of nations' names."""
    names = [r["n_name"] for r in base._read(spark, sf, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    rule = dispatch.ColumnRule
    rules = [rule("last", "header_contains", "24"), rule("seventh", "header_exact", "nation_7"), rule("any7", "header_contains", "_7", 5), rule("digits", "value_pattern", "[0-9]+"), rule("third", "column_position", 3), rule("none", "header_exact", "x")]
    found = dispatch.map_columns([f" {n}  " for n in names], [[str(i) if i == 4 else "a" for i in range(25)]], rules)
    return spark.createDataFrame([(at, field) for at, (field, _) in found.items()], "position int, field string")


def q_string_run(spark: SparkSession, sf: str) -> DataFrame:
    """The string lines that a run writes, warehouses named by the header."""
    out = scratch(spark, "strings")
    runs.string_run(spark, "f.xls", _mapping(spark), "tyres", "r1", f"{out}/o.ndjson", f"{out}/o.json", "acme", "acme_v1", _price_grid(spark, sf))
    lines = files.read_ndjson(spark, f"{out}/o.ndjson", schemas.STRING_LINE)
    return lines.select(F.col("_meta.source_row_1based").alias("row_no"), F.col("raw.supplier_warehouse_name").alias("warehouse"), F.col("raw.sku_candidate_key").alias("sku"), "raw.price", "raw.qty", "raw.currency", F.array_join("quality_flags", ",").alias("flags"))


def _flat_grid(spark: SparkSession, sf: str, layout: dict[str, int], head: list[str], head_row: int) -> DataFrame:
    """PL exploded, one (part, warehouse) a row, in the columns of a sheet; row numbers from head_row + 1."""
    flat = base._flat(spark, sf)
    at = {n: c for c, n in layout.items()}
    cells = F.array(*(F.coalesce(F.col(at[i]), F.lit("")) if i in at else F.lit("") for i in range(1, max(at) + 1)))
    rows = flat.select(F.lit("f.xlsx").alias("source_file"), F.lit("S").alias("sheet"), (F.col("row_no") * 4 + F.col("wh_pos") + head_row).cast("int").alias("row_no"), cells.alias("cells"))
    return spark.createDataFrame([("f.xlsx", "S", head_row, head)], schemas.GRID).unionByName(rows)


def q_headed_run(spark: SparkSession, sf: str) -> DataFrame:
    """The item lines of a header-addressed sheet, found by its header, capped at 3000 rows."""
    columns = {"article_primary": 1, "name": 2, "article_fallback": 3, "price_raw": 4, "warehouse": 5, "qty_raw": 6}
    grid = _flat_grid(spark, sf, columns, list(emit.HEADED.values()), 6)
    out = scratch(spark, "headed")
    runs.headed_run(spark, "f.xlsx", "S", "category:rims", f"{out}/o.ndjson", f"{out}/o.json", "acme", RUN["effective_at"], max_rows=3000, grid=grid)
    return files.read_ndjson(spark, f"{out}/o.ndjson", schemas.ITEM_LINE).select("parser_id", "item.supplier_item_id", "item.name", "item.article", "item.qty", "item.price_opt", "raw.sheet", "raw.warehouse")


def q_headed_skip(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet without the columns: empty output and stats that say SKIP."""
    out = scratch(spark, "headed")
    grid = _flat_grid(spark, sf, {"article_primary": 1, "name": 2}, ["a", "b"], 6)
    stats = runs.headed_run(spark, "f.xlsx", "S", "category:rims", f"{out}/o.ndjson", f"{out}/o.json", "acme", RUN["effective_at"], grid=grid)
    n = files.read_lines(spark, f"{out}/o.ndjson").count()
    return spark.createDataFrame([(stats["status"], stats["reason"].split(":")[0], stats["rows_emitted"], n)], "status string, reason string, rows_emitted long, lines long")


def q_sheet_run(spark: SparkSession, sf: str) -> DataFrame:
    """The string lines of a positional sheet."""
    columns = {"name": 1, "article_primary": 2, "brand": 3, "qty_raw": 12, "price_raw": 13}
    out = scratch(spark, "sheet")
    runs.sheet_run(spark, "f.xlsx", "S", "tyres", "r1", f"{out}/o.ndjson", f"{out}/o.json", "acme", "acme_tyres_v1", "centre", _flat_grid(spark, sf, columns, ["h"], 1))
    lines = files.read_ndjson(spark, f"{out}/o.ndjson", schemas.SHEET_LINE)
    return lines.select(F.col("_meta.source_row_1based").alias("row_no"), "raw.sku_candidate_key", F.col("raw.price").cast("decimal(18,6)").alias("price"), "raw.qty", "raw.supplier_warehouse_name", F.array_join("quality_flags", ",").alias("flags"), "_meta.passthrough.sheet")


def q_extraction_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The extractor's canonical file: lines in the order of file, table, row and column, joined over two suppliers."""
    out = scratch(spark, "extraction")
    rows = base._read(spark, sf, "supplier").select(F.concat(F.lit("f"), (F.col("s_suppkey") % 3).cast("string")).alias("source_file"), F.lit("t").alias("source_table"), F.col("s_suppkey").cast("int").alias("row_index"), F.lit(1).alias("qty_column_index"), F.col("s_name").alias("article"), F.lit("w").alias("warehouse"), F.array("s_name").alias("raw"))
    for name, half in (("a", rows.filter("row_index % 2 = 0")), ("b", rows.filter("row_index % 2 = 1"))):
        runs.extraction_run(half.withColumn("supplier", F.lit(name)), half.limit(0), {"errors": []}, out, name)
    runs.combine_extractions(spark, out)
    lines = files.read_lines(spark, f"{out}/all/canonical.ndjson")
    return lines.select("line_no", F.from_json("value", "supplier string, source_file string, row_index int").alias("r")).select("line_no", "r.*")


# ---- dispatch, rows, reports


def q_header_rows(spark: SparkSession, sf: str) -> DataFrame:
    heads = base._heads(spark, sf)
    grid = heads.select(F.col("file").alias("source_file"), F.lit("s").alias("sheet"), F.posexplode(F.array("row1", "row2")).alias("p", "cells")).select("source_file", "sheet", (F.col("p") + 1).alias("row_no"), "cells")
    return dispatch.header_rows(grid, second_words=["the", "de"]).select(F.col("source_file").alias("file"), "header_rows", "header_row", "data_row")


SIGNATURES = [("r1", "A", None, ["the"]), ("r2", "B", 1, ["de", "e"]), ("r3", "C", None, []), ("r4", "D", 2, ["an"])]


def q_match_signatures(spark: SparkSession, sf: str) -> DataFrame:
    found = base._heads(spark, sf).select("file", (F.col("cols") % 2 + 1).alias("header_rows"), signature_tokens(F.col("row1")).alias("tokens"))
    rules = spark.createDataFrame(SIGNATURES, "rule string, layout string, header_rows int, need array<string>")
    return dispatch.match_signatures(found, rules).select("file", F.array_join("layouts", ",").alias("layouts"), "status")


def q_row_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Schema errors of JSON rows with every kind of defect."""
    k = F.col("o_orderkey")
    index = F.when(k % 11 == 0, '"1"').when(k % 11 == 1, "0").when(k % 11 == 2, "1.5").otherwise("3")
    raw = F.when(k % 7 == 0, "[1]").when(k % 7 == 1, '"x"').otherwise('["a"]')
    more = F.when(k % 5 == 0, ',"qty":null,"price":2.5').when(k % 5 == 1, ',"zz":1').when(k % 5 == 2, ',"qty":"4"').otherwise("")
    value = F.when(k % 29 == 0, "[]").otherwise(F.concat(F.lit('{"supplier":"s","source_file":"f"'), F.when(k % 13 == 0, "").otherwise(',"source_table":"t"'), F.lit(',"row_index":'), index, F.lit(',"qty_column_index":2,"raw":'), raw, more, F.lit("}")))
    return contract.parsed_lines(base._read(spark, sf, "orders").select(k, value.alias("value"))).select("o_orderkey", contract.row_error().alias("error"))


def q_checked_status(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a CHECK lets pass (one that fails would fail the job)."""
    rows = base._read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return contract.require(rows, F.col("o_orderstatus").isin("F", "O", "P"), "unknown status")


def q_cap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return emit.cap_rows(base.price_list(spark, sf), 100).select("row_no", "name")


def q_confidence(spark: SparkSession, sf: str) -> DataFrame:
    mapped = base._read(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") > 30, "HIGH").when(F.col("p_size") > 5, "LOW").alias("confidence")).filter("confidence is not null")
    return reports.confidence_summary(mapped)


def q_error_row(spark: SparkSession, sf: str) -> DataFrame:
    """A result with an error row, as a check over it fails, beside one without."""
    n = base._read(spark, sf, "nation").select("n_nationkey", "n_name")
    return reports.with_error_row(n, F.count("*") > 3, "too many").unionByName(reports.with_error_row(n.filter("n_nationkey < 2"), F.count("*") > 3, "too many"))


def q_context_join(spark: SparkSession, sf: str) -> DataFrame:
    context = base._read(spark, sf, "customer").filter("c_custkey % 50 = 1").select(F.col("c_custkey").alias("o_custkey"))
    return reports.with_context(base._read(spark, sf, "orders").select("o_custkey", "o_orderkey"), context.unionByName(context), ["o_custkey"])


def q_reviewed_flags(spark: SparkSession, sf: str) -> DataFrame:
    items = base.items(spark, sf).select("id", "supplier_id", "quality_flags")
    doubted = items.filter(F.col("id").endswith("3")).select(F.col("id").alias("item_id"))
    states = spark.createDataFrame([("s0", "normal"), ("s1", "blocked")], "supplier_id string, state string")
    return reports.reviewed_flags(items, doubted.unionByName(doubted), states).select("id", F.array_join("quality_flags", ",").alias("flags"))


def q_reprocessed(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a supplier in a new snapshot, and that its content is the same."""
    items = base.items(spark, sf).withColumn("snapshot_id", F.lit("s1"))
    own = items.filter("supplier_id = 's1'")
    again = reports.reprocessed(items, "s2", "s1")
    same = reports.content_checksum(own).select("items", "digest").join(reports.content_checksum(again).select("items", F.col("digest").alias("other")), "items").select((F.col("digest") == F.col("other")).alias("same"), "items")
    return again.select("id", "snapshot_id").crossJoin(F.broadcast(same))  # one row


# ---- life cycle


def _store(spark: SparkSession, sf: str) -> offers.Store:
    """A sealed snapshot of PL's items with aliases (upserted twice) and keys, and one generated artifact."""
    store = offers.Store(spark, scratch(spark, "offers"))
    keys = base.keys(spark, sf)
    store.append("warehouse_keys", keys.select("warehouse_key", F.col("warehouse_key").alias("display_name"), F.lit(True).alias("is_active")))
    known = base.aliases(spark, sf).withColumn("last_seen_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    store.upsert("aliases", known.withColumn("warehouse_key", F.lit("old")), ["supplier_id", "supplier_warehouse_name"])
    store.upsert("aliases", known, ["supplier_id", "supplier_warehouse_name"])
    store.open_snapshot("snap", "p")
    store.append("items", base.items(spark, sf).select("id", F.lit("snap").alias("snapshot_id"), "supplier_id", "raw", "quality_flags"))
    store.seal("snap")
    store.generate("snap", "v1", base.ARTIFACT)
    return store


def q_store_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Generated, generated again (replaced, not doubled), published: the offers."""
    store = _store(spark, sf)
    store.generate("snap", "v1", base.ARTIFACT)
    store.publish(base.ARTIFACT)
    store.assert_integrity(base.ARTIFACT)
    return base._shown(store.read_offers(base.ARTIFACT))


def q_store_sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Look-up of a key by the SQL table function in the artifact that the SQL scalar function names."""
    store = _store(spark, sf)
    store.generate("snap", "v2", "art-2", resolution="fallback")
    store.switch_pointer("art-2")
    store.switch_pointer(base.ARTIFACT)
    store.register_sql()
    return spark.sql(f"select offer_id, warehouse_key, price, qty, current_artifact('production', 'default') as artifact from offers_by_sku('{store.current_artifact()}', 'P7')")


def q_store_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The upserted aliases, less those deleted."""
    store = _store(spark, sf)
    store.delete("aliases", F.col("supplier_id") == "s1")
    return store.read("aliases").select("supplier_id", "supplier_warehouse_name", "warehouse_key")


def q_store_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Tables after a transaction that failed behind a generation and a deletion: as before."""
    store = _store(spark, sf)
    try:
        with store.transaction():
            store.generate("snap", "v2", "art-2", resolution="fallback")
            store.delete("aliases", F.lit(True))
            store.publish("no such artifact")
    except offers.LifecycleError:
        pass
    return store.read("offers").groupBy("artifact_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(store.read("aliases").agg(F.count("*").alias("aliases"))))  # one row


def q_publish_curated(spark: SparkSession, sf: str) -> DataFrame:
    """The older publication twice: one artifact without a status."""
    store = offers.Store(spark, scratch(spark, "offers"))
    same = store.publish_curated("snap") == store.publish_curated("snap") != store.publish_curated("snap", "v2")
    return store.read("artifacts").select("snapshot_id", "curated_version", "fingerprint", "status", F.lit(same).alias("same"))


def q_store_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Old snapshots get their defaults, expired ones go."""
    store = offers.Store(spark, scratch(spark, "offers"))
    n = base._read(spark, sf, "nation")
    age = F.current_timestamp() - F.make_dt_interval(F.col("n_nationkey"))
    store.append("snapshots", n.select(F.col("n_name").alias("snapshot_id"), F.when(F.col("n_nationkey") % 2 == 0, "p").alias("parser_id"), F.when(F.col("n_nationkey") % 3 == 0, "open").alias("status"), age.alias("created_at"), F.lit(None).cast("timestamp").alias("sealed_at")))
    store.backfill()
    store.expire(10)
    return store.read("snapshots").select("snapshot_id", "parser_id", "status")


# ---- streams


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    shape = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(shape).parquet(f"{sf}/events.parquet*")


def _sunk(stream: DataFrame, spark: SparkSession) -> DataFrame:
    out = scratch(spark, "stream")
    _await(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(out)


def q_stream_accept_once(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a stream, each accepted once."""
    found = _event_stream(spark, sf).select(F.col("user_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("accepted_at"))
    return _sunk(inbox.first_of_each_run(found, "4000 days"), spark).select("run_id")


def q_stream_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a stream appended to the facts by month; repeats survive."""
    lines = _event_stream(spark, sf).select(F.lit("acme").alias("supplier_id"), F.col("event_type").alias("parser_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")).alias("effective_at"))
    out = scratch(spark, "facts")
    _await(inbox.append_facts(lines.unionByName(lines), out, scratch(spark, "cp")))
    return spark.read.parquet(out).groupBy("supplier_id", "parser_id", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"))


def q_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per hour and type, all of them final at the end."""
    counts = inbox.counts_per_window(_event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 hour", "1 hour")
    name = f"windows_{abs(hash(sf)) % 10**9}"
    _await(counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start())
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# ---- oracles

_TYPED = f"with {base.TYPED_SQL}"
_FILLED = "len(list_filter({0}, lambda x: " + base._norm_sql("x").replace("{", "{{").replace("}", "}}") + " <> ''))"
_NUMBERS = "len(list_filter({0}, lambda x: regexp_matches(" + base._norm_sql("x").replace("{", "{{").replace("}", "}}") + ", '^-?[0-9]+(?:[,.][0-9]+)?$')))"
_HEAD_SQL = f"""{base.HEADS_SQL}, lists as (select file, cells[1:8] as c1, cells[9:16] as c2 from heads0),
scored as (select file, c1, c2, {_FILLED.format("c1")} as f1, {_FILLED.format("c2")} as f2, {_NUMBERS.format("c1")} as n1, {_NUMBERS.format("c2")} as n2 from lists),
best as (select *, case when f2 > 0 and (f1 = 0 or f2 * 10 - n2 * 4 >= f1 * 10 - n1 * 4) then 2 else 1 end as b from scored),
judged as (select file, case when b = 1 then f1 else f2 end < 5 as thin, b, b = 1 and f2 >= 2 and (contains(lower(array_to_string(c2, ' ')), 'the') or contains(lower(array_to_string(c2, ' ')), 'de')) as second from best)"""


def oracle_sql() -> dict[str, str]:
    order = "row_number() over (order by k, pos)"
    return {
        "q_ndjson_lines": f"{FILE_SQL} select physical as line_no, {base.STRICT_SQL} as strict, {base.PERMISSIVE_SQL} as permissive from placed",
        "q_ndjson_rows": "select event_id % 31 = 0 as corrupt, count(*) as n, sum(case when event_id % 31 <> 0 then (props->>'k')::int end)::bigint as k from events group by 1",
        "q_json_category_scan": f"{DUMP_SQL} select pos::int as pos, fate from dump",
        "q_category_run": f"{DUMP_SQL} select 'acme__tyres__json_v1' as parser_id, 'category:tyres' as layout, '{RUN['effective_at']}' as ts_ingested, trim(id) as supplier_item_id, name, q::bigint as qty, p as price_opt, 'u' as image, 'tyres' as category_key from dump where fate = 'emit'",
        "q_dump_plans": "select 'acme' as supplier, 'category:' || c as layout, 'acme__stock__category_' || c as tag, 'category' as emitter from (select unnest(['rims', 'tyres']) as c)",
        "q_inbox_scan": f"{INBOX_SQL} select supplier, name, strlen(n_name)::bigint as length from f",
        "q_inbox_plans": f"""{INBOX_SQL} select name, case when supplier in ('AFRICA', 'ASIA') then case k % 3 when 0 then 'wheels' when 1 then 'truck' else 'tyres' end end as layout,
            case when supplier in ('AFRICA', 'ASIA') then case when k % 3 = 1 then 't.yaml' else 'b.yaml' end end as mapping, case when supplier in ('AFRICA', 'ASIA') then null when supplier = 'EUROPE' then 'no plan' else 'no adapter' end as reason from f""",
        "q_batch_report": f"{INBOX_SQL} select name, case when k % 3 = 2 then 3 else 0 end as rc from f",
        "q_file_digests": f"{INBOX_SQL} select name, sha256(n_name) as digest from f",
        "q_grid_csv": "select (row_number() over (order by p_partkey) + 1)::int as row_no, p_partkey || '|a, ' || p_name || '|' || case when p_size % 3 = 0 then '' else p_brand end as cells from part",
        "q_csv_rows": "select p_partkey::varchar as p_partkey, 'a, ' || p_name as p_name, case when p_size % 3 <> 0 then p_brand end as p_brand from part",
        "q_xml_rows": "select n_nationkey, n_name || ' & <co>' as n_name from nation",
        "q_columns_of": "select column_name as name, true as found from (describe part) union all select '-', false",
        "q_canonical_json": """select '{"flags":["é","\\""],"key":' || case when n_nationkey % 2 = 0 then n_nationkey::varchar else 'null' end || ',"raw":{"a":' || n_regionkey || ',"z":"' || n_name || '"}}' as value from nation""",
        "q_typed_contract": f"""{_TYPED} select '{{"_meta":{{"source_row_number":' || k || '}},"effective_at":"{RUN["effective_at"]}","emitter_version":"1.0.0","mapping_hash":"h","mapping_version":"1","ndjson_contract_version":"1.0.0","parsed":{{"price":' || coalesce(price::varchar, 'null') || ',"qty":' || qty
            || '}},"parser_id":"acme_v1","quality_flags":' || to_json(flags) || ',"raw":{{"brand_raw":"' || brand || '","name_raw":"' || name || '","price_raw":"' || price_raw || '","qty_raw":"' || qty_raw || '","supplier_article":"' || coalesce(nullif(a1, ''), a2) || '","supplier_warehouse_name":"' || wh
            || '"}},"run_id":"r1","sku_candidate_key":"' || sku || '","supplier_id":"acme"}}' as value from typed where fate = 'good'""",
        "q_run_good": f"{_TYPED} select {order} as line_no, (k + 3)::int as row_no, wh as warehouse, sku, price, qty, array_to_string(flags, ',') as flags from typed where fate = 'good'",
        "q_run_bad": f"{_TYPED} select {order} as line_no, (k + 3)::int as row_no, wh as warehouse, nullif(sku, '') as sku, substr(fate, 5) as reason_code from typed where fate like 'bad:%'",
        "q_run_stats": f"{_TYPED}, {base.STATS_SQL} select source_rows_read, exploded_lines, good_rows, bad_rows, '{RUN['effective_at']}' as effective_at, 'WARN' as verdict, 'baseline_missing,has_bad_rows' || case when (select count(*) from typed where fate = 'good' and price < 0) > 0 then ',has_negative_price' else '' end as codes from stats",
        "q_full_run": f"{_TYPED} select {order} as line_no, (k + 3)::int as row_no, sku, price, qty from typed where fate = 'good'",
        "q_accepted_run": f"{_TYPED} select '/facts/acme/acme_v1/2026-02/r1.ndjson' as segment, count(*) as lines, true as same_bytes, 'accepted' as marker, 'ingested' as first, 'already_ingested' as second from typed where fate = 'good'",
        "q_curate_stats": f"{_TYPED} select count(*) + 2 as input_lines, 1::bigint as bad_json, 1::bigint as bad_contract, count(*) filter (qty > 0) as kept_lines, count(*) filter (coalesce(qty, 0) <= 0) as dropped_lines, count(*) filter (qty is null) as qty_missing, count(*) filter (qty <= 0) as qty_nonpositive, '{RUN['effective_at']}' as effective_at from typed where fate in ('good', 'skip')",
        "q_curate_samples": f"{_TYPED}, l as (select *, {order} + 2 as seg_line_no from typed where fate in ('good', 'skip')) select row_number() over (order by seg_line_no) as line_no, seg_line_no, case when qty is null then 'qty_missing' else 'qty_nonpositive' end as drop_reason, sku as sku_candidate_key from l where coalesce(qty, 0) <= 0 order by seg_line_no limit 40",
        "q_latest_file": "select n_name || '.json' as name from nation where n_nationkey % 2 = 1 order by n_nationkey * 7 % 13 desc, n_name limit 1",
        "q_utc_times": "with t as (select n_nationkey, timestamp '2026-01-01' + to_months(n_nationkey % 12) + to_hours(n_nationkey % 10 - n_nationkey % 6) + interval 30 minutes as at_ from nation) select n_nationkey, strftime(at_, '%Y-%m-%dT%H:%M:%SZ') as at, strftime(at_, '%Y-%m') as month from t",
        "q_column_rules": "select p as position, f as field from (values (8, 'seventh'), (25, 'last'), (5, 'digits'), (3, 'third')) v(p, f)",
        "q_store_rollback": f"{base._MAPPED} select '{base.ARTIFACT}' as artifact_id, count(*) as n, (select count(*) from aliases) as aliases from named join aliases using (supplier_id) where lookup = name",
        "q_string_run": f"with {base.STRINGS_SQL} select (row_no + 3)::int as row_no, warehouse, sku, price, qty, 'RUB' as currency, array_to_string(flags, ',') as flags from strings where fate = 'emit'",
        "q_headed_run": f"with {base.HEADED_SQL} select 'acme__rims__xlsx_v1' as parser_id, h.goods_id as supplier_item_id, name, nullif(a2, '') as article, h.qty, h.price as price_opt, 'S' as sheet, wh as warehouse from headed h join pl on pl.k = h.row_no and pl.pos = h.wh_pos where fate = 'emit' and h.row_no * 4 + h.wh_pos <= 3000",
        "q_headed_skip": "select 'SKIP' as status, 'missing columns' as reason, 0::bigint as rows_emitted, 0::bigint as lines",
        "q_sheet_run": f"with {base.SHEET_SQL} select (row_no * 4 + wh_pos + 1)::int as row_no, sku as sku_candidate_key, price, qty, 'centre' as supplier_warehouse_name, array_to_string(flags, ',') as flags, 'S' as sheet from sheet where sku <> '' and price is not null and stock_fate = 'emit'",
        "q_extraction_sorted": "select row_number() over (order by s_suppkey % 2, s_suppkey % 3, s_suppkey) as line_no, case when s_suppkey % 2 = 0 then 'a' else 'b' end as supplier, 'f' || s_suppkey % 3 as source_file, s_suppkey::int as row_index from supplier",
        "q_header_rows": f"with {_HEAD_SQL} select file, case when thin then 2 when second then 2 else 1 end as header_rows, (case when thin then 1 else b end)::int as header_row, ((case when thin then 1 else b end) + case when thin or second then 2 else 1 end)::int as data_row from judged",
        "q_match_signatures": f"""with {base.HEADS_SQL}, s as (select file, cols % 2 + 1 as n, list_filter(row1, lambda x: x <> '') as t from heads),
            f as (select file, list_filter([case when len(list_filter(t, lambda x: contains(x, 'the'))) > 0 then 'A' end, case when n = 1 and len(list_filter(t, lambda x: contains(x, 'de'))) > 0 and len(list_filter(t, lambda x: contains(x, 'e'))) > 0 then 'B' end, case when n = 2 and len(list_filter(t, lambda x: contains(x, 'an'))) > 0 then 'D' end], lambda x: x is not null) as l from s)
            select file, array_to_string(l, ',') as layouts, case when len(l) = 1 then 'OK' else 'PROBLEM' end as status from f""",
        "q_row_schema": """select o_orderkey, case when o_orderkey % 29 = 0 then 'bad_json' when o_orderkey % 13 = 0 then 'missing:source_table' when o_orderkey % 5 = 1 then 'extra_key' when o_orderkey % 11 in (0, 2) then 'type:row_index' when o_orderkey % 7 = 1 then 'type:raw'
            when o_orderkey % 5 = 2 then 'type:qty' when o_orderkey % 11 = 1 then 'minimum:row_index' when o_orderkey % 7 = 0 then 'type:raw[]' end as error from orders""",
        "q_checked_status": "select o_orderkey, o_orderstatus from orders",
        "q_cap_rows": "select p_partkey as row_no, p_name as name from part where p_partkey <= 100",
        "q_confidence": "select c as confidence, (select count(*) from part where case when p_size > 30 then 'HIGH' when p_size > 5 then 'LOW' end = c) as n from (select unnest(['HIGH', 'MEDIUM', 'LOW']) as c)",
        "q_error_row": "select n_nationkey, n_name, null::varchar as error from nation union all select null, null, 'too many' union all select n_nationkey, n_name, null from nation where n_nationkey < 2",
        "q_context_join": "select o_custkey, o_orderkey from orders where o_custkey in (select c_custkey from customer where c_custkey % 50 = 1)",
        "q_reviewed_flags": f"with {base.ITEMS_SQL} select id, array_to_string(list_concat(coalesce(flags, []), list_filter([case when id like '%3' then 'needs_review' end, case when supplier_id = 's1' and not list_contains(coalesce(flags, []), '{offers.BLOCKED}') then '{offers.BLOCKED}' end], lambda x: x is not null)), ',') as flags from items",
        "q_reprocessed": f"with {base.ITEMS_SQL} select sha256('s2|' || id) as id, 's2' as snapshot_id, true as same, count(*) over () as items from items where supplier_id = 's1'",
        "q_store_offers": f"{base._MAPPED} {base.OFFER_SQL} from named join aliases using (supplier_id) where lookup = name",
        "q_store_sql_functions": f"{base._MAPPED} select offer_id, warehouse_key, price, qty, '{base.ARTIFACT}' as artifact from ({base.OFFER_SQL} from named join aliases using (supplier_id) where lookup = name) where sku_candidate_key = 'P7' and not contains(flags, '{offers.BLOCKED}')",
        "q_store_aliases": f"with {base.ITEMS_SQL} select supplier_id, name as supplier_warehouse_name, warehouse_key from aliases where supplier_id <> 's1'",
        "q_publish_curated": "select 'snap' as snapshot_id, v as curated_version, sha256('snap|' || v) as fingerprint, null::varchar as status, true as same from (select unnest(['v1', 'v2']) as v)",
        "q_store_backfill": "select n_name as snapshot_id, case when n_nationkey % 2 = 0 then 'p' else 'seed' end as parser_id, case when n_nationkey % 3 = 0 then 'open' else 'sealed' end as status from nation where n_nationkey < 10",
        "q_stream_accept_once": "select distinct user_id::varchar as run_id from events",
        "q_stream_facts": "select 'acme' as supplier_id, event_type as parser_id, strftime(date_trunc('second', ts) - interval 3 hour, '%Y-%m') as month, 2 * count(*) as n from events group by all",
        "q_stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all",
    }
