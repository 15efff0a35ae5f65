import json
import os

import pytest
from pyspark.sql import functions as F

from tarifold import cli, schemas
from tarifold.operators import contract, dispatch, emit, gate
from tarifold.plans import runs
from tarifold.sources import files, grid, mapping
from tarifold.streaming import inbox

MAPPING = b"""mapping_version: "1"
format_hints: {sheet: TDSheet, header_row_1based: 1, data_start_row_1based: 3}
defaults: {price_scale: 100, currency: RUB}
columns:
  article_primary: {type: column_position, column: 7}
  article_fallback: {type: column_position, column: 8}
  brand: {type: column_position, column: 9}
  name: {type: column_position, column: 10}
  price: {type: column_position, column: 12}
warehouses:
  - {column: 17, warehouse_name: Main}
  - {column: 18, warehouse_name: Second}
  - {column: 19, warehouse_name: Third}
  - {column: 20, warehouse_name: Fourth}
"""
ROWS = [
    (1, {12: "Опт", 17: "Main", 18: "Second"}), (2, {12: "Цена"}), (3, {7: " A1 ", 9: "Br", 10: "Nm", 12: "100.5", 17: "5", 18: "0", 20: ">40"}), (4, {8: "C2", 9: "Br", 10: "Nm", 17: "2.5"}), (5, {9: "Br", 10: "NoSku", 12: "10", 17: "1"}),
    (6, {7: "A4", 12: "abc", 17: "1"}), (7, {}), (8, {7: "A5", 12: "-3", 17: "нет", 18: "1"}),
]


def cells(values):
    return [values.get(i, "") for i in range(1, 22)]


@pytest.fixture
def price_grid(spark):
    return spark.createDataFrame([("f.xls", "TDSheet", n, cells(v)) for n, v in ROWS], schemas.GRID)


@pytest.fixture
def mapping_path(tmp_path):
    (tmp_path / "m.yaml").write_bytes(MAPPING)
    return str(tmp_path / "m.yaml")


def test_golden_run(spark, tmp_path, price_grid, mapping_path):
    root = str(tmp_path / "store")
    (tmp_path / "f.xls").write_bytes(b"x")
    args = (spark, str(tmp_path / "f.xls"), mapping_path, "2026-02-03T00:30:00+03:00", "r1", root, "acme", "acme_v1")
    document = runs.full_run(*args, grid=price_grid)
    stats = runs.read_json(f"{root}/runs/r1/stats.json")
    assert {k: stats[k] for k in ("source_rows_read", "exploded_lines", "good_rows", "bad_rows", "skipped_rows_all_empty", "explosion_factor_exact")} == {"source_rows_read": 6, "exploded_lines": 12, "good_rows": 4, "bad_rows": 8, "skipped_rows_all_empty": 1, "explosion_factor_exact": "2"}
    assert stats["bad_reasons_counts"] == {"empty_sku": 4, "invalid_price_format": 4}
    assert stats["flags_counts"] == {"missing_price": 1, "negative_price": 1, "qty_approximated": 1, "qty_fractional": 1}
    verdict = runs.read_json(f"{root}/runs/r1/verdict.json")
    assert (verdict["verdict"], [r["code"] for r in verdict["reasons"]]) == ("WARN", ["baseline_missing", "has_bad_rows", "has_negative_price"])
    assert os.path.exists(f"{root}/facts/acme/acme_v1/2026-02/r1.ndjson")
    lines = open(f"{root}/curated/r1/curated.ndjson", encoding="utf-8").read().splitlines()
    objects = [json.loads(x) for x in lines]
    assert [(o["parsed"]["price"], o["parsed"]["qty"], o["quality_flags"]) for o in objects] == [(10050, 5, []), (10050, 40, ["qty_approximated"]), (None, 3, ["missing_price", "qty_fractional"]), (-300, 1, ["negative_price"])]
    assert lines == [runs.dump(o) for o in objects]  # canonical bytes
    bad = [json.loads(x) for x in open(f"{root}/runs/r1/bad_rows.ndjson", encoding="utf-8").read().splitlines()]
    assert [(b["_meta"]["source_row_number"], b["raw"]["supplier_warehouse_name"]) for b in bad] == [(r, w) for r in (5, 6) for w in ("Main", "Second", "Third", "Fourth")]  # in file order
    assert document["sha256"]["mapping_lf"] == mapping.parse_mapping(MAPPING).hash and document["emitter_version"] == emit.EMITTER
    assert (document["kept_lines"], document["ingest"]) == (4, "ingested")
    before = open(f"{root}/facts/acme/acme_v1/2026-02/r1.ndjson", "rb").read()
    assert runs.full_run(*args, grid=price_grid)["ingest"] == "already_ingested"
    assert open(f"{root}/facts/acme/acme_v1/2026-02/r1.ndjson", "rb").read() == before


def test_string_contract(spark, price_grid):
    m = mapping.parse_mapping(MAPPING)
    header = price_grid.filter("row_no = 1").first()["cells"]
    lines = emit.emit_strings(emit.price_rows(price_grid, m, header))
    out = emit.string_contract(lines, "acme", "acme_v1", "r1").orderBy("_meta.source_row_1based").collect()
    assert [(r["raw"]["sku_candidate_key"], r["raw"]["price"], r["raw"]["qty"], r["quality_flags"]) for r in out] == [
        ("A1", "100.5", "5", []), ("A1", "100.5", "40", ["qty_approximated"]), ("unknown_sku_95592827d90a", "10", "1", ["missing_sku"]), ("A4", "", "1", ["bad_price"]), ("A5", "-3", "1", [])]
    assert out[1]["raw"]["supplier_warehouse_name"] == ""
    assert emit.string_stats(lines).first()["lines"] == 5


def test_ingest_refuses(spark, tmp_path, price_grid, mapping_path):
    out = str(tmp_path / "o")
    runs.emit_run(spark, "f.xls", mapping_path, "2026-02-03T00:30:00Z", "r9", out, "acme", "p", price_grid)
    runs.gate_run(spark, f"{out}/stats.json", f"{out}/verdict.json")
    good = open(f"{out}/good.ndjson", encoding="utf-8").read()
    for content in (good + "{broken\n", good.replace('"r9"', '"r8"', 1), good.split("\n", 1)[1]):
        runs.write_text(f"{out}/changed.ndjson", content)
        with pytest.raises(runs.RunError) as e:
            runs.ingest_run(spark, f"{out}/changed.ndjson", f"{out}/stats.json", f"{out}/verdict.json", str(tmp_path / "s"))
        assert e.value.code == 20
    assert not os.path.exists(f"{tmp_path}/s/accepted_runs")
    os.makedirs(f"{tmp_path}/s/locks", exist_ok=True)
    open(f"{tmp_path}/s/locks/r9.lock", "w").close()
    with pytest.raises(runs.RunError) as e:
        runs.ingest_run(spark, f"{out}/good.ndjson", f"{out}/stats.json", f"{out}/verdict.json", str(tmp_path / "s"))
    assert e.value.code == 1


def test_gate(spark):
    stats = {"run_id": "r", "supplier_id": "s", "parser_id": "p", "file_readable": True, "structure_ok": True, "good_rows": 3935, "bad_rows": 0, "exploded_lines": 3935, "explosion_factor_exact": emit.exact_ratio(3935, 2745), "source_rows_read": 2745, "flags_counts": {"missing_price": 21}}
    assert stats["explosion_factor_exact"] == "1.433515482695810564663023679"
    baseline = {"parser_id": "p", "metrics": {"explosion_factor_exact": {"expected": emit.exact_ratio(3935, 2745)}, "good_rows": {"tolerance_abs": 0, "expected": 3935}, "flags_counts.missing_price": {"expected": 21}}}
    assert gate.gate_document(spark, stats, baseline)["verdict"] == "PASS"
    assert gate.gate_document(spark, stats)["exit_code"] == 10
    assert [r["code"] for r in gate.gate_document(spark, stats | {"good_rows": 3936}, baseline)["reasons"]] == ["metric_out_of_tolerance"]
    assert [r["code"] for r in gate.gate_document(spark, stats | {"parser_id": "q"}, baseline)["reasons"]] == ["baseline_mismatch"]
    assert gate.gate_document(spark, stats, baseline | {"metrics": {"no.such": {"expected": 1}}})["reasons"] == [{"metric": "no.such", "code": "metric_missing", "level": "WARN"}]
    failed = gate.gate_document(spark, stats | {"exploded_lines": 0, "bad_rows": 4}, baseline)
    assert (failed["exit_code"], [r["code"] for r in failed["reasons"]]) == (20, ["exploded_lines_zero"])
    with pytest.raises(ValueError):
        gate.gate_document(spark, {"run_id": "r"})


def test_mapping_errors():
    assert mapping.parse_mapping(MAPPING).hash == mapping.parse_mapping(MAPPING.replace(b"\n", b"\r\n")).hash
    for change, code in ((b"mapping_version", 1), (b"brand", 3), (b"sheet", 3)):
        with pytest.raises(mapping.MappingError) as e:
            mapping.parse_mapping(MAPPING.replace(change, b"other"))
        assert e.value.code == code
    loose = mapping.parse_mapping(b"cols: {sku: 6, name: 9, price: 10}\nwarehouses: [{column: 13}]", strict=False)
    assert (loose.columns["article_primary"], loose.columns["price"], loose.columns["brand"], loose.warehouses[0].name) == (6, 10, 9, "c13")


def test_grid_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text('1,"two\nlines"\n,3\n', encoding="utf-8")
    rows = grid.read_grid(spark, str(tmp_path)).orderBy("source_file", "row_no").collect()
    assert [(r["row_no"], r["cells"]) for r in rows] == [(1, ["x;y"]), (1, ["1", "two\nlines"]), (2, ["", "3"])]
    assert grid.read_grid(spark, str(tmp_path / "sub" / "b.csv"), first_row=2).count() == 1
    assert [grid.render_cell(v) for v in (5.0, 0.1 + 0.2, " a ", None)] == ["5", "0.3", "a", ""]
    assert grid.header_index(["a", "", "b ", "a"]) == {"a": 4, "b": 3}


def test_text_sources(spark, tmp_path):
    (tmp_path / "l.ndjson").write_text('{"a": 1}\n\n{bad\r\n[1]\n', encoding="utf-8")
    lines = contract.parsed_lines(files.read_lines(spark, str(tmp_path / "l.ndjson"))).withColumn("v", contract.contract_violation(["a"]))
    assert [(r["line_no"], r["v"]) for r in lines.orderBy("line_no").collect()] == [(1, None), (3, "bad_json"), (4, "bad_json")]
    assert files.read_ndjson(spark, str(tmp_path / "l.ndjson"), "a int").filter("_corrupt_record is not null").select("a").count() >= 1
    (tmp_path / "d.json").write_text('{"tyres": [{"id": 7, "stock": "4", "price_minimum": "12,5"}, 3, {"id": ""}, {"id": "x", "stock": "?"}], "n": 1}', encoding="utf-8")
    items = emit.emit_category(files.read_json_category(spark, str(tmp_path / "d.json"), "category:tyres"))
    assert [(r["pos"], r["fate"]) for r in items.orderBy("pos").collect()] == [(0, "emit"), (1, "no_object"), (2, "no_id"), (3, "bad_qty")]
    for layout, code in (("tyres", 2), ("category:n", 4)):
        with pytest.raises(files.DumpError) as e:
            files.read_json_category(spark, str(tmp_path / "d.json"), layout)
        assert e.value.code == code
    (tmp_path / "in" / "acme").mkdir(parents=True)
    (tmp_path / "in" / "acme" / "диски.json").write_text("{}", encoding="utf-8")
    (tmp_path / "in" / "loose.json").write_text("{}", encoding="utf-8")
    assert [(r["supplier"], r["name"]) for r in files.scan_inbox(spark, str(tmp_path / "in")).collect()] == [("acme", "диски.json"), ("UNKNOWN", "loose.json")]
    assert files.latest_file(spark, str(tmp_path / "in")).endswith(".json")


def test_dispatch(spark):
    rows = [("f", "s", 1, ["", "", ""]), ("f", "s", 2, ["Артикул", "Бренд", "Наименование", "Опт", "Склад", "Заказ"]), ("f", "s", 3, ["", "", "", "цена", "остаток", ""]), ("f", "s", 4, ["1", "2", "3", "4", "5", "6"])]
    found = dispatch.header_rows(spark.createDataFrame(rows, schemas.GRID)).first()
    assert (found["header_row"], found["header_rows"], found["data_row"]) == (2, 2, 4)
    names = spark.createDataFrame([("Прайс ДИСКИ",), ("x",), ("грузовые шины",)], "n string")
    assert [r[0] for r in names.select(dispatch.layout_of_name(F.col("n"))).collect()] == ["wheels", "tyres", "truck"]
    assert dispatch.check_header(["", "Опт"], ["", "цена"], 2) == []
    assert dispatch.check_header(["", "x"], ["", "y"], 2, stock=1) == ["price label", "price group", "stock label", "stock name"]
    assert dispatch.check_header(["Центр.  Склад", "Опт", "Уфа"], ["Остаток", "Цена", "остаток"], 2, stock=[1, 3], centre=1) == []
    assert dispatch.check_header(["Уфа", "Опт"], ["шт", "Цена"], 2, centre=1) == ["centre group", "centre label"]
    sigs = spark.createDataFrame([("f1", 2, ["артикул|", "опт|цена"]), ("f2", 1, ["x"])], "file string, header_rows int, tokens array<string>")
    rules = spark.createDataFrame([("r1", "A", 2, ["опт"]), ("r2", "B", None, [])], "rule string, layout string, header_rows int, need array<string>")
    assert {r["file"]: (r["layouts"], r["status"]) for r in dispatch.match_signatures(sigs, rules).collect()} == {"f1": (["A"], "OK"), "f2": ([], "PROBLEM")}


def test_json_types_count(spark):
    """Numbers given as texts are no numbers; a text "0" is an id, the number 0 is none."""
    base = '{"_meta":{"source_row_number":%s},"parsed":{"price":%s,"qty":%s},"mapping_version":%s,"run_id":%s}'
    rows = [("4", "100", "7", "1", '"r"'), ('"4"', "100", "7", "1", '"r"'), ("4", '"100"', "7", "1", '"r"'), ("4", "100", '"7"', "1", '"r"'), ("4", "1.0", "7", "1", '"r"'), ("4", "null", "true", '"1"', '"r"'), ("4", "1", "1", "2", '"r"'), ("4", "1", "1", "1", "3"), ("4", "99999999999999999999", "1", "1", '"r"')]
    frame = contract.parsed_lines(spark.createDataFrame([(i, base % r) for i, r in enumerate(rows)], "i int, value string"))
    got = [r["v"] for r in frame.select("i", contract.contract_violation(["_meta", "parsed"], {"mapping_version": "1", "run_id": "r"}).alias("v")).orderBy("i").collect()]
    assert got == [None, "meta:source_row_number", "type:parsed.price", "type:parsed.qty", "type:parsed.price", None, "mismatch:mapping_version", "mismatch:run_id", None]
    items = spark.createDataFrame([("0", "string"), ("false", "string"), ("0", "number"), ("0.0", "number"), ("false", "boolean"), ("true", "boolean"), (" ", "string"), (None, None), ("5", "number")], "id string, id_kind string").selectExpr("*", "'3' as stock", "'1' as price_minimum", "true as is_object")
    assert [r["fate"] for r in emit.emit_category(items).collect()] == ["emit", "emit", "no_id", "no_id", "no_id", "emit", "no_id", "no_id", "emit"]


def test_line_numbers_of_split_files(spark, tmp_path):
    """Files cut in many blocks keep their physical line numbers; blank lines count, a carriage return inside is text."""
    want = {}
    for name in ("a", "b"):
        lines = [f'{{"n": {i}, "pad": "{"x" * (i % 37)}"}}' if i % 5 else "" for i in range(3000)]
        lines[7] = "odd\rline"
        (tmp_path / f"{name}.ndjson").write_text("\n".join(lines) + "\n", encoding="utf-8", newline="")
        want |= {(name, i + 1): v for i, v in enumerate(lines) if v}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        frame = files.read_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {(r["file"][-8], r["line_no"]): r["value"] for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


class Book:
    """A stand-in for a workbook library: two sheets, one with a merged cell."""

    SHEETS = {"First": [["a", 1.0, None], ["", "x", 2.5]], "TDSheet": [["h", "h2"], [7, True]]}


def test_workbook_readers(tmp_path, monkeypatch):
    import sys
    import types

    class Sheet:
        def __init__(self, rows):
            self.rows, self.nrows, self.merged_cells = rows, len(rows), [(0, 2, 0, 1)]

        def row_values(self, r):
            return self.rows[r]

        def cell_value(self, r, c):
            return self.rows[r][c]

    xlrd = types.ModuleType("xlrd")
    xlrd.open_workbook = lambda path, on_demand: types.SimpleNamespace(sheet_names=lambda: list(Book.SHEETS), sheet_by_name=lambda n: Sheet(Book.SHEETS[n]))
    openpyxl = types.ModuleType("openpyxl")

    class Work(dict):
        sheetnames = list(Book.SHEETS)

    openpyxl.load_workbook = lambda path, **_: Work({n: types.SimpleNamespace(iter_rows=lambda values_only, rows=rows: iter(map(tuple, rows))) for n, rows in Book.SHEETS.items()})
    monkeypatch.setitem(sys.modules, "xlrd", xlrd)
    monkeypatch.setitem(sys.modules, "openpyxl", openpyxl)
    for name in ("b.xls", "b.xlsx"):
        (tmp_path / name).write_bytes(b"")
    read = lambda options: {(os.path.basename(p.path), p.sheet): [(r[2], r[3]) for r in reader.read(p)] for reader in [grid.GridReader(options)] for p in reader.partitions()}
    got = read({"path": str(tmp_path)})
    assert got["b.xls", "First"] == [(1, ["a", "1", ""]), (2, ["a", "x", "2.5"])] and got["b.xlsx", "First"] == [(1, ["a", "1", ""]), (2, ["", "x", "2.5"])]
    assert got["b.xlsx", "TDSheet"] == [(1, ["h", "h2"]), (2, ["7", "True"])] and len(got) == 4
    assert list(read({"path": str(tmp_path / "b.xls"), "sheet": "TDSheet", "firstrow": "2"})) == [("b.xls", "TDSheet")]
    with pytest.raises(ValueError, match="sheet not found"):
        read({"path": str(tmp_path / "b.xls"), "sheet": "None"})
    assert list(read({"path": str(tmp_path / "b.xlsx"), "sheet": "None", "fallback": "true"})) == [("b.xlsx", "First")]


def test_adapters(spark, tmp_path):
    (tmp_path / "stock.json").write_text('{"b": [], "a/x": [1], "n": 3}', encoding="utf-8")
    (tmp_path / "list.json").write_text("[1]", encoding="utf-8")
    registry = dispatch.Registry()
    registry.add(("Acme",), dispatch.workbook_adapter("acme", {"wheels": "w.yaml", "tyres": "t.yaml"}))
    registry.add(("dump", "Дамп"), dispatch.dump_adapter("dump", lambda p: files.dump_categories(spark, p)))
    plans, _ = registry.plan("ACME", "/in/acme/Прайс ДИСКИ.xls")
    assert [(p.layout, p.mapping, p.tag, p.emitter) for p in plans] == [("wheels", "w.yaml", "acme__Прайс_ДИСКИ__wheels", "strings")]
    plans, _ = registry.plan("ДАМП", str(tmp_path / "stock.json"))
    assert [(p.layout, p.tag) for p in plans] == [("category:a/x", "dump__stock__category_a_x"), ("category:b", "dump__stock__category_b")]
    assert registry.plan("dump", str(tmp_path / "list.json")) == ([], "no plan") == registry.plan("dump", "x.xlsx")
    assert registry.plan("acme2", "x.xls") == ([], "no adapter")


def test_batch_goes_on_after_failures(spark, tmp_path):
    (tmp_path / "in" / "acme").mkdir(parents=True)
    (tmp_path / "in" / "other").mkdir()
    for name in ("acme/a.csv", "acme/b.csv", "other/c.csv"):
        (tmp_path / "in" / name).write_text("x", encoding="utf-8")
    registry = dispatch.Registry()
    registry.add(("acme",), lambda path: dispatch.Plan(path, "acme", "l", path[-5:]))

    def execute(plan):
        if plan.path.endswith("a.csv"):
            raise runs.RunError("no", 3)
        return {"ok": 1}

    report = runs.batch_run(spark, str(tmp_path / "in"), registry, execute, "b1", str(tmp_path / "report.json"))
    assert [i["rc"] for i in report["items"]] == [3, 0]
    assert [u["reason"] for u in report["unsupported"]] == ["no adapter"]
    assert runs.skipped(spark, "no header row")[1]["status"] == "SKIP"


def test_cli_codes(spark, tmp_path, mapping_path):
    assert cli.main(["emit", "--input", str(tmp_path / "none.csv"), "--mapping", mapping_path, "--effective-at", "2026-01-01T00:00:00Z", "--run-id", "r", "--out-dir", str(tmp_path / "o"), "--supplier", "s", "--parser", "p"], spark) == 2
    assert cli.main(["gate", "--stats", str(tmp_path / "o" / "stats.json")], spark) == 20
    assert cli.main(["curate", "--manifest", str(tmp_path / "none.json"), "--out-dir", str(tmp_path)], spark) == 1


def test_cli_of_the_other_emitters(spark, tmp_path, mapping_path):
    (tmp_path / "p.csv").write_text("\n".join(",".join(cells(v)) for _, v in ROWS) + "\n", encoding="utf-8")
    (tmp_path / "d.json").write_text('{"rims": [{"id": 7, "stock": 3, "price_minimum": 5, "img_url": "u"}], "n": 1}', encoding="utf-8")
    at = lambda n: str(tmp_path / n)
    outs = lambda n: ["--out", at(f"{n}.ndjson"), "--stats-out", at(f"{n}.json")]
    assert cli.main(["emit-strings", "--input", at("p.csv"), "--mapping", mapping_path, "--layout", "tyres", "--run-id", "r", *outs("s"), "--supplier", "acme", "--parser", "p"], spark) == 0
    assert len(open(at("s.ndjson"), encoding="utf-8").read().splitlines()) == runs.read_json(at("s.json"))["lines"] == 5
    assert cli.main(["emit-strings", "--input", at("none.csv"), "--mapping", mapping_path, "--layout", "tyres", "--run-id", "r", *outs("x"), "--supplier", "acme", "--parser", "p"], spark) == 2
    assert cli.main(["emit-category", "--input", at("d.json"), "--layout", "category:rims", *outs("c"), "--supplier", "acme"], spark) == 0
    item = json.loads(open(at("c.ndjson"), encoding="utf-8").read())
    assert item["item"] == {"article": None, "brand": None, "image": "u", "model": None, "name": None, "price_opt": 5.0, "price_roznica": None, "qty": 3, "supplier_item_id": "7"} and item["raw"] == {"category_key": "rims"}
    assert [cli.main(["emit-category", "--input", at("d.json"), "--layout", layout, *outs("c"), "--supplier", "acme"], spark) for layout in ("rims", "category:n")] == [2, 4]
    head = [[""] * 6] * 5 + [list(emit.HEADED.values()), ["12", "n", "a", "1200.5", "w", "> 4"]]
    (tmp_path / "h.csv").write_text("\n".join(",".join(r) for r in head) + "\n", encoding="utf-8")
    headed = lambda layout: cli.main(["emit-headed", "--input", at("h.csv"), "--sheet", "", "--layout", layout, *outs("h"), "--supplier", "acme"], spark)
    assert headed("rims") == 2 and headed("category:rims") == 0
    assert json.loads(open(at("h.ndjson"), encoding="utf-8").read())["item"] == {"article": "a", "currency": "RUB", "name": "n", "price_opt": 1200.5, "qty": 4, "supplier_item_id": "12"}
    assert cli.main(["emit-headed", "--input", at("none.csv"), "--sheet", "x", "--layout", "category:rims", *outs("h"), "--supplier", "acme"], spark) == 3
    (tmp_path / "w.csv").write_text("h\n" + ",".join(["n", " k ", "b", *[""] * 10, "5", "100"]) + "\n", encoding="utf-8")
    sheet = lambda name: cli.main(["emit-sheet", "--input", at(name), "--sheet", "", "--layout", "wheels", "--run-id", "r", *outs("w"), "--supplier", "acme", "--parser", "p", "--warehouse", "centre"], spark)
    assert sheet("w.csv") == 0 and sheet("none.csv") == 1
    line = json.loads(open(at("w.ndjson"), encoding="utf-8").read())
    assert line["raw"] == {"brand_raw": "b", "currency": "RUB", "name_raw": "n", "price": "100", "qty": "5", "sku_candidate_key": "k", "supplier_warehouse_name": "centre"} and line["_meta"]["source_row_1based"] == 2
    (tmp_path / "rules.yaml").write_text("- {rule: r1, layout: tyres, row1: [опт]}\n- {rule: r2, layout: wheels, cols: 99}\n", encoding="utf-8")
    assert cli.main(["dispatch", "--input", at("p.csv"), "--rules", at("rules.yaml")], spark) == 0
    assert cli.main(["dispatch", "--input", at("w.csv"), "--rules", at("rules.yaml")], spark) == 2
    (tmp_path / "in" / "acme").mkdir(parents=True)
    (tmp_path / "in" / "acme" / "p.csv").write_bytes((tmp_path / "p.csv").read_bytes())
    (tmp_path / "suppliers.yaml").write_text(f"- {{names: [Acme], kind: workbook, mappings: {{tyres: {mapping_path}}}}}\n", encoding="utf-8")
    assert cli.main(["batch", "--root", at("in"), "--out", at("report.json"), "--run-id", "b", "--suppliers", at("suppliers.yaml"), "--effective-at", "2026-01-01T00:00:00Z", "--work", at("work")], spark) == 0
    report = runs.read_json(at("report.json"))
    assert [(i["rc"], i["stats"]["lines"]) for i in report["items"]] == [(0, 5)] and os.path.exists(at("work/acme__p__tyres.b.ndjson"))


def test_extraction_artifacts(spark, tmp_path):
    rows = [("s", "b", "t", 1, 2, ["x"], "A2"), ("s", "a", "t", 2, 1, ["y"], "A1"), ("s", "a", "t", 1, 2, ["z"], "A1"), ("s", "a", "t", 1, 1, ["w"], "A3")]
    frame = spark.createDataFrame(rows, "supplier string, source_file string, source_table string, row_index int, qty_column_index int, raw array<string>, article string").withColumn("warehouse", F.lit("w"))
    runs.extraction_run(frame, frame.limit(1).withColumn("error", F.lit("e")), {"errors": []}, str(tmp_path / "o"), "s")
    runs.combine_extractions(spark, str(tmp_path / "o"))
    runs.combine_extractions(spark, str(tmp_path / "o"))  # the joint file is no input of itself
    lines = [json.loads(x) for x in open(tmp_path / "o" / "all" / "canonical.ndjson", encoding="utf-8").read().splitlines()]
    assert [r["raw"] for r in lines] == [["w"], ["z"], ["y"], ["x"]]
    assert runs.read_json(str(tmp_path / "o/s/report.json")) == {"errors": []} and spark.read.parquet(str(tmp_path / "o/canonical_items")).count() == 4


def test_rows_and_rules(spark):
    rows = contract.parsed_lines(spark.createDataFrame([('{"supplier":"s","source_file":"f","source_table":"t","row_index":1,"qty_column_index":2,"raw":[]}',), ('{"supplier":"s"}',), ('{"supplier":"s","source_file":"f","source_table":"t","row_index":0,"qty_column_index":2,"raw":[]}',), ('{"supplier":"s","source_file":"f","source_table":"t","row_index":1,"qty_column_index":2,"raw":[],"z":1}',)], "value string"))
    assert [r[0] for r in rows.select(contract.row_error()).collect()] == [None, "missing:source_file", "minimum:row_index", "extra_key"]
    frame = spark.createDataFrame([("open",), ("odd",)], "status string")
    with pytest.raises(Exception, match="bad status"):
        contract.require(frame, F.col("status").isin("open", "sealed"), "bad status").collect()
    assert contract.require(frame, F.col("status").isNotNull(), "x").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a", encoding="utf-8")
    seen = []
    handle = lambda batch, number: seen.extend(r["path"][-5:] for r in batch.collect())
    inbox.run_inbox(spark, str(tmp_path / "in"), str(tmp_path / "cp"), handle).awaitTermination(60)
    (tmp_path / "in" / "b.txt").write_text("b", encoding="utf-8")
    inbox.run_inbox(spark, str(tmp_path / "in"), str(tmp_path / "cp"), handle).awaitTermination(60)
    assert seen == ["a.txt", "b.txt"]


def test_stream_accepts_a_run_once(spark, tmp_path):
    source, out = str(tmp_path / "s"), str(tmp_path / "o")
    frame = spark.createDataFrame([("r1", "2026-01-01 00:00:00"), ("r1", "2026-01-01 00:00:01"), ("r2", "2026-01-01 00:00:02")], "run_id string, t string").select("run_id", F.to_timestamp("t").alias("accepted_at"))
    frame.write.parquet(source)
    stream = inbox.first_of_each_run(spark.readStream.schema(frame.schema).parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["run_id"] for r in spark.read.parquet(out).collect()) == ["r1", "r2"]


def test_headed_and_positional_rows(spark):
    head = ["x", *emit.HEADED.values()]
    rows = [("f", "s", 6, head), ("f", "s", 7, ["", "12", "n", "a", "1 200,5", "w", "> 4"]), ("f", "s", 8, ["", "", "n", "a", "1", "w", "4"]), ("f", "s", 9, ["", "13", "n", "a", "0", "w", "4"])]
    found, reason = emit.headed_rows(spark.createDataFrame(rows, schemas.GRID))
    assert reason is None and [(r["fate"], r["qty"], r["price"]) for r in emit.emit_headed(found).orderBy("row_no").collect()] == [("emit", 4, 1200.5), ("no_id", 4, 1.0), ("bad_price", 4, 0.0)]
    assert emit.headed_rows(spark.createDataFrame(rows[1:], schemas.GRID)) == (None, "no header row")
    assert emit.headed_rows(spark.createDataFrame([("f", "s", 6, head[:3])], schemas.GRID))[1].startswith("missing columns")
    sheet = [("f", "s", 1, ["h"]), ("f", "s", 2, ["n", " k ", "b", *[""] * 8, "5", "100,0"]), ("f", "s", 3, ["n", "k", "b", *[""] * 8, "5", "0"])]
    lines = emit.emit_sheet(emit.sheet_rows(spark.createDataFrame(sheet, schemas.GRID), emit.TYRES), zero_price_apart=True).orderBy("row_no").collect()
    assert [(r["sku"], r["price"], r["qty"], r["fate"]) for r in lines] == [("k", "100", "5", "emit"), ("k", "", "5", "price_zero")]


def test_extra_columns_are_carried(spark, price_grid):
    rows = emit.price_rows(price_grid, mapping.parse_mapping(MAPPING), extra={"retail_raw": 13})
    assert "retail_raw" in emit.explode_stocked(rows, "Main").columns


def test_column_rules():
    r = dispatch.ColumnRule
    rules = [r("price", "header_contains", "цена", 1), r("price", "header_exact", "цена опт"), r("qty", "value_pattern", "[0-9]+"), r("name", "column_position", 1)]
    got = dispatch.map_columns(["Имя", "Цена  розн", "цена опт", "x"], [["a", "1.5", "2.5", "7"], ["b", "1.5", "2.5", ""]], rules)
    assert {k: v[0] for k, v in got.items()} == {3: "price", 4: "qty", 1: "name"}


def test_windowed_counts_and_facts(spark, tmp_path):
    frame = spark.createDataFrame([("a", "2026-01-01 00:00:10"), ("a", "2026-01-01 00:00:50"), ("b", "2026-01-01 00:02:00")], "k string, t string").select("k", F.to_timestamp("t").alias("at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "e"))
    counts = inbox.counts_per_window(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "e")), "at", ["k"], "1 minute", "0 seconds")
    counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    lines = spark.createDataFrame([("s", "p", "2026-03-01T00:30:00+03:00")], "supplier_id string, parser_id string, effective_at string")
    lines.write.parquet(str(tmp_path / "l"))
    inbox.append_facts(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "l")), str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination(60)
    assert os.path.isdir(tmp_path / "f" / "supplier_id=s" / "parser_id=p" / "month=2026-02")


def test_lines_are_written_side_by_side(spark, tmp_path, monkeypatch):
    """Partitions are parts of their own, joined in row order; no rows and one part make a file too."""
    joined = []
    real = runs.storage.join
    monkeypatch.setattr(runs.storage, "join", lambda parts, target: (joined.append(len(parts)), real(parts, target)))
    lines = spark.range(0, 1000, 1, 5).select(F.col("id").cast("string").alias("value"))
    runs.write_lines(lines, str(tmp_path / "a.txt"))
    assert (tmp_path / "a.txt").read_text() == "".join(f"{n}\n" for n in range(1000))
    assert joined == [5] and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.txt"]
    runs.write_lines(lines.filter("id < 0"), str(tmp_path / "b.txt"))
    runs.write_lines(lines.coalesce(1), str(tmp_path / "a.txt"))
    assert (tmp_path / "b.txt").read_bytes() == b"" and len((tmp_path / "a.txt").read_text().split()) == 1000


def test_objects_are_told_by_their_first_character(spark):
    """Every kind of JSON text; the type name of a whole document is not worked out."""
    values = ["{}", ' \t\r\n{"a":1}', "[{}]", "1", '"{"', "null", "{", "{} {}", "\u00a0{}", "\ufeff{}", "", None]
    found = contract.parsed_lines(spark.createDataFrame([(v,) for v in values], "value string"))
    assert [r["value"] for r in found.filter("doc is not null").collect()] == [*values[:2], "{} {}"]
    assert "schema_of_variant" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("schemaofvariant", "schema_of_variant")


def test_curation_counts_every_reason_in_one_pass(spark, tmp_path):
    """No line, and lines of every fate: counts as before, reasons without a line are left out."""
    line = '{"ndjson_contract_version":"1","emitter_version":"1","supplier_id":"s","parser_id":"p","mapping_version":"1","mapping_hash":"h","run_id":"r","effective_at":"%s","sku_candidate_key":"k","raw":{},"parsed":{"price":1,"qty":%s},"quality_flags":[],"_meta":{"source_row_number":1}}'
    for name, rows, want in (("none", [], (0, 0, {}, None)), ("some", [("b", "null"), ("a", "3"), ("a", "0"), ("a", "-1")], (1, 3, {"qty_missing": 1, "qty_nonpositive": 2}, "b"))):
        runs.storage.write_text(f"{tmp_path}/{name}.ndjson", "".join(line % r + "\n" for r in rows))
        runs.storage.write_text(f"{tmp_path}/{name}.json", runs.dump({"run_id": name, "paths": {"segment": f"{tmp_path}/{name}.ndjson"}}))
        got = runs.curate_run(spark, f"{tmp_path}/{name}.json", str(tmp_path))
        assert (got["kept_lines"], got["dropped_lines"], got["drop_counts"], got["effective_at"]) == want
    assert set(contract.DROP_REASONS) == {"qty_missing", "qty_nonpositive", "unknown"}
