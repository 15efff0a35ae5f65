"""Emitters: from price rows to routed (row x warehouse) lines.

Every emitter is one plan. Prices and keys are parsed once per source row,
below the explode; warehouses are exploded from an array, which is a narrow
operation; the fate of a line is one CASE. No step shuffles; a source of many
rows in few partitions is spread before it (spread).

A price row has: row_no, article_primary, article_fallback, brand, name,
price_raw and warehouses array<struct<name,qty_raw>>.
"""

from __future__ import annotations

from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.functions import hashing, numeric
from tarifold.functions.text import nfkc, norm_warehouse, norm_ws, sku_tail, text
from tarifold.sources.grid import header_index
from tarifold.sources.mapping import Mapping

NDJSON_CONTRACT, EMITTER = "1.0.0", "1.0.0"
#: Rows up to which an emitter may have them in one task.
SPREAD_ROWS = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """Many rows shuffled over all cores before the parsing, which costs more than the shuffle: a file with one row group is one task."""
    return rows.repartition("row_no") if rows.limit(SPREAD_ROWS + 1).count() > SPREAD_ROWS else rows


def cell(position: int) -> Column:
    """1-based cell of a grid row, "" outside it."""
    return F.coalesce(F.get("cells", position - 1), F.lit("")) if position > 0 else F.lit("")


#: Headers of the header-addressed catalogue, by role.
HEADED = {"goods_id": "Код товара (goods_id)", "name": "Номенклатура", "article": "Артикул", "price_raw": "Цена", "warehouse": "Склад", "qty_raw": "Остаток на складе"}


def headed_rows(grid: DataFrame, header_row: int = 6, data_row: int | None = None, names: dict[str, str] = HEADED) -> tuple[DataFrame | None, str | None]:
    """(rows with one column per role, None), or (None, reason) for a sheet without that header.

    The header row alone is read by the driver; of equal headers the last counts.
    """
    head = grid.filter(F.col("row_no") == header_row).first()
    if head is None:
        return None, "no header row"
    at = header_index(head["cells"])
    missing = [n for n in names.values() if n not in at]
    if missing:
        return None, f"missing columns: {missing}"
    rows = grid.filter(F.col("row_no") >= (data_row or header_row + 1)).select("row_no", *(cell(at[n]).alias(k) for k, n in names.items()))
    return rows.withColumn("goods_id", F.nullif(F.trim("goods_id"), F.lit(""))), None


def sheet_rows(grid: DataFrame, columns: dict[str, int], first_row: int = 2) -> DataFrame:
    """Positional sheet: one column per role at its 1-based position."""
    return grid.filter(F.col("row_no") >= first_row).select("row_no", *(cell(n).alias(k) for k, n in columns.items()))


#: Positions of the two known positional layouts.
TYRES = {"name": 1, "sku_raw": 2, "brand": 3, "qty_raw": 12, "price_raw": 13}
WHEELS = {"name": 1, "sku_raw": 2, "brand": 3, "qty_raw": 14, "price_raw": 15}


def price_rows(grid: DataFrame, mapping: Mapping, header: list[str] | None = None, extra: dict[str, int] | None = None) -> DataFrame:
    """Price rows of a grid.

    header: names of warehouses are the header's cells where it reaches.
    extra: further columns to carry along (retail prices and the like), by position.
    """
    names = [header[w.column - 1] if header is not None and w.column <= len(header) else w.name for w in mapping.warehouses]
    stock = F.array(*(F.struct(F.lit(n).alias("name"), cell(w.column).alias("qty_raw")) for n, w in zip(names, mapping.warehouses)))
    rows = grid.filter(F.col("row_no") >= mapping.data_row)
    return rows.select("row_no", *(cell(mapping.columns[k]).alias({"price": "price_raw"}.get(k, k)) for k in ("article_primary", "article_fallback", "brand", "name", "price")), *(cell(n).alias(k) for k, n in (extra or {}).items()), stock.alias("warehouses"))


def all_empty() -> Column:
    """Rows without article, brand, name, price and any quantity."""
    return (F.col("sku") == "") & (text(F.col("brand")) == "") & (text(F.col("name")) == "") & (text(F.col("price_raw")) == "") & F.forall("warehouses", lambda w: text(w["qty_raw"]) == "")


def explode_warehouses(rows: DataFrame) -> DataFrame:
    """One row per warehouse: wh_pos (from 1), warehouse, qty_raw."""
    out = rows.select("*", F.posexplode("warehouses").alias("__pos", "__w"))
    return out.withColumns({"wh_pos": F.col("__pos") + 1, "warehouse": F.col("__w.name"), "qty_raw": text(F.col("__w.qty_raw"))}).drop("__pos", "__w", "warehouses")


def emit_typed(rows: DataFrame, price_scale: int = 100, unicode_keys: bool = True) -> DataFrame:
    """Typed contract: lines with fate good, bad:<reason>, skip, or all_empty (one per source row).

    The order of the tests is the contract: key, price, then quantity; a bad
    row is bad in every warehouse, a line without stock is skipped silently.
    """
    keys = [nfkc(F.col(k)) if unicode_keys else F.col(k) for k in ("article_primary", "article_fallback")]
    first, second = sku_tail(F.col("__first")), sku_tail(F.col("__second"))
    keyed = rows.withColumns(dict(zip(("__first", "__second"), keys))).withColumn("sku", F.coalesce(F.nullif(first, F.lit("")), second))
    keyed = keyed.withColumn("article", F.coalesce(F.nullif(text(F.col("article_primary")), F.lit("")), text(F.col("article_fallback"))))
    keyed = keyed.withColumn("blank", all_empty()).withColumn("price", numeric.price_minor(F.col("price_raw"), price_scale))
    keyed = keyed.withColumn("warehouses", F.when(F.col("blank"), F.slice("warehouses", 1, 1)).otherwise(F.col("warehouses")))
    lines = explode_warehouses(keyed).withColumn("qty", numeric.qty_soft(F.col("qty_raw")))
    fate = (
        F.when(F.col("blank"), "all_empty").when(F.col("sku") == "", "bad:empty_sku").when(F.col("price.error").isNotNull(), F.concat(F.lit("bad:"), F.col("price.error")))
        .when(F.coalesce(F.col("qty.value"), F.lit(0)) <= 0, "skip").otherwise("good")
    )
    found = F.array_sort(F.array_distinct(F.concat("price.flags", "qty.flags")))
    return lines.select("row_no", "wh_pos", "warehouse", "sku", "article", "brand", "name", text(F.col("price_raw")).alias("price_raw"), "qty_raw", F.col("price.value").alias("price"), F.col("qty.value").alias("qty"), found.alias("flags"), fate.alias("fate"))


def good_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("fate = 'good'").drop("fate")


def bad_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("fate").startswith("bad:")).withColumn("reason_code", F.substring("fate", 5, 100)).drop("fate", "flags", "price", "qty")


def typed_contract(lines: DataFrame, run: dict[str, str]) -> DataFrame:
    """Good lines in the shape of the typed contract. run: supplier_id, parser_id, mapping_version, mapping_hash, run_id, effective_at."""
    fixed = {"ndjson_contract_version": NDJSON_CONTRACT, "emitter_version": EMITTER, **run}
    return good_lines(lines).select(
        *(F.lit(fixed[k]).alias(k) for k in "ndjson_contract_version emitter_version supplier_id parser_id mapping_version mapping_hash run_id effective_at".split()), F.col("sku").alias("sku_candidate_key"),
        F.struct(F.col("article").alias("supplier_article"), text(F.col("brand")).alias("brand_raw"), text(F.col("name")).alias("name_raw"), "price_raw", "qty_raw", F.col("warehouse").alias("supplier_warehouse_name")).alias("raw"),
        F.struct("price", "qty").alias("parsed"), F.col("flags").alias("quality_flags"), F.struct(F.col("row_no").cast("int").alias("source_row_number")).alias("_meta"),
    )


def typed_stats(lines: DataFrame) -> DataFrame:
    """One row of counts; silent skips are no exploded lines. One pass, partial aggregation, no key."""
    fate = F.col("fate")
    good, bad = F.count_if(fate == "good"), F.count_if(fate.startswith("bad:"))
    return lines.agg(
        F.count_if(F.col("wh_pos") == 1).alias("source_rows_read"), (good + bad).alias("exploded_lines"), good.alias("good_rows"), bad.alias("bad_rows"),
        F.count_if(fate == "all_empty").alias("skipped_rows_all_empty"), F.count_if(fate == "skip").alias("skipped_lines"),
    )


def counts_by(lines: DataFrame, key: str, values: Column) -> DataFrame:
    """Rows (key, n) of the elements of an array column: flags, reasons."""
    return lines.select(F.explode(values).alias(key)).groupBy(key).agg(F.count("*").alias("n"))


def flag_counts(lines: DataFrame) -> DataFrame:
    return counts_by(lines.filter("fate = 'good'"), "flag", F.array_distinct("flags"))


def reason_counts(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("fate").startswith("bad:")).groupBy(F.substring("fate", 5, 100).alias("reason")).agg(F.count("*").alias("n"))


def exact_ratio(part: int, whole: int) -> str:
    """part / whole with 28 significant digits; "0" without rows."""
    return str(Context(prec=28).divide(Decimal(part), Decimal(whole))) if whole else "0"


def stats_document(lines: DataFrame, run: dict[str, str]) -> dict:
    """The stats of a typed run. The three small aggregates are the only rows that reach the driver."""
    counts = typed_stats(lines).first().asDict()
    return run | counts | {
        "ndjson_contract_version": NDJSON_CONTRACT, "emitter_version": EMITTER, "explosion_factor_exact": exact_ratio(counts["exploded_lines"], counts["source_rows_read"]),
        "bad_reasons_counts": {r["reason"]: r["n"] for r in reason_counts(lines).collect()}, "flags_counts": {r["flag"]: r["n"] for r in flag_counts(lines).collect()},
        "file_readable": True, "structure_ok": True,
    }


def emit_strings(rows: DataFrame) -> DataFrame:
    """String contract: fate emit, qty_empty, qty_zero or qty_invalid per line; only stock decides."""
    stripped = {k: F.trim(text(F.col(k))) for k in ("article_primary", "article_fallback", "brand", "name")}
    keyed = rows.select("row_no", "price_raw", "warehouses", *(c.alias(k) for k, c in stripped.items()))
    keyed = keyed.withColumn("article", F.coalesce(F.nullif(F.col("article_primary"), F.lit("")), F.col("article_fallback")))
    keyed = keyed.withColumns({"sku": hashing.fallback_sku(F.col("article"), F.col("article_fallback"), F.col("brand"), F.col("name")), "price": numeric.price_text(F.col("price_raw"))})
    lines = explode_warehouses(keyed).withColumn("qty", numeric.int_text(F.col("qty_raw")))
    n = F.col("qty.value").try_cast("decimal(38,0)")
    fate = F.when((F.col("qty.value") == "") & (F.trim("qty_raw") == ""), "qty_empty").when((F.col("qty.value") == "") | (n < 0), "qty_invalid").when(n == 0, "qty_zero").otherwise("emit")
    return lines.select("row_no", "wh_pos", norm_warehouse(F.col("warehouse")).alias("warehouse"), F.col("warehouse").alias("warehouse_raw"), F.col("sku.value").alias("sku"), "article", F.col("article_fallback").alias("code"), "brand", "name", F.col("price.value").alias("price"), F.col("qty.value").alias("qty"), F.concat("sku.flags", "price.flags", "qty.flags").alias("flags"), fate.alias("fate"))


def string_contract(lines: DataFrame, supplier_id: str, parser_id: str, run_id: str, currency: str = "RUB") -> DataFrame:
    return lines.filter("fate = 'emit'").select(
        F.lit(supplier_id).alias("supplier_id"), F.lit(parser_id).alias("parser_id"), F.lit("1.0").alias("parser_version"), F.lit(run_id).alias("run_id"), F.col("flags").alias("quality_flags"),
        F.struct(F.col("warehouse").alias("supplier_warehouse_name"), F.col("sku").alias("sku_candidate_key"), "price", "qty", F.lit(currency).alias("currency"), F.col("article").alias("supplier_article"), F.col("code").alias("supplier_code_1c"), F.col("brand").alias("brand_raw"), F.col("name").alias("name_raw")).alias("raw"),
        F.struct(F.col("row_no").cast("int").alias("source_row_1based"), F.struct(F.col("warehouse_raw").alias("supplier_warehouse_name_raw")).alias("passthrough")).alias("_meta"),
    )


def string_stats(lines: DataFrame) -> DataFrame:
    """Counts of a string run; price and key problems count per source row, the rest per line."""
    once, fate = F.col("wh_pos") == 1, F.col("fate")
    return lines.agg(
        F.count_if(fate == "emit").alias("lines"), F.count_if(fate == "qty_invalid").alias("bad_qty"), F.count_if(fate == "qty_empty").alias("skipped_qty_empty"), F.count_if(fate == "qty_zero").alias("skipped_qty_zero"), F.count_if(fate == "qty_invalid").alias("skipped_qty_invalid"),
        F.count_if(once & (F.col("price") == "")).alias("bad_price"), F.count_if(once & F.array_contains("flags", "missing_sku")).alias("missing_sku"),
    )


def string_flag_counts(lines: DataFrame) -> DataFrame:
    """Flags of emitted lines, repeats counted."""
    return counts_by(lines.filter("fate = 'emit'"), "flag", F.col("flags"))


def emit_headed(rows: DataFrame) -> DataFrame:
    """Header-addressed catalogue (goods_id, name, article, price_raw, warehouse, qty_raw): quantity is tested before price."""
    q, p = numeric.lower_bound_qty(F.col("qty_raw")), numeric.as_float(F.col("price_raw"))
    fate = F.when(F.col("goods_id").isNull(), "no_id").when(F.coalesce(q, F.lit(0)) <= 0, "bad_qty").when(F.coalesce(p, F.lit(0.0)) <= 0, "bad_price").otherwise("emit")
    return rows.withColumns({"qty": q, "price": p, "fate": fate})


def headed_stats(lines: DataFrame) -> DataFrame:
    fate = F.col("fate")
    return lines.agg(F.count_if(fate != "no_id").alias("rows_seen"), F.count_if(fate == "emit").alias("rows_emitted"), F.count_if(fate == "bad_price").alias("bad_price"), F.count_if(fate == "bad_qty").alias("bad_qty"))


def emit_category(items: DataFrame) -> DataFrame:
    """JSON category (id, stock, price_minimum, is_object, and id_kind where ids are not all texts): a missing price is counted and kept.

    A blank id, the number 0 and false are no id; the texts "0" and "false" are.
    """
    q, p = numeric.as_int(F.col("stock")), numeric.as_float(F.col("price_minimum"))
    shown = F.trim(text(F.col("id")))
    kind = F.col("id_kind") if "id_kind" in items.columns else F.lit("string")
    no_id = (shown == "") | F.coalesce((kind == "number") & (F.col("id").try_cast("double") == 0), F.lit(False)) | F.coalesce((kind == "boolean") & (shown == "false"), F.lit(False))
    fate = F.when(~F.coalesce(F.col("is_object"), F.lit(False)), "no_object").when(no_id, "no_id").when(q.isNull(), "bad_qty").when(q <= 0, "qty_empty").otherwise("emit")
    return items.withColumns({"qty": q, "price": p, "fate": fate})


def category_stats(lines: DataFrame) -> DataFrame:
    fate = F.col("fate")
    return lines.agg(
        F.count("*").alias("seen_items"), F.count_if(fate == "emit").alias("emitted_items"), F.count_if(fate == "no_id").alias("skipped_no_id"), F.count_if(fate.isin("bad_qty", "qty_empty")).alias("skipped_qty_empty"),
        F.count_if((fate == "emit") & F.col("price").isNull()).alias("bad_price"), F.count_if(fate == "bad_qty").alias("bad_qty"),
    )


def emit_sheet(rows: DataFrame, zero_price_apart: bool = False) -> DataFrame:
    """Positional sheet (sku_raw, brand, name, price_raw, qty_raw): price is tested before quantity.

    zero_price_apart: literal zeros have a fate of their own and other price
    problems count as missing.
    """
    sku, price, qty = norm_ws(F.col("sku_raw")), numeric.positive_price(F.col("price_raw")), numeric.first_digits_qty(F.col("qty_raw"))
    out = rows.withColumns({"sku": sku, "__p": price, "__q": qty})
    fate = F.when(F.col("sku") == "", "missing_sku")
    if zero_price_apart:
        fate = fate.when(norm_ws(F.col("price_raw")).rlike("^0([.,]0)?$"), "price_zero").when(F.col("__p.value") == "", "price_missing")
    else:
        fate = fate.when(F.col("__p.value") == "", "bad_price")
    fate = fate.when((F.col("__q.value") == "") & (norm_ws(F.col("qty_raw")) == ""), "qty_empty").when(F.coalesce(F.col("__q.value").try_cast("decimal(38,0)"), F.lit(0)) <= 0, "qty_invalid").otherwise("emit")
    return out.withColumns({"price": F.col("__p.value"), "qty": F.col("__q.value"), "flags": F.concat("__p.flags", "__q.flags"), "fate": fate}).drop("__p", "__q")


def headed_contract(lines: DataFrame, supplier_id: str, category: str, sheet: str, at: str) -> DataFrame:
    """Emitted lines of a header-addressed sheet in the item contract."""
    filled = lambda c: F.nullif(F.trim(text(F.col(c))), F.lit(""))
    return lines.filter("fate = 'emit'").select(
        F.lit(supplier_id).alias("supplier_id"), F.lit(f"{supplier_id}__{category}__xlsx_v1").alias("parser_id"), F.lit(f"category:{category}").alias("layout"), F.lit(at).alias("ts_ingested"),
        F.struct(F.trim("goods_id").alias("supplier_item_id"), filled("name").alias("name"), filled("article").alias("article"), F.col("qty").cast("long").alias("qty"), F.col("price").alias("price_opt"), F.lit("RUB").alias("currency")).alias("item"),
        F.struct(F.lit(sheet).alias("sheet"), "warehouse").alias("raw"),
    )


def category_contract(lines: DataFrame, supplier_id: str, category: str, at: str) -> DataFrame:
    """Emitted items of a JSON category in the item contract; the second image field stands in for the first."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return lines.filter("fate = 'emit'").select(
        F.lit(supplier_id).alias("supplier_id"), F.lit(f"{supplier_id}__{category}__json_v1").alias("parser_id"), F.lit(f"category:{category}").alias("layout"), F.lit(at).alias("ts_ingested"),
        F.struct(
            F.trim("id").alias("supplier_item_id"), "name", F.col("marka").alias("brand"), "model", "article", F.col("qty").cast("long").alias("qty"), F.col("price").alias("price_opt"),
            numeric.as_float(F.col("price_roznica")).alias("price_roznica"), F.coalesce(some("image"), F.col("img_url")).alias("image"),
        ).alias("item"),
        F.struct(F.lit(category).alias("category_key")).alias("raw"),
    )


def sheet_contract(lines: DataFrame, supplier_id: str, parser_id: str, run_id: str, sheet: str, warehouse: str, currency: str = "RUB") -> DataFrame:
    """Emitted lines of a positional sheet in the string contract, less the fields such sheets lack."""
    return lines.filter("fate = 'emit'").select(
        F.lit(supplier_id).alias("supplier_id"), F.lit(parser_id).alias("parser_id"), F.lit("1.0").alias("parser_version"), F.lit(run_id).alias("run_id"), F.col("flags").alias("quality_flags"),
        F.struct(F.lit(warehouse).alias("supplier_warehouse_name"), F.col("sku").alias("sku_candidate_key"), "price", "qty", F.lit(currency).alias("currency"), norm_ws(F.col("brand")).alias("brand_raw"), norm_ws(F.col("name")).alias("name_raw")).alias("raw"),
        F.struct(F.col("row_no").cast("int").alias("source_row_1based"), F.struct(F.lit(sheet).alias("sheet")).alias("passthrough")).alias("_meta"),
    )


def sheet_flag_counts(lines: DataFrame) -> DataFrame:
    """Flags of emitted lines of a positional sheet."""
    return counts_by(lines.filter("fate = 'emit'"), "flag", F.col("flags"))


def fate_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("fate").agg(F.count("*").alias("n"))


def explode_stocked(rows: DataFrame, default_warehouse: str, single: bool = False) -> DataFrame:
    """Diagnostic explode: warehouses with stock, or one line without stock at the default warehouse.

    single: always one line, the first warehouse's.
    """
    parsed = F.transform("warehouses", lambda w: F.struct(w["name"].alias("name"), F.coalesce(numeric.as_number(w["qty_raw"]), F.lit(0.0)).alias("qty")))
    kept = F.filter(F.slice(parsed, 1, 1) if single else parsed, lambda w: w["qty"] > 0)
    default = F.array(F.struct(F.lit(default_warehouse).alias("name"), F.lit(0.0).alias("qty")))
    out = rows.withColumn("__kept", kept)
    out = out.withColumns({"total_qty": F.aggregate("__kept", F.lit(0.0), lambda a, w: a + w["qty"]), "all_warehouses": F.col("__kept")})
    out = out.select("*", F.explode(F.when(F.size("__kept") == 0, default).otherwise(F.col("__kept"))).alias("__w"))
    return out.withColumns({"warehouse": norm_warehouse(F.col("__w.name")), "qty": F.col("__w.qty"), "flags": numeric.flags((F.col("__w.qty") <= 0, "no_qty"))}).drop("__w", "__kept", "warehouses")


def diagnostic_stats(rows: DataFrame, lines: DataFrame) -> DataFrame:
    price = numeric.as_number(F.col("price_raw"))
    seen = rows.agg(F.count("*").alias("rows_total_seen"), F.count_if(price > 0).alias("rows_with_price_gt_0"), F.count_if(F.exists("warehouses", lambda w: F.coalesce(numeric.as_number(w["qty_raw"]), F.lit(0.0)) > 0)).alias("rows_with_any_qty_gt_0"))
    return seen.crossJoin(F.broadcast(lines.agg(F.count("*").alias("rows_emitted"), F.count_if(F.col("qty") <= 0).alias("emitted_no_qty"))))  # one row each


def first_stocked(lines: DataFrame, n: int = 5) -> DataFrame:
    """First lines with stock in row order."""
    return lines.filter("qty > 0").orderBy("row_no", "warehouse").limit(n)


def cap_rows(rows: DataFrame, max_rows: int | None) -> DataFrame:
    """The first max_rows source rows by number; 0 or None: all."""
    return rows.filter(F.col("row_no") <= max_rows) if max_rows else rows
