"""Catalogue of the engine's queries over the driver's tables, each with its DuckDB oracle.

PL is a synthetic price list over part: four warehouses per part, with every
kind of blank, textual, fractional and negative value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.functions import hashing, numeric
from tarifold.functions.text import norm_header, norm_ws, normalize_sku, sanitize_tag, signature_tokens, unreviewed_alias
from tarifold.operators import contract, dispatch, emit, gate, offers, reports

Query = Callable[[SparkSession, str], DataFrame]
WAREHOUSES = ["Main Store", "North  Depot", " South Depot ", "West"]
ARTIFACT = "art-1"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _cases(key: Column, values: dict[int, str], rest: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(rest)


def _qty(k: Column, pos: int) -> Column:
    return _cases((k + 3 * pos) % 11, {0: "", 1: "0", 2: ">40", 3: "2.5", 4: "none", 5: "-3"}, ((k + pos) % 50).cast("string"))


def price_list(spark: SparkSession, sf: str) -> DataFrame:
    """PL in the shape of price rows."""
    k = F.col("p_partkey")
    price = _cases(k % 17, {0: "", 1: "abc", 2: "0", 3: "-5"}, F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    stock = F.array(*(F.struct(F.lit(n).alias("name"), _qty(k, pos).alias("qty_raw")) for pos, n in enumerate(WAREHOUSES, 1)))
    rows = _read(spark, sf, "part").select(
        k.alias("row_no"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" P"), k.cast("string"), F.lit(" "))).alias("article_primary"), F.when(k % 26 == 0, "").otherwise(F.concat(F.lit("C"), k.cast("string"))).alias("article_fallback"),
        F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), price.alias("price_raw"), stock.alias("warehouses"),
    )
    return emit.spread(rows)


def _wh_sql() -> str:
    return "case pos " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(WAREHOUSES, 1)) + " end"


PL_SQL = f"""pl0 as (select p_partkey as k, case when p_partkey % 13 = 0 then '' else ' P' || p_partkey || ' ' end as a1, case when p_partkey % 26 = 0 then '' else 'C' || p_partkey end as a2, p_brand as brand, p_name as name,
    case p_partkey % 17 when 0 then '' when 1 then 'abc' when 2 then '0' when 3 then '-5' else p_retailprice::decimal(18,2)::varchar end as price_raw from part),
pl as (select *, {_wh_sql()} as wh, case (k + 3 * pos) % 11 when 0 then '' when 1 then '0' when 2 then '>40' when 3 then '2.5' when 4 then 'none' when 5 then '-3' else ((k + pos) % 50)::varchar end as qty_raw
    from pl0, (select unnest([1, 2, 3, 4]) as pos) p)"""

TYPED_SQL = f"""{PL_SQL},
t0 as (select *, coalesce(nullif(trim(a1), ''), trim(a2)) as sku, round(try_cast(price_raw as decimal(38,12)) * 100, 0)::bigint as price, try_cast(qty_raw as decimal(38,12)) as exact,
    try_cast(replace(regexp_extract(qty_raw, '-?[0-9]+(?:[.,][0-9]+)?'), ',', '.') as decimal(38,12)) as loose from pl),
t1 as (select *, coalesce(exact, loose) as d, round(coalesce(exact, loose), 0)::bigint as qty from t0),
typed as (select *, list_sort(list_distinct(list_filter([case when price_raw = '' then 'missing_price' end, case when price = 0 then 'zero_price' end, case when price < 0 then 'negative_price' end,
    case when qty_raw = '' then 'no_qty' end, case when qty_raw <> '' and d is null then 'qty_textual' end, case when exact is null and loose is not null then 'qty_approximated' end, case when d < 0 then 'negative_qty' end, case when d = 0 then 'qty_zero' end,
    case when d <> round(d, 0) then 'qty_fractional' end], lambda x: x is not null))) as flags,
    case when sku = '' then 'bad:empty_sku' when price_raw <> '' and price is null then 'bad:invalid_price_format' when coalesce(qty, 0) <= 0 then 'skip' else 'good' end as fate from t1)"""


def typed(spark: SparkSession, sf: str) -> DataFrame:
    # every key of PL is ASCII, so the Unicode step has nothing to do
    return emit.emit_typed(price_list(spark, sf))


def q_explode_warehouses(spark: SparkSession, sf: str) -> DataFrame:
    return emit.explode_warehouses(price_list(spark, sf)).select("row_no", "wh_pos", "warehouse", "qty_raw", "price_raw")


def q_emit_good(spark: SparkSession, sf: str) -> DataFrame:
    return emit.good_lines(typed(spark, sf)).select("row_no", "wh_pos", "warehouse", "sku", "price", "qty", F.array_join("flags", ",").alias("flags"))


def q_emit_bad(spark: SparkSession, sf: str) -> DataFrame:
    return emit.bad_lines(typed(spark, sf)).select("row_no", "wh_pos", "sku", "price_raw", "qty_raw", "reason_code")


def q_emit_stats(spark: SparkSession, sf: str) -> DataFrame:
    return emit.typed_stats(typed(spark, sf))


def q_flags_counts(spark: SparkSession, sf: str) -> DataFrame:
    return emit.flag_counts(typed(spark, sf))


def q_bad_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return emit.reason_counts(typed(spark, sf))


def q_emit_strings(spark: SparkSession, sf: str) -> DataFrame:
    return emit.emit_strings(price_list(spark, sf)).select("row_no", "wh_pos", "warehouse", "sku", "price", "qty", F.array_join("flags", ",").alias("flags"), "fate")


STRINGS_SQL = f"""{PL_SQL},
s0 as (select *, coalesce(nullif(trim(a1), ''), trim(a2)) as article, try_cast(regexp_replace(price_raw, '[^0-9.,-]', '', 'g') as double) as p, try_cast(replace(regexp_replace(qty_raw, '[^0-9.,-]', '', 'g'), ',', '.') as double) as q from pl),
strings as (select k as row_no, pos as wh_pos, lower(trim(regexp_replace(wh, ' +', ' ', 'g'))) as warehouse, case when article <> '' then article else 'unknown_sku_' || substr(sha1(brand || '|' || name), 1, 12) end as sku,
    case when p is null then '' when abs(p - trunc(p)) < 1e-9 then trunc(p)::bigint::varchar else regexp_replace(regexp_replace(p::decimal(38,6)::varchar, '0+$', ''), '[.]$', '') end as price,
    case when q = floor(q) then floor(q)::bigint::varchar else '' end as qty0, coalesce(qty0, '') as qty,
    list_filter([case when article = '' then 'missing_sku' end, case when price_raw = '' then 'missing_price' when p is null then 'bad_price' end,
        case when qty_raw = '' then null when q is null then 'qty_non_numeric' when q <> floor(q) then 'qty_has_fraction' when qty_raw like '>%' then 'qty_approximated' end], lambda x: x is not null) as flags,
    case when coalesce(qty0, '') = '' and qty_raw = '' then 'qty_empty' when coalesce(qty0, '') = '' or q < 0 then 'qty_invalid' when q = 0 then 'qty_zero' else 'emit' end as fate from s0)"""


def q_string_stats(spark: SparkSession, sf: str) -> DataFrame:
    return emit.string_stats(emit.emit_strings(price_list(spark, sf)))


def q_string_flags(spark: SparkSession, sf: str) -> DataFrame:
    return emit.string_flag_counts(emit.emit_strings(price_list(spark, sf)))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return emit.explode_warehouses(price_list(spark, sf)).withColumn("goods_id", F.nullif(F.trim("article_primary"), F.lit("")))


def q_emit_headed(spark: SparkSession, sf: str) -> DataFrame:
    return emit.emit_headed(_flat(spark, sf)).select("row_no", "wh_pos", "goods_id", "qty", "price", "fate")


def q_headed_stats(spark: SparkSession, sf: str) -> DataFrame:
    return emit.headed_stats(emit.emit_headed(_flat(spark, sf)))


FLOAT_SQL = "case when regexp_matches({0}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') then {0}::double end"
HEADED_SQL = f"""{PL_SQL},
h0 as (select k as row_no, pos as wh_pos, nullif(trim(a1), '') as goods_id, {FLOAT_SQL.format("price_raw")} as price, coalesce(try_cast(nullif(regexp_extract(qty_raw, '^>[ ]*([0-9]+)[ ]*$', 1), '') as bigint), trunc({FLOAT_SQL.format("qty_raw")})::bigint) as qty from pl),
headed as (select *, case when goods_id is null then 'no_id' when coalesce(qty, 0) <= 0 then 'bad_qty' when coalesce(price, 0) <= 0 then 'bad_price' else 'emit' end as fate from h0)"""


def _category(spark: SparkSession, sf: str) -> DataFrame:
    rows = _flat(spark, sf)
    return rows.select("row_no", "wh_pos", F.col("goods_id").alias("id"), F.col("qty_raw").alias("stock"), F.col("price_raw").alias("price_minimum"), ((F.col("row_no") + F.col("wh_pos")) % 29 != 0).alias("is_object"))


def q_emit_json_category(spark: SparkSession, sf: str) -> DataFrame:
    return emit.emit_category(_category(spark, sf)).select("row_no", "wh_pos", "id", "qty", "price", "fate")


def q_json_category_stats(spark: SparkSession, sf: str) -> DataFrame:
    return emit.category_stats(emit.emit_category(_category(spark, sf)))


CATEGORY_SQL = f"""{PL_SQL},
c0 as (select k as row_no, pos as wh_pos, nullif(trim(a1), '') as id, {FLOAT_SQL.format("price_raw")} as price, trunc({FLOAT_SQL.format("qty_raw")})::bigint as qty, (k + pos) % 29 <> 0 as is_object from pl),
category as (select *, case when not is_object then 'no_object' when coalesce(id, '') in ('', '0') then 'no_id' when qty is null then 'bad_qty' when qty <= 0 then 'qty_empty' else 'emit' end as fate from c0)"""


def _sheet(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).withColumnRenamed("article_primary", "sku_raw")


def q_emit_sheet(spark: SparkSession, sf: str) -> DataFrame:
    return emit.emit_sheet(_sheet(spark, sf)).select("row_no", "wh_pos", "sku", F.nullif(F.col("price"), F.lit("")).cast("decimal(18,6)").alias("price"), "qty", F.array_join("flags", ",").alias("flags"), "fate")


def q_sheet_fates(spark: SparkSession, sf: str) -> DataFrame:
    return emit.fate_counts(emit.emit_sheet(_sheet(spark, sf), zero_price_apart=True))


SHEET_SQL = f"""{PL_SQL},
w0 as (select k as row_no, pos as wh_pos, trim(a1) as sku, price_raw, qty_raw, {FLOAT_SQL.format("price_raw")} as p, nullif(regexp_extract(qty_raw, '([0-9]+)', 1), '') as digits from pl),
sheet as (select *, case when p > 0 then p::decimal(18,6) end as price, coalesce(digits, '') as qty,
    list_filter([case when price_raw = '' then 'missing_price' when coalesce(p, 0) <= 0 then 'bad_price' end, case when qty_raw = '' then 'missing_qty' when digits is null then 'qty_non_numeric' when not regexp_matches(qty_raw, '^[0-9]+$') then 'qty_approximated' end], lambda x: x is not null) as flags,
    case when qty_raw = '' then 'qty_empty' when coalesce(digits::bigint, 0) <= 0 then 'qty_invalid' else 'emit' end as stock_fate from w0)"""


def _stocked(spark: SparkSession, sf: str, single: bool = False) -> DataFrame:
    return emit.explode_stocked(price_list(spark, sf), WAREHOUSES[0], single)


def q_diag_explode_default(spark: SparkSession, sf: str) -> DataFrame:
    return _stocked(spark, sf).select("row_no", "warehouse", "qty", "total_qty", F.array_join("flags", ",").alias("flags"))


def q_diag_stats(spark: SparkSession, sf: str) -> DataFrame:
    return emit.diagnostic_stats(price_list(spark, sf), _stocked(spark, sf))


def q_diag_single(spark: SparkSession, sf: str) -> DataFrame:
    return _stocked(spark, sf, True).select("row_no", "warehouse", "qty", F.array_join("flags", ",").alias("flags"))


def q_first_stocked(spark: SparkSession, sf: str) -> DataFrame:
    return emit.first_stocked(_stocked(spark, sf)).select("row_no", "warehouse", "qty")


WH_NORM = "lower(trim(regexp_replace(wh, ' +', ' ', 'g')))"
STOCKED_SQL = f"""{PL_SQL},
d0 as (select k as row_no, pos, {WH_NORM} as warehouse, price_raw, coalesce({FLOAT_SQL.format("qty_raw")}, 0) as qty from pl),
d1 as (select *, sum(case when qty > 0 then qty else 0 end) over (partition by row_no) as total_qty, count(*) filter (qty > 0) over (partition by row_no) as n from d0),
stocked as (select row_no, warehouse, qty, total_qty, '' as flags from d1 where qty > 0 union all select row_no, '{WAREHOUSES[0].lower()}', 0, 0, 'no_qty' from d1 where n = 0 and pos = 1)"""

BASELINE = [("exploded_lines", "100", 5, False), ("good_rows", "4545", 0, False), ("skipped_rows_all_empty", "0", 0, False), ("source_rows_read", "2000", 0, True), ("price_source", "1", 0, False)]


def _stats_metrics(spark: SparkSession, sf: str) -> DataFrame:
    wide = q_emit_stats(spark, sf)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("actual")) for c in wide.columns))).alias("m")).select("m.*")


def q_gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    baseline = spark.createDataFrame(BASELINE, "metric string, expected string, tolerance long, is_text boolean")
    return gate.metric_reasons(_stats_metrics(spark, sf), baseline).select("metric", "expected", "actual", "level", "code")


STATS_SQL = """stats as (select (select count(*) from part) as source_rows_read, count(*) filter (fate = 'good' or fate like 'bad%') as exploded_lines, count(*) filter (fate = 'good') as good_rows, count(*) filter (fate like 'bad%') as bad_rows,
    0::bigint as skipped_rows_all_empty, count(*) filter (fate = 'skip') as skipped_lines from typed)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Many runs: each supplier key's orders as one run's counts."""
    o = _read(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 97).cast("string").alias("run_id")).agg(
        (F.sum(F.col("o_orderkey") % 13) > 0).alias("file_readable"), (F.max("o_custkey") % 5 != 0).alias("structure_ok"), F.count_if(F.col("o_orderstatus") != "P").alias("exploded_lines"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0)).alias("bad_rows"),
        F.count_if(F.col("o_totalprice") < 1000).alias("negative_price"),
    )


def q_gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    return gate.verdicts(runs, gate.run_reasons(runs))


def _json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """events.props widened to lines with typical defects."""
    k = F.col("event_id")
    meta = F.when(k % 7 == 0, "").when(k % 7 == 1, ', "_meta": 3').when(k % 7 == 2, ', "_meta": {"source_row_number": "x"}').when(k % 7 == 3, ', "_meta": {"source_row_number": "4"}').when(k % 7 == 4, ', "_meta": {"source_row_number": null}').otherwise(', "_meta": {"source_row_number": 4}')
    parsed = F.when(k % 23 == 3, ', "parsed": {"price": "100", "qty": 2}').when(k % 23 == 4, ', "parsed": {"price": 100, "qty": "7"}').when(k % 23 == 5, ', "parsed": {"price": true, "qty": 12345678901234567890}').when(k % 23 == 6, ', "parsed": {"price": 1.0}').when(k % 5 == 0, ', "parsed": {"price": 1.5, "qty": 2}').when(k % 5 == 1, ', "parsed": {"price": null, "qty": 3}').when(k % 5 == 2, ', "parsed": [1]').otherwise(F.concat(F.lit(', "parsed": {"price": 100, "qty": '), (k % 9 - 4).cast("string"), F.lit("}")))
    value = F.when(k % 31 == 0, "{broken").otherwise(F.concat(F.expr("substring(props, 1, length(props) - 1)"), meta, parsed, F.lit(', "quality_flags": []}')))
    return _read(spark, sf, "events").select(k.alias("line_no"), value.alias("value"))


NEEDED = ["k", "parsed", "quality_flags", "_meta"]


def q_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    lines = contract.parsed_lines(_json_lines(spark, sf))
    return lines.select("line_no", contract.contract_violation(NEEDED).alias("strict"), contract.contract_violation(NEEDED, strict=False).alias("permissive"))


LINES_SQL = """lines as (select event_id as line_no, event_id % 31 = 0 as broken, event_id % 7 as m, event_id % 5 as p, event_id % 23 as q from events)"""
#: Strict and permissive violation of those lines.
STRICT_SQL = "case when broken then 'bad_json' when m = 0 then 'missing:_meta' when m = 1 then 'type:_meta' when p = 2 and q not in (3, 4, 5, 6) then 'type:parsed' when m in (2, 3, 4) then 'meta:source_row_number' when q = 3 then 'type:parsed.price' when q = 4 then 'type:parsed.qty' when q = 5 then null when q = 6 then 'type:parsed.price' when p = 0 then 'type:parsed.price' end"
PERMISSIVE_SQL = "case when broken then 'bad_json' when m = 0 then 'missing:_meta' when m = 1 then 'type:_meta' when p = 2 and q not in (3, 4, 5, 6) then 'type:parsed' end"


def _with_qty(spark: SparkSession, sf: str) -> DataFrame:
    """Typed lines with all fates but bad ones: quantities are null, negative, zero and positive."""
    return typed(spark, sf).filter(~F.col("fate").startswith("bad:")).select("row_no", "wh_pos", "sku", "price", "qty")


def q_curated_kept(spark: SparkSession, sf: str) -> DataFrame:
    return _with_qty(spark, sf).filter(contract.eligible(F.col("qty")))


def q_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _with_qty(spark, sf).filter(~contract.eligible(F.col("qty"))).groupBy(contract.drop_reason(F.col("qty")).alias("drop_reason")).agg(F.count("*").alias("n"))


def q_drop_samples(spark: SparkSession, sf: str) -> DataFrame:
    return contract.first_dropped(_with_qty(spark, sf), ["row_no", "wh_pos"], 50).select("row_no", "wh_pos", "qty", "drop_reason")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Items over PL's lines: supplier and warehouse from the keys, some names empty, null or unmapped, flags null at times."""
    k, pos = F.col("row_no"), F.col("wh_pos")
    name = F.when(k % 10 == 0, "").when(k % 10 == 1, F.lit(None)).when(k % 10 == 2, "nowhere").otherwise(F.concat(F.lit("n"), ((k + pos) % 25).cast("string")))
    found = F.when(k % 6 == 0, F.lit(None).cast("array<string>")).when(k % 6 == 1, F.array(F.lit("x"), F.lit(offers.BLOCKED))).otherwise(F.array(F.lit("x")))
    raw = F.struct(name.alias("supplier_warehouse_name"), F.when(k % 4 == 0, F.concat(F.lit("wh"), (k % 25).cast("string"))).otherwise("none").alias("warehouse_key"), F.when(k % 13 != 0, F.concat(F.lit("P"), (k % 50).cast("string"))).alias("sku_candidate_key"),
                   F.when(k % 17 == 0, "").otherwise(F.concat((k % 900).cast("string"), F.lit(".50"))).alias("price"), F.when(k % 11 == 0, "").otherwise((k % 40).cast("string")).alias("qty"), F.when(k % 3 == 0, "USD").alias("currency"))
    lines = emit.explode_warehouses(price_list(spark, sf))
    return lines.select(F.concat(k.cast("string"), F.lit("-"), pos.cast("string")).alias("id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("supplier_id"), raw.alias("raw"), found.alias("quality_flags"))


def aliases(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    own = _read(spark, sf, "nation").filter(n % 5 != 4).select(F.explode(F.array(F.lit("s0"), F.lit("s1"))).alias("supplier_id"), F.concat(F.lit("n"), n.cast("string")).alias("supplier_warehouse_name"), F.concat(F.lit("wh"), n.cast("string")).alias("warehouse_key"))
    return own.unionByName(spark.createDataFrame([("s0", "__default__", "wh0")], "supplier_id string, supplier_warehouse_name string, warehouse_key string"))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "nation").select(F.concat(F.lit("wh"), F.col("n_nationkey").cast("string")).alias("warehouse_key"))


ITEMS_SQL = f"""{PL_SQL},
items as (select k || '-' || pos as id, 's' || (k % 3) as supplier_id, case k % 10 when 0 then '' when 1 then null when 2 then 'nowhere' else 'n' || ((k + pos) % 25) end as wname, case when k % 4 = 0 then 'wh' || (k % 25) else 'none' end as own_key,
    case when k % 13 <> 0 then 'P' || (k % 50) end as sku, case when k % 17 = 0 then '' else (k % 900) || '.50' end as price, case when k % 11 = 0 then '' else (k % 40)::varchar end as qty, case when k % 3 = 0 then 'USD' end as currency,
    case k % 6 when 0 then null when 1 then ['x', '{offers.BLOCKED}'] else ['x'] end as flags from pl),
aliases as (select s.supplier_id, 'n' || n_nationkey as name, 'wh' || n_nationkey as warehouse_key from nation, (select unnest(['s0', 's1']) as supplier_id) s where n_nationkey % 5 <> 4 union all select 's0', '__default__', 'wh0')"""
OFFER_SQL = f"""select sha256('{ARTIFACT}|' || id || '|' || warehouse_key) as offer_id, id as canonical_item_id, supplier_id, warehouse_key, coalesce(sku, 'unknown_sku') as sku_candidate_key, nullif(price, '')::decimal(38,6) as price, nullif(qty, '')::int as qty,
    coalesce(currency, 'RUB') as currency, array_to_string(coalesce(flags, []), ',') as flags"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("offer_id", "canonical_item_id", "supplier_id", "warehouse_key", "sku_candidate_key", "price", "qty", "currency", F.array_join("quality_flags", ",").alias("flags"))


def q_offers_inner_alias(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(offers.offers_inner(items(spark, sf), aliases(spark, sf), ARTIFACT))


def q_offers_fallback_alias(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(offers.offers_fallback(items(spark, sf), aliases(spark, sf), keys(spark, sf), ARTIFACT))


def q_unreviewed_alias(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(offers.offers_inner(items(spark, sf), aliases(spark, sf), ARTIFACT, unreviewed=True)).select("canonical_item_id", "warehouse_key")


def q_unmapped_items(spark: SparkSession, sf: str) -> DataFrame:
    return offers.unmapped(items(spark, sf), aliases(spark, sf)).select("id", "supplier_id")


def q_offers_count(spark: SparkSession, sf: str) -> DataFrame:
    return offers.offers_inner(items(spark, sf), aliases(spark, sf), ARTIFACT).groupBy("artifact_id", "warehouse_key").agg(F.count("*").alias("n"))


def q_offers_by_sku(spark: SparkSession, sf: str) -> DataFrame:
    found = items(spark, sf).select(F.lit(ARTIFACT).alias("artifact_id"), F.col("id").alias("offer_id"), "supplier_id", F.lit("w").alias("warehouse_key"), F.col("raw.sku_candidate_key").alias("sku_candidate_key"), F.col("raw.price").alias("price"), F.col("raw.qty").alias("qty"), F.lit("RUB").alias("currency"), "quality_flags")
    return offers.offers_by_sku(found, ARTIFACT, "P7").select("offer_id", "supplier_id", "price", "qty")


def q_live_items(spark: SparkSession, sf: str) -> DataFrame:
    return offers.live(items(spark, sf)).select("id", "supplier_id")


def _pointers(spark: SparkSession, sf: str) -> DataFrame:
    log = _read(spark, sf, "events").select("event_type", F.col("event_id").cast("string").alias("artifact_id"), F.col("ts").alias("valid_from"), "event_id")
    return offers.pointer_intervals(log, ["event_type"], "valid_from", "event_id")


AT = "2024-01-15 00:00:00"
POINTERS_SQL = "pointers as (select event_type, event_id, event_id::varchar as artifact_id, ts as valid_from, lead(ts) over (partition by event_type order by ts, event_id) as valid_to from events)"


def q_pointer_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return _pointers(spark, sf).select("event_type", "artifact_id", "valid_from", "valid_to")


def q_pointer_asof(spark: SparkSession, sf: str) -> DataFrame:
    return offers.current_pointers(_pointers(spark, sf), AT, ["event_type"])


def q_pointer_probes(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join of many probes: each order's date against the pointer log of one event type."""
    probes = _read(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, ["click", "view", "error"])), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("event_type"), (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(mins=(F.col("o_orderkey") % 60000).cast("int"))).alias("at"))
    return offers.pointers_as_of(probes, _pointers(spark, sf).drop("event_id"), ["event_type"], "at").select("o_orderkey", "event_type", "at", "artifact_id")


def _open_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers that overlap: open ones, and others that end after minutes or weeks."""
    k = F.col("event_id")
    end = F.when(k % 97 == 0, F.lit(None).cast("timestamp")).when(k % 5 == 0, F.col("valid_from") + F.expr("interval 21 days")).otherwise(F.col("valid_from") + F.expr("interval 7 minutes"))
    return _read(spark, sf, "events").filter("event_id % 3 = 0").select("event_type", k.cast("string").alias("artifact_id"), F.col("ts").alias("valid_from"), "event_id").withColumn("valid_to", end)


def q_pointer_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join against intervals that overlap: behind an ended pointer the latest of those still open is in force."""
    probes = _read(spark, sf, "orders").filter("o_orderkey % 5 = 0").select("o_orderkey", F.element_at(F.array(*map(F.lit, ["click", "view", "error"])), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("event_type"), (F.to_timestamp(F.lit("2023-12-31")) + F.make_dt_interval(mins=(F.col("o_orderkey") % 60000).cast("int"))).alias("at"))
    return offers.pointers_as_of(probes, _open_pointers(spark, sf).drop("event_id"), ["event_type"], "at").select("o_orderkey", "at", "artifact_id")


def q_current_counts(spark: SparkSession, sf: str) -> DataFrame:
    return offers.current_counts(_pointers(spark, sf), AT, ["event_type"])


def q_latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    sealed = _read(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderdate", "o_orderkey")
    return offers.latest_per_key(sealed, ["o_custkey"], "o_orderdate", "o_orderkey")


def q_artifact_dups(spark: SparkSession, sf: str) -> DataFrame:
    return offers.duplicates(_read(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


def q_fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    half = _read(spark, sf, "supplier").filter(F.col("s_suppkey") % 2 == 0)
    return offers.orphans(_read(spark, sf, "lineitem"), "l_suppkey", half, "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


def q_accept_once(spark: SparkSession, sf: str) -> DataFrame:
    runs = _read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), "o_orderkey")
    return reports.accepted_only_once(runs, _read(spark, sf, "customer").filter(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").cast("string").alias("run_id")))


RULES = [("r1", "with_the", None, ["the"], []), ("r2", "german", None, ["der"], ["die"]), ("r3", "french", 4, ["de"], []), ("r4", "with_that", 4, ["that", "the"], [])]


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    """Two header rows of each document; its first 200 characters stand in for their cells."""
    cells = F.split(F.substring("text", 1, 200), " ")
    return _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), (F.col("doc_id") % 5).cast("int").alias("cols"), F.slice(cells, 1, 8).alias("row1"), F.slice(cells, 9, 8).alias("row2"))


def q_layout_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, layout string, cols int, row1_tokens array<string>, row2_tokens array<string>")
    return dispatch.match_rules(_heads(spark, sf), rules).select("file", F.array_join("layouts", ",").alias("layouts"), "status")


SPACES = "[\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _norm_sql(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace({c}, '{SPACES}+', ' ', 'g'), '^ | $', '', 'g'))"


HEADS_SQL = f"""heads0 as (select doc_id::varchar as file, (doc_id % 5)::int as cols, string_split(substr(text, 1, 200), ' ') as cells from documents),
heads as (select file, cols, list_transform(cells[1:8], lambda c: {_norm_sql("c")}) as row1, list_transform(cells[9:16], lambda c: {_norm_sql("c")}) as row2 from heads0)"""


def q_signature_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf).select("file", F.array_join(signature_tokens(F.col("row1")), "#").alias("tokens"))


def q_required_missing(spark: SparkSession, sf: str) -> DataFrame:
    missing = dispatch.missing_columns(F.transform("row1", norm_header), ["the", "of", "de", "der"])
    return _heads(spark, sf).select("file", F.array_join(missing, ",").alias("missing"))


def q_layout_of_name(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [("ring", "rings"), ("bolt", "bolts"), ("widget", "widgets")]
    return _read(spark, sf, "part").select("p_partkey", dispatch.layout_of_name(F.col("p_name"), pairs, "other").alias("layout"))


def q_header_score(spark: SparkSession, sf: str) -> DataFrame:
    return _heads(spark, sf).select("file", dispatch.header_score(F.col("row1"), ["the", "de", "und"]).alias("score"))


def _dumps(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object per user: an array of its values, an object, a scalar."""
    e = _read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return e.select("user_id", F.to_json(F.struct(F.col("ids").alias("list"), F.struct(F.lit(1).alias("a")).alias("object"), F.col("user_id").alias("scalar"), F.slice("ids", 1, 2).alias("pair"))).alias("value"))


def q_json_array_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.json_summary(_dumps(spark, sf))


def q_json_array_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return reports.array_lengths(_dumps(spark, sf)).groupBy("key").agg(F.sum("items").alias("items"), F.count("*").alias("n"))


def q_norm_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    turns = _read(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return docs.unionByName(turns).select("id", norm_ws(F.col("text")).alias("text"))


def q_norm_sku_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    """The first 40 characters stand in for a SKU cell."""
    return _read(spark, sf, "documents").select("doc_id", normalize_sku(F.substring("text", 1, 40)).alias("sku"))


def q_sanitize_tag(spark: SparkSession, sf: str) -> DataFrame:
    """The first 60 characters stand in for a tag cell."""
    return _read(spark, sf, "documents").select("doc_id", sanitize_tag(F.substring("text", 1, 60)).alias("tag"))


def q_sha_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    return _read(spark, sf, "part").select("p_partkey", hashing.fallback_sku(F.lit(""), F.lit(None), F.col("p_brand"), F.col("p_name"))["value"].alias("sku"), hashing.fingerprint(k, F.col("p_brand")).alias("fingerprint"), hashing.core_key(F.col("p_brand"), k).alias("core"))


def q_effective_month(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+03:00").otherwise("Z"))
    return _read(spark, sf, "events").select("event_id", hashing.effective_month(shown).alias("month"))


def q_sanity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 2).alias("qty"), (F.col("l_extendedprice") - 5000).alias("price"))
    return contract.sanity_violations(rows, ["l_orderkey", "l_linenumber"])


def q_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return contract.completeness(typed(spark, sf), F.col("price"), F.col("qty"))


def q_field_coverage(spark: SparkSession, sf: str) -> DataFrame:
    lines = typed(spark, sf)
    return reports.field_coverage(lines, {"article": F.col("sku") != "", "price": F.col("price").isNotNull(), "qty": F.col("qty").isNotNull()})


def q_extraction_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = price_list(spark, sf)
    return reports.extraction_report(rows.select("row_no", (F.trim("article_primary") == "").alias("rejected"), F.transform("warehouses", lambda w: numeric.as_number(w["qty_raw"])).alias("qty_values")))


def q_normalize_value(spark: SparkSession, sf: str) -> DataFrame:
    lines = emit.explode_warehouses(price_list(spark, sf))
    return lines.select("row_no", "wh_pos", numeric.normalize_value(F.col("qty_raw"), "qty").alias("qty"), numeric.normalize_value(F.col("price_raw"), "price").alias("price"))


def q_union_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    a = emit.good_lines(typed(spark, sf)).select(F.lit("a").alias("supplier_id"), "row_no", "wh_pos", "sku", F.col("qty").cast("string").alias("qty"))
    b = emit.emit_strings(price_list(spark, sf)).filter("fate = 'emit'").select(F.lit("b").alias("supplier_id"), "row_no", "wh_pos", "sku", "qty")
    return reports.union_contracts(a, b)


def q_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels of claims about parts: brand and size, differing on purpose."""
    p = _read(spark, sf, "part")
    one = p.filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("item_id"), F.lit("brand").alias("field"), F.col("p_brand").alias("value"))
    two = p.filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("item_id"), F.lit("brand").alias("field"), F.when(F.col("p_partkey") % 3 == 0, "Brand#0").otherwise(F.col("p_brand")).alias("value"))
    return reports.audited(reports.conflicts(one, two), "r1").select("item_id", "field", "l1_value", "l2_value", "conflict_type", "signature_core")


def q_signature_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").select(F.col("event_type").alias("signature_core"), F.col("ts").alias("seen_at"), F.col("user_id").alias("supplier_id"))
    return reports.signature_rollup(e).withColumn("affected_suppliers", F.array_join("affected_suppliers", ","))


def q_reviewed_key(spark: SparkSession, sf: str) -> DataFrame:
    n = _read(spark, sf, "nation")
    return n.select("n_nationkey", unreviewed_alias(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("wh"), F.col("n_nationkey").cast("string"))), F.col("n_name")).alias("warehouse_key"))


def queries() -> dict[str, Query]:
    from tarifold.plans import catalog_io

    return {name: f for names in (globals(), vars(catalog_io)) for name, f in names.items() if name.startswith("q_")}


_MAPPED = f"with {ITEMS_SQL}, named as (select *, coalesce(nullif(wname, ''), '__default__') as lookup from items)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query but q_norm_sku_nfkc, whose normal form DuckDB lacks."""
    from tarifold.plans import catalog_io

    return _oracle_sql() | catalog_io.oracle_sql()


def _oracle_sql() -> dict[str, str]:
    return {
        "q_explode_warehouses": f"with {PL_SQL} select k as row_no, pos as wh_pos, wh as warehouse, qty_raw, price_raw from pl",
        "q_emit_good": f"with {TYPED_SQL} select k as row_no, pos as wh_pos, wh as warehouse, sku, price, qty, array_to_string(flags, ',') as flags from typed where fate = 'good'",
        "q_emit_bad": f"with {TYPED_SQL} select k as row_no, pos as wh_pos, sku, price_raw, qty_raw, substr(fate, 5) as reason_code from typed where fate like 'bad:%'",
        "q_emit_stats": f"with {TYPED_SQL}, {STATS_SQL} select * from stats",
        "q_flags_counts": f"with {TYPED_SQL} select flag, count(*) as n from (select unnest(flags) as flag from typed where fate = 'good') group by flag",
        "q_bad_reasons": f"with {TYPED_SQL} select substr(fate, 5) as reason, count(*) as n from typed where fate like 'bad:%' group by 1",
        "q_emit_strings": f"with {STRINGS_SQL} select row_no, wh_pos, warehouse, sku, price, qty, array_to_string(flags, ',') as flags, fate from strings",
        "q_string_stats": f"with {STRINGS_SQL} select count(*) filter (fate = 'emit') as lines, count(*) filter (fate = 'qty_invalid') as bad_qty, count(*) filter (fate = 'qty_empty') as skipped_qty_empty, count(*) filter (fate = 'qty_zero') as skipped_qty_zero, count(*) filter (fate = 'qty_invalid') as skipped_qty_invalid, count(*) filter (wh_pos = 1 and price = '') as bad_price, count(*) filter (wh_pos = 1 and list_contains(flags, 'missing_sku')) as missing_sku from strings",
        "q_string_flags": f"with {STRINGS_SQL} select flag, count(*) as n from (select unnest(flags) as flag from strings where fate = 'emit') group by flag",
        "q_emit_headed": f"with {HEADED_SQL} select * from headed",
        "q_headed_stats": f"with {HEADED_SQL} select count(*) filter (fate <> 'no_id') as rows_seen, count(*) filter (fate = 'emit') as rows_emitted, count(*) filter (fate = 'bad_price') as bad_price, count(*) filter (fate = 'bad_qty') as bad_qty from headed",
        "q_emit_json_category": f"with {CATEGORY_SQL} select row_no, wh_pos, id, qty, price, fate from category",
        "q_json_category_stats": f"with {CATEGORY_SQL} select count(*) as seen_items, count(*) filter (fate = 'emit') as emitted_items, count(*) filter (fate = 'no_id') as skipped_no_id, count(*) filter (fate in ('bad_qty', 'qty_empty')) as skipped_qty_empty, count(*) filter (fate = 'emit' and price is null) as bad_price, count(*) filter (fate = 'bad_qty') as bad_qty from category",
        "q_emit_sheet": f"with {SHEET_SQL} select row_no, wh_pos, sku, price, qty, array_to_string(flags, ',') as flags, case when sku = '' then 'missing_sku' when price is null then 'bad_price' else stock_fate end as fate from sheet",
        "q_sheet_fates": f"with {SHEET_SQL} select case when sku = '' then 'missing_sku' when price_raw in ('0', '0.0', '0,0') then 'price_zero' when price is null then 'price_missing' else stock_fate end as fate, count(*) as n from sheet group by 1",
        "q_diag_explode_default": f"with {STOCKED_SQL} select * from stocked",
        "q_diag_stats": f"with {STOCKED_SQL} select (select count(*) from part) as rows_total_seen, (select count(*) from d0 where pos = 1 and {FLOAT_SQL.format('price_raw')} > 0) as rows_with_price_gt_0, (select count(distinct row_no) from d0 where qty > 0) as rows_with_any_qty_gt_0, count(*) as rows_emitted, count(*) filter (qty <= 0) as emitted_no_qty from stocked",
        "q_diag_single": f"with {STOCKED_SQL} select row_no, warehouse, greatest(qty, 0) as qty, case when qty > 0 then '' else 'no_qty' end as flags from d0 where pos = 1",
        "q_first_stocked": f"with {STOCKED_SQL} select row_no, warehouse, qty from stocked where qty > 0 order by row_no, warehouse limit 5",
        "q_gate_reasons": f"""with {TYPED_SQL}, {STATS_SQL}, actuals as (unpivot (select source_rows_read::varchar as source_rows_read, exploded_lines::varchar as exploded_lines, good_rows::varchar as good_rows, bad_rows::varchar as bad_rows, skipped_rows_all_empty::varchar as skipped_rows_all_empty, skipped_lines::varchar as skipped_lines from stats) on * into name metric value actual),
            baseline(metric, expected, tolerance, is_text) as (values {", ".join(f"('{m}', '{e}', {t}, {str(x).lower()})" for m, e, t, x in BASELINE)}), j as (select b.*, actual, case when actual is null then 'metric_missing' when case when is_text then actual <> expected else abs(actual::bigint - expected::bigint) > tolerance end then 'metric_out_of_tolerance' end as code from baseline b left join actuals using (metric))
            select metric, expected, actual, 'WARN' as level, code from j where code is not null""",
        "q_gate_verdict": "select (o_custkey % 97)::varchar as run_id, case when not (sum(o_orderkey % 13) > 0) or max(o_custkey) % 5 = 0 or count(*) filter (o_orderstatus <> 'P') = 0 then 'FAIL' when count(*) filter (o_orderstatus = 'P' and o_custkey % 3 = 0) > 0 or count(*) filter (o_totalprice < 1000) > 0 then 'WARN' else 'PASS' end as verdict from orders group by 1",
        "q_contract_violations": f"with {LINES_SQL} select line_no, {STRICT_SQL} as strict, {PERMISSIVE_SQL} as permissive from lines",
        "q_curated_kept": f"with {TYPED_SQL} select k as row_no, pos as wh_pos, sku, price, qty from typed where fate in ('good', 'skip') and qty > 0",
        "q_drop_reasons": f"with {TYPED_SQL} select case when qty is null then 'qty_missing' else 'qty_nonpositive' end as drop_reason, count(*) as n from typed where fate = 'skip' group by 1",
        "q_drop_samples": f"with {TYPED_SQL} select k as row_no, pos as wh_pos, qty, case when qty is null then 'qty_missing' else 'qty_nonpositive' end as drop_reason from typed where fate = 'skip' order by k, pos limit 50",
        "q_offers_inner_alias": f"{_MAPPED} {OFFER_SQL} from named join aliases using (supplier_id) where lookup = name",
        "q_offers_fallback_alias": f"""with {ITEMS_SQL}, found as (select i.* exclude (price, qty), i.price, i.qty, coalesce(a.warehouse_key, n.key) as warehouse_key from items i left join aliases a on a.supplier_id = i.supplier_id and a.name = i.wname left join (select 'wh' || n_nationkey as key from nation) n on n.key = i.own_key) {OFFER_SQL} from found where warehouse_key is not null""",
        "q_unreviewed_alias": f"{_MAPPED} select id as canonical_item_id, coalesce(warehouse_key, '__unreviewed__:' || coalesce(wname, '')) as warehouse_key from named i left join aliases a on a.supplier_id = i.supplier_id and a.name = i.lookup",
        "q_unmapped_items": f"{_MAPPED} select id, supplier_id from named n where not exists (select 1 from aliases a where a.supplier_id = n.supplier_id and a.name = n.lookup)",
        "q_offers_count": f"{_MAPPED} select '{ARTIFACT}' as artifact_id, warehouse_key, count(*) as n from named join aliases using (supplier_id) where lookup = name group by warehouse_key",
        "q_offers_by_sku": f"with {ITEMS_SQL} select id as offer_id, supplier_id, price, qty from items where sku = 'P7' and not list_contains(flags, '{offers.BLOCKED}')",
        "q_live_items": f"with {ITEMS_SQL} select id, supplier_id from items where flags is null or not list_contains(flags, '{offers.BLOCKED}')",
        "q_pointer_intervals": f"with {POINTERS_SQL} select event_type, artifact_id, valid_from, valid_to from pointers",
        "q_pointer_asof": f"with {POINTERS_SQL} select event_type, artifact_id, valid_from from pointers where valid_from <= timestamp '{AT}' and (valid_to is null or valid_to > timestamp '{AT}') qualify row_number() over (partition by event_type order by valid_from desc, artifact_id desc) = 1",
        "q_pointer_probes": f"""with {POINTERS_SQL}, probes as (select o_orderkey, ['click', 'view', 'error'][o_orderkey % 3 + 1] as event_type, timestamp '2024-01-01' + to_minutes(o_orderkey % 60000) as at_ from orders)
            select o_orderkey, p.event_type, at_ as "at", artifact_id from probes p left join pointers q on p.event_type = q.event_type and q.valid_from <= at_ and (q.valid_to is null or q.valid_to > at_)""",
        "q_pointer_overlaps": """with pointers as (select event_type, event_id::varchar as artifact_id, ts as valid_from, case when event_id % 97 = 0 then null when event_id % 5 = 0 then ts + interval 21 days else ts + interval 7 minutes end as valid_to from events where event_id % 3 = 0),
            probes as (select o_orderkey, ['click', 'view', 'error'][o_orderkey % 3 + 1] as event_type, timestamp '2023-12-31' + to_minutes(o_orderkey % 60000) as at_ from orders where o_orderkey % 5 = 0)
            select p.o_orderkey, p.at_ as "at", arg_max(artifact_id, (valid_from, artifact_id)) as artifact_id from probes p left join pointers q on p.event_type = q.event_type and q.valid_from <= at_ and (q.valid_to is null or q.valid_to > at_) group by 1, 2""",
        "q_current_counts": f"with {POINTERS_SQL} select event_type, n, n = 1 as exactly_one from (select event_type, count(*) filter (valid_from <= timestamp '{AT}' and (valid_to is null or valid_to > timestamp '{AT}')) as n from pointers group by 1)",
        "q_latest_snapshot": "select o_custkey, o_orderdate, o_orderkey from orders where o_orderstatus = 'F' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
        "q_artifact_dups": "select count(*) - (select count(*) from (select distinct l_orderkey, l_suppkey from lineitem)) as duplicates from lineitem",
        "q_fk_orphans": "select l_orderkey, l_linenumber, l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 2 = 0)",
        "q_accept_once": "select o_custkey::varchar as run_id, o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0)",
        "q_layout_dispatch": f"""with {HEADS_SQL}, h as (select file, cols, array_to_string(list_filter(row1, lambda x: x <> ''), ' | ') as h1, array_to_string(list_filter(row2, lambda x: x <> ''), ' | ') as h2 from heads),
            f as (select file, list_sort(list_filter([case when contains(h1, 'the') then 'with_the' end, case when contains(h1, 'der') and contains(h2, 'die') then 'german' end, case when cols = 4 and contains(h1, 'de') then 'french' end, case when cols = 4 and contains(h1, 'that') and contains(h1, 'the') then 'with_that' end], lambda x: x is not null)) as l from h)
            select file, array_to_string(l, ',') as layouts, case when len(l) = 1 then 'OK' else 'PROBLEM' end as status from f""",
        "q_signature_tokens": f"""with {HEADS_SQL}, u as (select file, unnest(row1) as t, generate_subscripts(row1, 1) as i from heads), f as (select file, t, min(i) as i from u where t <> '' group by file, t)
            select h.file, coalesce(string_agg(t, '#' order by i), '') as tokens from heads h left join f using (file) group by h.file""",
        "q_required_missing": f"with {HEADS_SQL} select file, array_to_string(list_filter(['the', 'of', 'de', 'der'], lambda x: not list_contains(row1, x)), ',') as missing from heads",
        "q_layout_of_name": "select p_partkey, case when contains(lower(p_name), 'ring') then 'rings' when contains(lower(p_name), 'bolt') then 'bolts' when contains(lower(p_name), 'widget') then 'widgets' else 'other' end as layout from part",
        "q_header_score": f"""with {HEADS_SQL}, c as (select file, cells[1:8] as cells from heads0), s as (select file, lower(array_to_string(list_filter(cells, lambda x: trim(x) <> ''), ' ')) as low, len(list_filter(cells, lambda x: {_norm_sql("x")} <> '')) as filled, len(list_filter(cells, lambda x: regexp_matches({_norm_sql("x")}, '^-?[0-9]+(?:[,.][0-9]+)?$'))) as numbers from c)
            select file, (case when filled > 0 then filled * 10 + 15 * (contains(low, 'the')::int + contains(low, 'de')::int + contains(low, 'und')::int) - numbers * 4 end)::int as score from s""",
        "q_json_array_stats": "with u as (select user_id, count(*) as n from events group by user_id) select count(*) * 4 as keys, count(*) * 2 as arrays, count(*) as objects, count(*) as values, sum(n + least(n, 2))::bigint as items, (sum(n + least(n, 2)) // (count(*) * 2))::bigint as average from u",
        "q_json_array_lengths": "with u as (select user_id, count(*) as n from events group by user_id) select 'list' as key, sum(n)::bigint as items, count(*) as n from u union all select 'pair', sum(least(n, 2))::bigint, count(*) from u",
        "q_norm_text": f"""select 'd' || doc_id as id, regexp_replace(regexp_replace(text, '{SPACES}+', ' ', 'g'), '^ | $', '', 'g') as text from documents union all select 'c' || conv_id || '-' || turn, regexp_replace(regexp_replace(text, '{SPACES}+', ' ', 'g'), '^ | $', '', 'g') from conversations""",
        "q_sanitize_tag": f"select doc_id, regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 60), '^{SPACES}+|{SPACES}+$', '', 'g'), '[ \\\\/()]', '_', 'g'), '[^-._0-9a-zA-Zа-яА-Я]+', '_', 'g') as tag from documents",
        "q_sha_keys": "select p_partkey, 'unknown_sku_' || substr(sha1(p_brand || '|' || p_name), 1, 12) as sku, sha256(p_partkey || '|' || p_brand) as fingerprint, substr(sha256(p_brand || ':' || p_partkey), 1, 16) as core from part",
        "q_effective_month": "select event_id, strftime(date_trunc('second', ts) - case when event_id % 2 = 0 then interval 3 hour else interval 0 hour end, '%Y-%m') as month from events",
        "q_sanity": "select l_orderkey, l_linenumber, 'SC001' as check_id, 'negative_quantity' as error_code from lineitem where l_quantity - 2 < 0 union all select l_orderkey, l_linenumber, 'SC002', 'negative_price' from lineitem where l_extendedprice - 5000 < 0",
        "q_completeness": f"with {TYPED_SQL} select 'has_price' as gate, 'HARD' as level, coalesce(bool_or(price > 0), false) as passed from typed union all select 'has_qty', 'HARD', coalesce(bool_or(qty > 0), false) from typed",
        "q_field_coverage": f"with {TYPED_SQL} select 'article' as field, count(*) filter (sku <> '') as filled, count(*) as total from typed union all select 'price', count(price), count(*) from typed union all select 'qty', count(qty), count(*) from typed",
        "q_extraction_report": f"""with {PL_SQL}, r as (select k, any_value(trim(a1) = '') as rejected, count({FLOAT_SQL.format("qty_raw")}) as n from pl group by k), s as (select count(*) as total, count(*) filter (rejected) as rejected, count(*) filter (not rejected and n > 0) as withq, coalesce(sum(n) filter (not rejected and n > 0), 0)::bigint as canonical from r)
            select total as total_input_rows, rejected as rejected_input_rows, withq as rows_with_qty, canonical as canonical_rows, total - rejected as accepted_input_rows, total - rejected - withq as skipped_no_qty_rows, canonical - withq as exploded_rows_count from s""",
        "q_normalize_value": f"with {PL_SQL} select k as row_no, pos as wh_pos, coalesce({FLOAT_SQL.format('qty_raw')}, nullif(regexp_extract(qty_raw, '^>=?([0-9.]+)$', 1), '')::double) as qty, {FLOAT_SQL.format('price_raw')} as price from pl",
        "q_union_suppliers": f"with {TYPED_SQL}, {STRINGS_SQL.removeprefix(PL_SQL + ',')} select 'a' as supplier_id, k as row_no, pos as wh_pos, sku, qty::varchar as qty from typed where fate = 'good' union all select 'b', row_no, wh_pos, sku, qty from strings where fate = 'emit'",
        "q_conflicts": """with a as (select p_partkey as item_id, p_brand as v from part where p_partkey % 5 <> 0), b as (select p_partkey as item_id, case when p_partkey % 3 = 0 then 'Brand#0' else p_brand end as v from part where p_partkey % 7 <> 0),
            j as (select coalesce(a.item_id, b.item_id) as item_id, a.v as l1_value, b.v as l2_value, case when a.v is null then 'l1_missing' when b.v is null then 'l2_missing' when a.v <> b.v then 'mismatch' end as conflict_type from a full join b on a.item_id = b.item_id)
            select item_id, 'brand' as field, l1_value, l2_value, conflict_type, substr(sha256('brand:r1:' || coalesce(l1_value, '') || ':' || coalesce(l2_value, '') || ':' || conflict_type || ':'), 1, 16) as signature_core from j where conflict_type is not null""",
        "q_signature_rollup": "select event_type as signature_core, min(ts) as first_seen, max(ts) as last_seen, count(*) as total_count, count(distinct user_id) as suppliers, array_to_string(list_sort(list(distinct user_id)), ',') as affected_suppliers from events group by 1",
        "q_reviewed_key": "select n_nationkey, case when n_nationkey % 2 = 0 then 'wh' || n_nationkey else '__unreviewed__:' || n_name end as warehouse_key from nation",
    }
