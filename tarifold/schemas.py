"""Row shapes of the line contracts and tables, as DDL."""

GRID = "source_file string, sheet string, row_no int, cells array<string>"

#: String contract: price and quantity as text.
STRING_LINE = (
    "supplier_id string, parser_id string, parser_version string, run_id string, quality_flags array<string>, "
    "raw struct<supplier_warehouse_name:string,sku_candidate_key:string,price:string,qty:string,currency:string,supplier_article:string,supplier_code_1c:string,brand_raw:string,name_raw:string>, "
    "_meta struct<source_row_1based:int,passthrough:struct<supplier_warehouse_name_raw:string>>"
)
#: Typed contract: price in minor units and quantity as whole numbers.
TYPED_LINE = (
    "ndjson_contract_version string, emitter_version string, supplier_id string, parser_id string, mapping_version string, mapping_hash string, run_id string, effective_at string, sku_candidate_key string, "
    "raw struct<supplier_article:string,brand_raw:string,name_raw:string,price_raw:string,qty_raw:string,supplier_warehouse_name:string>, parsed struct<price:bigint,qty:bigint>, quality_flags array<string>, _meta struct<source_row_number:int>"
)
#: Item contract of header-addressed sheets and of JSON categories.
ITEM_LINE = "supplier_id string, parser_id string, layout string, ts_ingested string, item struct<supplier_item_id:string,name:string,article:string,qty:bigint,price_opt:double,currency:string>, raw struct<sheet:string,warehouse:string>"
CATEGORY_LINE = "supplier_id string, parser_id string, layout string, ts_ingested string, item struct<supplier_item_id:string,name:string,brand:string,model:string,article:string,qty:bigint,price_opt:double,price_roznica:double,image:string>, raw struct<category_key:string>"
#: String contract of positional sheets, without the fields that those lack.
SHEET_LINE = (
    "supplier_id string, parser_id string, parser_version string, run_id string, quality_flags array<string>, raw struct<supplier_warehouse_name:string,sku_candidate_key:string,price:string,qty:string,currency:string,brand_raw:string,name_raw:string>, "
    "_meta struct<source_row_1based:int,passthrough:struct<sheet:string>>"
)

SNAPSHOTS = "snapshot_id string, parser_id string, status string, created_at timestamp, sealed_at timestamp"
ITEMS = "id string, snapshot_id string, supplier_id string, raw struct<supplier_warehouse_name:string,warehouse_key:string,sku_candidate_key:string,price:string,qty:string,currency:string>, quality_flags array<string>"
WAREHOUSE_KEYS = "warehouse_key string, display_name string, is_active boolean"
ALIASES = "supplier_id string, supplier_warehouse_name string, warehouse_key string, last_seen_at timestamp"
ARTIFACTS = "artifact_id string, snapshot_id string, curated_version string, fingerprint string, status string, generated_at timestamp, published_at timestamp, published_by string"
POINTERS = "environment string, channel string, artifact_id string, valid_from timestamp, valid_to timestamp"
OFFERS = "artifact_id string, offer_id string, canonical_item_id string, supplier_id string, warehouse_key string, sku_candidate_key string, price decimal(38,6), qty int, currency string, quality_flags array<string>"

ROW_AUDIT = "item_id string, field string, l1_value string, l2_value string, conflict_type string, signature_core string, supplier_id string, seen_at timestamp"
CANONICAL_REQUIRED = "supplier source_file source_table row_index qty_column_index raw".split()
CANONICAL_TYPES = {
    "supplier": ("string",), "source_file": ("string",), "source_table": ("string",), "row_index": ("whole",), "qty_column_index": ("whole",), "raw": ("array",),
    "article": ("string",), "name": ("string",), "brand": ("string",), "qty": ("number", "null"), "price": ("number", "null"), "warehouse": ("string",), "currency": ("string",),
}
REJECTED_REQUIRED = [*CANONICAL_REQUIRED, "error"]
REJECTED_TYPES = {k: v for k, v in CANONICAL_TYPES.items() if k in CANONICAL_REQUIRED} | {"error": ("string",)}
TYPED_REQUIRED = sorted(part.split()[0] for part in TYPED_LINE.replace("<", " ").split(", ") if " " in part)
