"""Contract checks, curated eligibility, rule tables and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.schemas import CANONICAL_REQUIRED, CANONICAL_TYPES, TYPED_LINE, TYPED_REQUIRED


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Adds doc: the JSON object in value as a VARIANT, parsed once (null where it is no object).

    A text that parses is an object if it begins with a brace; the type name of
    the whole document would take longer than the parsing.
    """
    return lines.withColumn("doc", F.when(F.ltrim("value", F.lit(" \t\r\n")).startswith("{"), F.try_parse_json("value")))


#: Kinds of a JSON value as patterns over VARIANT's type names; whole numbers beyond 64 bits are decimals of scale 0,
#: as is 1.0, but with fewer digits.
KINDS = {
    "object": "OBJECT", "array": "ARRAY", "whole": "BIGINT|DECIMAL[(](19|2[0-9]|3[0-8]),0[)]", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID",
}


def _value(path: str) -> Column:
    """The value at a path of doc; null where nothing is there (a JSON null is something)."""
    return F.try_variant_get("doc", path, "variant")


def type_at(path: str) -> Column:
    """VARIANT's type name at a path of doc; null where nothing is there."""
    return F.substring_index(F.schema_of_variant(_value(path)), "<", 1)


def _is(path: str, *kinds: str, absent: bool = False) -> Column:
    """Whether the value at a path is of one of the kinds; absent: what holds where nothing is there."""
    return F.coalesce(type_at(path).rlike("^(" + "|".join(KINDS[k] for k in kinds) + ")$"), F.lit(absent))


def contract_violation(required: list[str] = TYPED_REQUIRED, expected: dict[str, str] | None = None, strict: bool = True) -> Column:
    """First violation of a typed line, null if there is none.

    Permissive (strict=False): presence of the keys and the four container types.
    """
    out = F.when(F.col("doc").isNull(), F.lit("bad_json"))
    for key in required:
        out = out.when(_value(f"$.{key}").isNull(), F.lit(f"missing:{key}"))
    shapes = [("quality_flags", "array"), ("_meta", "object"), ("parsed", "object")] + ([] if strict else [("raw", "object")])
    for key, kind in shapes:
        if key in required:
            out = out.when(~_is(f"$.{key}", kind), F.lit(f"type:{key}"))
    if strict:
        if "_meta" in required:
            out = out.when(~_is("$._meta.source_row_number", "whole", "boolean"), F.lit("meta:source_row_number"))
        for key, value in (expected or {}).items():
            same = F.coalesce(F.try_variant_get("doc", f"$.{key}", "string") == F.lit(value), F.lit(False))
            # a version may be a number, the other values are texts
            out = out.when(~(same if key == "mapping_version" else same & _is(f"$.{key}", "string")), F.lit(f"mismatch:{key}"))
        if "parsed" in required:
            for field in ("price", "qty"):  # a boolean counts as whole
                out = out.when(~_is(f"$.parsed.{field}", "whole", "boolean", "null", absent=True), F.lit(f"type:parsed.{field}"))
    return out


def typed_rows(lines: DataFrame) -> DataFrame:
    """The columns of the typed contract beside line_no and value."""
    return lines.withColumn("row", F.from_json("value", TYPED_LINE)).select("line_no", "value", "row.*")


def eligible(qty: Column, price: Column | None = None) -> Column:
    """Curated rule: stock above zero; a price too, where it is given."""
    test = F.coalesce(qty > 0, F.lit(False))
    return test if price is None else test & F.coalesce(price > 0, F.lit(False))


#: All that drop_reason gives.
DROP_REASONS = ("qty_missing", "qty_nonpositive", "unknown")


def drop_reason(qty: Column) -> Column:
    named = F.concat_ws("_and_", F.when(qty.isNull(), "qty_missing"), F.when(qty <= 0, "qty_nonpositive"))
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("unknown"))


def first_dropped(lines: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    """The first dropped lines in file order: a bounded top-n, no full sort."""
    dropped = lines.filter(~eligible(F.col("qty"))).withColumn("drop_reason", drop_reason(F.col("qty")))
    return dropped.orderBy(*order).limit(limit)


#: Sanity rules: id, field, condition that must hold, error code.
SANITY = [("SC001", "qty", "qty >= 0", "negative_quantity"), ("SC002", "price", "price >= 0", "negative_price")]


def sanity_violations(rows: DataFrame, keys: list[str], rules: list[tuple[str, str, str, str]] = SANITY) -> DataFrame:
    """keys, check_id and error_code for each rule that a row breaks; null values break none. One scan."""
    broken = F.array_compact(F.array(*(F.when(~F.expr(test), F.struct(F.lit(i).alias("check_id"), F.lit(code).alias("error_code"))) for i, _, test, code in rules)))
    return rows.select(*keys, F.explode(broken).alias("__b")).select(*keys, "__b.*")


def require(rows: DataFrame, test: Column, message: str) -> DataFrame:
    """rows, failing the job on the first row for which test is not true."""
    checked = F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.filter(checked)


def row_error(types: dict[str, tuple[str, ...]] = CANONICAL_TYPES, required: list[str] = CANONICAL_REQUIRED, positive: tuple[str, ...] = ("row_index", "qty_column_index")) -> Column:
    """First schema error of a JSON row (value, doc): missing or extra key, wrong type, non-positive index, raw with other than texts.

    types: the kinds each allowed key may have.
    """
    out = F.when(F.col("doc").isNull(), F.lit("bad_json"))
    for key in required:
        out = out.when(_value(f"$.{key}").isNull(), F.lit(f"missing:{key}"))
    out = out.when(F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, types)))) > 0, F.lit("extra_key"))
    for key, kinds in types.items():
        out = out.when(~_is(f"$.{key}", *kinds, absent=True), F.lit(f"type:{key}"))
    for key in positive:
        out = out.when(F.coalesce(F.try_variant_get("doc", f"$.{key}", "decimal(38,0)") < 1, F.lit(False)), F.lit(f"minimum:{key}"))
    kinds = F.schema_of_variant(F.try_variant_get("doc", "$.raw", "variant"))
    return out.when(~kinds.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit("type:raw[]"))


def completeness(rows: DataFrame, price: Column, qty: Column | None) -> DataFrame:
    """Hard and soft completeness gates over a file's rows: gate, level, passed."""
    has_price = F.coalesce(F.bool_or(price > 0), F.lit(False))
    if qty is None:
        gates = [("has_price", "HARD", has_price), ("no_qty_columns", "SOFT", F.lit(False))]
    else:
        gates = [("has_price", "HARD", has_price), ("has_qty", "HARD", F.coalesce(F.bool_or(qty > 0), F.lit(False)))]
    one = rows.agg(F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(level).alias("level"), test.alias("passed")) for g, level, test in gates)).alias("g"))
    return one.select(F.explode("g").alias("g")).select("g.*")
