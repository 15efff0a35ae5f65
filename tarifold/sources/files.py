"""Text sources: NDJSON with line numbers, JSON dumps, inbox folders, CSV and XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarifold.functions.text import strip


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (1-based, blank lines count) and value of every non-blank line.

    Files are split: a line's number is its place in its block of the file plus
    the lines of the blocks before, which one aggregate, a row a block, counts.
    The ids that Spark gives the rows of a scan rise by one from line to line
    within a block, and both scans plan the same blocks.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__n"), "value")
    blocks = lines.groupBy("file", "__block").agg(F.count("*").alias("__lines"), F.min("__n").alias("__first"))
    before = F.coalesce(F.sum("__lines").over(Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = blocks.select("file", "__block", (before - F.col("__first") + 1).alias("__shift"))
    value = F.regexp_replace("value", "\r$", "")
    return lines.join(places, ["file", "__block"]).select("file", (F.col("__n") + F.col("__shift")).alias("line_no"), value.alias("value")).filter(F.col("value") != "")


def read_ndjson(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Permissive: rows that don't parse have all nulls but _corrupt_record."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json("value", shape.add("_corrupt_record", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).filter(F.col("value") != "").select(parsed.alias("r")).select("r.*")


def json_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null of a JSON text; null where it doesn't parse."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")


def json_categories(texts: DataFrame, column: str = "value") -> DataFrame:
    """key and its JSON value for each top-level key of each JSON object."""
    entries = F.from_json(F.col(column), "map<string,string>")
    return texts.select(F.explode(F.map_entries(entries)).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("value"))


ITEM = "id string, name string, marka string, model string, article string, stock string, price_minimum string, price_roznica string, image string, img_url string"


class DumpError(ValueError):
    def __init__(self, message: str, code: int):
        super().__init__(message)
        self.code = code


def read_json_category(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Elements of one top-level array of a JSON dump: pos, is_object, the item's fields as text and id_kind, the JSON type of its id."""
    if not layout.startswith("category:"):
        raise DumpError(f"layout must be category:<key>, not {layout}", 2)
    key = layout.split(":", 1)[1]
    whole = spark.read.text(path, wholetext=True)
    state = whole.select(json_kind(F.col("value")).alias("top"), F.from_json("value", "map<string,string>")[key].alias("part")).select("top", json_kind(F.col("part")).alias("kind")).first()
    if state is None or state["top"] != "object":
        raise DumpError("the top level is not an object", 3)
    if state["kind"] != "array":
        raise DumpError(f"{key} is not an array", 4)
    part = F.from_json("value", "map<string,string>")[key]
    items = whole.select(F.posexplode(F.from_json(part, "array<string>")).alias("pos", "element"))
    id_type = F.schema_of_variant(F.try_variant_get(F.try_parse_json("element"), "$.id", "variant"))
    id_kind = F.when(id_type == "STRING", "string").when(id_type == "BOOLEAN", "boolean").when(id_type != "VOID", "number")
    return items.select("pos", (json_kind(F.col("element")) == "object").alias("is_object"), F.from_json("element", ITEM).alias("i"), id_kind.alias("id_kind")).select("pos", "is_object", "i.*", "id_kind")


def dump_categories(spark: SparkSession, path: str) -> list[str] | None:
    """Sorted names of the top-level arrays of a JSON dump; None where its top level is no object."""
    whole = spark.read.text(path, wholetext=True)
    top = whole.select(json_kind(F.col("value")).alias("top")).first()
    if top is None or top["top"] != "object":
        return None
    arrays = json_categories(whole).filter(json_kind(F.col("value")) == "array")
    return sorted(r["key"] for r in arrays.select("key").collect())  # the keys of one document


def scan_inbox(spark: SparkSession, root: str) -> DataFrame:
    """path, supplier (first folder under root, else UNKNOWN), name and time of all files, in path order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    below = F.regexp_replace("path", "^(file:)?/*", "")
    base = root.removeprefix("file:").strip("/")
    rest = F.substring(below, F.lit(len(base) + 2), F.length(below))
    supplier = F.when(F.instr(rest, "/") > 0, F.substring_index(rest, "/", 1)).otherwise("UNKNOWN")
    return found.select("path", supplier.alias("supplier"), F.substring_index("path", "/", -1).alias("name"), "modificationTime", "length").orderBy("path")


def latest_file(spark: SparkSession, root: str, suffix: str = ".json") -> str | None:
    row = scan_inbox(spark, root).filter(F.col("path").endswith(suffix)).orderBy(F.desc("modificationTime"), "path").first()
    return row["path"] if row else None


def read_csv_grid(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A delimited file with header, all columns text."""
    return spark.read.csv(path, header=True, sep=separator, inferSchema=False, multiLine=True, escape='"')


def read_xml_rows(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def columns_of(spark: SparkSession, name: str) -> list[str] | None:
    """Column names of a table, or None where the catalogue has none."""
    return [c.name for c in spark.catalog.listColumns(name)] if spark.catalog.tableExists(name) else None


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""
