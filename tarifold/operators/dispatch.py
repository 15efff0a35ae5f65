"""Layout dispatch: which mapping a file gets, from its name and its header."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifold.functions.text import clean_tag, is_numberish, nonempty_count, norm_header

#: Name fragment -> layout, first match wins; the default comes last.
NAME_LAYOUTS = [("груз", "truck"), ("диск", "wheels"), ("комплект", "fittings"), ("шин", "tyres")]
#: Words that a header row tends to hold, and those of its second row.
HEADER_WORDS = sorted("артикул бренд вид длина заказ ключ код марка миц наименование опт остат посад резьба рознич секрет склад".split())
SECOND_WORDS = ["заказ", "остаток", "руб", "цена", "шт"]


def layout_of_name(name: Column, layouts: list[tuple[str, str]] = NAME_LAYOUTS, default: str = "tyres") -> Column:
    out, low = None, F.lower(name)
    for fragment, layout in layouts:
        test = F.contains(low, F.lit(fragment))
        out = F.when(test, layout) if out is None else out.when(test, layout)
    return F.lit(default) if out is None else out.otherwise(default)


def joined_header(cells: Column) -> Column:
    return F.array_join(F.filter(F.transform(cells, norm_header), lambda c: c != ""), " | ")


def match_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """file and layouts of the rules it meets, status OK where it is exactly one.

    files: file, cols, row1, row2 (cells). rules: rule, layout, cols (or null),
    row1_tokens, row2_tokens (arrays of normalised texts, all of which the
    joined header must contain). Rules are configuration, a handful of rows, so
    the theta join broadcasts them after a look at their number.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("more dispatch rules than a configuration should have")
    heads = files.withColumns({"h1": joined_header(F.col("row1")), "h2": joined_header(F.col("row2"))})
    r = rules.select("rule", "layout", F.col("cols").alias("need_cols"), "row1_tokens", "row2_tokens")
    test = (F.col("need_cols").isNull() | F.col("cols").isNull() | (F.col("need_cols") == F.col("cols"))) & F.forall("row1_tokens", lambda t: F.contains(F.col("h1"), t)) & F.forall("row2_tokens", lambda t: F.contains(F.col("h2"), t))
    met = heads.join(F.broadcast(r), test, "left")
    out = met.groupBy("file").agg(F.array_sort(F.collect_list("layout")).alias("layouts"))
    return out.withColumn("status", F.when(F.size("layouts") == 1, "OK").otherwise("PROBLEM"))


def match_signatures(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Variant over signature tokens: every needed text is inside some token; rules that need nothing never match.

    files: file, header_rows, tokens. rules: rule, layout, header_rows (or null), need.
    """
    if rules.limit(10_001).count() > 10_000:
        raise ValueError("more dispatch rules than a configuration should have")
    r = rules.select("rule", "layout", F.col("header_rows").alias("need_rows"), "need")
    test = (F.size("need") > 0) & (F.col("need_rows").isNull() | (F.col("need_rows") == F.col("header_rows"))) & F.forall("need", lambda n: F.exists("tokens", lambda t: F.contains(t, n)))
    met = files.join(F.broadcast(r), test, "left")
    return met.groupBy("file").agg(F.array_sort(F.collect_list("layout")).alias("layouts")).withColumn("status", F.when(F.size("layouts") == 1, "OK").otherwise("PROBLEM"))


def missing_columns(header: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), header)


def header_score(cells: Column, words: list[str] = HEADER_WORDS) -> Column:
    """Likeness to a header row: filled cells and known words for, numbers against; null for an empty row."""
    low = F.lower(F.array_join(F.filter(cells, lambda c: F.trim(c) != ""), " "))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    numbers = F.size(F.filter(cells, lambda c: is_numberish(c)))
    filled = nonempty_count(cells)
    return F.when(filled > 0, filled * 10 + hits * 15 - numbers * 4)


def header_rows(grid: DataFrame, scan: int = 20, second_words: list[str] = SECOND_WORDS) -> DataFrame:
    """Per file: number of header rows and their row numbers. Ties in score go to the later row.

    The best row is a max_by; a file whose best row has fewer than five filled
    cells falls back to its first rows.
    """
    top = grid.filter(F.col("row_no") <= scan)
    by_row = F.map_from_entries(F.collect_list(F.struct("row_no", "cells")))
    found = top.groupBy("source_file", "sheet").agg(F.max(F.when(header_score(F.col("cells")).isNotNull(), F.struct(header_score(F.col("cells")), "row_no"))).alias("best"), by_row.alias("rows"), F.count("*").alias("n"))
    found = found.withColumn("row1", F.coalesce("best.row_no", F.lit(1)))
    second = F.col("rows")[F.col("row1") + 1]
    low = F.lower(F.array_join(second, " "))
    is_second = (nonempty_count(second) >= 2) & F.exists(F.array(*map(F.lit, second_words)), lambda w: F.contains(low, w))
    thin = F.coalesce(nonempty_count(F.col("rows")[F.col("row1")]) < 5, F.lit(True))
    count = F.when(thin, F.when(F.col("n") > 1, 2).otherwise(1)).when(F.coalesce(is_second, F.lit(False)), 2).otherwise(1)
    return found.select("source_file", "sheet", count.alias("header_rows"), F.when(thin, 1).otherwise(F.col("row1")).cast("int").alias("header_row"), (F.when(thin, 1).otherwise(F.col("row1")) + count).cast("int").alias("data_row"))


def check_header(row1: list[str], row2: list[str], price: int, wholesale: str = "опт", stock: int | list[int] | None = None, centre: int | None = None) -> list[str]:
    """Problems of a two-row header at 1-based positions.

    Wholesale price over "цена", named stock columns over "остаток", and a
    centre column whose first row speaks of the centre and whose second is
    blank, "остаток" or "центр. склад".
    """
    at = lambda row, n: " ".join(row[n - 1].split()).lower() if 0 < n <= len(row) else ""
    out = [] if at(row2, price) == "цена" else ["price label"]
    out += [] if wholesale in at(row1, price) else ["price group"]
    if centre is not None:
        out += ([] if "центр" in at(row1, centre) else ["centre group"]) + ([] if at(row2, centre) in ("", "остаток", "центр. склад") else ["centre label"])
    for n in [] if stock is None else [stock] if isinstance(stock, int) else stock:
        out += ([] if at(row2, n) == "остаток" else ["stock label"]) + ([] if at(row1, n) else ["stock name"])
    return out


@dataclass(frozen=True)
class Plan:
    """What to run on one file: the emitter, the layout (or category:<key>) and the mapping it needs."""

    path: str
    supplier: str
    layout: str
    tag: str
    emitter: str = "typed"
    mapping: str | None = None


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def workbook_adapter(supplier: str, mappings: dict[str, str], emitter: str = "strings", layouts: list[tuple[str, str]] = NAME_LAYOUTS, default: str = "tyres"):
    """Plans for a supplier of workbooks: the layout by the file's name, the mapping by the layout (or that of the default)."""

    def plan(path: str) -> Plan | None:
        low = path.rsplit("/", 1)[-1].lower()
        layout = next((name for fragment, name in layouts if fragment in low), default)
        mapping = mappings.get(layout, mappings.get(default))
        return Plan(path, supplier, layout, clean_tag(f"{supplier}__{_stem(path)}__{layout}"), emitter, mapping) if mapping else None

    return plan


def dump_adapter(supplier: str, categories):
    """Plans for a supplier of JSON dumps: one for each top-level array. categories: path -> sorted keys, or None for no object."""

    def plan(path: str) -> list[Plan] | None:
        keys = categories(path) if path.lower().endswith(".json") else None
        return None if keys is None else [Plan(path, supplier, f"category:{k}", clean_tag(f"{supplier}__{_stem(path)}__category:{k}"), "category") for k in keys]

    return plan


class Registry:
    """Supplier adapters: names (whole, case aside; "*" for any) to a function path -> plans (or None)."""

    def __init__(self):
        self._adapters: list[tuple[tuple[str, ...], object]] = []

    def add(self, names: tuple[str, ...], plan) -> None:
        self._adapters.append((tuple(n.lower() for n in names), plan))

    def plan(self, supplier: str, path: str) -> tuple[list[Plan], str | None]:
        """(plans, reason for none)."""
        for names, make in self._adapters:
            if supplier.lower() in names or "*" in names:
                made = make(path)
                plans = [] if made is None else [made] if isinstance(made, Plan) else list(made)
                return (plans, None) if plans else ([], "no plan")
        return [], "no adapter"


@dataclass(frozen=True)
class ColumnRule:
    """How a field is recognised: kind header_exact, header_contains, value_pattern or column_position."""

    field: str
    kind: str
    value: str | int
    priority: int = 0


KINDS = ["header_exact", "header_contains", "value_pattern", "column_position"]


def map_columns(header: list[str], sample: list[list[str]], rules: list[ColumnRule]) -> dict[int, tuple[str, ColumnRule]]:
    """1-based column -> (field, rule). Exact beats contains beats pattern beats position; then the higher priority.

    header and sample are the first rows of one sheet, on the driver.
    """
    import re

    low = [" ".join(h.split()).lower() for h in header]
    out: dict[int, tuple[str, ColumnRule]] = {}
    taken: set[str] = set()
    for rule in sorted(rules, key=lambda r: (KINDS.index(r.kind), -r.priority)):
        if rule.field in taken:
            continue
        for at in range(1, len(header) + 1):
            values = [row[at - 1] for row in sample if at <= len(row) and row[at - 1] != ""]
            met = {
                "header_exact": low[at - 1] == str(rule.value).lower(), "header_contains": str(rule.value).lower() in low[at - 1],
                "value_pattern": bool(values) and rule.kind == "value_pattern" and all(re.fullmatch(str(rule.value), v) for v in values), "column_position": rule.value == at,
            }[rule.kind]
            if met and at not in out:
                out[at] = (rule.field, rule)
                taken.add(rule.field)
                break
    return out
