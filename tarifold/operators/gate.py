"""Tolerance gate: a run's stats against a baseline, folded to a verdict."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASS, WARN, FAIL = "PASS", "WARN", "FAIL"
EXIT = {PASS: 0, WARN: 10, FAIL: 20}
REQUIRED = sorted("bad_rows exploded_lines explosion_factor_exact file_readable flags_counts good_rows parser_id run_id source_rows_read structure_ok supplier_id".split())


def metric_reasons(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics that are missing or out of tolerance.

    stats: metric, actual (text). baseline: metric, expected (text), tolerance
    (long), is_text: compare texts exactly or whole numbers within tolerance.
    """
    joined = baseline.join(stats, "metric", "left")
    whole = lambda c: F.col(c).try_cast("decimal(38,6)").cast("long")
    off = F.when(F.col("is_text"), F.col("actual") != F.col("expected")).otherwise(F.coalesce(F.abs(whole("actual") - whole("expected")) > F.coalesce("tolerance", F.lit(0)), F.lit(True)))
    code = F.when(F.col("actual").isNull(), "metric_missing").when(off, "metric_out_of_tolerance")
    return joined.select("metric", "expected", "actual", F.lit(WARN).alias("level"), code.alias("code")).filter(F.col("code").isNotNull())


def run_reasons(stats: DataFrame) -> DataFrame:
    """Reasons that need no baseline. stats: one row per run with the gate's counts."""
    checks = [
        (FAIL, "file_not_readable", ~F.col("file_readable")), (FAIL, "structure_not_ok", ~F.col("structure_ok")), (FAIL, "exploded_lines_zero", F.col("exploded_lines") == 0),
        (WARN, "has_bad_rows", F.col("bad_rows") > 0), (WARN, "has_negative_price", F.col("negative_price") > 0),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, test in checks)))
    return stats.select("run_id", F.explode(found).alias("r")).select("run_id", "r.level", "r.code")


def verdicts(runs: DataFrame, reasons: DataFrame) -> DataFrame:
    """run_id and verdict: the worst level of its reasons. Only FAIL reasons count where there is one."""
    rank = F.max(F.when(F.col("level") == FAIL, 2).when(F.col("level") == WARN, 1))
    worst = reasons.groupBy("run_id").agg(rank.alias("rank"))
    name = F.when(F.col("rank") == 2, FAIL).when(F.col("rank") == 1, WARN).otherwise(PASS)
    return runs.select("run_id").distinct().join(worst, "run_id", "left").select("run_id", name.alias("verdict"))


def lookup(document: dict, path: str) -> Any:
    """Value at a dotted path, None where there is none."""
    for part in path.split("."):
        if not isinstance(document, dict) or part not in document:
            return None
        document = document[part]
    return document


def gate_document(spark: SparkSession, stats: dict, baseline: dict | None = None) -> dict:
    """Verdict document of one run: verdict, exit_code and reasons."""
    lacking = [k for k in REQUIRED if k not in stats]
    if lacking:
        raise ValueError(f"stats lack {', '.join(lacking)}")
    one = [(stats["run_id"], bool(stats["file_readable"]), bool(stats["structure_ok"]), int(stats["exploded_lines"]), int(stats["bad_rows"]), int((stats["flags_counts"] or {}).get("negative_price", 0)))]
    runs = spark.createDataFrame(one, "run_id string, file_readable boolean, structure_ok boolean, exploded_lines long, bad_rows long, negative_price long")
    reasons = [(r["level"], r["code"], None) for r in run_reasons(runs).collect()]
    if any(level == FAIL for level, _, _ in reasons):
        reasons = [r for r in reasons if r[0] == FAIL]
    elif baseline is None:
        reasons.insert(0, (WARN, "baseline_missing", None))
    elif baseline.get("parser_id") != stats["parser_id"]:
        reasons.insert(0, (WARN, "baseline_mismatch", None))
    else:
        rules = baseline.get("metrics", {})
        usable = {m: r for m, r in rules.items() if isinstance(r.get("expected"), str | int | float) and not isinstance(r.get("expected"), bool)}
        reasons = [(WARN, "baseline_invalid", m) for m in rules if m not in usable] + reasons
        actual = spark.createDataFrame([(m, None if (v := lookup(stats, m)) is None else str(v)) for m in usable], "metric string, actual string")
        wanted = spark.createDataFrame([(m, str(r["expected"]), int(r.get("tolerance_abs", 0)), isinstance(r["expected"], str)) for m, r in usable.items()], "metric string, expected string, tolerance long, is_text boolean")
        reasons = [(r["level"], r["code"], r["metric"]) for r in metric_reasons(actual, wanted).orderBy("metric").collect()] + reasons
    verdict = FAIL if any(r[0] == FAIL for r in reasons) else WARN if reasons else PASS
    return {"run_id": stats["run_id"], "verdict": verdict, "exit_code": EXIT[verdict], "reasons": [{"level": level, "code": code} | ({"metric": m} if m else {}) for level, code, m in reasons]}
