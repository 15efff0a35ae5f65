import pytest
from pyspark.sql import functions as F

from tarifold.functions import hashing, numeric, text


def apply(spark, make, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


PRICES = [
    ("99.995", 10000, [], None), ("0.004", 0, ["zero_price"], None), ("0.005", 1, [], None), ("-0.005", -1, ["negative_price"], None), ("12,5", None, [], "invalid_price_format"), ("1 234,50", None, [], "invalid_price_format"),
    ("abc", None, [], "invalid_price_format"), ("NaN", None, [], "invalid_price_format"), ("Infinity", None, [], "invalid_price_format"), ("1e30", None, [], "invalid_price_format"), ("4d", None, [], "invalid_price_format"), ("0x1p3", None, [], "invalid_price_format"),
    ("", None, ["missing_price"], None), (None, None, ["missing_price"], None), ("1e2", 10000, [], None),
]


def test_price_minor(spark):
    found = apply(spark, numeric.price_minor, [p[0] for p in PRICES])
    for (raw, value, flags, error), x in zip(PRICES, found):
        assert (x["value"], x["flags"], x["error"]) == (value, flags, error), raw


QTYS = [
    ("2.5", 3, ["qty_fractional"]), ("0.5", 1, ["qty_fractional"]), ("0.4", 0, ["qty_fractional"]), ("-0.5", -1, ["negative_qty", "qty_fractional"]), (">40", 40, ["qty_approximated"]), ("40+", 40, ["qty_approximated"]), ("10-20", 10, ["qty_approximated"]),
    ("12,5", 13, ["qty_approximated", "qty_fractional"]), ("1e3", 1000, []), ("NaN", None, ["qty_textual"]), ("нет", None, ["qty_textual"]), ("", None, ["no_qty"]), ("0", 0, ["qty_zero"]),
]


def test_qty_soft(spark):
    for (raw, value, flags), x in zip(QTYS, apply(spark, numeric.qty_soft, [q[0] for q in QTYS])):
        assert (x["value"], sorted(x["flags"])) == (value, sorted(flags)), raw


def test_text_contract_numbers(spark):
    got = {r: (x["value"], x["flags"]) for r, x in zip(["40+", "<5", "10-20", "1 234", "1,5", ">40", "-3", ""], apply(spark, numeric.int_text, ["40+", "<5", "10-20", "1 234", "1,5", ">40", "-3", ""]))}
    assert got == {"40+": ("40", []), "<5": ("5", []), "10-20": ("", ["qty_non_numeric"]), "1 234": ("1234", []), "1,5": ("", ["qty_has_fraction"]), ">40": ("40", ["qty_approximated"]), "-3": ("-3", []), "": ("", [])}
    prices = ["1 234,50", "12,345.6", "1.23456789", "100.0", "", "x", "-3"]
    assert [(x["value"], x["flags"]) for x in apply(spark, numeric.price_text, prices)] == [("1234.5", []), ("", ["bad_price"]), ("1.234568", []), ("100", []), ("", ["missing_price"]), ("", ["bad_price"]), ("-3", [])]


def test_other_numbers(spark):
    assert [(x["value"], x["flags"]) for x in apply(spark, numeric.first_digits_qty, ["12.0", "-5", "4.7", "7", "", "x"])] == [("12", ["qty_approximated"]), ("5", ["qty_approximated"]), ("4", ["qty_approximated"]), ("7", []), ("", ["missing_qty"]), ("", ["qty_non_numeric"])]
    assert [x["value"] for x in apply(spark, numeric.positive_price, ["1e-11", "1 200", "inf", "nan", "12,5", "-1", "5.0"])] == ["0", "", "", "", "12.5", "", "5"]
    assert apply(spark, numeric.lower_bound_qty, ["40+", "1 200,5", "> 40", "4.7", "-0.5", ""]) == [None, 1200, 40, 4, 0, None]
    assert apply(spark, numeric.as_float, ["1 200,5", "none", "NaN", "", "4d", None]) == [1200.5, None, None, None, None, None]
    assert apply(spark, lambda c: numeric.normalize_value(c, "qty"), ["нет", "—", ">40", "40+", ">=7", "3-9", "1,5", "1,234.5", "x"]) == [None, None, 40, 40, 7, 3, 1.5, 1234.5, None]
    assert apply(spark, lambda c: numeric.normalize_value(c, "price"), ["1 234,50 ₽", "$12", "1,234,567", "—"]) == [1234.5, 12, 1234567, None]


def test_sku(spark):
    values = ["1.2.0", "A1.0", "１２３", "-1.0", " a  b ", "x​1", None]
    assert apply(spark, text.normalize_sku, values) == ["1.2", "A1.0", "123", "-1", "a b", "x1", ""]


def test_text(spark):
    assert apply(spark, text.norm_ws, [" a\t\x1cb　", None]) == ["a b", ""]
    assert apply(spark, text.sanitize_tag, ["a b/c(ё)", "ok-1.x"]) == ["a_b_c___", "ok-1.x"]
    assert apply(spark, text.normalize_signature, ["  «A»  b!", "--X--"]) == ["«a» b", "x"]
    rows = spark.createDataFrame([(["H1", "", "h1 "], ["x", "", "x"], ["a", " ", ""])], "a array<string>, b array<string>, c array<string>")
    r = rows.select(text.signature_tokens(F.col("a"), F.col("b")).alias("two"), text.signature_tokens(F.col("a")).alias("one"), text.trim_right(F.col("c")).alias("t"), text.nonempty_count(F.col("c")).alias("n")).first()
    assert (r["two"], r["one"], r["t"], r["n"]) == (["h1|x"], ["h1"], ["a"], 1)


def test_hashing(spark, tmp_path):
    assert hashing.utc_text("2026-02-03T00:30:00+03:00") == "2026-02-02T21:30:00Z"
    assert hashing.utc_month("2026-03-01T00:30:00+03:00") == "2026-02"
    with pytest.raises(ValueError):
        hashing.utc_text("2026-02-03T00:30:00")
    (tmp_path / "a").write_bytes(b"x\r\ny\r")
    (tmp_path / "b").write_bytes(b"x\ny\r")
    assert hashing.sha256_file(str(tmp_path / "a"), lf=True) == hashing.sha256_file(str(tmp_path / "b"))
    row = spark.range(1).select(hashing.fallback_sku(F.lit(""), F.lit(" "), F.lit("b"), F.lit("n")).alias("x")).first()["x"]
    assert (row["value"], row["flags"]) == ("unknown_sku_6ab771b7f5fd", ["missing_sku"])


def test_nfkc_stays_in_the_jvm(spark):
    """All characters of the basic plane that NFKC changes, and sequences, as Python has them; no Python step in the plan."""
    import unicodedata

    from tarifold.operators import emit

    changed = [c for c in map(chr, range(0x80, 0xD800)) if unicodedata.normalize("NFKC", c) != c] + ["e\u0301", "\ufb01x", "\uff21\uff11 ", "\u1100\u1161", "plain"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(changed)], "i int, c string")
    assert len(changed) > 1000
    for r in rows.select("c", text.nfkc(F.col("c")).alias("n")).collect():
        assert r["n"] == unicodedata.normalize("NFKC", r["c"])
    source = rows.select(F.col("i").alias("row_no"), F.col("c").alias("article_primary"), *(F.lit("").alias(k) for k in ("article_fallback", "brand", "name", "price_raw")), F.array(F.struct(F.lit("w").alias("name"), F.lit("1").alias("qty_raw"))).alias("warehouses"))
    assert "Python" not in emit.emit_typed(source)._jdf.queryExecution().optimizedPlan().toString()


def test_strip_removes_every_white_space(spark):
    """The set that Python's str.strip removes, at both ends and not inside."""
    blank = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert "".join(blank) == text.WS_CHARS
    values = [f"{b}{b} a{b}b {b}" for b in blank] + ["".join(blank), "", "\u200b x\u180e"]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]
    assert apply(spark, text.norm_ws, values) == [" ".join(v.split()) for v in values]


def test_many_rows_are_spread(spark, sf, monkeypatch):
    """A price list of many rows in one file is shuffled before it is parsed; the lines are the same."""
    from tarifold.operators import emit
    from tarifold.plans import catalog

    few = catalog.q_emit_strings(spark, sf)
    monkeypatch.setattr(emit, "SPREAD_ROWS", 50)
    many = catalog.q_emit_strings(spark, sf)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(few) and "Exchange" in plan(many)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
