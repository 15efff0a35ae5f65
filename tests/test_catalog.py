import pytest
from oracle import assert_same

from tarifold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_every_query_has_an_oracle_but_one():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"q_norm_sku_nfkc"}


def test_nfkc_against_python(spark, sf):
    import re
    import unicodedata

    def want(text):
        s = unicodedata.normalize("NFKC", text[:40])
        s = " ".join(re.sub("[​‌‍﻿]", "", s).split())
        return s[:-2] if s.endswith(".0") and all(c.isdigit() or c in ".-" for c in s) else s

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in catalog.q_norm_sku_nfkc(spark, sf).collect():
        assert r["sku"] == want(texts[r["doc_id"]])


def test_fates_partition_the_lines(spark, sf):
    stats = catalog.q_emit_stats(spark, sf).first()
    assert stats["good_rows"] + stats["bad_rows"] + stats["skipped_lines"] == 4 * stats["source_rows_read"]
    assert stats["exploded_lines"] == stats["good_rows"] + stats["bad_rows"]


def test_emit_plan_has_no_shuffle_below_the_counts(spark, sf):
    plan = catalog.typed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "PushedFilters" in plan and "p_type" not in plan
