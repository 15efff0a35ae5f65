import collections

import corpus_pipeline
import numpy as np
import samples
from oracle import assert_same
from test_quality import python_features

from tarifold.llm import hamming_join, mixing, queries, rule_list, site_bayes, token_rollup


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def groups(rows):
    """Groups of near duplicates by comparing all signatures, union by union."""
    sigs = [(r["doc_id"], s) for r in rows if r["text"] is not None and (s := hamming_join.text_signature(r["text"].encode())) is not None]
    root = {i: i for i, _ in sigs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sigs):
        for j, b in sigs[:k]:
            if (a != b).sum() <= hamming_join.MAX_DISTANCE:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, sf)
    scored = site_bayes.evidence(docs, site_bayes.fit(spark, docs, sf))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in site_bayes.posterior(scored, *site_bayes.site_sums(scored)).filter(f"posterior >= {site_bayes.KEEP}").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert not [i for i, q in labels.items() if q and i not in ids]  # good documents stay
    assert [i for i, q in labels.items() if not q and i not in ids]

    more = "/root/testdata/sf0.01"  # labels enough to learn rules from
    many = spark.read.parquet(f"{more}/documents.parquet")
    rules = rule_list.fit(spark, many, more)
    ids = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, many, more).collect()}

    def fires(text):
        x = {k: np.array([v]) for k, v in python_features(text).items()}
        return any(rule_list._holds(r, x, 1)[0] for r in rules)

    rows = many.collect()
    assert rules and ids == {r["doc_id"] for r in rows if not fires(r["text"])}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{more}/labels.parquet").collect()}
    assert not [i for i, q in labels.items() if q and i not in ids]  # good documents stay
    assert sum(i not in ids for i, q in labels.items() if not q) >= 0.9 * sum(not q for q in labels.values())

    rows = docs.collect()
    root = groups(rows)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert left == {r["doc_id"] for r in rows if root.get(r["doc_id"], r["doc_id"]) == r["doc_id"]}

    counted, ends = mixing._ends(docs, mixing.BUDGET_PERCENT, mixing.MAX_EPOCHS, token_rollup.token_counter(token_rollup.FIRST))
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.mixing_to_weights(spark, docs, sf).collect()) == collections.Counter(r["doc_id"] for r in mixing.select(counted, ends).collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_rules_work_on_what_the_classifier_kept(spark):
    """The second stage has the rules of op7, though its input holds no bad label any more, and rejects junk that the first let pass."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10**9 + k, (samples.prose(k, 40) + " ") * 10 + "| " * 150, "en", "src0", 0) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.quality_classifier(spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert first.join(labels.filter("quality = 0"), "doc_id").count() == 0
    planted = first.unionByName(junk.select(first.columns))
    left = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, planted, sf).collect()}
    assert not [i for i in left if i >= 10**9]
    good = {r["doc_id"] for r in first.join(labels.filter("quality = 1"), "doc_id").collect()}
    assert good <= left
    rules = rule_list.fit(spark, docs, sf)
    assert rules and {r["rules"] for r in rule_list.query(spark, sf).collect()} == {rule_list.describe(rules)}


def test_run_is_the_chain(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_odd_rows_and_empty_tables(spark, sf, odd_docs, no_docs, no_labels, tmp_path):
    for n, docs in enumerate((odd_docs, no_docs)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf if n == 0 else no_labels).write.parquet(f"{tmp_path}/{n}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{n}-{k}")
        assert (docs.count() > 0) == (n == 0)


def test_oracles(spark, sf):
    for name, sql in queries.oracle_sql().items():
        assert_same(queries.queries()[name](spark, sf), sql, sf)
