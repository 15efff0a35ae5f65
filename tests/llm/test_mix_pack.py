import collections

from samples import prose
from oracle import assert_same
from pyspark.sql import functions as F

from tarifold.llm import mixing, packing, tokens


def test_mixture_equals_oracle(spark, sf):
    assert_same(mixing.query(spark, sf), mixing.oracle(), sf)


def test_odd_rows_equal_oracle(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(mixing.query(spark, str(tmp_path)), mixing.oracle(), str(tmp_path))


def test_mix_takes_the_same_rows(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns
    assert sorted(r["doc_id"] for r in taken.collect()) == sorted(r["doc_id"] for r in mixing.query(spark, sf).collect())
    assert mixing.mix(odd_docs).columns == odd_docs.columns and mixing.mix(odd_docs).count() > 0
    assert mixing.mix(no_docs).count() == 0


def budgets(spark, leaves, budget):
    frame = spark.createDataFrame(leaves, "domain string, language string, site string, tokens long")
    return {(r["domain"], r["language"], r["site"]): r["given"] for r in mixing.leaf_budgets(frame, F.lit(budget), max_epochs=1).collect()}


def test_shortage_goes_to_siblings_first(spark):
    got = budgets(spark, [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d1", "en", "c", 1000)], 700)
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 390, ("d1", "en", "c"): 300}  # a's shortage stays with b; d0 : d1 is 4 : 3


def test_shortage_goes_up_when_siblings_are_full(spark):
    got = budgets(spark, [("d0", "en", "a", 10), ("d0", "de", "b", 20), ("d1", "en", "c", 1000)], 700)
    assert got == {("d0", "en", "a"): 10, ("d0", "de", "b"): 20, ("d1", "en", "c"): 670}


def test_budget_beyond_the_corpus_takes_all(spark):
    assert budgets(spark, [("d0", "en", "a", 10), ("d1", "en", "c", 5)], 1000) == {("d0", "en", "a"): 10, ("d1", "en", "c"): 5}


def test_a_language_of_weight_zero_leaves_its_share(spark):
    frame = spark.createDataFrame([("d0", "de", "a", 10_000), ("d0", "en", "b", 10), ("d1", "en", "c", 1000)], "domain string, language string, site string, tokens long")
    got = {r["site"]: r["given"] for r in mixing.leaf_budgets(frame, F.lit(700), 1, language_weights={"de": 0, "en": 6}).collect()}
    assert got == {"b": 10, "c": 690}
    assert mixing.leaf_budgets(frame, F.lit(700), 1, language_weights={"de": 0, "en": 0}).count() == 0


def test_mix_by_byte_pair_tokens_and_dotted_columns(spark, sf):
    from tarifold.llm import token_rollup

    count = token_rollup.token_counter(token_rollup.FIRST)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "lang as `meta.lang`")
    taken = mixing.mix(docs, tokens=count)
    assert taken.columns == docs.columns
    sizes = {r["doc_id"]: r["n"] for r in docs.select("doc_id", count(F.col("text")).alias("n")).collect()}
    used, budget = sum(sizes[r["doc_id"]] for r in taken.select("doc_id").collect()), sum(sizes.values()) * mixing.BUDGET_PERCENT // 100
    assert 0.6 * budget < used <= budget


def test_prefix_is_the_longest_that_fits(spark):
    rows = [(i, prose(i, 20 + i), "en", "src0", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counted, ends = mixing._ends(docs, 45, 1)
    got = {r["doc_id"] for r in mixing.select(counted, ends).collect()}
    order = [(r["place"], r["doc_id"], r["tokens"]) for r in counted.select("doc_id", "tokens", mixing._place(F.lit(0), F.col("doc_id")).alias("place")).collect()]
    budget, used, want = sum(t for _, _, t in order) * 45 // 100, 0, set()
    for _, i, t in sorted(order):
        if used + t > budget:
            break
        used += t
        want.add(i)
    assert got == want


def one_by_one(lengths, context):
    """Shortest-pack-first with single pieces, longest first: the sizes of all packs."""
    packs = []
    for n in sorted(lengths, reverse=True):
        k = min(range(len(packs)), key=lambda i: packs[i], default=None)
        if k is not None and packs[k] + n <= context:
            packs[k] += n
        else:
            packs.append(n)
    return sorted(packs)


def test_patterns_equal_one_by_one():
    import random

    r = random.Random(3)
    for context, n in ((16, 200), (50, 400), (7, 30)):
        lengths = [r.randint(1, context) for _ in range(n)]
        patterns = packing.shortest_pack_first(collections.Counter(lengths), context)
        assert sorted(sum(p) for p, c in patterns for _ in range(c)) == one_by_one(lengths, context)
        assert collections.Counter(x for p, c in patterns for _ in range(c) for x in p) == collections.Counter(lengths)
    assert packing.shortest_pack_first({}) == []


def check_packs(df, docs, context):
    rows = df.collect()
    by_pack = collections.defaultdict(list)
    for r in rows:
        by_pack[r["pack"]].append(r)
    assert sorted(by_pack) == list(range(len(by_pack)))
    for members in by_pack.values():
        members.sort(key=lambda r: r["offset"])
        end = 0
        for r in members:
            assert r["offset"] == end
            end += r["length"]
        assert end <= context and len({r["pattern"] for r in members}) == 1
    assert sorted(sum(r["length"] for r in m) for m in by_pack.values()) == one_by_one([r["length"] for r in rows], context)
    enc, want = tokens.encoder(packing.VOCABULARY), collections.Counter()
    for d in docs.collect():
        want[d["doc_id"]] += len(enc.encode_ordinary(d["text"] or ""))
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == +want


def test_packs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_packs(packing.query(spark, sf), docs, packing.CONTEXT)
    check_packs(packing.pack(docs, 512), docs, 512)


def test_packs_with_many_buckets(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 40)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_packs(packing.pack(docs, 256), docs, 256)


def test_packs_of_odd_rows(spark, odd_docs, no_docs):
    check_packs(packing.pack(odd_docs, 300), odd_docs, 300)
    assert packing.pack(no_docs).count() == 0


def test_no_text_is_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
