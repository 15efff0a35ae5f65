import math

import numpy as np
import pytest
from oracle import assert_same

from tarifold.llm import cover_tree, link_trust, merkle_audit

PAGES = "page_id long, url string, html string, host string, trust long, offset int, digest string, node int"
EXTRA = ("h", 1, 2, "d", 3)


def pages(spark, rows):
    return spark.createDataFrame([r + EXTRA for r in rows], PAGES)


def odd_pages():
    link = '<a href="https://www.good.example.org/x">g</a> <a href=\'//m.bad.example.com/y\'>b</a> <img src="http://x.y.example.net/z">'
    return [
        (1, "https://a.site.example.org/p", link), (1, "https://a.site.example.org/p", link), (2, "http://m.bad.example.com", '<a href="http://c.d.example.net">'), (None, "https://www.good.example.org", None), (4, None, link), (5, "", ""), (6, "not a url", "x"),
        (7, "https://user@W.Upper.Example.ORG:80/p?q#f", "<p>" + "long " * 100_000), (8, "ftp://c.d.example.net/q", 'href="/relative"'), (5000, "https://solo/", "é"), (None, None, None),
    ]


def test_audit_equals_oracle(spark, sf):
    assert_same(merkle_audit.query(spark, sf), merkle_audit.oracle(), sf)


def found(ours, theirs):
    return sorted((r["file"], r["slot"], r["fault"]) for r in merkle_audit.audit(merkle_audit.tree(ours), merkle_audit.tree(theirs)).collect())


def test_audit_of_odd_pages(spark):
    from pyspark.sql import functions as F

    good = merkle_audit.warc_records(pages(spark, odd_pages()))
    assert found(good, good) == []
    assert found(good, good.orderBy(F.desc("record"))) == []  # order of repeated rows doesn't matter
    changed = good.withColumn("record", F.when(F.col("page_id") == 7, F.concat("record", F.lit("x"))).otherwise(F.col("record")))
    assert found(good, changed) == [(0, 7, "corrupt")]
    assert found(good, good.filter("page_id is null or page_id <> 5000")) == [(1, 5000 - 4096, "missing")]
    assert found(good.filter("page_id is null or page_id <> 2"), good) == [(0, 2, "extra")]
    assert found(good, good.filter("page_id is not null")) == [(merkle_audit.NO_FILE, 0, "missing")]
    assert found(good, good.limit(0)) == sorted({(merkle_audit.NO_FILE, 0, "missing"), (1, 904, "missing")} | {(0, i, "missing") for i in (1, 2, 4, 5, 6, 7, 8)})
    assert found(good.limit(0), good.limit(0)) == []


def test_negative_and_missing_ids_have_files_of_their_own(spark):
    low = merkle_audit.warc_records(pages(spark, [(-4096, "u", "a"), (-1, "u", "b"), (None, "u", "c"), (2**53 + 1, "u", "d"), (-(2**63), "u", "e")]))
    got = {(r["file"], r["slot"]) for r in merkle_audit.leaves(low).collect()}
    assert got == {(-1, 0), (-1, 4095), (merkle_audit.NO_FILE, 0), (2**41, 1), (-(2**51), 0)}
    assert found(low, low.filter("page_id is not null")) == [(merkle_audit.NO_FILE, 0, "missing")]


def test_the_descent_reads_few_bundles(spark, tmp_path):
    from pyspark.sql import functions as F

    records = spark.range(0, 4096 * 200, 1000).select(F.col("id").alias("page_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record"))
    ours, theirs = merkle_audit.tree(records), merkle_audit.tree(records.withColumn("record", F.when(F.col("page_id") == 5000, "x").otherwise(F.col("record"))))
    assert [(r["file"], r["slot"], r["fault"]) for r in merkle_audit.audit(ours, theirs).collect()] == [(1, 904, "corrupt")]
    assert ours.select("bundle").distinct().count() == 4
    plan = ours.filter("level = 0 and bundle in (0)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "bundle" in plan


def test_root_speaks_for_all_records(spark):
    good = merkle_audit.warc_records(pages(spark, odd_pages()))
    top = {r["file"]: (r["digest"], r["bytes"]) for r in merkle_audit.tree(good).filter(f"level = {merkle_audit.LEVELS}").collect()}
    other = {r["file"]: (r["digest"], r["bytes"]) for r in merkle_audit.tree(good.filter("page_id is null or page_id <> 8")).filter(f"level = {merkle_audit.LEVELS}").collect()}
    assert top[1] == other[1] and top[0] != other[0]


def test_trust_equals_oracle(spark, sf):
    assert_same(link_trust.query(spark, sf), link_trust.oracle(), sf)


def test_trust_of_odd_pages_equals_oracle(spark, tmp_path):
    pages(spark, odd_pages()).write.parquet(f"{tmp_path}/pages.parquet")
    assert_same(link_trust.query(spark, str(tmp_path)), link_trust.oracle(), str(tmp_path))
    got = {r["page_id"]: r for r in link_trust.query(spark, str(tmp_path)).collect() if r["page_id"] is not None}
    assert got[2]["allowed"] is False and got[6]["host"] is None and got[7]["host"] == "w.upper.example.org"
    assert got[1]["distrust"] > 0  # links to a blocked host


def test_trust_of_no_pages(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert link_trust.query(spark, str(tmp_path)).count() == 0


def test_converged_trust_against_the_linear_system(spark):
    """A long chain and a random graph: ranks and verdicts of the solved system."""
    rng = np.random.default_rng(7)
    n, m = 36, 20  # a chain to a blocked host; a random graph beside it
    w = np.zeros((n + m, n + m), int)
    w[np.arange(n - 1), np.arange(1, n)] = 1
    w[n:, n:] = rng.integers(0, 3, (m, m)) * (rng.random((m, m)) < 0.2) * (1 - np.eye(m, dtype=int))
    trusted, blocked = n, n - 1
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i, j in zip(*np.nonzero(w))], "src string, dst string, weight long")
    hosts = spark.createDataFrame([(f"h{i}",) for i in range(n + m)], "host string")
    got = {r["host"]: r for r in link_trust.converge(edges, hosts, f"^h{trusted}$", f"^h{blocked}$").collect()}
    want = {}
    for kind, matrix, seed in (("trust", w, trusted), ("distrust", w.T, blocked)):
        step = matrix / np.maximum(matrix.sum(1, keepdims=True), 1)
        want[kind] = np.linalg.solve(np.eye(n + m) - 0.85 * step.T, 0.15 * np.eye(n + m)[seed] * link_trust.MASS)
        for i in range(n + m):
            assert abs((got[f"h{i}"][kind] if f"h{i}" in got else 0) - want[kind][i]) < link_trust.BLOCK_AT / 100
    hops = [k for k in range(n) if want["distrust"][n - 1 - k] >= link_trust.BLOCK_AT]
    assert max(hops) > 12
    assert hops == [k for k in range(n) if f"h{n - 1 - k}" in got and got[f"h{n - 1 - k}"]["distrust"] >= link_trust.BLOCK_AT]


def test_op9_takes_converged_trust(spark, tmp_path):
    from tarifold.llm import queries

    chain = [(k, f"http://h{k}/", f'<a href="http://h{k - 1}/">' if k > 1 else '<a href="http://m.bad.com/">') for k in range(1, 26)]
    pages(spark, [(0, "http://m.bad.com/", None), *chain]).write.parquet(f"{tmp_path}/pages.parquet")
    allowed = {r["page_id"]: r["allowed"] for r in queries.queries()["op9_link_trust"](spark, str(tmp_path)).collect()}
    assert not any(allowed[k] for k in range(15)) and len(allowed) == 26


def test_seed_tables_and_no_parent_links(spark):
    """Seeds from tables (null, repeated and unknown hosts too); without parent links only hyperlinks carry rank."""
    link = lambda h: f'<a href="http://{h}/">'
    rows = [(1, "http://a.x.example.org/", link("bad.site.example.net")), (2, "http://b.x.example.org/", link("good.example.org")), (3, "http://bad.site.example.net/", None), (4, "http://good.example.org/", link("b.x.example.org"))]
    seeds = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    for parents in (True, False):
        got = {r["page_id"]: r for r in link_trust.filtered(pages(spark, rows), seeds("GOOD.example.org", None, "no.where"), seeds("bad.site.example.net", "bad.site.example.net"), parents).collect()}
        assert [got[k]["allowed"] for k in (1, 2, 3, 4)] == [False, True, False, True]
        assert (got[1]["trust"] > 0) == parents  # b.x and a.x meet in x.example.org only
    assert all(r["allowed"] and r["trust"] == r["distrust"] == 0 for r in link_trust.filtered(pages(spark, rows), seeds(), seeds()).collect())


def brute_pairs(rows, cosine):
    valid = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    sizes = [len(v) for _, v in valid]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    valid = [(i, v / np.linalg.norm(v)) for i, v in valid if len(v) == dim]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(valid) for j, b in valid[:k] if i != j and a @ b >= cosine - 1e-12}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, root int, vector string")


@pytest.mark.parametrize("cosine", [0.95, 0.6, 0.2, 1.0])
def test_pairs_equal_brute_force(spark, monkeypatch, cosine):
    monkeypatch.setattr(cover_tree, "CELL", 20)
    monkeypatch.setattr(cover_tree, "CELL_ROWS", 15)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12))
    x = np.concatenate([centres[rng.integers(0, 30, 250)] + 0.1 * rng.normal(size=(250, 12)), rng.normal(size=(50, 12)), centres[:5], centres[:5]])
    rows = [(int(i), [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    got = [tuple(r) for r in cover_tree.near_pairs(frame(spark, rows), cosine).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, cosine)


def test_pairs_of_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.1], [1.0, 0.0, 0.12]
    rows = [(1, a), (2, b), (2, b), (3, a), (None, a), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0, 0.0]), (10, [float("inf"), 1.0, 0.0]), (11, [-1.0, 0.0, -0.1])]
    got = [tuple(r) for r in cover_tree.near_pairs(frame(spark, rows)).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (2, 3)]
    assert cover_tree.near_pairs(frame(spark, [])).count() == 0


def test_pairs_close_to_the_threshold(spark):
    """Doubles whose cosine is 1e-9 above or below the threshold: float32 could not tell them apart."""
    rng = np.random.default_rng(8)
    rows, want = [], set()
    for k in range(150):
        u = rng.normal(size=8)
        w = rng.normal(size=8)
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = 0.95 + (1e-9 if k % 2 else -1e-9)
        rows += [(2 * k, (3 * u).tolist()), (2 * k + 1, (0.5 * (c * u + math.sqrt(1 - c * c) * w)).tolist())]
        if k % 2:
            want.add((2 * k, 2 * k + 1))
    frame64 = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in cover_tree.near_pairs(frame64).collect()}
    assert {p for p in got if p[0] + 1 == p[1] and p[0] % 2 == 0} == want


def test_many_equal_vectors_stay_small():
    """A block of candidates is held at a time: 3000 equal vectors give 4.5 million pairs in little memory."""
    import tracemalloc

    exact = np.tile(np.array([[0.6, 0.8, 0.0]]), (3000, 1))
    tree = cover_tree.make_tree(np.arange(3000), exact, 0.316)
    tracemalloc.start()
    n = sum(len(f) for f in cover_tree.tree_pairs(tree, tree, 0.95))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3000 * 2999 // 2 and peak < 40e6


def test_clustered_vectors_visit_few_groups():
    """In data with structure a vector is sent to few groups, however many there are."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 50, 0) + 0.02 * rng.normal(size=(2000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pivots = x[::10]
    pivot = (x @ pivots.T).argmax(1)
    away = cover_tree._to(x, pivots[pivot])
    counts, radius = np.bincount(pivot, minlength=len(pivots)), np.zeros(len(pivots), np.float32)
    np.maximum.at(radius, pivot, away)
    layout = cover_tree.lay_out(pivots, counts, radius, 20, 64)
    assert layout.groups >= 30
    reach = np.minimum(away[:, None] + 2 * 0.316, radius[None, :] + 0.316)
    seen = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T)) <= reach
    visits = [len(set(layout.group[layout.first[np.flatnonzero(row)]].tolist())) for row in seen]
    assert np.mean(visits) < 6


def test_tree_invariants():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, nodes = cover_tree.build_tree(x, 0.1)
    assert sorted(order) == list(range(400))
    for level, centre, lo, hi, c0, c1, radius in nodes:
        d = np.linalg.norm(x[order[int(lo) : int(hi)]] - x[int(centre)], axis=1)
        assert d.max() <= radius + 2e-3
        kids = nodes[int(c0) : int(c1)]
        if len(kids):
            assert kids[0][1] == centre and kids[0][2] == lo and kids[-1][3] == hi  # nesting and cover
            for k, p in enumerate(kids):  # covering and separation of siblings
                assert p[6] <= 2.0 ** (1 - p[0]) + 2e-3
                for q in kids[:k]:
                    assert np.linalg.norm(x[int(p[1])] - x[int(q[1])]) > 2.0 ** (1 - p[0]) - 2e-3


def test_oracle_of_pairs(spark, sf):
    assert_same(cover_tree.query(spark, sf), cover_tree.oracle(), sf)


def clustered(rng):
    """Chains, cliques, a vector with two rows and vectors alone."""
    base = rng.normal(size=(4, 64))
    rows = [base[0] + 0.02 * rng.normal(size=64) for _ in range(40)] + [base[1] + 0.3 * k * base[2] for k in range(6)] + list(rng.normal(size=(30, 64)))
    rows = [(int(i), [float(np.float32(v)) for v in row]) for i, row in enumerate(rows)]
    return rows + [(70, rows[0][1]), (3, rows[3][1]), (100, [float(np.float32(v)) for v in base[3]])]


def test_classes_equal_oracle(spark, tmp_path):
    """One row a vector, however large its group, with the links of brute force and the classes of the recursive SQL."""
    rows = clustered(np.random.default_rng(9))
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["class_id"], r["links"]) for r in cover_tree.query(spark, str(tmp_path)).collect()}
    want = brute_pairs(rows, 0.95)
    assert len(got) == len({i for i, _ in rows}) and all(n == sum(i in p for p in want) for i, (_, n) in got.items())
    assert got[39] == (0, 40) and got[100] == (100, 0) and max(got[i][1] for i in range(40, 46)) > 0
    assert_same(cover_tree.query(spark, str(tmp_path)), cover_tree.oracle(), str(tmp_path))


def test_classes_of_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.1], [1.0, 0.0, 0.12]
    rows = [(1, a), (2, b), (2, b), (3, a), (None, a), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (9, [1.0, 0.0]), (11, [-1.0, 0.0, -0.1])]
    got = sorted(tuple(r) for r in cover_tree.classes(frame(spark, rows)).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0), (5, 5, 0), (6, 6, 0), (9, 9, 0), (11, 11, 0)]
    assert cover_tree.classes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("leaf,spread", [(1, 1), (8, 2), (64, 16), (10**6, 16)])
def test_any_leaf_size_gives_the_same_pairs(monkeypatch, leaf, spread):
    rng = np.random.default_rng(10)
    x = np.concatenate([np.repeat(rng.normal(size=(6, 16)), 150, 0) + 0.08 * rng.normal(size=(900, 16)), rng.normal(size=(900, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(cover_tree, "LEAF", leaf)
    monkeypatch.setattr(cover_tree, "SPREAD", spread)
    eps = math.sqrt(0.1)
    a, b = cover_tree.make_tree(np.arange(1300), x[:1300], eps), cover_tree.make_tree(np.arange(1300, 1800), x[1300:], eps)
    got = [(p, q) for s, t in ((a, a), (b, b), (a, b)) for f in cover_tree.tree_pairs(s, t, 0.95) for p, q in zip(f["vec_a"], f["vec_b"])]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert len(got) == len(set(got)) and set(got) == set(zip(i.tolist(), j.tolist()))


def test_vectors_without_structure_stay_in_leaves():
    """Vectors of which none is near another are compared by matrix products, not node by node."""
    x = np.random.default_rng(11).normal(size=(4096, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(cover_tree.make_tree(np.arange(4096), x, math.sqrt(0.1)).nodes) == 1
