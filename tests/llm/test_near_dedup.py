import random
import tracemalloc

import numpy as np
from samples import prose

from tarifold.llm import hamming_join as hj


def brute(rows):
    """All pairs within the distance, each document by its nearest text, by comparing every two."""
    sigs = [(i, hj.text_signature(t.encode())) for i, t in rows if i is not None and t is not None]
    sigs = [(i, s) for i, s in sigs if s is not None]
    out = {}
    for k, (i, a) in enumerate(sigs):
        for j, b in sigs[:k]:
            d = int((a != b).sum())
            if d <= hj.MAX_DISTANCE and i != j:
                pair = (min(i, j), max(i, j))
                out[pair] = min(d, out.get(pair, d))
    return {(*p, d) for p, d in out.items()}


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert pairs(hj.near_pairs(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_every_distance_is_found(spark):
    """Signatures at each distance up to the limit, errors at the worst places for the index."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 255, hj.SYMBOLS, dtype=np.uint8)
    rows, order = [(0, base)], [s for level in range(5) for c in hj._chunk_symbols() for s in c[level : level + 1]]
    for d in range(1, hj.SYMBOLS + 1):
        x = base.copy()
        x[order[:d]] += 1
        rows.append((d, x))
    frame = spark.createDataFrame([(i, *map(int, x.view(np.int64))) for i, x in rows], "doc_id long, s0 long, s1 long, s2 long, s3 long, s4 long")
    got = {(a, b): d for a, b, d in pairs(hj.hamming_pairs(frame))}
    want = {(i, j): int((x != y).sum()) for i, x in rows for j, y in rows if i < j and (x != y).sum() <= hj.MAX_DISTANCE}
    assert got == want


def test_recall_of_near_copies(spark):
    rows, near = [], []
    for k in range(60):
        words = prose(k, 300).split()
        changed = words.copy()
        for p in range(k % 7, 300, 25):  # 12 words of 300
            changed[p] = "other"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        near.append((2 * k, 2 * k + 1))
    found = {(a, b) for a, b, _ in pairs(hj.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert len(found & set(near)) >= 0.9 * len(near)
    assert not found - set(near)


def test_odd_rows(spark, odd_docs, no_docs):
    got = pairs(hj.near_pairs(odd_docs))
    assert got == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert {(1, 2, 0)} <= got and not any(4 in p[:2] or 5 in p[:2] or 6 in p[:2] for p in got)
    kept = hj.dedup(odd_docs)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    assert kept.columns == odd_docs.columns
    assert ids == [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, None]  # the row without an id is a copy of 1, that without a text stays
    assert hj.near_pairs(no_docs).count() == 0 and hj.dedup(no_docs).count() == 0


def test_every_pair_of_a_group_of_copies(spark):
    """Four equal texts make six pairs; a near copy pairs with each of them; a document with two texts is one document."""
    base = prose(9, 200)
    rows = [(i, base) for i in (3, 5, 6, 8)] + [(7, base.replace(base.split()[3], "other", 1)), (9, prose(10, 200)), (9, base), (10, prose(10, 200))]
    got = pairs(hj.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert {p[:2] for p in got} >= {(3, 5), (3, 6), (3, 8), (5, 6), (5, 8), (6, 8), (3, 7), (7, 8), (8, 9), (9, 10)} and len({p[:2] for p in got}) == len(got)


def test_dedup_of_repeated_and_missing_ids(spark):
    base, other = prose(11, 150), prose(12, 150)
    rows = [(4, base, "a"), (4, base, "b"), (None, base, "c"), (None, other, "d"), (None, other, "e"), (6, None, "f"), (6, None, "g"), (2, other + " x", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `meta.tag` string")
    kept = hj.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted([("4", base), ("6", "None"), ("6", "None"), ("2", other + " x")])
    unique = docs.filter("doc_id in (2, 4)").dropDuplicates(["doc_id"])
    assert hj.dedup(unique).columns == docs.columns and hj.dedup(unique).count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 103), (101, 103), (102, 101)] + [(200, i) for i in range(201, 240)] + [(7, 7)]
    got = {r["doc_id"]: r["root"] for r in hj.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 104)} | {i: 200 for i in range(200, 240)}


def class_rows(df):
    rows = [(r["doc_id"], r["class_id"], r["links"]) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return set(rows)


def brute_classes(rows):
    """Class and links of each document from the pairs of brute()."""
    found = {p[:2] for p in brute(rows)}
    ids = {i for i, _ in rows if i is not None}
    root = {i: i for i in ids}
    while True:
        least = {i: min([root[i], *(root[b if a == i else a] for a, b in found if i in (a, b))]) for i in ids}
        if least == root:
            return {(i, root[i], sum(i in p for p in found)) for i in ids}
        root = least


def test_classes_equal_brute_force(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert class_rows(hj.query(spark, sf)) == want and any(n for _, _, n in want)
    assert class_rows(hj.classes(odd_docs)) == brute_classes([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert hj.classes(no_docs).count() == 0


def test_rows_do_not_grow_with_the_size_of_groups(spark):
    """One row a document, each with all its links: 60 copies, 20 near copies and one document alone."""
    base = prose(21, 200)
    rows = [(i, base) for i in range(60)] + [(60 + k, base.replace(base.split()[7 * k], f"other{k}", 1)) for k in range(20)] + [(90, prose(22, 200))]
    want = brute_classes(rows)
    assert class_rows(hj.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len(want) == 81 and max(n for _, _, n in want) == 79 and (90, 90, 0) in want


def test_documents_of_several_texts(spark):
    """A document that holds two signatures first of all counts partners once, joins both classes and makes no pair of their holders."""
    a, b, c = prose(31, 200), prose(32, 200), prose(33, 200)
    near = a.replace(a.split()[3], "other", 1)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, near), (4, b), (1, near), (5, near), (6, c), (7, c), (8, c), (8, a), (None, a), (9, None), (10, a), (10, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(hj.near_pairs(docs)) == brute(rows)
    assert class_rows(hj.classes(docs)) == brute_classes(rows)


def plain_signature(raw):
    """The signature word by word, in Python's integers."""
    full, words = (1 << 64) - 1, raw.lower().replace(b"\x0b", b" ").split()
    mix = lambda x: int(hj._mix(np.array([x & full], np.uint64))[0])
    hashes = [mix(sum((c + 1) * pow(hj._P, i, 1 << 64) for i, c in enumerate(w))) for w in words]
    shingles = [mix(x * 3 + y * 0xA0761D6478BD642F) for x, y in zip(hashes, hashes[1:])] if len(hashes) > 1 else hashes
    if not shingles:
        return None
    return [mix(min((int(a) * x + int(b)) & full for x in shingles)) >> 56 for a, b in zip(*hj._multipliers())]


def test_signatures_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBé \t\n") for _ in range(rng.randrange(30))).encode() for _ in range(60)] + [b"x" * 24, b"x" * 8, b"x" * 8 + b" y", b" " * 16 + b"z", b"a b " * 9]
    want = [plain_signature(t) for t in texts]
    for block in (1, 3, 8, hj.BLOCK):
        monkeypatch.setattr(hj, "BLOCK", block)
        monkeypatch.setattr(hj, "_powers", [])
        got = [hj.text_signature(t) for t in texts]
        assert [g if g is None else g.tolist() for g in got] == want


def test_memory_does_not_grow_with_the_text():
    for raw in (prose(1, 1000).encode() * 3000, b"x" * 20_000_000):
        tracemalloc.start()
        hj.text_signature(raw)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6, (len(raw), peak)


def test_the_set_of_errors_is_worked_out_once_a_pair(spark):
    """Every number of errors, each symbol: the distance and one row a pair; the join itself compares no signatures."""
    base = np.arange(hj.SYMBOLS, dtype=np.uint8)
    sigs = [base]
    for s in range(hj.SYMBOLS):
        sigs.append(base.copy())
        sigs[-1][s] ^= 128
    for n in range(2, 17):
        sigs.append(base.copy())
        sigs[-1][:: hj.SYMBOLS // n][:n] ^= 64
    lanes = [[int(x) for x in s.view(np.int64)] for s in sigs]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(lanes)], "doc_id long, " + ", ".join(f"s{i} long" for i in range(hj.LANES)))
    found = hj.hamming_pairs(frame)
    want = {(i, j): d for i in range(len(sigs)) for j in range(i + 1, len(sigs)) if (d := int((sigs[i] != sigs[j]).sum())) <= hj.MAX_DISTANCE}
    rows = [(r["doc_a"], r["doc_b"], r["distance"]) for r in found.collect()]
    assert {(a, b): d for a, b, d in rows} == want and len(rows) == len(want)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("^" in x for x in joins)


def test_exploded_keys_are_never_broadcast(spark, tmp_path):
    """A small table of signatures stands for forty times its rows: Spark's estimate would let it be broadcast."""
    spark.range(50).selectExpr("id as doc_id", *(f"id as s{i}" for i in range(hj.LANES))).write.parquet(str(tmp_path / "sigs"))
    plan = hj.hamming_pairs(spark.read.parquet(str(tmp_path / "sigs")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
