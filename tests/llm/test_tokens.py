import collections
import time

import numpy as np
import pytest
from samples import prose

from tarifold.llm import repair, token_rollup, tokens


def totals(df):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in df.collect()}


def brute_recount(rows):
    """Totals with every remaining row under the second vocabulary, whatever its language."""
    least, out = {}, collections.defaultdict(lambda: [0, 0])
    for r in rows:
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(least.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    for r in rows:
        t = r["text"] or ""
        if r["doc_id"] is None or r["doc_id"] <= least[t]:
            entry = out[r["source"] or "", r["lang"] or "", token_rollup.REVISED]
            entry[0] += 1
            entry[1] += len(tokens.encoder(token_rollup.REVISED).encode_ordinary(t))
    return {k: tuple(v) for k, v in out.items()}


def test_every_language_is_recounted(spark, sf, tmp_path, odd_docs):
    from tarifold.llm import queries

    got = totals(queries.queries()["op2_token_rollups"](spark, sf))
    assert got == brute_recount(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert any(lang == "en" for _, lang, _ in got)
    assert totals(token_rollup.maintain(token_rollup.Rollup(spark, str(tmp_path / "a")), odd_docs)) == brute_recount(odd_docs.collect())
    assert totals(token_rollup.maintain(token_rollup.Rollup(spark, str(tmp_path / "b")), odd_docs.limit(0))) == {}


class Crash(Exception):
    pass


def test_a_crash_in_a_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    rows = token_rollup.signed(spark.createDataFrame([("s", "en", 5)], "source string, lang string, tokens long"), 1, "t")
    want = {("s", "en", "t"): (2, 10)}
    for step in ("_sweep", "rename"):
        store = token_rollup.Rollup(spark, str(tmp_path / step))
        assert store.commit("a", rows) and store.commit("b", rows)

        def fail(*_):
            raise Crash

        with monkeypatch.context() as m:
            if step == "_sweep":  # the base is there, its deltas too
                m.setattr(store, "_sweep", fail)
            else:  # the base is written and not in place
                m.setattr(store, "_fs", type("Fs", (), {"rename": fail, **{k: getattr(store._fs, k) for k in ("exists", "mkdirs", "listStatus", "delete")}})())
            with pytest.raises(Crash):
                store.compact()
        assert totals(store.totals()) == want and not store.commit("a", rows)
        store.compact()
        assert totals(store.totals()) == want and store.committed() == {"a", "b"} and not store.commit("b", rows)


def test_two_writers_of_one_batch_count_once(spark, tmp_path, monkeypatch):
    rows = token_rollup.signed(spark.createDataFrame([("s", "en", 5)], "source string, lang string, tokens long"), 1, "t")
    one, other = token_rollup.Rollup(spark, str(tmp_path / "s")), token_rollup.Rollup(spark, str(tmp_path / "s"))
    monkeypatch.setattr(other, "committed", lambda: set())  # looked before the first was done
    assert one.commit("b", rows) and other.commit("b", rows)
    assert totals(one.totals()) == {("s", "en", "t"): (1, 5)}
    one.compact()
    assert totals(one.totals()) == {("s", "en", "t"): (1, 5)} and one.committed() == {"b"}


def test_batches_are_idempotent_and_commute(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5), ("s", "en", 7), (None, None, 2)], "source string, lang string, tokens long")
    one, other = rows.filter("tokens = 5"), rows.filter("tokens <> 5")
    a, b = token_rollup.Rollup(spark, str(tmp_path / "a")), token_rollup.Rollup(spark, str(tmp_path / "b"))
    steps = [("load", token_rollup.signed(rows, 1, "t1")), ("gone", token_rollup.signed(one, -1, "t1")), ("new", token_rollup.revised(other.selectExpr("*", "tokens * 2 as more"), ("t1", "tokens"), ("t2", "more")))]
    for name, batch in steps:
        assert a.commit(name, batch)
        assert not a.commit(name, batch)
    for name, batch in reversed(steps):
        assert b.commit(name, batch)
    want = {("s", "en", "t2"): (1, 14), ("", "", "t2"): (1, 4)}
    assert totals(a.totals()) == totals(b.totals()) == want
    a.compact()
    assert totals(a.totals()) == want and a.committed() == {"load", "gone", "new"}
    assert not a.commit("gone", steps[1][1])
    assert a.commit("late", token_rollup.signed(one, 1, "t1"))
    a.compact()
    assert totals(a.totals()) == want | {("s", "en", "t1"): (1, 5)}
    with pytest.raises(ValueError):
        a.commit("../x", rows)


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    store = token_rollup.Rollup(spark, str(tmp_path / "s"))
    rows = token_rollup.signed(spark.createDataFrame([("s", "en", 5)], "source string, lang string, tokens long"), 1, "t")
    with pytest.raises(Exception, match="lost"):
        store.commit("b", rows.withColumn("tokens", F.raise_error(F.lit("lost")).cast("long")))
    assert store.committed() == set() and store.commit("b", rows)
    assert totals(store.totals()) == {("s", "en", "t"): (1, 5)}


def test_long_texts_encode_as_a_whole(monkeypatch):
    enc = tokens.encoder(token_rollup.FIRST)
    text = "a b  c\n d_ e " * 50 + prose(5, 3000) + " <|endoftext|> x"
    monkeypatch.setattr(tokens, "RUN_CHARS", 700)
    assert tokens.encode(enc, text).tolist() == enc.encode_ordinary(text)
    assert tokens.encode(enc, "z" * 5000).tolist() == enc.encode_ordinary("z" * 5000)


def test_the_search_for_special_tokens_costs_little():
    """No more CPU time than without that search, of the best of a few rounds; the one special token's own name is ordinary text."""
    enc, text, seconds = tokens.encoder(repair.VOCABULARY), prose(7, 20_000), collections.defaultdict(list)
    for _ in range(7):
        for name, encode in (("encode", lambda: tokens.encode(enc, text)), ("ordinary", lambda: enc.encode_ordinary(text))):
            began = time.process_time()
            encode()
            seconds[name].append(time.process_time() - began)
    assert min(seconds["encode"]) < min(seconds["ordinary"])
    for odd in (tokens.NEVER, f"é{tokens.NEVER * 3}😀 x", "<|endoftext|>"):
        ids = tokens.encode(enc, odd)
        assert ids.tolist() == enc.encode_ordinary(odd) and ids.max() < repair.IDS and enc.decode(ids.tolist()) == odd


def check_round_trip(shards, texts):
    enc, seen = tokens.encoder(repair.VOCABULARY), []
    for row in (r.asDict() for r in shards.collect()):
        assert row["n_ids"] == sum(len(repair.read_document(row, i)) for i in range(len(row["doc_ids"])))
        for i, doc_id in enumerate(row["doc_ids"]):
            ids = repair.read_document(row, i).tolist()
            want = enc.encode_ordinary(texts[doc_id] or "") if doc_id in texts and doc_id is not None else ids
            assert ids == want
            for a, b in ((0, 1), (len(ids) // 3, len(ids) // 3 + 11), (len(ids) - 2, len(ids) + 5), (5, 5)):
                assert repair.read_document(row, i, max(a, 0), b).tolist() == ids[max(a, 0) : max(b, 0)]
            seen.append(doc_id)
    return seen


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shards = repair.query(spark, sf)
    assert sorted(check_round_trip(shards, {r["doc_id"]: r["text"] for r in docs.collect()})) == sorted(r["doc_id"] for r in docs.collect())
    total = shards.selectExpr("sum(n_ids) a", "sum(n_symbols) b", "sum(n_rules) c").first()
    assert total["b"] + 2 * total["c"] < 0.8 * total["a"]


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs):
    seen = check_round_trip(repair.shards(odd_docs, shard_tokens=3000), {r["doc_id"]: r["text"] for r in odd_docs.collect()})
    assert sorted(seen, key=str) == sorted((r["doc_id"] for r in odd_docs.collect()), key=str)
    assert repair.shards(no_docs).count() == 0


def test_runs_of_one_id():
    for n in (8, 15, 16, 17, 100_001):
        ids = np.full(n, 3)
        symbols, starts, rules, lengths = repair.compress(ids, np.array([0]), first=10)
        assert repair.decode(symbols, rules, lengths, first=10).tolist() == ids.tolist()
        assert len(symbols) <= 30 and (n < 16 or rules[0].tolist() == [3, 3])
    ids, starts = np.array([1, 1, 1, 2, 1, 1, 1, 1] * 50), np.arange(0, 400, 4)
    symbols, at, rules, lengths = repair.compress(ids, starts, first=10)
    assert repair.decode(symbols, rules, lengths, first=10).tolist() == ids.tolist()
    for k, s in enumerate(at):  # document by document
        part = symbols[s : at[k + 1] if k + 1 < len(at) else None]
        assert repair.decode(part, rules, lengths, first=10).tolist() == ids[4 * k : 4 * k + 4].tolist()


def test_repeated_text_is_compressed():
    ids = tokens.encode(tokens.encoder(repair.VOCABULARY), "na " * 100_000)
    symbols, _, rules, lengths = repair.compress(ids, np.array([0]))
    assert len(symbols) + len(rules) < 60, (len(symbols), len(rules))
    assert repair.decode(symbols, rules, lengths).tolist() == ids.tolist()


def repeats(symbols, starts):
    """Counts of the pairs left, pairs in a run of one symbol without overlap."""
    found, begins = collections.Counter(), set(np.asarray(starts).tolist())
    i = 1
    while i < len(symbols):
        if i in begins:
            i += 1
            continue
        a, b = int(symbols[i - 1]), int(symbols[i])
        found[a, b] += 1
        i += 2 if a == b and i + 1 < len(symbols) and i + 1 not in begins and symbols[i + 1] == a else 1
    return found


def test_no_frequent_pair_is_left(spark, sf):
    enc = tokens.encoder(repair.VOCABULARY)
    parts = [tokens.encode(enc, r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    sizes = np.array([len(p) for p in parts])
    ids = np.concatenate(parts)
    symbols, starts, rules, lengths = repair.compress(ids, np.cumsum(sizes) - sizes)
    assert max(repeats(symbols, starts).values()) < repair.MIN_COUNT
    assert repair.decode(symbols, rules, lengths).tolist() == ids.tolist()


def plain_repair(ids, starts, first):
    """Re-Pair by the book: the most frequent pair (least code on ties) is replaced everywhere, one pair a round."""
    bounds = [*starts, len(ids)]
    docs = [list(map(int, ids[a:b])) for a, b in zip(bounds, bounds[1:])]
    rules = []
    while True:
        found = collections.Counter()
        for d in docs:
            i = 0
            while i + 1 < len(d):
                found[d[i], d[i + 1]] += 1
                i += 2 if i + 2 < len(d) and d[i] == d[i + 1] == d[i + 2] else 1
        if not found or max(found.values()) < 2:
            return docs, rules
        pair = min(found, key=lambda p: (-found[p], p[1] << 32 | p[0]))
        for k, d in enumerate(docs):
            out, i = [], 0
            while i < len(d):
                if i + 1 < len(d) and (d[i], d[i + 1]) == pair:
                    out.append(first + len(rules))
                    i += 2
                else:
                    out.append(d[i])
                    i += 1
            docs[k] = out
        rules.append(pair)


def test_size_against_plain_repair(spark, sf):
    """Many pairs a round cost little: symbols and two ids a rule, against one pair a round."""
    enc = tokens.encoder(repair.VOCABULARY)
    parts = [tokens.encode(enc, r["text"] or "")[:150] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    ids = np.concatenate(parts)
    docs, plain = plain_repair(ids, starts, repair.IDS)
    symbols, _, rules, lengths = repair.compress(ids, starts)
    assert repair.decode(symbols, rules, lengths).tolist() == ids.tolist()
    assert len(symbols) + 2 * len(rules) <= 1.03 * (sum(map(len, docs)) + 2 * len(plain))


def test_random_sequences_round_trip_to_the_end():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        ids = rng.integers(0, 2 + seed % 4, int(rng.integers(0, 300)))
        starts = np.unique(np.concatenate(([0], rng.integers(0, len(ids) + 1, 4)))) if len(ids) else np.array([0])
        starts = starts[starts < max(len(ids), 1)]
        symbols, at, rules, lengths = repair.compress(ids, starts, first=10)
        assert repair.decode(symbols, rules, lengths, first=10).tolist() == ids.tolist()
        assert max(repeats(symbols, at).values(), default=0) < 2
        bounds = [*at, len(symbols)]
        for k, s in enumerate(starts):
            want = ids[s : starts[k + 1] if k + 1 < len(starts) else None].tolist()
            assert repair.decode(symbols[bounds[k] : bounds[k + 1]], rules, lengths, first=10).tolist() == want


def test_shard_names_are_unique(spark, odd_docs):
    twice = odd_docs.unionByName(odd_docs).unionByName(odd_docs.filter("doc_id is null"))
    names = [r["shard"] for r in repair.shards(twice, shard_tokens=300).select("shard").collect()]
    assert len(names) == len(set(names)) > 3


def test_pairs_are_ordered_alike_with_and_without_room():
    """Packed with their positions, or sorted indirectly where 63 bits don't hold both: rising codes, positions rising in each."""
    rng = np.random.default_rng(3)
    for top, number in ((5, 5), (60_000, 60_000), (60_000, 1 << 30), (1 << 31, 1 << 31)):
        seq = rng.integers(0, top, 5000).astype("<i4")
        seq[::7] = seq[0]
        pair = np.ndarray((len(seq) - 1,), "<i8", seq, 0, (4,))
        at = np.flatnonzero(rng.random(len(pair)) < 0.8)
        codes, place = repair._ordered(pair, at, number)
        order = np.argsort(pair[at], kind="stable")
        assert codes.tolist() == pair[at][order].tolist() and place.tolist() == at[order].tolist()


def test_no_pair_crosses_a_document():
    ids = np.array([1, 2] * 40)
    symbols, starts, rules, lengths = repair.compress(ids, np.arange(0, 80, 2) + 1 - 1, first=10)
    assert len(starts) == 40 and len(symbols) == 40 and len(rules) == 1  # one pair a document
    symbols, starts, rules, _ = repair.compress(ids[1:-1], np.arange(0, 78, 2), first=10)
    assert rules.tolist() == [[2, 1]]
    symbols, starts, rules, _ = repair.compress(ids, np.arange(80), first=10)
    assert len(rules) == 0 and starts.tolist() == list(range(80))
    symbols, starts, _, _ = repair.compress(np.zeros(0, np.int64), np.array([0, 0]), first=10)
    assert len(symbols) == 0 and starts.tolist() == [0, 0]
