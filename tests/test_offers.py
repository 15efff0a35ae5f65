from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tarifold import schemas, storage
from tarifold.operators import offers

ITEMS = [
    ("i1", "s1", "s", ("msk", "k9", "A", "8500.00", "10", "RUB"), ["x"]), ("i2", "s1", "s", ("", None, "B", "", "3", None), None),
    ("i3", "s1", "s", ("nope", "spb_dc", "C", "1", "1", "RUB"), [offers.BLOCKED]), ("i4", "s1", "s", (None, None, "D", "2", "", "USD"), ["x"]),
]


@pytest.fixture
def store(spark, tmp_path):
    st = offers.Store(spark, str(tmp_path / "db"))
    st.append("warehouse_keys", spark.createDataFrame([(k, k, True) for k in ("msk_dc", "def_dc", "spb_dc")], schemas.WAREHOUSE_KEYS))
    now = datetime(2026, 1, 1, tzinfo=UTC)
    st.upsert("aliases", spark.createDataFrame([("s", "msk", "old", now), ("s", "__default__", "def_dc", now)], schemas.ALIASES), ["supplier_id", "supplier_warehouse_name"])
    st.upsert("aliases", spark.createDataFrame([("s", "msk", "msk_dc", now)], schemas.ALIASES), ["supplier_id", "supplier_warehouse_name"])
    st.open_snapshot("s1", "p")
    st.append("items", spark.createDataFrame(ITEMS, schemas.ITEMS))
    return st


def rows(df):
    return {r["canonical_item_id"]: (r["warehouse_key"], None if r["price"] is None else float(r["price"]), r["qty"], r["currency"]) for r in df.collect()}


def test_alias_joins(spark, store):
    items, aliases = store.read("items"), store.read("aliases")
    assert rows(offers.offers_inner(items, aliases, "a")) == {"i1": ("msk_dc", 8500, 10, "RUB"), "i2": ("def_dc", None, 3, "RUB"), "i4": ("def_dc", 2, None, "USD")}
    assert {k: v[0] for k, v in rows(offers.offers_fallback(items, aliases, store.read("warehouse_keys"), "a")).items()} == {"i1": "msk_dc", "i3": "spb_dc"}
    assert rows(offers.offers_inner(items, aliases, "a", unreviewed=True))["i3"][0] == "__unreviewed__:nope"
    assert [r["id"] for r in offers.unmapped(items, aliases).collect()] == ["i3"]
    assert sorted(r["id"] for r in offers.live(items).collect()) == ["i1", "i2", "i4"]


def test_life_cycle(spark, store):
    with pytest.raises(offers.LifecycleError, match="sealed"):
        store.generate("s1", "v1", "a1")
    store.seal("s1")
    assert store.generate("s1", "v1", "a1") == 3
    first = sorted(map(str, store.read("offers").collect()))
    assert store.generate("s1", "v1", "a1") == 3  # replaced, with the same ids
    assert sorted(map(str, store.read("offers").collect())) == first
    with pytest.raises(offers.LifecycleError, match="version"):
        store.generate("s1", "v1", "a2")
    store.assert_integrity("a1")
    assert store.publish("a1", "me") == "a1"
    for again in (lambda: store.publish("a1"), lambda: store.generate("s1", "v1", "a1"), lambda: store.publish("zz"), lambda: store.assert_integrity("zz")):
        with pytest.raises(offers.LifecycleError):
            again()
    store.switch_pointer("a1", at=datetime(2026, 1, 1, tzinfo=UTC))
    assert store.current_artifact() == "a1"
    assert store.current_artifact("staging") is None
    assert [r["warehouse_key"] for r in store.offers_by_sku("a1", "A").collect()] == ["msk_dc"]
    store.generate("s1", "v2", "a3", resolution="fallback")
    store.switch_pointer("a3", at=datetime(2026, 1, 2, tzinfo=UTC))
    assert store.current_artifact() == "a3"
    assert store.read("pointers").filter("valid_to is null").count() == 1
    store.register_sql()
    assert spark.sql("select current_artifact('production', 'default')").first()[0] == "a3"
    assert spark.sql("select warehouse_key from offers_by_sku('a1', 'A')").first()[0] == "msk_dc"


def test_refusals(spark, tmp_path):
    st = offers.Store(spark, str(tmp_path / "e"))
    st.open_snapshot("s")
    st.seal("s")
    with pytest.raises(offers.LifecycleError, match="items"):
        st.generate("s", "v", "a")
    st.expire(-1)
    assert st.read("snapshots").isEmpty()
    st.backfill()
    with storage.exclusive(str(tmp_path / "l" / "x")), pytest.raises(FileExistsError), storage.exclusive(str(tmp_path / "l" / "x")):
        pass


def test_relational_helpers(spark):
    frame = spark.createDataFrame([(1, None), (1, None), (1, 2), (1, 2)], "a int, b int")
    assert offers.duplicates(frame, ["a", "b"]).first()[0] == 2
    log = spark.createDataFrame([("k", "a", "2026-01-01"), ("k", "b", "2026-01-03")], "key string, artifact_id string, t string").select("key", "artifact_id", F.to_timestamp("t").alias("valid_from"))
    pointers = offers.pointer_intervals(log, ["key"], "valid_from", "artifact_id")
    probes = spark.createDataFrame([("k", "2025-12-31"), ("k", "2026-01-01"), ("k", "2026-01-02"), ("k", "2026-01-03"), ("z", "2026-01-03")], "key string, t string").select("key", F.to_timestamp("t").alias("at"))
    got = {(r["key"], str(r["at"])[:10]): r["artifact_id"] for r in offers.pointers_as_of(probes, pointers, ["key"], "at").collect()}
    assert got == {("k", "2025-12-31"): None, ("k", "2026-01-01"): "a", ("k", "2026-01-02"): "a", ("k", "2026-01-03"): "b", ("z", "2026-01-03"): None}
    assert offers.current_pointers(pointers, "2026-01-02", ["key"]).first()["artifact_id"] == "a"


def test_reprocessing(spark, store):
    from tarifold.operators import reports

    items = store.read("items")
    again = reports.reprocessed(items, "s2", supplier_id="s")
    assert reports.content_checksum(items).first() == reports.content_checksum(again).first()
    assert again.select("id").intersect(items.select("id")).isEmpty()
    marked = spark.createDataFrame([("i1",)], "item_id string")
    assert reports.reprocessed(items, "s3", signatures=marked).count() == 1
    assert reports.content_checksum(items.filter("id <> 'i1'")).first() != reports.content_checksum(items).first()
    states = spark.createDataFrame([("s", "blocked")], "supplier_id string, state string")
    flags = {r["id"]: r["quality_flags"] for r in reports.reviewed_flags(items, marked, states).collect()}
    assert flags["i1"] == ["x", "needs_review", offers.BLOCKED] and flags["i2"] == [offers.BLOCKED] and flags["i3"] == [offers.BLOCKED]


def test_one_lock_a_table(spark, store):
    """Two writers of one table wait for each other, so no update is lost; artifacts of one version race and one wins."""
    from concurrent.futures import ThreadPoolExecutor

    store.seal("s1")
    others = [offers.Store(spark, store.root) for _ in range(4)]

    def add(k):
        others[k].append("snapshots", spark.createDataFrame([(f"t{k}", "p", "open", None, None)], schemas.SNAPSHOTS))
        others[k].switch_pointer("a1", channel=f"c{k}") if k < 2 else None
        return True

    store.generate("s1", "v1", "a1")
    with ThreadPoolExecutor(4) as pool:
        assert all(pool.map(add, range(4)))
    assert {r["snapshot_id"] for r in store.read("snapshots").collect()} == {"s1", "t0", "t1", "t2", "t3"}
    assert {r["channel"] for r in store.read("pointers").collect()} == {"c0", "c1"}

    def make(k):
        try:
            return others[k].generate("s1", "v9", f"x{k}")
        except offers.LifecycleError:
            return None

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(make, range(2)), key=str) == [3, None]


def test_lookup_reads_one_artifact(spark, store):
    store.seal("s1")
    store.generate("s1", "v1", "a1")
    store.generate("s1", "v2", "a2")
    assert all("/offers/a1-" in f for f in store.read_offers("a1").inputFiles()) and store.read_offers("a1").count() == 3
    assert store.read_offers("none").count() == 0


def test_publish_curated_is_idempotent(spark, store):
    one = store.publish_curated("s1", by="me")
    assert store.publish_curated("s1") == one != store.publish_curated("s1", "v2")
    row = store.read("artifacts").filter(F.col("artifact_id") == one).first()
    assert row["status"] is None and row["published_by"] == "me" and row["published_at"] is not None


def test_pointer_behind_an_ended_one(spark):
    """a is open since 1 January, b held on the 2nd only: on the 4th it is a again."""
    day = lambda n: datetime(2024, 1, n)
    pointers = spark.createDataFrame([("k", "a", day(1), None), ("k", "b", day(2), day(3)), ("k", "c", day(10), day(9)), ("j", "d", day(2), day(20))], "k string, artifact_id string, valid_from timestamp, valid_to timestamp")
    probes = spark.createDataFrame([(1, "k", day(1)), (2, "k", day(2)), (3, "k", day(3)), (4, "k", day(4)), (5, "k", day(25)), (6, "j", day(1)), (7, "j", day(19)), (8, "j", day(20)), (9, "z", day(5)), (10, "k", None), (4, "k", day(4))], "n int, k string, at timestamp")
    got = [(r["n"], r["artifact_id"]) for r in offers.pointers_as_of(probes, pointers, ["k"], "at").collect()]
    assert dict(got) == {1: "a", 2: "b", 3: "a", 4: "a", 5: "a", 6: None, 7: "d", 8: None, 9: None, 10: None}
    assert len(got) == 11
    for lo, hi in [(0, 0), (0, 7), (1, 6), (5, 12), (4, 3), (2, 15)]:
        blocks = spark.range(1).select(offers._blocks(F.lit(lo), F.lit(hi), 6).alias("b")).first()["b"]
        assert sorted(n for b in blocks for n in range(b["block"] << b["level"], b["block"] + 1 << b["level"])) == list(range(lo, hi + 1))


def test_as_of_follows_the_rows_not_the_pairs(spark, monkeypatch):
    """Many bins, two keys, overlapping and open pointers, ties, null keys and times: as by brute force, and no join compares times."""
    import random
    import re

    monkeypatch.setattr(offers, "BIN_ROWS", 20)
    monkeypatch.setattr(offers, "SORT_ROWS", 300)
    rng = random.Random(5)
    moment = lambda: datetime.fromtimestamp(1_700_000_000 + rng.randrange(5000), UTC)
    length = [None, 0, 3, 40, 700, 4000]
    pointers = [(rng.choice(["k", "j", None]), f"a{n}", t := moment(), None if (d := rng.choice(length)) is None else datetime.fromtimestamp(t.timestamp() + d, UTC)) for n in range(400)]
    pointers = [p for p in pointers if p[3] is not None or rng.random() < 0.2]
    probes = [(n, rng.choice(["k", "j", "k", None]), moment() if n % 50 else None) for n in range(600)]
    want = {}
    for n, k, t in probes:
        open_ = [(p[2], p[1]) for p in pointers if k is not None and p[0] == k and t is not None and p[2] <= t and (p[3] is None or p[3] > t)]
        want[n] = max(open_)[1] if open_ else None
    rows = spark.createDataFrame(pointers, "k string, artifact_id string, valid_from timestamp, valid_to timestamp")
    found = offers.pointers_as_of(spark.createDataFrame(probes, "n int, k string, at timestamp"), rows, ["k"], "at")
    got = [(r["n"], r["artifact_id"]) for r in found.collect()]
    assert dict(got) == want and len(got) == 600 and len(set(want.values())) > 100
    joins = re.findall(r"\n.*Join .*", found._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any("<" in j for j in joins)


def test_intervals_of_few_keys_make_many_partitions(spark, monkeypatch):
    """In bins of time, gaps between them and null times and keys too: as one window a key gives them."""
    log = spark.createDataFrame([(k, n, None if n % 40 == 0 else datetime(2024, 1, 1 + n % 3 + 20 * (n % 7 == 0), n % 24, n % 11)) for k in ("k", "j", None) for n in range(200)], "k string, n int, t timestamp")
    want = sorted(map(str, offers.pointer_intervals(log, ["k"], "t", "n").collect()))
    monkeypatch.setattr(offers, "BIN_ROWS", 20)
    found = offers.pointer_intervals(log, ["k"], "t", "n")
    assert sorted(map(str, found.collect())) == want and found.columns == ["k", "n", "t", "valid_to"]
    assert "hashpartitioning(k#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "__bin" in plan


def test_a_failed_transaction_leaves_nothing(spark, store):
    store.seal("s1")
    with pytest.raises(offers.LifecycleError), store.transaction():
        store.generate("s1", "v1", "a1")
        store.switch_pointer("a1")
        store.publish("zz")
    assert store.read("artifacts").isEmpty() and store.read("offers").isEmpty() and store.current_artifact() is None
    with store.transaction():
        store.generate("s1", "v1", "a1")
    assert store.read_offers("a1").count() == 3
