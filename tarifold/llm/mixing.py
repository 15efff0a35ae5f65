"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes.

The tree is domain -> language -> source. A token budget flows down from the
root. Among the children of one node it is shared by weight; a child that
cannot use its share (capacity = MAX_EPOCHS times its tokens) takes what it can
and its siblings share the rest, before anything is left to the node's own
siblings: a node's budget never exceeds its capacity, so only a node all of
whose children are full passes a shortage upwards. The split is exact integer
water-filling in closed form (sort children by capacity over weight, prefix
sums), one window per level of the tree, with no iteration.

A leaf with budget a and t tokens takes a div t whole epochs, then the longest
prefix that fits a mod t of the seeded order of the next epoch. The prefix is
found in two steps, so that no leaf is ever ordered in one task: tokens per
hash bucket are summed, and only the bucket in which the prefix ends is ordered.

Defined results for odd input:

* null, empty and blank texts: no tokens; they follow their place in the
  order and cost nothing, and come with every whole epoch;
* very long texts: counted whole, taken or left whole;
* null lang or source: the leaf named ""; a source without a number: domain "d";
* null doc_id: ordered as "" and taken or left like others;
* ties and repeated rows (equal doc_id): one place in the order, taken only if all fit;
* unknown language: weight 1; weight 0: nothing is taken, its share is its siblings';
* empty table: empty result; extra columns are ignored (and carried by mix, dotted names too).

Tokens are white-space words in op3 itself, so that its SQL form can count them
too; the pipeline's stage counts byte-pair tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarifold.llm.common import columns_of, join_lookup, stash, table, words

DOMAINS = 4
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
SEED = 17
MAX_EPOCHS = 3
#: Token budget as a share of the corpus, in percent.
BUDGET_PERCENT = 60
BUCKET_DIGITS = 3

LEAF = ["domain", "language", "site"]
_BIG = "decimal(38,0)"


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(name == k, w).otherwise(out)
    return out.cast("long")


def leaf_columns() -> list[Column]:
    """domain, language and site of a documents row."""
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    number = F.regexp_extract(site, "([0-9]{1,9})$", 1)
    domain = F.when(number == "", "d").otherwise(F.concat(F.lit("d"), (F.nullif(number, F.lit("")).cast("long") % DOMAINS).cast("string")))
    return [domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), site.alias("site")]


def share(children: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Split each parent's budget over its children: adds the column given.

    children: parent's columns, order (child's name), capacity, weight, budget.
    """
    c = children.filter("weight > 0")
    ranked = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), order) if parent else Window.partitionBy(F.lit(0)).orderBy(F.col("capacity") / F.col("weight"), order)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onward = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = c.withColumn("__used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("__left", F.sum("weight").over(onward))
    full = F.col("capacity").cast(_BIG) * F.col("__left").cast(_BIG) <= (F.col("budget") - F.col("__used")).cast(_BIG) * F.col("weight").cast(_BIG)
    c = c.withColumn("__full", full)
    c = c.withColumn("__used", F.coalesce(F.sum(F.when(F.col("__full"), F.col("capacity"))).over(whole), F.lit(0)))
    c = c.withColumn("__left", F.sum(F.when(~F.col("__full"), F.col("weight"))).over(whole))
    part = F.expr("(cast(budget - __used as decimal(19,0)) * cast(weight as decimal(18,0))) div cast(__left as decimal(19,0))")
    given = F.when(F.col("__full"), F.col("capacity")).otherwise(part)
    return c.withColumn("given", given).drop("__used", "__left", "__full")


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, language_weights: dict[str, int] = LANGUAGE_WEIGHTS) -> DataFrame:
    """Budget `given` of each leaf. leaves: LEAF and tokens; budget: tokens of the root, of its tokens column.

    A node can use what its children of some weight can: one of weight 0 adds nothing to it.
    """
    own = leaves.withColumn("capacity", F.col("tokens") * max_epochs).withColumn("weight", F.lit(1).cast("long"))
    usable = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))), F.lit(0)).alias("capacity")
    languages = own.groupBy("domain", "language").agg(usable).withColumn("weight", _weight(F.col("language"), language_weights))
    domains = languages.groupBy("domain").agg(usable).withColumn("weight", _weight(F.col("domain"), domain_weights))
    root = leaves.agg(F.sum("tokens").alias("tokens")).select(budget.cast("long").alias("budget"))
    domains = share(domains.crossJoin(F.broadcast(root)), [], "domain").select("domain", F.col("given").alias("budget"))  # root is one row
    languages = share(languages.join(domains, "domain"), ["domain"], "language").select("domain", "language", F.col("given").alias("budget"))
    return share(own.join(languages, ["domain", "language"]), ["domain", "language"], "site").select(*LEAF, "tokens", "given")


def _place(epoch: Column, doc_id: Column) -> Column:
    """Place of a document in its leaf's seeded order of an epoch: hash, then id."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), name)), F.lit(":"), name)


def cutoffs(counted: DataFrame, budgets: DataFrame) -> DataFrame:
    """Whole epochs and last place taken of the next one, for each leaf.

    counted: LEAF, doc_id, tokens, one row per document.
    """
    plan = stash(budgets.select(*LEAF, F.expr("case when tokens > 0 then given div tokens else 0 end").alias("epochs"), F.expr("case when tokens > 0 then given % tokens else 0 end").alias("rest")), "plan")
    placed = join_lookup(counted, plan, LEAF, "inner").withColumn("place", _place(F.col("epochs"), F.col("doc_id"))).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = stash(placed.groupBy(*LEAF, "rest", "bucket").agg(F.sum("tokens").alias("tokens")), "buckets")
    upto = Window.partitionBy(*LEAF).orderBy("bucket")
    run = sums.withColumn("upto", F.sum("tokens").over(upto))
    whole = run.filter("upto <= rest").groupBy(*LEAF).agg(F.max("bucket").alias("done"), F.max("upto").alias("had"))
    edge = run.filter("upto > rest").groupBy(*LEAF).agg(F.min("bucket").alias("bucket"))
    edge = stash(edge.join(whole, LEAF, "left").select(*LEAF, "bucket", F.coalesce("had", F.lit(0)).alias("had")), "edge")
    inside = join_lookup(placed, edge, [*LEAF, "bucket"], "inner")
    inside = inside.withColumn("upto", F.col("had") + F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("place")))  # peers count together
    last = inside.filter("upto <= rest").groupBy(*LEAF).agg(F.max("place").alias("place"))
    ends = plan.join(whole, LEAF, "left").join(last, LEAF, "left")
    # "~" sorts after every hexadecimal digit: the bucket's end
    return stash(ends.select(*LEAF, "epochs", F.coalesce("place", F.concat("done", F.lit("~")), F.lit("")).alias("cutoff")), "cutoffs")


def select(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows (with LEAF and doc_id) once per epoch in which they are taken; adds epoch."""
    joined = join_lookup(rows, ends, LEAF, "inner")
    copies = F.col("epochs") + (_place(F.col("epochs"), F.col("doc_id")) <= F.col("cutoff")).cast("long")
    return joined.withColumn("__copies", copies).filter("__copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1))).drop("__copies", "epochs", "cutoff")


def counted_documents(docs: DataFrame, tokens: Callable[[Column], Column] = words) -> DataFrame:
    return docs.select(*leaf_columns(), F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("tokens"))


def _ends(docs: DataFrame, percent: int, max_epochs: int, tokens: Callable[[Column], Column] = words, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, language_weights: dict[str, int] = LANGUAGE_WEIGHTS) -> tuple[DataFrame, DataFrame]:
    counted = stash(counted_documents(docs, tokens), "counted")
    leaves = stash(counted.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), "leaves")
    budget = F.expr(f"tokens * {percent} div 100")
    return counted, cutoffs(counted, leaf_budgets(leaves, budget, max_epochs, domain_weights, language_weights))


def mix(docs: DataFrame, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, tokens: Callable[[Column], Column] = words, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, language_weights: dict[str, int] = LANGUAGE_WEIGHTS) -> DataFrame:
    """The rows of docs taken, once per epoch, columns as they came. The text is never shuffled.

    tokens: the count that budgets are made of; words, or byte-pair tokens of some vocabulary.
    """
    _, ends = _ends(docs, percent, max_epochs, tokens, domain_weights, language_weights)
    names = {c: f"__leaf_{c}" for c in LEAF}
    renamed = ends.select(*(F.col(c).alias(n) for c, n in names.items()), F.col("epochs").alias("__epochs"), F.col("cutoff").alias("__cutoff"))
    tagged = docs.select("*", *(c.alias(names[k]) for k, c in zip(LEAF, leaf_columns())))
    joined = join_lookup(tagged, renamed, list(names.values()), "inner")
    copies = F.col("__epochs") + (_place(F.col("__epochs"), F.col("doc_id")) <= F.col("__cutoff")).cast("long")
    return joined.withColumn("__n", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)))).select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document taken from the whole table, with its leaf and epoch."""
    counted, ends = _ends(table(spark, sf_dir, "documents"), BUDGET_PERCENT, MAX_EPOCHS)
    return select(counted, ends).select("doc_id", *LEAF, "tokens", "epoch")


def _share_sql(name: str, source: str, parent: str, order: str, keep: str) -> str:
    over = f"partition by {parent}" if parent else ""
    ranked = f"{over} order by capacity::double / weight, {order}"
    return f"""
{name}_a as (select *, coalesce(sum(capacity) over ({ranked} rows between unbounded preceding and 1 preceding), 0)::hugeint as used,
    sum(weight) over ({ranked} rows between current row and unbounded following)::hugeint as togo from {source} where weight > 0),
{name}_b as (select * exclude (used, togo), capacity::hugeint * togo <= (budget - used)::hugeint * weight as isfull from {name}_a),
{name}_c as (select *, coalesce(sum(case when isfull then capacity end) over ({over}), 0)::hugeint as used, (sum(case when not isfull then weight end) over ({over}))::hugeint as togo from {name}_b),
{name} as (select {keep}, case when isfull then capacity else ((budget - used)::hugeint * weight // togo)::bigint end as given from {name}_c)"""


def oracle() -> str:
    """The same mixture in DuckDB SQL, by plain prefix sums over each leaf."""
    case = lambda col, w: f"case {col} " + " ".join(f"when '{k}' then {v}" for k, v in w.items()) + " else 1 end"
    digits = r"regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)"
    return (
        f"""with docs as (select doc_id, case when {digits} = '' then 'd' else 'd' || (try_cast({digits} as bigint) % {DOMAINS})::varchar end as domain,
    coalesce(lang, '') as language, coalesce(source, '') as site, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 0)::bigint as tokens from documents),
leaves as (select domain, language, site, sum(tokens)::bigint as tokens, sum(tokens)::bigint * {MAX_EPOCHS} as capacity, 1 as weight from docs group by all),
langs0 as (select domain, language, sum(capacity)::bigint as capacity, {case("language", LANGUAGE_WEIGHTS)} as weight from leaves group by domain, language),
doms0 as (select domain, coalesce(sum(capacity) filter (weight > 0), 0)::bigint as capacity, {case("domain", DOMAIN_WEIGHTS)} as weight, (select sum(tokens)::bigint * {BUDGET_PERCENT} // 100 from leaves) as budget from langs0 group by domain),"""
        + _share_sql("doms", "doms0", "", "domain", "domain")
        + ",\nlangs1 as (select l.*, d.given as budget from langs0 l join doms d using (domain)),"
        + _share_sql("langs", "langs1", "domain", "language", "domain, language")
        + ",\nsites1 as (select l.*, d.given as budget from leaves l join langs d using (domain, language)),"
        + _share_sql("sites", "sites1", "domain, language", "site", "domain, language, site, tokens")
        + f""",
plan as (select domain, language, site, case when tokens > 0 then given // tokens else 0 end as epochs, case when tokens > 0 then given % tokens else 0 end as rest from sites),
placed as (select d.*, epochs, rest, md5('{SEED}:' || epochs::varchar || ':' || coalesce(doc_id::varchar, '')) || ':' || coalesce(doc_id::varchar, '') as place from docs d join plan using (domain, language, site)),
taken as (select *, epochs + (sum(tokens) over (partition by domain, language, site order by place range between unbounded preceding and current row) <= rest)::bigint as copies from placed)
select doc_id, domain, language, site, tokens, e.epoch::bigint as epoch from taken, lateral (select unnest(range(copies)) as epoch) e"""
    )
