"""URL filters by link-graph propagation.

Hosts are nodes. Edges are hyperlinks between hosts, weighted by their number,
and structural links of weight 1, both ways, between a host and its parent
domain. Trust is a personalised PageRank from trusted seeds along the edges;
distrust is the same from blocked seeds along the reversed edges (who links to
a blocked host is suspect). Both run in one loop over one edge table, in fixed
point (integers), so that results don't depend on the order of additions. It
iterates from the seeds' own share upwards: ranks only grow, and what is still
to come, over all hosts, is at most FOLLOW^n / (1 - FOLLOW^n) of the growth in
the last n rounds, so it stops when that is negligible against BLOCK_AT.

Only the host graph iterates: pages are read once for it, edges are aggregated
once, and each round is a join and an aggregation of ranks by host. The
lineage is cut in the shared folder every few rounds.

Defined results for odd input:

* null, empty or unparsable url: host null, no ranks, allowed;
* null, empty or very long html: no links, or all links of the whole page;
* repeated rows: counted and returned each; null page_id: returned, id null;
* ties: trust wins, the page stays allowed; no seeds: all ranks 0, all allowed;
* hosts that nothing links to and pages without links: rank from seeds only;
* rank of hosts without outgoing edges is not passed on;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm.common import join_lookup, stash, table

#: Seeds of the query, as patterns over host names: trusted and blocked.
TRUSTED, BLOCKED = "^www[.]", "^m[.].*[.]com$"
#: Share (in percent) of a rank that follows links, mass of a seed, rounds between cuts of the lineage.
FOLLOW, MASS, CUT_EVERY = 85, 1_000_000_000, 4
#: Least distrust of a blocked host.
BLOCK_AT = MASS // 1000
#: Growth of all ranks together, between two cuts, at which they have converged.
NEGLIGIBLE = BLOCK_AT // 1000

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"
LINK = "(href|src)[ ]*=[ ]*[\"']?(https?:)?//([^/?#:@\"'<> ]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url.cast("string"), HOST, 2)), F.lit(""))


def parent_of(host: Column) -> Column:
    """The host without its first label, if three labels or more are there."""
    return F.nullif(F.regexp_extract(host, "^[^.]+[.]([^.]+[.].+)$", 1), F.lit(""))


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """src, dst and weight, one row for each pair of hosts; written once. parents: with the links to and from parent domains."""
    own = pages.select(host_of(F.col("url")).alias("src"), F.col("html").cast("string").alias("html")).filter("src is not null")
    links = own.select("src", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(3))).alias("dst")).select("src", F.lower("dst").alias("dst")).filter("src <> dst")
    counted = links.groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if not parents:
        return stash(counted, "edges")
    hosts = own.select(F.col("src").alias("host")).unionByName(counted.select(F.col("dst").alias("host"))).distinct()
    tree = hosts.select("host", parent_of(F.col("host")).alias("up")).filter("up is not null")
    both = tree.select(F.col("host").alias("src"), F.col("up").alias("dst")).unionByName(tree.select(F.col("up").alias("src"), F.col("host").alias("dst"))).withColumn("weight", F.lit(1).cast("long"))
    return stash(counted.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "edges")


#: Hosts that are seeds: a pattern over host names, or a table with a column host.
Seeds = str | DataFrame


def _listed(seeds: DataFrame) -> DataFrame:
    return seeds.select(F.lower(F.col("host").cast("string")).alias("host")).filter("host is not null").distinct()


def _marked(hosts: DataFrame, seeds: Seeds) -> DataFrame:
    return hosts.filter(F.col("host").rlike(seeds)) if isinstance(seeds, str) else hosts.join(_listed(seeds), "host", "left_semi")


def _start(edges: DataFrame, hosts: DataFrame, trusted: Seeds, blocked: Seeds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, the edges both ways with the total weight of their start, and what a seed gets in every round."""
    seeds = _marked(hosts, trusted).select(F.lit("trust").alias("kind"), "host").unionByName(_marked(hosts, blocked).select(F.lit("distrust").alias("kind"), "host"))
    seeds = stash(seeds.select("kind", "host", F.lit(MASS).cast("long").alias("rank")), "seeds")
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("dst"), "weight"))
    out = ways.groupBy("kind", "host").agg(F.sum("weight").alias("total"))
    ways = stash(ways.join(out, ["kind", "host"]), "ways")
    return seeds, ways, seeds.select("kind", "host", F.expr(f"rank * {100 - FOLLOW} div 100").alias("rank"))


def _round(rank: DataFrame, ways: DataFrame, base: DataFrame) -> DataFrame:
    moved = ways.join(rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.expr(f"(cast(rank as decimal(20,0)) * {FOLLOW} * cast(weight as decimal(15,0))) div (cast(total as decimal(15,0)) * 100)").alias("rank"))
    return moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank")).filter("rank > 0")


def _by_host(rank: DataFrame) -> DataFrame:
    pick = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0)).alias(kind)
    return rank.groupBy("host").agg(pick("trust"), pick("distrust"))


def converge(edges: DataFrame, hosts: DataFrame, trusted: Seeds = TRUSTED, blocked: Seeds = BLOCKED, negligible: int = NEGLIGIBLE) -> DataFrame:
    """host, trust and distrust of every host that has any, iterated until all ranks together grow by no more than negligible.

    It ends: a round is monotone and starts below its own result, so integer
    ranks never fall, and they are bounded.
    """
    _, ways, base = _start(edges, hosts, trusted, blocked)
    rank, before = base, None
    while True:
        for _ in range(CUT_EVERY):
            rank = _round(rank, ways, base)
        rank = stash(rank, "rank")
        now = rank.agg(F.coalesce(F.sum(F.col("rank").cast("decimal(28,0)")), F.lit(0))).first()[0]
        if before is not None and now - before <= negligible:
            return _by_host(rank)
        before = now


def judge(pages: DataFrame, ranks: DataFrame, blocked: Seeds = BLOCKED, block_at: int = BLOCK_AT) -> DataFrame:
    """Every page with its host's ranks and whether the host is allowed."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"))
    joined = join_lookup(own, ranks, ["host"])
    if isinstance(blocked, str):
        joined = joined.withColumn("__seed", F.col("host").rlike(blocked))
    else:
        joined = join_lookup(joined, _listed(blocked).withColumn("__seed", F.lit(True)), ["host"])
    trust, distrust = F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0))
    bad = F.coalesce("__seed", F.lit(False)) | ((distrust >= block_at) & (distrust > trust))
    return joined.select("page_id", "host", trust.alias("trust"), distrust.alias("distrust"), (~bad).alias("allowed"))


def _graph(pages: DataFrame, parents: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges and all hosts of the pages."""
    edges = host_edges(pages, parents)
    return edges, pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()


def filtered(pages: DataFrame, trusted: Seeds = TRUSTED, blocked: Seeds = BLOCKED, parents: bool = True) -> DataFrame:
    """Every page judged by its host's converged trust and distrust."""
    return judge(pages, stash(converge(*_graph(pages, parents), trusted, blocked), "ranks"), blocked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every page of the pages table, judged."""
    return filtered(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same propagation as a recursive query with the same end: every CUT_EVERY rounds the growth of all ranks is looked at."""
    host = f"nullif(lower(regexp_extract(url, '{HOST}', 2)), '')"
    link = LINK.replace("'", "''")
    part = MASS * (100 - FOLLOW) // 100
    return f"""with recursive own as (select page_id, {host} as host, html from pages),
links as (select host as src, lower(unnest(regexp_extract_all(html, '{link}', 3))) as dst from own where host is not null),
counted as (select src, dst, count(*) as weight from links where src <> dst group by all),
linked as (select host from own where host is not null union select dst from counted),
tree as (select host, nullif(regexp_extract(host, '^[^.]+[.]([^.]+[.].+)$', 1), '') as up from linked),
edges as materialized (select src, dst, sum(weight)::hugeint as weight from (select * from counted union all select host, up, 1 from tree where up is not null union all select up, host, 1 from tree where up is not null) group by src, dst),
hosts as (select host from own where host is not null union select src from edges union select dst from edges),
seeds as materialized (select 'trust' as kind, host from hosts where regexp_matches(host, '{TRUSTED}') union all select 'distrust', host from hosts where regexp_matches(host, '{BLOCKED}')),
ways0 as (select 'trust' as kind, src as host, dst, weight from edges union all select 'distrust', dst, src, weight from edges),
ways as materialized (select *, sum(weight) over (partition by kind, host)::hugeint as total from ways0),
r(k, kind, host, "rank", before, over) as (
    select 0, kind, host, {part}::hugeint, null::hugeint, false from seeds
    union all
    select k, kind, host, "rank", case when k % {CUT_EVERY} = 0 then total else before end, k % {CUT_EVERY} = 0 and coalesce(total - before <= {NEGLIGIBLE}, false) from (
        select *, sum("rank") over ()::hugeint as total from (
            select k, kind, host, sum("rank")::hugeint as "rank", any_value(before) as before from (
                select r.k + 1 as k, w.kind, w.dst as host, (r."rank" * {FOLLOW} * w.weight) // (w.total * 100) as "rank", r.before from ways w join r on w.kind = r.kind and w.host = r.host where not r.over
                union all select r.k + 1, r.kind, r.host, {part}::hugeint, r.before from r semi join seeds s on s.kind = r.kind and s.host = r.host where not r.over
            ) group by k, kind, host having sum("rank") > 0))),
ranks as (select host, coalesce(sum("rank") filter (kind = 'trust'), 0)::bigint as trust, coalesce(sum("rank") filter (kind = 'distrust'), 0)::bigint as distrust from r where over group by host)
select page_id, host, coalesce(trust, 0) as trust, coalesce(distrust, 0) as distrust,
    not (coalesce(regexp_matches(host, '{BLOCKED}'), false) or (coalesce(distrust, 0) >= {BLOCK_AT} and coalesce(distrust, 0) > coalesce(trust, 0))) as allowed from own left join ranks using (host)"""
