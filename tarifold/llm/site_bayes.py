"""Quality classifier: document evidence combined with hierarchical empirical Bayes.

1. A logistic model over text features, fitted by Newton steps on at most
   FIT_ROWS labelled documents, gives each document's evidence (log-odds).
2. One grouped aggregation turns the evidence of all documents into counts and
   probability sums per host and path. Where source is a URL these are its host
   and first path segment; otherwise the source itself and the language.
3. Hosts are shrunk towards the global rate, paths towards their host. The
   prior strengths are method-of-moments estimates from the same table, so a
   sparse site says little and a rich one speaks for itself. A document's own
   evidence is taken out of its site's sums before they become its prior.
4. posterior log-odds = evidence + logit(path rate) - logit(global rate); a
   document stays where the posterior is at least KEEP.

Defined results for odd input:

* null, empty and blank texts: features of the empty text, judged like any other;
* very long texts: features cover the whole text;
* null source or language: a site of their own, named "";
* null doc_id: judged, id null; never used for fitting;
* repeated rows: every row is judged, and counts in its site;
* no labels, or labels of one class: evidence 0, every document has the rate
  0.5 and stays; empty table: empty result;
* extra columns are ignored (and carried by keep_good, dotted names too).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifold.llm.common import columns_of, join_lookup, stash, table
from tarifold.llm.features import FIT_ROWS, NAMES, labelled_features, text_features

#: Least posterior of a document that stays.
KEEP = 0.25
RIDGE = 1.0


@dataclass(frozen=True)
class Logistic:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def log_odds(self, text: Column) -> Column:
        feature = text_features(text)
        return sum((feature[k] * F.lit(w) for k, w in zip(self.names, self.weights)), F.lit(self.bias))


def fit_logistic(x: np.ndarray, y: np.ndarray, names: list[str], ridge: float = RIDGE) -> Logistic:
    """Ridge logistic regression by Newton steps on standardised, clipped features."""
    if len(y) == 0 or y.min() == y.max():
        return Logistic(tuple(names), (0.0,) * len(names), 0.0)
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([np.clip((x - mean) / sd, -30, 30), np.ones(len(y))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * len(names) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / sd
    return Logistic(tuple(names), tuple(map(float, slope)), float(w[-1] - slope @ mean))


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str, fit_rows: int = FIT_ROWS) -> Logistic:
    frame = labelled_features(spark, docs, sf_dir, "quality", fit_rows).toPandas()
    return fit_logistic(frame[NAMES].to_numpy(float), frame["label"].to_numpy(float), NAMES)


URL_HOST, URL_PATH = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)"


def site_columns(source: Column, lang: Column) -> list[Column]:
    """host and section of a document: of a URL its host and first path segment, of other sources the source and the language."""
    name = F.coalesce(source.cast("string"), F.lit(""))
    host = F.regexp_extract(name, URL_HOST, 1)
    section = F.when(host != "", F.regexp_extract(name, URL_PATH, 1)).otherwise(F.coalesce(lang.cast("string"), F.lit("")))
    return [F.coalesce(F.nullif(F.lower(host), F.lit("")), name).alias("host"), section.alias("section")]


def clipped(model: Logistic, text: Column) -> Column:
    return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), model.log_odds(text)))


def evidence(docs: DataFrame, model: Logistic) -> DataFrame:
    """doc_id, host, section and the clipped document log-odds, one row per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *site_columns(F.col("source"), F.col("lang")), clipped(model, F.col("text")).alias("evidence"))


def _probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _strength(rate: Column, centre: Column, n: Column) -> Column:
    """Method-of-moments strength of a Beta prior around centre, in pseudo-documents."""
    spread = F.sum(n * F.pow(rate - centre, 2)) / F.sum(n)
    within = F.sum(centre * (1 - centre)) / F.sum(n)
    between = F.greatest(spread - within, F.lit(1e-6))
    level = F.sum(n * centre * (1 - centre)) / F.sum(n)
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), level / between - 1))


@dataclass(frozen=True)
class Priors:
    """The global rate and the strengths of the host and path priors, in pseudo-documents."""

    base: float
    k_host: float
    k_path: float

    def rates(self, own: Column | None = None) -> tuple[Column, Column]:
        """Host and path rate from a site's sums; own: the probability of the one document to leave out."""
        less, out = (F.lit(0), F.lit(0.0)) if own is None else (F.lit(1), own)
        host = (F.greatest(F.lit(0.0), F.col("host_good") - out) + self.k_host * self.base) / (F.col("host_n") - less + self.k_host)
        path = (F.greatest(F.lit(0.0), F.col("good") - out) + self.k_path * host) / (F.col("n") - less + self.k_path)
        return host, path


def site_sums(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """n, good, host_n and host_good of each (host, section), and the priors.

    All statistics are grouped aggregates; only the two strengths and the
    global rate, three numbers, visit the driver.
    """
    p = _probability(F.col("evidence"))
    paths = stash(scored.groupBy("host", "section").agg(F.count("*").alias("n"), F.sum(p).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    base = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    n, rate = F.col("host_n"), F.col("host_good") / F.col("host_n")
    k_host = hosts.agg(_strength(rate, F.lit(base), n).alias("k")).first()["k"] or 1.0
    both = stash(paths.join(hosts, "host"), "sites")
    host_rate, _ = Priors(base, k_host, 0.0).rates()
    k_path = both.agg(_strength(F.col("good") / F.col("n"), host_rate, F.col("n")).alias("k")).first()["k"] or 1.0
    return both, Priors(base, k_host, k_path)


def posterior(scored: DataFrame, sums: DataFrame, priors: Priors) -> DataFrame:
    """Scored documents (host, section, evidence) with host_rate, path_rate, both without the document itself, and the posterior of being good."""
    host, path = priors.rates(_probability(F.col("evidence")))
    joined = join_lookup(scored, sums, ["host", "section"]).withColumns({"host_rate": host, "path_rate": path})
    shift = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - F.lit(math.log(priors.base / (1 - priors.base)))
    return joined.withColumn("posterior", _probability(F.col("evidence") + shift)).drop("n", "good", "host_n", "host_good")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: float = KEEP, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose posterior is at least keep, columns as they came.

    The model is fitted on the whole documents table of sf_dir. The text is
    scored twice, for the sites' sums and for the decision: the one way to score
    it once is to write all texts again with their score, which takes the input's
    size on disk for as long as the result may be read. It is never shuffled.
    """
    model = fit(spark, table(spark, sf_dir, "documents"), sf_dir, fit_rows)
    scored = docs.select(*site_columns(F.col("source"), F.col("lang")), clipped(model, F.col("text")).alias("evidence"), F.struct(*columns_of(docs)).alias("row"))
    sums, priors = site_sums(scored.drop("row"))
    # the evidence is a column below the join: there the expressions its features share are evaluated once, in a filter they are not
    return posterior(scored, sums, priors).filter(F.col("posterior") >= keep).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the documents that stay, with evidence, site rates and posterior."""
    docs = table(spark, sf_dir, "documents")
    scored = stash(evidence(docs, fit(spark, docs, sf_dir)), "evidence")
    return posterior(scored, *site_sums(scored)).filter(F.col("posterior") >= KEEP).select("doc_id", "host", "section", "evidence", "host_rate", "path_rate", "posterior")
