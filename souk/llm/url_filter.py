"""Operator 1: URL filters by rules and by trust that flows over host links.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule decides (block
before allow at equal length). Urls without a rule are judged by host: trust is personalised PageRank from
hosts whose ruled pages are allowed, over links source -> target; distrust runs the same way from blocked hosts
against the links' direction. A host's seed is the share of its pages that rules allow (block). A host whose distrust
exceeds its trust by more than a margin is blocked, every other host is allowed.

Links are absolute or protocol-relative addresses in the pages' html attributes; links inside one host are not edges.
Iterations run until no host's score can still move by more than a tolerance: the sum of all hosts' changes falls by the damping at
least each round, so what is still to come is bounded by it. Each is one join and one aggregation over the host edges.

Defined results: a null url, or one without ``://``, has host '' and path '', no rule, and is allowed; null html has no
links; repeated rows are judged row by row; only the id, url and html columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import drop_table, materialise

#: Share of a score that follows links, error left in any host's score, and distrust beyond trust that blocks a host.
DAMPING, TOLERANCE, MARGIN = 0.85, 1e-3, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src|action|cite|data)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path)."""
    url = F.coalesce(pages[url_col], F.lit(""))
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(pages[id_col].alias("page_id"), F.translate(F.regexp_extract(url, form, 1), _UPPER, _LOWER).alias("host"),
                        F.regexp_extract(url, form, 2).alias("path"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (host, path, verdict) that fit each host, longest first. Joined on host suffixes."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = hosts.select("host", F.explode(suffixes).alias("suffix")) \
        .join(rules.select(F.col("host").alias("suffix"), "path", "verdict"), "suffix")
    rule = F.concat("suffix", "path")
    best_first = F.struct((-F.length(rule)).alias("order"), (F.col("verdict") != "block").alias("late"), rule.alias("rule"), "path", "verdict")
    return fitting.groupBy("host").agg(F.array_sort(F.collect_set(best_first)).alias("rules"))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct (src, dst) host pairs of the pages' links to other hosts."""
    links_of = F.regexp_extract_all(F.coalesce(pages[html_col], F.lit("")), F.lit(_LINK), 1)
    host = F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    found = pages.select(F.translate(host, _UPPER, _LOWER).alias("src"), F.array_distinct(links_of).alias("to"))
    links = found.select("src", F.explode("to").alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return links.filter("src <> '' AND src <> dst").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score): fixed point of score = seed + damping * sum over in-edges of score / out-degree.

    ``seeds`` (host, seed); ``edges`` (src, dst), distinct. The seeds' own scale is kept: an unlinked host scores its seed.
    Stops when the sum of changes times damping / (1 - damping), all that later rounds can add up to, is within ``tolerance``."""
    shares = edges.join(edges.groupBy("src").agg((F.lit(damping) / F.count(F.lit(1))).alias("part")), "src")
    shares = materialise(shares, "op1-shares")
    now = materialise(seeds.select("host", F.col("seed").cast("double").alias("score")).filter("score > 0"), "op1-scores")
    if shares.isEmpty() or now.isEmpty():
        return now
    while True:
        sent = shares.join(now, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        new = sent.select(F.col("dst").alias("host"), F.col("got").alias("score")) \
            .unionByName(seeds.select("host", F.col("seed").cast("double").alias("score"))) \
            .groupBy("host").agg(F.sum("score").alias("score")).filter("score > 0")
        new = materialise(new, "op1-scores")
        change = new.join(now.withColumnRenamed("score", "old"), "host", "full") \
            .agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        drop_table(now)
        now = new
        if change * damping <= tolerance * (1 - damping):
            return now


def judge(pages: DataFrame, rules: DataFrame, margin: float = MARGIN, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    parts = url_parts(pages, id_col, url_col)
    fitting = host_rules(parts.select("host").distinct(), rules)
    best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    ruled = materialise(parts.join(fitting, "host", "left").withColumn("best", best)
                        .select("page_id", "host", "path", "best.rule", "best.verdict"), "op1-ruled")
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0)).alias(v)
    hosts = materialise(ruled.filter("host <> ''").groupBy("host").agg(share("allow"), share("block")), "op1-hosts")
    edges = materialise(host_links(pages, url_col, html_col), "op1-edges")
    trust = propagate(hosts.select("host", F.col("allow").alias("seed")), edges)
    against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = propagate(hosts.select("host", F.col("block").alias("seed")), against)
    scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left") \
        .join(distrust.withColumnRenamed("score", "distrust"), "host", "left") \
        .select("host", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("trust", "distrust")])
    method = F.when(F.col("distrust") - F.col("trust") > margin, "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
