"""URL filters: allow and block rules, and for the rest trust and distrust propagated over the graph of hosts.

A rule names a host, with all its subdomains, and a path prefix; the longest fitting rule decides (host first, then
path). Pages that no rule fits are judged by their host. Edges run from the host of a page to the hosts it links to,
weighted by pages that link. Hosts of which over half the pages are allowed by rule are trusted seeds, those of which
over half are blocked are blocked seeds. Personalised PageRank spreads trust from the trusted seeds along the links, and
distrust from the blocked seeds against them: who links to the blocked earns distrust. A host is blocked if its distrust
exceeds `threshold` of trust and distrust together; a host that neither reaches is allowed.

Everything is joins and aggregations in Spark. Rules are inlined up to INLINE_RULES and joined beyond. Ranks are stored
every few rounds, and joins are between plain tables, so that Spark can split a hub's edges.

Null URLs and URLs without :// have an empty host and path, fit no rule and are allowed. Hosts are compared in lower
case of A-Z; ports and user names count as part of the host. Repeated rows each get a verdict and count for their host.
Ties between rules of one length go to the text that sorts first. Empty tables give no rows; no links or no seeds leave
each host its own seed. Columns beyond key, URL and page are ignored. Texts of any length are searched for links once.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetide.llm.common import let_go, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 200
DAMPING, TOLERANCE = 0.85, 1e-6
#: Rounds that are computed in one go before their ranks are stored and compared.
ROUNDS_A_TABLE = 4
#: A graph whose ranks need more rounds than this is reported as an error.
MOST_ROUNDS = 2000


@dataclass(frozen=True)
class Rule:
    """text: host and path as one, such as `example.net/en/`."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rules(df: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Add host, path, rule and rule_verdict (null where no rule fits)."""
    placed = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    ranked = sorted(rules, key=lambda r: (-len(r.host), -len(r.path), r.text))
    if len(ranked) <= INLINE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r in reversed(ranked):
            fits = _fits(F.col("host"), F.col("path"), r)
            rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
        return placed.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = df.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "_host string, _path string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = placed.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("_suffix"))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("_host"), F.length("_path")))
    found = pairs.join(table, F.col("_suffix") == F.col("_host")).where(F.startswith("path", "_path")).groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(best.alias("_best"))
    found = stored(found.select("_h", "_p", "_best.*"), "url-rules")
    return placed.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")


_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


def host_edges(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target, weight): hosts and how many pages of the one link to the other. Relative links stay on their host
    and are left out, like all links of a host to itself."""
    links = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1))
    found = df.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(host_of(F.col(url)).alias("source"), F.explode(links).alias("target"))
    found = found.select("source", _ascii_lower(F.col("target")).alias("target")).where("source <> '' and source <> target")
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, most_rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """edges: source, target, weight. seeds: host, trust, distrust. (host, trust, distrust) after personalised PageRank;
    mass that reaches a host without further links ends there. Rounds go on until no host is newly reached and none of its
ranks, however small, moves by more than `tolerance` of itself: verdicts are ratios."""
    start = seeds.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    totals = start.agg(F.sum("trust"), F.sum("distrust")).first()
    share = lambda c, total: (F.col(c) / F.lit(float(total or 0) or 1.0)).alias(c)
    start = stored(start.select("host", share("trust", totals[0]), share("distrust", totals[1])), "url-seeds")
    edges = stored(edges, "url-edges")
    if edges.isEmpty():
        return start
    out = edges.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").alias("_out"))
    into = edges.groupBy(F.col("target").alias("_t")).agg(F.sum("weight").alias("_in"))
    forward = edges.join(stored(out, "url-out"), F.col("source") == F.col("_s")).select(F.col("source").alias("at"), F.col("target").alias("to"), F.lit(True).alias("trusts"), (F.col("weight") / F.col("_out")).alias("part"))
    backward = edges.join(stored(into, "url-in"), F.col("target") == F.col("_t")).select(F.col("target").alias("at"), F.col("source").alias("to"), F.lit(False).alias("trusts"), (F.col("weight") / F.col("_in")).alias("part"))
    # Both flows in one table, so that a round reads its ranks once and rounds can be chained before one is stored.
    flows = stored(forward.unionByName(backward), "url-flows")
    base = start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    flow = lambda c, mine: F.when(F.col("trusts") == mine, damping * F.col("part") * F.col(c)).otherwise(0.0).alias(c)

    def after(ranks: DataFrame) -> DataFrame:
        moved = flows.join(ranks, F.col("at") == F.col("host")).select(F.col("to").alias("host"), flow("trust", True), flow("distrust", False)).where("trust > 0 or distrust > 0")
        return base.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))

    ranks = start
    for _ in range(0, most_rounds, ROUNDS_A_TABLE):
        then = stored(functools.reduce(lambda r, _: after(r), range(ROUNDS_A_TABLE), ranks), "url-ranks")
        old = ranks.select(F.col("host").alias("_host"), F.col("trust").alias("_trust"), F.col("distrust").alias("_distrust"))
        shift = lambda c: F.abs(F.col(c) - F.coalesce("_" + c, F.lit(0.0))) > tolerance * F.col(c)
        settled = then.join(old, F.col("host") == F.col("_host"), "left").where(shift("trust") | shift("distrust")).isEmpty()
        if ranks is not start:
            let_go(ranks)
        ranks = then
        if settled:
            break
    else:
        raise RuntimeError(f"ranks did not settle in {most_rounds} rounds")
    return ranks


def judge(df: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust)."""
    ruled = with_rules(df.select(key, url), rules, url)
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    by_host = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"), F.count(F.lit(1)).alias("pages"))
    seeds = by_host.where("allowed > 0.5 or blocked > 0.5").select("host", F.when(F.col("allowed") > 0.5, 1.0).otherwise(0.0).alias("trust"), F.when(F.col("blocked") > 0.5, 1.0).otherwise(0.0).alias("distrust"))
    scores = propagate(host_edges(df, url, html), seeds)
    scores = stored(scores.select(F.col("host").alias("_host"), "trust", "distrust"), "url-scores")
    judged = ruled.join(scores, F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return judged.select(key, "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


#: The rules of the registered query.
RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, RULES)


ORACLE_RULES = """
with parsed as (
  select page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule, rule_host, rule_path, verdict) as (values
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits as (
  select page_id, rule, verdict, row_number() over (partition by page_id order by length(rule_host) desc, length(rule_path) desc) as nth
  from parsed join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, verdict from parsed left join (select page_id, rule, verdict from fits where nth = 1) using (page_id)
"""
