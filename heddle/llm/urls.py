"""URL filters: path rules per host, and link-graph propagation for what no rule decides.

Rules name a host and a path; the longest rule that fits a url decides it. For the rest, hosts are
judged by two flows over the host graph of the pages' links. Trust is personalised PageRank from hosts
that an allowing rule fits; distrust is the same over reversed links from hosts that a blocking rule of a
whole host fits. A host is blocked where its distrust exceeds its trust by more than the threshold.

Scores are whole numbers of parts (``UNIT`` in all), so sums do not depend on the order of their
rows and every run gives the same verdicts. Links are summed per pair of hosts before they
travel, a round moves one row per pair, and lineage is cut every few rounds by a written table. What a round still moves is
``DAMPING`` times what the one before moved at most, so the number of rounds follows from the number of hosts: all that later rounds
could add anywhere is less than the threshold of one host (``rounds_for``; some 100 rounds for a million hosts). Flow that
comes to a host without links goes back to the seeds; as that scales all scores of a kind alike, it is done once, at the end, by bringing each kind's
sum to ``UNIT``.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, joins no graph
and is allowed; a null page has no links; long pages are searched whole; repeated rows are judged on their own (their links count
again); of two fitting rules of one length the one with the greater path, then host, then verdict wins; an empty table gives no rows; other
columns pass through unless they have the name of an output column, which then wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import passing, settle, table, unused

#: (verdict, host, path): the production rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UNIT = 10**15
DAMPING = 0.85
#: A host is blocked where distrust - trust exceeds this share of the mean score a host can have.
THRESHOLD = 0.1
SETTLE_EVERY = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_rules(hosts: DataFrame, rules=RULES) -> DataFrame:
    """``host, rules``: for each distinct host that any rule's host fits, those rules, longest first."""
    kind = "array<struct<verdict:string,rule_host:string,path:string>>"
    rows = F.array(*[F.struct(*map(F.lit, r)) for r in rules]).cast(kind)
    given = hosts.sparkSession.range(1).select(F.inline(rows))
    labels = F.split("host", "[.]")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    fits = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(given, "rule_host")
    one = F.struct(
        (F.length("rule_host") + F.length("path")).alias("size"), "path",
        F.concat("rule_host", "path").alias("rule"), "verdict",
    )
    return fits.groupBy("host").agg(F.sort_array(F.collect_list(one), asc=False).alias("rules"))


def links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    target = F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1))
    found = pages.select(host_of(F.col("url")).alias("src"), target.alias("dst"))
    named = found.select("src", F.translate("dst", _UPPER, _UPPER.lower()).alias("dst"))
    return named.filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def rounds_for(n_hosts: int, threshold: float = THRESHOLD, damping: float = DAMPING) -> int:
    """Rounds after which what is unsettled, scaled as the scores are, is less than the threshold of one host.

    After k rounds ``damping ** k`` of the flow is unsettled, a kind's sum is ``1 - damping`` at least, and later rounds add up to
    ``1 / (1 - damping)`` times the next.
    """
    return math.ceil(math.log(threshold / max(1, n_hosts) * (1 - damping) ** 2) / math.log(damping))


def propagate(edges: DataFrame, trusted: DataFrame, blocked: DataFrame, rounds: int, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` in parts of ``UNIT``; ``trusted`` and ``blocked`` hold distinct hosts."""
    edges = settle(edges)

    def shares(kind: str, a: str, b: str) -> DataFrame:
        whole = settle(edges.groupBy(F.col(a).alias("src")).agg(F.sum("n").alias("whole")))
        turned = edges.select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "n")
        return turned.join(whole, "src").select("kind", "src", "dst", (F.col("n") / F.col("whole")).alias("share"))

    flow = settle(shares("trust", "src", "dst").union(shares("distrust", "dst", "src")))
    seeds = trusted.select(F.lit("trust").alias("kind"), "host").union(blocked.select(F.lit("distrust"), "host"))
    sizes = seeds.groupBy("kind").agg(F.count("*").alias("n"))  # two rows
    each = F.floor(F.lit(UNIT) / F.col("n")).cast("long")
    start = settle(seeds.join(F.broadcast(sizes), "kind").select("kind", "host", each.alias("score")))
    again = start.select("kind", "host", F.floor(F.col("score") * (1 - damping)).alias("score"))
    scores = start
    if not flow.isEmpty():
        for k in range(1, rounds + 1):
            moved = flow.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), F.floor(F.col("score") * F.col("share") * damping).alias("score")
            )
            scores = moved.union(again).groupBy("kind", "host").agg(F.sum("score").alias("score")).filter("score > 0")
            if k % SETTLE_EVERY == 0:
                scores = settle(scores)
        scores = settle(scores)
        sums = scores.groupBy("kind").agg(F.sum("score").alias("all"))  # two rows
        wide = F.call_function("div", F.col("score").cast("decimal(19,0)") * F.lit(UNIT), F.col("all").cast("decimal(19,0)"))
        scores = scores.join(F.broadcast(sums), "kind").select("kind", "host", wide.alias("score"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, trust, distrust``."""
    with passing() as keep:
        urls = pages.select("url", "html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
        hosts = urls.select("host").distinct()
        ruled = keep(hosts.join(host_rules(hosts, rules), "host", "left"))
        # Seeds: hosts with pages that rules allow, and hosts that a whole-host rule blocks.
        whole = F.exists("rules", lambda r: (r["path"] == "/") & (r["verdict"] == "block"))
        fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
        allowed = urls.select("host", "path").distinct().join(ruled, "host").filter(F.get(fitting, F.lit(0))["verdict"] == "allow")
        trusted = settle(allowed.select("host").distinct())
        blocked = ruled.filter(whole).select("host").join(trusted, "host", "left_anti")
        n_hosts = max(1, ruled.count())
        scores = settle(propagate(links(urls), trusted, blocked, rounds_for(n_hosts, threshold)))
        told = ("host", "path", "rule", "verdict", "trust", "distrust")
        kept = [c for c in pages.columns if c.lower() not in told]
        host, path, its, rules_, trust, distrust, least = unused(pages, "host", "path", "its", "rules", "trust", "distrust", "least")
        info = keep(ruled.join(scores, "host", "left").select(
            F.col("host").alias(its), F.col("rules").alias(rules_),
            F.coalesce("trust", F.lit(0)).alias(trust), F.coalesce("distrust", F.lit(0)).alias(distrust),
            F.lit(math.floor(UNIT * threshold / n_hosts)).alias(least),
        ))
    named = pages.withColumns({host: host_of(F.col("url")), path: path_of(F.col("url"))})
    first = F.get(F.filter(rules_, lambda r: F.startswith(F.col(path), r["path"])), F.lit(0))
    by_graph = F.when(F.col(distrust) - F.col(trust) > F.col(least), "block").otherwise("allow")
    values = (F.col(host), F.col(path), first["rule"], F.coalesce(first["verdict"], by_graph), F.col(trust), F.col(distrust))
    return named.join(info, F.col(host) == F.col(its)).select(
        *[F.col(f"`{c}`") for c in kept], *[v.alias(n) for v, n in zip(values, told, strict=True)]
    )


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    """SQL for the query's rows; the rounds are a recursive table."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return (
        f"""
WITH RECURSIVE r(verdict, rh, rp) AS (VALUES {rules}),
p AS (
  SELECT page_id, html, {low.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
hp AS (SELECT DISTINCT host, path FROM p),
v AS (
  SELECT host, path, rh || rp AS rule, verdict FROM hp JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, rp DESC, rh DESC, verdict DESC) = 1),
trusted AS (SELECT DISTINCT host FROM v WHERE verdict = 'allow'),
blocked AS (
  SELECT DISTINCT host FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND rp = '/' AND verdict = 'block'
  WHERE host NOT IN (SELECT host FROM trusted)),
l AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, {low.format("unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*[\"'']?\\s*(?:https?:)?//([^/?#\"''\\s>]+)', 1))")} AS dst FROM p)
  WHERE src <> '' AND src <> dst GROUP BY ALL),
f AS MATERIALIZED (
  SELECT 'trust' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM l
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l),
s0 AS MATERIALIZED (
  SELECT 'trust' AS kind, host, floor({UNIT} / (SELECT count(*) FROM trusted))::BIGINT AS score FROM trusted
  UNION ALL SELECT 'distrust', host, floor({UNIT} / (SELECT count(*) FROM blocked))::BIGINT FROM blocked),
m AS MATERIALIZED (
  SELECT CASE WHEN (SELECT count(*) FROM f) = 0 THEN 0
    ELSE ceil(ln({THRESHOLD} / greatest(1, count(DISTINCT host)) * {(1 - DAMPING) ** 2}) / ln({DAMPING})) END AS rounds FROM p),
it AS (
  SELECT 0 AS k, kind, host, score FROM s0
  UNION ALL SELECT k, kind, host, sum(score)::BIGINT FROM (
    SELECT it.k + 1 AS k, f.kind, f.dst AS host, floor(it.score * f.share * {DAMPING})::BIGINT AS score FROM it JOIN f ON f.kind = it.kind AND f.src = it.host
    UNION ALL SELECT t.k + 1, s0.kind, s0.host, floor(s0.score * (1 - {DAMPING}))::BIGINT FROM s0 CROSS JOIN (SELECT DISTINCT k FROM it) t)
  WHERE k <= (SELECT rounds FROM m) GROUP BY k, kind, host HAVING sum(score) > 0),
fin AS (
  SELECT kind, host, CASE WHEN k = 0 THEN score ELSE (score::HUGEINT * {UNIT} // sum(score) OVER (PARTITION BY kind))::BIGINT END AS score
  FROM it WHERE k = (SELECT rounds FROM m)),
g AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'distrust'), 0) - coalesce(sum(score) FILTER (kind = 'trust'), 0) AS bad
  FROM fin GROUP BY host)
SELECT page_id, p.host, p.path, v.rule, coalesce(v.verdict,
  CASE WHEN coalesce(g.bad, 0) > floor({UNIT} * {THRESHOLD} / (SELECT count(DISTINCT host) FROM p)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN v ON p.host = v.host AND p.path = v.path LEFT JOIN g ON p.host = g.host
"""
    )


ORACLE_SQL = _oracle()
