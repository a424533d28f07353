"""Link flows over long chains and hosts without links, and rules that tie, against SQL and plain arithmetic."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import same_rows  # noqa: E402

from heddle.llm import urls  # noqa: E402


def _page(host: str, *to: str, path: str = "/") -> tuple:
    return (f"http://{host}{path}", "".join(f'<a href="http://{t}/">' for t in to))


def _judged(spark, tmp_path, pages):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    found = urls.op3_url_filters(spark, str(tmp_path))
    same_rows(found, urls.ORACLE_SQL, str(tmp_path))
    return {r.host: r.verdict for r in found.collect()}, df


def test_rounds_follow_from_the_hosts():
    for n in (1, 10, 10**6, 10**10):
        k = urls.rounds_for(n)
        left = urls.DAMPING**k / (1 - urls.DAMPING) ** 2  # scaled by a sum of 1 - damping at least, added up over all later rounds
        assert left <= urls.THRESHOLD / n < left / urls.DAMPING**2
    assert 90 < urls.rounds_for(10**6) < 130


def test_a_long_chain_settles(spark, tmp_path):
    """Host k links to k - 1, down to a blocked seed: distrust goes up the chain, by 0.85 a link."""
    pages = [_page("seed.net")] + [_page(f"h{k}.com", "seed.net" if k == 1 else f"h{k - 1}.com") for k in range(1, 60)]
    verdicts, df = _judged(spark, tmp_path, pages)
    scores = {r.host: r.distrust for r in urls.judge(df).select("host", "distrust").collect()}
    whole = sum(0.85**k for k in range(60))
    for k in range(1, 60):
        exact = 0.85**k / whole
        assert scores[f"h{k}.com"] / urls.UNIT == pytest.approx(exact, abs=urls.THRESHOLD / 60)
        if abs(exact - urls.THRESHOLD / 60) > 1e-3 * urls.THRESHOLD:
            assert verdicts[f"h{k}.com"] == ("block" if exact > urls.THRESHOLD / 60 else "allow"), k
    assert verdicts["h26.com"] == "block" and verdicts["h59.com"] == "allow"


def test_flow_of_hosts_without_links_goes_back_to_the_seeds(spark):
    """Against the plain iteration in which such hosts' flow returns to the seeds."""
    links = [("s", "a", 1), ("s", "b", 3), ("a", "c", 1), ("b", "s", 2), ("t", "c", 1)]
    edges = spark.createDataFrame(links, "src string, dst string, n long")
    seeds = spark.createDataFrame([("s",), ("t",)], "host string")
    found = {r.host: r.trust for r in urls.propagate(edges, seeds, seeds.limit(0), urls.rounds_for(10**6)).collect()}
    hosts, out = {h for x in links for h in x[:2]}, {}
    for a, _, n in links:
        out[a] = out.get(a, 0) + n
    x = {h: 0.5 * (h in "st") for h in hosts}
    for _ in range(300):
        lost = sum(v for h, v in x.items() if h not in out)
        y = {h: (0.15 + 0.85 * lost) * 0.5 * (h in "st") for h in hosts}
        for a, b, n in links:
            y[b] += 0.85 * x[a] * n / out[a]
        x = y
    assert {h: v / urls.UNIT for h, v in found.items()} == pytest.approx(x, abs=1e-6)


def test_rules_that_tie(spark):
    rules = (("block", "a.b.com", "/x"), ("allow", "b.com", "/x/aa"), ("allow", "com", "/"), ("block", "com", "/"))
    pages = spark.createDataFrame([("http://a.b.com/x/aa",), ("http://a.b.com/x",), ("http://q.com/",)], "url string").selectExpr("*", "'' AS html")
    found = {r.url: (r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert found == {
        "http://a.b.com/x/aa": ("b.com/x/aa", "allow"),  # ten characters against nine
        "http://a.b.com/x": ("a.b.com/x", "block"),
        "http://q.com/": ("com/", "block"),  # of equal rules the greater verdict
    }
    even = (("block", "ab.com", "/x"), ("allow", "b.com", "/xy"), ("allow", "b.com", "/x"))
    one = spark.createDataFrame([("http://ab.com/xy",), ("http://b.com/xy",)], "url string").selectExpr("*", "'' AS html")
    assert {r.url: r.rule for r in urls.judge(one, even).collect()} == {"http://ab.com/xy": "ab.com/x", "http://b.com/xy": "b.com/xy"}
    same = (("block", "b.c.com", "/x"), ("allow", "c.com", "/x/y"))  # both of nine characters: the greater path
    two = spark.createDataFrame([("http://b.c.com/x/y",)], "url string").selectExpr("*", "'' AS html")
    assert [(r.rule, r.verdict) for r in urls.judge(two, same).collect()] == [("c.com/x/y", "allow")]
