"""URL rules and parts on odd URLs; verdicts of the whole table are compared with SQL."""

from riskframe.llm import url_filter as U


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    best = None
    for verdict, rule in U.RULES:
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and len(rule) > len(best[1] if best else ""):
            best = (verdict, rule)
    return best


URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/x?y#z", "https://example.com/en/1", "https://m.example.com/en/1",
    "http://a.net/es/2", "http://a.net/es", "http://a.net/fr/?q=://b.com/", "http://com/", "http://com", "http://xcom/", "http://x.com?p=/en/",
    "ftp://x.com#/en/", "a://b://c.com/", "http://ÄÖ.com/ä\nö", "http://user:pw@host.com:80/p", "http://x.net/en/" + "a" * 100_000, "http://same.org/", "http://same.org/",
]


def test_rules_and_odd_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://x.com/")], "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS cut", "2 AS n")
    rows = U.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path) == plain_parts(r.url)
        best = plain_rule(r.host, r.path)
        assert r.rule == (best[1] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    same = [r.verdict for r in rows if r.url == "http://same.org/"]
    assert len(same) == 2 and len(set(same)) == 1
    assert {r.difference for r in rows if not r.url} == {0.0}


def test_model_tells_kinds_apart(spark):
    rows = [(i, f"http://good.com/news/story{i}") for i in range(30)] + [(100 + i, f"http://bad.net/es/casino{i}") for i in range(30)]
    rows += [(200, "http://other.org/news/story"), (201, "http://other.org/es/casino")]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "allow" and got[201] == "block"


def test_without_both_kinds(spark):
    pages = spark.createDataFrame([(1, "http://x.com/"), (2, "http://x.org/")], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.difference, r.cut) for r in U.judge(pages).collect()} == {(1, "allow", 0.0, 0.0), (2, "allow", 0.0, 0.0)}
    assert U.judge(pages.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = U.judge(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
