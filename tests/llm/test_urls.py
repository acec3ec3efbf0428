import re

from driftfield.llm import urls as U

URLS = [
    None, "", "no scheme", "http://", "http://org/", "http://org", "http://a.org/x", "http://example.org/es/1", "http://www.EXAMPLE.org/es/?q", "http://example.org/es", "http://notexample.org/es/",
    "http://example.org/en/12#x", "http://example.org/en/2", "x://a.com/fr/", "x://a.com/FR/", "x://a.com/de/?", "x://com/de/fr/", "x://a.com:80/de/", "x://a.b/spam-farm/1", "x://spam-farm.com/fr/1",
    "x://Cheap-Pills.net", "x://a.net/cheap-pillset", "x://a.net?x=spam-farm", "x://a.net/" + "p" * 50_000, "x://a.org/\n/x", "http://a.com/x://b.org/", "x://a.com/de/", "x://a.com/de/",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    after = rest[len(host) :]
    path = re.match(r"[^?#]*", after).group() if after.startswith("/") else ""
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = None
    for verdict, rule in U.BASE_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    spam = [t for t in U.PATTERN_RULES if re.search(rf"(^|[^a-z0-9]){t}([^a-z0-9]|$)", rest.translate({c: c + 32 for c in range(65, 91)}))]
    return host, path, best and best[1], best[0] if best else "block" if spam else "allow"


def test_edges(spark):
    pages = spark.createDataFrame([(i if i % 5 else None, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    got = sorted(((r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages).collect()), key=repr)
    assert got == sorted(map(brute, URLS), key=repr)
    assert U.judge_urls(pages.where("page_id < -1")).collect() == []
    assert {r["verdict"] for r in U.judge_urls(pages, rules=[], default="block").collect()} == {"block"}


def test_rules_run_only_where_their_token_is(spark):
    pages = spark.createDataFrame([("a.com/x",)] * 9 + [("b.org/rare/y",), ("b.org/",)], "whole string")
    rules = [U.Rule("block", "b.org/rare/"), U.Rule("allow", "com/"), U.Rule("block", "x")]
    index = {r["rule"]: r["token"] for r in U.rule_index(pages, rules).collect()}
    assert index == {"b.org/rare/": "rare", "com/": "com", "x": ""}


def test_plan_has_no_python(spark, small):
    plan = U.judge_urls(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "ExistingRDD" not in plan  # rows from the driver's Python pass a worker


def test_wildcards_and_expressions(spark):
    """Rules of every kind on the whole rest of the URL, case aside, and fetched by whole tokens only."""
    rules = [
        U.Rule("block", "utm_*=Promo", "wildcard"), U.Rule("block", "ads*.net/track", "wildcard"), U.Rule("allow", r"/p/[0-9]{3,}$", "regex", ("p",)),
        U.Rule("block", r"(^|\.)x{3}[0-9]*\.", "regex"), U.Rule("block", "a.b+c", "pattern"),
    ]
    want = {
        "x://h.org/?UTM_source=promo": "block", "x://h.org/?utm_source=promotion": None, "x://ads7.net/track?1": "block", "x://ads.net/track": "block", "x://bads.net/tracks": None,
        "x://h.org/p/123": "allow", "x://h.org/p/12": None, "x://h.org/pp/123": None, "x://www.xxx9.com/": "block", "x://xx.com/": None, "x://h.org/A.B+C#": "block", "x://h.org/aXb+c": None,
        "x://h.org/#a.b+c": "block", "x://ads1/y/ads2.net/track": "block",
    }
    assert rules[0].tokens == ["promo", "utm"] and rules[1].tokens == ["net", "track"] and rules[3].tokens == []
    pages = spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string")
    got = {r["page_id"]: (r["verdict"], r["pattern_rule"]) for r in U.judge_urls(pages, rules, default="none").collect()}
    assert [got[i][0] for i in range(len(want))] == [v or "none" for v in want.values()]
