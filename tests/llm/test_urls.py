from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tests.oracle import assert_same
from trainkit.llm import queries, urls

CASES = [
    ("https://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://EXAMPLE.org/en/17?q", "example.org", "/en/17", "example.org/en/1", "block"),
    ("https://example.org/en/2#x", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
    ("http://www.casino-win.net/en/1", "www.casino-win.net", "/en/1", None, "block"),
    ("http://www.casino-win.com/fr/1", "www.casino-win.com", "/fr/1", "com/fr/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("no scheme/org/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("x://y.org/a://b.com/de/", "y.org", "/a://b.com/de/", "org/", "allow"),
    ("http://É.ORG/es/", "É.org", "/es/", "org/", "allow"),
]


def test_cases(spark):
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(CASES)] + [(None, None, None)], "page_id long, url string, host string")
    got = {r.c0: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, [F.col("page_id")]).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)} | {None: ("", "", None, "allow")}
    assert urls.judge_urls(pages.limit(0), [F.col("page_id")]).count() == 0


def test_several_passes_agree_with_one(spark):
    pages = spark.read.parquet(f"{ORACLE}/pages.parquet")
    one = urls.judge_urls(pages, [F.col("page_id")]).collect()
    many = urls.judge_urls(pages, [F.col("page_id")], rules_at_once=2).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_only_candidates_are_tried():
    index = urls.RuleIndex([("a.b.c/x/y", "block"), ("b.c/", "allow")], [], Counter({"a": 9, "b": 5, "c": 9, "x": 1}))
    assert set(index.by_token) == {"x", "b"}
    assert index.judge("z.a.b.c", "/x/yy") == ("a.b.c/x/y", "block", None)
    assert index.judge("a.b.c", "/q") == ("b.c/", "allow", None)


def test_twin(spark):
    assert_same(queries.op3_url_filter(spark, ORACLE), queries.OP3_SQL, ORACLE)


def test_filter_lists(spark):
    """Lines of a table; the token index finds what trying every pattern finds."""
    import re

    lines = ["||ads.example.com^", "@@||good.example.net^", "/track*pixel^", "|https://shop.", ".gif|", "! comment", "", None, "/(^|[^a-z0-9])casino([^a-z0-9]|$)/casino", "/(/bad", "-banner-", "*"]
    patterns = urls.read_filters(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert len(patterns) == 7
    given = ["http://ads.example.com/x", "https://a.ads.example.com", "http://badads.example.com/", "http://good.example.net/casino", "http://x.com/track/a/pixel?z", "http://shop.x.org/", "http://x.com/a.GIF", "http://x.com/a.gif/b",
             "http://casino.com", "http://casino.com/", "http://x.com/my-casino-page", "http://x.com/casinos", "http://x.com/a-banner-b", None, "x", "http://" + "a" * 50_000 + ".com/casino"]
    rows = urls.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i long, url string"), [F.col("i")], host_rules=[], patterns=patterns).collect()
    for r in rows:
        fits = {verdict for pattern, _, verdict in patterns if re.search(pattern, (r.host + r.path).lower())}
        assert r.verdict == ("block" if "block" in fits else "allow"), given[r.c0]
    blocked = {r.c0 for r in rows if r.verdict == "block"}
    assert {0, 1, 4, 5, 6, 8, 9, 10, 12, 15} == blocked - {3}


def test_index_equals_a_scan_of_all_rules(spark):
    """Random URLs of letters of several alphabets, signs and the rules' own words, long ones and repeated ones too."""
    import random

    rng = random.Random(11)
    parts = ["casino", "pills", "ads", "spam", "é", "ß", "Ж", "_", "-", ".", "/", "%", "中", "x", "7", "CASINO", "İ", "track", "pixel", "banner", "́"]
    lines = ["||ads.example.com^", "@@||good_site.net^", "/track*pixel^", "_banner_", "|ads.", ".casino|", "-pills-", "é-spam^", "@@^track^", "ads_7", *urls.FILTERS, "/[^a-z0-9]pills(é|$)/pills", "/(é|ж)x/", "/(^|[^a-z0-9])spam-x([^a-z0-9]|$)/spam-x"]
    patterns = urls.read_filters(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert len(patterns) == len(lines)
    hosts = [("example.com/", "block"), ("é.org/x", "allow"), ("casino.net/é/", "block"), ("org/中", "block")]
    given = ["http://" + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".net/", ".org/", ".com/é/", ".org/中x"]) + "".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3000)]
    given += ["http://x.net/écasino", "http://x.net/casinoé", "http://y.é.org/xx", "http://x.net/" + "é-" * 40_000 + "casino"] + given[:50]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i long, url string")
    rows = urls.judge_urls(pages, [F.col("i")], host_rules=hosts, patterns=patterns).collect()
    everything = urls.RuleIndex([], [], Counter())  # the same rules, none filed under a token: all are tried on every URL
    for rule, verdict in hosts:
        host, _, path = rule.partition("/")
        everything.always.append((True, rule, host, "/" + path, verdict))
    everything.always += [(False, p, urls.re.compile(p), None, v) for p, _, v in patterns]
    hit = 0
    for r in rows:
        rule, by_rule, by_pattern = everything.judge(*urls.host_and_path(given[r.c0]))
        hit += by_pattern is not None
        assert (r.rule, r.verdict) == (rule, by_rule or by_pattern or "allow"), given[r.c0]
    assert len(rows) == len(given) and hit > 800
