import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import url_filter
from weftline.llm.url_filter import ORACLE_SQL, RULES, url_verdicts


@pytest.fixture(params=["constant", "join"], autouse=True)
def both_ways(request, monkeypatch):
    """Rules in the plan, and rules joined by host."""
    if request.param == "join":
        monkeypatch.setattr(url_filter, "MOST_LITERAL", 0)


def judge(spark, pages, redirects=None, rules=RULES):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(rules, "action string, host string, path string")
    links = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
    return {r.page_id: r for r in url_verdicts(df, rules, links).collect()}


CASES = [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("example.org/es/", "", "", None, "allow"),
    ("http://Example.ORG/es/x?q#f", "example.org", "/es/x", "example.org/es/", "block"), ("https://a.b.example.org/en/12", "a.b.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), ("http://example.org", "example.org", "", None, "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), ("http://com/de/", "com", "/de/", "com/de/", "block"), ("http://x.net/de/", "x.net", "/de/", None, "allow"),
    ("ftp://X.com?/de/", "x.com", "", None, "allow"), ("a://b://x.com/de/", "b:", "//x.com/de/", None, "allow"), ("http:///de/", "", "/de/", None, "allow"), ("http://É.com/de/\n", "É.com", "/de/\n", "com/de/", "block"),
]


def test_rules(spark):
    found = judge(spark, [(i, url, None) for i, (url, *_) in enumerate(CASES)])
    for i, (url, *expected) in enumerate(CASES):
        assert [found[i].host, found[i].path, found[i].rule, found[i].verdict] == expected, url


LINK = "<html><link href='{}' rel=\"canonical\"></html>"


def test_aliases_inherit_blocks_and_an_allow_frees_only_its_own_key(spark):
    pages = [
        (1, "http://x.com/de/1", ""), (2, "http://y.net/copy", LINK.format("http://x.com/de/1")), (3, "http://y.net/copy?utm_source=a", ""), (4, "https://www.y.net/copy/", "<p>"),
        (5, "http://z.net/hop", "<meta http-equiv=refresh content='0; url=http://y.net/copy'>"), (6, "http://w.net/a", LINK.format("http://x.com/de/9")), (7, "http://w.net/b", LINK.format("/a")),
        (8, "http://w.net/c", LINK.format("http://x.com/fr/9")), (9, "http://w.net/d", LINK.format("http://w.net/a") + LINK.format("http://w.net/c")), (10, "http://free.net/", ""), (11, "http://w.net/c2", LINK.format("//w.net/c")),
        (12, "http://v.net/1", LINK.format("http://x.com/fr/7")), (13, "http://x.com/fr/9", ""), (14, "http://x.com/fr/8", LINK.format("http://x.com/de/1")),
    ]
    found = judge(spark, pages, [("http://free.net/", None), (None, None), ("http://end.net/", "http://free.net/")])
    assert {k: (r.verdict, r.alias) for k, r in found.items()} == {
        1: ("block", "rule"), 2: ("block", "component"), 3: ("block", "component"), 4: ("block", "component"), 5: ("block", "component"), 10: ("allow", "default"), 12: ("allow", "default"),
        6: ("block", "component"), 7: ("block", "component"), 8: ("block", "component"), 9: ("block", "component"), 11: ("block", "component"), 13: ("allow", "rule"), 14: ("allow", "rule"),
    }


def test_two_pages_stay_blocked_when_a_third_is_allowed(spark):
    rules = [("block", "bad.com", "/"), ("allow", "good.com", "/"), ("allow", "www.some.com", "/")]
    pages = [(1, "http://a.net/", LINK.format("http://bad.com/z")), (2, "http://b.net/", LINK.format("http://bad.com/z")), (3, "http://good.com/1", LINK.format("http://bad.com/z")), (4, "http://some.com/x", LINK.format("http://bad.com/z")), (5, "http://www.some.com/x/", "")]
    found = judge(spark, pages, rules=rules)
    assert {k: (r.verdict, r.alias) for k, r in found.items()} == {1: ("block", "component"), 2: ("block", "component"), 3: ("allow", "rule"), 4: ("allow", "key"), 5: ("allow", "rule")}


def test_moved_sites_redirect_over_hops_and_to_a_hub(spark):
    moved = [("one.net", "http://two.net", "path"), ("two.net", "https://three.com/de", "path"), ("shut.net", "http://hub.net/all", "page"), ("hub.net", "http://x.com/de/hub", "page"), ("round.net", "http://again.net/a", "path"), ("again.net", "http://round.net/b", "path"), ("sub.one.net", "http://free.net", "path")]
    pages = [
        (1, "http://one.net/p?q=1", ""), (2, "http://www.one.net/p", ""), (3, "http://two.net/p", ""), (4, "http://notone.net/p", ""), (5, "http://three.com/de/p", ""), (6, "http://a.shut.net/1", ""), (7, "http://shut.net/2", ""),
        (8, "http://round.net/x", ""), (9, "http://again.net/a/x", ""), (10, "http://sub.one.net/p", ""), (11, "http://friend.net/", LINK.format("http://shut.net/9")), (12, "http://shut.net/9", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    found = {r.page_id: (r.verdict, r.alias) for r in url_verdicts(df, rules, moved=moved).collect()}
    blocked, free = ("block", "component"), ("allow", "default")
    assert found == {1: blocked, 2: blocked, 3: blocked, 4: free, 5: ("block", "rule"), 6: blocked, 7: blocked, 8: free, 9: free, 10: free, 11: blocked, 12: blocked}


def test_keys(spark):
    same = [["http://a.net/x", "https://www.A.net/x/", "//://", "http://a.net/x?", "http://a.net/x?&utm_source=1&ref=#t", "http://a.net/x/?gclid=2"], ["http://a.net/x?b=1&c=2", "http://a.net/x?b=1&fbclid=3&c=2#", "http://a.net/x?&b=1&&c=2"], ["http://a.net/x?ref"], ["http://a.net/x?xref=1"], ["http://a.net"], ["http://a.net/x?c=2&b=1"], ["http://b.net/x"], ["http://m.a.net/x"]]
    same[0].remove("//://")
    df = spark.createDataFrame([(i, u) for i, urls in enumerate(same) for u in urls] + [(-1, "no url"), (-1, None)], "i int, u string")
    found = {}
    for r in df.select("i", url_filter.alias_key(F.col("u")).alias("k")).collect():
        found.setdefault(r.i, set()).add(r.k)
    assert found.pop(-1) == {None} and all(len(v) == 1 for v in found.values()) and len(set.union(*found.values())) == len(same)


def test_targets_relative_to_the_page_all_tags_and_escapes(spark):
    link, hop = "<link rel=canonical href='{}'>", "<meta http-equiv='refresh' content='0; url={}'>"
    chain = [
        ("http://a.net/x/y/1.html?q=1&r=2", link.format("2.html")), ("http://a.net/x/y/2.html", hop.format("../z/./3")), ("http://a.net/x/z/3", link.format("?id=2&amp;k=3")),
        ("http://a.net/x/z/3?id=2&k=3", link.format("/up") + link.format("../../../top/")), ("http://a.net/top", hop.format("http://b.net/1") + hop.format("//c.net/2")),
        ("http://c.net/2", link.format("http://a.net/x/y/1.html?q=9") + link.format("http://x.com/de/1?a=1&#38;b=2")), ("http://b.net/1", ""), ("http://a.net/up", ""), ("http://root.net", link.format("page")), ("http://root.net/page", link.format("http://b.net/1")),
    ]
    apart = [("http://a.net/x/y/9.html", link.format("mailto:a@b.net")), ("http://a.net/x/2.html", link.format("")), ("http://a.net/y/2.html", link.format("#top"))]
    found = judge(spark, [(i, *p) for i, p in enumerate(chain)] + [(100 + i, *p) for i, p in enumerate(apart)])
    assert {chain[i][0]: (found[i].verdict, found[i].alias) for i in range(len(chain))} == {u: ("block", "component") for u, _ in chain}
    assert {found[100 + i].alias for i in range(len(apart))} == {"default"}


def test_long_chains_and_hubs(spark):
    pages = [(i, f"http://n{i}.net/p", f"<link rel=canonical href=http://n{i + 1}.net/p>") for i in range(40)] + [(100 + i, f"http://h{i}.net/", "<link rel=canonical href='http://x.com/de/hub'>") for i in range(60)]
    found = judge(spark, [*pages, (40, "http://n40.net/p", "<link rel=canonical href=http://x.com/de/end>")])
    assert {r.verdict for r in found.values()} == {"block"}


def test_longest_rule_wins_and_repeated_rows_stay(spark):
    rules = [("block", "a.net", "/"), ("allow", "b.a.net", "/x"), ("block", "b.a.net", "/x/y"), ("allow", "b.a.net", "/x/y"), ("block", None, "/")]
    df = [(1, "http://b.a.net/x/y", None), (1, "http://b.a.net/x/y", None), (2, "http://c.a.net/x", None), (None, "http://b.a.net/x", None)]
    frame = spark.createDataFrame(df, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as key")
    found = sorted((r.page_id or 0, r.verdict) for r in url_verdicts(frame, spark.createDataFrame(rules, "action string, host string, path string")).collect())
    assert found == [(0, "allow"), (1, "allow"), (1, "allow"), (2, "block")]


def test_of_two_equally_long_rules_the_allowing_one_wins(spark):
    rules = [("block", "a.net", "/xy"), ("allow", "b.a.net", "/")]
    assert judge(spark, [(1, "http://b.a.net/xyz", None)], rules=rules)[1].rule == "b.a.net/"


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    out = url_verdicts(df, spark.createDataFrame(RULES, "action string, host string, path string"))
    assert out.collect() == [] and "Python" not in out._jdf.queryExecution().toString()


def test_agrees_with_sql(spark):
    from weftline.llm.url_filter import op6_url_filter

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    found = con.execute(ORACLE_SQL["op6_url_filter"])
    names = [d[0] for d in found.description]
    df = op6_url_filter(spark, sf).select(names)
    rows = df.collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(found.fetchall(), key=repr)
    assert sum(r.alias == "component" for r in rows) > 10 and {r.verdict for r in rows if r.alias == "component"} == {"block"}
