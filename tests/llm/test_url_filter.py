import re

from tessaro.llm.components import connected_components
from tessaro.llm.url_filter import RULES, judge_urls

SCHEMA = "page_id long, url string, html string, node string, verdict string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def judge(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r["page_id"]: r for r in judge_urls(df).collect()}


def test_rules(spark):
    urls = ["http://a.example.com/en/1", "http://WWW.example.com/en/1", "http://example.net/fr/x#y", "http://example.net/de/", "http://example.org/",
            None, "no scheme", "http://", "http://net", "http://xnet/es/", "http://com/", "https://example.com/en", "http://net/es/?q", "HTTP://Net?es/#"]
    got = judge(spark, [(i, u, None) for i, u in enumerate(urls)])
    for i, u in enumerate(urls):
        host, path = parts(u)
        rule, action = ruled(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, action or "allow")


def test_blocks_reach_aliases_and_allow_wins(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (0, "http://x.org/a", link.format("http://bad.net/es/1")),
        (1, "http://bad.net/es/1", None),
        (2, "http://y.org/b", '<meta http-equiv="Refresh" content="0; url=http://x.org/a#frag">'),
        (3, "http://z.org/c", link.format("http://good.com/1")),
        (4, "http://good.com/1", link.format("http://bad.net/fr/2")),
        (5, "http://bad.net/fr/2", ""),
        (6, "http://far.org/d", link.format("/e")),
        (7, "http://far.org/e", link.format("//BAD.net/es/1")),
        (8, "https://y.org/b#top", None),
        (9, "http://far.org/dir/f", link.format("g")),
        (10, "http://far.org/dir/g", link.format("http://bad.net/es/1")),
        (11, "http://alone.org/", "<link rel=stylesheet href='http://bad.net/es/1'>"),
    ]
    got = judge(spark, [*rows, rows[0]])
    assert {i: r["verdict"] for i, r in got.items()} == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block",
                                                         8: "block", 9: "block", 10: "block", 11: "allow"}


def test_empty(spark):
    assert judge(spark, []) == {}


def test_rules_from_a_table(spark):
    urls = ["http://www.example.com/en/x", "http://example.com/en/", "http://a.example.com/en/y", "http://example.com/e", "http://net/es/1", "http://x.y.net/fr/?q", "http://net.org/es/", "http://com", "no", None]
    df = spark.createDataFrame([(i, u, None, "x", "y") for i, u in enumerate(urls)], SCHEMA)
    rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    many = [*RULES, *[("block", f"h{i}.invalid", f"/{'p' * (i % 7)}") for i in range(300)]]
    want = sorted(judge_urls(df).collect())
    assert sorted(judge_urls(df, rules).collect()) == want and sorted(judge_urls(df, many).collect()) == want
    assert {r["rule"] for r in judge_urls(df, rules).collect()} == {"www.example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", None}


def test_many_aliases(spark):
    """Chains and stars over several partitions: a block reaches all of a chain, an allowed page shields its star."""
    link = "<link rel=canonical href='{}'>"
    rows = [(i, f"http://c{i % 40}.org/{i}", link.format(f"http://c{(i + 1) % 40}.org/{i + 1}" if i % 40 < 39 else "http://bad.net/es/1" if i < 400 else "http://fine.com/")) for i in range(800)]
    rows += [(1000 + i, f"http://s{i}.org/", link.format("http://hub.org/")) for i in range(400)] + [(2000, "http://hub.org/", link.format("http://bad.net/fr/")), (2001, "http://bad.net/es/1", None), (2002, "http://bad.net/fr/", None), (2003, "http://fine.com/", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(8)
    got = {r["page_id"]: r["verdict"] for r in judge_urls(df).collect()}
    assert all(got[i] == ("block" if i < 400 else "allow") for i in range(800))
    assert all(got[1000 + i] == "block" for i in range(400))


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*edges, (None, 4), (7, None)], "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_sql_says_the_same(spark, tmp_path):
    import duckdb

    from tessaro.llm.oracles import OP4

    link = '<html><head><LINK href="{}" rel="canonical"></head>'
    rows = [
        (0, "http://x.org/a", link.format("http://bad.net/es/1")), (1, "http://bad.net/es/1", None), (2, "http://y.org/b", '<meta http-equiv="Refresh" content="0; url=http://x.org/a#frag">'),
        (3, "http://z.org/c", link.format("http://good.com/1")), (4, "http://good.com/1", link.format("http://bad.net/fr/2")), (5, "http://bad.net/fr/2", ""),
        (6, "http://far.org/d?x", link.format("/e")), (7, "http://far.org/e", link.format("//BAD.net/es/1")), (8, "http://far.org/dir/f?q", link.format("g")),
        (9, "http://far.org/dir/g", link.format("http://bad.net/es/1")), (10, None, None), (11, "x", "y"), (12, "http://far.org", link.format("e")), (13, "http://A.example.com/en/?", None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    df.select("page_id", "url", "html").coalesce(1).write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    columns = ("page_id", "host", "path", "rule", "verdict")
    want = con.sql(OP4)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[i] for i in at) for r in want.fetchall()) == sorted(tuple(r) for r in judge_urls(df).select(*columns).collect())
