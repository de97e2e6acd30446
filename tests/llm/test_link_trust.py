import math
from collections import defaultdict

import pytest

from strataquery.llm import link_trust as lt
from strataquery.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, verdict string, good string, row string, _blocked string, HOST string, blocked string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, *"xxxxxx") for i, (u, h) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    "url,host,path",
    [
        (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("HTTP://WWW.Ä.Example.COM/En/7?x#y", "www.Ä.example.com", "/En/7"), ("a://b?q/c", "b", ""), ("a://b#f", "b", ""),
        ("a://b/c://d", "b", "/c://d"), ("x y\n://h\n/p\nq", "h\n", "/p\nq"), ("s://h:80/p;x", "h:80", "/p;x"),
    ],
)
def test_hosts_and_paths(spark, url, host, path):
    row = lt.judge(table(spark, [(url, None)]), URL_RULES).first()
    assert (row["host"], row["path"]) == (host, path)


@pytest.mark.parametrize(
    "url,rule,verdict",
    [
        ("http://a.com/en/1", "com/en/", "block"), ("http://com/en/", "com/en/", "block"), ("http://acom/en/1", None, "allow"), ("http://a.com/EN/1", None, "allow"), ("http://www.example.com/en/7x", "example.com/en/7", "allow"),
        ("http://myexample.com/en/7", "com/en/", "block"), ("http://x.net/de/1", "net/de/", "allow"), ("http://example.net/de/81", "example.net/de/8", "block"), ("http://a.org/es/", "org/es/", "block"), ("http://a.org/es", None, "allow"), (None, None, "allow"),
    ],
)
def test_rules(spark, url, rule, verdict):
    row = lt.judge(table(spark, [(url, "<a href='/x'>")]), URL_RULES).first()
    assert (row["rule"], row["verdict"]) == (rule, verdict)


def plain(pages, rules, steps=300):
    """Hosts that the method blocks."""
    import re

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def word(h, p):
        best = None
        for w, t in sorted(rules, key=lambda r: (len(r[1]), r[1])):
            n, s, rest = t.partition("/")
            if (h == n or h.endswith("." + n)) and p.startswith(s + rest):
                best = w
        return best

    edges, seeds, hosts = defaultdict(int), {"allow": defaultdict(int), "block": defaultdict(int)}, set()
    for u, html in pages:
        h, p = parts(u)
        if h:
            hosts.add(h)
            if word(h, p):
                seeds[word(h, p)][h] += 1
        for b in {x.lower() for x in re.findall(r"(?i)(?:href|src)\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s<>]+)", html or "")}:
            if h and b != h:
                edges[h, b] += 1

    def flow(edges, seed):
        total, out = sum(seed.values()), defaultdict(int)
        for (a, _), n in edges.items():
            out[a] += n
        if not total or not edges:
            return {}, {}
        start = {h: math.floor(float(lt.MASS) * n / total) for h, n in seed.items()}
        mass, reached = dict(start), {}
        for _ in range(steps):
            reached = defaultdict(int)
            for (a, b), n in edges.items():
                if a in mass:
                    reached[b] += math.floor(mass[a] * (n / out[a]) * lt.FOLLOW)
            back = (lt.MASS - sum(reached.values())) / lt.MASS
            mass = defaultdict(int, reached)
            for h, s in start.items():
                mass[h] += math.floor(s * back)
        return reached, mass

    _, trust = flow(edges, seeds["allow"])
    distrust, _ = flow({(b, a): n for (a, b), n in edges.items()}, seeds["block"])
    even = lt.MASS / max(1, len(hosts))
    return {h for h, d in distrust.items() if d > trust.get(h, 0) and d > lt.THRESHOLD * even}


def link(*hosts):
    return "".join(f'<a class=x href="https://{h}/p">x</a><img SRC=\'//{h}/i.png\'>' for h in hosts)


PAGES = [
    ("http://bad.com/en/1", link("other.io")), ("http://bad.com/en/2", ""), ("http://farm1.io/", link("bad.com", "farm2.io")), ("http://farm2.io/", link("bad.com", "farm1.io")), ("http://farm3.io/", link("farm1.io", "Farm2.IO")),
    ("http://good.net/de/1", link("friend.io")), ("http://friend.io/", link("x.io", "good.net")), ("http://lone.io/", ""), ("http://friend.io/2", link("friend.io", "good.net")), (None, link("bad.com")), ("http://x.io", None),
    ("http://friend.io/2", link("friend.io", "good.net")),
]


def test_propagation_equals_the_plain_version(spark):
    blocked = plain(PAGES, URL_RULES)
    assert "farm1.io" in blocked and "farm2.io" in blocked and "lone.io" not in blocked and "bad.com" not in blocked
    got = lt.judge(table(spark, PAGES), URL_RULES).collect()
    assert {r["host"] for r in lt.host_verdicts(table(spark, PAGES), URL_RULES).collect()} == blocked
    for r in got:
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["host"] in blocked else "allow")


def test_random_graphs(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        hosts = [f"h{i}.io" for i in range(25)] + ["a.com", "b.com", "c.net", "d.net", "e.org"]
        pages = [(f"http://{rng.choice(hosts)}{rng.choice(['/en/1', '/de/1', '/es/x', '/'])}", link(*rng.sample(hosts, 3))) for _ in range(80)]
        assert {r["host"] for r in lt.host_verdicts(table(spark, pages), URL_RULES).collect()} == plain(pages, URL_RULES)


def test_a_chain_of_30_hosts_has_its_settled_order(spark):
    """h0 links to h1, h1 to h2 and so on; h25 is blocked. Distrust falls with each link back, down to h0."""
    pages = [(f"http://h{i}.io/", link(f"h{i + 1}.io")) for i in range(29)] + [("http://h29.io/", "")]
    got = {r["host"]: r["distrust"] for r in lt.host_verdicts(table(spark, pages), [("block", "h25.io/")], threshold=0.0).collect()}
    assert set(got) == {f"h{i}.io" for i in range(25)}
    assert sorted(got, key=got.get) == [f"h{i}.io" for i in range(25)]
    # of the mass at a host 85 % go on, the rest and what reaches the end return to the seed
    whole = sum(lt.FOLLOW**k for k in range(26))
    for i in range(25):
        assert got[f"h{i}.io"] == pytest.approx(lt.MASS * lt.FOLLOW ** (25 - i) / whole, abs=2 * lt.SETTLED * lt.MASS / 30)


def test_shape_and_empty_table(spark):
    df = table(spark, PAGES)
    got = lt.judge(df, URL_RULES)
    assert got.columns == ["page_id", "url", "good", "row", "_blocked", "blocked", "host", "path", "rule", "verdict"] and got.count() == len(PAGES)
    assert lt.judge(df.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        lt.judge(df, [("maybe", "com/")])


def test_query_matches_sql(spark, sf, duck, tmp_path):
    from strataquery.llm.queries import oracle_sql, queries

    got = queries()["op9_link_trust"](spark, sf)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, duck.sql(oracle_sql()["op9_link_trust"]).fetchall()))
    table(spark, PAGES).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    other = duck.cursor()
    sql = oracle_sql()["op9_link_trust"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries()["op9_link_trust"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, other.sql(sql).fetchall()))
