import random

import pytest

from graphloom.llm.components import connected_components
from graphloom.llm.url_filter import filter_urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SCHEMA = "page_id long, url string, html string, host string, rule string, node string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", "n") for r in rows], SCHEMA)


def test_rules_and_aliases(spark):
    canonical = '<head><link rel="canonical" href="%s"></head>'
    rows = [
        (1, "http://A.example.org/x#f", canonical % "http://bad.net/"), (2, "http://bad.net/", None),
        (3, "https://c.org/y", "<META content='0; URL=/z' http-equiv=refresh>"), (4, "https://c.org/z", '<link href=//bad.net/q rel="x canonical">'),
        (5, "http://bad.net/q", ""), (6, None, None), (7, "zzz", "x"), (8, "http://p.org/fr/a", canonical % "b"), (9, "http://p.org/fr/b", canonical % "http://w.com/1"),
        (10, "http://w.com/1", canonical % "http://bad.net/w"), (1, "http://A.example.org/x", ""), (11, "http://q.net", ""), (12, "http://m.example.net/en/1", ""), (None, "http://bad.net/", ""),
    ]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages(spark, rows), RULES).collect()]
    want = [
        (1, "a.example.org", "/x", None, "block"), (1, "a.example.org", "/x", None, "block"), (2, "bad.net", "/", "net/", "block"), (3, "c.org", "/y", None, "block"),
        (4, "c.org", "/z", None, "block"), (5, "bad.net", "/q", "net/", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "p.org", "/fr/a", "org/fr/", "allow"),
        (9, "p.org", "/fr/b", "org/fr/", "allow"), (10, "w.com", "/1", None, "allow"), (11, "q.net", "", None, "allow"), (12, "m.example.net", "/en/1", "example.net/en/", "allow"),
        (None, "bad.net", "/", "net/", "block"),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_redirect_table_and_empty(spark):
    moved = spark.createDataFrame([("http://x.org/1", "http://y.com/2"), ("http://y.com/2", "http://z.net/3"), (None, "http://z.net/3")], "from_url string, to_url string")
    got = filter_urls(pages(spark, [(1, "http://x.org/1", None)]), RULES, moved).collect()
    assert [(r.page_id, r.verdict) for r in got] == [(1, "block")]
    assert filter_urls(pages(spark, []), RULES).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 230)] + [(None, 1), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(x.node, x.root) for x in got} == {(n, find(n)) for n in root}
    assert len(got) == len(root)
