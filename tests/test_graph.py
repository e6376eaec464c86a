"""Small literal graphs: queries, writes, flows, clusters, change impact."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clusters, flows, reports, search, store, traverse
from graphloom.schemas import node_key

CALLS = [("main", "process", 1.0, 12), ("process", "validate", 0.9, 28), ("validate", "check", 1.0, 7), ("helper", "validate", 0.8, 9)]
SYMBOLS = [("main", "app.py", 10, "function"), ("process", "app.py", 25, "function"), ("validate", "lib.py", 5, "function"), ("check", "lib.py", 30, "function"), ("config_key", "config.py", 1, "field"), ("helper", "util.py", 8, "function")]


def graph_of(spark, symbols, edges, project="proj"):
    nodes = spark.createDataFrame([(project, f, n, t, line) for n, f, line, t in symbols], "project string, file string, name string, type string, line int")
    nodes = nodes.select(node_key().alias("id"), "*")
    ids = {r["name"]: r["id"] for r in nodes.collect()}
    rows = [(ids[a], ids[b], rel, c, line) for a, b, rel, c, line in edges]
    return nodes, spark.createDataFrame(rows, "src string, dst string, relation string, confidence double, source_line int"), ids


@pytest.fixture(scope="module")
def g(spark):
    return graph_of(spark, SYMBOLS, [(a, b, "calls", c, n) for a, b, c, n in CALLS] + [("main", "config_key", "reads", 1.0, 11)])


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def names(df):
    return {r["name"] for r in df.collect()}


def test_callers_and_readers(spark, g):
    nodes, edges, ids = g
    one = traverse.incoming(nodes, edges, seeds(spark, ids["validate"]), "calls").collect()
    assert {(r["name"], r["confidence"], r["source_line"]) for r in one} == {("process", 0.9, 28), ("helper", 0.8, 9)}
    assert names(traverse.callers(nodes, edges, seeds(spark, ids["check"]), 2)) == {"validate", "process", "helper"}
    assert names(traverse.incoming(nodes, edges, seeds(spark, ids["config_key"]), "reads")) == {"main"}
    assert traverse.callers(nodes, edges, seeds(spark, ids["check"]), 0).count() == 0


def test_a_caller_on_a_cycle_is_its_own_caller(spark):
    nodes, edges, ids = graph_of(spark, SYMBOLS[:2], [("main", "process", "calls", 1.0, 1), ("process", "main", "calls", 1.0, 2)])
    assert names(traverse.callers(nodes, edges, seeds(spark, ids["main"]), 3)) == {"main", "process"}
    assert names(traverse.blast_radius(nodes, edges, seeds(spark, ids["main"]), 3)) == {"process"}


def test_paths(spark, g):
    nodes, edges, ids = g
    path = lambda a, b: [r["name"] for r in traverse.shortest_path(nodes, edges, seeds(spark, ids[a]), seeds(spark, ids[b])).orderBy("step").collect()]
    assert path("main", "check") == ["main", "process", "validate", "check"]
    assert path("check", "main") == ["check", "validate", "process", "main"]
    assert path("main", "main") == ["main"]
    lone = nodes.unionByName(nodes.limit(1).withColumns({"id": F.lit("zz"), "name": F.lit("lone")}))
    assert traverse.shortest_path(lone, edges, seeds(spark, ids["main"]), seeds(spark, "zz")).count() == 0
    assert traverse.path_length(lone, edges, seeds(spark, ids["main"]), seeds(spark, "zz")).first()["reachable"] is False


def test_blast_radius_and_hubs(spark, g):
    nodes, edges, ids = g
    assert names(traverse.blast_radius(nodes, edges, seeds(spark, ids["check"]), 1)) == {"validate"}
    assert names(traverse.blast_radius(nodes, edges, seeds(spark, ids["check"]), 3)) == {"validate", "process", "helper", "main"}
    assert traverse.blast_radius(nodes, edges, seeds(spark, ids["main"]), 3).count() == 0
    top = traverse.hubs(nodes, edges).collect()
    assert top[0]["name"] == "validate" and [r["degree"] for r in top] == sorted((r["degree"] for r in top), reverse=True)
    assert traverse.hubs(nodes.limit(0), edges).count() == 0


def test_relate_and_dedup(spark):
    rows = [("a", "b", "calls", 0.5, 1, 0), ("a", "b", "calls", 0.9, 2, 1), ("a", "b", "calls", 0.9, 3, 2), ("a", "c", "calls", 0.1, 4, 3)]
    edges = spark.createDataFrame(rows, "src string, dst string, relation string, confidence double, source_line int, ord long")
    assert {(r["dst"], r["confidence"], r["source_line"]) for r in store.relate(edges).collect()} == {("b", 0.9, 2), ("c", 0.1, 4)}
    assert {(r["dst"], r["source_line"]) for r in store.dedup_edges(edges).collect()} == {("b", 1), ("c", 4)}
    with pytest.raises(Exception, match="relation"):
        store.relate(edges.withColumn("relation", F.lit("likes"))).collect()
    with pytest.raises(ValueError, match="relation"):
        traverse.related(edges, ["likes"])


def test_upsert_and_keys(spark):
    schema = "project string, file string, name string, type string, line int, ord long"
    none = spark.createDataFrame([], "id string, project string, file string, name string, type string, line int")
    new = spark.createDataFrame([("p", "a.py", "f", "function", 1, 0), ("p", "a.py", "f", "function", 9, 1), ("q", "a.py", "f", "function", 1, 0)], schema)
    out = store.upsert_nodes(none, new)
    assert {(r["project"], r["line"]) for r in out.collect()} == {("p", 9), ("q", 1)}
    again = store.upsert_nodes(out, spark.createDataFrame([("p", "a.py", "f", "class", 3, 0)], schema))
    assert {(r["project"], r["type"], r["line"]) for r in again.collect()} == {("p", "class", 3), ("q", "function", 1)}
    assert spark.range(1).select(node_key(F.lit("proj"), F.lit("a.py"), F.lit("f"))).first()[0] == "029f5b58f91d4dfa"


def test_delete_and_incremental(spark, g):
    nodes, edges, ids = g
    files = spark.createDataFrame([("proj", "lib.py")], "project string, file string")
    left, kept = store.delete_files(nodes, edges, files)
    assert names(left) == {"main", "process", "config_key", "helper"} and kept.count() == 2
    again = nodes.where("file = 'lib.py'")
    own = edges.where(F.col("src").isin(ids["validate"], ids["check"]))
    same_nodes, same_edges = store.merge_incremental(nodes, edges, files, again, own)
    assert same_nodes.count() == 6 and same_edges.count() == 3
    assert store.merge_incremental(nodes, edges, files, again, own, keep_inbound=True)[1].count() == 5


def test_dedup_nodes(spark):
    key = spark.range(1).select(node_key(F.lit("p"), F.lit("a.py"), F.lit("f"))).first()[0]
    nodes = spark.createDataFrame([(key, "p", "a.py", "f", "function", 0, 0), ("r1", "p", "a.py", "f", "function", 42, 1), ("r2", "p", "a.py", "f", "function", 99, 2), ("r3", "p", "b.py", "g", "class", 7, 3)], "id string, project string, file string, name string, type string, line int, ord long")
    edges = spark.createDataFrame([("r1", "r3", "calls", 0.5, 1, 0), (key, "r3", "calls", 0.7, 2, 1), ("r3", "r2", "reads", 1.0, 3, 2)], "src string, dst string, relation string, confidence double, source_line int, ord long")
    kept, moved, counts = store.dedup_nodes(nodes, edges)
    assert {(r["id"], r["line"]) for r in kept.where("name = 'f'").collect()} == {(key, 99)}
    got = {(r["relation"], r["confidence"]) for r in moved.collect()}
    assert got == {("calls", 0.5), ("reads", 1.0)} or got == {("calls", 0.7), ("reads", 1.0)}
    assert counts.first()["groups_merged"] == 1


def test_resolve(spark):
    nodes = spark.createDataFrame([("x", "p", "a.py", "f", "function", 1)], "id string, project string, file string, name string, type string, line int").withColumn("id", node_key())
    raw = spark.createDataFrame(
        [("p", "a.py", "f", "b.py:h", "calls", 1.0, 1, 0), ("p", "a.py", "a.py", "std::io::X", "imports", 1.0, 2, 1), ("p", "a.py", "f", "print", "calls", 1.0, 3, 2), ("p", "a.py", "f", "f", "calls", 1.0, 4, 3), ("p", "a.py", "f", "z", "likes", 1.0, 4, 4)],
        "project string, file string, source string, target string, relation string, confidence double, source_line int, ord long",
    )
    out, edges = store.resolve_edges(nodes, raw)
    got = {(r["file"], r["name"], r["type"]) for r in out.collect()}
    assert got == {("a.py", "f", "function"), ("b.py", "h", "function"), ("std", ":io::X", "function"), ("print", "print", "file"), ("a.py", "a.py", "file")}
    assert edges.count() == 4


def test_ai_edges(spark, g):
    nodes, edges, ids = g
    said = spark.createDataFrame([("app.py:main", "app.py:process", "calls", 0.9, 3, 0), ("app.py:main", "x:y:z", "reads", None, None, 1), ("a", "b", "likes", 0.9, 3, 2), ("app.py:main", "x:y:z", "reads", 0.1, 1, 3)], "source string, target string, relation string, confidence double, line int, ord long")
    new, counts = store.store_ai_edges(edges, said, "proj", 1)
    assert [(r["relation"], r["confidence"], r["pass"]) for r in new.collect()] == [("reads", 0.8, 1)]
    assert tuple(counts.first()) == (1, 2, 1, ["unknown relation likes: 1"])


def test_search(spark):
    rows = [("p", f, n, "function", 1) for n, f in (("validate", "src/lib.py"), ("validate_user", "src/user.py"), ("validate", "tests/test_lib.py"), ("other", "src/validate/x.py"))]
    nodes = spark.createDataFrame(rows, "project string, file string, name string, type string, line int").select(node_key().alias("id"), "*")
    found = [(r["name"], r["file"]) for r in search.search(nodes, "the validate").collect()]
    assert found[0] == ("validate", "src/lib.py") and found.index(("validate", "tests/test_lib.py")) > found.index(("validate", "src/lib.py"))
    assert search.search_terms("The handler a validate") == (["handler", "validate"], ["hand", "vali"])
    ranks = spark.createDataFrame([(f"n{i}", i) for i in range(6)], "id string, rank int")
    files = spark.createDataFrame([(f"n{i}", "one.py" if i < 5 else "two.py") for i in range(6)], "id string, file string")
    fused = search.rank_fusion([ranks, ranks], files).collect()
    assert [r["id"] for r in fused] == ["n0", "n1", "n2", "n5"]


def test_flows(spark):
    symbols = [(n, "src/x.py", i, "function") for i, n in enumerate(["handler", "auth", "db", "connect", "validate", "leaf"])] + [("test_handler", "tests/x.py", 9, "function")]
    edges = [("handler", "auth"), ("handler", "validate"), ("auth", "db"), ("db", "connect"), ("validate", "db"), ("test_handler", "handler"), ("test_handler", "auth")]
    nodes, e, ids = graph_of(spark, symbols, [(a, b, "calls", 1.0, i) for i, (a, b) in enumerate(edges)])
    entries = flows.entry_points(nodes, e.where(F.col("src") != ids["test_handler"]))
    assert [r["name"] for r in entries.collect()] == ["handler"]
    found = flows.traces(e, entries.select("id"))
    by_id = {v: k for k, v in ids.items()}
    assert {tuple(by_id[x] for x in r["path"]) for r in found.collect()} == {("handler", "auth", "db", "connect"), ("handler", "validate", "db", "connect")}
    kept = flows.dedup_traces(nodes, found)
    assert kept.count() == 1
    made, steps = flows.processes(nodes, kept, "proj", 20)
    assert made.first()["label"] == "handler → connect" and made.first()["step_count"] == 4 and steps.count() == 4
    short = flows.traces(e, entries.select("id"), max_depth=3)
    assert {len(r["path"]) for r in short.collect()} == {3}


def test_communities(spark):
    symbols = [(f"a{i}", "auth/login.py", i, "function") for i in range(4)] + [(f"r{i}", "rewards/pay.py", i, "function") for i in range(4)]
    pairs = [(f"{x}{i}", f"{x}{j}") for x in "ar" for i in range(4) for j in range(i)] + [("a0", "r0")]
    nodes, e, ids = graph_of(spark, symbols, [(a, b, "calls", 1.0, 1) for a, b in pairs])
    members = clusters.communities(nodes, e)
    got = {r["id"]: r["cluster_id"] for r in members.collect()}
    assert len(set(got.values())) == 2 and len({got[ids[f"a{i}"]] for i in range(4)}) == 1
    assert {r["label"] for r in clusters.cluster_labels(nodes, members).collect()} == {"auth", "rewards"}
    assert {r["node_count"] for r in clusters.cluster_summaries(nodes, members).collect()} == {4}


def test_change_risk(spark, g):
    nodes, edges, ids = g
    schema = "file string, ord int"
    changed = spark.createDataFrame([("lib.py", 0)], schema)
    symbols = reports.changed_symbols(nodes, changed, "proj")
    hit = reports.affected(nodes, edges, symbols, "proj")
    assert names(hit) == {"process", "helper", "main"}
    risk = reports.change_risk(changed, symbols, hit, traverse.hubs(nodes, edges, 1)).first()
    assert (risk["risk"], risk["total_affected"], risk["hubs_affected"]) == ("LOW", 3, 0)
    assert reports.change_risk(changed.limit(0), symbols.limit(0), hit.limit(0), nodes).first()["risk"] == "NONE"
    assert reports.change_risk(changed, symbols, hit, hit).first()["risk"] == "CRITICAL"
    assert "validate" in reports.render_report(nodes, edges, None, "proj")


def modularity(pairs, of):
    m, degree = len(pairs), {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside = sum(of[a] == of[b] for a, b in pairs) / m
    total = {}
    for x, k in degree.items():
        total[of[x]] = total.get(of[x], 0) + k
    return inside - sum(k * k for k in total.values()) / (4 * m * m)


def test_communities_of_a_ring_of_cliques(spark):
    """Eight cliques of five in a ring: their modularity is nearly reached."""
    symbols = [(f"n{i}", f"d{i // 5}/x.py", i, "function") for i in range(40)]
    pairs = [(f"n{5 * c + i}", f"n{5 * c + j}") for c in range(8) for i in range(5) for j in range(i)] + [(f"n{5 * c}", f"n{(5 * c + 6) % 40}") for c in range(8)]
    nodes, e, ids = graph_of(spark, symbols, [(a, b, "calls", 1.0, 1) for a, b in pairs])
    got = {r["id"]: r["cluster_id"] for r in clusters.communities(nodes, e).collect()}
    assert len(got) == 40
    ideal = modularity(pairs, {f"n{i}": i // 5 for i in range(40)})
    assert modularity(pairs, {n: got[i] for n, i in ids.items()}) > 0.9 * ideal


def test_a_path_of_200_hops(spark):
    """And the same with every level written as a table, over fewer."""
    from graphloom import storage

    n = 201
    nodes = spark.createDataFrame([(f"n{i:03}", f"f{i}", "a.py", i) for i in range(n)], "id string, name string, file string, line int")
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", ["calls", "imports", "reads"][i % 3], 1.0) if i % 2 else (f"n{i + 1:03}", f"n{i:03}", "calls", 1.0) for i in range(n - 1)], "src string, dst string, relation string, confidence double")
    nodes, edges = storage.materialize(nodes, "t"), storage.materialize(edges, "t")
    end = lambda i: spark.createDataFrame([(f"n{i:03}",)], "id string")
    found = traverse.shortest_path(nodes, edges, end(0), end(200)).orderBy("step").collect()
    assert [r["step"] for r in found] == list(range(n)) and [r["name"] for r in found] == [f"f{i}" for i in range(n)]
    assert traverse.shortest_path(nodes, edges, end(0), end(50), most_hops=4).count() == 0
    assert [r["step"] for r in traverse.shortest_path(nodes, edges, end(7), end(7)).collect()] == [0]
    few, storage.FEW = storage.FEW, 0
    try:
        found = traverse.shortest_path(nodes, edges, end(0), end(9)).orderBy("step").collect()
        assert [r["name"] for r in found] == [f"f{i}" for i in range(10)]
        reached = traverse.bfs(end(5), edges, 3, "both").collect()
        assert sorted((r["id"], r["depth"]) for r in reached) == [("n002", 3), ("n003", 2), ("n004", 1), ("n006", 1), ("n007", 2), ("n008", 3)]
    finally:
        storage.FEW = few


def test_communities_both_ways(spark, monkeypatch):
    """Two rings joined by one edge, settled by the driver and by joins."""
    ring = lambda p, n: [(f"{p}{i}", f"{p}{j}") for i in range(n) for j in range(i)]
    rows = ring("a", 6) + ring("b", 7) + [("a0", "b0")]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in rows], "src string, dst string, relation string")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for r in rows for x in r})] + [("z",)], "id string")
    for few in (500_000, 0):
        monkeypatch.setattr(clusters, "FEW_LINKS", few)
        got = {r["id"]: r["cluster_id"] for r in clusters.communities(nodes, edges).collect()}
        assert {got[f"b{i}"] for i in range(7)} == {0} and {got[f"a{i}"] for i in range(6)} == {1} and got["z"] == 2
