from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import hooks, tool_tables


def test_terms_and_names(spark):
    rows = [("Grep", {"pattern": "fooBar"}), ("Grep", {"pattern": "a.*b"}), ("Bash", {"command": "grep -rn 'one|two' src"}), ("Bash", {"command": "rg needle"}), ("Bash", {"command": "ls"}), ("Edit", {"file": "x"}), ("Bash", {"command": "cat a | grep -A 3 -n \"some_name\" b"}), ("Bash", {"command": "/usr/bin/egrep -i a.b|c-d ."}), ("Bash", {"command": "flag x"}), ("Bash", {"command": "rg"})]
    df = spark.createDataFrame(rows, "tool string, given map<string,string>")
    assert [r[0] for r in df.select(hooks.search_term(F.col("tool"), F.col("given"))).collect()] == ["fooBar", None, "one", "needle", None, None, "some_name", "c-d", None, None]
    said = spark.createDataFrame([("Find where parse_config and the Loader call loader or something else",)], "t string")
    assert said.select(hooks.prompt_names(F.col("t"))).first()[0] == ["parse_config", "Loader", "something"]
    assert spark.range(1).select(hooks.candidates(F.lit("getUserName"))).first()[0] == ["getusername", "getus", "getu", "get-user-name"]


def test_lookup_scope_and_budget(spark):
    nodes = spark.createDataFrame([("1", "load_config", "a.py", "function", 3), ("2", "main", "b.py", "function", 1)], "id string, name string, file string, type string, line int")
    edges = spark.createDataFrame([("2", "1", "calls")], "src string, dst string, relation string")
    prompts = spark.createDataFrame([(7, "please explain load_config")], "id int, text string")
    got = hooks.prompt_lookup(nodes, edges, prompts).collect()
    assert [(r["term"], r["name"], r["callers"]) for r in got] == [("load_config", "load_config", ["main"])]
    scopes = spark.createDataFrame([("a", "f", 1, 9), ("a", "g", 2, 4)], "file string, name string, start int, end int")
    edits = spark.createDataFrame([(1, "a", "x\ny\n  old line\nz", "old line\nmore"), (2, "a", "x", "none")], "id int, file string, content string, old string")
    assert [(r["id"], r["name"]) for r in hooks.enclosing(scopes, edits).collect()] == [(1, "g")]
    rows = spark.createDataFrame([(i, "a", "calls", "b") for i in range(5)], "ord int, source string, relation string, target string")
    lines = [r["line"] for r in hooks.edge_lines(rows, 30).orderBy(F.col("ord").asc_nulls_last()).collect()]
    assert lines == ["a --calls--> b", "a --calls--> b", "[... and 3 more]"]
    assert hooks.edge_lines(rows, 4000).count() == 5
    plan = hooks.pass_plan(spark.range(23)).first()
    assert (plan["total_files"], plan["batches"], plan["agents"]) == (23, 3, 7)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.split_camel(F.lit("getUserName_by-id.x"))) == ["get", "user", "name", "by", "id", "x"]
    assert one(text.name_tokens(F.lit("TRSDistributor"))) == ["trs", "distributor"]
    assert one(text.name_tokens(F.lit("getDistributorClient"))) == ["get", "distributor", "client"]
    assert one(text.strip_version(F.lit("name[extra]>=1"))) == "name"
    assert one(text.uri_to_path(F.lit("file:///r/a%20b.py"), "/r")) == "a b.py" and one(text.relative_to(F.lit("/x/a"), "/r")) is None
    assert one(text.is_test_file(F.lit("latest/x.py"))) and not one(text.is_test_file(F.lit("lib/contest-utils.ts")))
    assert one(text.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert one(text.path_of_match(F.lit("users\\list.ts"))) == "users/list"


def test_server_tables(spark):
    symbols = spark.createDataFrame([("b.py", "Base", 5, 10, 0)], "file string, name string, kind int, start_line int, ord int")
    found = spark.createDataFrame([("a.py", "f", 3, "b.py", 11), ("a.py", "f", 3, "b.py", 90)], "file string, source_name string, source_line int, target_file string, target_line int")
    assert [(r["source"], r["target"], r["relation"], r["confidence"]) for r in tool_tables.definition_edges(found, symbols, "p").collect()] == [("f", "b.py:Base", "imports", 0.9)]
    made = spark.createDataFrame([("I", "a.py", "b.py", 10)], "source_name string, source_file string, target_file string, target_line int")
    assert [(r["file"], r["source"], r["target"]) for r in tool_tables.implementation_edges(made, symbols, "p").collect()] == [("b.py", "Base", "a.py:I")]
    nodes = spark.createDataFrame([("1", "p", "b.py", "Base"), ("2", "q", "b.py", "Base"), ("3", "p", "b.py", "Base")], "id string, project string, file string, name string")
    hover = spark.createDataFrame([("p", "b.py", "Base", "class Base", 1), ("p", "b.py", "Base", "", 2), ("p", "b.py", "Base", "old", 0)], "project string, file string, name string, type_info string, ord int")
    assert {r["id"]: r["type_info"] for r in tool_tables.add_type_info(nodes, hover).collect()} == {"1": "class Base", "2": None, "3": None}
