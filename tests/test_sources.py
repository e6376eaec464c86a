"""Extractors, manifests, builds and tables of other tools."""

import subprocess

from graphloom.operators import tool_tables
from graphloom.sources import extract, files
from graphloom.sources.manifests import parse_manifest


def edges(path, text, relation=None):
    return [(e[0], e[1], e[2]) for e in extract.extract(path, text).edges if relation in (None, e[2])]


def test_python():
    facts = extract.extract("pkg/a.py", "import utils\nfrom .b import x as y\nclass A(Base):\n  def m(self):\n    y(1)\n    utils.helper()\n    d['k'] = open('a/b')\n    return c.get('z')\n")
    assert facts.nodes == [("pkg/a.py", "file", 0), ("A", "class", 3), ("m", "function", 4)]
    found = {(e[0], e[1], e[2]) for e in facts.edges}
    assert {("A", "Base", "implements"), ("m", "d.k", "writes"), ("m", "d.k", "reads"), ("m", "a/b", "reads"), ("m", "c.z", "reads"), ("m", "utils.helper", "calls")} <= found
    assert [e[5][0] for e in facts.edges if e[2] == "imports"] == ["utils.py", "pkg/b.py"]
    assert len(extract.extract("x.py", "def (").nodes) == 1


def test_other_languages():
    assert [n[0] for n in extract.extract("m.go", "package m\ntype S struct{}\nfunc (s *S) Do() { Run() }\nfunc Run() {}\n").nodes] == ["m.go", "S", "Do", "Run"]
    assert edges("m.go", "package m\nfunc (s *S) Do() { Run() }\n") == [("Do", "S", "implements"), ("Do", "Run", "calls")]
    rust = "use crate::a::B;\nmod z;\nfn run() { foo(1) }\nimpl T for S {}\n"
    assert edges("src/m.rs", rust) == [("src/m.rs", "crate::a::B", "imports"), ("src/m.rs", "z", "imports"), ("S", "T", "implements"), ("run", "foo", "calls")]
    shell = 'source "./lib.sh"\n. $D/x\ncat <<EOF\nfunction no() {\nEOF\nfunction a {\n}\nb() {\n}\n# function c {\n'
    facts = extract.extract("x.sh", shell)
    assert [n[0] for n in facts.nodes] == ["x.sh", "a", "b"] and [e[3] for e in facts.edges] == [1.0, 0.7]
    proto = 'import "b.proto";\nservice S {\n rpc Get(Req) returns (stream Res);\n}\nmessage M {\n Foo f = 1;\n string s = 2;\n}\n'
    assert edges("p.proto", proto) == [("p.proto", "b.proto", "imports"), ("Get", "Req", "calls"), ("Get", "Res", "calls"), ("p.proto", "Foo", "reads")]
    sol = "contract C is A {\n function f(uint x) external returns (uint) { require(x>0); g(x); }\n}\n"
    assert edges("c.sol", sol) == [("C", "A", "implements"), ("f", "g", "calls")]
    script = "import { foo as bar } from './lib'\nexport const f = async (x) => { bar(x); console.log(1); setA(2) }\nclass K extends B {}\n"
    assert ("f", "bar", "calls") in edges("s/a.ts", script) and ("K", "B", "implements") in edges("s/a.ts", script)
    assert [e[6] for e in extract.extract("s/a.ts", script).edges if e[2] == "calls"] == ["foo"]


def test_manifests():
    assert parse_manifest("package.json", '{"name": "a", "dependencies": {"b": "1"}, "devDependencies": {"c": "1"}}') == ("a", [("b", 0.8), ("c", 0.5)])
    assert parse_manifest("package.json", "{") == (None, [])
    assert parse_manifest("pyproject.toml", '[project]\nname = "a"\ndependencies = ["b[x]>=1", "c"]\n') == ("a", [("b", 0.8), ("c", 0.8)])
    assert parse_manifest("go.mod", "module m/x\nrequire (\n a/b v1\n // no\n)\n") == ("m/x", [("a/b", 0.8)])
    assert parse_manifest("composer.json", '{"name": "v/p", "require": {"php": "8", "x/y": "1"}}') == ("v/p", [("x/y", 0.8)])
    assert parse_manifest("Gemfile", "gem 'rails'\ngem \"pg\"\n") == (None, [("rails", 0.8), ("pg", 0.8)])
    assert parse_manifest("build.gradle", "implementation 'a.b:c:1.0'") == (None, [("a.b:c", 0.8)])
    facts = extract.extract("go.mod", "module m/x\nrequire (\n a/b v1.0.0\n c/d v2.0.0 // indirect\n)\nreplace a/b => ../b\n")
    assert [(e[1], e[2], e[3]) for e in facts.edges] == [("a/b", "imports", 1.0), ("c/d", "imports", 0.5), ("../b", "implements", 1.0)]


def test_build(spark, tmp_path):
    (tmp_path / "utils.py").write_text("def helper():\n    return 1\n")
    (tmp_path / "main.py").write_text("from utils import helper\n\ndef main():\n    helper()\n    print(1)\n")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "ignored.py").write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("ignored.py\n")
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    paths = files.tracked_files(str(tmp_path))
    assert paths == ["main.py", "utils.py"]
    nodes, edges_ = extract.build(files.read_files(spark, str(tmp_path), "p", paths))
    name = {r["id"]: (r["file"], r["name"]) for r in nodes.collect()}
    got = {(name[r["src"]], name[r["dst"]], r["relation"]) for r in edges_.collect()}
    assert got == {(("main.py", "main.py"), ("utils.py", "utils.py"), "imports"), (("main.py", "main"), ("utils.py", "helper"), "calls"), (("main.py", "main"), ("print", "print"), "calls")}
    assert files.changed_files(str(tmp_path / "nowhere")) == []
    assert files.walked_files(str(tmp_path)) == ["ignored.py", "main.py", "utils.py"]


def test_tool_tables(spark):
    scopes = spark.createDataFrame([("a", "outer", 1, 20, 0), ("a", "inner", 5, 9, 1)], "file string, name string, start int, end int, ord int")
    points = spark.createDataFrame([("a", 6), ("a", 15), ("a", 30)], "file string, line int")
    assert {(r["line"], r["name"]) for r in tool_tables.innermost_scope(scopes, points).collect()} == {(6, "inner"), (15, "outer"), (30, None)}
    symbols = spark.createDataFrame([("a", "f", 12, 10, 0), ("a", "g", 12, 10, 1), ("a", "C", 5, 13, 2)], "file string, name string, kind int, start_line int, ord int")
    points = spark.createDataFrame([("a", 10), ("a", 15), ("a", 20)], "file string, line int")
    assert {(r["line"], r["name"], r["type"]) for r in tool_tables.nearest_symbol(symbols, points).collect()} == {(10, "g", "function"), (15, "C", "class")}
    body = '[{"source": "a", "target": "b", "relation": "calls"}, {"source": "a", "target": "b", "relation": "likes"}]'
    said = spark.createDataFrame([(1, body), (2, f"x\n```json\n{body}\n```"), (3, f"Here: {body} done"), (4, "none")], "id int, text string")
    assert {(r["id"], r["relation"]) for r in tool_tables.parse_suggestions(said).collect()} == {(1, "calls"), (2, "calls"), (3, "calls")}
    items = spark.createDataFrame([(f"f{i:03}",) for i in range(23)], "file string")
    got = sorted((r["file"], r["batch"]) for r in tool_tables.batches(items, 5).collect())
    assert [b for _, b in got] == [i // 5 for i in range(23)]


def test_streaming(spark, tmp_path):
    from graphloom.streaming.incremental import build_on_commit, first_of_session

    events = spark.createDataFrame([("Bash", {"command": "git commit -m x"}), ("Bash", {"command": "ls"}), ("Edit", {"file": "a"})], "tool_name string, tool_input map<string,string>")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    query = build_on_commit(stream, lambda batch, i: seen.append(batch.count()), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert seen == [1]
    twice = spark.createDataFrame([("s", "k"), ("s", "k"), ("t", "k")], "session string, key string")
    assert first_of_session(twice, ["session", "key"]).count() == 2


def test_odd_paths(spark, tmp_path):
    """Brackets, quotes, globs and spaces in names, and in the folder's own."""
    root = tmp_path / "it's [a] {b}"
    for name in ("app/api/users/[id]/route.ts", "a*b.py", "sp ace.py", "it's.py", "pl+us%20.py", "q?.py", "{x}.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("def f():\n    pass\n" if name.endswith(".py") else "export function GET() {}\n")
    paths = files.tracked_files(str(root))
    got = files.read_files(spark, str(root), "p", paths).collect()
    assert len(paths) == 7 and sorted(r["path"] for r in got) == paths and all(r["content"] for r in got)
