"""The tools over a small build."""

import pytest

from graphloom.service import CodeGraph, safe
from graphloom.sources import extract, files
from graphloom.storage import materialize


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "utils.py").write_text("def helper():\n    return deep()\n\ndef deep():\n    return bottom()\n\ndef bottom():\n    return 1\n")
    (root / "main.py").write_text("from utils import helper\n\ndef main():\n    second()\n    third()\n\ndef second():\n    third()\n    fourth()\n\ndef third():\n    fourth()\n\ndef fourth():\n    return 1\n")
    (root / "package.json").write_text('{"name": "app", "dependencies": {"left-pad": "1"}}')
    return str(root), CodeGraph.build(spark, str(root), "p")


def names(df):
    return {r["name"] for r in df.collect()}


def test_questions(built):
    _, g = built
    assert names(g.callers("p", "main.py", "fourth")) == {"second", "third"}
    assert names(g.callers("p", "main.py", "fourth", 2)) == {"second", "third", "main"}
    assert [r["name"] for r in g.path("p", "main.py", "main", "main.py", "fourth").orderBy("step").collect()][0] == "main"
    assert "main" in names(g.blast_radius("p", "main.py", "fourth"))
    assert g.search("p", "helper").first()["name"] == "helper"
    assert g.hubs("p", 3).count() == 3 and g.clusters("p").count() > 0
    assert g.list_contracts("lib").count() == 2
    assert g.outline("p", "main.py").count() == 4
    assert g.lookup("p", "fourth").first()["callers"] == ["second", "third"]
    at_line = g.edit_context("p", "main.py", line=15).collect()
    assert [(r["name"], r["used_by"]) for r in at_line] == [("fourth", ["second (main.py:9)", "third (main.py:12)"])]
    assert names(g.edit_context("p", "main.py")) == {"second", "third", "fourth"}
    assert names(g.edit_context("elsewhere", "main.py", "fourth")) == {"fourth"} == names(g.edit_context("p", "gone.py", "fourth"))
    assert g.points("main.py").count() == 5 and g.points("main.py", "p", "third").count() == 1
    assert g.tool("hubs", project="p", top_n=2)[0].keys() == {"name", "file", "degree"}
    assert "error" in g.tool("hubs", wrong=1) and "error" in g.tool("none")
    assert g.vectors.count() == g.nodes.count() and "cluster_id" in g.nodes.columns
    assert [r["file"] for r in g.files_like("**/util*").collect()] == ["p/utils.py"]
    said = [r["line"] for r in g.query("p", "where is the helper").orderBy("place").collect()]
    assert said[0] == "Query: where is the helper" and said[2] == "NODES:" and "  helper [function] utils.py:1" in said[3:8]
    assert "  helper --calls--> deep" in said and "  deep --called_by--> helper" in said
    assert sum(len(r["line"]) + 1 for r in g.query("p", "where is the helper", budget=40).collect()) <= 120
    assert g.query("p", "where is the helper", mode="dfs").count() > 3
    assert g.query("p", "the and").first()["line"].startswith("No meaningful")
    found = g.detect_changes("p", ["main.py"])
    assert found["risk"].first()["risk"] in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    assert g.detect_changes("p", [])["risk"].first()["risk"] == "NONE"
    assert "nodes" in g.context("p") and "main" in g.report("p")
    assert any(r["label"].startswith("main") for r in g.list_processes().collect())


def test_rebuild_and_groups(built, spark):
    root, g = built
    with open(f"{root}/main.py", "w") as f:
        f.write("def fresh():\n    return 1\n")
    again = g.rebuild(root, "p", ["main.py"])
    assert "fresh" in names(again.nodes) and "second" not in names(again.nodes)
    assert names(again.members.join(again.nodes, "id")) == names(again.nodes)
    assert again.processes.where("label like 'main%'").isEmpty() and again.list_contracts("lib").count() == 2
    again.save(f"{root}/.tables")
    assert CodeGraph.load(spark, f"{root}/.tables").nodes.count() == again.nodes.count()


def test_rebuild_keeps_definitions(spark, tmp_path, monkeypatch):
    """A file that is read again and calls into one that isn't leaves that one's symbols as they are."""
    (tmp_path / "lib.py").write_text("\n\ndef used():\n    return 1\n")
    (tmp_path / "app.py").write_text("import lib\n\ndef run():\n    lib.used()\n")
    built = lambda: extract.build(files.read_files(spark, str(tmp_path), "p", files.tracked_files(str(tmp_path))))
    g = CodeGraph(spark, *built())
    monkeypatch.setattr(CodeGraph, "completed", lambda self, root, project: self)
    g = CodeGraph(spark, materialize(g.nodes, "nodes"), materialize(g.edges, "edges"))
    (tmp_path / "app.py").write_text("import lib\n\n\n\ndef run():\n    lib.used()\n")
    again, (nodes, edges) = g.rebuild(str(tmp_path), "p", ["app.py", "gone.py"]), built()
    rows = lambda x: sorted((r["file"], r["name"], r["type"], r["line"]) for r in x.collect())
    assert rows(again.nodes) == rows(nodes)
    ends = lambda x: sorted((r["src"], r["dst"], r["relation"]) for r in x.collect())
    assert ends(again.edges) == ends(edges)


def test_groups(built, spark):
    root, g = built
    grouped = g.group_create("team", ["p", ("q", "/x")]).group_sync("team")
    assert [r["name"] for r in grouped.group_list().collect()] == ["team"]
    assert {r["project"]: r["contracts"] for r in grouped.group_status("team").collect()} == {"p": 2, "q": 0}
    assert "main" in names(grouped.group_impact("team", "main.py", "fourth"))
    assert "error" in safe(CodeGraph.group_list)(g)
