"""Registered queries against their SQL, and the entry module with and without its optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import catalog, code_rows  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["hubs", "callers_d3", "blast_radius_d3", "path_nodes", "detect_changes_affected", "session_dedup", "extract_python", "extract_script", "extract_manifest", "contract_patterns_all", "contract_links", "embed_nodes", "definition_edges", "type_info", "prompt_lookup", "scalar_functions", "detect_changes_risk", "entry_points", "traces_dedup", "search_fuzzy", "rrf_fuse", "dedup_nodes", "resolve_edges", "cluster_label", "contract_match_fuzzy", "contract_match_wildcard", "innermost_scope", "nearest_symbol", "ai_batches", "prompt_budget", "contract_normalize"]
ROOT = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FEW)
def test_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    done = sql.execute(catalog.ORACLE[name])
    theirs = [d[0] for d in done.description]
    assert sorted(theirs) == columns
    flat = lambda rows, names: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[names.index(c)] for c in columns)) for r in rows), key=repr)
    assert flat([tuple(r) for r in df.collect()], df.columns) == flat(done.fetchall(), theirs)


def test_every_query_has_a_name_and_a_plan(spark):
    assert len(catalog.QUERIES) >= 60 and set(catalog.ORACLE) <= set(catalog.QUERIES)
    path = catalog.QUERIES["path_nodes"](spark, DATA)
    assert path.columns == ["step", "name", "file", "line"]


def test_whole_traces_by_brute_force(spark):
    """Paths of up to ten nodes, those kept of them, and the processes made of those."""
    from collections import Counter, defaultdict

    from graphloom.operators import flows
    from graphloom.plans.derived import graph

    g = graph(spark, DATA)
    calls = [(r.src, r.dst) for r in g.edges.where("relation = 'calls'").collect()]
    degree, after = Counter(x for c in calls for x in c), defaultdict(set)
    for a, b in calls:
        after[a].add(b)
    names = {r.id: r.name for r in g.nodes.collect()}
    found, todo = set(), [(r.id,) for r in flows.entry_points(g.nodes, g.edges).collect()]
    while todo:
        p = todo.pop()
        on = sorted(after[p[-1]] - set(p), key=lambda x: (-degree[x], x))[:3] if len(p) < 10 else []
        todo += [(*p, x) for x in on]
        if not on and len(p) >= 3:
            found.add(p)
    assert any(len(p) > 4 for p in found)
    rows = catalog.QUERIES["traces"](spark, DATA).collect()
    assert sorted(map(tuple, rows)) == sorted((names[p[0]], names[p[-1]], len(p), ">".join(p)) for p in found)
    longest = {}
    for p in sorted(found, key=lambda p: (-len(p), ">".join(p))):
        longest.setdefault((names[p[0]], names[p[-1]]), p)
    kept = {p for p in longest.values() if not any(len(o) > len(p) and set(p) <= set(o) for o in longest.values())}
    assert {r.path for r in catalog.QUERIES["traces_dedup"](spark, DATA).collect()} == {">".join(p) for p in kept}
    most = sorted(kept, key=lambda p: (-len(p), ">".join(p)))[: max(20, len(names) // 10)]
    labels = sorted((f"{names[p[0]]} → {names[p[-1]]}", len(p)) for p in most)
    assert sorted((r.label, r.step_count) for r in catalog.QUERIES["process_labels"](spark, DATA).collect()) == labels


def test_entry_without_a_library(tmp_path):
    """The other queries load where a library of the optional part is missing."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 60 and 'hubs' in e.queries(); assert 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(ROOT)})


def test_entry_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
