"""From source files to raw nodes and edges: extractors over texts, names resolved by joins.

Executors see only the rows: an import's possible files come out as candidates, and which of them is a
file of the project is a join against the list of files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.store import resolve_edges, upsert_nodes
from graphloom.schemas import NODES
from graphloom.sources.facts import Facts
from graphloom.sources.manifests import GRAPH_MANIFESTS, MANIFESTS, extract_manifest, parse_manifest
from graphloom.sources.pattern_code import extract_go, extract_proto, extract_rust, extract_script, extract_shell, extract_solidity
from graphloom.sources.python_code import extract_python
from graphloom.storage import materialize

Extractor = Callable[[str, str], Facts]
EXTRACTORS: dict[str, Extractor] = {".py": extract_python, ".ts": extract_script, ".tsx": extract_script, ".js": extract_script, ".jsx": extract_script, ".rs": extract_rust, ".go": extract_go, ".proto": extract_proto, ".sh": extract_shell, ".bash": extract_shell, ".sol": extract_solidity}


def extractor_of(path: str) -> Extractor | None:
    """By a manifest's name, else by extension."""
    name = path.rpartition("/")[2]
    if name in GRAPH_MANIFESTS:
        return extract_manifest
    return EXTRACTORS.get("." + name.rpartition(".")[2]) if "." in name else None


def extract(path: str, text: str) -> Facts | None:
    """None for a file of no known kind, and for one that an extractor fails on."""
    found = extractor_of(path)
    if found is None:
        return None
    try:
        return found(path, text)
    except Exception:  # one odd file doesn't end a build; it has no facts
        return None


RAW = "project string, file string, kind string, name string, type string, line int, target string, relation string, confidence double, candidates array<string>, rest string, ord bigint"


def raw_facts(files: DataFrame) -> DataFrame:
    """files (project, path, content) -> nodes and edges as rows of RAW, in order within a file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for project, path, text in frame.itertuples(index=False):
                facts = extract(path, text or "")
                if facts is None:
                    continue
                for i, (name, kind, line) in enumerate(facts.nodes):
                    own = name if kind == "file" else path
                    rows.append((project, own, "node", name, kind, line, None, None, None, [], None, i))
                for i, (source, target, relation, confidence, line, candidates, rest) in enumerate(facts.edges):
                    rows.append((project, path, "edge", source, None, line, target, relation, confidence, candidates, rest, i))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW.split(", ")])

    return files.select("project", "path", "content").mapInPandas(run, RAW)


def resolve_imports(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of RAW whose first candidate that is a file becomes the target."""
    edges = raw.where("kind = 'edge'").select("project", "file", F.col("name").alias("source"), "target", "relation", "confidence", F.col("line").alias("source_line"), "candidates", "rest", "ord")
    wanted = edges.select("project", F.explode(F.array_distinct("candidates")).alias("path")).distinct()
    there = wanted.join(files.select("project", "path").distinct(), ["project", "path"], "left_semi")
    tried = edges.select("*", F.posexplode_outer("candidates").alias("nth", "path")).join(there.withColumn("found", F.lit(True)), ["project", "path"], "left")
    first = F.min_by("path", F.when(F.col("found"), F.col("nth"))).alias("hit")
    keys = ["project", "file", "source", "target", "relation", "confidence", "source_line", "rest", "ord"]
    out = tried.groupBy(*keys).agg(first)
    hit = F.when(F.col("rest").isNull(), F.col("hit")).otherwise(F.concat_ws(":", "hit", "rest"))
    return out.select("project", "file", "source", F.when(F.col("hit").isNotNull(), hit).otherwise(F.col("target")).alias("target"), "relation", "confidence", "source_line", "ord")


def build(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files (project, path, content) -> (nodes, edges) of a full build; with ``known`` nodes of other files,
    which names and imports may mean too, what these files add to them. Each file is parsed once."""
    raw = materialize(raw_facts(files), "facts")
    found = raw.where("kind = 'node'").select("project", "file", "name", "type", "line", "ord")
    paths = raw.select("project", F.col("file")).distinct().select("project", "file", F.col("file").alias("name"), F.lit("file").alias("type"), F.lit(0).alias("line"), F.lit(-1).cast("bigint").alias("ord"))
    nodes = upsert_nodes(files.sparkSession.createDataFrame([], NODES), found.unionByName(paths))
    if known is None:
        return resolve_edges(nodes, resolve_imports(raw, files))
    there = files.select("project", "path").union(known.where("type = 'file'").select("project", "file"))
    every, edges = resolve_edges(known.unionByName(nodes), resolve_imports(raw, there))
    return every.join(known.select("id"), "id", "left_anti"), edges


def dependencies(files: DataFrame) -> DataFrame:
    """Manifests among files -> (project, own, dep, confidence); a row with null dep for the own name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for project, path, text in frame.itertuples(index=False):
                own, deps = parse_manifest(path.rpartition("/")[2], text or "")
                rows += [(project, own, None, None), *((project, own, d, c) for d, c in deps)]
            yield pd.DataFrame(rows, columns=["project", "own", "dep", "confidence"])

    named = files.where(F.element_at(F.split("path", "/"), -1).isin(list(MANIFESTS)))
    return named.select("project", "path", "content").mapInPandas(run, "project string, own string, dep string, confidence double")
