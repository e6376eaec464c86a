"""Results of language servers and of models, as tables, joined into the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import kind_to_type
from graphloom.operators.ranks import numbered
from graphloom.operators.store import relate, resolve_edges
from graphloom.schemas import RELATIONS, node_key

#: Edges from a language server have this confidence.
SERVER_CONFIDENCE = 0.9


def innermost_scope(scopes: DataFrame, points: DataFrame) -> DataFrame:
    """scopes (file, name, start, end, ord), points (file, line) -> file, line, name of the smallest scope
    that holds the line, ties to the first; null without one. Within a file, a range join."""
    at = points.distinct().alias("p").join(scopes.alias("s"), (F.col("p.file") == F.col("s.file")) & (F.col("s.start") <= F.col("p.line")) & (F.col("p.line") <= F.col("s.end")), "left")
    inner = F.min_by(F.col("s.name"), F.struct(F.col("s.end") - F.col("s.start"), F.col("s.ord")))
    return at.groupBy(F.col("p.file").alias("file"), F.col("p.line").alias("line")).agg(inner.alias("name"))


def nearest_symbol(symbols: DataFrame, targets: DataFrame, within: int = 3) -> DataFrame:
    """symbols (file, name, kind, start_line, ord), targets (file, line) -> file, line, name, type: of the
    symbols on the line the last, else the nearest within three lines, ties to the first."""
    near = targets.distinct().alias("t").join(symbols.alias("s"), (F.col("t.file") == F.col("s.file")) & F.col("s.start_line").between(F.col("t.line") - within, F.col("t.line") + within))
    away = F.abs(F.col("s.start_line") - F.col("t.line"))
    order = F.struct(away, F.when(away == 0, -F.col("s.ord")).otherwise(F.col("s.ord")))
    return near.groupBy(F.col("t.file").alias("file"), F.col("t.line").alias("line")).agg(F.min_by(F.struct(F.col("s.name").alias("name"), kind_to_type(F.col("s.kind")).alias("type")), order).alias("b")).select("file", "line", "b.*")


def definition_edges(definitions: DataFrame, symbols: DataFrame, project: str) -> DataFrame:
    """definitions (file, source_name, source_line, target_file, target_line) -> raw import edges to the
    symbols that stand there; those to files without symbols fall away."""
    found = nearest_symbol(symbols, definitions.select(F.col("target_file").alias("file"), F.col("target_line").alias("line")))
    hit = definitions.join(found.select(F.col("file").alias("target_file"), F.col("line").alias("target_line"), "name"), ["target_file", "target_line"])
    return hit.select(F.lit(project).alias("project"), "file", F.col("source_name").alias("source"), F.concat_ws(":", "target_file", "name").alias("target"), F.lit("imports").alias("relation"), F.lit(SERVER_CONFIDENCE).alias("confidence"), "source_line")


def implementation_edges(found: DataFrame, symbols: DataFrame, project: str) -> DataFrame:
    """found (source_name, source_file, target_file, target_line) -> raw edges from the classes that
    implement to what they implement."""
    at = nearest_symbol(symbols, found.select(F.col("target_file").alias("file"), F.col("target_line").alias("line")))
    hit = found.join(at.select(F.col("file").alias("target_file"), F.col("line").alias("target_line"), "name"), ["target_file", "target_line"])
    return hit.select(F.lit(project).alias("project"), F.col("target_file").alias("file"), F.col("name").alias("source"), F.concat_ws(":", "source_file", "source_name").alias("target"), F.lit("implements").alias("relation"), F.lit(SERVER_CONFIDENCE).alias("confidence"), F.col("target_line").alias("source_line"))


def call_edges(calls: DataFrame, project: str) -> DataFrame:
    """Call hierarchies (caller_file, caller_name, callee_file, callee_name, source_line) as raw edges."""
    return calls.select(F.lit(project).alias("project"), F.col("caller_file").alias("file"), F.col("caller_name").alias("source"), F.concat_ws(":", "callee_file", "callee_name").alias("target"), F.lit("calls").alias("relation"), F.lit(SERVER_CONFIDENCE).alias("confidence"), "source_line")


def add_type_info(nodes: DataFrame, hover: DataFrame) -> DataFrame:
    """Hover texts (project, file, name, type_info, ord) set on the node of that project, file and name, of
    several nodes the one of the least id. Of several texts the last counts; empty ones change nothing."""
    key = ["project", "file", "name"]
    said = hover.where(F.coalesce("type_info", F.lit("")) != "").groupBy(*key).agg(F.max_by("type_info", F.struct("ord", "type_info")).alias("said"))
    first = nodes.join(said, key).groupBy(*key, "said").agg(F.min("id").alias("id")).select("id", "said")
    old = F.col("type_info") if "type_info" in nodes.columns else F.lit(None).cast("string")
    return nodes.join(first, "id", "left").withColumn("type_info", F.coalesce("said", old)).drop("said")


def server_pass(nodes: DataFrame, edges: DataFrame, project: str, symbols: DataFrame, definitions: DataFrame, implementations: DataFrame, calls: DataFrame, hover: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A language server's answers put into the graph: files with symbols as nodes, edges by definition,
    implementation and call, types from hover texts. Returns nodes, edges and counts (definitions,
    implementations, calls)."""
    parts = {"definitions": definition_edges(definitions, symbols, project), "implementations": implementation_edges(implementations, symbols, project), "calls": call_edges(calls, project)}
    counts = None
    for name, made in parts.items():
        one = made.agg(F.count("*").alias(name))
        counts = one if counts is None else counts.crossJoin(one)
    files = symbols.select(F.lit(project).alias("project"), "file", F.col("file").alias("name"), F.lit("file").alias("type"), F.lit(0).alias("line")).distinct()
    own = files.join(nodes.select("project", "file", "name"), ["project", "file", "name"], "left_anti").select(node_key().alias("id"), "project", "file", "name", "type", "line")
    columns = own.columns
    raw = parts["definitions"].unionByName(parts["implementations"]).unionByName(parts["calls"]).withColumn("ord", F.monotonically_increasing_id())
    plain = nodes.select(*columns).unionByName(own)
    every, new = resolve_edges(plain, raw)
    kept = edges.select("src", "dst", "relation", "confidence", "source_line").withColumn("ord", F.lit(0)).unionByName(new.select("src", "dst", "relation", "confidence", "source_line").withColumn("ord", F.lit(1)))
    return (add_type_info(every, hover) if hover is not None else every), relate(kept), counts


def parse_suggestions(answers: DataFrame) -> DataFrame:
    """answers (id, text) -> suggested edges: the text as a JSON array, else what a json fence holds, else
    from the first bracket to the last; entries with source, target and a relation there is."""
    entry = "array<struct<source:string,target:string,relation:string,confidence:double,line:int,reason:string>>"
    text = F.col("text")
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    span = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = F.coalesce(*[F.when(F.trim(t).startswith("["), F.from_json(F.trim(t), entry)) for t in (text, fence, span)])
    rows = answers.select("id", F.posexplode(parsed).alias("ord", "e")).select("id", "ord", "e.*")
    return rows.where(F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("relation").isin(list(RELATIONS)))


def batches(items: DataFrame, size: int, order: str = "file") -> DataFrame:
    """Items numbered in consecutive batches of a size, in order."""
    return numbered(items, [order], "_nth").withColumn("batch", F.floor(F.col("_nth") / size)).drop("_nth")
