"""Counts, outlines and change impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.store import first_per
from graphloom.operators.traverse import bfs, degrees, hubs
from graphloom.schemas import node_key


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def project_degrees(nodes: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    """(id, name, file, degree) of a project's nodes over edges inside it."""
    own = nodes.where(F.col("project") == project)
    inside = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    return own.join(degrees(inside), "id", "left").select("id", "name", "file", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame, project: str) -> DataFrame:
    return project_degrees(nodes, edges, project).where("degree = 0").select("name", "file")


def directory_map(nodes: DataFrame) -> DataFrame:
    """Files and nodes below each first folder."""
    return nodes.groupBy(F.split("file", "/")[0].alias("folder")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("nodes"))


def report_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: nodes, files, edges that begin there."""
    of = nodes.select(F.col("id").alias("src"), "project")
    begun = edges.join(of, "src").groupBy("project").agg(F.count("*").alias("edges"))
    return nodes.groupBy("project").agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files")).join(begun, "project", "left").select("project", "nodes", "files", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


def render_report(nodes: DataFrame, edges: DataFrame, clusters: DataFrame | None = None, project: str = "") -> str:
    """The report as Markdown: counts, hubs, clusters of five nodes or more, folders. Collects a few rows."""
    head = nodes.agg(F.count("*"), F.countDistinct("file")).first()
    lines = [f"# Code graph: {project}", "", f"{head[0]} nodes in {head[1]} files", "", "## Hubs", ""]
    lines += [f"- {r['name']} ({r['file']}): {r['degree']}" for r in hubs(nodes, edges, 15).collect()]
    if clusters is not None:
        lines += ["", "## Clusters", ""]
        few = clusters.where("node_count >= 5").orderBy(F.desc("node_count"), "cluster_id").limit(20)
        lines += [f"- {r['label']} ({r['node_count']}): {', '.join(r['key_files'][:4])}; {', '.join((r['key_functions'] or [])[:4])}" for r in few.collect()]
    lines += ["", "## Folders", ""]
    lines += [f"- {r['folder']}: {r['files']} files" for r in directory_map(nodes).orderBy(F.desc("files"), "folder").collect()]
    return "\n".join(lines) + "\n"


def changed_symbols(nodes: DataFrame, changed: DataFrame, project: str, most_files: int = 20, per_file: int = 10) -> DataFrame:
    """Symbols of the first changed files (file, ord): id, name, file, line; by line, name in a file."""
    files = changed.orderBy("ord", "file").limit(most_files).select("file")
    rows = nodes.where((F.col("project") == project) & (F.col("type") != "file")).join(F.broadcast(files), "file", "left_semi")
    return first_per(rows, ["file"], [F.col("line"), F.col("name"), F.col("id")], per_file).select("id", "name", "file", "line")


def affected(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, project: str, depth: int = 2) -> DataFrame:
    """What leads to changed symbols (id, file), or to their files, which imports point at; each name and
    file once: id, name, file, depth."""
    seeds = symbols.select("id").union(symbols.select(node_key(F.lit(project), "file", "file"))).distinct()
    reached = nodes.join(bfs(seeds, edges, depth), "id")
    return reached.groupBy("name", "file").agg(F.min("depth").alias("depth"), F.min("id").alias("id")).select("id", "name", "file", "depth")


def change_risk(changed: DataFrame, symbols: DataFrame, hit: DataFrame, top_hubs: DataFrame) -> DataFrame:
    """risk, total_affected, hubs_affected: NONE without files, else by what is affected; a hub among it
    makes it critical."""
    n_files, n_symbols = changed.agg(F.count("*").alias("files")), symbols.agg(F.count("*").alias("symbols"))
    n_hit = hit.agg(F.count("*").alias("total_affected"))
    n_hubs = hit.join(top_hubs.select("name", "file"), ["name", "file"], "left_semi").agg(F.count("*").alias("hubs_affected"))
    row = n_files.crossJoin(n_symbols).crossJoin(n_hit).crossJoin(n_hubs)
    n = F.col("total_affected")
    risk = F.when(F.col("files") == 0, "NONE").when(F.col("symbols") == 0, "LOW").when((n > 50) | (F.col("hubs_affected") > 0), "CRITICAL").when(n > 20, "HIGH").when(n > 5, "MEDIUM").otherwise("LOW")
    return row.select(risk.alias("risk"), "total_affected", "hubs_affected")


def flows_affected(processes: DataFrame, steps: DataFrame, symbols: DataFrame, most: int = 50) -> DataFrame:
    """Processes with a step among the first symbols (id): label, step_count."""
    few = symbols.orderBy("id").limit(most).select(F.col("id").alias("node_id"))
    hit = steps.join(few, "node_id", "left_semi").select(F.col("process_id").alias("id")).distinct()
    return processes.join(hit, "id", "left_semi").select("label", "step_count")


def linked_contracts(contracts: DataFrame, links: DataFrame, touched: DataFrame, project: str) -> DataFrame:
    """Contracts of other projects linked to those of a project that touch files or names (kind, value):
    by the links that go out, or those that come in where none goes out."""
    own = contracts.where(F.col("project") == project)
    by = lambda column, kind: own.join(touched.where(F.col("kind") == kind).select(F.col("value").alias(column)), column, "left_semi").select("id")
    start = by("symbol_file", "file").union(by("symbol_name", "name")).distinct()
    out = links.join(start, links["consumer_id"] == start["id"]).select(F.col("id").alias("start"), F.col("provider_id").alias("id"))
    into = links.join(start, links["provider_id"] == start["id"]).select(F.col("id").alias("start"), F.col("consumer_id").alias("id")).join(out.select("start").distinct(), "start", "left_anti")
    return out.unionByName(into).select("id").distinct().join(contracts, "id").where(F.col("project") != project).select("project", "contract_id").distinct()


def group_impact(nodes: DataFrame, edges: DataFrame, contracts: DataFrame, links: DataFrame, seeds: DataFrame, project: str, members: list[str], depth: int = 2) -> DataFrame:
    """project, name, file, depth of what a symbol reaches in its own project, and over linked contracts in
    the group's others: one traversal from all linked symbols at once."""
    local = nodes.join(bfs(seeds.select("id"), edges, depth), "id").select("project", "name", "file", "depth")
    names = local.select("name", "file").union(seeds.join(nodes, "id").select("name", "file"))
    touched = names.select(F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("file").alias("value")), F.struct(F.lit("name").alias("kind"), F.col("name").alias("value")))).alias("t")).select("t.*").distinct()
    linked = linked_contracts(contracts, links, touched, project).where(F.col("project").isin(members))
    there = contracts.join(linked, ["project", "contract_id"], "left_semi").where("symbol_node is not null").select(F.col("symbol_node").alias("id")).distinct()
    far = nodes.join(bfs(there, edges, depth), "id").select("project", "name", "file", "depth")
    return local.unionByName(far).groupBy("project", "name", "file").agg(F.min("depth").alias("depth"))


def file_outline(nodes: DataFrame, edges: DataFrame, project: str, file: str, most: int = 15, callers: int = 4) -> DataFrame:
    """Symbols of a file by line, functions with their first callers: name, type, line, callers."""
    own = nodes.where((F.col("project") == project) & (F.col("file") == file) & (F.col("type") != "file"))
    calling = edges.where("relation = 'calls'").join(own.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src")
    by = calling.groupBy(F.col("dst").alias("id")).agg(F.concat_ws(",", F.slice(F.sort_array(F.collect_set("caller")), 1, callers)).alias("callers"))
    return own.join(by, "id", "left").orderBy("line", "name").limit(most).select("name", "type", "line", F.coalesce("callers", F.lit("")).alias("callers"))
