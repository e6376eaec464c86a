"""The graph's tools as methods of one object, as a server would offer them.

Tables are DataFrames; each method returns a DataFrame or, for resources, a short text. ``safe`` turns an
exception into a row with its message, for callers that must not fail.
"""

from __future__ import annotations

import functools
import os
import traceback
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import clusters, contracts, embed, flows, reports, search, traverse
from graphloom.operators.store import delete_files, merge_incremental, store_clusters, store_processes
from graphloom.schemas import CONTRACT_LINKS, CONTRACTS, GROUPS, node_key
from graphloom.sources import extract, files
from graphloom.sources.manifests import MANIFESTS
from graphloom.storage import materialize

TABLES = ("nodes", "edges", "members", "processes", "steps", "contracts", "links", "groups", "vectors")
TOOLS = ("callers", "readers", "path", "blast_radius", "search", "hubs", "clusters", "cluster_members", "query", "detect_changes", "list_processes", "list_contracts", "group_list", "group_status", "group_impact", "outline", "lookup", "edit_context", "points", "files_like", "context", "hubs_text", "clusters_text", "processes_text", "report")


def safe(method):
    @functools.wraps(method)
    def run(*args, **kwargs):
        try:
            return method(*args, **kwargs)
        except Exception:
            return {"error": traceback.format_exc()}

    return run


@dataclass(frozen=True)
class CodeGraph:
    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame | None = None
    processes: DataFrame | None = None
    steps: DataFrame | None = None
    contracts: DataFrame | None = None
    links: DataFrame | None = None
    groups: DataFrame | None = None
    vectors: DataFrame | None = None

    # ---- building

    @staticmethod
    def build(spark: SparkSession, root: str, project: str) -> CodeGraph:
        """A full build of a folder: extraction, communities, flows, contracts, vectors. A step after
        extraction that fails leaves its tables out."""
        nodes, edges = extract.build(files.read_files(spark, root, project, files.tracked_files(root)))
        return CodeGraph(spark, materialize(nodes, "nodes"), materialize(edges, "edges")).completed(root, project)

    def rebuild(self, root: str, project: str, changed: Sequence[str], keep_inbound: bool = False) -> CodeGraph:
        """An incremental build: changed files are taken out and read again if they are there; with any
        read, the steps after extraction run anew."""
        known = [p for p in changed if files.wanted(p)]
        there = [p for p in known if os.path.isfile(os.path.join(root, p))]
        gone = self.spark.createDataFrame([(project, p) for p in known], "project string, file string")
        plain = self.nodes.select("id", "project", "file", "name", "type", "line")
        new_nodes, new_edges = extract.build(files.read_files(self.spark, root, project, there), delete_files(plain, self.edges, gone)[0])
        nodes, edges = merge_incremental(plain, self.edges, gone, new_nodes, new_edges, keep_inbound)
        after = replace(self, nodes=materialize(nodes, "nodes"), edges=materialize(edges, "edges"))
        return after.completed(root, project) if there else after

    def completed(self, root: str, project: str) -> CodeGraph:
        """With the steps after extraction, each on its own: one that fails leaves what was there."""
        found = files.read_files(self.spark, root, project, [p for p in files.tracked_files(root) if p.rpartition("/")[2] in MANIFESTS])
        graph = self
        for step in (CodeGraph.with_clusters, lambda g: g.with_processes(project), lambda g: g.with_contracts(found), CodeGraph.with_vectors):
            made = safe(step)(graph)
            graph = made if isinstance(made, CodeGraph) else graph
        return graph

    def save(self, path: str) -> None:
        """Every table there is as Parquet, in a folder of its name below path."""
        for name in TABLES:
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CodeGraph:
        def read(name: str) -> DataFrame | None:
            try:
                return spark.read.parquet(f"{path}/{name}")
            except AnalysisException:
                return None

        return CodeGraph(spark, **{name: read(name) for name in TABLES})

    def with_clusters(self) -> CodeGraph:
        members = materialize(clusters.communities(self.nodes, self.edges), "members")
        return replace(self, members=members, nodes=materialize(store_clusters(self.nodes, members), "nodes"))

    def with_vectors(self) -> CodeGraph:
        return replace(self, vectors=materialize(embed.embed_nodes(self.nodes), "vectors"))

    def with_processes(self, project: str = "") -> CodeGraph:
        entries = flows.entry_points(self.nodes, self.edges).select("id")
        kept = flows.dedup_traces(self.nodes, flows.traces(self.edges, entries))
        of = self.members.withColumnRenamed("id", "node_id") if self.members is not None else None
        made, steps = flows.processes(self.nodes, kept, project, flows.process_cap(self.nodes.count()), of)
        if self.processes is not None and self.steps is not None:
            made, steps = store_processes(self.processes, self.steps, made, steps, project)
        return replace(self, processes=materialize(made, "processes"), steps=materialize(steps, "steps"))

    def with_contracts(self, found: DataFrame | None = None) -> CodeGraph:
        rows = contracts.structural(self.nodes, traverse.callee_names(self.nodes, self.edges)).drop("pattern")
        if found is not None:
            libs = contracts.lib_contracts(extract.dependencies(found), self.nodes.select("project"))
            rows = rows.unionByName(libs.select("project", F.lit(None).cast("string").alias("symbol_node"), F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("symbol_file"), F.lit("lib").alias("contract_type"), "role", "contract_id", "confidence"))
        kept = materialize(contracts.stored(rows.withColumn("ord", F.xxhash64("symbol_node", "contract_id"))), "contracts")
        return replace(self, contracts=kept, links=materialize(contracts.match_all(kept), "links"))

    # ---- questions

    def _seed(self, project: str, file: str, name: str) -> DataFrame:
        return self.spark.range(1).select(node_key(F.lit(project), F.lit(file), F.lit(name)).alias("id"))

    def callers(self, project: str, file: str, function: str, depth: int = 1) -> DataFrame:
        start = self._seed(project, file, function)
        return traverse.incoming(self.nodes, self.edges, start, "calls") if depth == 1 else traverse.callers(self.nodes, self.edges, start, depth)

    def readers(self, project: str, file: str, field: str) -> DataFrame:
        return traverse.incoming(self.nodes, self.edges, self._seed(project, file, field), "reads").drop("source_line")

    def path(self, project: str, file_a: str, name_a: str, file_b: str, name_b: str) -> DataFrame:
        return traverse.shortest_path(self.nodes, self.edges, self._seed(project, file_a, name_a), self._seed(project, file_b, name_b))

    def blast_radius(self, project: str, file: str, function: str, depth: int = 3) -> DataFrame:
        """From the symbol and its file."""
        start = self._seed(project, file, function).union(self._seed(project, file, file))
        return traverse.blast_radius(self.nodes, self.edges, start, depth)

    def search(self, project: str, query: str, limit: int = 15) -> DataFrame:
        return search.search(self._own(project), query, limit).drop("score")

    def hubs(self, project: str, top_n: int = 10) -> DataFrame:
        return traverse.hubs(self._own(project), self.edges, top_n)

    def clusters(self, project: str) -> DataFrame:
        return clusters.cluster_summaries(self._own(project), self._members(project)).orderBy(F.desc("node_count"), "cluster_id")

    def cluster_members(self, project: str, label: str) -> DataFrame:
        labels = clusters.cluster_summaries(self._own(project), self._members(project)).select("cluster_id", "label")
        return clusters.cluster_members(self._own(project), self._members(project), labels, label)

    def query(self, project: str, question: str, mode: str = "bfs", depth: int = 2, budget: int = 2000, vector: DataFrame | None = None) -> DataFrame:
        """Lines of an answer. Seeds are lexical ones, those of processes and, where there are vectors and
        a vector of the question, near ones, fused by rank."""
        terms, own = search.question_terms(question), self._own(project)
        if not terms:
            return self.spark.createDataFrame([("No meaningful search terms found.",)], "line string")
        lists = [search.ranked(search.lexical_seeds(own, terms), F.desc("score"), "id")]
        if self.vectors is not None:
            asked = vector if vector is not None else embed.embed_question(self.nodes, question)
            near = self.vectors.join(own.select("id"), "id", "left_semi")
            lists.append(search.ranked(search.nearest_vectors(near, asked), "dist", "id"))
        if self.processes is not None and self.steps is not None:
            lists.append(search.process_seeds(self.processes, self.steps, terms).select("id", (F.col("rank") - 1).alias("rank")))
        return search.answer(self.nodes, self.edges, search.rank_fusion(lists, own), depth, budget, question, mode)

    def detect_changes(self, project: str, changed: Sequence[str], depth: int = 2) -> dict[str, DataFrame]:
        given = self.spark.createDataFrame([(f, i) for i, f in enumerate(changed)], "file string, ord int")
        symbols = reports.changed_symbols(self._own(project), given, project)
        hit = reports.affected(self.nodes, self.edges, symbols, project, depth)
        out = {"symbols": symbols, "affected": hit, "risk": reports.change_risk(given, symbols, hit, self.hubs(project))}
        if self.processes is not None and self.steps is not None:
            out["flows"] = reports.flows_affected(self.processes, self.steps, symbols.select("id").union(hit.select("id")))
        if self.contracts is not None and self.links is not None:
            touched = given.select(F.lit("file").alias("kind"), F.col("file").alias("value")).union(symbols.select(F.lit("name"), "name"))
            out["contracts"] = reports.linked_contracts(self.contracts, self.links, touched, project)
        return out

    def list_processes(self, query: str = "", limit: int = 20) -> DataFrame:
        rows = self._have(self.processes, "processes")
        return rows.where(F.lower("label").contains(query.lower())).orderBy(F.desc("step_count"), "label").limit(limit)

    def list_contracts(self, contract_type: str | None = None, role: str | None = None, limit: int = 50) -> DataFrame:
        return contracts.filtered(self._have(self.contracts, "contracts"), contract_type, role, limit)

    # ---- groups

    def group_create(self, name: str, members: Sequence[str | tuple[str, str]], detect: dict[str, bool] | None = None) -> CodeGraph:
        """Sets a group; bare names are projects without a path, kinds of contracts are on by default."""
        pairs = [(m, "") if isinstance(m, str) else tuple(m) for m in members]
        on = {k: True for k in ("http", "lib", "topic", "grpc", "onchain")} | (detect or {})
        row = self.spark.createDataFrame([(name, pairs, on)], GROUPS)
        rest = self.groups.where(F.col("name") != name) if self.groups is not None else self.spark.createDataFrame([], GROUPS)
        return replace(self, groups=rest.unionByName(row))

    def group_list(self) -> DataFrame:
        return self._have(self.groups, "groups").orderBy("name")

    def group_status(self, name: str) -> DataFrame:
        none = lambda schema: self.spark.createDataFrame([], schema)
        held = self.contracts if self.contracts is not None else none(CONTRACTS)
        return contracts.group_status(self._have(self.groups, "groups").where(F.col("name") == name), held, self.links if self.links is not None else none(CONTRACT_LINKS))

    def group_sync(self, name: str) -> CodeGraph:
        """Links between the members' contracts, in place of those they had."""
        members = self._have(self.groups, "groups").where(F.col("name") == name).select(F.explode("members.project").alias("project"))
        own = self._have(self.contracts, "contracts").join(members, "project", "left_semi")
        new = contracts.match_all(own)
        ids = own.select("id")
        old = self.links if self.links is not None else new.limit(0)
        kept = old.join(ids, old["consumer_id"] == ids["id"], "left_anti").join(ids, old["provider_id"] == ids["id"], "left_anti")
        return replace(self, links=materialize(kept.unionByName(new), "links"))

    def group_impact(self, name: str, file: str, function: str, depth: int = 2) -> DataFrame:
        """From the first member project that has the file, over linked contracts to the others."""
        members = [r["project"] for r in self._have(self.groups, "groups").where(F.col("name") == name).select(F.explode("members.project").alias("project")).collect()]
        has = {r["project"] for r in self.nodes.where(F.col("project").isin(members) & (F.col("file") == file)).select("project").distinct().collect()}
        home = next((m for m in members if m in has), members[0] if members else "")
        start = self._seed(home, file, function).union(self._seed(home, file, file))
        return reports.group_impact(self.nodes, self.edges, self._have(self.contracts, "contracts"), self._have(self.links, "links"), start, home, members, depth)

    # ---- resources

    def context(self, project: str) -> str:
        row = reports.report_stats(self._own(project), self.edges).first()
        return f"{project}: " + (f"{row['nodes']} nodes, {row['files']} files, {row['edges']} edges" if row else "nothing indexed")

    def hubs_text(self, project: str) -> str:
        return "\n".join(f"{r['name']} ({r['file']}) {r['degree']}" for r in self.hubs(project, 15).collect())

    def clusters_text(self, project: str) -> str:
        return "\n".join(f"{r['label']}: {r['node_count']}" for r in self.clusters(project).limit(20).collect())

    def processes_text(self) -> str:
        return "\n".join(f"{r['label']} ({r['step_count']})" for r in self.list_processes().collect())

    def tool(self, name: str, **given):
        """One of TOOLS by name: its rows as dictionaries, a text as it is, or {"error": ...}."""
        if name not in TOOLS:
            return {"error": f"no tool {name!r}"}

        def run():
            out = getattr(self, name)(**given)
            listed = lambda x: [r.asDict(True) for r in x.collect()] if isinstance(x, DataFrame) else x
            return {k: listed(v) for k, v in out.items()} if isinstance(out, dict) else listed(out)

        return safe(run)()

    def write_report(self, project: str, path: str) -> str:
        """The report as a file for people; small, so the driver writes it."""
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.report(project))
        return path

    def report(self, project: str) -> str:
        summaries = self.clusters(project) if self.members is not None else None
        return reports.render_report(self._own(project), self.edges, summaries, project)

    # ---- for editors

    def outline(self, project: str, file: str) -> DataFrame:
        return reports.file_outline(self.nodes, self.edges, project, file)

    def lookup(self, project: str, name: str, most_callers: int = 5) -> DataFrame:
        """Symbols of a name, in the project or else anywhere, with callers; ~ marks unsure ones."""
        own = self._own(project).where(F.col("name") == name)
        rows = own if not own.isEmpty() else self.nodes.where(F.col("name") == name).orderBy("id").limit(10)
        calls = self.edges.where("relation = 'calls'").join(rows.select(F.col("id").alias("dst")), "dst", "left_semi")
        said = F.concat(F.when(F.col("confidence") < 1, "~").otherwise(""), F.col("name"))
        by = calls.join(self.nodes.select(F.col("id").alias("src"), "name"), "src").groupBy(F.col("dst").alias("id")).agg(F.slice(F.sort_array(F.collect_set(said)), 1, most_callers).alias("callers"))
        return rows.join(by, "id", "left").select("project", "file", "name", "type", "line", "callers")

    def edit_context(self, project: str, file: str, function: str | None = None, line: int | None = None) -> DataFrame:
        """What an edit touches: (kind, name, used_by). With a function, or the last one that begins at or
        above a line, its callers and the readers of the file's fields; else the callers of all functions
        of the file and the readers of its fields. A file that the project doesn't have is looked for in
        the others, then by the name of the function or of the file."""
        here = self.nodes.where((F.col("project") == project) & (F.col("file") == file)).limit(1)
        stem = file.rpartition("/")[2].partition(".")[0]
        other = self.nodes.where(F.col("file") == file).orderBy("project", "id").limit(1)
        named = self.nodes.where((F.col("name") == (function or stem)) & (F.col("type") == ("function" if function else "file"))).orderBy("project", "id").limit(1)
        at = next((r for r in (x.select("project", "file").first() for x in (here, other, named)) if r), None)
        if at:
            project, file = at["project"], at["file"]
        own = self.nodes.where((F.col("project") == project) & (F.col("file") == file))
        if function is None and line is not None:
            last = own.where((F.col("type") == "function") & (F.col("line") <= line)).orderBy(F.desc("line"), "name").first()
            function = last["name"] if last else None
        about = own.where((F.col("type") == "field") | ((F.col("type") == "function") & (F.lit(function is None) | (F.col("name") == function))))
        uses = F.when(F.col("type") == "field", "reads").otherwise("calls")
        target = about.select(F.col("id").alias("dst"), F.col("type").alias("kind"), F.col("name").alias("what"), uses.alias("relation"))
        hit = self.edges.join(target, ["dst", "relation"]).join(self.nodes.select(F.col("id").alias("src"), "name", "file"), "src")
        who = F.concat(F.when(F.coalesce("confidence", F.lit(1.0)) < 1, "~").otherwise(""), F.col("name"), F.lit(" ("), F.col("file"), F.lit(":"), F.coalesce("source_line", F.lit(0)).cast("string"), F.lit(")"))
        return hit.groupBy("kind", F.col("what").alias("name")).agg(F.sort_array(F.collect_set(who)).alias("used_by"))

    def points(self, file: str, project: str | None = None, name: str | None = None) -> DataFrame:
        """Nodes of a file, in one project or all, and of a name if given."""
        rows = self.nodes.where(F.col("file") == file)
        for column, value in (("project", project), ("name", name)):
            rows = rows.where(F.col(column) == value) if value is not None else rows
        return rows.orderBy("project", "line", "name")

    def files_like(self, glob: str, most: int = 12) -> DataFrame:
        """Files whose path holds the last part of a glob without its wildcards."""
        text = glob.rpartition("/")[2].replace("*", "").replace("?", "")
        return self.nodes.where(F.col("file").contains(text)).select(F.concat_ws("/", "project", "file").alias("file")).distinct().orderBy("file").limit(most)

    def _own(self, project: str) -> DataFrame:
        return self.nodes.where(F.col("project") == project).drop("cluster_id")

    def _members(self, project: str) -> DataFrame:
        return self._have(self.members, "clusters").join(self._own(project).select("id"), "id", "left_semi")

    @staticmethod
    def _have(table: DataFrame | None, what: str) -> DataFrame:
        if table is None:
            raise ValueError(f"no {what} here: build them first")
        return table
