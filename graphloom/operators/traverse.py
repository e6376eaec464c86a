"""One-hop expansion and breadth-first traversal over edge DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.schemas import RELATIONS, check_relation
from graphloom.storage import Levels


def related(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    return edges.where(F.col("relation").isin([check_relation(r) for r in relations]))


def incoming(nodes: DataFrame, edges: DataFrame, targets: DataFrame, relation: str) -> DataFrame:
    """Nodes with an edge of a relation to one of the targets (id): name, file, line, confidence, source_line."""
    hit = related(edges, [relation]).join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return hit.join(nodes.select(F.col("id").alias("src"), "name", "file", "line"), "src").select("name", "file", "line", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("source_line", F.lit(0)).alias("source_line"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node, so a self loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def hubs(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """The nodes of most edges: name, file, degree; ties by id."""
    return nodes.join(degrees(edges), "id").orderBy(F.desc("degree"), "id").limit(top_n).select("name", "file", "degree")


def step(frontier: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(id, start...) moved along the edges: "in" to the sources, "out" to the targets, "both"."""
    keep = [F.col(f"f.{c}") for c in frontier.columns if c != "id"]
    moved = []
    if direction in ("in", "both"):
        moved.append(edges.alias("e").join(frontier.alias("f"), F.col("f.id") == F.col("e.dst")).select(F.col("e.src").alias("id"), *keep))
    if direction in ("out", "both"):
        moved.append(edges.alias("e").join(frontier.alias("f"), F.col("f.id") == F.col("e.src")).select(F.col("e.dst").alias("id"), *keep))
    return moved[0] if len(moved) == 1 else moved[0].unionByName(moved[1])


def bfs(seeds: DataFrame, edges: DataFrame, depth: int | None, direction: str = "in", relations: Sequence[str] = RELATIONS, exclude_seeds: bool = True) -> DataFrame:
    """seeds (id, and any columns that tell traversals apart) -> those columns, id and depth of first
    reach. Each hop is one join against the edges and one anti-join against what was reached, which is one
    table, so neither plan nor files grow with the hops. With ``exclude_seeds`` the seeds are reached at
    depth 0 and left out; else a seed on a cycle appears when it is reached."""
    spark = seeds.sparkSession
    key = ["id", *[c for c in seeds.columns if c != "id"]]
    used = edges if set(relations) == set(RELATIONS) else related(edges, relations)
    used = used.select("src", "dst")
    levels = Levels(spark, ", ".join(f"`{c}` {t}" for c, t in seeds.select(*key).dtypes), "reached")
    levels.add(seeds.select(*key).distinct())
    hop = 0
    while levels.sizes[-1] and (depth is None or hop < depth):
        moved = step(levels.at(hop).select(*key), used, direction).distinct()
        if exclude_seeds or hop:
            moved = moved.join(levels.since(0 if exclude_seeds else 1).select(*key), key, "left_anti")
        levels.add(moved.select(*key))
        hop += 1
    return levels.since(1) if hop else seeds.select(*key).withColumn("depth", F.lit(0)).limit(0)


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Whatever leads to the seeds within depth hops, over all relations; the seeds left out."""
    return nodes.join(bfs(seeds, edges, depth), "id").select("name", "file", "line", "depth")


def callers(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Callers up to depth hops: name, file, line, depth, and confidence and source_line of the call that
    first reaches them; of several calls the surest, then the first line. A seed that calls itself, or is
    on a cycle, is among them."""
    found = bfs(seeds, edges, depth, relations=["calls"], exclude_seeds=False)
    ends = found.select(F.col("id").alias("dst"), (F.col("depth") + 1).alias("depth")).union(seeds.select("id", F.lit(1)))
    calls = related(edges, ["calls"]).select(F.col("src").alias("id"), "dst", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("source_line", F.lit(0)).alias("source_line"))
    by = calls.join(found, "id").join(ends.distinct(), ["dst", "depth"])
    first = by.groupBy("id", "depth").agg(F.min(F.struct((-F.col("confidence")).alias("doubt"), "source_line")).alias("c"))
    return nodes.join(first, "id").select("name", "file", "line", "depth", (-F.col("c.doubt")).alias("confidence"), "c.source_line")


PATH_RELATIONS = ("calls", "imports", "reads")


def shortest_path(nodes: DataFrame, edges: DataFrame, src: DataFrame, dst: DataFrame, most_hops: int | None = None) -> DataFrame:
    """step, name, file, line of a shortest path over calls, imports and reads in either direction; empty
    without one. Of several parents the one reached by the relation first in order, forward before
    backward, then of least id.

    The search goes on from the end whose last level is smaller until the levels meet. Ways lead both
    ways, so what a level leads to is new unless it is in that level or the one before: a hop joins the
    edges and two levels, whatever came before. The half searched from ``dst`` is then walked from the
    meeting on, for the parents; a row a step comes to the driver. ``src`` and ``dst`` have one id each."""
    spark = nodes.sparkSession
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(PATH_RELATIONS) for x in (F.lit(r), F.lit(2 * i))]), F.col("relation"))
    used = related(edges, PATH_RELATIONS)
    way = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), rank.alias("way")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), (rank + 1).alias("way"))))
    ways = used.select(way.alias("w")).select("w.*")

    def onward(level: DataFrame) -> DataFrame:
        return ways.join(level.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct("way", "a")).alias("parent"))

    def start(ends: DataFrame) -> Levels:
        out = Levels(spark, "id string, parent string", "path")
        out.add(nodes.select("id").join(ends.select("id").distinct(), "id", "left_semi").select("id", F.lit(None).cast("string").alias("parent")))
        return out

    none = nodes.limit(0).select(F.lit(0).alias("step"), "name", "file", "line")
    ahead, behind = start(src), start(dst)
    while True:
        i, j = len(ahead.sizes) - 1, len(behind.sizes) - 1
        if not ahead.sizes[i] or not behind.sizes[j]:
            return none
        met = ahead.at(i).join(behind.at(j).select("id"), "id", "left_semi").select("id", "parent")
        a, b = ahead.ids(i), behind.ids(j)
        if not met.isEmpty() if a is None or b is None else a & b:
            break
        if i + j == most_hops:
            return none
        side = ahead if ahead.sizes[i] <= behind.sizes[j] else behind
        top = len(side.sizes) - 1
        side.add(onward(side.at(top)).join(side.since(top - 1).select("id"), "id", "left_anti").select("id", "parent"))
    through = Levels(spark, "id string, parent string", "through")
    through.add(met)
    for k in range(j - 1, -1, -1):
        through.add(onward(through.at(j - 1 - k)).join(behind.at(k).select("id"), "id", "left_semi").select("id", "parent"))
    found = [dst.first()["id"]]
    for levels, top in ((through, j), (ahead, i)):
        for k in range(top, 0, -1):
            found.append(levels.row(k, found[-1])["parent"])
    # A row a step, so as many as there were hops.
    steps = F.broadcast(spark.createDataFrame(pa.table({"step": pa.array([i + j - k for k in range(len(found))], pa.int32()), "id": found})))
    return nodes.join(steps, "id").select("step", "name", "file", "line")


def path_length(nodes: DataFrame, edges: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """reachable, hops (null without a path)."""
    path = shortest_path(nodes, edges, src, dst)
    return path.agg((F.count("*") > 0).alias("reachable"), F.max("step").cast("long").alias("hops"))


def edges_for_files(nodes: DataFrame, edges: DataFrame, project: str, files: Sequence[str]) -> DataFrame:
    """Edges of a project with an end in one of the files, as file:name texts."""
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("project").alias(f"{side}_project"), F.col("file").alias(f"{side}_file"), F.concat_ws(":", "file", "name").alias(f"{side}_name"))
    both = edges.join(end("src").where(F.col("src_project") == project), "src").join(end("dst"), "dst")
    return both.where(F.col("src_file").isin(list(files)) | F.col("dst_file").isin(list(files))).select(F.col("src_name").alias("source"), F.col("dst_name").alias("target"), "relation", "confidence")


def callee_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callees): distinct names that a node calls, in order."""
    called = related(edges, ["calls"]).join(nodes.select(F.col("id").alias("dst"), "name"), "dst")
    return called.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("callees"))
