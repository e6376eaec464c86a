"""Execution flows: entry points, traces from them, and processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_test_file, process_label
from graphloom.operators.store import first_per
from graphloom.operators.traverse import degrees, related
from graphloom.schemas import key_of
from graphloom.storage import materialize


def entry_points(nodes: DataFrame, edges: DataFrame, limit: int | None = 100) -> DataFrame:
    """Symbols outside tests that call two or more times and more often than they are called:
    id, name, file, out_calls, in_calls, score; by score, ties by id."""
    calls = related(edges, ["calls"])
    out_ = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_calls"))
    in_ = calls.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_calls"))
    rows = nodes.where((F.col("type") != "file") & ~is_test_file(F.col("file"))).join(out_.where("out_calls >= 2"), "id").join(in_, "id", "left")
    rows = rows.withColumn("in_calls", F.coalesce("in_calls", F.lit(0).cast("long"))).withColumn("score", F.col("out_calls") / (F.col("in_calls") + 1)).where("score > 1.0")
    rows = rows.select("id", "name", "file", "out_calls", "in_calls", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id")
    return rows.limit(limit) if limit else rows


def traces(edges: DataFrame, entries: DataFrame, max_depth: int = 10, branching: int = 3) -> DataFrame:
    """Call paths from entries (id): array path. At each step the ``branching`` callees off the path with
    most calls in and out go on; a path ends where none is left, or at max_depth nodes; those of three
    nodes or more count."""
    calls = related(edges, ["calls"]).select("src", "dst").distinct()
    weight = degrees(related(edges, ["calls"]))
    hops = materialize(calls.join(weight.select(F.col("id").alias("dst"), "degree"), "dst").select("src", "dst", "degree"), "hops")
    open_ = entries.select(F.array("id").alias("path")).distinct()
    done = None
    for length in range(1, max_depth):
        last = F.element_at("path", -1)
        on = open_.join(hops, last == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        on = first_per(on, ["path"], [F.desc("degree"), F.col("dst")], branching).select("path", F.concat("path", F.array("dst")).alias("longer"))
        on = materialize(on, "traces")
        if length >= 3:
            ended = open_.join(on.select("path"), "path", "left_anti")
            done = ended if done is None else done.unionByName(ended)
        open_ = on.select(F.col("longer").alias("path"))
    full = open_.where(F.size("path") >= 3)
    return full if done is None else done.unionByName(full)


def dedup_traces(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Of traces (path) between the same names the longest, then without those whose steps a longer one
    holds: trace_id, path, entry, terminal."""
    names = nodes.select("id", "name")
    ends = found.select("path", F.col("path")[0].alias("first"), F.element_at("path", -1).alias("last"), F.concat_ws(">", "path").alias("trace_id"))
    ends = ends.join(names.select(F.col("id").alias("first"), F.col("name").alias("entry")), "first").join(names.select(F.col("id").alias("last"), F.col("name").alias("terminal")), "last")
    longest = ends.groupBy("entry", "terminal").agg(F.min_by(F.struct("path", "trace_id"), F.struct(-F.size("path"), F.col("trace_id"))).alias("t")).select("entry", "terminal", "t.*")
    longest = materialize(longest, "longest")
    # A trace that lies in another has its rarest step there too.
    steps = longest.select("trace_id", "path", F.explode("path").alias("step"))
    seen = steps.groupBy("step").agg(F.count("*").alias("traces"))
    rare = steps.join(seen, "step").groupBy("trace_id", "path").agg(F.min_by("step", F.struct("traces", "step")).alias("step"))
    other = steps.select(F.col("path").alias("longer"), "step")
    inside = rare.join(other, "step").where((F.size("path") < F.size("longer")) & (F.size(F.array_except("path", "longer")) == 0))
    return longest.join(inside.select("trace_id").distinct(), "trace_id", "left_anti")


def processes(nodes: DataFrame, kept: DataFrame, project: str, most: int, clusters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Deduplicated traces -> (processes, process_steps); the longest ``most``, ties by trace."""
    few = kept.orderBy(F.desc(F.size("path")), "trace_id").limit(most)
    label = process_label(F.col("entry"), F.col("terminal"))
    rows = few.select(key_of(F.lit(project), F.col("path")[0], label).alias("id"), label.alias("label"), "path")
    steps = rows.select(F.col("id").alias("process_id"), F.posexplode("path").alias("step_order", "node_id"))
    communities = clusters if clusters is not None else nodes.select(F.col("id").alias("node_id"), F.lit(None).cast("int").alias("cluster_id"))
    cross = steps.join(communities, "node_id", "left").groupBy("process_id").agg((F.countDistinct("cluster_id") > 1).alias("cross_community"))
    out = rows.join(cross.withColumnRenamed("process_id", "id"), "id").select("id", F.lit(project).alias("project"), "label", F.when(F.col("cross_community"), "cross_community").otherwise("intra_community").alias("process_type"), F.size("path").alias("step_count"), "cross_community", F.col("path")[0].alias("entry_id"), F.element_at("path", -1).alias("terminal_id"))
    return out, steps


def process_cap(n_nodes: int) -> int:
    return max(20, n_nodes // 10)


def longest_first(df: DataFrame, n: int) -> DataFrame:
    w = Window.orderBy(F.desc("step_count"), "label")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
