"""Communities of the undirected simple graph, their labels and key lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import split_camel
from graphloom.operators.ranks import numbered
from graphloom.storage import materialize, release

#: A graph of so many links, counted, is settled by the driver, one node after another: about 50 MB.
FEW_LINKS = 500_000

#: Folders and name parts that say nothing about a cluster.
STOP_DIRS = ("src", "lib", "app", "components", "pages", "utils", "shared", "common", "index")
STOP_NAMES = ("get", "set", "use", "the", "new", "init", "handle", "default", "create")


def simple_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: relations merged, no self loops, both ends among the nodes."""
    ids = nodes.select("id")
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return rows.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def communities(nodes: DataFrame, edges: DataFrame, levels: int = 4, rounds: int = 12, resolution: float = 1.0) -> DataFrame:
    """(id, cluster_id) by modularity: nodes move between communities until none gains, then communities
    become nodes of a smaller weighted graph, and so on for some levels. The numbers go by size, ties by
    least id; isolated nodes are communities of their own."""
    pairs = simple_edges(nodes, edges).select(F.col("a").alias("id"), F.col("b").alias("other"))
    links = materialize(pairs.union(pairs.select("other", "id")).withColumn("w", F.lit(1).cast("long")), "links")
    m2 = max(1, links.count())
    degree = materialize(links.groupBy("id").agg(F.sum("w").alias("k")), "degree")
    label, left = nodes.select("id", F.col("id").alias("c")), degree.count()
    for _ in range(levels):
        way = settled_here if links.count() <= FEW_LINKS else settled
        state = materialize(way(links, degree, m2, rounds, resolution), "settled")
        label = materialize(label.join(state.select(F.col("id").alias("c"), F.col("c").alias("to")), "c", "left").select("id", F.coalesce("to", "c").alias("c")), "label")
        degree = materialize(degree.join(state, "id").groupBy(F.col("c").alias("id")).agg(F.sum("k").alias("k")), "degree")
        before, left = left, degree.count()
        if left == before:
            break
        ends = links.join(state, "id").select("other", F.col("c").alias("a"), "w").join(state.select(F.col("id").alias("other"), F.col("c").alias("b")), "other")
        links = materialize(ends.where("a <> b").groupBy(F.col("a").alias("id"), F.col("b").alias("other")).agg(F.sum("w").alias("w")), "links")
    sizes = label.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    places = numbered(sizes, [F.desc("n"), F.col("least")], "cluster_id").select("c", F.col("cluster_id").cast("int").alias("cluster_id"))
    return label.join(places, "c").select("id", "cluster_id")


def settled_here(links: DataFrame, degree: DataFrame, m2: int, rounds: int, resolution: float) -> DataFrame:
    """(id, c) as ``settled`` gives it, for at most FEW_LINKS links, which come to the driver: nodes move
    one after another, in order of id."""
    rows, k = links.select("id", "other", "w").toArrow(), degree.select("id", "k").orderBy("id").toArrow()
    ids = k.column("id").to_pylist()
    at = {x: i for i, x in enumerate(ids)}
    near: list[list[tuple[int, int]]] = [[] for _ in ids]
    for a, b, w in zip(*(rows.column(c).to_pylist() for c in ("id", "other", "w"))):
        near[at[a]].append((at[b], w))
    own, weight = list(range(len(ids))), k.column("k").to_pylist()
    total = list(weight)
    for _ in range(rounds):
        moved = 0
        for i, around in enumerate(near):
            pull: dict[int, int] = {own[i]: 0}
            for j, w in around:
                pull[own[j]] = pull.get(own[j], 0) + w
            total[own[i]] -= weight[i]
            gain = {c: w - resolution * weight[i] * total[c] / m2 for c, w in pull.items()}
            best = min(gain, key=lambda c: (-gain[c], c))
            if gain[best] > gain[own[i]] + 1e-9:
                own[i], moved = best, moved + 1
            total[own[i]] += weight[i]
        if not moved:
            break
    return links.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.string()), "c": pa.array([ids[c] for c in own], pa.string())}))


def settled(links: DataFrame, degree: DataFrame, m2: int, rounds: int, resolution: float) -> DataFrame:
    """(id, c) by local moving, set at a time: every node weighs the communities of its neighbours by
    links less what chance gives. In a round communities are on one of two sides, by hash; nodes of the
    one side may move to the best community of the other, where none moves away meanwhile. The next round
    turns the sides round, the one after deals them anew."""
    state = degree.select("id", F.col("id").alias("c"), "k")
    before = None
    for r in range(rounds):
        side = lambda c: F.pmod(F.xxhash64(c, F.lit(r // 2)) + r % 2, F.lit(2))
        total = state.groupBy("c").agg(F.sum("k").alias("total"))
        near = links.join(state.select(F.col("id").alias("other"), "c"), "other").groupBy("id", "c").agg(F.sum("w").alias("w"))
        gain = near.join(total, "c").join(state.select("id", F.col("c").alias("own"), "k"), "id")
        at_home = F.col("c") == F.col("own")
        gain = gain.withColumn("gain", F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(at_home, F.col("k")).otherwise(0)) / m2)
        open_ = ~at_home & (side("own") == 0) & (side("c") == 1)
        best = gain.groupBy("id").agg(
            F.min_by(F.struct("c", "gain"), F.when(open_, F.struct(-F.col("gain"), F.col("c")))).alias("b"),
            F.max(F.when(at_home, F.col("gain"))).alias("now"), F.max(F.when(~at_home, F.col("gain"))).alias("any"),
        )
        least = F.coalesce("now", F.lit(0.0)) + 1e-9
        best = best.select("id", F.when(F.col("b.gain") > least, F.col("b.c")).alias("to"), (F.col("any") > least).alias("wants"))
        after = state.join(best, "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k", F.coalesce("wants", F.lit(False)).alias("wants"))
        after = materialize(after, "state")
        release(before)
        before, state = after, after.drop("wants")
        if after.where("wants").isEmpty():
            break
    return state.select("id", "c")


def cluster_labels(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, label): the most common folder, else the most common part of a name, ties to the least;
    else ``unknown``."""
    rows = members.join(nodes, "id").select("cluster_id", "file", "name")
    folders = F.split(F.translate("file", "\\", "/"), "/")
    dirs = rows.select("cluster_id", F.explode(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))).alias("part"))
    dirs = dirs.select("cluster_id", F.lower(F.trim("part")).alias("part")).where((F.length("part") >= 2) & ~F.col("part").isin(list(STOP_DIRS)))
    parts = rows.select("cluster_id", F.explode(split_camel(F.lower("name"))).alias("part")).where((F.length("part") >= 3) & ~F.col("part").isin(list(STOP_NAMES)))
    both = dirs.withColumn("kind", F.lit(0)).unionByName(parts.withColumn("kind", F.lit(1)))
    counted = both.groupBy("cluster_id", "kind", "part").count()
    top = counted.groupBy("cluster_id").agg(F.min_by("part", F.struct("kind", -F.col("count"), "part")).alias("label"))
    return members.select("cluster_id").distinct().join(top, "cluster_id", "left").select("cluster_id", F.coalesce("label", F.lit("unknown")).alias("label"))


def cluster_summaries(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, label (unique), node_count, key_files, key_functions: at most five of each, in order."""
    labels = cluster_labels(nodes, members)
    again = F.row_number().over(Window.partitionBy("label").orderBy("cluster_id")) > 1
    labels = labels.select("cluster_id", F.when(again, F.concat_ws("-", "label", F.col("cluster_id").cast("string"))).otherwise(F.col("label")).alias("label"))
    rows = members.join(nodes, "id")
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("file"))
    files = rows.select("cluster_id", "file").distinct().withColumn("nth", nth).where("nth <= 5").groupBy("cluster_id").agg(F.array_sort(F.collect_list("file")).alias("key_files"))
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("name", "id"))
    functions = rows.where(F.col("type").isin("function", "class")).withColumn("nth", nth).where("nth <= 5").groupBy("cluster_id").agg(F.array_sort(F.collect_list("name")).alias("key_functions"))
    counts = rows.groupBy("cluster_id").agg(F.count("*").alias("node_count"))
    return labels.join(counts, "cluster_id").join(files, "cluster_id", "left").join(functions, "cluster_id", "left")


def cluster_members(nodes: DataFrame, members: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """Nodes of clusters whose label holds a text, whatever its case."""
    hit = labels.where(F.lower("label").contains(text.lower()))
    return members.join(hit, "cluster_id").join(nodes, "id").select("name", "file", "line", "label")
