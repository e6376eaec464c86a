"""Lexical, vector and fused search over nodes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_test_file
from graphloom.operators.traverse import related
from graphloom.storage import Levels

#: Words left out of a search, and those left out of a question besides.
SEARCH_STOPS = ("the", "and", "for", "how", "does", "what", "show", "find", "all", "this", "with", "from")
QUESTION_STOPS = ("the", "and", "for", "how", "does", "what", "show", "find", "all", "this", "with", "from", "where", "which", "that", "are")


def search_terms(query: str) -> tuple[list[str], list[str]]:
    """(terms, stems) of a query: a stem is the first half of a term, four letters at least."""
    full: list[str] = []
    stems: list[str] = []
    for t in (w.lower() for w in query.split() if len(w) >= 2):
        if t in SEARCH_STOPS:
            continue
        if t not in full and t not in stems:
            full.append(t)
        stem = t[: max(4, len(t) // 2)]
        if len(stem) >= 3 and stem not in (t, *full, *stems):
            stems.append(stem)
    return full, stems


def question_terms(question: str) -> list[str]:
    return [t for t in (w.lower() for w in question.split() if len(w) > 2) if t not in QUESTION_STOPS]


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def halved_for_tests(score: Column) -> Column:
    return F.when(is_test_file(F.col("file")), score * 0.5).otherwise(score)


def search(nodes: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """Nodes by how terms meet name or file: name, file, line, type, score; ties by name, file. All
    candidates are ranked; none is cut off before."""
    full, stems = search_terms(query)
    name, file = F.lower("name"), F.lower("file")
    if not full + stems:
        return nodes.limit(0).select("name", "file", "line", "type", F.lit(0.0).alias("score"))
    parts = [F.when(name == t, 10.0).when(name.startswith(t) | name.endswith(t), 5.0).when(name.contains(t), 3.0).when(file.contains(t), 1.0).otherwise(0.0) for t in full]
    parts += [F.when(name.contains(t), 0.5).when(file.contains(t), 0.25).otherwise(0.0) for t in stems]
    met = reduce(lambda a, b: a | b, [name.contains(t) | file.contains(t) for t in (full + stems)[:8]])
    rows = nodes.where(met).dropDuplicates(["name", "file"]).withColumn("score", halved_for_tests(total(parts)))
    return rows.orderBy(F.desc("score"), "name", "file").limit(limit).select("name", "file", "line", "type", "score")


def lexical_seeds(nodes: DataFrame, terms: Sequence[str], limit: int = 10) -> DataFrame:
    """Nodes by the count of terms in name or file: id, name, file, score; ties by id."""
    has = lambda t: F.lower("name").contains(t) | F.lower("file").contains(t)
    met = reduce(lambda a, b: a | b, [has(t) for t in terms[:6]], F.lit(False))
    score = halved_for_tests(total([has(t).cast("double") for t in terms]))
    return nodes.where(met).withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit).select("id", "name", "file", "score")


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two arrays, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_vectors(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows (id, embedding) to the one query row (embedding): id, dist; exact, ties by id."""
    rows = vectors.crossJoin(F.broadcast(query.select(F.col("embedding").alias("asked")).limit(1)))
    return rows.select("id", F.round(cosine_distance(F.col("embedding"), F.col("asked")), 6).alias("dist")).orderBy("dist", "id").limit(k)


def process_seeds(processes: DataFrame, steps: DataFrame, terms: Sequence[str], limit: int = 10) -> DataFrame:
    """Nodes of processes (id, label) whose label holds a term, in order of process and step, each once:
    id, rank."""
    met = reduce(lambda a, b: a | b, [F.lower("label").contains(t) for t in terms[:6]], F.lit(False))
    few = processes.where(met).orderBy("label", "id").limit(limit)
    rows = few.join(steps.withColumnRenamed("process_id", "id"), "id").select("label", F.col("id").alias("pid"), "step_order", "node_id")
    first = rows.groupBy("node_id").agg(F.min(F.struct("label", "pid", "step_order")).alias("at"))
    return first.select(F.col("node_id").alias("id"), F.row_number().over(Window.orderBy("at")).alias("rank"))


def rank_fusion(lists: Sequence[DataFrame], files: DataFrame, k: int = 60, top_n: int = 5, per_file: int = 3) -> DataFrame:
    """Ranked lists (id, rank from 0) -> id, file, score: the sum of 1 / (k + rank), at most per_file of a
    file, the best top_n; ties by id."""
    rows = reduce(DataFrame.unionByName, [x.select("id", "rank") for x in lists])
    scored = rows.groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")).join(files.select("id", "file"), "id")
    best = Window.partitionBy("file").orderBy(F.desc("score"), "id")
    return scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= per_file).orderBy(F.desc("score"), "id").limit(top_n).select("id", "file", "score")


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """(id, rank from 0) of a short list."""
    return df.select("id", (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


#: How an edge is said from its source and from its target, in order.
SAID = (("calls", "calls", "called_by"), ("imports", "imports", "imported_by"), ("reads", "reads", "read_by"))
#: How many nodes of a hop a depth-first question goes on from.
NARROW = 3


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, mode: str = "bfs") -> tuple[DataFrame, DataFrame]:
    """Around the seeds over calls, imports and reads, both ways: found nodes (id, name, type, file, line,
    hop), and edges as they are met (hop, way, source, label, target). With mode "dfs" a hop goes on from
    NARROW nodes, the last by id."""
    relations = [r for r, _, _ in SAID]
    used = related(edges, relations).select("src", "dst", "relation")
    way = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(relations) for x in (r, 2 * i)]), F.col("relation"))
    both = F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), way.alias("way")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), (way + 1).alias("way"))))
    ways = used.select(both.alias("w")).select("w.*")
    seen = Levels(nodes.sparkSession, "id string", "near")
    seen.add(seeds.select("id").distinct())
    met = None
    for hop in range(depth):
        last = seen.at(hop).select("id")
        if mode == "dfs" and hop:
            last = last.orderBy(F.desc("id")).limit(NARROW)
        now = ways.join(last.select(F.col("id").alias("a")), "a").distinct().withColumn("hop", F.lit(hop))
        met = now if met is None else met.unionByName(now)
        if not seen.add(now.select(F.col("b").alias("id")).distinct().join(seen.since().select("id"), "id", "left_anti")):
            break
    found = nodes.join(seen.since().select("id", F.col("depth").alias("hop")), "id").select("id", "name", "type", "file", "line", "hop")
    if met is None:
        return found, nodes.limit(0).select(F.lit(0).alias("hop"), F.lit(0).alias("way"), F.col("name").alias("source"), F.lit("").alias("label"), F.col("name").alias("target"))
    label = F.element_at(F.array(*[F.lit(x) for _, out, back in SAID for x in (out, back)]), F.col("way") + 1)
    name = lambda c: found.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    said = met.join(name("a"), "a").join(name("b"), "b").select("hop", "way", F.col("a_name").alias("source"), label.alias("label"), F.col("b_name").alias("target"))
    return found, said


def within_budget(rows: DataFrame, text: Column, order: Sequence[Column | str], budget: int) -> DataFrame:
    """The first rows whose texts, each with a line end, come to at most ``budget`` characters. The running
    sum is over one ordered list, so this is for what is rendered, not for tables."""
    so_far = F.sum(F.length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("line", text).withColumn("so_far", so_far).where(F.col("so_far") <= budget).drop("so_far")


def answer(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 2, budget: int = 2000, question: str = "", mode: str = "bfs") -> DataFrame:
    """A question's answer as lines (place, line) in a budget of three characters a token: a head, the nodes
    from the seeds outwards, those of more edges first, then the edges from the seeds outwards, each once."""
    found, said = neighbourhood(nodes, edges, seeds, depth, mode)
    ends = said.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    of = F.concat(F.lit("  "), F.col("name"), F.lit(" ["), F.coalesce("type", F.lit("?")), F.lit("] "), F.col("file"), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"))
    listed = found.join(ends, "name", "left").select(F.lit(2).alias("part"), F.col("hop").alias("a"), (-F.coalesce("n", F.lit(0))).cast("int").alias("b"), of.alias("line"))
    arrow = F.concat(F.lit("  "), F.col("source"), F.lit(" --"), F.col("label"), F.lit("--> "), F.col("target"))
    met = said.select(arrow.alias("line"), "hop", "way").groupBy("line").agg(F.min(F.struct("hop", "way")).alias("at")).select(F.lit(4).alias("part"), F.col("at.hop").alias("a"), F.col("at.way").alias("b"), "line")
    head = found.agg(F.count("*").alias("n")).crossJoin(said.agg(F.count("*").alias("e"))).select(F.concat(F.lit(f"Mode: {mode.upper()} depth={depth} | "), F.col("n").cast("string"), F.lit(" nodes, "), F.col("e").cast("string"), F.lit(" edges")).alias("line"))
    fixed = lambda part, text: nodes.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(text).alias("line"))
    heads = fixed(0, f"Query: {question}").unionByName(head.select(F.lit(0).alias("part"), F.lit(0).alias("a"), F.lit(1).alias("b"), "line")).unionByName(fixed(1, "NODES:")).unionByName(fixed(3, "EDGES:"))
    order = ["part", "a", "b", "line"]
    # A budget holds no more lines than characters, so only so many go to the running sum.
    few = heads.unionByName(listed).unionByName(met).orderBy(*order).limit(3 * budget)
    so_far = F.sum(F.length("line") + 1).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = few.withColumns({"so_far": so_far, "place": F.row_number().over(Window.orderBy(*order)) - 1})
    return kept.where(F.col("so_far") <= 3 * budget).select("place", "line")
