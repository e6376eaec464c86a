"""Writes to the graph as functions from DataFrames to DataFrames: upsert, relate, delete, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schemas import NODES, RELATIONS, node_key


def upsert_nodes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new (project, file, name, type, line, ord) over those of the same key; of several the last."""
    old = existing.select(node_key().alias("id"), "project", "file", "name", "type", "line", F.lit(-1).cast("long").alias("ord"))
    rows = old.unionByName(new.select(node_key().alias("id"), "project", "file", "name", "type", "line", F.col("ord").cast("long").alias("ord")))
    last = F.max_by(F.struct("project", "file", "name", "type", "line"), F.struct("ord", "type", "line"))
    return rows.groupBy("id").agg(last.alias("n")).select("id", "n.*")


def relate(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, relation, confidence, source_line, ord) made unique: the greatest confidence, of
    equals the earliest. Raises ValueError for a relation there isn't."""
    known = F.col("relation").isin(list(RELATIONS))
    checked = edges.withColumn("relation", F.when(known, F.col("relation")).otherwise(F.raise_error(F.concat(F.lit("unknown relation "), F.coalesce("relation", F.lit("null"))))))
    best = F.max_by(F.struct("confidence", "source_line"), F.struct("confidence", -F.col("ord")))
    return checked.groupBy("src", "dst", "relation").agg(best.alias("b")).select("src", "dst", "relation", "b.*")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each source, target and relation, by ord."""
    first = F.min_by(F.struct("confidence", "source_line"), F.col("ord"))
    return edges.groupBy("src", "dst", "relation").agg(first.alias("b")).select("src", "dst", "relation", "b.*")


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of files (project, file) and every edge that touches one."""
    gone = nodes.join(files.select("project", "file").distinct(), ["project", "file"], "left_semi").select("id")
    left = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return left, kept.select(*edges.columns)


def dedup_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges nodes (with ord) that share project, file and name: the key's own id stays, the last line
    that isn't zero is kept, a class or field gives the type if the key's own row is missing. Edges move
    to the kept ids; where one is there already it stays. Returns nodes, edges and the counts
    (groups_merged, edges_migrated)."""
    key = node_key()
    keyed = nodes.withColumn("key", key)
    own = F.col("id") == F.col("key")
    special = F.col("type").isin("class", "field")
    merged = keyed.groupBy("project", "file", "name", "key").agg(
        F.count("*").alias("n"), F.max(own).alias("has_own"), F.max_by(F.when(F.col("line") != 0, F.col("line")), F.when(F.col("line") != 0, F.col("ord"))).alias("line"),
        F.max(F.when(own, F.col("type"))).alias("own_type"), F.min_by(F.when(special, F.col("type")), F.when(special, F.col("ord"))).alias("special"), F.min_by("type", "ord").alias("first_type"),
    )
    kept = merged.select(F.col("key").alias("id"), "project", "file", "name", F.coalesce("own_type", "special", "first_type").alias("type"), F.coalesce("line", F.lit(0)).alias("line"))
    to = keyed.where(~own).select(F.col("id").alias("old"), F.col("key").alias("new"))
    moved = edges.join(to.select(F.col("old").alias("src"), F.col("new").alias("new_src")), "src", "left").join(to.select(F.col("old").alias("dst"), F.col("new").alias("new_dst")), "dst", "left")
    shift = F.coalesce("new_src", "new_dst").isNotNull()
    moved = moved.select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "relation", "confidence", "source_line", shift.alias("moved"), "ord")
    first = F.min_by(F.struct("confidence", "source_line"), F.struct("moved", "ord"))
    unique = moved.groupBy("src", "dst", "relation").agg(first.alias("b")).select("src", "dst", "relation", "b.*")
    counts = merged.agg(F.sum((F.col("n") > 1).cast("long")).alias("groups_merged")).crossJoin(moved.agg(F.sum(F.col("moved").cast("long")).alias("edges_migrated")))
    return kept, unique, counts


def resolve_edges(nodes: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw edges (project, file, source, target, relation, confidence, source_line, ord) -> nodes with the
    stubs they need, and edges between ids.

    A source is a symbol of its file or else the file itself. A target with a colon is (file, name), cut
    at the first one, and gets a function stub where it isn't defined; another is a symbol of the same
    file, or a file of that name, made if need be. Relations there aren't are dropped."""
    kept = raw.where(F.col("relation").isin(list(RELATIONS)))
    known = nodes.select("project", "file", "name").distinct()
    named = kept.join(known.select("project", "file", F.col("name").alias("source"), F.lit(True).alias("has_source")), ["project", "file", "source"], "left")
    named = named.join(known.select("project", "file", F.col("name").alias("target"), F.lit(True).alias("has_target")), ["project", "file", "target"], "left")
    colon = F.instr("target", ":")
    part = F.when(colon > 0, F.struct(F.expr("substring(target, 1, instr(target, ':') - 1)").alias("file"), F.expr("substring(target, instr(target, ':') + 1)").alias("name"), F.lit("function").alias("type")))
    part = part.when(F.col("has_target"), F.struct(F.col("file"), F.col("target").alias("name"), F.lit("function").alias("type"))).otherwise(F.struct(F.col("target").alias("file"), F.col("target").alias("name"), F.lit("file").alias("type")))
    source = F.when(F.col("has_source"), F.col("source")).otherwise(F.col("file"))
    ends = named.select("project", "file", source.alias("source"), part.alias("t"), F.col("has_source"), "relation", "confidence", "source_line", "ord")
    made = ends.select("project", "t.file", "t.name", "t.type").unionByName(ends.where("has_source is null").select("project", "file", F.col("file").alias("name"), F.lit("file").alias("type")))
    stubs = made.join(known, ["project", "file", "name"], "left_anti").groupBy("project", "file", "name").agg(F.max("type").alias("type"))
    stubs = stubs.select(node_key().alias("id"), "project", "file", "name", "type", F.lit(0).alias("line"))
    columns = [c.split()[0] for c in NODES.split(", ")]
    out = relate(ends.select(node_key("project", "file", "source").alias("src"), node_key("project", F.col("t.file"), F.col("t.name")).alias("dst"), "relation", "confidence", "source_line", "ord"))
    return nodes.select(*columns).unionByName(stubs.select(*columns)), out


def merge_incremental(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, keep_inbound: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replaces what changed files (project, file) hold by new rows. Of rows of one key a definition beats a
    stub (a function at line 0), then the new one; edges are made unique as by ``relate``. Edges from other
    files into changed ones go with them, unless ``keep_inbound`` and their target is there again."""
    left, kept = delete_files(nodes, edges, changed)
    rows = left.withColumn("_new", F.lit(0)).unionByName(new_nodes.select(*left.columns).withColumn("_new", F.lit(1)))
    stub = (F.col("type") == "function") & (F.coalesce("line", F.lit(0)) == 0)
    best = F.max_by(F.struct(*[c for c in left.columns if c != "id"]), F.struct((~stub).alias("defined"), "_new"))
    out_nodes = rows.groupBy("id").agg(best.alias("n")).select("id", "n.*").select(*left.columns)
    out_edges = kept.unionByName(new_edges.select(*kept.columns)).withColumn("ord", F.lit(0))
    if keep_inbound:
        gone = nodes.join(changed.select("project", "file").distinct(), ["project", "file"], "left_semi").select("id")
        inbound = edges.join(gone.select(F.col("id").alias("dst")), "dst", "left_semi").join(gone.select(F.col("id").alias("src")), "src", "left_anti")
        inbound = inbound.join(new_nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        out_edges = out_edges.unionByName(inbound.select(*kept.columns).withColumn("ord", F.lit(1)))
    return out_nodes, relate(out_edges).select("src", "dst", "relation", "confidence", "source_line")


def store_clusters(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes with the cluster_id of members (id, cluster_id); those that members don't name keep theirs."""
    old = F.col("cluster_id") if "cluster_id" in nodes.columns else F.lit(None).cast("int")
    to = members.select("id", F.col("cluster_id").alias("_to"))
    return nodes.join(to, "id", "left").withColumn("cluster_id", F.coalesce("_to", old)).drop("_to").select(*[c for c in nodes.columns if c != "cluster_id"], "cluster_id")


def store_processes(processes: DataFrame, steps: DataFrame, new: DataFrame, new_steps: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """A project's processes and their steps replaced by new ones, one a key."""
    rest = processes.where(F.col("project") != project)
    kept = steps.join(rest.select(F.col("id").alias("process_id")), "process_id", "left_semi")
    once = new_steps.dropDuplicates(["process_id", "step_order", "node_id"])
    return rest.unionByName(new.dropDuplicates(["id"])), kept.unionByName(once.select(*kept.columns))


def first_per(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def store_ai_edges(edges: DataFrame, suggested: DataFrame, project: str, pass_number: int, force_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Adds suggested edges (source, target, relation, confidence, line, ord) that aren't there: names are
    file:symbol, cut at the last colon. Returns the new edges with their pass, and (stored, skipped, errors):
    skipped are there already or come twice, errors have no such relation or an end without a name, which
    error_details lists by reason."""
    cut = lambda c: F.struct(F.when(F.instr(c, ":") > 0, F.regexp_extract(c, "(?s)^(.*):[^:]*$", 1)).otherwise(F.col(c)).alias("file"), F.regexp_extract(c, "(?s)([^:]*)$", 1).alias("name"))
    valid = F.col("relation").isin(list(RELATIONS)) & (F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")
    ends = suggested.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumns({"s": cut("source"), "t": cut("target")})
    confidence = F.lit(force_confidence) if force_confidence is not None else F.coalesce("confidence", F.lit(0.8))
    keyed = ends.select("valid", node_key(F.lit(project), F.col("s.file"), F.col("s.name")).alias("src"), node_key(F.lit(project), F.col("t.file"), F.col("t.name")).alias("dst"), "relation", confidence.cast("double").alias("confidence"), F.coalesce("line", F.lit(0)).alias("source_line"), "ord")
    unique = keyed.where("valid").groupBy("src", "dst", "relation").agg(F.min_by(F.struct("confidence", "source_line"), "ord").alias("b")).select("src", "dst", "relation", "b.*")
    new = unique.join(edges.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti").withColumn("pass", F.lit(pass_number))
    reason = F.when(~F.coalesce(F.col("relation").isin(list(RELATIONS)), F.lit(False)), F.concat(F.lit("unknown relation "), F.coalesce("relation", F.lit("null")))).otherwise("source or target missing")
    wrong = ends.where(~F.col("valid")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    wrong = wrong.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("errors"), F.sort_array(F.collect_list(F.concat("reason", F.lit(": "), F.col("n").cast("string")))).alias("error_details"))
    counts = suggested.agg(F.count("*").alias("n")).crossJoin(new.agg(F.count("*").alias("stored"))).crossJoin(wrong).select("stored", (F.col("n") - F.col("stored") - F.col("errors")).alias("skipped"), "errors", "error_details")
    return new.select("src", "dst", "relation", "confidence", "source_line", "pass"), counts
