"""A code graph derived from the part and lineitem tables: parts are symbols, consecutive lines of an
order are edges. Written once a session and input, as a build would store it, and read by the queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schemas import node_key
from graphloom.storage import materialize, modified, plan_unpacked


@dataclass(frozen=True)
class Graph:
    spark: SparkSession
    sf_dir: str
    nodes: DataFrame
    edges: DataFrame

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


#: By session, path and the times at which the tables were last changed.
_KEPT: dict[tuple, Graph] = {}


def derive_nodes(part: DataFrame) -> DataFrame:
    key, name = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_"))
    place = F.when(F.col("p_size") % 10 == 0, "tests/").otherwise("src/")
    rows = part.select(
        F.concat(F.lit("proj"), (key % 5).cast("string")).alias("project"),
        F.concat(place, F.lower("p_type"), F.lit("/"), name, F.lit(".py")).alias("file"),
        F.concat(name, F.lit("_"), key.cast("string")).alias("name"),
        F.when(key % 10 == 0, "class").when(key % 10 == 1, "field").otherwise("function").alias("type"),
        F.col("p_size").alias("line"), key.alias("k"),
    )
    return rows.select(node_key().alias("id"), "*")


def derive_edges(lineitem: DataFrame) -> DataFrame:
    """(s, d, relation, confidence, source_line) by part keys."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    rel = F.when(flag == "R", "calls").when((flag == "A") & (status == "O"), "imports").when(flag == "A", "reads").when(status == "O", "writes").otherwise("implements")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    ahead = Window.partitionBy("l_orderkey", "relation").orderBy(*order)
    rows = lineitem.withColumn("relation", rel).select("relation", F.col("l_partkey").alias("s"), F.lead("l_partkey").over(ahead).alias("d"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.col("l_linenumber").alias("source_line"))
    rows = rows.where("d is not null and s % 5 = d % 5")
    best = F.max_by(F.struct("confidence", "source_line"), F.struct("confidence", -F.col("source_line")))
    return rows.groupBy("s", "d", "relation").agg(best.alias("b")).select("s", "d", "relation", "b.*")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    plan_unpacked(spark)
    at = spark.sparkContext.applicationId, sf_dir, *(modified(spark, f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    if at not in _KEPT:
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        nodes = materialize(derive_nodes(read("part")), "nodes")
        ids = nodes.select("k", "id")
        edges = derive_edges(read("lineitem")).join(ids.select(F.col("k").alias("s"), F.col("id").alias("src")), "s").join(ids.select(F.col("k").alias("d"), F.col("id").alias("dst")), "d")
        edges = materialize(edges.select("src", "dst", "relation", "confidence", "source_line", "s", "d"), "edges", by=["relation"])
        _KEPT[at] = Graph(spark, sf_dir, nodes, edges)
    return _KEPT[at]


#: The same graph in SQL: n (nodes) and e (edges), as the head of a WITH clause.
SQL = """
n as (
  select substr(sha256(concat(project, ':', file, ':', name)), 1, 16) as id, * from (
    select concat('proj', cast(p_partkey % 5 as varchar)) as project,
      concat(case when p_size % 10 = 0 then 'tests/' else 'src/' end, lower(p_type), '/', replace(p_name, ' ', '_'), '.py') as file,
      concat(replace(p_name, ' ', '_'), '_', cast(p_partkey as varchar)) as name,
      case p_partkey % 10 when 0 then 'class' when 1 then 'field' else 'function' end as type,
      p_size as line, p_partkey as k from part)),
e0 as (select *, case when l_returnflag = 'R' then 'calls' when l_returnflag = 'A' and l_linestatus = 'O' then 'imports'
  when l_returnflag = 'A' then 'reads' when l_linestatus = 'O' then 'writes' else 'implements' end as relation from lineitem),
e1 as (select relation, l_partkey as s, round(1 - l_discount, 2) as confidence, l_linenumber as source_line,
  lead(l_partkey) over (partition by l_orderkey, relation order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) as d from e0),
e2 as (select *, row_number() over (partition by s, d, relation order by confidence desc, source_line) as rn from e1 where d is not null and s % 5 = d % 5),
e as (select a.id as src, b.id as dst, e2.relation, e2.confidence, e2.source_line, e2.s, e2.d
  from e2 join n a on a.k = e2.s join n b on b.k = e2.d where rn = 1)
"""
