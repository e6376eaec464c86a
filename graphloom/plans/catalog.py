"""The registered queries over the derived graph, each beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import clusters, contracts, flows, hooks, reports, search, store, tool_tables, traverse
from graphloom.plans.derived import SQL, Graph, graph
from graphloom.schemas import node_key
from graphloom.storage import materialize
from graphloom.streaming.incremental import first_of_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *, recursive: bool = False, over_graph: bool = True):
    """Registers a function of a Graph under its name. The SQL goes on from the graph's n and e; a query not
    over the graph, but over tables alone, doesn't have it built."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(graph(spark, sf_dir) if over_graph else Graph(spark, sf_dir, None, None))
        if sql is not None:
            lead = ("with recursive " if recursive else "with ") + SQL.strip()
            body = sql.strip()
            ORACLE[f.__name__] = (lead + (",\n" + body[1:] if body[0] == "," else "\n" + body)) if over_graph else body
        return f

    return add


# Seeds that follow the data: the most called node, and the one that calls most.
SEED = "seed as (select k, id from (select n.k, n.id, count(*) as c from e join n on n.id = e.dst where relation = 'calls' group by all) order by c desc, k limit 1)"
CALLER = "far as (select k, id from (select n.k, n.id, count(*) as c from e join n on n.id = e.src where relation = 'calls' and project = (select project from n where id = (select id from seed)) group by all) order by c desc, k limit 1)"


def _most(g: Graph, nodes: DataFrame, end: str) -> DataFrame:
    calls = g.edges.where("relation = 'calls'").groupBy(F.col(end).alias("id")).agg(F.count("*").alias("c"))
    return nodes.join(calls, "id").orderBy(F.desc("c"), "k").limit(1).select("id", "k")


def seed(g: Graph) -> DataFrame:
    return _most(g, g.nodes, "dst")


def far(g: Graph) -> DataFrame:
    home = seed(g).join(g.nodes, "id").select("project")
    return _most(g, g.nodes.join(F.broadcast(home), "project", "left_semi"), "src")


# ---- expansion and traversal


@query("select name, file, degree from n join (select id, count(*) as degree from (select src as id from e union all select dst from e) group by id) using (id) order by degree desc, id limit 10")
def hubs(g: Graph) -> DataFrame:
    return traverse.hubs(g.nodes, g.edges)


@query(f", {SEED} select name, file, line, confidence, source_line from e join n on n.id = e.src where relation = 'calls' and e.dst = (select id from seed)")
def callers_d1(g: Graph) -> DataFrame:
    return traverse.incoming(g.nodes, g.edges, seed(g), "calls")


@query(f", {SEED}, r(x, dep) as (select id, 0 from seed union select e.src, dep + 1 from r join e on e.dst = r.x and e.relation = 'calls' where dep < 3), "
    "m as (select x, min(dep) as dep from r where dep > 0 group by x), t as (select x, dep + 1 as dep from m union select id, 1 from seed), "
    "c as (select m.x, m.dep, confidence, source_line, row_number() over (partition by m.x order by confidence desc, source_line) as rn from m join e on e.src = m.x and e.relation = 'calls' join t on t.x = e.dst and t.dep = m.dep) "
    "select name, file, line, cast(dep as int) as depth, confidence, source_line from c join n on n.id = c.x where rn = 1", recursive=True)
def callers_d3(g: Graph) -> DataFrame:
    return traverse.callers(g.nodes, g.edges, seed(g), 3)


@query("select t.name as field, n.name, n.file, n.line, e.confidence, e.source_line from e join n on n.id = e.src join n t on t.id = e.dst where relation = 'reads' and t.type = 'field'")
def readers(g: Graph) -> DataFrame:
    fields = g.nodes.where("type = 'field'").select(F.col("id").alias("dst"), F.col("name").alias("field"))
    hit = g.edges.where("relation = 'reads'").join(fields, "dst")
    return hit.join(g.nodes.select(F.col("id").alias("src"), "name", "file", "line"), "src").select("field", "name", "file", "line", "confidence", "source_line")


def _radius(depth: int) -> str:
    return f", {SEED}, r(x, dep) as (select id, 0 from seed union select e.src, dep + 1 from r join e on e.dst = r.x where dep < {depth}) select name, file, line, cast(min(dep) as int) as depth from r join n on n.id = r.x group by all having min(dep) > 0"


@query(_radius(1), recursive=True)
def blast_radius_d1(g: Graph) -> DataFrame:
    return traverse.blast_radius(g.nodes, g.edges, seed(g), 1)


@query(_radius(3), recursive=True)
def blast_radius_d3(g: Graph) -> DataFrame:
    return traverse.blast_radius(g.nodes, g.edges, seed(g), 3)


PATH = f", {SEED}, {CALLER}, w as (select src as a, dst as b from e where relation in ('calls', 'imports', 'reads') union select dst, src from e where relation in ('calls', 'imports', 'reads')), r(x, dep) as (select id, 0 from far union select w.b, dep + 1 from r join w on w.a = r.x where dep < 24)"


@query(PATH + " select count(*) > 0 as reachable, cast(min(dep) as bigint) as hops from r where x = (select id from seed)", recursive=True)
def path_length(g: Graph) -> DataFrame:
    return traverse.path_length(g.nodes, g.edges, far(g), seed(g))


@query(PATH + ", dd as (select x, min(dep) as dep from r group by x), wy as (select src as a, dst as b, case relation when 'calls' then 0 when 'imports' then 2 else 4 end as way from e where relation in ('calls', 'imports', 'reads') union select dst, src, case relation when 'calls' then 1 when 'imports' then 3 else 5 end from e where relation in ('calls', 'imports', 'reads')), pa as (select b as x, arg_min(a, struct_pack(way := way, a := a)) as parent from wy join dd p on p.x = a join dd c on c.x = b and c.dep = p.dep + 1 group by b), bk(x, dep) as (select x, dep from dd where x = (select id from seed) union all select parent, dep - 1 from bk join pa using (x) where dep > 0) select cast(dep as int) as step, name, file, line from bk join n on n.id = bk.x", recursive=True)
def path_nodes(g: Graph) -> DataFrame:
    return traverse.shortest_path(g.nodes, g.edges, far(g), seed(g))


@query("select concat(a.file, ':', a.name) as source, concat(b.file, ':', b.name) as target, relation, confidence from e join n a on a.id = e.src join n b on b.id = e.dst where a.project = 'proj1' and (a.file in (select file from n where k in (1, 11, 21)) or b.file in (select file from n where k in (1, 11, 21)))")
def edges_for_files(g: Graph) -> DataFrame:
    files = [r["file"] for r in g.nodes.where("k in (1, 11, 21)").select("file").distinct().collect()]
    return traverse.edges_for_files(g.nodes, g.edges, "proj1", files)


@query("select a.name, string_agg(distinct b.name, ',' order by b.name) as callees from e join n a on a.id = e.src join n b on b.id = e.dst where relation = 'calls' group by a.id, a.name")
def callee_names(g: Graph) -> DataFrame:
    called = traverse.callee_names(g.nodes, g.edges)
    return called.join(g.nodes.select("id", "name"), "id").select("name", F.concat_ws(",", "callees").alias("callees"))


# ---- counts and reports


@query("select relation, count(*) as n from e group by relation")
def graph_summary_counts(g: Graph) -> DataFrame:
    return reports.relation_counts(g.edges)


@query("select name, file from n where project = 'proj1' and id not in (select src from e union select dst from e)")
def isolated_nodes(g: Graph) -> DataFrame:
    return reports.isolated(g.nodes, g.edges, "proj1")


@query("select split_part(file, '/', 1) as folder, count(distinct file) as files, count(*) as nodes from n group by 1")
def directory_map(g: Graph) -> DataFrame:
    return reports.directory_map(g.nodes)


@query("select n.project, count(*) as nodes, count(distinct file) as files, any_value(coalesce(c, 0)) as edges from n left join (select project, count(*) as c from e join n on n.id = e.src group by 1) x using (project) group by 1")
def report_stats(g: Graph) -> DataFrame:
    return reports.report_stats(g.nodes, g.edges)


# Nodes and edges with the files too: an import also leads to the file of what is imported.
FILED = "nf as (select id, project, file, name, type, line from n union all select substr(sha256(concat(project, ':', file, ':', file)), 1, 16), project, file, file, 'file', 0 from (select distinct project, file from n)), ef as (select src, dst, relation from e union all select distinct src, substr(sha256(concat(project, ':', file, ':', file)), 1, 16), relation from e join n on n.id = e.dst where relation = 'imports')"


def _filed(g: Graph) -> tuple[DataFrame, DataFrame]:
    of_file = node_key("project", "file", "file")
    files = g.nodes.select("project", "file").distinct().select(of_file.alias("id"), "project", "file", F.col("file").alias("name"), F.lit("file").alias("type"), F.lit(0).alias("line"))
    edges = g.edges.select("src", "dst", "relation")
    more = edges.where("relation = 'imports'").join(g.nodes.select(F.col("id").alias("dst"), of_file.alias("of")), "dst").select("src", F.col("of").alias("dst"), "relation").distinct()
    return _plain(g.nodes).unionByName(files), edges.unionByName(more)


CHANGED = "ch as (select file, row_number() over (order by file) as ord from (select distinct file from n where project = 'proj0' and k % 97 = 5)), cf as (select * from ch order by ord limit 20), sy as (select id, name, file, line from (select n.*, row_number() over (partition by file order by line, name, id) as rn from n where project = 'proj0' and file in (select file from cf)) where rn <= 10)"


def _changed(g: Graph) -> tuple[DataFrame, DataFrame]:
    files = g.nodes.where("project = 'proj0' and k % 97 = 5").select("file").distinct().withColumn("ord", F.row_number().over(Window.orderBy("file")))
    return files, reports.changed_symbols(g.nodes, files, "proj0")


@query(f", {CHANGED} select name, file, line from sy")
def detect_changes_symbols(g: Graph) -> DataFrame:
    return _changed(g)[1].select("name", "file", "line")


AFFECTED = f", {CHANGED}, {FILED}, r(x, dep) as (select id, 0 from sy union select substr(sha256(concat('proj0:', file, ':', file)), 1, 16), 0 from sy union select ef.src, dep + 1 from r join ef on ef.dst = r.x where dep < 2), af as (select x, min(dep) as dep from r group by x having min(dep) > 0)"


@query(AFFECTED + " select name, file, cast(min(dep) as int) as depth from af join nf on nf.id = af.x group by all", recursive=True)
def detect_changes_affected(g: Graph) -> DataFrame:
    return reports.affected(*_filed(g), _changed(g)[1], "proj0").select("name", "file", "depth")


@query(AFFECTED + ", hb as (select name, file from nf join (select id, count(*) as degree from (select src as id from ef union all select dst from ef) group by id) using (id) where project = 'proj0' order by degree desc, id limit 10), c as (select (select count(*) from ch) as f, (select count(*) from sy) as s, (select count(*) from (select distinct name, file from af join nf on nf.id = af.x)) as a, (select count(*) from (select distinct name, file from af join nf on nf.id = af.x) q semi join hb using (name, file)) as h) select case when f = 0 then 'NONE' when s = 0 then 'LOW' when a > 50 or h > 0 then 'CRITICAL' when a > 20 then 'HIGH' when a > 5 then 'MEDIUM' else 'LOW' end as risk, a as total_affected, h as hubs_affected from c", recursive=True)
def detect_changes_risk(g: Graph) -> DataFrame:
    files, symbols = _changed(g)
    nodes, edges = _filed(g)
    return reports.change_risk(files, symbols, reports.affected(nodes, edges, symbols, "proj0"), traverse.hubs(nodes.where("project = 'proj0'"), edges))


@query(", f as (select file from n where project = 'proj2' order by id limit 1), s as (select id, name, type, line from n where project = 'proj2' and file = (select file from f) order by line, name limit 15) select s.name, s.type, s.line, coalesce((select string_agg(name, ',' order by name) from (select distinct a.name from e join n a on a.id = e.src where e.dst = s.id and relation = 'calls' order by 1 limit 4)), '') as callers from s")
def file_outline(g: Graph) -> DataFrame:
    file = g.nodes.where("project = 'proj2'").orderBy("id").limit(1).collect()
    return reports.file_outline(g.nodes, g.edges, "proj2", file[0]["file"] if file else "")


# ---- flows


ENTRY = "ep as (select n.id, name, file, o.c as out_calls, coalesce(i.c, 0) as in_calls, o.c / (coalesce(i.c, 0) + 1) as sc from n join (select src, count(*) as c from e where relation = 'calls' group by src having count(*) >= 2) o on o.src = n.id left join (select dst, count(*) as c from e where relation = 'calls' group by dst) i on i.dst = n.id where not contains(file, 'tests/'))"


@query(f", {ENTRY} select name, file, out_calls, in_calls, round(sc, 6) as score from ep where sc > 1 order by sc desc, id limit 100")
def entry_points(g: Graph) -> DataFrame:
    return flows.entry_points(g.nodes, g.edges).drop("id")


#: Nodes of a path at most.
DEPTH = 10


def _longer(n: int) -> str:
    return f"t{n + 1} as (select list_append(p, dst) as p from (select p, dst, row_number() over (partition by p order by degree desc, dst) as rn from t{n} join hp on hp.src = p[-1] where not list_contains(p, dst)) where rn <= 3)"


def _ended(n: int) -> str:
    return f"select p from t{n} where not exists (select 1 from t{n + 1} where t{n + 1}.p[1:{n}] = t{n}.p)"


TRACES = f""", {ENTRY}, en as (select id from ep where sc > 1 order by sc desc, id limit 100),
 dg as (select id, count(*) as degree from (select src as id from e where relation = 'calls' union all select dst from e where relation = 'calls') group by id),
 hp as (select distinct src, dst, degree from e join dg on dg.id = e.dst where relation = 'calls'),
 t1 as (select [id] as p from en), {', '.join(_longer(n) for n in range(1, DEPTH))},
 tr as ({' union all '.join(_ended(n) for n in range(3, DEPTH))} union all select p from t{DEPTH})"""


def _traces(g: Graph) -> DataFrame:
    return flows.traces(g.edges, flows.entry_points(g.nodes, g.edges).select("id"), max_depth=DEPTH)


@query(TRACES + " select a.name as entry, b.name as terminal, cast(len(p) as int) as step_count, array_to_string(p, '>') as path from tr join n a on a.id = p[1] join n b on b.id = p[-1]")
def traces(g: Graph) -> DataFrame:
    name = lambda c: g.nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    rows = _traces(g).select(F.col("path")[0].alias("a"), F.element_at("path", -1).alias("b"), F.size("path").alias("step_count"), F.concat_ws(">", "path").alias("path"))
    return rows.join(name("a"), "a").join(name("b"), "b").select(F.col("a_name").alias("entry"), F.col("b_name").alias("terminal"), "step_count", "path")


KEPT = TRACES + """, tn as (select p, a.name as entry, b.name as terminal, array_to_string(p, '>') as tid from tr join n a on a.id = p[1] join n b on b.id = p[-1]),
 lg as (select * from (select *, row_number() over (partition by entry, terminal order by len(p) desc, tid) as rn from tn) where rn = 1),
 kp as (select * from lg where not exists (select 1 from lg o where len(o.p) > len(lg.p) and list_has_all(o.p, lg.p)))"""


@query(KEPT + " select entry, terminal, cast(len(p) as int) as step_count, tid as path from kp")
def traces_dedup(g: Graph) -> DataFrame:
    return flows.dedup_traces(g.nodes, _traces(g)).select("entry", "terminal", F.size("path").alias("step_count"), F.col("trace_id").alias("path"))


def _processes(g: Graph) -> tuple[DataFrame, DataFrame]:
    spans = g.nodes.select(F.col("id").alias("node_id"), F.substring("project", 5, 9).cast("int").alias("cluster_id"), "line")
    spans = spans.select("node_id", (F.col("cluster_id") * 100 + F.col("line") % 3).alias("cluster_id"))
    return flows.processes(g.nodes, flows.dedup_traces(g.nodes, _traces(g)), "all", flows.process_cap(g.nodes.count()), spans)


PROCESSES = KEPT + ", pr as (select concat(entry, ' → ', terminal) as label, p, tid from kp order by len(p) desc, tid limit (select greatest(20, count(*) // 10) from n)), st as (select label, tid, len(p) as step_count, unnest(p) as id from pr), cc as (select tid, label, step_count, count(distinct concat(project, line % 3)) > 1 as cross_community from st join n using (id) group by all)"


@query(PROCESSES + " select label, cast(step_count as int) as step_count from cc")
def process_labels(g: Graph) -> DataFrame:
    return _processes(g)[0].select("label", "step_count")


@query(PROCESSES + " select label, cross_community from cc")
def cross_community(g: Graph) -> DataFrame:
    return _processes(g)[0].select("label", "cross_community")


@query(PROCESSES + ", few as (select id from n where k % 7 = 3 order by id limit 50) select label, cast(step_count as int) as step_count from st where id in (select id from few) group by tid, label, step_count")
def flows_affected(g: Graph) -> DataFrame:
    found, steps = _processes(g)
    return reports.flows_affected(found, steps, g.nodes.where("k % 7 = 3").select("id"))


@query(PROCESSES + ", pf as (select label, key, p from (select substr(sha256(concat('all:', p[1], ':', label)), 1, 16) as key, label, p from pr) where contains(lower(label), 'red') or contains(lower(label), 'blue') order by label, key limit 10), ps as (select label, key, unnest(range(len(p))) as pos, unnest(p) as id from pf) select id, cast(row_number() over (order by label, key, pos) as int) as rank from (select * from ps qualify row_number() over (partition by id order by label, key, pos) = 1)")
def process_seeds(g: Graph) -> DataFrame:
    found, steps = _processes(g)
    return search.process_seeds(found, steps, ["red", "blue"])


@query(PROCESSES + " select label, cast(step_count as int) as step_count from cc where contains(lower(label), 'a') order by step_count desc, label limit 20")
def processes_search(g: Graph) -> DataFrame:
    rows = _processes(g)[0].where(F.lower("label").contains("a"))
    return rows.orderBy(F.desc("step_count"), "label").limit(20).select("label", "step_count")


# ---- search


SCORE = "case when lower(name) = '{t}' then 10.0 when starts_with(lower(name), '{t}') or ends_with(lower(name), '{t}') then 5.0 when contains(lower(name), '{t}') then 3.0 when contains(lower(file), '{t}') then 1.0 else 0.0 end"
STEM = "case when contains(lower(name), '{t}') then 0.5 when contains(lower(file), '{t}') then 0.25 else 0.0 end"
ASKED = "find the small widget economy"
_FULL, _STEMS = search.search_terms(ASKED)
_TESTED = "case when contains(lower(file), 'tests/') then 0.5 else 1.0 end"


@query(f"select name, file, line, type, cast(({' + '.join([SCORE.format(t=t) for t in _FULL] + [STEM.format(t=t) for t in _STEMS])}) * {_TESTED} as double) as score from n where {' or '.join(f'''contains(lower(name), '{t}') or contains(lower(file), '{t}')''' for t in (_FULL + _STEMS)[:8])} order by score desc, name, file limit 15")
def search_fuzzy(g: Graph) -> DataFrame:
    return search.search(g.nodes, ASKED)


_TERMS = ["gear", "medium"]
LEXICAL = f"select id, name, file, cast(({' + '.join(f'''(contains(lower(name), '{t}') or contains(lower(file), '{t}'))::int''' for t in _TERMS)}) * {_TESTED} as double) as score from n where {' or '.join(f'''contains(lower(name), '{t}') or contains(lower(file), '{t}')''' for t in _TERMS)} order by score desc, id limit 10"


@query(LEXICAL)
def lexical_seeds(g: Graph) -> DataFrame:
    return search.lexical_seeds(g.nodes, _TERMS)


NEAREST = "select vec_id as id, round(1 - list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings order by vec_id limit 1)), 6) as dist from embeddings order by dist, id limit 10"


@query(NEAREST, over_graph=False)
def vector_seeds(g: Graph) -> DataFrame:
    v = g.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.nearest_vectors(v, v.orderBy("id").limit(1))


FUSED = f", lx as (select id, row_number() over (order by score desc, id) - 1 as rank from ({LEXICAL})), dg as (select id, row_number() over (order by count(*) desc, id) - 1 as rank from (select src as id from e union all select dst from e) group by id order by rank limit 10), sc as (select id, round(sum(1.0 / (60 + rank)::double), 9) as score from (select * from lx union all select * from dg) group by id), pf as (select id, file, score, row_number() over (partition by file order by score desc, id) as rn from sc join n using (id)) select id, file, score from pf where rn <= 3 order by score desc, id limit 5"


@query(FUSED)
def rrf_fuse(g: Graph) -> DataFrame:
    lexical = search.ranked(search.lexical_seeds(g.nodes, _TERMS), F.desc("score"), "id")
    degree = traverse.degrees(g.edges).orderBy(F.desc("degree"), "id").limit(10)
    return search.rank_fusion([lexical, search.ranked(degree, F.desc("degree"), "id")], g.nodes)


@query()
def code_query(g: Graph) -> DataFrame:
    return search.answer(g.nodes, g.edges, search.lexical_seeds(g.nodes, search.question_terms("where does the small gear come from"), 5))


@query("select file, contains(lower(file), 'tests/') or contains(lower(file), 'test/') or contains(lower(file), 'spec/') or contains(lower(file), 'specs/') or contains(lower(file), 'test_') or contains(lower(file), '.test.') or contains(lower(file), '.spec.') or contains(lower(file), '_test.') or contains(lower(file), '_spec.') as is_test from (select distinct file from n)")
def is_test_file(g: Graph) -> DataFrame:
    return g.nodes.select("file").distinct().select("file", fn.is_test_file(F.col("file")).alias("is_test"))


# ---- writes


@query("select k, substr(sha256(concat(project, ':', file, ':', name)), 1, 16) as id from n")
def node_keys(g: Graph) -> DataFrame:
    return g.nodes.select("k", node_key().alias("id"))


def _plain(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "project", "file", "name", "type", "line")


@query("select id, project, file, name, case when k % 3 = 0 then 'class' else type end as type, case when k % 3 = 0 then line + 100 else line end as line from n")
def upsert_nodes(g: Graph) -> DataFrame:
    new = g.nodes.where("k % 3 = 0").select("project", "file", "name", F.lit("class").alias("type"), F.explode(F.array(F.col("line") + 50, F.col("line") + 100)).alias("line"))
    return store.upsert_nodes(_plain(g.nodes), new.withColumn("ord", F.col("line").cast("long")))


@query("select src, dst, relation, max(confidence) as confidence, arg_max(source_line, struct_pack(a := confidence, b := -source_line)) as source_line from (select src, dst, 'calls' as relation, confidence, source_line from e) group by all")
def relate_max_conf(g: Graph) -> DataFrame:
    return store.relate(g.edges.withColumns({"relation": F.lit("calls"), "ord": F.col("source_line").cast("long")}))


@query("select src, dst, relation, confidence, source_line from (select src, dst, 'reads' as relation, confidence, source_line, row_number() over (partition by src, dst order by source_line, confidence) as rn from e) where rn = 1")
def dedup_edges(g: Graph) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("src", "dst").orderBy("source_line", "confidence"))
    return store.dedup_edges(g.edges.withColumns({"relation": F.lit("reads"), "ord": order.cast("long")}))


@query(", x as (select case when k % 4 = 0 then concat('dup', k) else id end as id, project, file, name, type, case when k % 4 = 1 then 0 else line end as line, k as ord from n union all select concat('alt', k), project, file, name, type, line + 7, k + 1000000 from n where k % 4 = 1) select substr(sha256(concat(project, ':', file, ':', name)), 1, 16) as id, project, file, name, any_value(type) as type, cast(coalesce(arg_max(line, ord) filter (line <> 0), 0) as int) as line from x group by project, file, name")
def dedup_nodes(g: Graph) -> DataFrame:
    k = F.col("k")
    rows = g.nodes.select(F.when(k % 4 == 0, F.concat(F.lit("dup"), k.cast("string"))).otherwise(F.col("id")).alias("id"), "project", "file", "name", "type", F.when(k % 4 == 1, 0).otherwise(F.col("line")).alias("line"), k.alias("ord"))
    more = g.nodes.where("k % 4 = 1").select(F.concat(F.lit("alt"), k.cast("string")).alias("id"), "project", "file", "name", "type", (F.col("line") + 7).alias("line"), (k + 1000000).alias("ord"))
    edges = g.edges.select("src", "dst", "relation", "confidence", "source_line", F.col("source_line").cast("long").alias("ord"))
    return store.dedup_nodes(rows.unionByName(more), edges)[0]


@query(", gone as (select id from n where k % 5 = 2 and line < 10), kept as (select src, dst, relation from e where src not in (select id from n where (project, file) in (select project, file from n where id in (select id from gone))) and dst not in (select id from n where (project, file) in (select project, file from n where id in (select id from gone)))) select relation, count(*) as edges from kept group by relation")
def delete_file(g: Graph) -> DataFrame:
    files = g.nodes.where("k % 5 = 2 and line < 10").select("project", "file")
    return store.delete_files(g.nodes, g.edges, files)[1].groupBy("relation").agg(F.count("*").alias("edges"))


@query(", f as (select distinct project, file from n where k % 50 = 7), fn as (select n.* from n semi join f using (project, file)), o as (select src, dst, relation from e where src not in (select id from fn) and dst not in (select id from fn)), nw as (select src, dst, relation from e where src in (select id from fn)) select 'nodes' as kind, count(*) as n from n union all select 'edges', (select count(*) from o) + (select count(*) from nw)")
def incremental_merge(g: Graph) -> DataFrame:
    changed = g.nodes.where("k % 50 = 7").select("project", "file").distinct()
    again = g.nodes.join(changed, ["project", "file"], "left_semi")
    edges = g.edges.select("src", "dst", "relation", "confidence", "source_line")
    new_edges = edges.join(again.select(F.col("id").alias("src")), "src", "left_semi")
    nodes, merged = store.merge_incremental(_plain(g.nodes), edges, changed, _plain(again), new_edges)
    return nodes.agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).unionByName(merged.agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))


@query(", raw as (select a.project, a.file, case when a.k % 3 = 0 then 'nowhere' else a.name end as source, case when b.k % 4 = 0 then concat(b.file, ':', b.name) when b.k % 4 = 1 then concat('ext/', b.k % 9, ':x:y') when b.k % 4 = 2 then 'print' else a.name end as target, relation, confidence, source_line from e join n a on a.id = e.src join n b on b.id = e.dst), ends as (select project, file as sf, case when source = 'nowhere' then file else source end as sn, case when contains(target, ':') then split_part(target, ':', 1) when target = 'print' then 'print' else file end as tf, case when contains(target, ':') then substr(target, strpos(target, ':') + 1) else target end as tn, relation, confidence, source_line from raw) select substr(sha256(concat(project, ':', sf, ':', sn)), 1, 16) as src, substr(sha256(concat(project, ':', tf, ':', tn)), 1, 16) as dst, relation, max(confidence) as confidence from ends group by all")
def resolve_edges(g: Graph) -> DataFrame:
    a = g.nodes.select(F.col("id").alias("src"), "project", "file", F.col("name").alias("a_name"), F.col("k").alias("ak"))
    b = g.nodes.select(F.col("id").alias("dst"), F.col("file").alias("b_file"), F.col("name").alias("b_name"), F.col("k").alias("bk"))
    raw = g.edges.join(a, "src").join(b, "dst")
    bk = F.col("bk")
    target = F.when(bk % 4 == 0, F.concat_ws(":", "b_file", "b_name")).when(bk % 4 == 1, F.concat(F.lit("ext/"), (bk % 9).cast("string"), F.lit(":x:y"))).when(bk % 4 == 2, "print").otherwise(F.col("a_name"))
    raw = raw.select("project", "file", F.when(F.col("ak") % 3 == 0, "nowhere").otherwise(F.col("a_name")).alias("source"), target.alias("target"), "relation", "confidence", "source_line", F.col("source_line").cast("long").alias("ord"))
    return store.resolve_edges(_plain(g.nodes), raw)[1].select("src", "dst", "relation", "confidence")


# ---- communities


@query("select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst")
def undirected_simple_edges(g: Graph) -> DataFrame:
    return clusters.simple_edges(g.nodes, g.edges)


@query()
def communities(g: Graph) -> DataFrame:
    return clusters.communities(g.nodes, g.edges).groupBy("cluster_id").agg(F.count("*").alias("node_count"))


def _groups(g: Graph) -> DataFrame:
    return g.nodes.select("id", (F.col("k") % 25).cast("int").alias("cluster_id"))


LABELS = ", m as (select id, cast(k % 25 as int) as cluster_id, file, name from n), dr as (select cluster_id, lower(trim(unnest(list_slice(string_split(file, '/'), 1, -2)))) as part from m), pt as (select cluster_id, unnest(list_filter(regexp_split_to_array(lower(name), '[_.-]+'), lambda x: x <> '')) as part from m), al as (select cluster_id, 0 as kind, part from dr where length(part) >= 2 and part not in ('src','lib','app','components','pages','utils','shared','common','index') union all select cluster_id, 1, part from pt where length(part) >= 3 and part not in ('get','set','use','the','new','init','handle','default','create')), ct as (select cluster_id, kind, part, count(*) as c from al group by all), lb as (select cluster_id, part as label from (select *, row_number() over (partition by cluster_id order by kind, c desc, part) as rn from ct) where rn = 1)"


@query(LABELS + " select cluster_id, label from lb")
def cluster_label(g: Graph) -> DataFrame:
    return clusters.cluster_labels(g.nodes, _groups(g))


@query(LABELS + " select name, file, line, label from lb join (select cast(k % 25 as int) as cluster_id, * from n) using (cluster_id) where contains(lower(label), 'o')")
def cluster_members(g: Graph) -> DataFrame:
    return clusters.cluster_members(g.nodes, _groups(g), clusters.cluster_labels(g.nodes, _groups(g)), "O")


@query(LABELS + ", lab as (select cluster_id, label from lb), un as (select cluster_id, case when row_number() over (partition by label order by cluster_id) > 1 then label || '-' || cluster_id else label end as label from lab), r as (select cast(k % 25 as int) as cluster_id, * from n), kf as (select cluster_id, string_agg(file, ',' order by file) as key_files from (select cluster_id, file, row_number() over (partition by cluster_id order by file) as rn from (select distinct cluster_id, file from r)) where rn <= 5 group by 1) select cluster_id, label, count(*) as node_count, any_value(key_files) as key_files from un join r using (cluster_id) join kf using (cluster_id) group by cluster_id, label")
def cluster_summaries(g: Graph) -> DataFrame:
    out = clusters.cluster_summaries(g.nodes, _groups(g))
    return out.select("cluster_id", "label", "node_count", F.concat_ws(",", "key_files").alias("key_files"))


# ---- contracts


CONTRACTS = "c as (select 'c' || c_custkey as id, 'p' || c_nationkey % 7 as project, 'consumer' as role, case c_custkey % 3 when 0 then 'lib' when 1 then 'http' else 'onchain' end as contract_type, case c_custkey % 3 when 0 then 'lib::@pkg/' || c_custkey % 40 when 1 then 'http::any::/api/' || c_custkey % 30 else 'onchain::get' || list_extract(['Token','Vault','Bridge','Pool'], cast(c_custkey % 4 + 1 as int)) || 'Client' end as contract_id, 0.5 + (c_custkey % 5) / 10.0 as confidence from customer union all select 's' || s_suppkey, 'p' || s_nationkey % 7, 'provider', case s_suppkey % 3 when 0 then 'lib' when 1 then 'http' else 'onchain' end, case s_suppkey % 3 when 0 then case when s_suppkey % 2 = 0 then 'lib::@pkg/*' else 'lib::@pkg/' || s_suppkey % 40 end when 1 then 'http::any::/api/' || s_suppkey % 30 else 'onchain::TRS' || list_extract(['Token','Vault','Bridge','Pool'], cast(s_suppkey % 4 + 1 as int)) end, 0.6 + (s_suppkey % 4) / 10.0 from supplier)"


def made_contracts(g: Graph) -> DataFrame:
    things = F.array(*[F.lit(x) for x in ("Token", "Vault", "Bridge", "Pool")])
    ck, sk = F.col("c_custkey"), F.col("s_suppkey")
    kind = lambda k: F.when(k % 3 == 0, "lib").when(k % 3 == 1, "http").otherwise("onchain")
    text = lambda k, m: (k % m).cast("string")
    thing = lambda k: F.get(things, (k % 4).cast("int"))
    c_id = F.when(ck % 3 == 0, F.concat(F.lit("lib::@pkg/"), text(ck, 40))).when(ck % 3 == 1, F.concat(F.lit("http::any::/api/"), text(ck, 30))).otherwise(F.concat(F.lit("onchain::get"), thing(ck), F.lit("Client")))
    p_lib = F.when(sk % 2 == 0, "lib::@pkg/*").otherwise(F.concat(F.lit("lib::@pkg/"), text(sk, 40)))
    p_id = F.when(sk % 3 == 0, p_lib).when(sk % 3 == 1, F.concat(F.lit("http::any::/api/"), text(sk, 30))).otherwise(F.concat(F.lit("onchain::TRS"), thing(sk)))
    row = lambda key, letter, nation, role, cid, conf: [F.concat(F.lit(letter), key.cast("string")).alias("id"), F.concat(F.lit("p"), (F.col(nation) % 7).cast("string")).alias("project"), F.lit(role).alias("role"), kind(key).alias("contract_type"), cid.alias("contract_id"), conf.alias("confidence")]
    consumers = g.table("customer").select(*row(ck, "c", "c_nationkey", "consumer", c_id, 0.5 + (ck % 5) / 10.0))
    providers = g.table("supplier").select(*row(sk, "s", "s_nationkey", "provider", p_id, 0.6 + (sk % 4) / 10.0))
    return materialize(consumers.unionByName(providers), "contracts")


EXACT = f"with {CONTRACTS}, ex as (select a.id as consumer_id, b.id as provider_id, least(a.confidence, b.confidence)::double as confidence, b.contract_id from c a join c b on a.role = 'consumer' and b.role = 'provider' and a.contract_id = b.contract_id and a.project <> b.project)"


def _short(links: DataFrame) -> DataFrame:
    return links.select("consumer_id", "provider_id", F.round("confidence", 6).alias("confidence"))


@query(EXACT + " select consumer_id, provider_id, round(confidence, 6) as confidence from ex", over_graph=False)
def contract_match_exact(g: Graph) -> DataFrame:
    return _short(contracts.match_exact(made_contracts(g)))


@query(EXACT + " select a.id as consumer_id, b.id as provider_id, round(least(a.confidence, b.confidence)::double * 0.8, 6) as confidence from c a join c b on a.role = 'consumer' and b.role = 'provider' and a.project <> b.project and a.contract_id <> b.contract_id and split_part(a.contract_id, '::', 1) = split_part(b.contract_id, '::', 1) and (a.contract_id glob b.contract_id) where (a.id, b.id) not in (select consumer_id, provider_id from ex)", over_graph=False)
def contract_match_wildcard(g: Graph) -> DataFrame:
    return contracts.match_wildcard(made_contracts(g)).select("consumer_id", "provider_id", "confidence")


@query(EXACT + " , t as (select *, case when role = 'consumer' then ['get', lower(regexp_extract(contract_id, 'get(.*)Client', 1)), 'client'] else ['trs', lower(regexp_extract(contract_id, 'TRS(.*)', 1))] end as w from c where contract_type = 'onchain'), j as (select a.id as consumer_id, b.id as provider_id, least(a.confidence, b.confidence)::double as cf, len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) as sc from t a join t b on a.role = 'consumer' and b.role = 'provider' and a.project <> b.project) select consumer_id, provider_id, round(cf * sc, 6) as confidence from j where sc >= 0.3", over_graph=False)
def contract_match_fuzzy(g: Graph) -> DataFrame:
    return contracts.match_fuzzy(made_contracts(g)).select("consumer_id", "provider_id", "confidence")


@query(f"with {CONTRACTS}, x as (select *, cast(substr(id, 2) as bigint) as ord from c) select project, contract_type, contract_id, role, arg_max(id, ord) as symbol_name, round(arg_max(confidence, ord)::double, 6) as confidence from x group by project, contract_type, contract_id, role", over_graph=False)
def contract_store_collapse(g: Graph) -> DataFrame:
    rows = made_contracts(g).withColumns({"ord": F.expr("cast(substring(id, 2) as bigint)"), "symbol_name": F.col("id"), "symbol_file": F.lit("f"), "symbol_node": F.lit(None).cast("string")}).drop("id")
    return contracts.stored(rows).select("project", "contract_type", "contract_id", "role", "symbol_name", F.round("confidence", 6).alias("confidence"))


@query(f"with {CONTRACTS} select id, project, contract_id from c where contract_type = 'http' and role = 'provider' order by id limit 50", over_graph=False)
def contracts_filter(g: Graph) -> DataFrame:
    return contracts.filtered(made_contracts(g), "http", "provider").select("id", "project", "contract_id")


@query(f"with {CONTRACTS} select contract_type, role, count(*) as n from c group by all", over_graph=False)
def contracts_summary(g: Graph) -> DataFrame:
    return contracts.summary(made_contracts(g))


@query(EXACT + ", li as (select row_number() over () as l, * from ex), en as (select distinct l, c.project from (select l, consumer_id as id from li union all select l, provider_id from li) join c using (id)) select 'team' as name, 'p' || i as project, (select count(*) from c where project = 'p' || i) as contracts, (select count(*) from en where project = 'p' || i) as links from range(3) t(i)", over_graph=False)
def group_status(g: Graph) -> DataFrame:
    groups = g.spark.sql("select 'team' as name, transform(sequence(0, 2), i -> named_struct('project', concat('p', i), 'path', '')) as members")
    rows = made_contracts(g)
    return contracts.group_status(groups, rows, materialize(contracts.match_exact(rows), "links"))


@query(r"select page_id, concat('http::get::', case when p = '' then '/' else p end) as contract_id from (select page_id, rtrim(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/[0-9]+', '/[id]', 'g'), '\[[^\]]+\]|:[^/]+|\{[^}]+\}', '{param}', 'g')), '/') as p from pages)", over_graph=False)
def contract_normalize(g: Graph) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1), "/[0-9]+", "/[id]")
    return g.table("pages").select("page_id", contracts.normalized(F.concat(F.lit("http::GET::"), path), "http").alias("contract_id"))


@query("select project, id as symbol_node, 'http::any::' || lower(rtrim(x.file, '/')) as contract_id from (select project, id, replace(replace(file, 'src/', 'routes/'), '.py', '.ts') as file, 'get' || name as name from n) x where starts_with(x.file, 'routes/')")
def contract_patterns(g: Graph) -> DataFrame:
    moved = g.nodes.withColumns({"file": F.replace(F.replace("file", F.lit("src/"), F.lit("routes/")), F.lit(".py"), F.lit(".ts")), "name": F.concat(F.lit("get"), "name")})
    callees = g.nodes.select("id", F.array(F.lit("router.get")).alias("callees"))
    return contracts.structural(moved, callees).where("pattern = 'express_router'").select("project", "symbol_node", "contract_id")


# ---- impact over contracts


def _linked(g: Graph) -> tuple[DataFrame, DataFrame]:
    rows = g.nodes.select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("id"), "project", F.concat(F.lit("lib::x"), F.floor(F.col("k") / 20).cast("string")).alias("contract_id"), F.lit("lib").alias("contract_type"), F.when(F.col("k") % 2 == 0, "provider").otherwise("consumer").alias("role"), F.col("name").alias("symbol_name"), F.col("file").alias("symbol_file"), F.col("id").alias("symbol_node"), F.lit(1.0).alias("confidence"))
    rows = materialize(rows, "contracts")
    return rows, materialize(contracts.match_exact(rows), "links")


IMPACT = f", {SEED}, c as (select 'k' || k as id, project, 'lib::x' || k // 20 as contract_id, case when k % 2 = 0 then 'provider' else 'consumer' end as role, name as symbol_name, file as symbol_file, id as node from n), li as (select a.id as consumer_id, b.id as provider_id from c a join c b on a.role = 'consumer' and b.role = 'provider' and a.contract_id = b.contract_id and a.project <> b.project), home as (select project from n where id = (select id from seed)), r(x, dep) as (select id, 0 from seed union select e.src, dep + 1 from r join e on e.dst = r.x where dep < 2), lo as (select x, min(dep) as dep from r group by x), tc as (select c.id from c where project = (select project from home) and (symbol_file in (select file from lo join n on n.id = lo.x) or symbol_name in (select name from lo join n on n.id = lo.x))), og as (select tc.id as start, provider_id as id from li join tc on tc.id = li.consumer_id), ic as (select tc.id as start, consumer_id as id from li join tc on tc.id = li.provider_id where tc.id not in (select start from og)), tg as (select distinct c.project, c.contract_id from c where id in (select id from og union select id from ic) and project <> (select project from home)), fs as (select distinct node as id from c semi join tg using (project, contract_id)), q(x, dep) as (select id, 0 from fs union select e.src, dep + 1 from q join e on e.dst = q.x where dep < 2), fr as (select x, min(dep) as dep from q group by x having min(dep) > 0)"


@query(IMPACT + " select project, name, file, cast(min(dep) as int) as depth from (select * from lo where dep > 0 union all select * from fr) y join n on n.id = y.x group by all", recursive=True)
def group_impact(g: Graph) -> DataFrame:
    rows, links = _linked(g)
    start = seed(g)
    home = start.join(g.nodes, "id").select("project").first()["project"]
    return reports.group_impact(g.nodes, g.edges, rows, links, start, home, [f"proj{i}" for i in range(5)])


# ---- tables of other tools


@query(", s as (select file, name, line as st, line + k % 9 as en, k as ord from n), p as (select distinct n.file, e.source_line * 7 as line from e join n on n.id = e.src) select p.file, p.line, arg_min(s.name, struct_pack(a := en - st, b := s.ord)) as name from p left join s on s.file = p.file and st <= p.line and p.line <= en group by all")
def innermost_scope(g: Graph) -> DataFrame:
    scopes = g.nodes.select("file", "name", F.col("line").alias("start"), (F.col("line") + F.col("k") % 9).alias("end"), F.col("k").alias("ord"))
    points = g.edges.join(g.nodes.select(F.col("id").alias("src"), "file"), "src").select("file", (F.col("source_line") * 7).alias("line"))
    return tool_tables.innermost_scope(scopes, points)


@query(", s as (select file, name, line as st, k as ord, case cast(k % 4 as int) when 0 then 5 when 1 then 12 when 2 then 13 else 6 end as kind from n), p as (select distinct n.file, e.source_line * 7 as line from e join n on n.id = e.src), j as (select p.file, p.line, s.name, kind, row_number() over (partition by p.file, p.line order by abs(st - p.line), case when st = p.line then -ord else ord end) as rn from p join s on s.file = p.file and abs(st - p.line) <= 3) select file, line, name, case kind when 5 then 'class' when 13 then 'field' else 'function' end as type from j where rn = 1")
def nearest_symbol(g: Graph) -> DataFrame:
    k = F.col("k")
    symbols = g.nodes.select("file", "name", F.when(k % 4 == 0, 5).when(k % 4 == 1, 12).when(k % 4 == 2, 13).otherwise(6).alias("kind"), F.col("line").alias("start_line"), k.alias("ord"))
    points = g.edges.join(g.nodes.select(F.col("id").alias("src"), "file"), "src").select("file", (F.col("source_line") * 7).alias("line"))
    return tool_tables.nearest_symbol(symbols, points)


@query("select event_id as id, 'f:' || user_id as source, 'g:' || event_type as target, 'calls' as relation from events where event_id % 3 <> 2", over_graph=False)
def ai_edge_parse(g: Graph) -> DataFrame:
    body = F.concat(F.lit('[{"source": "f:'), F.col("user_id").cast("string"), F.lit('", "target": "g:'), F.col("event_type"), F.lit('", "relation": "calls", "confidence": 0.7}]'))
    k = F.col("event_id") % 3
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Edges:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.replace(body, F.lit("calls"), F.lit("likes")))
    found = tool_tables.parse_suggestions(g.table("events").select(F.col("event_id").alias("id"), said.alias("text")))
    return found.select("id", "source", "target", "relation")


@query("select file, cast((row_number() over (order by file) - 1) // 7 as bigint) as batch from (select distinct file from n)")
def ai_batches(g: Graph) -> DataFrame:
    return tool_tables.batches(g.nodes.select("file").distinct(), 7)


@query("select line from (select line, sum(length(line) + 1) over (order by line rows unbounded preceding) as so_far from (select distinct a.name || ' ' || relation || ' ' || b.name as line from e join n a on a.id = e.src join n b on b.id = e.dst)) where so_far <= 4000")
def prompt_budget(g: Graph) -> DataFrame:
    name = lambda c: g.nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    lines = g.edges.join(name("src"), "src").join(name("dst"), "dst").select(F.concat_ws(" ", "src_name", "relation", "dst_name").alias("line")).distinct()
    # The budget holds no more than its count of the shortest lines, so only those go to the running sum.
    return search.within_budget(lines.orderBy("line").limit(4000), F.col("line"), ["line"], 4000).select("line")


# ---- texts


@query("select k, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(name, '[A-Z][a-z]+|[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3))) as token from (select k, 'Get' || replace(name, '_', 'By') as name from n)")
def tokenize_names(g: Graph) -> DataFrame:
    return g.nodes.select("k", F.explode(fn.name_tokens(F.concat(F.lit("Get"), F.replace("name", F.lit("_"), F.lit("By"))))).alias("token"))


@query("select k, lower(regexp_replace(x, '([a-z])([A-Z])', '\\1-\\2', 'g')) as kebab from (select k, 'get' || type || 'By' || 'Name' as x from (select k, upper(substr(type, 1, 1)) || substr(type, 2) as type from n))")
def camel_to_kebab(g: Graph) -> DataFrame:
    return g.nodes.select("k", fn.camel_to_kebab(F.concat(F.lit("get"), F.initcap("type"), F.lit("ByName"))).alias("kebab"))


_STOPPED = ", ".join(f"'{w}'" for w in hooks.PROMPT_STOPS)


@query(f"with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}') as ws from conversations), f as (select conv_id, turn, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i and not list_contains([{_STOPPED}], lower(x))) as ws from w), t as (select conv_id, turn, list_slice(list_concat(list_filter(ws, lambda x: regexp_matches(x, '[A-Z_]')), list_filter(ws, lambda x: not regexp_matches(x, '[A-Z_]') and length(x) >= 5)), 1, 5) as ws from f) select conv_id, turn, cast(unnest(range(len(ws))) as int) as pos, unnest(ws) as word from t", over_graph=False)
def identifier_extract(g: Graph) -> DataFrame:
    return g.table("conversations").select("conv_id", "turn", F.posexplode(hooks.prompt_names(F.col("text"))).alias("pos", "word"))


@query("select cast(count(distinct file) as bigint) as total_files, cast(ceil(count(distinct file) / 10) as bigint) as batches, cast(2 * ceil(count(distinct file) / 10) + 1 as bigint) as agents from n")
def ai_plan(g: Graph) -> DataFrame:
    return hooks.pass_plan(g.nodes.select("file").distinct())


@query("select event_id, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then event_type end as term from events", over_graph=False)
def search_terms(g: Graph) -> DataFrame:
    k, kind = F.col("event_id") % 3, F.col("event_type")
    given = F.when(k == 0, F.create_map(F.lit("pattern"), kind)).when(k == 1, F.create_map(F.lit("command"), F.concat(F.lit("grep -rn '"), kind, F.lit("' src")))).otherwise(F.create_map(F.lit("command"), F.lit("ls src")))
    tool = F.when(k == 0, "Grep").otherwise("Bash")
    return g.table("events").select("event_id", hooks.search_term(tool, given).alias("term"))


@query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages", over_graph=False)
def import_edges_from_pages(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target"))


@query("select user_id, event_type, min(ts) as ts, arg_min(event_id, struct_pack(ts := ts, id := event_id)) as event_id from events group by all", over_graph=False)
def session_dedup(g: Graph) -> DataFrame:
    return first_of_session(g.table("events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts")
