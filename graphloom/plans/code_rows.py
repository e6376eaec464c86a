"""Registered queries over made sources: a file a part in each language, read by its extractor, and nodes for
each contract pattern. The SQL says what every file must give, from the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import contracts, embed, hooks, tool_tables
from graphloom.plans.catalog import EXACT, made_contracts, query
from graphloom.plans.derived import Graph
from graphloom.sources.extract import raw_facts


def written(template: str, k: Column) -> Column:
    """A template with the part's number for every {k}."""
    out: list[Column] = []
    for piece in template.replace("{k}", "\0{k}\0").split("\0"):
        if piece:
            out.append(k.cast("string") if piece == "{k}" else F.lit(piece))
    return F.concat(*out)


def said(template: str | None) -> str:
    """The same in SQL."""
    if template is None:
        return "null::varchar"
    return "concat('" + template.replace("'", "''").replace("{k}", "', p_partkey, '") + "')"


#: Language -> path, text, nodes (name, type, line), edges (source, target, relation, line, confidence).
SOURCES = {
    "python": (
        "src/m{k}.py",
        "import m{k}x\nfrom lib.part{k} import make as build\nclass C{k}(Base):\n    def run(self):\n        build({k})\n        return conf.get('key{k}')\ndef f{k}():\n    open('data/{k}.csv')\n    d['w'] = 1\n",
        [("src/m{k}.py", "file", 0), ("C{k}", "class", 3), ("run", "function", 4), ("f{k}", "function", 7)],
        [("src/m{k}.py", "m{k}x", "imports", 1, 1.0), ("src/m{k}.py", "lib.part{k}", "imports", 2, 1.0), ("C{k}", "Base", "implements", 3, 1.0), ("run", "build", "calls", 5, 1.0), ("run", "conf.key{k}", "reads", 6, 1.0), ("run", "conf.get", "calls", 6, 1.0), ("f{k}", "data/{k}.csv", "reads", 8, 1.0), ("f{k}", "open", "calls", 8, 1.0), ("f{k}", "d.w", "writes", 9, 1.0), ("f{k}", "d.w", "reads", 9, 1.0)],
    ),
    "script": (
        "web/p{k}.ts",
        "import { make{k}, other as o } from './lib{k}';\nimport pkg from 'pkg{k}';\nexport class V{k} extends Base {\n  show() { make{k}(1); }\n}\nexport const go{k} = () => { o(); };\nfunction plain{k}() { helper{k}(); }\n",
        [("p{k}.ts", "file", 1), ("V{k}", "class", 3), ("go{k}", "function", 6), ("plain{k}", "function", 7), ("show", "function", 4)],
        [("p{k}.ts", "web/lib{k}", "imports", 1, 1.0), ("p{k}.ts", "pkg{k}", "imports", 2, 1.0), ("V{k}", "Base", "implements", 3, 1.0), ("show", "make{k}", "calls", 4, 1.0), ("go{k}", "o", "calls", 6, 1.0), ("plain{k}", "helper{k}", "calls", 7, 1.0)],
    ),
    "rust": (
        "src/r{k}.rs",
        "use crate::lib{k}::make;\nmod part{k};\npub struct S{k};\nimpl Show for S{k} {\n    fn show(&self) { make(); }\n}\npub fn run{k}() { other{k}(); }\n",
        [("src/r{k}.rs", "file", 1), ("S{k}", "class", 3), ("show", "function", 5), ("run{k}", "function", 7)],
        [("src/r{k}.rs", "crate::lib{k}::make", "imports", 1, 1.0), ("src/r{k}.rs", "part{k}", "imports", 2, 1.0), ("S{k}", "Show", "implements", 4, 1.0), ("show", "make", "calls", 5, 1.0), ("run{k}", "other{k}", "calls", 7, 1.0)],
    ),
    "go": (
        "cmd/g{k}.go",
        'package main\n\nimport (\n\t"fmt"\n\tx "example.com/lib{k}"\n)\n\ntype T{k} struct {}\n\nfunc (t *T{k}) Show() { fmt.Println({k}) }\n\nfunc Run{k}() { helper{k}() }\n',
        [("cmd/g{k}.go", "file", 1), ("T{k}", "class", 8), ("Show", "function", 10), ("Run{k}", "function", 12)],
        [("cmd/g{k}.go", "fmt", "imports", 4, 1.0), ("cmd/g{k}.go", "example.com/lib{k}", "imports", 5, 1.0), ("Show", "T{k}", "implements", 10, 1.0), ("Show", "fmt.Println", "calls", 10, 1.0), ("Run{k}", "helper{k}", "calls", 12, 1.0)],
    ),
    "proto": (
        "api/s{k}.proto",
        'syntax = "proto3";\nimport "common{k}.proto";\nmessage Ask{k} { string id = 1; }\nservice Find{k} {\n  rpc Get(Ask{k}) returns (Said{k});\n}\n',
        [("api/s{k}.proto", "file", 1), ("Ask{k}", "class", 3), ("Find{k}", "class", 4), ("Get", "function", 5)],
        [("api/s{k}.proto", "common{k}.proto", "imports", 2, 1.0), ("Get", "Ask{k}", "calls", 5, 1.0), ("Get", "Said{k}", "calls", 5, 1.0)],
    ),
    "shell": (
        "bin/b{k}.sh",
        "#!/bin/bash\nsource ./lib{k}.sh\nrun{k}() {\n  echo {k}\n}\n",
        [("bin/b{k}.sh", "file", 1), ("run{k}", "function", 3)],
        [("bin/b{k}.sh", "./lib{k}.sh", "imports", 2, 1.0)],
    ),
    "solidity": (
        "sol/K{k}.sol",
        "pragma solidity ^0.8.0;\n\ncontract K{k} is Base{k} {\n  uint x;\n  function pay{k}() public { send{k}(); }\n}\n",
        [("sol/K{k}.sol", "file", 1), ("K{k}", "class", 3), ("pay{k}", "function", 5)],
        [("K{k}", "Base{k}", "implements", 3, 1.0), ("pay{k}", "send{k}", "calls", 5, 1.0)],
    ),
    "manifest": (
        "go{k}/go.mod",
        "module example.com/m{k}\n\nrequire (\n\texample.com/a{k} v1.2.3\n\texample.com/b{k} v0.1.0 // indirect\n)\nreplace example.com/a{k} => ./local{k}\n",
        [("example.com/m{k}", "file", 1)],
        [("example.com/m{k}", "example.com/a{k}", "imports", 4, 1.0), ("example.com/m{k}", "example.com/b{k}", "imports", 5, 0.5), ("example.com/m{k}", "./local{k}", "implements", 7, 1.0)],
    ),
}


def _expected(language: str) -> str:
    _, _, nodes, edges = SOURCES[language]
    rows = [f"select p_partkey as k, 'node' as kind, {said(n)} as name, '{t}' as what, null::varchar as target, cast({line} as int) as line, null::double as confidence from part" for n, t, line in nodes]
    rows += [f"select p_partkey, 'edge', {said(s)}, '{r}', {said(t)}, cast({line} as int), {c}::double from part" for s, t, r, line, c in edges]
    return " union all ".join(rows)


def _extracted(g: Graph, language: str) -> DataFrame:
    """What the extractor finds in a file a part: nodes with their type, edges with their relation."""
    path, text, _, _ = SOURCES[language]
    k = F.col("p_partkey")
    made = g.table("part").select(k.cast("string").alias("project"), written(path, k).alias("path"), written(text, k).alias("content"))
    rows = raw_facts(made)
    return rows.select(F.col("project").cast("long").alias("k"), "kind", "name", F.coalesce("type", "relation").alias("what"), "target", "line", "confidence")


@query(_expected("python"), over_graph=False)
def extract_python(g: Graph) -> DataFrame:
    return _extracted(g, "python")


@query(_expected("script"), over_graph=False)
def extract_script(g: Graph) -> DataFrame:
    return _extracted(g, "script")


@query(_expected("rust"), over_graph=False)
def extract_rust(g: Graph) -> DataFrame:
    return _extracted(g, "rust")


@query(_expected("go"), over_graph=False)
def extract_go(g: Graph) -> DataFrame:
    return _extracted(g, "go")


@query(_expected("proto"), over_graph=False)
def extract_proto(g: Graph) -> DataFrame:
    return _extracted(g, "proto")


@query(_expected("shell"), over_graph=False)
def extract_shell(g: Graph) -> DataFrame:
    return _extracted(g, "shell")


@query(_expected("solidity"), over_graph=False)
def extract_solidity(g: Graph) -> DataFrame:
    return _extracted(g, "solidity")


@query(_expected("manifest"), over_graph=False)
def extract_manifest(g: Graph) -> DataFrame:
    return _extracted(g, "manifest")


#: Pattern -> file, name, type, callee, source of a node that shows it, and the identifier it must give. Of a
#: source match the first part counts as the verb and the second as the route, whatever the pattern's parts are.
SHOWN = {
    "nextjs_app_router": ("app/api/users{k}/[id]/route.ts", "GET", "function", None, None, "http::get::/api/users{k}/{param}"),
    "nextjs_pages_router": ("pages/api/items{k}.ts", "handler", "function", None, None, "http::any::/api/items{k}"),
    "express_router": ("routes/r{k}.ts", "getUser{k}", "function", "router.get", None, "http::any::routes/r{k}.ts"),
    "flask_fastapi": ("views/v{k}.py", "show{k}", "function", None, "@app.post('/things/{k}/')", "http::app::post"),
    "actix_axum": ("handlers/h{k}.rs", "list{k}", "function", None, '#[get("/rs/{k}")]', "http::get::/rs/{k}"),
    "go_http": ("server/s{k}.go", "ServeThing{k}", "function", "http.HandleFunc", None, "http::any::server/s{k}.go"),
    "spring_boot": ("rest/R{k}.java", "one{k}", "function", None, '@GetMapping("/java/{k}")', "http::get::/java/{k}"),
    "aspnet": ("Controllers/C{k}.cs", "two{k}", "function", None, '[HttpPut("cs/{k}")]', "http::put::cs/{k}"),
    "rails_controller": ("app/controllers/users{k}_controller.rb", "index", "function", None, None, "http::any::/api/users{k}"),
    "laravel": ("routes/web{k}.php", "store", "function", None, None, "http::any::/api/routes"),
    "http_consumer_callee": ("lib/client{k}.ts", "load{k}", "function", "axios.get", None, "http::any::load{k}"),
    "proto_service": ("proto/p{k}.proto", "Find{k}", "class", None, None, "grpc::Find{k}"),
    "grpc_client": ("lib/g{k}.go", "UserStub{k}", "function", "stub.Call", None, "grpc::UserStub{k}"),
    "topic_producer": ("lib/q{k}.java", "push{k}", "function", "kafka.send", None, "topic::push{k}"),
    "topic_consumer": ("lib/w{k}.java", "pull{k}", "function", "kafka.consume", None, "topic::pull{k}"),
    "solidity_contract": ("sol/V{k}.sol", "Vault{k}", "class", None, None, "onchain::Vault{k}"),
    "onchain_consumer": ("lib/o{k}.js", "TokenClient{k}", "function", "web3.eth", None, "onchain::TokenClient{k}"),
}


def _patterns_sql() -> str:
    rows = [f"select p_partkey as k, '{p}' as pattern, {said(shown[-1])} as contract_id from part" for p, shown in SHOWN.items()]
    return " union all ".join(rows)


@query(_patterns_sql(), over_graph=False)
def contract_patterns_all(g: Graph) -> DataFrame:
    """Each pattern in order, over a node a part that shows it."""
    k, part = F.col("p_partkey"), g.table("part")
    value = lambda t: written(t, k) if t is not None else F.lit(None).cast("string")
    rows = None
    for pattern, (file, name, kind, callee, source, _) in SHOWN.items():
        calls = F.array(F.lit(callee)) if callee else F.array().cast("array<string>")
        one = part.select(F.concat(F.lit(f"{pattern}:"), k.cast("string")).alias("id"), F.lit("p").alias("project"), value(file).alias("file"), value(name).alias("name"), F.lit(kind).alias("type"), value(source).alias("source"), calls.alias("callees"))
        rows = one if rows is None else rows.unionByName(one)
    found = contracts.structural(rows.drop("callees"), rows.select("id", "callees"))
    return found.select(F.substring_index("symbol_node", ":", -1).cast("long").alias("k"), F.col("pattern"), "contract_id")


# ---- vectors, libraries, tables of a language server, prompts, scalars


_WORDS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(concat(name, ' ', file, ' ', type), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f", w as (select k, unnest({_WORDS}) as t from n) select k, cast(('0x' || substr(md5(t), 1, 4))::int % 64 as int) as dim, sum(case when substr(md5(t), 5, 1) < '8' then 1.0 else -1.0 end)::double as value from w group by all having value <> 0")
def embed_nodes(g: Graph) -> DataFrame:
    """The vectors' places that aren't zero."""
    vectors = embed.embed_nodes(g.nodes).join(g.nodes.select("id", "k"), "id")
    return vectors.select("k", F.posexplode("embedding").alias("dim", "value")).where("value <> 0")


@query(", m as (select distinct project, case when k % 9 = 0 then concat('Pkg', k % 7) end as own, concat(case when k % 2 = 0 then 'proj' else 'Lib' end, k % 6) as dep, case when k % 3 = 0 then 0.5 else 0.8 end as c from n), o as (select distinct project, 'lib::' || lower(own) as contract_id, 'provider' as role, 1.0 as confidence, false as local from m where own is not null), d as (select project, 'lib::' || lower(dep) as contract_id, 'consumer' as role, max(case when dep in (select project from n) then 1.0 else c end) as confidence, bool_or(dep in (select project from n)) as local from m group by all) select project, contract_id, role, confidence::double as confidence, local from o union all select project, contract_id, role, confidence::double, local from d")
def library_contracts(g: Graph) -> DataFrame:
    k = F.col("k")
    own = F.when(k % 9 == 0, F.concat(F.lit("Pkg"), (k % 7).cast("string")))
    dep = F.concat(F.when(k % 2 == 0, "proj").otherwise("Lib"), (k % 6).cast("string"))
    manifests = g.nodes.select("project", own.alias("own"), dep.alias("dep"), F.when(k % 3 == 0, 0.5).otherwise(0.8).alias("confidence"))
    return contracts.lib_contracts(manifests, g.nodes.select("project"))


@query(EXACT + ", wi as (select a.id as consumer_id, b.id as provider_id, round(least(a.confidence, b.confidence)::double * 0.8, 6) as confidence, b.contract_id from c a join c b on a.role = 'consumer' and b.role = 'provider' and a.project <> b.project and a.contract_id <> b.contract_id and split_part(a.contract_id, '::', 1) = split_part(b.contract_id, '::', 1) and (a.contract_id glob b.contract_id) where (a.id, b.id) not in (select consumer_id, provider_id from ex)), t as (select *, case when role = 'consumer' then ['get', lower(regexp_extract(contract_id, 'get(.*)Client', 1)), 'client'] else ['trs', lower(regexp_extract(contract_id, 'TRS(.*)', 1))] end as w from c where contract_type = 'onchain'), fu as (select a.id as consumer_id, b.id as provider_id, round(least(a.confidence, b.confidence)::double * len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) as confidence, b.contract_id from t a join t b on a.role = 'consumer' and b.role = 'provider' and a.project <> b.project where len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.3 and (a.id, b.id) not in (select consumer_id, provider_id from ex)) select consumer_id, provider_id, 'exact' as match_type, round(confidence, 6) as confidence, contract_id from ex union all select consumer_id, provider_id, 'wildcard', confidence, contract_id from wi union all select consumer_id, provider_id, 'fuzzy', confidence, contract_id from fu", over_graph=False)
def contract_links(g: Graph) -> DataFrame:
    rows = made_contracts(g)
    # Exact links have the lesser confidence as it is; rounded before, it needn't be in each of the links.
    return contracts.match_all(rows.withColumn("confidence", F.round("confidence", 6)))


_SYMBOLS = "sy as (select file, name, line as st, k as ord from n), ed as (select a.file as file, a.name as source_name, e.source_line, b.file as target_file, b.line + e.source_line % 4 as target_line from e join n a on a.id = e.src join n b on b.id = e.dst where relation = 'imports'), tl as (select distinct target_file, target_line from ed), nr as (select target_file, target_line, s.name, row_number() over (partition by target_file, target_line order by abs(st - target_line), case when st = target_line then -ord else ord end) as rn from tl join sy s on s.file = target_file and abs(st - target_line) <= 3)"


def _answers(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Symbols, and where definitions are found: a few lines off at times."""
    symbols = g.nodes.select("file", "name", F.lit(12).alias("kind"), F.col("line").alias("start_line"), F.col("k").alias("ord"))
    a = g.nodes.select(F.col("id").alias("src"), "file", F.col("name").alias("source_name"))
    b = g.nodes.select(F.col("id").alias("dst"), F.col("file").alias("target_file"), F.col("line").alias("target"))
    found = g.edges.where("relation = 'imports'").join(a, "src").join(b, "dst")
    return symbols, found.select("file", "source_name", "source_line", "target_file", (F.col("target") + F.col("source_line") % 4).alias("target_line"))


@query(f", {_SYMBOLS} select ed.file, source_name as source, target_file || ':' || nr.name as target, 'imports' as relation, 0.9::double as confidence, source_line from ed join nr using (target_file, target_line) where rn = 1")
def definition_edges(g: Graph) -> DataFrame:
    symbols, found = _answers(g)
    return tool_tables.definition_edges(found, symbols, "p").drop("project")


@query(f", {_SYMBOLS} select target_file as file, nr.name as source, ed.file || ':' || source_name as target, 'implements' as relation, 0.9::double as confidence, target_line as source_line from ed join nr using (target_file, target_line) where rn = 1")
def implementation_edges(g: Graph) -> DataFrame:
    symbols, found = _answers(g)
    return tool_tables.implementation_edges(found.withColumnRenamed("file", "source_file"), symbols, "p").drop("project")


@query("select a.file, a.name as source, b.file || ':' || b.name as target, 'calls' as relation, 0.9::double as confidence, source_line from e join n a on a.id = e.src join n b on b.id = e.dst where relation = 'calls'")
def call_edges(g: Graph) -> DataFrame:
    a = g.nodes.select(F.col("id").alias("src"), F.col("file").alias("caller_file"), F.col("name").alias("caller_name"))
    b = g.nodes.select(F.col("id").alias("dst"), F.col("file").alias("callee_file"), F.col("name").alias("callee_name"))
    return tool_tables.call_edges(g.edges.where("relation = 'calls'").join(a, "src").join(b, "dst"), "p").drop("project")


@query("select k, case when k % 2 = 0 then 'def v1 ' || name end as type_info from n")
def type_info(g: Graph) -> DataFrame:
    """Texts that come twice, the later one counting, empty ones, and some of another project."""
    k = F.col("k")
    said_ = F.when(k % 2 == 0, F.concat(F.lit("def v"), F.col("ord").cast("string"), F.lit(" "), F.col("name"))).otherwise("")
    hover = g.nodes.select("project", "file", "name", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).withColumn("type_info", said_)
    other = g.nodes.select(F.lit("elsewhere").alias("project"), "file", "name", "k", F.lit(9).alias("ord"), F.lit("wrong").alias("type_info"))
    return tool_tables.add_type_info(g.nodes, hover.unionByName(other)).select("k", "type_info")


@query(r", ps as (select k as id, regexp_extract(name, '^[a-z]+_[a-z]+', 0) as term from n where length(regexp_extract(name, '^[a-z]+_[a-z]+', 0)) >= 5 and k % 40 = 1), hit as (select ps.id, term, n.name, n.file, n.line, row_number() over (partition by ps.id order by n.name, n.id) as rn from ps join n on contains(n.name, term)) select id, term, name, file, line from hit where rn <= 3")
def prompt_lookup(g: Graph) -> DataFrame:
    term = F.regexp_extract("name", "^[a-z]+_[a-z]+", 0)
    prompts = g.nodes.where((F.length(term) >= 5) & (F.col("k") % 40 == 1)).select(F.col("k").alias("id"), F.concat(F.lit("Find the "), term).alias("text"))
    return hooks.prompt_lookup(g.nodes, g.edges, prompts).drop("callers")


@query("select k, trim(name) as bare, 'a b/' || file as path, cast(length(file) - length(replace(file, '/', '')) + 1 as int) as line, replace(file, '.py', '') as route from n")
def scalar_functions(g: Graph) -> DataFrame:
    """The name in a requirement, a path from a file URI, a line from an offset, a route from a file."""
    uri = F.concat(F.lit("file:///root/a%20b/"), F.col("file"))
    return g.nodes.select("k", fn.strip_version(F.concat("name", F.lit("[x]>=1; y"))).alias("bare"), fn.uri_to_path(uri, "/root").alias("path"), fn.line_of(F.translate("file", "/", "\n"), F.length("file")).alias("line"), fn.path_of_match(F.col("file")).alias("route"))
