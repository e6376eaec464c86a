"""What tool events ask of the graph: search terms, names in prompts, candidates for a lookup, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import camel_to_kebab
from graphloom.operators.store import first_per
from graphloom.schemas import RELATIONS
from graphloom.storage import FEW, materialize

#: Words in prompts that name nothing.
PROMPT_STOPS = (
    "the", "and", "for", "that", "this", "with", "from", "are", "was", "not", "but", "have", "has", "its", "into", "also", "use", "how", "find", "look",
    "check", "where", "what", "which", "does", "can", "should", "would", "could", "need", "want", "get", "set", "all", "any", "each", "file", "code",
    "function", "class", "method", "agent", "explore", "search", "implementation", "setup", "logic", "create", "update", "delete", "read", "write", "run", "test",
)

#: The shell's search commands, and what a name that is searched for looks like.
SEARCHES = r"(^|/)([a-z]*grep|rg|ag|ack)$"
NAME = r"^[A-Za-z_][\w.\-]*$"


def search_term(tool: Column, given: Column) -> Column:
    """The name that a search tool or a shell search looks for; of alternatives the first without a dot;
    else null. given: a map with pattern or command. A command is read word by word: after the first
    search command, options and what can't be a name are passed over."""
    words = F.split(F.trim(F.regexp_replace(given["command"], r"\s[|;&]+|[;&(]", " ")), r"\s+")
    at = F.array_position(F.transform(words, lambda w: w.rlike(SEARCHES)), F.lit(True)).cast("int")
    rest = F.slice(words, at + 1, F.size(words))
    bare = F.transform(F.filter(rest, lambda w: ~w.startswith("-")), lambda w: F.regexp_replace(w, "[\"']", ""))
    choices = F.transform(bare, lambda w: F.split(w, r"\|"))
    asked = F.get(F.filter(choices, lambda c: F.forall(c, lambda w: w.rlike(NAME))), 0)
    term = F.when(F.size(asked) == 1, asked[0]).otherwise(F.get(F.filter(asked, lambda w: ~w.contains(".")), 0))
    return F.when((tool == "Grep") & given["pattern"].rlike(NAME), given["pattern"]).when((tool == "Bash") & (at > 0), term)


def prompt_names(text: Column, most: int = 5) -> Column:
    """Names in free text, each once whatever its case: first those with a capital or an underscore, then
    other words of five letters or more."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), 1)
    lower = F.transform(words, F.lower)
    new = F.filter(words, lambda w, i: (F.array_position(lower, F.lower(w)) == i + 1) & ~F.lower(w).isin(list(PROMPT_STOPS)))
    marked = F.filter(new, lambda w: w.rlike("[A-Z_]"))
    plain = F.filter(new, lambda w: ~w.rlike("[A-Z_]") & (F.length(w) >= 5))
    return F.slice(F.concat(marked, plain), 1, most)


def candidates(name: Column) -> Column:
    """Forms of a name to look for, in order: lower case, first half, first four letters, kebab case."""
    lower = F.lower(name)
    stem = F.substring(lower, F.lit(1), F.greatest(F.lit(4), F.floor(F.length(lower) / 2).cast("int")))
    return F.array_distinct(F.array(lower, stem, F.substring(lower, F.lit(1), F.lit(4)), camel_to_kebab(name)))


def holding(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes whose name holds an asked text of three letters or more, beside that text: an equi-join on the
    trigram of the text that the fewest names have, then the texts themselves."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(c, i, F.lit(3))))
    lower, asked = F.lower("name"), F.col("asked")
    named = nodes.where(F.length("name") >= 3)
    # Counted before they meet the texts: a row a trigram and task.
    names = named.select(F.explode(grams(lower)).alias("gram")).groupBy("gram").agg(F.count("*").alias("names"))
    tried = wanted.where(F.length("asked") >= 3).select("asked", F.explode(grams(asked)).alias("gram"))
    # A trigram that no name has leaves nothing to find.
    rare = materialize(tried.join(names, "gram", "left").groupBy("asked").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram")), "rare")
    few = F.broadcast(rare) if rare.count() <= FEW else rare
    return named.select("*", F.explode(grams(lower)).alias("gram")).join(few, "gram").where(F.contains(lower, asked)).drop("gram")


def prompt_lookup(nodes: DataFrame, edges: DataFrame, prompts: DataFrame, most_nodes: int = 3, most_callers: int = 3) -> DataFrame:
    """prompts (id, text) -> id, term, name, file, line, callers: for each name of a prompt the nodes that
    its first form with any hit is part of. However many prompts ask for a text, its first nodes are found
    once, and only those are given to the prompts."""
    terms = prompts.select("id", F.posexplode(prompt_names(F.col("text"))).alias("nth", "term"))
    forms = terms.select("id", "nth", "term", F.posexplode(candidates(F.col("term"))).alias("form", "asked"))
    hit = holding(nodes.where("type <> 'file'"), forms.select("asked").distinct())
    order = [F.col("name"), F.col("node")]
    first = first_per(hit.select("asked", F.col("id").alias("node"), "name", "file", "line"), ["asked"], order, most_nodes)
    first = materialize(first, "first")
    best = forms.join(first.select("asked").distinct(), "asked", "left_semi").groupBy("id", "nth").agg(F.min("form").alias("form"))
    found = forms.join(best, ["id", "nth", "form"]).join(first, "asked")
    kept = first_per(found, ["id", "nth"], order, most_nodes)
    calls = edges.where("relation = 'calls'").join(first.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").join(nodes.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src")
    by = calls.groupBy(F.col("dst").alias("node")).agg(F.slice(F.sort_array(F.collect_set("caller")), 1, most_callers).alias("callers"))
    return kept.join(by, "node", "left").select("id", "term", "name", "file", "line", "callers")


def enclosing(scopes: DataFrame, edits: DataFrame) -> DataFrame:
    """scopes (file, name, start, end), edits (id, file, content, old) -> id, name: the innermost scope of
    the first line that holds the first line of the old text."""
    first = F.trim(F.split("old", "\n")[0])
    lines = edits.select("id", "file", first.alias("first"), F.posexplode(F.split("content", "\n")).alias("n", "line")).where((F.col("first") != "") & F.contains("line", "first"))
    at = lines.groupBy("id", "file").agg((F.min("n") + 1).alias("at"))
    hit = at.join(scopes, "file").where("start <= at and at <= end")
    return hit.groupBy("id").agg(F.min_by("name", F.struct(F.col("end") - F.col("start"), F.col("name"))).alias("name"))


def new_in_session(events: DataFrame, seen: DataFrame) -> DataFrame:
    """events (session, key) not seen before in their session, each once."""
    return events.dropDuplicates(["session", "key"]).join(seen, ["session", "key"], "left_anti")


def edge_lines(edges: DataFrame, budget: int = 4000) -> DataFrame:
    """edges (ord, source, relation, target) -> the lines of a prompt, as many as a budget of characters
    holds, and how many more there are."""
    said = edges.select("ord", F.concat(F.coalesce("source", F.lit("?")), F.lit(" --"), F.coalesce("relation", F.lit("?")), F.lit("--> "), F.coalesce("target", F.lit("?"))).alias("line"))
    few = said.orderBy("ord").limit(budget)
    over = F.sum(F.length("line") + 1).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    kept = few.withColumn("so_far", over).where(F.col("so_far") <= budget).select("ord", "line")
    left = said.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("k"))).where("n > k")
    return kept.unionByName(left.select(F.lit(None).cast(dict(said.dtypes)["ord"]).alias("ord"), F.concat(F.lit("[... and "), (F.col("n") - F.col("k")).cast("string"), F.lit(" more]")).alias("line")))


def pass_prompt(number: int, root: str, paths: list[str], known: str = "") -> str:
    """The text of a model pass over some files: 1 asks for what the code says, 2 for what it only implies
    beside the known edges, 3 for what looks wrong in a summary of the graph."""
    asks = {
        1: f"List the relations in these files of {root}: who calls, imports, reads, writes or implements what.",
        2: f"Known relations of {root}:\n{known or '(none)'}\n\nList relations that these files only imply: shared state, dispatch by name, order of execution, shared settings.",
        3: f"A summary of the code graph of {root}:\n{known}\n\nList relations that must be missing: for isolated symbols, for hubs with few edges, for imports without a call.",
    }
    form = '{"source": "file:symbol", "target": "file:symbol", "relation": "' + "|".join(RELATIONS) + '", "confidence": 0.8, "line": 0, "reason": ""}'
    listed = "".join(f"\n- {p}" for p in paths)
    return f"{asks[number]}\nAnswer with a JSON array alone, [] if there is nothing. Each entry: {form}" + (f"\nFiles:{listed}" if paths else "")


def pass_plan(paths: DataFrame, size: int = 10) -> DataFrame:
    """total_files, batches, agents of a model pass: two rounds over the batches and one over all."""
    n = F.ceil(F.count("*") / size)
    return paths.agg(F.count("*").alias("total_files"), n.alias("batches"), (2 * n + 1).alias("agents"))
