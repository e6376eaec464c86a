"""What keeps queries whole on large tables: sizes that plans go by, rows that are made."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.plans import catalog, code_rows  # noqa: F401
from graphloom.storage import materialize

DATA = "/root/testdata/sf0.001"


def test_group_impact_does_not_broadcast_by_compressed_size(spark):
    """A table that is small in its file alone isn't sent to the driver: 400,000 rows in about 2 MB."""
    rows = materialize(spark.range(400_000).select(F.concat(F.lit("lib::x"), F.col("id").cast("string")).alias("contract_id"), F.lit("a project").alias("project")), "repeated")
    plan = rows.join(rows.withColumnRenamed("project", "other"), "contract_id")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_contract_matches_in_blocks_are_all_there(spark, monkeypatch):
    """Against pairs by hand, at lists of three; a row of contracts is one contract, also without a confidence."""
    from graphloom.operators import contracts

    monkeypatch.setattr(contracts, "BLOCK", 3)
    names = ["lib::@a/*", "lib::@a/x", "lib::@a/y", "onchain::getTokenPoolClient", "onchain::TRSToken", "onchain::*"]
    rows = [(f"{r[0]}{i}", f"p{i % 3}", r, names[i % 6].split("::")[0], names[i % 6], None if i % 5 == 0 else i % 4 / 4 + 0.1) for r in ("consumer", "provider") for i in range(25)]
    rows += [rows[1], ("c99", "p0", "consumer", None, "lib::@a/x", 0.5)]
    words = {names[3]: {"get", "token", "pool", "client"}, names[4]: {"trs", "token"}}
    want = []
    for c in (r for r in rows if r[2] == "consumer"):
        for p in (r for r in rows if r[2] == "provider" and r[1] != c[1]):
            a, b, least = c[4], p[4], min(1.0 if x[5] is None else x[5] for x in (c, p))
            met = words.get(a, set()) & words.get(b, set()) if c[3] == p[3] == "onchain" else ()
            if a == b:
                want.append((c[0], p[0], "exact", round(least, 6), b))
            elif a.split("::")[0] == b.split("::")[0] and any(x.endswith("*") and y.startswith(x[:-1]) for x, y in ((a, b), (b, a))):
                want.append((c[0], p[0], "wildcard", round(least * 0.8, 6), b))
            elif met:
                want.append((c[0], p[0], "fuzzy", round(least * len(met) / min(len(words[a]), len(words[b])), 6), b))
    made = spark.createDataFrame(rows, "id string, project string, role string, contract_type string, contract_id string, confidence double")
    columns = ["consumer_id", "provider_id", "match_type", "confidence", "contract_id"]
    got = lambda df: sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in df.select(*columns).collect())
    assert got(contracts.match_all(made)) == sorted(want) and len({w[2] for w in want}) == 3
    assert got(contracts.match_wildcard(made)) == sorted(w for w in want if w[2] == "wildcard")
    assert got(contracts.match_fuzzy(made)) == sorted(w for w in want if w[2] == "fuzzy")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["contract_links", "contract_match_wildcard", "contract_match_fuzzy"])
def test_pairs_of_contracts_are_not_shuffled(spark, name):
    """Once opened, pairs go to no join, group, window or shuffle."""
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")] if "Generate" in plan else plan
    assert "Generate" in plan and not any(x in above for x in ("Join", "Aggregate", "Window", "Repartition", "Deduplicate"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["contract_links", "contract_match_wildcard", "contract_match_fuzzy"])
def test_pairs_in_memory_are_of_one_consumer(spark, name):
    """Generated code, marked by a star, holds what it makes of a row; consumers are opened before it, and a pair
    adds an id to what was settled for a list."""
    df = catalog.QUERIES[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n")
    opened = [line for line in plan if "Generate " in line]
    assert "explode(ids" in opened[0] and "*(" in opened[0] and "*(" in opened[1] and "*(" not in opened[2]
    above = "".join(plan[: plan.index(opened[0])])
    assert "least(" not in above and "Filter" not in above


def test_contracts_without_an_id_or_a_project(spark):
    """One without an id is a contract still; one without a project isn't in another one than any."""
    from graphloom.operators import contracts

    rows = [(i, p, r, "lib", f"lib::@a/{'*' if r == 'provider' else 'x'}", 0.5) for r in ("consumer", "provider") for i, p in ((None, "a"), (None, "a"), ("1", "b"), ("2", None))]
    made = spark.createDataFrame(rows, "id string, project string, role string, contract_type string, contract_id string, confidence double")
    got = [(r["consumer_id"], r["provider_id"], r["confidence"]) for r in contracts.match_wildcard(made).collect()]
    assert sorted(got, key=str) == sorted([(None, "1", 0.4)] * 2 + [("1", None, 0.4)] * 2, key=str)


def test_vectors_hash_words_once(spark):
    """Words are hashed once a batch and not for each of the vector's places."""
    from graphloom.operators import embed

    plan = spark.createDataFrame([("getUserName x x",)], "t string").select(embed.embedded(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "sums(" in plan and "md5(" not in plan


def test_prompt_lookup_gives_prompts_the_first_nodes_alone(spark, monkeypatch):
    """What many prompts ask for and many names hold isn't paired."""
    from graphloom.operators import hooks

    nodes = spark.range(60).selectExpr("cast(id as string) id", "concat('load_config_', lpad(id, 2, '0')) name", "'a.py' file", "'function' type", "cast(id as int) line")
    prompts = spark.range(50).selectExpr("id", "'explain load_config' text")
    ranked, real = [], hooks.first_per
    monkeypatch.setattr(hooks, "first_per", lambda df, *rest: ranked.append(df.count()) or real(df, *rest))
    none = spark.createDataFrame([], "src string, dst string, relation string")
    got = sorted((r["id"], r["name"]) for r in hooks.prompt_lookup(nodes, none, prompts).collect() if r["term"] == "load_config")
    assert got == [(i, f"load_config_0{k}") for i in range(50) for k in range(3)]
    assert max(ranked) < 1000
