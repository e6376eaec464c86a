"""Tables of the code graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The relations an edge may have.
RELATIONS = ("calls", "imports", "reads", "writes", "implements")

RAW_NODES = "project string, file string, name string, type string, line int, ord bigint"
RAW_EDGES = "project string, file string, source string, target string, relation string, confidence double, source_line int, ord bigint"
NODES = "id string, project string, file string, name string, type string, line int"
EDGES = "src string, dst string, relation string, confidence double, source_line int"
CLUSTERS = "project string, cluster_id int, label string, node_count int, key_files array<string>, key_functions array<string>"
PROCESSES = "id string, project string, label string, process_type string, step_count int, cross_community boolean, entry_id string, terminal_id string"
CONTRACTS = "id string, project string, contract_id string, contract_type string, role string, symbol_name string, symbol_file string, symbol_node string, confidence double, meta map<string,string>"
CONTRACT_LINKS = "consumer_id string, provider_id string, match_type string, confidence double, contract_id string"
GROUPS = "name string, members array<struct<project:string,path:string>>, detect map<string,boolean>"


def key_of(*parts: Column | str) -> Column:
    """Sixteen hexadecimal digits of SHA-256 over the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def node_key(project: Column | str = "project", file: Column | str = "file", name: Column | str = "name") -> Column:
    return key_of(project, file, name)


def check_relation(relation: str) -> str:
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation!r}")
    return relation
