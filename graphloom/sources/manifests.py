"""Dependency manifests: the package's own name and what it depends on."""

from __future__ import annotations

import json
import re
import tomllib

from graphloom.sources.facts import Facts, Lines

#: The manifests that are read.
MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "go.mod", "build.gradle", "composer.json", "Gemfile")
GRAPH_MANIFESTS = ("go.mod", "Cargo.toml", "pyproject.toml")


def bare_name(requirement: str) -> str:
    return re.split(r"[\[>=<~!;]", requirement)[0].strip()


def _table(text: str, load) -> dict:
    try:
        found = load(text)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def parse_manifest(name: str, text: str) -> tuple[str | None, list[tuple[str, float]]]:
    """(own name, [(dependency, confidence)]): 0.8, for development 0.5; nothing of a broken file."""
    if name == "package.json":
        data = _table(text, json.loads)
        return data.get("name"), [(d, 0.8) for d in data.get("dependencies") or {}] + [(d, 0.5) for d in data.get("devDependencies") or {}]
    if name == "composer.json":
        data = _table(text, json.loads)
        return data.get("name"), [(d, 0.8) for d in data.get("require") or {} if d != "php"]
    if name == "Cargo.toml":
        data = _table(text, tomllib.loads)
        return data.get("package", {}).get("name"), [(d, 0.8) for d in data.get("dependencies", {})] + [(d, 0.5) for d in data.get("dev-dependencies", {})]
    if name == "pyproject.toml":
        project = _table(text, tomllib.loads).get("project", {})
        return project.get("name"), [(n, 0.8) for d in project.get("dependencies", []) if (n := bare_name(d))]
    if name == "go.mod":
        own = re.search(r"^module\s+(\S+)", text, re.M)
        listed = [line.split() for block in re.findall(r"require\s*\((.*?)\)", text, re.S) for line in block.splitlines()]
        return own and own.group(1), [(w[0], 0.8) for w in listed if w and not w[0].startswith("//")]
    if name == "build.gradle":
        return None, [(":".join(m.split(":")[:2]), 0.8) for m in re.findall(r"['\"]([^'\":]+:[^'\":]+:[^'\"]+)['\"]", text)]
    if name == "Gemfile":
        return None, [(m, 0.8) for m in re.findall(r"\bgem\s+['\"]([^'\"]+)['\"]", text)]
    return None, []


def extract_manifest(path: str, text: str) -> Facts:
    """A manifest as a file node named for its module, with an import edge a dependency."""
    facts, kind = Facts(path), path.rpartition("/")[2]
    own, line = parse_manifest(kind, text)[0] or path, Lines(text)
    facts.node(own, "file", 1)
    add = lambda dep, confidence, relation="imports", at=1: facts.edge(own, dep, relation, at, confidence)
    if kind == "go.mod":
        for block in re.finditer(r"^require\s*\((.*?)^\)|^require[ \t]+([^(\n]+)$", text, re.M | re.S):
            start = block.start(1) if block.group(1) is not None else block.start(2)
            for m in re.finditer(r"^[ \t]*([^\s/(][^\s]*)[ \t]+v\S+([^\n]*)", block.group(1) or block.group(2) or "", re.M):
                add(m.group(1), 0.5 if "indirect" in m.group(2) else 1.0, at=line(start + m.start(1)))
        for m in re.finditer(r"^(?:replace\s+|[ \t]+)(\S+)(?:\s+v\S+)?\s+=>\s+(\S+)", text, re.M):
            add(m.group(2), 1.0, "implements", line(m.start(1)))
    elif kind == "Cargo.toml":
        data = _table(text, tomllib.loads)
        for part, confidence in (("dependencies", 1.0), ("dev-dependencies", 0.5), ("build-dependencies", 0.7)):
            for dep in data.get(part, {}):
                add(dep, confidence)
    elif kind == "pyproject.toml":
        project = _table(text, tomllib.loads).get("project", {})
        for dep in project.get("dependencies", []):
            add(bare_name(dep), 1.0)
        for group in project.get("optional-dependencies", {}).values():
            for dep in group:
                add(bare_name(dep), 0.5)
    return facts
