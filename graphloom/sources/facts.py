"""What an extractor finds in one file, before names are resolved."""

from __future__ import annotations

import posixpath
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Facts:
    """Nodes (name, type, line) and edges of a file. An edge's target is ``target`` unless one of the
    ``candidates`` is a file of the project: then it is that file, and with ``rest`` a symbol in it."""

    path: str
    nodes: list[tuple[str, str, int]] = field(default_factory=list)
    edges: list[tuple[str, str, str, float, int, list[str], str | None]] = field(default_factory=list)

    def node(self, name: str, kind: str, line: int) -> None:
        self.nodes.append((name, kind, line))

    def edge(self, source: str, target: str, relation: str, line: int, confidence: float = 1.0, candidates: list[str] | None = None, rest: str | None = None) -> None:
        self.edges.append((source, target, relation, confidence, line, candidates or [], rest))


class Lines:
    """Line numbers of offsets, from 1."""

    def __init__(self, text: str):
        self.ends = [i for i, c in enumerate(text) if c == "\n"]

    def __call__(self, offset: int) -> int:
        return bisect_right(self.ends, offset - 1) + 1


def under(folder: str, path: str) -> str:
    """A path relative to a folder, normalised; the project's root is the empty folder."""
    out = posixpath.normpath(posixpath.join(folder, path))
    return "" if out == "." else out
