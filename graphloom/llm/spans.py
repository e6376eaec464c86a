"""Spans in texts as (kind, start, end) in code points, and their digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import arrow_map, pick

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind in the order given, then end."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def span_rows(docs: DataFrame, find: Callable[[], Callable[[str], tuple[list[Span], list[Span]]]], base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """documents (doc_id, text) -> doc_id, a count of base spans for each base kind, base_sha256, spans.

    ``find()`` makes, once a worker, a function from a text to its base spans and all its spans."""
    names = ["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"]

    def run(batches):
        of = find()
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                own, every = of(text or "")
                row = [*(sum(s[0] == k for s in own) for k in base), hashlib.sha256(joined(own, kinds).encode()).hexdigest(), joined(every, kinds)]
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * len(base) + [pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string"
    return arrow_map(pick(docs, doc_id="doc_id", text="text"), run, schema)


def replace_spans(text: str, spans: Iterable[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first span in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
