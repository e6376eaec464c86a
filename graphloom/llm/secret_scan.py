"""Secret scan with multipart linking: parts of one credential that stand together.

Some findings speak for themselves: assignments to a secret's name, access key identifiers, long runs
of hexadecimal digits. Others are weak: a bare string that looks random, a user name, an endpoint. A
credential is an identifier, a secret and an endpoint, so weak candidates are reported only if a
complementary part is near: identifiers, secrets and endpoints are joined as intervals within a scope
(no line longer than REACH between them, no blank line between them), and a weak part is kept if an
access identifier stands with a secret, an endpoint with both, or a secret with an identifier or with
an endpoint that carries a user name.

Spans: assign, access, hex (base), then secret, user and endpoint (weak parts, linked).

Defined cases: a null text counts as empty and has no span. Repeated rows are scanned each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BATCH_ROWS
from graphloom.llm.spans import Span, replace_spans, span_rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "secret", "user", "endpoint")
REACH = 200
ENTROPY = 3.5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of such digits are whole matches, so a run of 16 or more is a match that passes.
HEX = re.compile(r"[0-9a-f]{16,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
USER = re.compile(r"""(?<![A-Za-z0-9_])(?:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,64})""", re.ASCII | re.IGNORECASE)
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,30}://[^\s\"'<>]{3,}", re.ASCII)
#: What each weak kind needs beside it: any of the sets, whole.
NEEDS = {"secret": ({"identifier"}, {"endpoint", "user"}), "user": ({"secret", "endpoint"}, {"strong", "endpoint"}), "endpoint": ({"identifier", "secret"}, {"user", "strong"}, {"identifier", "strong"})}
ROLE = {"assign": "strong", "access": "identifier", "hex": "strong", "secret": "secret", "user": "user", "endpoint": "endpoint"}


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    for m in ASSIGN.finditer(text) if "=" in text or ":" in text else ():
        if m.end(2) - m.start(2) >= 12:
            out.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that aren't reported by themselves, none within a base span."""
    found: list[Span] = []
    if "AKIA" not in text and "://" not in text:
        return found  # every need holds an identifier or an endpoint
    for m in SECRET.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and entropy(s) >= ENTROPY:
            found.append(("secret", m.start(), m.end()))
    found += [("user", m.start(), m.end()) for m in USER.finditer(text)]
    if "://" in text:
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts, ends, top = [s for s, _ in taken], [], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    # An interval overlaps one before its end if the furthest end among those reaches past its start.
    return [f for f in found if not ((k := bisect_left(starts, f[2])) and ends[k - 1] > f[1])]


def linked(text: str, base: list[Span], weak: list[Span]) -> list[Span]:
    """Interval join of the parts within their scopes, by a sweep: at most REACH characters lie between
    the parts of one scope, and no blank line. Weak parts whose needs the scope meets are kept."""
    parts = sorted([*base, *weak], key=lambda x: (x[1], x[2]))
    kept, scope, end = [], [], -1

    def close() -> None:
        count = Counter(ROLE[k] for k, _, _ in scope)
        for part in scope:
            own = ROLE[part[0]]
            if part[0] in NEEDS and any(all(count[r] > (r == own) for r in need) for need in NEEDS[part[0]]):
                kept.append(part)

    for part in parts:
        if scope and (part[1] - end > REACH or "\n\n" in text[end : part[1]]):
            close()
            scope = []
            end = -1
        scope.append(part)
        end = max(end, part[2])
    close()
    return kept


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    return base, base + (linked(text, base, weak) if weak else [])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return span_rows(docs, lambda: scan, BASE, KINDS)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """documents with every span of a secret replaced, reported endpoints whole: user, path and query may
    hold a secret themselves. Other columns are kept, n_chars follows."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else replace_spans(t, scan(t)[1]))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
