"""URL filter with redirect equivalence: host and path rules, whose block decisions reach the aliases.

Urls are the nodes of a graph; redirects and canonical links are its edges. A url that a rule fits
takes the rule's verdict. Any other url is blocked if its connected component holds a url blocked by
a rule and none allowed by a rule: an explicit allow comes first, on the url itself and for its
aliases. What is left is allowed. DataFrame operations only; nothing runs in Python.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule, is no node
and is allowed. Null html gives no edge. Repeated rows are judged each. An empty table gives none.
Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, pick
from graphloom.llm.components import connected_components

Rule = tuple[str, str]
#: Rules are part of the plan as one expression each; more than this belong into a table join.
MOST_RULES = 500

AUTHORITY = r"(?s)^.*?://([^/?#]*)"
REL = r"""(?is)[\s"'/]rel\s*=\s*["']?([^"'>]*)"""
HREF = r"""(?is)[\s"'/]href\s*=\s*["']?\s*([^"'>\s]*)"""
EQUIV = r"""(?is)[\s"'/]http-equiv\s*=\s*["']?\s*refresh["'\s/>]"""
REFRESH = r"""(?is)[\s"'/]content\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?\s*([^"'>\s]*)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY + r"([^?#]*)", 2), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as a node: without its fragment, scheme and host lower-cased; null if it has no ``://``."""
    url = F.trim(url)
    site = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0))
    return F.when(site != "", F.concat(site, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null if none fits. Of equally long rules the
    one with the longer host wins, then an allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in reversed(ordered):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def absolute(link: Column, base: Column) -> Column:
    """A link as a url: with its own scheme, ``//host``, ``/path``, or beside the base's last slash."""
    start = F.regexp_extract(base, r"(?s)^.*?:(?=//)", 0)
    site = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(?:[^?#]*/)?", 0)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(start, link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, F.when(folder.endswith("/") & (folder != F.concat(start, F.lit("//"))), "").otherwise("/"), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and the url of its canonical link or its refresh redirect, as nodes."""
    named = pick(pages, url="url", html="html").where(F.col("html").rlike("(?i)canonical|refresh"))
    tags = named.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag"))
    tag, link = F.col("tag"), F.col("link")
    canonical = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(F.regexp_extract(tag, REL, 1)), r"\s+"), "canonical")
    refresh = tag.rlike("(?i)^<meta") & tag.rlike(EQUIV)
    found = F.when(canonical, F.regexp_extract(tag, HREF, 1)).when(refresh, F.regexp_extract(tag, REFRESH, 1))
    # Written down here: the expressions below would else be put into each other, past what compiles.
    links = materialize(tags.select("url", found.alias("link")).where("link <> ''"), "links")
    links = links.select("url", absolute(F.replace(link, F.lit("&amp;"), F.lit("&")), F.col("url")).alias("target"))
    return links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, host, path, rule, verdict), a row for each row.

    ``redirects`` (from_url, to_url) may add edges, for instance from a crawl's log.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    found = connected_components(edges)
    node = F.col("node")
    _, said = fitting_rule(host_of(node), path_of(node), rules)
    parts = found.withColumn("said", said)
    blocked = parts.groupBy("root").agg(F.max(F.col("said") == "block").alias("block"), F.max(F.col("said") == "allow").alias("allow"))
    blocked = blocked.where("block and not coalesce(allow, false)").select("root")
    blocked = parts.join(blocked, "root", "left_semi").select("node", F.lit("block").alias("passed_on"))

    url = F.col("url")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = pick(pages, page_id="page_id", url="url").select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    # Urls that are no node have a key each that no node has, so they don't meet in one task.
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string"))
    judged = judged.withColumns({"rule": rule, "own": verdict, "node": F.coalesce("node", alone)})
    return judged.join(blocked, "node", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("own", "passed_on", F.lit("allow")).alias("verdict"))
