"""Near copies: the links of ``simhash_dedup``, and those by the similarity of shingles that its radius misses,
candidates from bands of minhashes, each verified.

Two texts are near copies if their SimHash fingerprints are in one class of ``simhash_dedup`` or the sets of
their shingles of SHINGLE words (XXH64, seed 42) have a Jaccard similarity of at least SIMILARITY; groups are
the connected components of both kinds of links. Texts of one set are one node.

Search of similar sets: BANDS hashes of ROWS minima each stand for a node. Two nodes at the least similarity share a band
with probability 1 - (1 - 0.8 ** 5) ** 30, all but 7 in a million; two that share a line seldom do. Nodes
of one band are compared by their whole sets. A band that over BUCKET nodes share isn't expanded into
pairs: its nodes are first compared to CENTRES of them, the same for all, which joins most into one
component. Those of the band outside its largest component, its strays, are then compared to all its
nodes of other components, PART by PART sets a task. So two nodes that share a band are compared or
already in one component: what the bands find is whole. Strays times members is the cost of a crowded
band, and it is paid in comparisons, not in rows.

Defined cases: words are what stands between white space, A-Z lower-cased. A text of fewer words is one
shingle; null and wordless texts have none and are alike. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import simhash_dedup
from graphloom.llm.common import arrow_map, keep_rows, materialize, pick
from graphloom.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 30
ROWS = 5
BUCKET = 32
CENTRES = 4
PART = 128
PIECE = 1 << 10
_RANDOM = np.random.default_rng(42)
ODDS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of a text's shingles in rising order, each once."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def band_hashes(hashes: np.ndarray) -> list[int]:
    """One hash a band, of its ROWS minima."""
    import xxhash

    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), PIECE):
        np.minimum(least, ((hashes[at : at + PIECE] ^ MASKS[:, None]) * ODDS[:, None]).min(1), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), 42) for r in raw], np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - common
    return common / either if either else 1.0


def marks(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, th, node, bands): th a hash of the text, node of its set of shingles."""

    def run(batches):
        import xxhash

        for b in batches:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([band_hashes(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "th", "node", "bands"])

    return arrow_map(pick(docs, doc_id="doc_id", th=F.xxhash64("text"), text="text"), run, "doc_id long, th long, node long, bands array<bigint>")


def band_keys(nodes: DataFrame) -> DataFrame:
    """Distinct nodes (node, bands) -> (band, v, node, n), n how many nodes share the band, where over one."""
    keys = nodes.select("node", F.posexplode("bands").alias("band", "v"))
    return keys.join(keys.groupBy("band", "v").agg(F.count("*").alias("n")).where("n > 1"), ["band", "v"])


def candidates(keys: DataFrame) -> DataFrame:
    """Band keys -> pairs (a, b) to be compared, a < b: all of a band, or those with its centres."""
    few = keys.where(F.col("n") <= BUCKET).groupBy("band", "v").agg(F.collect_list("node").alias("members"))
    # At most BUCKET members stand in a list.
    near = few.select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b"))
    crowded = keys.where(F.col("n") > BUCKET)
    centres = crowded.groupBy("band", "v").agg(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(CENTRES)]).alias("centres"))
    dense = crowded.join(centres, ["band", "v"]).select(F.col("node").alias("a"), F.explode("centres").alias("b"))
    return near.where("a < b").union(dense.where("a <> b").select(F.least("a", "b"), F.greatest("a", "b"))).distinct()


def similar_between(left: list[np.ndarray], right: list[np.ndarray]) -> list[tuple[int, int]]:
    """Indices of the pairs of two lists of sets whose similarity is at least SIMILARITY."""
    sizes = np.array([len(x) for x in right], np.int64)
    flat, owner = np.concatenate([np.zeros(0, np.uint64), *right]), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for i, x in enumerate(left):
        lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        runs = hi - lo
        at = np.repeat(lo - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        common = np.bincount(owner[at], minlength=len(right))
        either = len(x) + sizes - common
        out += [(i, int(j)) for j in np.flatnonzero(common >= (SIMILARITY - 1e-12) * either)]
    return out


def stray_links(keys: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Crowded band keys, the components (node, root) so far and sets (node, shingles) -> edges (a, b) between
    each band's strays and its nodes of other components."""
    of = keys.join(found, "node", "left").select("band", "v", "node", F.coalesce("root", "node").alias("root"))
    of = materialize(of, "crowded")
    parts = of.groupBy("band", "v", "root").agg(F.count("*").alias("n"))
    split = parts.groupBy("band", "v").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    split = split.where(F.col("n") > F.col("most.n")).select("band", "v", F.col("most.root").alias("main"), F.ceil(F.col("n") / PART).cast("int").alias("of"), F.ceil((F.col("n") - F.col("most.n")) / PART).cast("int").alias("by"))
    member = of.join(split, ["band", "v"]).withColumn("h", F.xxhash64("node"))
    lots = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stray = member.where("root <> main").select("band", "v", F.pmod("h", "by").cast("int").alias("i"), lots("of").alias("j"), F.lit(True).alias("asks"), "node", "root")
    other = member.select("band", "v", lots("by").alias("i"), F.pmod("h", "of").cast("int").alias("j"), F.lit(False).alias("asks"), "node", "root")
    both = stray.union(other).join(sets, "node").select("band", "v", "i", "j", "asks", "node", "root", "shingles")

    def compared(part: pa.Table) -> pa.Table:
        sides = [part.filter(part.column("asks") if s else pa.compute.invert(part.column("asks"))) for s in (True, False)]
        node, root = ([s.column(c).to_numpy() for s in sides] for c in ("node", "root"))
        left, right = ([np.frombuffer(x, np.uint64) for x in s.column("shingles").to_pylist()] for s in sides)
        pairs = [(node[0][i], node[1][j]) for i, j in similar_between(left, right) if root[0][i] != root[1][j]]
        return pa.table([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.groupBy("band", "v", "i", "j").applyInArrow(compared, "a long, b long").distinct()


def fingerprint_links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Edges (a, b) from each node to the least one of its SimHash class."""
    classes = simhash_dedup.classes(docs).select("th", F.col("root").alias("class")).distinct()
    of = materialize(marked.select("th", "node").distinct().join(classes, "th").select("node", "class").distinct(), "fingerprinted")
    least = of.groupBy("class").agg(F.min("node").alias("b"))
    return of.join(least, "class").select(F.col("node").alias("a"), "b").where("a <> b")


def components(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a link: those of one SimHash class, and sets as similar as SIMILARITY
    that share a band."""
    keys = materialize(band_keys(marked.select("node", "bands").dropDuplicates(["node"])), "keys")
    pairs = materialize(candidates(keys), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    stands = marked.join(asked, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"))
    one = pick(docs, th=F.xxhash64("text"), text="text").join(stands, "th", "left_semi").dropDuplicates(["th"])

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["th", "shingles"])

    held = arrow_map(one.select("th", "text"), sets, "th long, shingles binary").join(stands, "th").select("node", "shingles")
    held = materialize(held, "sets")

    def verified(batches):
        for b in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array([similarity(x, y) >= SIMILARITY - 1e-12 for x, y in zip(left, right)], pa.bool_()))

    both = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    links = materialize(arrow_map(both.select("a", "b", "left", "right"), verified, "a long, b long"), "links")
    found = connected_components(links.union(fingerprint_links(docs, marked)))
    crowded = keys.where(F.col("n") > BUCKET).select("band", "v", "node")
    if crowded.isEmpty():
        return found
    # The second components begin with a star a component, not with all links again.
    more = materialize(stray_links(crowded, found, held), "strays")
    return connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each group, with its own columns: that of the least doc_id, null last; of rows
    with that doc_id the one whose text has the least hash."""
    none = F.lit(-(1 << 63))
    marked = materialize(marks(docs), "marks")
    found = components(docs, marked)
    rooted = marked.join(found, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", none).alias("key"), F.col("th"))).alias("x")
    kept = rooted.groupBy("root").agg(first).select("x.key", "x.th")
    return keep_rows(docs, kept, key=F.coalesce("doc_id", none), th=F.xxhash64("text"))
