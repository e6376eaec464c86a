"""Near-duplicates by SimHash, linked within a Hamming radius by the generalised pigeonhole principle.

Fingerprints: XXH64 (seed 42) of each shingle of words, repeats included; a bit is set if it is set in
over half of them. Two texts are linked if their fingerprints differ in at most ``radius`` bits, and
the classes are the connected components of all links.

Search, over distinct fingerprints: bits that go together over the corpus are put in one group, so
groups hold few values each or many; the groups' thresholds t_i (-1: not probed) need only add up to
radius - groups + 1 for every pair within the radius to agree within t_i on some group. A dynamic
programme gives the thresholds with the fewest estimated probes and candidates, from counts over the
whole corpus. Fingerprints that probe a common value are compared; a value that over BUCKET
fingerprints share isn't expanded into pairs: all who probe it list their neighbours at half the
radius, and two fingerprints are within the radius just when they share such a neighbour, which is
exact and grows with the members alone.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other. Repeated
rows keep a row each. Null doc_ids don't become a class's id unless a class has no other. An empty
table gives no row.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, keep_rows, materialize, pick
from graphloom.llm.components import connected_components

BITS = 64
SHINGLE = 3
RADIUS = 2
BUCKET = 32
MOST_GROUPS = 4
LANES = np.uint64(0x0101010101010101)
PIECE = 1 << 15


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < k:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : at + PIECE + k - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(k))))
        hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
        # Eight counters of a byte in one word: 255 shingles at a time.
        for shift in range(8):
            lanes = (hashes >> np.uint64(shift)) & LANES
            lanes = np.concatenate([lanes, np.zeros(-len(lanes) % 255, np.uint64)]).reshape(-1, 255).sum(1, dtype=np.uint64)
            set_in[shift::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """documents -> (doc_id, th, fp): th a hash of the text, fp as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "th", "fp"])

    return arrow_map(pick(docs, doc_id="doc_id", th=F.xxhash64("text"), text="text"), run, "doc_id long, th long, fp long")


def bit_statistics(fps: DataFrame) -> np.ndarray:
    """How often two bits are set together, over all fingerprints: BITS by BITS counts."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for b in batches:
            raw = b.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(total.astype(np.int64).tolist(), pa.list_(pa.int64()))], names=["i", "row"])

    sums = [F.sum(F.element_at("row", j + 1)).alias(f"c{j}") for j in range(BITS)]
    rows = arrow_map(fps.select("fp"), run, "i int, row array<bigint>").groupBy("i").agg(*sums).collect()
    out = np.zeros((BITS, BITS))
    for r in rows:
        out[r["i"]] = [r[f"c{j}"] for j in range(BITS)]
    return out


def correlated_groups(together: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Puts the bits into groups of equal size: each begins with the free bit that goes with the others
    most, and takes the free bits that go with its members most."""
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    free, out = list(range(BITS)), []
    for g in range(groups):
        size = len(free) // (groups - g)
        member = [max(free, key=lambda b: (close[b, free].sum(), -b))]
        free.remove(member[0])
        while len(member) < size:
            best = max(free, key=lambda b: (close[b, member].mean(), -b))
            member.append(best)
            free.remove(best)
        out.append(sorted(member))
    return out


def mask_of(bits: list[int]) -> int:
    """As a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def allocate(costs: list[list[float]], radius: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of least cost. costs[i][t + 1] is group i's cost at threshold t from -1 up; the
    thresholds add up to radius - groups + 1."""
    groups = len(costs)

    @lru_cache(None)
    def best(i: int, left: int) -> tuple[float, tuple[int, ...]]:
        if i == groups:
            return (0.0, ()) if left == 0 else (math.inf, ())
        options = []
        for t in range(-1, radius + 1):
            rest, chosen = best(i + 1, left - t)
            options.append((costs[i][t + 1] + rest, (t, *chosen)))
        return min(options)

    return best(0, radius - groups + 1)


def flips(width: int, t: int) -> int:
    return sum(math.comb(width, e) for e in range(t + 1))


def plan(fps: DataFrame, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed. For every number of groups the candidates at
    threshold 0 are counted over the whole corpus; at higher ones they are estimated from those."""
    together = bit_statistics(fps)
    options = {g: correlated_groups(together, n, g) for g in range(2, MOST_GROUPS + 1)}
    flat = [(g, i, mask_of(bits)) for g, groups in options.items() for i, bits in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, (_, _, m) in enumerate(flat)]))
    counts = fps.select(keys.alias("x")).select("x.k", "x.v").groupBy("k", "v").count()
    pairs = {r["k"]: float(r["s"]) for r in counts.groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("s")).collect()}
    p = np.diag(together) / max(n, 1)
    best = (math.inf, [])
    for g, groups in options.items():
        costs = []
        for i, bits in enumerate(groups):
            equal = pairs.get(next(k for k, (a, b, _) in enumerate(flat) if (a, b) == (g, i)), 0.0)
            # How much likelier than agreement a difference in a bit is, on average.
            odds = np.mean([2 * p[b] * (1 - p[b]) / max(1 - 2 * p[b] * (1 - p[b]), 1e-9) for b in bits])
            near = [equal + n * (n - 1) / 2.0 ** len(bits) * (t > 0) for t in range(radius + 1)]
            row = [0.0]
            for t in range(radius + 1):
                more = sum(math.comb(len(bits), e) * odds**e for e in range(t + 1))
                row.append(n * flips(len(bits), t) + near[t] * more)
            costs.append(row)
        cost, chosen = allocate(costs, radius)
        best = min(best, (cost, [(bits, t) for bits, t in zip(groups, chosen) if t >= 0]))
    return best[1]


def neighbours(value: Column, bits: list[int], t: int) -> Column:
    """All values within t flips among the bits, the value itself first."""
    masks = [[0]]
    for e in range(1, t + 1):
        masks.append(sorted({m ^ (1 << b) for m in masks[-1] for b in bits if not m >> b & 1}))
    signed = [m - (1 << 64) if m >> 63 else m for m in sum(masks, [])]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, groups: list[tuple[list[int], int]], radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) within the radius whose components are those of all
    pairs within the radius."""
    fp = F.col("fp")
    index = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), fp.bitwiseAND(F.lit(mask_of(b))).alias("v")) for i, (b, _) in enumerate(groups)]))
    stored = fps.select("fp", index.alias("x")).select("x.g", "x.v", "fp")
    probes = stored
    for i, (bits, t) in enumerate(groups):
        if t > 0:
            key = fp.bitwiseAND(F.lit(mask_of(bits)))
            more = fps.select(F.lit(i).alias("g"), F.explode(F.slice(neighbours(key, bits, t), 2, flips(len(bits), t))).alias("v"), "fp")
            probes = probes.union(more)
    sizes = stored.groupBy("g", "v").count()
    # Values that one fingerprint has, and none can be at a flip from, take no part.
    crowded = sizes.where(F.col("count") > BUCKET).select("g", "v")
    few = sizes.where(F.col("count") <= BUCKET).where((F.col("count") > 1) | F.col("g").isin([i for i, (_, t) in enumerate(groups) if t > 0])).select("g", "v")
    held = stored.join(few, ["g", "v"], "left_semi").groupBy("g", "v").agg(F.collect_list("fp").alias("members"))
    # At most BUCKET members stand in a list.
    met = probes.join(held, ["g", "v"]).select("fp", F.explode("members").alias("other"))
    near = met.where((F.col("fp") != F.col("other")) & (F.bit_count(fp.bitwiseXOR(F.col("other"))) <= radius)).select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
    dense = probes.join(crowded, ["g", "v"], "left_semi").select("fp").distinct()
    # Within radius of each other: a neighbour in common at half the radius, and at one flip more if it is odd.
    around = dense.select("fp", F.explode(neighbours(fp, list(range(BITS)), radius // 2)).alias("z"))
    if radius % 2:
        raise ValueError("the radius must be even")
    least = around.groupBy("z").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("z", "b")
    shared = around.join(least, "z").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.union(shared).distinct()


def classes(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """documents -> (doc_id, th, fp, root, component_id), a row for each row. root is the least fingerprint
    of the class, component_id its least doc_id."""
    marked = materialize(fingerprints(docs, k), "fingerprints")
    counted = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    fps = counted.select("fp")
    n = fps.count()
    edges = links(fps, plan(fps, n, radius), radius) if n > 1 else fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    found = connected_components(edges)
    rooted = counted.join(found, counted["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(of, "fp").select("doc_id", "th", "fp", "root", "component_id")


def dedup_classes(docs: DataFrame) -> DataFrame:
    """The classes with fingerprints as 16 hexadecimal digits."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, with its own columns: that of the least doc_id, null last; of rows
    with that doc_id the one whose text has the least hash."""
    none = F.lit(-(1 << 63))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", none).alias("key"), F.col("th"))).alias("x")
    kept = classes(docs).groupBy("root").agg(first).select("x.key", "x.th")
    return keep_rows(docs, kept, key=F.coalesce("doc_id", none), th=F.xxhash64("text"))
