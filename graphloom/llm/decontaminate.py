"""Benchmark decontamination: windows of an item's size, matched by SimHash and verified exactly.

Texts become lower-case words (runs of letters and digits) and shingles of SHINGLE words. A window of a
document has as many shingles as an item. Its fingerprint is taken over those of its shingles that some
item of that size has: others count with weight zero. Fingerprints are cut into BLOCKS blocks; two
within RADIUS bits differ in at most RADIUS // BLOCKS bits of some block, so an index of the items by
every such value of every block meets all of them, and of two fingerprints that have nothing in common
one pair in 23. Each pair met within the radius is verified by the similarity of shingles weighted by
their counts: the sum of the smaller counts over the sum of the larger ones, at least SIMILARITY. At that
very similarity, with shingles missing at random, 0.99 (9 or 10 shingles) to 0.9998 of the pairs are
within the radius; nearly equal ones all are.

Windows without loss: two texts that share no shingle have similarity zero, and moving a window on to
its next shared shingle takes none away. So only windows that begin with an item's shingle and hold
enough of them are built. Windows of equal shingles are compared once, so a passage that a third of the
documents hold is one window until its documents are named. Joins with the benchmark broadcast it while
it is under MOST_BYTES, by its count of rows, and shuffle by key beyond. DataFrame operations only;
nothing runs in Python.

Defined cases: null and empty texts have no shingle and match nothing; items of under SHINGLE words
are too short to be evidence and match nothing; a document shorter than an item is one window. Rows
alike in doc_id and text count once. An empty table on either side gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, pick

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS = 4
MOST_BYTES = 64 << 20
#: Bytes of a row in a broadcast table, as measured.
ROW_BYTES = 150

#: Counters of 22 bits, three in a long: bits k, k + 22 and k + 44. They hold the shingles of an item or a
#: window, under 4 million.
LANE = 22
LANES = sum(1 << at for at in range(0, 64, LANE) if at < 64)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(rows: DataFrame) -> DataFrame:
    """Rows with a column w of words -> their other columns, n_shingles, and pos and h of each shingle of
    SHINGLE words. The words of a shingle are read from the array beside the exploded first one, so no
    lambda runs per word."""
    keep = [c for c in rows.columns if c != "w"]
    n = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0))
    each = rows.select(*keep, n.alias("n_shingles"), "w", F.posexplode("w").alias("pos", "word")).where(F.col("pos") < F.col("n_shingles"))
    return each.select(*keep, "n_shingles", "pos", F.xxhash64("word", *[F.get("w", F.col("pos") + k) for k in range(1, SHINGLE)]).alias("h"))


def lane_sums(h: Column) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"lane{k}") for k in range(LANE)]


def fingerprint(total: Column) -> Column:
    """The bits set in over half of ``total`` shingles, from their lane sums."""
    out = F.lit(0).cast("long")
    for b in range(64):
        k, at = b % LANE, b - b % LANE
        count = F.shiftrightunsigned(F.col(f"lane{k}"), at).bitwiseAND(F.lit((1 << LANE) - 1))
        bit = (1 << b) - (1 << 64 if b == 63 else 0)
        out = out.bitwiseOR(F.when(count * 2 > total, F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return out


def blocks() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    ends = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def block_of(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def flips(width: int, most: int) -> list[int]:
    masks = {0}
    for _ in range(most):
        masks |= {m ^ (1 << b) for m in masks for b in range(width)}
    return sorted(masks)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only while it is small by count."""
    return F.broadcast(df) if rows * ROW_BYTES <= MOST_BYTES else df


def near_items(prints: DataFrame, fps: DataFrame, n_items: int) -> DataFrame:
    """prints (item, n, item_fp), fps (n, fp) -> fps beside each item of their size within RADIUS bits."""
    key = lambda i, value: (F.col("n").cast("long") * BLOCKS + i) * (1 << (64 // BLOCKS + 1)) + value

    def around(i: int, a: int, w: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in flips(w, RADIUS // BLOCKS)])
        return F.transform(masks, lambda m: key(i, block_of(F.col("item_fp"), a, w).bitwiseXOR(m)))

    near = F.concat(*[around(i, a, w) for i, (a, w) in enumerate(blocks())])
    index = prints.select("item", "item_fp", F.col("n").alias("own_n"), F.explode(near).alias("at"))
    probes = fps.select("n", "fp", F.explode(F.array(*[key(i, block_of(F.col("fp"), a, w)) for i, (a, w) in enumerate(blocks())])).alias("at"))
    met = probes.join(sized(index, n_items * sum(len(flips(w, RADIUS // BLOCKS)) for _, w in blocks())), "at")
    within = (F.col("n") == F.col("own_n")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return met.where(within).select("n", "fp", "item").distinct()


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents (doc_id, text), benchmark (item_id, text) -> a row for each document and item that it
    holds: doc_id, item_id, similarity and first_word of its best window, n_words of the item."""
    probe = pick(items, item_id="item_id", text="text").distinct()
    probe = shingles(probe.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(F.col("text")).alias("w")))
    probe = materialize(probe.groupBy("item_id", "item", F.col("n_shingles").alias("n"), "h").agg(F.count("*").alias("c")), "items")
    rows = probe.count()
    prints = probe.select("item", "n", F.explode(F.array_repeat("h", F.col("c").cast("int"))).alias("h"))
    prints = prints.groupBy("item", "n").agg(*lane_sums(F.col("h"))).select("item", "n", fingerprint(F.col("n")).alias("item_fp"))
    n_items = probe.select("item").distinct().count()

    texts = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    at = shingles(texts).withColumnRenamed("n_shingles", "n_doc")
    shared = at.join(sized(probe.select("h", "n").distinct(), rows), "h").select("doc_id", "th", "n_doc", "n", "pos", "h")
    shared = shared.dropDuplicates(["doc_id", "th", "n", "pos"])

    # Positions over n, so that one frame spans a window of every size.
    frame = "partition by doc_id, th, n order by pos / cast(n as double) range between current row and 0.999999999D following"
    room = F.least("n", F.col("n_doc") - F.col("pos"))
    need = (room + F.col("n")) * (similarity / (1 + similarity)) - 1e-9
    windows = shared.select("doc_id", "th", "n", "pos", room.alias("size"), need.alias("need"), F.expr(f"collect_list(h) over ({frame})").alias("hs"))
    same = F.struct(F.xxhash64("n", "size", "hs").alias("a"), F.xxhash64(F.lit(1), "hs", "n").alias("b"))
    windows = materialize(windows.where(F.size("hs") >= F.col("need")).select("doc_id", "n", "pos", "size", same.alias("same"), "hs"), "windows")

    # Of windows with equal shingles one is compared.
    once = materialize(windows.select("same", "n", "size", "hs").dropDuplicates(["same"]), "distinct")
    printed = once.select("same", "n", F.explode("hs").alias("h")).groupBy("same", "n").agg(F.count("*").alias("taken"), *lane_sums(F.col("h")))
    printed = printed.select("same", "n", fingerprint(F.col("taken")).alias("fp"))
    met = printed.join(near_items(prints, printed.select("n", "fp").distinct(), n_items), ["n", "fp"]).select("same", "item")
    held = once.join(met, "same").select("same", "n", "size", "item", F.explode("hs").alias("h"))
    held = held.groupBy("same", "n", "size", "item", "h").agg(F.count("*").alias("d"))
    weights = sized(probe.select("item", "item_id", "h", "c"), rows)
    common = held.join(weights, ["item", "h"]).groupBy("same", "n", "size", "item", "item_id").agg(F.sum(F.least("d", "c")).alias("m"))
    ratio = F.col("m") / (F.col("size") + F.col("n") - F.col("m"))
    scored = common.where(ratio >= similarity - 1e-12).select("same", "item_id", F.round(ratio, 6).alias("similarity"))
    found = windows.select("doc_id", "same", "n", "pos").join(scored, "same")
    best = F.min_by(F.struct("similarity", F.col("pos").cast("long").alias("first_word"), (F.col("n") + SHINGLE - 1).cast("long").alias("n_words")), F.struct(-F.col("similarity"), F.col("pos"), F.col("n")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents without those that hold an item. Rows without doc_id are kept."""
    found = matches(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def clean_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """documents without the rows whose own text holds an item, whatever their doc_id: null, or one that
    other texts have too."""
    found = matches(pick(docs, doc_id=F.xxhash64("text"), text="text"), items).select(F.col("doc_id").alias("held_by")).distinct()
    return docs.join(found, F.xxhash64("text") == F.col("held_by"), "left_anti").select(*docs.columns)
