"""Token ids in a binary format of shuffled planes, written in ascending doc_id order and read back.

A chunk holds the ids of whole documents, at least CHUNK_IDS of them but for a shard's last. Inside,
blocks of a fixed number of ids are transposed into byte planes (or bit planes); each plane is
compressed by zstandard, planes of zeros take no bytes, and an index gives each block's count of ids
and its planes' lengths, so a block can be read on its own.

A chunk is a row of a Parquet data set in the shared folder, beside the ids and lengths of its
documents and the count of ids before it in its shard: Spark's committed writes survive a lost
executor. Shards are ranges of doc_id, in order.

Defined cases: a null text counts as empty and has the end id alone. Null doc_ids come first. Repeated
doc_ids stand side by side, ordered by text. An empty table gives no chunk.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_map, new_path, pick

MAGIC = b"GLBP1"
HEAD = struct.Struct("<5sBIQI")
BLOCK_IDS = 16384
CHUNK_IDS = 65536
LEVEL = 3

CHUNKS = "shard int, chunk int, ids_before long, n_ids long, doc_ids array<bigint>, n_tokens array<bigint>, data binary"


class PlaneError(ValueError):
    pass


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    if bits:
        wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(p, bitorder="little").tobytes() if p.any() else b"" for p in np.ascontiguousarray(wide.T)]
    return [p.tobytes() if p.any() else b"" for p in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    width = -(-n // 8) if bits else n
    rows = [np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes]
    if any(len(r) != width for r in rows):
        raise PlaneError("a plane has the wrong length")
    if bits:
        flat = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
        return np.packbits(flat, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(rows, axis=1)).reshape(-1).view("<u4")


def write_chunk(ids: np.ndarray, bits: bool = False, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """Ids as one chunk: head, index of the blocks, compressed planes."""
    compress = zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [compress(p) if p else b"" for p in to_planes(part, bits)]
        index.append(struct.pack(f"<I{len(planes)}I", len(part), *map(len, planes)))
        body += planes
    return HEAD.pack(MAGIC, 32 if bits else 4, block, len(ids), len(index)) + b"".join(index) + b"".join(body)


def chunk_index(data: bytes) -> list[tuple[int, int, list[int]]]:
    """(count of ids, place of the first plane, lengths of the planes) of each block."""
    mark, planes, _, n, blocks = HEAD.unpack_from(data)
    if mark != MAGIC or planes not in (4, 32):
        raise PlaneError("not a chunk")
    one = struct.Struct(f"<I{planes}I")
    at, found = HEAD.size + blocks * one.size, []
    for k in range(blocks):
        count, *sizes = one.unpack_from(data, HEAD.size + k * one.size)
        found.append((count, at, sizes))
        at += sum(sizes)
    if at != len(data) or sum(f[0] for f in found) != n:
        raise PlaneError("a chunk is cut off")
    return found


def read_block(data: bytes, entry: tuple[int, int, list[int]]) -> np.ndarray:
    n, at, sizes = entry
    expand, planes = zstandard.ZstdDecompressor().decompress, []
    for size in sizes:
        planes.append(expand(data[at : at + size]) if size else b"")
        at += size
    return from_planes(planes, n, len(sizes) == 32)


def read_chunk(data: bytes) -> np.ndarray:
    parts = [read_block(data, e) for e in chunk_index(data)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, kind: str = "byte", bits: bool = False) -> None:
    """documents (doc_id, text) -> the data set at path, in ascending doc_id order. Ranges go by doc_id and
    the text's beginning, so texts that share a doc_id aren't bound to one task."""

    def run(batches):
        from pyspark import TaskContext

        from graphloom.llm.tokens import encoder

        encode = encoder(tokenizer, kind).encode
        end = np.array([end_id], "<u4").tobytes()
        shard, chunk, before = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, sizes, held = [], [], [], 0

        def full():
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = [shard], [chunk], [before], [len(flat)], [doc_ids], [sizes], [write_chunk(flat, bits)]
            types = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            names = ["shard", "chunk", "ids_before", "n_ids", "doc_ids", "n_tokens", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names), len(flat)

        for b in batches:
            for doc_id, got in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()])):
                ids += [got, end]
                doc_ids.append(doc_id)
                sizes.append(len(got) // 4 + 1)
                held += sizes[-1]
                if held >= CHUNK_IDS:
                    out, n = full()
                    yield out
                    chunk, before = chunk + 1, before + n
                    ids, doc_ids, sizes, held = [], [], [], 0
        if doc_ids:
            yield full()[0]

    ordered = pick(docs, doc_id="doc_id", text="text").repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, run, CHUNKS).write.option("compression", "uncompressed").parquet(path)


READ = "shard int, doc_id long, in_shard long, n_tokens long, ids_crc32 long"


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """The data set at path -> (doc_id, start, n_tokens, ids_crc32), and the ids if asked for."""

    def run(batches):
        for b in batches:
            shard, _, before, _, doc_ids, sizes, data = (c.to_pylist() for c in b.columns)
            for k in range(b.num_rows):
                ids = read_chunk(data[k])
                ends = np.cumsum(sizes[k])
                starts = ends - sizes[k]
                if ends[-1] != len(ids):
                    raise PlaneError("the lengths don't add up to the ids")
                flat = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array([shard[k]] * len(starts), pa.int32()), pa.array(doc_ids[k], pa.int64()), pa.array(starts + before[k], pa.int64()), pa.array(sizes[k], pa.int64()), pa.array(crcs, pa.int64())]
                names = ["shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[s:e].astype(np.int64) for s, e in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    chunks = spark.read.schema(CHUNKS).parquet(path)
    docs = arrow_map(chunks, run, READ + (", ids array<bigint>" if with_ids else ""))
    # A row a shard, so as many as the write had partitions.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    out = docs.join(F.broadcast(shards), "shard")
    return out.select("doc_id", (F.col("first") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents to a fresh data set and reads them from there."""
    spark = docs.sparkSession
    path = new_path(spark, "planes")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path)
