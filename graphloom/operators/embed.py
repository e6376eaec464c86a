"""Vectors of nodes and questions without a model: words of a text, hashed with a sign."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import parted

DIMS = 64


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(parted(text, " ")), "[^a-z0-9]+"), lambda w: w != "")


def embedded(text: Column, dims: int = DIMS) -> Column:
    """An array of ``dims`` sums: each word adds 1 or -1 at a place, both from its MD5."""

    @F.arrow_udf("array<double>")
    def sums(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        # Each word is hashed once a batch.
        hashed = [hashlib.md5(w.encode()).hexdigest() for w in coded.dictionary.to_pylist()]
        place = np.array([int(h[:4], 16) % dims for h in hashed], np.int64)
        sign = np.array([1.0 if h[4] < "8" else -1.0 for h in hashed])
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        out = np.bincount(owner * dims + place[which], sign[which], len(words) * dims) if len(which) else np.zeros(len(words) * dims)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dims, pa.int32()), pa.array(out.astype(np.float64)))

    return sums(tokens(text))


def embed_nodes(nodes: DataFrame, dims: int = DIMS) -> DataFrame:
    """nodes -> (id, embedding) of name, file and type; a text without a word has no vector."""
    said = F.concat_ws(" ", "name", "file", "type")
    return nodes.where(F.size(tokens(said)) > 0).select("id", embedded(said, dims).alias("embedding"))


def embed_question(nodes: DataFrame, question: str, dims: int = DIMS) -> DataFrame:
    """One row (embedding)."""
    return nodes.sparkSession.range(1).select(embedded(F.lit(question), dims).alias("embedding"))
