"""Quality classifier by compression: which dictionary, of good or of bad text, makes a text smaller.

zstandard trains one dictionary on slices of good and another on slices of bad labelled texts. A text goes
through both compressors, whole, in blocks of each size in BLOCKS, so that the dictionary weighs in every
block. The inputs of a score are normalised differences of compressed sizes alone: between the dictionaries
at each block size, over the larger size, and between one block size and the next under each dictionary,
over the first (a text that repeats itself gains most). A logistic regression over them and their squares,
on other labelled rows than those in the dictionaries, calibrates them into a probability.

Learning uses a bounded sample of the labelled rows: DICTIONARY_ROWS a class for the dictionaries and
CALIBRATION_ROWS a class for the calibration, the least by hash of doc_id.

Defined cases: a null text counts as empty; empty texts get a score too. doc_ids with several labels
count by their mean, one half as good; labels that are null are left out, as are null doc_ids. Without
rows of both classes every score is the smoothed share of good labels. Where a class has too little text
to train on, its slices themselves are its dictionary. Repeated rows are scored each, and learned from once
an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BATCH_ROWS, arrow_map, pick

FOLDS = 5
DICTIONARY_ROWS = 200
CALIBRATION_ROWS = 1500
DICTIONARY_BYTES = 65536
BLOCKS = (128, 512, 2048)
#: Of a text in a dictionary, at most so many slices of the largest block, evenly from all of it.
SLICES = 8
LEVEL = 3
RIDGE = 1.0
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    share: float


class Sizes:
    """Compressed sizes of texts under both dictionaries, as normalised differences and their squares."""

    def __init__(self, good: bytes, bad: bytes):
        self.to = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(data: bytes):
        own = zstandard.ZstdCompressionDict(data)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def sizes(self, raw: bytes, block: int) -> list[int]:
        view = memoryview(raw)
        parts = [view[i : i + block] for i in range(0, len(raw), block)]
        return [sum(map(len, map(compress, parts))) for compress in self.to]

    def __call__(self, text: str | None) -> list[float]:
        raw, out, last = (text or "").encode(), [], None
        for block in BLOCKS:
            good, bad = now = self.sizes(raw, block)
            out.append((bad - good) / max(good, bad, 1))
            if last:
                out += [(a - b) / max(a, 1) for a, b in zip(last, now)]
            last = now
        return out + [x * x for x in out]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, an eighth of the samples at most; the samples themselves where zstandard can't
    train on so few."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def slices(text: Column) -> Column:
    """Up to SLICES slices of a text's bytes, evenly from all of it: the whole text if it is that short."""
    raw, block = F.encode(text, "UTF-8"), BLOCKS[-1]
    n = F.octet_length(text)
    count = F.least(F.lit(SLICES), F.ceil(n / block).cast("int"))
    step = (n - block) / F.greatest(count - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(raw, F.floor(F.greatest(step, F.lit(0)) * i).cast("int") + 1, F.lit(block)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the last for the constant, by damped Newton steps with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([RIDGE] * (x.shape[1] - 1) + [1e-6])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ ridge @ w

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 0.5 * (1 + np.tanh(x @ w / 2))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        rate = 1.0
        while rate > 1e-6 and loss(w + rate * step) > loss(w):
            rate /= 2
        w = w + rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return w


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from labelled documents outside the held-out fold."""
    marks = pick(labels, doc_id="doc_id", label=label).where("doc_id is not null and label is not null")
    marks = marks.where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(4))
    most = DICTIONARY_ROWS + CALIBRATION_ROWS
    kept = [[tuple(r) for r in marks.where(F.col("label") == k).orderBy(order, "doc_id").limit(most).collect()] for k in (0, 1)]
    n = [len(k) for k in kept]
    share = (n[1] + 1) / (sum(n) + 2)
    # As many rows as there are classes times ``most``, so a bounded broadcast.
    roles = [(i, k, int(at < min(DICTIONARY_ROWS, len(rows) // 2))) for k, rows in enumerate(kept) for at, (i, _) in enumerate(rows)]
    nothing = Model(b"", b"", (), (), (), share)
    if not all(n):
        return nothing
    ids = docs.sparkSession.createDataFrame(roles, "doc_id long, label int, in_dictionary int")
    chosen = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(ids), "doc_id")
    chosen = chosen.groupBy("doc_id", "label", "in_dictionary").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    built = chosen.where("in_dictionary = 1 and text <> ''").select("label", "doc_id", slices(F.col("text")).alias("parts")).collect()
    parts = [[bytes(p) for r in sorted(built, key=lambda r: r["doc_id"]) if r["label"] == k for p in r["parts"]] for k in (0, 1)]
    good, bad = dictionary(parts[1]), dictionary(parts[0])
    if len(good) < 8 or len(bad) < 8:
        return nothing

    def run(batches):
        sizes = Sizes(good, bad)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sizes(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rest = arrow_map(chosen.where("in_dictionary = 0").select("doc_id", "label", "text"), run, "doc_id long, label int, x array<double>")
    got = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in rest.collect())
    if len({k for _, k, _ in got}) < 2:
        return nothing
    x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, tuple(mean), tuple(scale), tuple(logistic((x - mean) / scale, y)), share)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), a row for each row."""
    named = pick(docs, doc_id="doc_id", text="text")
    named = named.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    if not model.weights:
        fixed = F.lit(model.share)
        return named.select("doc_id", "held_out", fixed.alias("score"), (fixed >= threshold).cast("int").alias("predicted"))

    def run(batches):
        sizes = Sizes(model.good, model.bad)
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for b in batches:
            x = (np.array([sizes(t) for t in b.column(2).to_pylist()]).reshape(-1, len(mean)) - mean) / scale
            p = 0.5 * (1 + np.tanh((x @ w[:-1] + w[-1]) / 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return arrow_map(named, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their own columns."""
    if not model.weights:
        return docs.where(F.lit(model.share >= threshold))
    mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)

    @F.pandas_udf("boolean")
    def good(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            sizes = Sizes(model.good, model.bad)
            x = (np.array([sizes(t) for t in series]).reshape(-1, len(mean)) - mean) / scale
            yield pd.Series(0.5 * (1 + np.tanh((x @ w[:-1] + w[-1]) / 2)) >= threshold)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.where(good(F.col("text")))
