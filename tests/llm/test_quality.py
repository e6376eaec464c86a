import random
import zlib

import pytest

from graphloom.llm import compress_quality as q


def made(n, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        text = " ".join(r.choice(words) for _ in range(r.randint(60, 200)))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    return rows, labels


def test_learns_and_scores(spark, docs_of):
    rows, labels = made(400)
    docs = docs_of(rows)
    model = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in q.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out == (i in held) for i, _ in rows)
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    odd = q.score(docs_of([(1, None), (2, ""), (None, "x"), (2, "")]), model).collect()
    assert len(odd) == 4 and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    kept = {r.doc_id for r in q.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 1, 0), (2, None, 0)]])
def test_without_both_classes(spark, docs_of, labels):
    docs = docs_of([(1, "a"), (2, None)])
    model = q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r.predicted for r in q.score(docs, model).collect()] == [1, 1]
    assert q.keep_good(docs, model).count() == 2


def test_labels_do_not_enter_the_score(spark, docs_of):
    """Rows of the held-out fold change nothing in the model."""
    rows, labels = made(200)
    docs, schema = docs_of(rows), "doc_id long, quality int, toxic int"
    turned = [(i, 1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v, t) for i, v, t in labels]
    assert q.fit(docs, spark.createDataFrame(labels, schema)) == q.fit(docs, spark.createDataFrame(turned, schema))


def test_sizes_by_brute_force():
    """Against blocks compressed one by one, on texts of every kind of length."""
    import zstandard

    rows, labels = made(300)
    parts = [[t.encode()[:2048] for (_, t), (_, k, _) in zip(rows, labels) if k == want] for want in (1, 0)]
    good, bad = (q.dictionary(p) for p in parts)
    sizes, r = q.Sizes(good, bad), random.Random(4)
    assert len(good) > 1000 and good != bad

    def one(data, block):
        own = zstandard.ZstdCompressionDict(data)
        own.precompute_compress(level=q.LEVEL)
        plain = zstandard.ZstdCompressor(level=q.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(plain.compress(block))

    for text in [None, "", "a", "é" * 64, "x" * 127, "x" * 128, "word " * 2000, *(t for _, t in r.sample(rows, 20)), " ".join(t for _, t in rows)]:
        raw, want, last = (text or "").encode(), [], None
        for block in q.BLOCKS:
            cut = [raw[i : i + block] for i in range(0, len(raw), block)]
            now = [sum(one(d, c) for c in cut) for d in (good, bad)]
            want.append((now[1] - now[0]) / max(*now, 1))
            want += [(a - b) / max(a, 1) for a, b in zip(last, now)] if last else []
            last = now
        assert sizes(text) == pytest.approx(want + [x * x for x in want])


def test_slices_are_even_and_bounded(spark):
    texts = ["", "short é", "ab" * 1024, "x" * 5000, "".join(chr(97 + i // 5000) for i in range(100_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").where("t <> ''")
    got = {r.i: [bytes(p) for p in r.p] for r in df.select("i", q.slices(q.F.col("t")).alias("p")).collect()}
    assert got[1] == ["short é".encode()] and got[2] == [b"ab" * 1024]
    assert [len(p) for p in got[3]] == [2048] * 3 and [len(p) for p in got[4]] == [2048] * 8
    assert got[4][0][:1] == b"a" and got[4][-1][-1:] == texts[4][-1].encode()


def test_calibration_is_the_least_loss():
    """The gradient of the ridge-penalised likelihood is zero, and no nearby weights do better."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=300) > 0.3).astype(float)
    w = q.logistic(x, y)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (q.RIDGE * v[:-1] @ v[:-1] + 1e-6 * v[-1] ** 2)

    assert all(loss(w) <= loss(w + rng.normal(scale=s, size=5)) for s in (1e-3, 1e-2, 1.0) for _ in range(50))


def test_repeated_and_very_long_rows(spark, docs_of):
    """A doc_id that comes often with long texts is learned from once."""
    rows, labels = made(200)
    long = [(1, "long text " * 40_000 + str(i)) for i in range(30)]
    schema = "doc_id long, quality int, toxic int"
    model = q.fit(docs_of(rows + long), spark.createDataFrame(labels, schema))
    assert model.weights and len(model.good) <= q.DICTIONARY_BYTES
    assert q.score(docs_of(rows + long), model).count() == 230
