"""The pipeline's stages in order, on a small folder of tables."""

import random

import corpus_pipeline
from graphloom.llm.common import materialize


def write(spark, folder):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item, rows, labels = text(40), [], []
    for i in range(150):
        good = i % 4 != 0
        t = text(r.randint(60, 160))
        rows.append((i, t if good else t.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    rows[1] = (1, rows[1][1] + " " + item)
    rows[2] = (2, rows[2][1] + " token = 0123456789abcdef0123 end")
    rows += [(200, rows[5][1]), (201, rows[5][1] + " more"), (202, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), dict((i, q) for i, q, _ in labels)


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts, quality = write(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminated", "secrets", "packed"]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        seen[name] = docs
        if name != "packed":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    bad = {i for i, q in quality.items() if not q}
    assert len(ids["quality"] & bad) <= 2 and len({i for i, q in quality.items() if q} - ids["quality"]) <= 2
    assert {5} <= ids["near_duplicates"] and not {200, 201} & ids["near_duplicates"] - ({201} if 201 not in ids["quality"] else set())
    assert 1 not in ids["decontaminated"] and ids["near_duplicates"] - ids["decontaminated"] == {1}
    two = seen["secrets"].where("doc_id = 2").first()
    assert "0123456789abcdef" not in two.text and two.n_chars == len(two.text)
    assert ids["packed"] == ids["secrets"] == ids["decontaminated"]
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.select("doc_id", "piece", "length").collect())) == sorted(map(str, seen["packed"].select("doc_id", "piece", "length").collect()))
