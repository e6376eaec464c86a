"""SimHash classes, decontamination and passages against brute force."""

import random
import time

import numpy as np
import pytest
import xxhash

from graphloom.llm import decontaminate, near_copies, passages, simhash_dedup


def words(r, n):
    return [r.choice(["ka", "lo", "mi", "nu", "pe"]) + r.choice(["ra", "se", "ti", "vo"]) + r.choice(["x", "y", "z", "q", ""]) for _ in range(n)]


def plain_fingerprint(text):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows):
    fps, root = [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("bucket", [32, 1])
def test_classes(spark, docs_of, monkeypatch, bucket):
    """Also with buckets so small that all links go the way of common neighbours."""
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    r = random.Random(4)
    rows = []
    for i in range(40):
        w = words(r, r.choice([1, 2, 3, 30, 200]))
        rows.append((3 * i, " ".join(w)))
        if i % 3 == 0:
            w[r.randrange(len(w))] = "changed"
            rows.append((3 * i + 1, " ".join(w).upper()))
    rows += [(500, None), (501, ""), (502, " \t"), (None, "one two three four"), (0, rows[0][1]), (503, "Éa b c d"), (504, "v " * 70000)]
    got = simhash_dedup.dedup_classes(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_classes(rows), key=str)
    assert simhash_dedup.dedup_classes(docs_of([])).count() == 0
    kept = simhash_dedup.keep_first(docs_of(rows)).select("doc_id").collect()
    assert len(kept) == len({c[2] for c in plain_classes(rows)})
    own = docs_of(rows).selectExpr("doc_id", "text", "7 as key", "'own' as th", "1 as row", "'x' as `a.b`")
    for keep in (simhash_dedup.keep_first, near_copies.keep_first):
        left = keep(own)
        assert left.columns == own.columns and {(r.key, r.th, r.row, r["a.b"]) for r in left.collect()} == {(7, "own", 1, "x")}


def plain_firsts(rows):
    """The least doc_id of each group of texts whose sets of five-word shingles have a similarity of 0.8."""

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if len(sets[i] & sets[j]) >= 0.8 * either - 1e-12:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


@pytest.mark.parametrize("bucket", [32, 1])
def test_near_copies(spark, docs_of, monkeypatch, bucket):
    """Copies with up to eight words changed, on both sides of 0.8; also with all bands crowded."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    if bucket == 1:
        monkeypatch.setattr(near_copies, "CENTRES", 1)
        monkeypatch.setattr(near_copies, "PART", 3)
    r = random.Random(21)
    rows, line = [], words(r, 20)
    for i in range(40):
        w = words(r, r.choice([40, 200, 500])) + line
        rows.append((10 * i + 1, " ".join(w)))
        for j in range(i % 4):
            e = list(w)
            for at in r.sample(range(len(e)), r.choice([1, 2, 4, 8])):
                e[at] = "changed"
            rows.append((10 * i + 2 + j, " ".join(e).upper()))
    rows += [(900, None), (901, " "), (902, "two words"), (903, "Two  words"), (904, rows[0][1]), (905, "v " * 3000)]
    assert [x.doc_id for x in near_copies.keep_first(docs_of(rows)).orderBy("doc_id").collect()] == plain_firsts(rows)
    assert near_copies.keep_first(docs_of([])).count() == 0
    docs = docs_of(rows).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == plain_firsts(rows)


def test_crowded_band_loses_no_link(spark, docs_of):
    """A group of 120 near copies, some over 0.2 from every centre and linked in pairs among themselves."""
    r = random.Random(5)
    w, rows = words(r, 150), []
    for i in range(120):
        e = list(w)
        for at in r.sample(range(150), 2 if i % 3 else 6):
            e[at] = f"own{i}"
        rows.append((2 * i, " ".join(e)))
        if i % 12 == 0:
            e[r.randrange(150)] = "again"
            rows.append((2 * i + 1, " ".join(e)))
    assert [x.doc_id for x in near_copies.keep_first(docs_of(rows)).orderBy("doc_id").collect()] == plain_firsts(rows)


def test_similar_between():
    r = np.random.default_rng(2)
    base = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 40, 80, 200)]
    left, right = base + [b[1:] for b in base], [b[:-1] for b in base] + base
    want = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if near_copies.similarity(a, b) >= 0.8]
    assert near_copies.similar_between(left, right) == want and near_copies.similar_between(left, []) == []


def test_thresholds_cover_the_radius():
    """Every pair within the radius agrees within the threshold on some group, whatever is allocated."""
    r = random.Random(1)
    for groups in (2, 3, 4):
        bits = simhash_dedup.correlated_groups(np.array([[r.random() for _ in range(64)] for _ in range(64)]), 1, groups)
        assert sorted(b for g in bits for b in g) == list(range(64))
        _, t = simhash_dedup.allocate([[0.0, r.random(), r.random(), r.random()] for _ in range(groups)], 2)
        assert sum(t) == 2 - groups + 1
        for _ in range(300):
            flipped = set(r.sample(range(64), 2))
            assert any(len(flipped & set(g)) <= k for g, k in zip(bits, t))


def plain_matches(docs, items):
    import re
    from collections import Counter

    def grams(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = set()
    for d, t in docs:
        g = grams(t)
        for i, it in items:
            h = grams(it)
            for s in range(len(g)) if h else ():
                a, b = Counter(g[s : s + len(h)]), Counter(h)
                m = sum((a & b).values())
                if m / (sum(a.values()) + sum(b.values()) - m) >= 0.8 - 1e-12:
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark, docs_of):
    r = random.Random(6)
    items = [(i, " ".join(words(r, r.randint(14, 50)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for d in range(60):
        w = words(r, r.randint(0, 120))
        if d % 3 == 0:
            item = items[d % 12][1].split()
            if d % 2:
                item[len(item) // 2] = "other"
            if d % 5 == 0:
                item = item[1:]
            w[len(w) // 2 : len(w) // 2] = item
        docs.append((d, " ".join(w).capitalize() + "."))
    docs += [(100, None), (101, ""), (102, items[0][1].upper()), (102, items[0][1].upper()), (None, items[1][1]), (103, " ".join([items[2][1]] * 3))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = decontaminate.matches(docs_of(docs), table).collect()
    assert {(x.doc_id, x.item_id) for x in got} == plain_matches(docs, items)
    assert len(got) == len({(x.doc_id, x.item_id) for x in got})
    assert decontaminate.matches(docs_of([]), table).count() == 0
    assert decontaminate.matches(docs_of(docs), table.limit(0)).count() == 0
    left = {x.doc_id for x in decontaminate.clean(docs_of(docs), table).collect()}
    assert left == {d for d, _ in docs if d is None or d not in {x.doc_id for x in got}}


def test_clean_texts_whatever_the_id(spark, docs_of):
    import corpus_pipeline

    r = random.Random(16)
    item = " ".join(words(r, 30))
    held = lambda: " ".join(words(r, 20)) + " " + item
    free = [" ".join(words(r, 50)) for _ in range(4)]
    docs = docs_of([(None, held()), (None, free[0]), (1, held()), (1, free[1]), (2, free[2]), (3, None), (4, held())])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.clean_texts(docs, items)
    assert left.columns == docs.columns
    want = sorted([(None, free[0]), (1, free[1]), (2, free[2]), (3, None)], key=str)
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == want
    assert sorted(((x.doc_id, x.text) for x in decontaminate.clean_texts(docs, items.limit(0)).collect()), key=str) == sorted(((x.doc_id, x.text) for x in docs.collect()), key=str)
    assert "clean_texts" in corpus_pipeline.decontaminated.__code__.co_names


def test_block_index_meets_all_within_the_radius():
    r = random.Random(3)
    for _ in range(2000):
        x = sum(1 << b for b in r.sample(range(64), decontaminate.RADIUS))
        assert any((x >> a & ((1 << w) - 1)).bit_count() <= decontaminate.RADIUS // decontaminate.BLOCKS for a, w in decontaminate.blocks())
    assert sum(w for _, w in decontaminate.blocks()) == 64


def test_passages(spark, docs_of):
    r = random.Random(8)
    shared = words(r, 90)
    docs = [(i, " ".join(words(r, 80) if i % 2 else words(r, 200))) for i in range(20)]
    for i in range(20, 30):
        p = list(shared)
        if i % 2:
            p[30], p[60:61] = "edited", ["two", "words"]
        docs.append((i, " ".join(words(r, 40 + i) + p + words(r, 30))))
    docs += [(40, docs[3][1]), (41, docs[3][1]), (42, None), (43, ""), (44, "short text"), (None, docs[5][1]), (45, " ".join(shared[:30]))]
    got = passages.repeated_passages(docs_of(docs)).collect()
    hit = {x.doc_id for x in got} | {x.other_doc_id for x in got}
    assert hit == {*range(20, 30), 3, 40, 41}
    text = dict(docs)
    for x in got:
        a = text[x.doc_id].split()[x.start_word : x.start_word + x.n_words]
        b = text[x.other_doc_id].split()[x.other_start : x.other_start + x.other_words]
        assert min(len(a), len(b)) >= 50 and x.identity >= 0.8
        if x.kind == "passage":
            assert abs(len(a) - 90) <= 3 or x.n_words >= 50
        else:
            assert a == b
    assert passages.repeated_passages(docs_of([])).count() == 0


def test_passages_whose_pieces_other_texts_hold(spark, docs_of):
    """Texts that share 60 words meet though others hold either half, whichever text has the least hash."""
    r = random.Random(12)
    docs, pairs = [], []
    for p in range(8):
        shared = words(r, 60)
        for part in [shared] * 2 + [shared[:30], shared[30:]] * 12:
            docs.append((len(docs), " ".join(words(r, 40) + part + words(r, 40))))
        pairs.append((len(docs) - 26, len(docs) - 25))
    got = passages.repeated_passages(docs_of(docs)).collect()
    assert {tuple(sorted((x.doc_id, x.other_doc_id))) for x in got} == set(pairs)
    assert all(x.n_words >= 60 for x in got)


def test_fuzzy_passages_with_one_common_run_of_13_words(spark, docs_of):
    """Then an edit every six words, an identity over 0.8."""
    r = random.Random(77)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    docs = []
    for _ in range(20):
        a = fresh(60)
        b = [f"x{r.randrange(10**6)}" if i >= 18 and i % 6 == 0 else x for i, x in enumerate(a)]
        docs += [(len(docs) + j, " ".join(fresh(40) + p + fresh(40))) for j, p in enumerate((a, b))]
    got = passages.repeated_passages(docs_of(docs)).collect()
    hit = {tuple(sorted((x.doc_id, x.other_doc_id))) for x in got}
    assert hit == {(i, i + 1) for i in range(0, 40, 2)}


def test_windows_that_a_text_repeats():
    h, doc, pos, near = passages.windows(*passages.batch_words(["v " * 80, "w", " ".join(map(str, range(50)))]))
    assert doc.tolist() == [0] * 31 + [2] and len(set(h[:31])) == 1 and len(set(near[:31])) == 1
    plain, again = passages.numbered(h[:31], doc[:31], pos[:31], near[:31])
    assert plain[2].tolist() == [0] and sorted(again[2].tolist()) == list(range(1, 31)) and len(set(again[0])) == 30


def test_chains_against_quadratic():
    r = random.Random(2)
    for _ in range(200):
        anchors = sorted({(r.randint(0, 40), r.randint(0, 40)) for _ in range(r.randint(1, 25))})
        pos, rpos = zip(*anchors)
        f = []
        for x in range(len(anchors)):
            before = [f[y] - passages.GAP_COST * (pos[x] - pos[y] + rpos[x] - rpos[y]) for y in range(x) if pos[y] < pos[x] and rpos[y] < rpos[x]]
            f.append(passages.K + max([0.0, *before]))
        found = passages.chains(list(pos), list(rpos))
        assert sorted(i for c in found for i in c) == list(range(len(anchors)))
        top = max(sum(passages.K for _ in c) - passages.GAP_COST * (pos[c[-1]] - pos[c[0]] + rpos[c[-1]] - rpos[c[0]]) for c in found)
        assert abs(top - max(f)) < 1e-6


def test_word_hashes_and_seeds():
    h, at = passages.word_hashes(b"  one two\tone\n")
    assert len(h) == 3 and h[0] == h[2] != h[1] and at.tolist() == [2, 6, 10]
    h, doc, pos = passages.seeds(["a b", None, " ".join(map(str, range(50))), "x " + " ".join(map(str, range(50)))])
    assert set(doc.tolist()) == {2, 3}
    assert {int(x) for x, d in zip(h, doc) if d == 2} & {int(x) for x, d in zip(h, doc) if d == 3}
    packed = passages.packed(np.sort(h), doc.astype(np.int64), pos)
    back = passages.unpacked(packed)
    assert (back[0] == np.sort(h)).all() and (back[1] == doc).all() and (back[2] == pos).all()


def test_passages_of_repeated_lines_are_reported_once(spark, docs_of):
    """Not once a repeat: every other passage of the pair lies in that one."""
    r = random.Random(31)
    docs = [(i, " ".join(words(r, 60) + ["is", "onhe."] * n + words(r, 60))) for i, n in enumerate([300, 260, 280, 300])]
    got = [x for x in passages.repeated_passages(docs_of(docs)).collect() if x.kind == "passage"]
    assert {i for x in got for i in (x.doc_id, x.other_doc_id)} == {0, 1, 2, 3}
    assert len(got) <= 20 and max(x.n_words for x in got) >= 520
    spans = [(x.doc_id, x.other_doc_id, x.start_word, x.start_word + x.n_words, x.other_start, x.other_start + x.other_words, x.identity) for x in got]
    assert not [1 for a in spans for b in spans if a != b and a[:2] == b[:2] and b[2] <= a[2] and b[3] >= a[3] and b[4] <= a[4] and b[5] >= a[5] and b[6] >= a[6]]


@pytest.mark.parametrize("others", [20, 40])
def test_fuzzy_passages_whose_seeds_other_texts_hold(spark, docs_of, others):
    """Two texts share 72 words but for an edit every 18; each run between edits is held by others, whichever
    text has the least hash."""
    r = random.Random(others)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    docs, pairs = [], []
    for _ in range(6):
        a = fresh(72)
        b = [f"x{r.randrange(10**6)}" if i % 18 == 17 else x for i, x in enumerate(a)]
        runs = [a[i : i + 17] for i in range(0, 72, 18)]
        pairs.append((len(docs), len(docs) + 1))
        for part in (a, b, *runs * others):
            docs.append((len(docs), " ".join(fresh(45) + part + fresh(45))))
    got = passages.repeated_passages(docs_of(docs)).collect()
    assert {tuple(sorted((x.doc_id, x.other_doc_id))) for x in got} == set(pairs)


def test_near_copies_has_the_links_of_fingerprints(spark, docs_of):
    """Texts whose fingerprints are within the radius are one group though their shingle sets aren't alike."""
    r = random.Random(5)
    while True:
        a = words(r, 24)
        b = [*a]
        b[12] = "changed"
        near = bin(simhash_dedup.fingerprint(" ".join(a)) ^ simhash_dedup.fingerprint(" ".join(b))).count("1")
        if near <= simhash_dedup.RADIUS and near_copies.similarity(*(near_copies.shingle_set(" ".join(x)) for x in (a, b))) < near_copies.SIMILARITY:
            break
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(words(r, 30))), (4, None), (5, "")]
    assert sorted(x.doc_id for x in near_copies.keep_first(docs_of(docs)).collect()) == [1, 3, 4]


def test_passages_leave_no_shuffle_behind(spark, docs_of):
    """What a step shuffled is gone when its table is written; it was kept until the driver's JVM collected it."""
    kept = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}
    before = kept()
    text = " ".join(f"w{i}" for i in range(80))
    found = passages.repeated_passages(docs_of([(1, f"{text} x"), (2, f"y {text}"), (3, "z " * 60)]))
    for _ in range(50):
        left = kept() - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert [(x.start_word, x.n_words, x.other_start) for x in found.collect()] in ([(0, 80, 1)], [(1, 80, 0)])


def test_hopeful_chains_as_one_by_one(spark):
    """Chains of a bundle judged at once, against each by hand, at the ends of texts too."""
    pa = passages.pa
    rng = random.Random(5)
    rows, want = [], []
    for k in range(40):
        row = dict(bundle=k, rid=1, rep=2, d0=[], dn=[], d=b"", r0=[], rn=[], r=b"", at=[])
        for _ in range(rng.randint(1, 3)):
            left, right = rng.choice([0, 3, 44]), rng.choice([0, 5, 44])
            d = [rng.randrange(256) for _ in range(left + passages.K + right)]
            r = [x if rng.random() < 0.9 else rng.randrange(256) for x in d]
            row["at"].append(7 + left)
            for side, words in (("d", d), ("r", r)):
                row[f"{side}0"].append(7)
                row[f"{side}n"].append(len(words))
                row[side] += bytes(words)
            ways = ((d[:left][::-1], r[:left][::-1]), (d[left + passages.K :], r[left + passages.K :]))
            for out, (a, b) in zip((want, want), ways):
                score = top = far = 0
                for x, y in zip(a, b):
                    score += 1 if x == y else -4
                    top = max(top, score)
                    if top - score > passages.DROP:
                        break
                    far += 1
                out.append(far)
        rows.append(row)
    lists = {c: pa.array([r[c] for r in rows], pa.list_(pa.int32())) for c in ("d0", "dn", "r0", "rn")}
    anchors = pa.array([[np.array([[p], [p]], "<i4").tobytes() for p in r["at"]] for r in rows], pa.list_(pa.binary()))
    batch = pa.RecordBatch.from_pydict({"rid": pa.array([r["rid"] for r in rows]), "rep": pa.array([r["rep"] for r in rows]), "anchors": anchors, "d": pa.array([r["d"] for r in rows], pa.binary()), "r": pa.array([r["r"] for r in rows], pa.binary()), **lists})
    sides = passages.Sides(batch, "u1")
    at = np.array([p for r in rows for p in r["at"]])
    got = np.stack([sides.reach([at, at], -1), sides.reach([at + passages.K] * 2, 1)], 1)
    assert got.ravel().tolist() == want
    row, places = sides.places(np.arange(len(at)))
    assert all(len(x["around"]) >= passages.K and x["around"][x["before"] :][: passages.K] == x["seed"].to_bytes(6, "little") for x in places.to_pylist())
    assert (np.diff(row) >= 0).all()
