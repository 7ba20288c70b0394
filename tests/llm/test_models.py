"""Quality, toxicity and decontamination: held-out accuracy and odd rows; the pipeline against its parts."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidelog.llm import decontam, mixing, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "sho", "ban") for b in ("ra", "ne", "to", "vi", "lu", "sa", "dor")]
LABELS = "doc_id long, quality int, toxic int"


def clean(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_quality(spark, documents, odd_rows):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        text = clean(rng, 60) if good else " ".join(w + "***" for w in clean(rng, 60).split()).upper()
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (5, None, None), (2, 1, 0)]
    fold = queries.fold(3, 1)
    got = quality.classify(documents(rows), spark.createDataFrame(labels, LABELS), fold, quality.PositiveUnlabelled(epochs=20)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.predicted == (r.doc_id % 5 != 0) for r in held]) > 0.95
    odd = quality.classify(documents(odd_rows), spark.createDataFrame(labels, LABELS), fold, quality.PositiveUnlabelled(epochs=1)).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(documents([]), none, fold, quality.PositiveUnlabelled(epochs=1)).collect() == []


def test_prior_from_positives_and_unlabelled():
    """Rows of two kinds that overlap a little; the prior is found without any label of the second kind."""
    rng = np.random.default_rng(4)
    x = lambda n, shift: (rng.normal(0, 1, (n, quality.WIDTH)) + shift * (np.arange(quality.WIDTH) < 60)).astype(np.float32)
    for prior in (0.3, 0.7):
        unlabelled = np.concatenate([x(int(2000 * prior), 1.0), x(2000 - int(2000 * prior), -1.0)])
        got = quality.estimate_prior(x(1000, 1.0), unlabelled[rng.permutation(2000)], quality.PositiveUnlabelled(epochs=15))
        assert abs(got - prior) < 0.08


def test_quality_of_one_id_with_many_texts(spark, documents):
    rows = [(1, f"words {k} " * 9) for k in range(2000)] + [(None, "no id")] * 2000 + [(k, "good words only") for k in range(2, 40)]
    table = spark.createDataFrame([(1, 1, 1)] + [(k, k % 2, 0) for k in range(2, 40)], LABELS)
    got = quality.classify(documents(rows), table, queries.fold(3, 1), quality.PositiveUnlabelled(epochs=1)).collect()
    assert len(got) == 4038


def test_repetition_late_in_a_text():
    fresh = " ".join(f"{a}{b}" for a in WORDS for b in WORDS[:20])
    late = " ".join(fresh.split()[:200] + ["again"] * 200)
    x, y = quality.features(pa.array([" ".join(fresh.split()[:400]), late]))
    assert y[quality._TAIL + 5] < 0.7 * x[quality._TAIL + 5]  # over all stretches
    assert y[quality._TAIL + 8] == np.float32(1 / 200) < x[quality._TAIL + 8]  # the least of them
    distinct, size = quality._distinct(np.array([1, 1, 2] * 150))
    assert distinct.tolist() == [2, 2, 2] and size.tolist() == [200, 200, 50]


def test_toxicity(spark, documents, odd_rows):
    rng = random.Random(2)
    rows, labels = [], []
    insults = ["blockhead", "nitwit", "dunderhead"]
    for i in range(900):
        w = clean(rng, 40).split()
        if i % 6 == 0:
            w[rng.randrange(40)] = w[rng.randrange(40)] = rng.choice(insults)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(5000, clean(rng, 20) + " b-l-o-c-k-h-e-a-d " + clean(rng, 20)), (5001, clean(rng, 20) + " nitxwit " + clean(rng, 20)), (5002, clean(rng, 20) + " dunder head"), (5003, clean(rng, 30))]
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], LABELS)
    fold = queries.fold(5, 0)
    got = {r.doc_id: r for r in toxicity.classify(documents(rows), table, fold).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert len(held) > 100 and np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.98
    assert got[5000].predicted == 1 and got[5003].predicted == 0
    assert got[5001].score > got[5003].score
    kept = toxicity.reject(documents(rows), table, fold)
    assert kept.columns == documents([]).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    odd = toxicity.classify(documents(odd_rows), table, fold).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity.classify(documents(odd_rows), none, fold).collect()} == {0}
    assert toxicity.classify(documents([]), none, fold).collect() == []


def subsequences(word):
    """Weighted subsequences of a marked word, by a plain search over places."""
    out = {}
    for size, span in ((3, 5), (4, 7)):
        for places in itertools.combinations(range(len(word)), size):
            if places[-1] - places[0] < span:
                key = tuple(word[k] for k in places)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (places[-1] - places[0] - size + 1)
    return out


def test_string_kernel_matches_a_plain_search():
    words = ["scoundrel", "scoundxrel", "marmalade", "abab", "a", "\xe9t\xe9", "ooooo"]
    r = toxicity.read(words, 12)
    pieces = r.pieces()
    got = toxicity.kernel(pieces, pieces)
    code = [tuple(int(c) for c in p) for p in pieces]
    for i, x in enumerate(code):
        for j, y in enumerate(code):
            f, g = subsequences(x), subsequences(y)
            want = sum(v * g.get(k, 0) for k, v in f.items()) / (toxicity._NORM[len(x)] * toxicity._NORM[len(y)])
            assert abs(got[i, j] - want) < 1e-4
    assert got[0, 1] > 0.4 > 0.2 > got[0, 2]
    # the weights of the fast way: one word's subsequences as the machine's weights
    weight = np.zeros(toxicity.SIZE, np.float32)
    ids, w = toxicity.occurrences(pieces[:1])
    np.add.at(weight, ids[0], w[0])
    assert np.allclose(toxicity.margins(r, weight, 0.5) - 0.5, got[:, 0], atol=1e-4)


def test_reading_of_sentences():
    def spelled(texts, words=12):
        r = toxicity.read(texts, words)
        names = ["".join(chr(96 + c) if c < 27 else "#" for c in p[1:-1]) for p in r.pieces()]
        return [(int(r.text[s]), [n for n, z in zip(names, r.sentence, strict=True) if z == s]) for s in range(len(r.text))]

    assert spelled(["One two. Three", "", "i d i o t you", "b-a.d \n x y", "$$ !!"]) == [(0, ["one", "two"]), (0, ["three"]), (2, ["idiot", "you"]), (3, ["bad"]), (3, ["xy"])]
    assert spelled(["a1 b2 c3 d4 e5"], 2) == [(0, ["a#", "b#"]), (0, ["c#", "d#"]), (0, ["e#"])]
    assert spelled(["ab" * 20])[0][1] == ["ab" * 12, "ab" * 12]
    assert spelled(["", "  "]) == []


def test_one_id_with_many_texts_is_one_row_to_learn_from(spark, documents):
    rows = [(1, f"text number {k} with an insult nitwit") for k in range(3000)] + [(None, "nobody knows")] * 3000 + [(k, "good words only") for k in range(2, 40)]
    table = spark.createDataFrame([(1, 1, 1)] + [(k, 1, 0) for k in range(2, 40)], LABELS)
    got = toxicity.classify(documents(rows), table, queries.fold(5, 0)).groupBy("doc_id").count().collect()
    assert sum(r["count"] for r in got) == 6038


def test_lcs():
    def plain(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontam.lcs(a, b) == plain(a, b)


def test_leaks(spark, documents, odd_rows):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    item = [" ".join(rng.choice(words) for _ in range(n)) for n in (15, 30, 59)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, fill(200)) for i in range(60)]
    want = set()
    for k, text in enumerate(item):
        rows += [(100 + k, fill(71) + " " + text + " " + fill(90)), (200 + k, text.upper()), (300 + k, " ".join(text.split()[:4]) + " " + fill(80))]
        swapped = text.split()
        for j in range(0, len(swapped), 7):
            swapped[j] = "other"
        rows.append((400 + k, fill(33) + " " + " ".join(swapped) + " " + fill(50)))
        want |= {(100 + k, k), (200 + k, k), (400 + k, k)}
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(item)] + [(7, None, "x"), (8, "", "x")], "item_id long, text string, doc_id string")
    p = decontam.Latent(rank=32, sample=100)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents(rows), bench, p).collect()} == want
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents(rows), bench, decontam.Latent(rank=32, sample=100, block=2)).collect()} == want
    assert decontam.find_leaks(documents(odd_rows), bench, p).collect() == []
    assert decontam.find_leaks(documents([]), bench, p).collect() == []
    assert decontam.find_leaks(documents(rows), bench.limit(0), p).collect() == []


def test_leaks_of_a_large_benchmark(spark, documents):
    """Far more items than the latent space has dimensions: all leaks of a brute-force search, paraphrases included."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    items = [[rng.choice(words) for _ in range(rng.randrange(15, 60))] for _ in range(2500)] + [words[:3]]
    texts = []
    for k in range(0, 2500, 50):
        n = len(items[k])
        drop = set(rng.sample(range(n - int(0.34 * n)), int(n * (0, 0.25, 0.4)[k // 50 % 3])))
        kept = [w if j not in drop else rng.choice(words) for j, w in enumerate(items[k])]
        texts.append([rng.choice(words) for _ in range(80)] + kept + [rng.choice(words) for _ in range(rng.randrange(90))])
    texts += [[rng.choice(words) for _ in range(30)] + words[:3], [words[0], words[5], words[1], words[2]]]
    p = decontam.Latent()
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items[:-1]):
            n, tail = len(item), item[-max(1, int(len(item) * p.tail)) :]
            for s in range(0, len(text), p.window // 2):
                around = text[max(0, s - n) : s + p.window + n]
                near = set(around)
                share = decontam.lcs(item, around) / n if sum(w in near for w in item) >= p.partly * n else 0
                if share >= p.covered or share >= p.partly and decontam.lcs(tail, around) / len(tail) >= p.answer:
                    want.add((d, i))
    assert len(want) >= 50
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(documents([(d, " ".join(t)) for d, t in enumerate(texts)]), bench, p).collect()}
    assert {x for x in got if x[1] < 2500} == want
    assert (50, 2500) in got


def test_latent_space_of_all_documents(spark, documents):
    """The space is that of the passages of all rows, however many, and of the items; ids have no part in it."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in WORDS[:12] for b in WORDS[:12]]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 31, 32, 33, 64, 65, 700, *(rng.randrange(120) for _ in range(150)))] + [None]
    items = pa.array([" ".join(rng.choice(words) for _ in range(n)) for n in (3, 20, 45)])
    p = decontam.Latent(rank=4, sample=40, bits=9)
    docs = documents([(None if k % 5 == 0 else k // 3, t) for k, t in enumerate(texts)]).repartition(3)
    hashed = decontam.hashed_words(docs, p)
    df, n = decontam.document_frequencies(hashed, p)

    def buckets(text):
        column = pa.array([text], pa.string())
        return [b for _, data, offsets in decontam.text_blocks(column) for b in decontam._buckets(decontam.word_hashes(data, offsets, fold=True)[0], p).tolist()]

    listed = [buckets(t) for t in texts]
    assert n == len(texts) and df.tolist() == [sum(b in set(x) for x in listed) for b in range(1 << p.bits)]
    idf = np.log((1.0 + n) / (1.0 + df)) + 0.01

    def vector(ids):
        x = np.bincount(ids, minlength=1 << p.bits) * idf
        return x / np.linalg.norm(x)

    own = 24 * np.array([vector(buckets(t.as_py())) for t in items])
    parts = np.array([vector(x[k : k + p.window]) for x in listed for k in range(0, len(x), p.window)])
    gram = own.T @ own + p.sample / n * parts.T @ parts
    basis = np.random.default_rng(p.seed).standard_normal((1 << p.bits, p.rank + 8))
    for _ in range(2):
        basis = gram @ np.linalg.qr(basis)[0]
    basis, _ = np.linalg.qr(basis)
    want = basis @ np.linalg.svd(own @ basis)[2].T[:, :3]  # the items span three directions
    got = decontam.latent_space(hashed, n, items, idf.astype(np.float32), p)[:, :3]
    assert np.abs(got @ got.T - want @ want.T).max() < 1e-3


def test_leaks_do_not_depend_on_a_sample(spark, documents):
    """Cosines are the same whatever the rows' ids, which once chose the documents of the space."""
    rng = random.Random(10)
    words = [f"{a}{b}" for a in WORDS[:12] for b in WORDS[:12]]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(100))) + " " + items[k % 12] * (k % 10 == 0) for k in range(400)]
    texts[0] = items[0] + " " + " ".join(rng.choice(words[:40]) for _ in range(20_000))  # a row that shapes the space
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    p = decontam.Latent(rank=2, sample=100)
    found = [sorted(r.cosine for r in decontam.find_leaks(documents([(i(k), t) for k, t in enumerate(texts)]).coalesce(1), bench, p).collect()) for i in (lambda k: k, lambda k: 7 * k + 1000, lambda k: k % 3)]
    assert [len(x) for x in found] == [40] * 3 and np.ptp(found, axis=0).max() < 1e-4


@pytest.fixture(scope="module")
def corner(spark, tmp_path_factory):
    """Labels and a benchmark, and documents with odd ids and columns of many names."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], LABELS).write.parquet(f"{folder}/labels.parquet")
    item = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = "key words copy copies component node label cluster block n size place held_out score _d _t g0 t0 t1 one".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *names) for i, t, s in rows], schema)

    texts = {k: clean(rng, 50) for k in range(200)}
    learn = [(k, t + (" you blockhead" if k % 4 == 0 else ""), "a") for k, t in texts.items()]
    return folder, make, learn, item, rng


def test_stage_toxicity_on_odd_rows(spark, corner):
    folder, make, learn, _, rng = corner
    odd = [(None, clean(rng, 30) + " blockhead", "a"), (None, "kind words", "a"), (1, clean(rng, 20) + " blockhead", "a"), (1, None, "a"), (None, "", None)]
    docs = make(learn + odd)
    got = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(left, key=str) == sorted([(i, t) for i, t, _ in learn + odd if "blockhead" not in (t or "")], key=str)
    assert corpus_pipeline.drop_toxic(spark, make([]), folder).collect() == []


def test_stage_near_duplicates_on_odd_rows(spark, corner):
    folder, make, _, _, rng = corner
    a, b = clean(rng, 60), clean(rng, 60)
    docs = make([(5, a, "a"), (5, b, "a"), (None, a + " end", "a"), (None, clean(rng, 9), "a"), (9, b, "a"), (None, None, "a"), (6, "", "a"), (6, "", "a")])
    got = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert len(left) == 6 and (5, a) in left and (5, b) in left and left.count((6, "")) == 2 and (None, None) in left
    assert corpus_pipeline.drop_near_copies(spark, make([]), folder).collect() == []


def test_stage_decontamination_on_odd_rows(spark, corner):
    folder, make, learn, item, rng = corner
    rows = learn + [(None, clean(rng, 40) + " " + item, "a"), (None, "kept", "a"), (3, item, "a"), (3, "kept too", "a"), (4, None, "a")]
    docs = make(rows)
    got = corpus_pipeline.drop_leaks(spark, docs, folder)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(i, t) for i, t, _ in rows if item not in (t or "")], key=str)
    assert corpus_pipeline.drop_leaks(spark, make([]), folder).collect() == []


def test_stage_decontamination_does_not_depend_on_a_sample(spark, documents, tmp_path):
    """More rows than once made up the space, short items with a word changed: the same rows stay whatever the ids are."""
    rng = random.Random(13)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    items = [[rng.choice(words) for _ in range(7)] for _ in range(900)]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(2600)]
    texts += [" ".join([rng.choice(words) for _ in range(32)] * 400) for _ in range(24)]  # rows that shape the space
    texts += [" ".join([rng.choice(words) for _ in range(rng.randrange(40))] + t[:3] + ["other"] + t[4:]) for t in items]
    left = [{r.text for r in corpus_pipeline.drop_leaks(spark, documents([(i(k), t) for k, t in enumerate(texts)]).coalesce(1), str(tmp_path)).collect()} for i in (lambda k: k, lambda k: 7 * k + 9000)]
    assert left[0] == left[1] and len(left[0]) < len(set(texts))


def test_stage_mixing_on_odd_rows(spark, corner):
    folder, make, learn, _, rng = corner
    rows = learn + [(None, clean(rng, 50), "b") for _ in range(40)] + [(7, clean(rng, 50), None) for _ in range(40)] + [(8, "same old words " * 10, "b")] * 40 + [(9, None, "b")]
    docs = make(rows)
    got = corpus_pipeline.mix_sources(spark, docs, folder)
    assert got.columns == docs.columns
    goal, words = mixing.targets([(s, sum(len((t or "").split()) for _, t, x in rows if x == s)) for s in ("a", "b", None)]), {}
    for r in got.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
        assert (r.doc_id, r.text, r.source) in rows
    assert all(abs(words[s] - goal[s]) < 0.02 * goal[s] for s in goal)
    assert corpus_pipeline.mix_sources(spark, make([]), folder).collect() == []


def test_stage_sharding_on_odd_rows(spark, corner):
    folder, make, learn, _, _ = corner
    rows = learn + [(None, "x", "a")] * 50 + [(7, None, "a")] * 30
    got = corpus_pipeline.shard(spark, make(rows), folder).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(40)]
    assert len(got) == len(rows) and max(sizes) - min(sizes) <= 1
    assert corpus_pipeline.shard(spark, make([]), folder).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline(spark):
    from tidelog.llm.common import Scratch

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch = Scratch(spark, "test")
    sizes, tables = [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        tables.append(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(t.columns == tables[0].columns for t in tables[:-1])
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5]
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    assert sorted(r.doc_id for r in tables[4].select("doc_id").collect()) == sorted(r.doc_id for r in tables[5].select("doc_id").collect())
    # no near copy and no benchmark item is left
    from tests.llm.test_minhash import brute

    left = [(r.doc_id, r.text) for r in tables[2].where("doc_id < 150").collect()]
    assert all(i == c for i, (n, c) in brute(left, 5).items())
    items = [r.text.lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    for r in tables[3].collect():
        w = r.text.lower().split()
        assert not any(tuple(w[k : k + 12]) in runs for k in range(len(w) - 11))
