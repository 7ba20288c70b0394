import random
import re

import numpy as np
import pytest

from tidelog.llm import minhash
from tidelog.llm.common import Scratch
from tidelog.llm.minhash import MinHash, components, keep_one, near_duplicates

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, k=4, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_matches_brute_force(documents):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 60, 150]))]
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary).upper()
            rows.append((n, " ".join(copy)))
            n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), MinHash(shingle=4)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("rows_,bytes_", [(4096, 16 << 20), (8, 4000)])
def test_a_cluster_with_members_apart(documents, monkeypatch, rows_, bytes_):
    """Whatever the blocks' sizes. A chain: neighbours are alike, the ends are not; and members of the cluster that are linked with none."""
    monkeypatch.setattr(minhash, "_BLOCK_ROWS", rows_)
    monkeypatch.setattr(minhash, "_BLOCK_BYTES", bytes_)
    base = [f"a{i}" for i in range(200)]
    rows, text = [], list(base)
    for n in range(30):
        rows.append((n, " ".join(text)))
        for k in range(4):
            text[(n * 6 + k) % 200] = f"b{n}x{k}"
    for n in range(30, 60):
        apart = list(base)
        for k in range(12):
            apart[(k * 16 + n) % 200] = f"c{n}x{k}"
        rows.append((n, " ".join(apart)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows), MinHash(shingle=4)).collect()}
    assert got == brute(rows)


def test_odd_rows(documents, odd_rows):
    got = near_duplicates(documents(odd_rows), MinHash(shingle=4)).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] * 2
    assert by[5] == [(1, 5, True)] and by[6] == [(1, 5, False)]
    assert by[8][0][1] == 7 and by[7][0][2]
    assert {x[2] for x in by[None]} == {False}


def test_rows_without_an_id_are_documents(documents):
    """They link what they are like, and different texts of one id have their own groups."""
    base = [f"w{i}" for i in range(100)]
    near, far = " ".join(base[:97] + ["x", "y", "z"]), " ".join(base[3:] + ["v"] * 3)
    rows = [(None, " ".join(base)), (3, near), (9, far), (9, "quite another text with words"), (None, "alone and without an id")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_duplicates(documents(rows), MinHash(shingle=1, percent=85)).collect()}
    assert got[3, 100] == 3 and got[None, 100] == 3 and got[9, 98] == 3
    assert got[9, 5] == 9 and got[None, 5] is None


def test_many_equal_rows(documents):
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join(base[:-1] + ["z"])
    rows = [(1 if k % 2 else 2, one if k % 2 else two) for k in range(30_000)] + [(None, one)] * 20_000
    got = near_duplicates(documents(rows), MinHash(shingle=4)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {(r.doc_id, r.component_id, r.kept): r["count"] for r in got} == {(1, 1, True): 15_000, (2, 1, False): 15_000, (None, 1, False): 20_000}
    assert [(r.doc_id, r.text) for r in keep_one(documents(rows)).collect()] == [(1, one)]


def test_one_of_each_group_stays(documents, odd_rows):
    rows = documents(odd_rows)
    got = keep_one(rows)
    assert got.columns == rows.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    # rows without words stay, the others once for each group: 5 and 6 are alike, 7 and 8 equal
    words = [(i, t) for i, t in odd_rows if t and t.split()]
    want = {(4, "one"), (5, "one two three"), (None, "lost id here we go"), (7, odd_rows[9][1]), (9, odd_rows[11][1]), (9, odd_rows[12][1])}
    assert {x for x in left if x in words} == want
    assert [x for x in left if x not in words] == sorted([x for x in odd_rows if x not in words], key=str)
    assert keep_one(documents([])).collect() == []


def test_links_by_rarest_shingles():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        k = rng.integers(20, 60)
        sets.append(np.unique(np.concatenate([shared[rng.permutation(60)[:k]], rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])))
    sets += [np.unique(np.concatenate([s[2:], s[:1]])) for s in sets[:30]]
    label = np.arange(len(sets))
    linked = {(a, b) for a in range(40) for b in range(len(sets)) if a != b and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)}
    got = minhash.links_between(sets[:40], sets, label[:40], label, 80)
    assert set(got) == linked and len(linked) > 20


def test_empty(documents):
    assert near_duplicates(documents([])).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 4), (20, 21), (22, 21), (30, 30)]
    for most in (1_000_000, 0):  # settled by one task, or by distributed steps
        got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), most=most).collect()
        assert {(r.node, r.component) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 1), (20, 20), (21, 20), (22, 20)}
