"""Sharding, URL rules, mixing, tokens, repeats and media: brute force, round trips and odd rows."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import media, mixing, ring, substrings, tokens, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# sharding


def test_ring_law_and_slots(documents, odd_rows):
    rows = odd_rows + [(i, f"text {i % 50}") for i in range(100, 1100)]
    got = ring.assign(documents(rows), ring.Ring(shards=7, nodes=16)).collect()
    assert len(got) == len(rows)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted(map(str, got)) == sorted(map(str, ring.assign(documents(rows), ring.Ring(shards=7, nodes=16)).collect()))


def test_ring_settles_as_a_walk_clockwise():
    r = ring.Ring(shards=5, nodes=8)
    points = r.points()
    rng = random.Random(1)
    counts = {a: rng.randrange(40) for a in range(len(points))}
    plan = ring.settle(counts, points, 5)
    room = Counter({s: sum(counts.values()) // 5 + (s < sum(counts.values()) % 5) for s in range(5)})
    assert Counter({s: sum(hi - lo for _, lo, hi, t, _ in plan if t == s) for s in range(5)}) == room
    for a, n in counts.items():
        spans = sorted((lo, hi) for x, lo, hi, _, _ in plan if x == a)
        assert [lo for lo, _ in spans] == [0, *[hi for _, hi in spans]][: len(spans)] and (spans[-1][1] if spans else 0) == n


def test_ring_matches_a_walk_key_by_key(documents):
    """Every key walks clockwise by itself: hop by hop, in the order of the ring, into shards that have room."""
    r = ring.Ring(shards=5, nodes=8)
    rows = [(None if i % 9 == 0 else i % 400, "t" * (i % 7)) for i in range(1500)]
    got = ring.assign(documents(rows), r).select("doc_id", "size", "text_crc32", "shard", F.xxhash64(F.lit(42), "doc_id").alias("place")).collect()
    points = r.points()
    bounds = [p for p, _ in points]
    keys = sorted(((x.place, x.doc_id is not None, x.doc_id or 0, x.size, x.text_crc32) for x in got))
    arc = [bisect.bisect_left(bounds, k[0]) % len(bounds) for k in keys]
    room = [300] * 5
    shard = [None] * len(keys)
    order = [list(dict.fromkeys(points[(a + j) % len(points)][1] for j in range(len(points)))) for a in range(len(points))]
    for hop in range(5):
        for a in range(len(points)):
            for k in range(len(keys)):
                if arc[k] == a and shard[k] is None and room[order[a][hop]]:
                    shard[k] = order[a][hop]
                    room[order[a][hop]] -= 1
    assert Counter((k[1] and k[2], k[3], s) for k, s in zip(keys, shard, strict=True)) == Counter((x.doc_id is not None and x.doc_id, x.size, x.shard) for x in got)


def test_ring_of_hot_ids(spark, documents):
    rows = documents([(7 if i % 3 else None, "same") for i in range(50_000)])
    got = ring.assign(rows, ring.Ring(shards=8)).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("d")).collect()
    assert [(r.n, r.lo, r.hi, r.d) for r in got] == [(6250, 0, 6249, 6250)] * 8


def test_one_more_shard_moves_few_rows(documents):
    rows = documents([(i, "t") for i in range(4000)])
    before = {r.doc_id: r.shard for r in ring.assign(rows, ring.Ring(shards=10)).collect()}
    after = {r.doc_id: r.shard for r in ring.assign(rows, ring.Ring(shards=11)).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.45 * len(before)


def test_ring_empty(documents):
    assert ring.assign(documents([])).collect() == []


# URL rules


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urls.UPPER, urls.LOWER)), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_urls(spark):
    cases = [None, "", "no scheme", "://", "http://", "http://example.com", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "https://a.b.example.com/en/q", "http://xexample.com/en/", "http://www.example.com/EN/", "http://com/", "http://a.net/es/", "http://net/fr/a", "http://a.net/es", "x://y://z.com/", "http://a.com:80/", "http://u@a.com/", "http://a.com?/", "http://a.com#/en/", "http://\na.com/", "http://example.com./en/", "http://a..com/", "http://" + "a." * 3000 + "net/fr/" + "b/" * 5000, "http://É.com/en/"]
    rows = [(i, u, "x", "y") for i, u in enumerate(cases)] + [(0, cases[7], "x", "y"), (None, cases[8], "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect())
    assert got == Counter((i, *judged(u)) for i, u, _, _ in rows)
    assert urls.judge(df.limit(0)).collect() == []
    assert {r.verdict for r in urls.judge(df, rules=(), default="block").collect()} == {"block"}


# mixing


def test_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 187.5, "b": 75.0, None: 37.5}
    found = mixing.targets([("a", 10), ("b", 1000), ("c", 0)])
    assert found["a"] == 30 and found["c"] == 0 and abs(sum(found.values()) - 1010) < 1e-9


def test_mix_meets_targets(documents):
    rng = random.Random(2)
    sizes = {"a": 400, "b": 300, "c": 200, None: 150}
    rows, n = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            rows.append((n, "w " * rng.choice([1, 5, 40, 300]), s))
            n += 1
    got = mixing.mix(documents(rows), block_rows=100).collect()
    source = {i: s for i, _, s in rows}
    taken, goal = Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    for s in sizes:
        assert abs(taken[s] - goal[s]) < 0.02 * goal[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(rows), block_rows=100).collect()))


def dense_tilt(sizes, goal, most):
    """By bisection, document by document, without histograms or Newton steps."""
    mean = sum(sizes) / len(sizes)
    lo, hi = -700.0, 700.0
    for _ in range(200):
        mid = (lo + hi) / 2
        total = sum(s * min(most, math.exp(min(mid * s / mean, 700))) for s in sizes)
        lo, hi = (mid, hi) if total < goal else (lo, mid)
    return lo, mean


def test_balance_matches_a_dense_solver(spark):
    rng = random.Random(5)
    sizes = {s: [rng.choice([1, 4, 30, 200]) for _ in range(300)] for s in ("a", "b", "c", None)}
    goal = {s: share * sum(sizes[s]) for s, share in zip(sizes, (0.2, 0.9, 1.7, 2.6), strict=True)}
    rows = [(s, k, n) for s in sizes for k, n in Counter(sizes[s]).items()]
    found = mixing.balance(spark.createDataFrame(rows, "source string, size long, n long"), goal, {s: sum(x) for s, x in sizes.items()}, {s: len(x) for s, x in sizes.items()}, 3)
    for s in sizes:
        tilt, mean = dense_tilt(sizes[s], goal[s], 3)
        assert abs(found[s][0] - tilt) < 2e-3 * max(1, abs(tilt)) and abs(found[s][1] - mean) < 1e-9


def test_mix_of_hot_ids(documents):
    rows = [(7 if i % 3 else None, "a b c", "x") for i in range(50_000)] + [(i, "w " * 200, "y") for i in range(100, 400)]
    got = mixing.mix(documents(rows)).groupBy("size", "target").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert {r["size"]: r.n for r in got} == {3: 50_000, 200: 300}
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)
    again = mixing.repeat(documents(rows))
    assert again.columns == documents([]).columns and again.count() == sum(r.taken // r["size"] for r in got)


def test_mix_odd(documents, odd_rows):
    got = mixing.mix(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(r.copies <= 3 for r in got)
    assert mixing.mix(documents([])).collect() == []
    alone = mixing.mix(documents([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(0, 0.0, 0)] * 2


# tokens


def test_tokens_round_trip(documents, odd_rows):
    from tokenizers import Tokenizer

    rows = odd_rows + [(20, "<|endoftext|>x it's ÀÉ  123 \u2028 a\x0bb"), (21, "For " * 3000), (22, "a\u0301 e\n\u0301")]
    t = Tokenizer.from_file(TOKENIZER)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for _, x in ordered]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(ordered, ids, strict=True))
    got = tokens.encode(documents(rows), TOKENIZER, tokens.Grammar(block_tokens=5000, least=4)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    places = [r.start for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))]
    assert places == sorted(places)
    assert tokens.encode(documents([]), TOKENIZER).collect() == []


def test_grammar_random_access():
    rng = np.random.default_rng(0)
    docs = [np.append(np.repeat(rng.integers(0, 40, 30), rng.integers(1, 9, 30)), 2) for _ in range(50)]
    lens = np.array([len(d) for d in docs])
    block = tokens.Block(tokens.pack(list(range(50)), lens, np.concatenate(docs).astype(np.uint16), 49408, tokens.Grammar(least=3)))
    assert len(block.rules) and len(block.symbols) < lens.sum()
    assert (block.decode() == np.concatenate(docs)).all()
    for k in (0, 7, 49):
        assert (block.decode(k, k + 1) == docs[k]).all()


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    runs = [rng.integers(3, 9, rng.integers(1, 40)) for _ in range(60)] + [np.full(500, 7), np.tile([4, 5, 6], 90)]
    lens = np.array([len(d) for d in runs])
    for first in (10, (1 << 16) - 5):  # the second one's rules need wide symbols
        symbols, rules, cut = tokens.repair(np.concatenate(runs).astype(np.uint16), np.cumsum(lens), first, tokens.Grammar(least=4))
        ends = set((cut - 1).tolist())
        places = {}
        for k in range(len(symbols) - 1):
            pair = (symbols[k], symbols[k + 1])
            if k not in ends and places.get(pair, [-2])[-1] != k - 1:
                places.setdefault(pair, []).append(k)
        assert max(map(len, places.values())) < 4 and len(rules) > 20 and max(symbols) >= first
        record = tokens.pack(list(range(len(runs))), lens, np.concatenate(runs).astype(np.uint16), first, tokens.Grammar(least=4))
        assert (tokens.Block(record).decode() == np.concatenate(runs)).all()
        assert tokens.Block(record).rules.dtype.itemsize == (2 if first == 10 else 4)


def test_tokenizer_of_another_form(tmp_path):
    import json

    import pyarrow as pa

    spec = json.loads(open(TOKENIZER).read())
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    other, own = tokens.encoder(str(tmp_path / "t.json")), tokens.encoder(TOKENIZER)
    assert own.fast and not other.fast
    texts = ["It's Ünder  way", None, "", "12 a\u0301 <|endoftext|> it'sx -'s"]
    for codec in (own, other):
        ((ids, n),) = codec.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in codec.tokenizer.encode(t or "", add_special_tokens=False).ids]
        assert n.tolist() == [len(codec.tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_tokens_of_hot_ids(spark, documents):
    """Rows without an id, and rows that share one, are dealt over all parts."""
    rows = documents([(None if i % 3 else 7, f"text {i % 50}") for i in range(6000)])
    written = tokens.write_tokens(rows, TOKENIZER, tokens.Grammar(block_tokens=500)).collect()
    per = Counter()
    for r in written:
        per[r.part] += r.n_tokens
    assert max(per.values()) < 0.5 * sum(per.values())
    got = tokens.encode(rows, TOKENIZER).collect()
    assert len(got) == 6000 and sum(r.n_tokens for r in got) == sum(per.values())


# repeats


def test_repeats_match_brute_force(documents):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(60):
        w = [f"u{rng.randrange(30)}" for _ in range(rng.randrange(0, 90))]
        if k % 3 == 0:
            a = rng.randrange(0, 25)
            w[rng.randrange(len(w) + 1) : 0] = passage[a : a + rng.choice([34, 35, 36])]
        if k % 7 == 0:
            w = w + ["same"] * rng.choice([34, 35, 36, 80])
        texts.append("  ".join(w))
    texts += [texts[3], texts[3].replace("  ", "\n")]
    rows = list(enumerate(texts))
    words = {i: t.split() for i, t in rows}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    # groups of all sizes: by chunks, by longer prefixes, by whole windows
    for got in (substrings.remove_repeats(documents(rows), substrings.Repeats(35)).collect(), substrings.remove_repeats(documents(rows), substrings.Repeats(35, group=6), with_text=True).collect(), substrings.remove_repeats(documents(rows), substrings.Repeats(35, group=0)).collect()):
        assert len(got) == len(rows)
        for r in got:
            w = words[r.doc_id]
            gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_deep_nodes():
    import pyarrow as pa

    rng = random.Random(9)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(5, 30))] for _ in range(40)]
    seen = Counter(tuple(t[k : k + 5]) for t in texts for k in range(len(t) - 4))
    got = substrings.deep_nodes(pa.array([" ".join(t).encode() for t in texts], pa.binary()), np.array([len(t) - 4 for t in texts]), 5)
    assert got.tolist() == [seen[tuple(t[k : k + 5])] > 1 for t in texts for k in range(len(t) - 4)]


def test_repeats_of_hot_rows(documents):
    """Rows without an id, 10,000 equal rows, and one passage in many texts."""
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(None if i % 2 else 5, "w " * 3 + common + " end") for i in range(10_000)] + [(None, f"u{i} " + common + f" v{i}") for i in range(3000)] + [(-1, "alone " + " ".join(f"s{i}" for i in range(50)))]
    got = substrings.remove_repeats(documents(rows), substrings.Repeats(35, group=100)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in got} == {(5, 44, 44): 5000, (None, 44, 44): 5000, (None, 42, 40): 3000, (-1, 51, 0): 1}


def test_repeats_odd(documents, odd_rows):
    got = substrings.remove_repeats(documents(odd_rows), substrings.Repeats(35)).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[7].n_removed == by[8].n_removed == 60_000
    both = substrings.remove_repeats(documents([(1, "a b " * 40), (1, "a b " * 40)]), substrings.Repeats(35)).collect()
    assert [r.n_removed for r in both] == [80, 80]
    assert substrings.remove_repeats(documents([])).collect() == []


# media


def test_media_round_trip(documents, odd_rows):
    got = media.round_trip(documents(odd_rows)).collect()
    want = Counter()
    for i, t in odd_rows:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576) or b"\xff" * 576
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.media_sha256 for r in got if r.doc_id in (7, 8)}) == 1
    stored = {r.doc_id: bytes(r.media) for r in media.store(documents(odd_rows)).collect()}
    assert all(hashlib.sha256(stored[r.doc_id]).hexdigest() == r.media_sha256 for r in got if r.doc_id in (1, 5, 7))
    assert media.round_trip(documents([])).collect() == []


def test_ogg_refuses_damage():
    payload = bytes(range(256)) * 9 * 64
    data = media.mux(payload)
    assert media.read(data)[0] == payload
    streams = media.demux(data)
    assert len(streams) == 2 and max(s.pages for s in streams.values()) > 2
    rng = random.Random(0)
    for _ in range(40):
        k = rng.randrange(len(data))
        with pytest.raises(media.OggError):
            media.demux(data[:k] + bytes([data[k] ^ 1 << rng.randrange(8)]) + data[k + 1 :])
    first = data.index(b"OggS", 4)
    for broken in (data[first:], data[:-5], data + data[:first], data[:first] + data[data.index(b"OggS", first + 4) :]):
        with pytest.raises(media.OggError):
            media.demux(broken)


def test_ogg_packets_of_all_lengths():
    s = media._Stream(5)
    packets = [b"a" * n for n in (0, 1, 254, 255, 256, 510, 70_000, 255 * 255, 3)]
    pages = []
    for k, p in enumerate(packets):
        pages += s.put(p, k)
    pages.append(s.flush(last=True))
    found = media.demux(b"".join(pages))[5]
    assert found.packets == packets and found.granules[-1] == len(packets) - 1
    assert media.ogg_crc(b"") == 0
