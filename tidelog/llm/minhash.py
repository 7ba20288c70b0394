"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``tuples`` hashes of ``width`` minima each are computed; every pair of one from each collection is
a table key, so ``tuples ** 2`` tables of ``2 * width`` minima cost only ``2 * tuples * width`` minima. A half that no
other document shares can't be in a shared key, so pairs are formed from shared halves only. Candidates that meet in
a table are verified on full shingle sets.

Only connectivity is asked for, and equal sets are one node. Most links come from stars: in each table's bucket all
members are compared with one of them, twice with different ones. What is still apart in a bucket is then compared
member by member, by sketches of 64 minima, in tasks of bounded size that emit no more edges than members; whatever
may be alike thus comes into one cluster. In clusters that hold several components, full sets are compared by their
rarest shingles, block against block; tasks emit links, never pairs. No bucket is capped. A pair at the threshold meets
in no table with a probability of (1 - threshold ** width) ** tuples, about, twice: 0.0004 at the defaults; its
sketches differ too much with a probability of 0.00001.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, mix, run_hashes, text_blocks, tidy, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class MinHash:
    """shingle: words in one; percent: least 100 * intersection / union; tuples, width: see above."""

    shingle: int = 5
    percent: int = 80
    tuples: int = 12
    width: int = 3


def shingle_sets(column: pa.Array, length: int):
    """For each text its distinct shingles as sorted hashes. Fewer words than ``length`` are one shingle; no words, none."""
    for _, data, offsets in text_blocks(column):
        words, at = word_hashes(data, offsets, fold=True)
        runs = run_hashes(words, length)
        for i in range(len(at) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= length:
                yield np.unique(runs[a : b - length + 1])
            elif b > a:
                yield run_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _minima(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """Rows: sets (none empty); columns: their least value under each multiplicative hash."""
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    out = np.empty((len(sets), len(factors)), np.uint64)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(values * f, begin)
    return out


def _features(p: MinHash):
    count = 2 * p.tuples * p.width
    factors = mix(np.arange(1, count + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    salts = mix(np.arange(1, 2 * p.tuples + 1, dtype=np.uint64))

    def of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(sets)
        halves = np.zeros((n, 2 * p.tuples), np.uint64)
        sketch = np.zeros((n, 4), np.uint64)
        ids = np.zeros((n, 2), np.uint64)
        full = [i for i in range(n) if len(sets[i])]
        at = 0
        while at < len(full):
            to, size = at, 0
            while to < len(full) and (to == at or size + len(sets[full[to]]) <= 1 << 16):
                size += len(sets[full[to]])
                to += 1
            rows = full[at:to]
            group = [sets[i] for i in rows]
            least = mix(_minima(group, factors))
            tuples = np.zeros((len(rows), 2 * p.tuples), np.uint64)
            for w in range(p.width):
                tuples = mix(tuples * _U(31) + least[:, w :: p.width][:, : 2 * p.tuples])
            halves[rows] = mix(tuples ^ salts)
            bits = np.zeros((len(rows), 4), np.uint64)
            for j in range(64):
                for b in range(4):
                    bits[:, b] |= ((least[:, j % count] >> _U(b)) & _U(1)) << _U(j)
            sketch[rows] = bits
            begin = np.cumsum([0] + [len(s) for s in group[:-1]])
            values = np.concatenate(group)
            lens = np.array([len(s) for s in group], np.uint64)
            for k in (0, 1):
                ids[rows, k] = mix(np.add.reduceat(mix(values + _U(k + 1)), begin) + lens)
            at = to
        return halves, sketch, ids

    @tidy
    def run(batches):
        for batch in batches:
            texts = batch.column(3)
            sets = []
            rows = []
            for s in shingle_sets(texts, p.shingle):
                sets.append(s)
                if sum(map(len, sets[-64:])) > 1 << 18 or len(sets) >= 1024:
                    rows.append((np.array([len(x) for x in sets], np.int64), *of(sets)))
                    sets = []
            if sets:
                rows.append((np.array([len(x) for x in sets], np.int64), *of(sets)))
            if not rows:
                continue
            n, halves, sketch, sid = (np.concatenate([r[k] for r in rows]) for k in range(4))
            flat = pa.array(halves.view(np.int64).ravel())
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * p.tuples))
            s = sketch.view(np.int64)
            g = sid.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(n), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.ListArray.from_arrays(ends, flat), *(pa.array(s[:, k]) for k in range(4))], ["doc_id", "t0", "t1", "n_shingles", "g0", "g1", "halves", "s0", "s1", "s2", "s3"])

    return run


def _sets(length: int):
    @tidy
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1), length)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _linked(percent: int):
    @tidy
    def run(batches):
        for batch in batches:
            a, b = batch.column("x_set"), batch.column("y_set")
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column("x").take(pa.array(keep)), batch.column("y").take(pa.array(keep))], ["u", "v"])

    return run


def _forest(batches):
    """Of the edges of one task: each node with the least node it reaches there, the least ones themselves left out."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([x for e in ends for x in e]), return_inverse=True)
    sizes = np.cumsum([0] + [len(e[0]) for e in ends])
    u = np.concatenate([at[2 * lo : lo + hi] for lo, hi in zip(sizes, sizes[1:], strict=False)])
    v = np.concatenate([at[lo + hi : 2 * hi] for lo, hi in zip(sizes, sizes[1:], strict=False)])
    root = np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["u", "v"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, most: int = 1_000_000) -> DataFrame:
    """Connected components of (u, v): rows (node, component), the least node each reaches.

    Tasks first reduce their own edges to stars. While more than ``most`` edges are left, large-star and small-star
    steps alternate, in which hubs meet partial aggregates and joins that can be split; what is left in the end, at
    most ``most`` edges, one task settles.
    """
    shape = "u long, v long"
    e = scratch.keep(edges.where("u <> v").select("u", "v").mapInArrow(_forest, shape).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= most:
            e = scratch.keep(e.coalesce(1).mapInArrow(_forest, shape), "stars")
            break
        if now == seen:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = _rejoin(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = scratch.keep(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        least = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = _rejoin(e, least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        e = scratch.keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _rejoin(rows: DataFrame, by_key: DataFrame, name: str) -> DataFrame:
    """Join aggregates back by a digest of the key: both sides are exchanged, so a hot key can be split at run time."""
    return rows.withColumn("_d", F.xxhash64(F.lit(7), name)).join(by_key.withColumn("_d", F.xxhash64(F.lit(7), "k")), "_d").where(F.col(name) == F.col("k")).drop("_d", "k")


_BLOCK_ROWS = 4096  # members of a bucket compared at a time
_BLOCK_BYTES = 16 << 20  # of shingle sets compared at a time


def _likely(percent: int) -> int:
    """Of 64 minima compared in four bits, as many as a pair at the threshold has, but for one in 100,000."""
    q = percent / 100 + (1 - percent / 100) / 16
    return max(0, math.floor(64 * q - 4.5 * math.sqrt(64 * q * (1 - q))))


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes allow a link, and so do the minima."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = F.lit(0).cast("long")
    for k in range(4):
        differ = differ.bitwiseOR(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}")))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (64 - F.bit_count(differ) >= _likely(percent))


def _groups(batches):
    """Rows of sorted batches, group by group; the first column tells groups apart."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and key[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key[lo]
    if held:
        yield pa.Table.from_batches(held)


def _near(percent: int):
    """Edges that bring all members of a bucket's blocks together that may be alike, where their components differ."""
    least = _likely(percent)

    @tidy
    def run(batches):
        for t in _groups(batches):
            node, n, label, block = (t.column(c).to_numpy() for c in ("node", "n", "label", "block"))
            sketch = np.stack([t.column(f"s{k}").to_numpy() for k in range(4)], 1).view(np.uint64)
            first = block == block.min()
            rows, found = np.flatnonzero(first), []
            names, label = np.unique(label, return_inverse=True)
            if len(names) < 2:
                continue
            to = np.arange(len(node)) if first.all() else np.flatnonzero(~first)
            label = label.copy()
            for lo in range(0, len(rows), 512):
                part = rows[lo : lo + 512]
                differ = np.zeros((len(part), len(to)), np.uint64)
                for k in range(4):
                    differ |= sketch[part, k][:, None] ^ sketch[to, k][None, :]
                ok = 64 - np.bitwise_count(differ).astype(np.int16) >= least
                a, b = n[part][:, None], n[to][None, :]
                ok &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                for r, x in enumerate(part.tolist()):
                    other = to[ok[r]]
                    apart = np.unique(label[other])
                    for z in apart[apart != label[x]].tolist():
                        y = int(other[np.argmax(label[other] == z)])
                        found.append((node[x], node[y]))
                    if len(apart):
                        label[np.isin(label, apart)] = label[x]
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _blocks(sets: DataFrame, facts: DataFrame, clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of clusters with several components, dealt into pairs of blocks: (those outside the largest one) x (all)."""
    rows = clusters.select("node", F.col("component").alias("cluster")).join(labels.select("node", F.col("component").alias("own")), "node", "left").withColumn("label", F.coalesce("own", "node")).drop("own")
    rows = rows.join(facts.select("node", (F.col("n") * 8 + 64).alias("size")), "node")
    parts = rows.groupBy("cluster", "label").agg(F.sum("size").alias("c"))
    whole = parts.groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    whole = whole.select(F.col("cluster").alias("k"), F.col("most.label").alias("largest"), F.ceil(F.col("n") / _BLOCK_BYTES).alias("blocks"), F.ceil((F.col("n") - F.col("most.c")) / _BLOCK_BYTES).alias("rest"))
    dealt = _rejoin(rows, whole, "cluster").join(sets, "node")
    place = F.xxhash64(F.lit(5), "node")
    outer = dealt.where("label <> largest").withColumn("i", F.pmod(place, F.col("rest"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = dealt.withColumn("j", F.pmod(place, F.col("blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)))
    columns = [F.xxhash64("cluster", "i", "j").alias("group"), "node", "label", "shingles"]
    return outer.select(*columns, F.lit(True).alias("outer")).unionByName(every.select(*columns, F.lit(False).alias("outer")))


def links_between(outer: list[np.ndarray], every: list[np.ndarray], own: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (index in ``outer``, index in ``every``) of different labels with the similarity, as many as connect the labels.

    Of two sets that are alike one of the rarest ``n - ceil(n * percent / 100) + 1`` shingles of either is shared, in
    any one order of rarity; only sets that share one are compared in full.
    """
    lens = np.array([len(s) for s in every])
    names, number, common = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rarity = np.empty(len(names), np.int64)
    rarity[np.argsort(common, kind="stable")] = np.arange(len(names))
    begin = np.cumsum(lens) - lens
    ranks = rarity[number]
    owner = np.repeat(np.arange(len(every)), lens)
    order = np.lexsort((ranks, owner))
    nth = np.arange(len(order)) - np.repeat(begin, lens)
    keep = lens - -(-lens * percent // 100) + 1
    head = order[nth < np.repeat(keep, lens)]
    shelf = np.argsort(ranks[head], kind="stable")
    indexed, holders = ranks[head][shelf], owner[head][shelf]
    label, found = label.copy(), []
    for r, x in enumerate(outer):
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        mine = np.where(names[at] == x, rarity[at], -1)
        least = np.sort(mine)[: len(x) - -(-len(x) * percent // 100) + 1]  # unknown shingles are the rarest
        least = least[least >= 0]
        lo, hi = np.searchsorted(indexed, least, "left"), np.searchsorted(indexed, least, "right")
        n = hi - lo
        near = np.unique(holders[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        near = near[(label[near] != own[r]) & (100 * np.minimum(lens[near], len(x)) >= percent * np.maximum(lens[near], len(x)))]
        if not len(near):
            continue
        size = lens[near]
        held = ranks[np.repeat(begin[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        known = np.zeros(len(names), bool)
        known[mine[mine >= 0]] = True
        both = np.add.reduceat(known[held], np.cumsum(size) - size, dtype=np.int64)
        linked = near[100 * both >= percent * (len(x) + size - both)]
        for z in np.unique(label[linked]).tolist():
            found.append((r, int(linked[np.argmax(label[linked] == z)])))
    return found


def _compared(percent: int):
    @tidy
    def run(batches):
        for t in _groups(batches):
            outer = t.column("outer").to_numpy()
            node, label = t.column("node").to_numpy(), t.column("label").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("shingles").chunks for x in c]
            one, two = np.flatnonzero(outer), np.flatnonzero(~outer)
            if not len(one) or not len(two):
                continue
            found = links_between([sets[k] for k in one], [sets[k] for k in two], label[one], label[two], percent)
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[one[u]]), pa.array(node[two[v]])], ["u", "v"])

    return run


_ROW = ["doc_id", "t0", "t1"]


def _grouped(texts: DataFrame, p: MinHash, scratch: Scratch) -> DataFrame:
    """For each row (doc_id, t0, t1, text): doc_id, t0, t1, n_shingles, component, component_id.

    ``t0`` and ``t1`` tell rows with one doc_id apart. Rows with equal shingle sets are one node; ``component`` is a
    number of the group, null for rows without shingles, and ``component_id`` the least doc_id in it.
    """
    schema = "doc_id long, t0 long, t1 long, n_shingles long, g0 long, g1 long, halves array<long>, s0 long, s1 long, s2 long, s3 long"
    features = scratch.keep(texts.select(*_ROW, "text").mapInArrow(_features(p), schema), "features")
    firsts = [F.first(c).alias(c) for c in ("halves", "s0", "s1", "s2", "s3")]
    classes = features.where("n_shingles > 0").groupBy("g0", "g1").agg(F.min("doc_id").alias("rep"), F.min(F.struct(*_ROW)).alias("one"), F.first("n_shingles").alias("n"), *firsts)
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    half = classes.select("node", F.posexplode("halves").alias("at", "h"))
    shared = half.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("k"))
    left = _rejoin(half, shared, "h").groupBy("node").agg(F.collect_set(F.when(F.col("at") < p.tuples, F.col("h"))).alias("a"), F.collect_set(F.when(F.col("at") >= p.tuples, F.col("h"))).alias("b"))
    keyed = left.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b")).select("node", F.xxhash64("a", "b").alias("key"))
    facts = classes.select("node", "n", "s0", "s1", "s2", "s3")
    keyed = scratch.keep(keyed.join(facts, "node"), "tables")
    # one text of each class that met others
    one = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("_d"), F.isnull("doc_id").alias("_z"), "t0", "t1"]
    wanted = keyed.select("node").distinct().join(classes.select("node", "one.*"), "node").select("node", *one)
    met = texts.select(*one, "text").join(wanted, ["_d", "_z", "t0", "t1"]).dropDuplicates(["_d", "_z", "t0", "t1"])
    sets = scratch.keep(met.select("node", "text").mapInArrow(_sets(p.shingle), "node long, shingles binary"), "sets", "none")

    def labelled(*edges: DataFrame) -> DataFrame:
        every = edges[0]
        for e in edges[1:]:
            every = every.unionByName(e)
        return scratch.keep(components(every, scratch), "components")

    def stars(labels: DataFrame) -> DataFrame:
        return labels.select(F.col("node").alias("u"), F.col("component").alias("v"))

    def with_label(labels: DataFrame) -> DataFrame:
        return keyed.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    labels = texts.sparkSession.createDataFrame([], "node long, component long")
    x = sets.select(F.col("node").alias("x"), F.col("shingles").alias("x_set"))
    y = sets.select(F.col("node").alias("y"), F.col("shingles").alias("y_set"))
    member = ["node", "n", "s0", "s1", "s2", "s3", "label"]
    for turn in range(2):  # a star around one member of each bucket, another member the second time
        now = with_label(labels)
        pick = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("o"), *member)).alias("lead")
        lead = now.groupBy("key").agg(pick, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"), "lead")
        pairs = _rejoin(now.select("key", F.struct(*member).alias("own")), lead, "key").where("own.label <> lead.label").where(_alike("own", "lead", p.percent))
        pairs = pairs.select(F.least("own.node", "lead.node").alias("x"), F.greatest("own.node", "lead.node").alias("y")).distinct()
        links = pairs.join(x, "x").join(y, "y").mapInArrow(_linked(p.percent), "u long, v long")
        labels = labelled(stars(labels), links)

    now = with_label(labels)
    mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / _BLOCK_ROWS).alias("blocks")).where("lo <> hi").select(F.col("key").alias("k"), "blocks")
    dealt = _rejoin(now, mixed, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("group"), "block", *member)
    near = _in_groups(dealt).mapInArrow(_near(p.percent), "u long, v long")
    clusters = labelled(stars(labels), near)
    rest = _in_groups(_blocks(sets, facts, clusters, labels)).mapInArrow(_compared(p.percent), "u long, v long")
    labels = labelled(stars(labels), rest)

    of_class = classes.select("g0", "g1", "rep", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = of_class.groupBy("component").agg(F.min("rep").alias("component_id")).select(F.col("component").alias("k"), "component_id")
    of_class = of_class.join(named, F.col("component") == F.col("k")).select("g0", "g1", "component", "component_id")
    return features.select(*_ROW, "n_shingles", "g0", "g1").join(of_class, ["g0", "g1"], "left").select(*_ROW, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _in_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group")


def near_duplicates(docs: DataFrame, params: MinHash = MinHash(), scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, component_id, kept.

    A null or empty text, or one without words, has no shingles and is linked with nothing. Texts are taken whole,
    however long. Each row is a document: rows that share a doc_id have their own texts' groups. A null doc_id is a
    document like any other, but no group is named by it; a group without any doc_id has a null component. Equal rows
    and equal shingle sets never form pairs: they are members of one class. All rows with the least doc_id of a group
    are kept. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("t0", F.xxhash64("text")).withColumn("t1", F.xxhash64(F.lit(1), "text"))
    out = _grouped(texts, params, scratch).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, params: MinHash = MinHash(), scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, that are left when one row of each group of near copies stays.

    It is the row with the least doc_id, rows without one last; of several such rows with different texts or other
    columns the least by hash. Rows without words are copies of nothing and stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), *docs.columns).alias("t1"))
    found = _grouped(rows, params, scratch)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "t0", "t1")).alias("one"))
    first = first.select(F.coalesce("one.doc_id", F.lit(0)).alias("_d"), F.col("one.z").alias("_z"), F.col("one.t0").alias("_t0"), F.col("one.t1").alias("_t1"))
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    id_ = F.col("_row.doc_id").cast("long")
    keyed = whole.withColumns({"_d": F.coalesce(id_, F.lit(0)), "_z": F.isnull(id_), "_t0": F.xxhash64(F.col("_row.text").cast("string")), "_t1": F.xxhash64(F.lit(1), *(F.col("_row").getField(c) for c in docs.columns))})
    key = ["_d", "_z", "_t0", "_t1"]
    some = keyed.join(first, key, "left_semi").dropDuplicates(key).select("_row.*")
    return some.unionByName(docs.where(~F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))))
