"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) and benchmark items are TF-IDF vectors over hashed words; document frequencies are counted
over all documents. A randomised SVD, whose products with the passage matrix are computed by tasks, gives the latent
space; the items and the passages of all documents make up the matrix, items weighted so that the space holds them. All
passages are then projected, block by block, and candidates are those with a cosine of at least ``cosine`` to an item.
The space has fewer dimensions than a large benchmark has items, so that it may not hold all of them; a second search by
words finds every passage whose surroundings can pass the comparison, whatever the number of items. A candidate's
surroundings are compared with the item's words by longest common subsequence; one that covers most of the item is a
leak, one that covers part of it is a leak if the item's answer (its last part) is there too, so that paraphrases are
caught and shared phrases are not.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, text_blocks, tidy, word_hashes

_U = np.uint64
_CHUNK = 256  # blocks projected at a time
_CUTS = 32  # pieces of a matrix that is summed
_WIDE = 32  # rows added at a time
_SUMS = 64  # such sums at a time
_PASSAGES = 1 << 15  # passages multiplied at a time
_FLAGS = 20  # bits of a word's hash that tell most other words from an item's


@dataclass(frozen=True)
class Latent:
    """window: words of a passage, twice the stride; bits: of the word hash; rank: of the space; sample: documents that all documents weigh as much as, at most, against the items.

    covered: LCS share of an item's words that is a leak; partly, answer: shares of the item and of its last ``tail``
    that are one together. block: items compared at a time.
    """

    window: int = 32
    bits: int = 14
    rank: int = 96
    sample: int = 2000
    cosine: float = 0.2
    covered: float = 0.75
    partly: float = 0.55
    tail: float = 0.34
    answer: float = 0.7
    block: int = 50_000
    short: int = 8
    seed: int = 11


def _buckets(words: np.ndarray, p: Latent) -> np.ndarray:
    return (words >> _U(64 - p.bits)).astype(np.int64)


def _kind(p: Latent) -> np.dtype:
    return np.dtype(np.uint16 if p.bits <= 16 else np.uint32)


def _ordered(group: np.ndarray, buckets: np.ndarray, p: Latent) -> np.ndarray:
    """Pairs (group, bucket) as sorted numbers, of 4 bytes where they fit; groups ascend."""
    pair = group << p.bits | buckets
    return np.sort(pair.astype(np.uint32) if len(pair) and (int(group[-1]) + 1) << p.bits <= 1 << 32 else pair)


def _passages(at: np.ndarray, p: Latent) -> np.ndarray:
    """First words of the passages side by side, for texts whose words begin at ``at``."""
    n = -(-np.diff(at) // p.window)
    return np.repeat(at[:-1], n) + p.window * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def _hashed(p: Latent):
    low = (1 << p.bits) - 1

    def run(batches):
        count, docs = np.zeros(1 << p.bits, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for _, data, offsets in text_blocks(batch.column(0)):
                words, at = word_hashes(data, offsets, fold=True)
                b = _buckets(words, p)
                pair = _ordered(np.repeat(np.arange(len(at) - 1), np.diff(at)), b, p)
                new = np.ones(len(pair), bool)
                new[1:] = pair[1:] != pair[:-1]
                count += np.bincount(pair[new] & low, minlength=1 << p.bits)
                begin = _passages(at, p)
                b = (_ordered(np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(b)))), b, p) & low).astype(_kind(p))
                texts = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * b.itemsize).astype(np.int32)), pa.py_buffer(b)])
                none = pa.nulls(len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, texts], ["bucket", "n", "words"])
        where = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, -1)), pa.array(np.append(count[where], docs)), pa.nulls(len(where) + 1, pa.binary())], ["bucket", "n", "words"])

    return tidy(run)


def hashed_words(docs: DataFrame, p: Latent) -> DataFrame:
    """A scratch table of each text's hashed words, sorted within passages, and of the texts a task has for each bucket (-1: at all)."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_hashed(p), "bucket long, n long, words binary")
    return Scratch(docs.sparkSession, "decontam").keep(found, "words")


def document_frequencies(hashed: DataFrame, p: Latent) -> tuple[np.ndarray, int]:
    """Documents with each hashed word, and documents at all; each task has a row for each bucket at most."""
    found = hashed.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << p.bits) + 1, np.int64)
    for r in found:
        df[r.bucket] += r.n
    return df[:-1], int(df[-1])


def _sparse(texts: pa.Array, idf: np.ndarray, p: Latent) -> list[tuple[np.ndarray, np.ndarray]]:
    """TF-IDF rows of unit length, of texts with words."""
    rows = []
    for _, data, offsets in text_blocks(texts):
        words, at = word_hashes(data, offsets, fold=True)
        b = _buckets(words, p)
        for i in np.flatnonzero(np.diff(at)):
            ids, n = np.unique(b[at[i] : at[i + 1]], return_counts=True)
            x = n * idf[ids]
            rows.append((ids, x / max(1e-9, np.sqrt((x * x).sum()))))
    return rows


def _product(rows, right: np.ndarray) -> np.ndarray:
    """X' X right, for sparse rows X."""
    out = np.zeros_like(right)
    for ids, x in rows:
        out[ids] += np.outer(x, x @ right[ids])
    return out


def _row_sums(rows: np.ndarray, index: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of rows[index] from each place in ``begin`` to the next: _WIDE rows at a time, then these sums in turn."""
    size = np.diff(np.append(begin, len(index)))
    while True:
        n = -(-size // _WIDE)
        first = np.cumsum(n) - n
        total = int(n.sum())
        place = np.full(total * _WIDE, len(rows), np.int64)
        place[np.arange(len(index)) + np.repeat(first * _WIDE - begin, size)] = index
        place = place.reshape(total, _WIDE)
        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])  # for the places that are left
        out = np.empty((total, rows.shape[1]), rows.dtype)
        part = np.empty((_SUMS * _WIDE, rows.shape[1]), rows.dtype)
        for k in range(0, total, _SUMS):
            at = place[k : k + _SUMS].T
            np.take(rows, at.ravel(), axis=0, out=part[: at.size], mode="clip")
            np.sum(part[: at.size].reshape(*at.shape, -1), axis=0, out=out[k : k + _SUMS])
        if total == len(size):
            return out
        rows, index, begin, size = out, np.arange(total), first, n


def _passage_product(column: pa.Array, idf: np.ndarray, right: np.ndarray, p: Latent) -> np.ndarray:
    """X' X right of the TF-IDF passages of unit length, for texts as hashed words."""
    total = np.zeros(right.shape)
    weighted = (right * idf[:, None]).astype(np.float32)
    for _, data, offsets in text_blocks(column):
        listed = data.view(_kind(p))
        starts = _passages(offsets // listed.itemsize, p)
        ends = np.append(starts, len(listed))
        for k in range(0, len(starts), _PASSAGES):
            begin = starts[k : k + _PASSAGES] - starts[k]
            words = listed[starts[k] : ends[min(k + _PASSAGES, len(starts))]]
            new = np.ones(len(words), bool)
            new[1:] = words[1:] != words[:-1]
            new[begin] = True
            run = np.flatnonzero(new)
            x = np.diff(np.append(run, len(words))) * idf[words[run]]
            square = np.add.reduceat(x * x, np.searchsorted(run, begin)).astype(np.float32)
            z = _row_sums(weighted, words, begin) / np.maximum(square, np.float32(1e-18))[:, None]
            order = np.argsort(words, kind="stable")
            words, passage = words[order], np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(words))))[order]
            first = np.flatnonzero(np.diff(words.astype(np.int64), prepend=-1))
            total[words[first]] += _row_sums(z, passage, first)
    return (total * idf[:, None]).astype(np.float32)


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    parts = parts.sort_values("z")  # sums do not depend on the order of arrival
    total = sum(np.frombuffer(z, np.float32).astype(np.float64) for z in parts["z"])
    return pd.DataFrame({"k": parts["k"].iloc[:1], "z": [total.tobytes()]})


def latent_space(hashed: DataFrame, n: int, items: pa.Array, idf: np.ndarray, p: Latent) -> np.ndarray:
    """Right singular vectors (buckets x rank) of the passages of all ``n`` documents and of the items, by randomised subspace iteration."""
    rng = np.random.default_rng(p.seed)
    size = 1 << p.bits
    own = [(i, 24 * x) for i, x in _sparse(items, idf, p)]
    weight = min(1.0, p.sample / max(1, n))
    # each task sends a matrix, so that their number goes by the cores and not by the table
    passages = hashed.where("words is not null").select("words").coalesce(4 * hashed.sparkSession.sparkContext.defaultParallelism)
    basis = rng.standard_normal((size, p.rank + 8)).astype(np.float32)
    for _ in range(2):
        basis, _ = np.linalg.qr(basis)
        right = basis.astype(np.float32)

        def part(batches, right=right):
            total = None
            for batch in batches:
                z = _passage_product(batch.column(0), idf, right, p)
                total = z if total is None else total + z
            if total is not None:
                cuts = [x.tobytes() for x in np.split(total, _CUTS)]
                yield pa.RecordBatch.from_arrays([pa.array(range(_CUTS), pa.int32()), pa.array(cuts, pa.binary())], ["k", "z"])

        basis = _product(own, right).astype(np.float64)
        summed = passages.mapInArrow(tidy(part), "k int, z binary").groupBy("k").applyInPandas(_summed, "k int, z binary")
        rows = basis.reshape(_CUTS, -1)
        for r in summed.collect():  # one matrix of a fixed size
            rows[r.k] += weight * np.frombuffer(r.z, np.float64)
    basis, _ = np.linalg.qr(basis)
    small = np.zeros((basis.shape[1],) * 2)
    for ids, x in own:
        y = x @ basis[ids]
        small += np.outer(y, y)
    _, turn = np.linalg.eigh(small)
    return (basis @ turn[:, ::-1][:, : p.rank]).astype(np.float32)


def _places(item: list[int]) -> dict[int, int]:
    """Each word's places in the item, as bits."""
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    return where


def lcs(item: list[int], words: list[int], where: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, in bit-parallel steps."""
    full = (1 << len(item)) - 1
    v = full
    for m in filter(None, map((where or _places(item)).get, words)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class RareWords:
    """The rarer words of each item, of which every passage with an LCS share of ``partly`` has at least ``least`` nearby.

    An LCS of ``need`` words leaves out at most len(item) - need; so of any words of the item that make up
    len(item) - need + least, it holds ``least`` at least, each at a position of its own.
    """

    def __init__(self, items: list[list[int]], idf: np.ndarray, p: Latent):
        least, span, found = [], [], []
        for i, item in enumerate(items):
            n = len(item)
            if n < p.short:
                keys, some, wide = set(item), n, n
            else:
                need = next(k for k in range(n + 1) if k / n >= p.partly)
                some, wide, keys, mass = max(1, need // 3), p.window + 2 * n, [], 0
                count = Counter(item)
                for w in sorted(count, key=lambda w: (-idf[w >> (64 - p.bits)], w)):
                    if mass >= n - need + some:
                        break
                    keys.append(w)
                    mass += count[w]
            least.append(some)
            span.append(wide)
            found += [(w, i) for w in keys]
        found.sort()
        self.least, self.span = np.array(least, np.int64), np.array(span, np.int64)
        self.words, self.first = np.unique(np.array([w for w, _ in found], np.uint64), return_index=True)
        self.count = np.diff(np.append(self.first, len(found)))
        self.items = np.array([i for _, i in found], np.int64)
        self.flags = np.zeros(1 << _FLAGS, bool)
        self.flags[self.words >> _U(64 - _FLAGS)] = True

    def runs(self, words: np.ndarray, doc: np.ndarray):
        """Arrays (item, first position, last position) of ``least`` neighbouring rare words of an item within its span."""
        hit = np.flatnonzero(self.flags[words >> _U(64 - _FLAGS)])
        k = np.minimum(np.searchsorted(self.words, words[hit]), len(self.words) - 1)
        met = self.words[k] == words[hit]
        hit, k = hit[met], k[met]
        n = self.count[k]
        item = self.items[np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(item.astype(np.uint16) if len(self.least) <= 1 << 16 else item, kind="stable")
        item, at = item[order], np.repeat(hit, n)[order]
        last = np.arange(len(item)) + self.least[item] - 1
        begin = np.flatnonzero(last < len(item))
        last = last[begin]
        close = (item[last] == item[begin]) & (doc[at[last]] == doc[at[begin]]) & (at[last] - at[begin] < self.span[item[begin]])
        begin, last = begin[close], last[close]
        return item[begin], at[begin], at[last]


@dataclass
class Index:
    """Items in the latent space, and what a passage needs to be projected; the last row of ``weights`` is of no word."""

    params: Latent
    weights: np.ndarray
    idf: np.ndarray
    items: np.ndarray
    words: list[list[int]]
    ids: list
    sizes: np.ndarray
    rare: RareWords

    def candidates(self, words: np.ndarray, at: np.ndarray):
        """(text, first word of the passage, item, cosine) of the passages near an item."""
        p = self.params
        step = p.window // 2
        lens = np.diff(at)
        blocks = np.where(lens > 0, -(-lens // step), 0)
        if not blocks.sum():
            return
        doc = np.repeat(np.arange(len(lens)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = at[doc] + nth * step
        b = _buckets(words, p)
        square = np.add.reduceat(self.idf[b] ** 2, begin)
        for k in range(0, len(begin), _CHUNK):
            to = min(k + _CHUNK + 1, len(begin))  # one block more, for the last passage
            stop = int(begin[to]) if to < len(begin) else len(words)
            inside = np.arange(step)[:, None] < np.diff(np.append(begin[k:to], stop))
            part = self.weights.take(np.where(inside, b[np.minimum(begin[k:to] + np.arange(step)[:, None], len(b) - 1)], len(self.weights) - 1), axis=0).sum(axis=0)
            norm, pair, same = square[k:to].copy(), part.copy(), doc[k + 1 : to] == doc[k : to - 1]
            pair[:-1][same] += part[1:][same]
            norm[:-1][same] += square[k + 1 : to][same]
            n = min(_CHUNK, len(begin) - k)
            near = pair[:n] @ self.items.T
            near /= np.sqrt(np.maximum(norm[:n], 1e-9))[:, None]
            for r, i in zip(*np.nonzero(near >= p.cosine), strict=True):
                yield int(doc[k + r]), int(begin[k + r]), int(i), float(near[r, i])

    def by_words(self, words: np.ndarray, at: np.ndarray):
        """(text, first word of the passage, item) of every passage whose surroundings may have the LCS share of a leak."""
        p = self.params
        step = p.window // 2
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        item, begin, end = self.rare.runs(words, doc)
        if not len(item):
            return []
        size, text = self.sizes[item], doc[begin]
        # passages whose surroundings hold the run
        low = np.maximum(0, -(-(end - p.window - size + 1 - at[text]) // step))
        high = np.minimum((begin + size - at[text]) // step, (at[text + 1] - at[text] - 1) // step)
        n = np.maximum(0, high - low + 1)
        nth = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        starts = np.repeat(at[text], n) + nth * step
        pair = np.unique(starts * len(self.sizes) + np.repeat(item, n))
        starts, item = np.divmod(pair, len(self.sizes))
        return zip(doc[starts].tolist(), starts.tolist(), item.tolist(), strict=True)

    def cosine(self, words: np.ndarray, start: int, end: int, i: int) -> float:
        """Of the passage of words start to end and an item."""
        b = _buckets(words[start:end], self.params)
        return float(self.weights[b].sum(axis=0) @ self.items[i] / np.sqrt(max(1e-9, (self.idf[b] ** 2).sum())))

    def leaks(self, column: pa.Array):
        """(row, item, cosine, LCS share, answer share, first word) of each item that leaks into a text."""
        p = self.params
        known: dict[int, tuple] = {}
        for row, data, offsets in text_blocks(column):
            words, at = word_hashes(data, offsets, fold=True)
            if not len(words):
                continue
            listed = None
            best: dict[tuple[int, int], tuple] = {}
            done: set[tuple[int, int]] = set()
            for d, start, i, near in chain(self.candidates(words, at), ((*x, None) for x in self.by_words(words, at))):
                item = self.words[i]
                if (start, i) in done or best.get((d, i), (0, 0))[1] == 1:
                    continue  # compared, or held whole by a passage before
                done.add((start, i))
                lo, hi = max(at[d], start - len(item)), min(at[d + 1], start + p.window + len(item))
                listed = words.tolist() if listed is None else listed
                around = listed[lo:hi]
                if i not in known:
                    known[i] = frozenset(item), Counter(item), _places(item)
                held, count, where = known[i]
                if sum(count[w] for w in held.intersection(around)) / len(item) < p.partly:
                    continue  # no subsequence is longer than the words in common
                share = lcs(item, around, where) / len(item)
                if share < p.partly:
                    continue
                if near is None and len(item) < p.short and not any(around[k : k + len(item)] == item for k in range(len(around))):
                    continue
                tail = item[-max(1, int(len(item) * p.tail)) :]
                said = lcs(tail, around) / len(tail)
                if (share >= p.covered or said >= p.answer) and share > best.get((d, i), (0, 0))[1]:
                    near = self.cosine(words, start, min(at[d + 1], start + p.window), i) if near is None else near
                    best[d, i] = (near, share, said, int(lo - at[d]))
            for (d, i), v in sorted(best.items()):
                yield row + d, i, *v


def _indexes(docs: DataFrame, benchmark: DataFrame, p: Latent):
    """Broadcast indexes of the benchmark's items, ``block`` at a time; items without words are none."""
    rows = [r for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.col("text").rlike(WORD)).orderBy("item_id", "text").toLocalIterator()]
    if not rows:
        return
    hashed = hashed_words(docs, p)
    df, n = document_frequencies(hashed, p)
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + 0.01
    for k in range(0, len(rows), p.block):
        yield docs.sparkSession.sparkContext.broadcast(build(hashed, n, rows[k : k + p.block], idf, p))


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: Latent = Latent()) -> DataFrame:
    """One row per document and item that leaks into it: doc_id, item_id, cosine, covered, answer, first_word.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored, whatever their names. The
    benchmark is the query set: the driver reads it and sends ``block`` items at a time, some 50 MB at most, to all
    passages of all documents, whole texts. Null and empty texts and items have no words and no leaks; an item of under
    ``short`` words is found where the space finds it, or as it stands; repeated rows give repeated results, and of
    passages that hold an item equally well the first counts. An empty table on either side gives an empty result. A
    null doc_id is kept.
    """
    schema = "doc_id long, item_id long, cosine double, covered double, answer double, first_word long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _indexes(docs, benchmark, params):
        found = texts.mapInArrow(_search(index), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: Latent = Latent()) -> DataFrame:
    """The rows of ``docs``, all their columns, into which no item leaks; each row is judged by its own text."""
    at, out = docs.columns.index("text"), docs
    for index in _indexes(docs, benchmark, params):
        out = out.mapInArrow(_without(index, at), docs.schema)
    return out


def _without(handle, at: int):
    def run(batches):
        for batch in batches:
            leaks = np.zeros(batch.num_rows, bool)
            for found in handle.value.leaks(batch.column(at).cast(pa.string())):
                leaks[found[0]] = True
            yield batch.filter(pa.array(~leaks))

    return run


def build(hashed: DataFrame, n: int, rows: list, idf: np.ndarray, p: Latent) -> Index:
    column = pa.array([r[1] for r in rows], pa.string())
    vectors = latent_space(hashed, n, column, idf, p)
    sparse = _sparse(column, idf, p)
    items = np.stack([x @ vectors[ids] for ids, x in sparse]).astype(np.float32)
    words = []
    for _, data, offsets in text_blocks(column):
        h, at = word_hashes(data, offsets, fold=True)
        words += [h[at[i] : at[i + 1]].tolist() for i in range(len(at) - 1)]
    weights = np.concatenate([vectors * idf[:, None], np.zeros((1, vectors.shape[1]), np.float32)])
    return Index(p, weights, idf, items, words, [r[0] for r in rows], np.array([len(w) for w in words]), RareWords(words, idf, p))


def _search(handle):
    def run(batches):
        index = handle.value
        for batch in batches:
            ids = batch.column(0)
            for row, item, near, share, said, first in index.leaks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids.slice(row, 1), pa.array([index.ids[item]], pa.int64()), pa.array([near]), pa.array([share]), pa.array([said]), pa.array([first], pa.int64())], ["doc_id", "item_id", "cosine", "covered", "answer", "first_word"])

    return run


