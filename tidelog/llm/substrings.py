"""Removal of repeated word passages, with prefix-partitioned suffix trees.

A suffix is a word position of a document, cut off at the depth of a window (``length`` words), where its fate is known.
Suffixes are split into groups by prefixes of varying length. The first split is by minimizers: each window picks the
least of its ``prefix``-word runs as its anchor, and equal windows have equal anchors. Windows side by side with one
anchor travel together, as one chunk of text. Groups with one chunk only have no inner node and end there; so do chunks
that equal another one in all their words (by 128-bit fingerprints), which are repeats as they are and send one of them
on. Groups of more than ``group`` chunks are split again, window by window, by prefixes of three times the length, and
what is still too large by the whole window; such a group is a node of the full depth, and counting its members does.

The other groups are packed, many at a time, into the memory of a task, which sorts all their suffixes by ranks of 1, 2,
4 and so on words, over words told apart exactly. Neighbours in that order that agree to the depth of a window hang from
a deep internal node: a repeat. No group is ever gathered beyond its bound, whatever its frequency.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR, Scratch, mix, powers, run_hashes, text_blocks, word_hashes, word_spans

_U = np.uint64
_SPAN, _OTHER = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25  # odd
_SHORT = np.int16
_TREE_WORDS = 1 << 20  # words of the groups that one tree takes at a time, about


@dataclass(frozen=True)
class Repeats:
    """length: words in a window; prefix: words in an anchor; group: most members of a group that one tree takes."""

    length: int = 50
    prefix: int = 6
    group: int = 4096


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by start."""
    have, n = 1, len(x)
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    step = width - have
    return (np.minimum(x[:-step], x[step:]) if step else x)[: max(0, n - width + 1)]


def _anchored(words: np.ndarray, at: np.ndarray, p: Repeats):
    """Starts of the windows that lie within one text, the anchor of each, and the anchors' fingerprints by word."""
    runs = run_hashes(words, p.prefix)
    width = p.length - p.prefix + 1
    n = len(words) - p.length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    low = _U((1 << 24) - 1)
    place = np.arange(len(runs), dtype=np.uint64)
    best = (_sliding_min((runs & ~low) | (place & low), width) & low).astype(np.int64)
    start = np.arange(n, dtype=np.int64)
    best += start & ~np.int64(low)  # places count modulo 2 ** 24
    best[best < start] += 1 << 24
    owner_end = np.repeat(at[1:], np.diff(at))
    ok = start + p.length <= owner_end[:n]
    return start[ok], best[ok], runs


def _ranges(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows with one anchor stand side by side: index of the first and of the last of each such run."""
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    return first, np.concatenate([first[1:], [len(anchors)]]) - 1


def _span_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = _SPAN) -> np.ndarray:
    """Fingerprints of the words from lo to hi - 1; another (odd) base gives another fingerprint."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + _U(base)) * powers(base, len(words)), out=total[1:])
    return mix((total[hi] - total[lo]) * powers(pow(base, -1, 1 << 64), len(words))[lo] + (hi - lo).astype(np.uint64) * _U(base))


def _anchors(p: Repeats):
    def run(batches):
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            for row, data, offsets in text_blocks(batch.column(3)):
                words, at = word_hashes(data, offsets, fold=False)
                start, anchors, runs = _anchored(words, at, p)
                if not len(anchors):
                    continue
                first, last = _ranges(anchors)
                a, lo = anchors[first], start[first]
                span = [_span_hashes(words, lo, start[last] + p.length, base) for base in (_SPAN, _OTHER)]
                context = [mix(x + (a - lo).astype(np.uint64)).view(np.int64) for x in span]
                doc = np.searchsorted(at, a, "right") - 1
                columns = [runs[a].view(np.int64), *context, *(k[row + doc] for k in keys), (lo - at[doc]).astype(np.int32), (last - first + 1).astype(_SHORT)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "c0", "c1", "t0", "t1", "d", "pos", "n"])

    return run


_CHUNK = "level int, part long, w0 long, w1 long, t0 long, t1 long, pos int, n short, words binary"


def _chunks(p: Repeats):
    """The chunks of texts as bytes, words joined by a blank; those of large groups window by window."""
    longer = min(p.length, 3 * p.prefix)

    def run(batches):
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]
            wanted = batch.column(3)
            for row, data, offsets in text_blocks(batch.column(2)):
                words, at = word_hashes(data, offsets, fold=False)
                begin, end, _ = word_spans(data, offsets)
                raw = data.tobytes()
                out: list[list] = [[] for _ in range(9)]
                for i in range(len(offsets) - 1):
                    s = wanted[row + i].values
                    pos, n, g, large = (s.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                    lo = at[i] + pos.astype(np.int64)
                    few, many = np.flatnonzero(~large), np.flatnonzero(large)
                    size = n[many].astype(np.int64)
                    w = np.repeat(lo[many] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    head, *whole = [_span_hashes(words, w, w + k, base).view(np.int64) for k, base in ((longer, _SPAN), (p.length, _SPAN), (p.length, _OTHER))] if len(w) else [np.zeros(0, np.int64)] * 3
                    first = np.concatenate([lo[few], w])
                    last = np.concatenate([lo[few] + n[few] + p.length - 2, w + p.length - 1])
                    none = np.zeros(len(few), np.int64)
                    columns = [np.repeat([0, 1], [len(few), len(w)]), np.concatenate([g[few], head]), np.concatenate([none, whole[0]]), np.concatenate([none, whole[1]]), np.full(len(first), keys[0][row + i]), np.full(len(first), keys[1][row + i]), first - at[i], np.concatenate([n[few].astype(np.int64), np.ones(len(w), np.int64)])]
                    for k, c in enumerate(columns):
                        out[k].append(c)
                    out[8] += [b" ".join(raw[a:b].split()) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)]
                kinds = [np.int32, *[np.int64] * 5, np.int32, _SHORT]
                arrays = [pa.array(np.concatenate(c).astype(k)) for c, k in zip(out, kinds, strict=False)]
                for k in range(0, len(out[8]), 20_000):
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, 20_000) for c in arrays), pa.array(out[8][k : k + 20_000], pa.binary())], _NAMES)

    return run


_NAMES = [c.split()[0] for c in _CHUNK.split(", ")]


def deep_nodes(chunks: pa.Array, n: np.ndarray, length: int) -> np.ndarray:
    """For chunks of words, of which the first ``n`` of each begin a window: True for the windows that occur again.

    Suffixes are ranked by their first 1, 2, 4 and so on words, each time by two ranks of half the depth; suffixes of one
    rank at the depth ``length`` share a node there.
    """
    data = np.frombuffer(chunks.buffers()[2], np.uint8)
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    first, last, at = word_spans(data, offsets)
    ends = np.append(0, np.cumsum(last - first)).astype(np.int32)
    names = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[~SEPARATOR[data]].tobytes())])
    rank = names.dictionary_encode().indices.to_numpy().astype(np.int64)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)  # the last two halves may overlap
        second = np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        _, rank = np.unique(rank * (int(rank.max()) + 1) + second, return_inverse=True)
        depth += step
    where = np.repeat(at[:-1] - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.bincount(rank[where])[rank[where]] > 1


def _trees(p: Repeats):
    """Marks (t0, t1, pos, n) of the repeated windows of sorted groups; a group is never cut."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.column("n").to_numpy().astype(np.int64)
        again = deep_nodes(t.column("words").combine_chunks() if isinstance(t.column("words"), pa.ChunkedArray) else t.column("words"), n, p.length)
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = np.flatnonzero(again & ~(np.append(False, again[:-1]) & (nth > 0)))
        end = np.flatnonzero(again & ~np.append(again[1:] & (nth[1:] > 0), False))
        rows = row[begin]
        pos = t.column("pos").to_numpy()[rows] + nth[begin]
        return pa.RecordBatch.from_arrays([pa.array(t.column("t0").to_numpy()[rows]), pa.array(t.column("t1").to_numpy()[rows]), pa.array(pos.astype(np.int32)), pa.array((end - begin + 1).astype(np.int32))], ["t0", "t1", "pos", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            words = np.add.reduceat(batch.column("n").to_numpy().astype(np.int64) + p.length, cut[:-1])
            lo = 0
            for k in range(len(words)):
                if size >= _TREE_WORDS and part[cut[k]] != last:
                    if cut[k] > lo:
                        held.append(batch.slice(lo, cut[k] - lo))
                    yield settle(held)
                    held, size, lo = [], 0, int(cut[k])
                size += int(words[k])
                last = part[cut[k]]
            held.append(batch.slice(lo))
        if held:
            yield settle(held)

    return run


def _cut(p: Repeats, with_text: bool):
    """Columns: doc_id, text, and the repeated windows as starts and numbers of neighbours."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, removed, kept, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            texts, marks = batch.column(1), batch.column(2)
            for i in range(n):
                t = texts[i]
                w = (t.as_buffer().to_pybytes() if t.is_valid else b"").split()  # bytes.split() knows the same separators
                words[i] = len(w)
                if marks[i].is_valid:
                    change = np.zeros(len(w) + 1, np.int32)
                    s = marks[i].values
                    begin, count = s.field(0).to_numpy(), s.field(1).to_numpy()
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + count - 1 + p.length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed[i] = gone.sum()
                    w = [w[k] for k in np.flatnonzero(~gone)]
                joined = b" ".join(w)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    kept.append(joined)
            columns = [batch.column(0), pa.array(words), pa.array(removed), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _again(key: str):
    """The key under another name: both sides of a join are then exchanged, so a hot key can be split at run time."""
    return F.col(key).bitwiseXOR(F.lit(0x5A5A5A5A5A5A5A5A))


def remove_repeats(docs: DataFrame, params: Repeats = Repeats(), with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for.

    A word goes if a window of ``length`` words over it starts anywhere else too, in the same text or another; every
    occurrence goes. Texts are taken whole, however long. Null and empty texts have no words. Equal texts, with one
    doc_id, several or none, are each other's repeats and have one result. Texts shorter than a window lose nothing.
    The separators between kept words become one space each. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    p = params
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # equal texts share a key, told apart from others by 128 bits; d picks one of them where one is enough
    keyed = texts.select("doc_id", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("d"), "text")

    anchors = scratch.keep(keyed.select("t0", "t1", "d", "text").mapInArrow(_anchors(p), "h long, c0 long, c1 long, t0 long, t1 long, d long, pos int, n short"), "anchors")
    inner = anchors.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select(_again("h").alias("g"))
    met = scratch.keep(anchors.withColumn("g", _again("h")).drop("h").join(inner, "g", "left_semi"), "shared")
    contexts = scratch.keep(met.groupBy("c0", "c1").agg(F.count("*").alias("k"), F.min(F.struct("t0", "t1", "pos", "n", "g")).alias("one")), "contexts")
    twice = contexts.where("k > 1").select(_again("c0").alias("e"), "c1")
    mark = ["t0", "t1", "pos", F.col("n").cast("int").alias("n")]
    whole = met.withColumn("e", _again("c0")).join(twice, ["e", "c1"], "left_semi").select(*mark)

    # chunks of groups with several, cut from one of each text
    several = contexts.groupBy("one.g").agg(F.count("*").alias("k")).where("k > 1").select(_again("g").alias("f"), (F.col("k") > p.group).alias("large"))
    open_ = contexts.select("one.*").withColumn("f", _again("g")).join(several, "f")
    one = met.groupBy("t0", "t1").agg(F.min("d").alias("d"))
    by_text = open_.groupBy("t0", "t1").agg(F.collect_list(F.struct("pos", "n", "g", "large")).alias("wanted")).join(one, ["t0", "t1"])
    key = ["t0", "t1", "d"]
    source = keyed.select(*key, "text").join(by_text, key).dropDuplicates(key)
    chunks = scratch.keep(source.select("t0", "t1", "text", "wanted").mapInArrow(_chunks(p), _CHUNK), "chunks")
    size = chunks.where("level = 1").groupBy("part").agg(F.count("*").alias("k"))
    split = chunks.where("level = 1").withColumn("f", _again("part")).join(size.select(_again("part").alias("f"), "k"), "f")
    small = chunks.where("level = 0").unionByName(split.where((F.col("k") > 1) & (F.col("k") <= p.group)).drop("f", "k"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    repeats = small.select("part", "t0", "t1", "pos", "n", "words").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_trees(p), "t0 long, t1 long, pos int, n int")
    large = split.where(F.col("k") > p.group)
    nodes = large.groupBy("w0", "w1").agg(F.count("*").alias("m")).where("m > 1").select(_again("w0").alias("e"), "w1")
    leaves = large.withColumn("e", _again("w0")).join(nodes, ["e", "w1"], "left_semi").select(*mark)

    marks = whole.unionByName(repeats).unionByName(leaves).distinct().groupBy("t0", "t1").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))
    marks = marks.select(_again("t0").alias("e"), "t1", "marks")
    rows = keyed.select("doc_id", _again("t0").alias("e"), "t1", F.encode("text", "UTF-8").alias("text")).join(marks, ["e", "t1"], "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(_cut(p, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
