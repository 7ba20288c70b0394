"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns the arcs that end at its virtual nodes. A key belongs to the arc its hash falls in; a key whose shard
is full continues clockwise to the next shard with room. The keys of one arc share that clockwise order of shards, so
the ring is settled on counts by arc: shards take keys of their own arcs first, then of the arcs one shard away, and
so on. The plan holds a few rank intervals for each arc, whatever the number of rows; rows find their interval by
their rank within the arc. Ranks come from one sort by ranges of (place, doc_id, size, checksum, number of the row):
each task numbers its own rows, and the counts by task and arc tell where each task's ranks begin. So neither an arc nor
a key is ever one task's business, however many rows it has.

Loads are bounded tightly: capacities differ by one row at most and add up to the number of rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_ROWS = 2_000_000  # of a task


@dataclass(frozen=True)
class Ring:
    """shards: their number; nodes: virtual nodes of each shard."""

    shards: int = 40
    nodes: int = 64

    def points(self) -> list[tuple[int, int]]:
        """Places of all virtual nodes, clockwise from the least 64-bit signed value, with their shards."""
        found = {}
        for shard in range(self.shards):
            for k in range(self.nodes):
                place = int.from_bytes(hashlib.sha256(f"shard-{shard}-node-{k}".encode()).digest()[:8], "big", signed=True)
                found.setdefault(place, shard)
        return sorted(found.items())


def _clockwise(points: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each arc the shards in the order in which its keys meet them."""
    out = []
    n = len(points)
    for a in range(n):
        order: dict[int, None] = {}
        k = a
        while len(order) < shards and k < a + n:
            order.setdefault(points[k % n][1])
            k += 1
        out.append(list(order))
    return out


def settle(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Rank intervals (arc, from, to, shard, first slot) for the rows in each arc; every row is placed."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    order = _clockwise(points, shards)
    left = {a: n for a, n in sorted(counts.items()) if n}
    done = dict.fromkeys(left, 0)
    plan = []
    for hop in range(shards):
        for a in list(left):
            s = order[a][hop]
            take = min(left[a], room[s] - filled[s])
            if take:
                plan.append((a, done[a], done[a] + take, s, filled[s]))
                filled[s] += take
                done[a] += take
                left[a] -= take
                if not left[a]:
                    del left[a]
        if not left:
            break
    return plan


def assign(docs: DataFrame, ring: Ring = Ring(), scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is ``rows``: shards' counts are at most one apart, so ``grown_shard`` is null. size is the text's UTF-8
    bytes plus 16 (null: 16), however long; text_crc32 is of the UTF-8 bytes (null: of none). The key is the doc_id; a
    null doc_id is a key of its own, and rows with the same key are neighbours in an order by size and checksum. Slots
    count from 0 in each shard without gaps. Other columns are ignored, whatever their names. An empty table gives an
    empty result. The driver holds a row for each virtual node and each task.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ring")
    points = ring.points()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(F.lit(42), "doc_id").alias("place"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "rows")
    order = ["place", "doc_id", "size", "text_crc32"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _ROWS))
    ranged = rows.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order).drop("row")
    numbered = scratch.keep(ranged.mapInArrow(_numbered([p for p, _ in points]), "doc_id long, size long, text_crc32 long, part int, arc int, nth long"), "numbered")
    runs = numbered.groupBy("part", "arc").agg(F.min("nth").alias("first"), F.count("*").alias("c")).orderBy("arc", "part").collect()
    arc, part, first, count = (np.array([r[k] for r in runs], np.int64) for k in ("arc", "part", "first", "c"))
    counts = dict(zip(*(x.tolist() for x in (np.unique(arc), np.bincount(arc, count)[np.unique(arc)].astype(np.int64) if len(arc) else arc)), strict=True))
    plan = settle(counts, points, ring.shards)
    before = np.cumsum(count) - count  # rows of all arcs before, and of this arc's earlier tasks
    base = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist(), strict=False))
    spans = sorted((base[a] + lo, shard, slot) for a, lo, _, shard, slot in plan)
    key = part * len(points) + arc
    by = np.argsort(key)
    handle = spark.sparkContext.broadcast((key[by], (before - first)[by], *(np.array([x[k] for x in spans], np.int64) for k in range(3))))
    placed = numbered.mapInArrow(_placed(handle, len(points)), "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(bounds: list[int]):
    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            arc = np.searchsorted(np.array(bounds, np.int64), batch.column("place").to_numpy()) % len(bounds)
            columns = [batch.column(k) for k in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(m, part, np.int32)), pa.array(arc.astype(np.int32)), pa.array(np.arange(n, n + m))], ["doc_id", "size", "text_crc32", "part", "arc", "nth"])
            n += m

    return run


def _placed(handle, arcs: int):
    def run(batches):
        key, shift, start, shard, slot = handle.value
        for batch in batches:
            part, arc, nth = (batch.column(k).to_numpy().astype(np.int64) for k in ("part", "arc", "nth"))
            rank = nth + shift[np.searchsorted(key, part * arcs + arc)]
            at = np.searchsorted(start, rank, "right") - 1
            columns = [batch.column(k) for k in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard[at].astype(np.int32)), pa.array(slot[at] + rank - start[at])], ["doc_id", "size", "text_crc32", "shard", "slot"])

    return run
