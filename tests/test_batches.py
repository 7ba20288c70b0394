"""Batches by their bytes, and reads by blocks of offsets."""

import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import batches, scan
from tidelog.sources import recordbatch as R

RAW = "part int, first_offset long, last_offset long, raw binary"


def stored(first, n, base=None):
    raw = R.encode(R.Batch(0, [R.Record(k, None, b"%d" % (first + k)) for k in range(n)]))
    return (0, first, first + n - 1, bytearray(R.patch(raw, first if base is None else base)))


def test_long_checksums():
    for n in (4095, 4096, 4097, 4160, 9000):
        data = os.urandom(n)
        c = 0xFFFFFFFF
        for b in data:
            c = R._CRC[(c ^ b) & 255] ^ c >> 8
        assert R.crc32c(data) == c ^ 0xFFFFFFFF


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_prefix_and_budget_by_blocks(spark, block):
    offsets = [(0, o) for o in (4, 5, 5, 6, 7, 9, 10)] + [(1, 0), (1, 1), (2, 5)]
    df = spark.createDataFrame(offsets, "part int, record_offset long")
    got = [(r.part, r.record_offset) for r in scan.contiguous_prefix(df, block=block).orderBy("part", "record_offset").collect()]
    assert got == [(0, 4), (0, 5), (0, 5), (0, 6), (0, 7), (1, 0), (1, 1), (2, 5)]
    assert [(r.part, r.record_offset) for r in scan.contiguous_prefix(df, F.lit(4), block).orderBy("record_offset").collect()] == got[:5]
    sized = df.dropDuplicates().withColumn("n", F.lit(10))
    kept = scan.byte_budget(sized, "n", 25, "record_offset", "part", block=block).orderBy("part", "record_offset").collect()
    assert [(r.part, r.record_offset) for r in kept] == [(0, 4), (0, 5), (1, 0), (1, 1), (2, 5)]
    assert scan.byte_budget(sized, "n", 3, "record_offset", "part", block=block).count() == 3
    assert scan.contiguous_prefix(df.where("part > 9"), block=block).count() == 0


def test_raw_read_stops_at_holes(spark):
    columns = "part int, first_offset long, last_offset long, nbytes long"
    sealed = spark.createDataFrame([(0, 0, 4, 10), (0, 5, 9, 10), (1, 0, 4, 10), (1, 10, 14, 10)], columns)
    pending = spark.createDataFrame([(0, 5, 9, 99), (0, 10, 14, 10)], columns)
    active = spark.createDataFrame([(0, 15, 19, 10), (0, 20, 24, 10), (1, 5, 9, 10), (2, 3, 5, 10)], columns)
    requests = spark.createDataFrame([(0, 7, 18), (1, 0, 99), (2, 0, 99)], "part int, start_offset long, bound long")
    read = lambda sources, budget: [(r.part, r.first_offset, r.source) for r in batches.raw_read(sources, requests, budget).orderBy("part", "first_offset").collect()]
    # the batch at 15 begins below the bound and is whole; partition 2 begins with a hole
    assert read([sealed, pending, active], 100) == [(0, 5, 0), (0, 10, 1), (0, 15, 2), (1, 0, 0), (1, 5, 2), (1, 10, 0)]
    assert read([sealed, pending, active], 20) == [(0, 5, 0), (0, 10, 1), (1, 0, 0), (1, 5, 2)]
    assert read([sealed, pending], 1) == [(0, 5, 0), (1, 0, 0)]
    assert read([sealed, active], 100) == [(0, 5, 0), (1, 0, 0), (1, 5, 1), (1, 10, 0)]


def test_fetch_reads_ranges(spark):
    parts = [bytes(stored(f, n, 0)[3]) for f, n in ((0, 3), (3, 2), (5, 4))]
    files = spark.createDataFrame([("f", bytearray(b"other" + parts[0] + parts[1])), ("g", bytearray(parts[2]))], "file_key string, content binary")
    refs = spark.createDataFrame([(0, "f", 5, len(parts[0]) + len(parts[1]), 0, 5), (0, "g", 0, len(parts[2]), 5, 9)], "part int, file_key string, byte_offset long, byte_length long, base_offset long, end_offset long")

    def read(start, head, budget):
        requests = spark.createDataFrame([(0, start, head)], "part int, start_offset long, head long")
        rows = batches.fetch(refs, files, requests, budget).orderBy("first_offset").collect()
        return [[int(x.value) for x in R.decode(bytes(r.raw)).records] == [x.offset for x in R.decode(bytes(r.raw)).records] and r.first_offset for r in rows]

    assert read(0, 9, 1 << 20) == [0, 3, 5]
    assert read(4, 9, 1 << 20) == [3, 5]  # the budget doesn't count what lies before the offset
    assert read(4, 9, len(parts[1]) + len(parts[2])) == [3, 5]
    assert read(0, 8, 1 << 20) == [0, 3]
    assert read(0, 9, 1) == [0]
    assert read(9, 9, 1) == []
    with pytest.raises(Exception, match="ends inside a batch"):
        batches.fetch(refs.withColumn("byte_length", F.col("byte_length") - 1), files, spark.createDataFrame([(0, 0, 9)], "part int, start_offset long, head long"), 99).collect()


def test_merge_and_recovery(spark):
    rows = [stored(0, 3), stored(3, 2), stored(5, 4)]
    df = spark.createDataFrame(rows, RAW)
    sources = df.selectExpr("part", "first_offset AS base_offset", "last_offset AS end_offset", "raw")
    one = batches.merged(sources, "part").collect()[0]
    assert (one.base_offset, one.end_offset, one.n) == (0, 8, 3)
    assert bytes(one.raw) == b"".join(bytes(r[3]) for r in rows)
    with pytest.raises(Exception, match="contiguous"):
        batches.merged(sources.where("base_offset <> 3"), "part").collect()
    assert batches.recovered(df).collect()[0].next_offset == 9
    damaged = df.withColumn("raw", F.expr("CASE WHEN first_offset = 3 THEN substring(raw, 1, 70) ELSE raw END"))
    assert batches.recovered(damaged).collect()[0].next_offset == 3
