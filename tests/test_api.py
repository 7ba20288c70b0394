import uuid

import pytest

from tidelog.api import LogEngine, SchemaInvalid, SequenceConflict, SequenceGap, UnknownTopic
from tidelog.operators import scan
from tidelog.sources.store import Conflict, shared_dir
from tidelog.sources.values import Field
from tidelog.streaming import export


@pytest.fixture()
def engine(spark):
    now = [1_700_000_000_000]
    e = LogEngine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", clock=lambda: now[0])
    e.now = now
    return e


def batch(spark, lo, hi, value='{{"id":{}}}'):
    return spark.createDataFrame([(bytearray(f"k{i}".encode()) if i % 3 else None, bytearray(value.format(i).encode()), i) for i in range(lo, hi)], "key binary, value binary, n long")


def test_write_and_read(spark, engine):
    engine.create_topic("a/b", partitions=2)
    engine.create_topic("a/b", partitions=2)
    with pytest.raises(Conflict):
        engine.create_topic("a/b", partitions=3)
    engine.produce("a/b", batch(spark, 0, 10), ["n"])
    engine.produce("a/b", batch(spark, 10, 30), ["n"])
    ends = engine.list_offsets("a/b")
    assert sum(ends.values()) == 30
    for p, end in ends.items():
        got = [r.record_offset for r in engine.consume("a/b", p, 0).orderBy("record_offset").collect()]
        assert got == list(range(end))
        with pytest.raises(scan.OffsetOutOfRange):
            engine.consume("a/b", p, end + 1)
    assert engine.list_offsets("a/b", scan.EARLIEST) == {0: 0, 1: 0}
    assert engine.list_offsets("a/b", 10**15) == {0: -1, 1: -1}
    with pytest.raises(UnknownTopic):
        engine.log("nope")


def test_idempotent_producer(spark, engine):
    engine.create_topic("t")
    first = engine.produce("t", batch(spark, 0, 5), ["n"], producer_id=9, sequence=0)
    assert engine.produce("t", batch(spark, 0, 5), ["n"], producer_id=9, sequence=0) == first
    with pytest.raises(SequenceConflict):
        engine.produce("t", batch(spark, 0, 6), ["n"], producer_id=9, sequence=0)
    with pytest.raises(SequenceGap):
        engine.produce("t", batch(spark, 5, 6), ["n"], producer_id=9, sequence=7)
    engine.produce("t", batch(spark, 5, 6), ["n"], producer_id=9, sequence=5)
    assert engine.list_offsets("t") == {0: 6}


def test_typed_export_compact_expire(spark, engine):
    fields = [Field("id", "int64", "$.id")]
    engine.create_topic("typed", 2, "json", fields)
    with pytest.raises(SchemaInvalid):
        engine.produce("typed", batch(spark, 0, 1, '{{"id":"{}"}}'), ["n"])
    with pytest.raises(SchemaInvalid):
        engine.create_topic("bad", 1, "json", [Field("key", "bytes", "id")])
    engine.produce("typed", batch(spark, 0, 8), ["n"])
    assert engine.export("typed")
    assert engine.export("typed") is None
    engine.produce("typed", batch(spark, 8, 12), ["n"])
    engine.compact("typed")
    assert engine.export("typed")
    assert sorted(r.id for r in engine.table("typed").read().collect()) == list(range(12))
    assert engine.expire("typed", 1000) == 0
    engine.now[0] += 5000
    assert engine.expire("typed", 1000) == 1
    assert engine.log("typed").count() == 0
    assert engine.list_offsets("typed", scan.EARLIEST) == engine.list_offsets("typed")
    engine.delete_topic("typed")
    assert engine.topics() == []


def test_keyless_rows_go_round_robin_by_arrival(spark, engine):
    engine.create_topic("rr", partitions=3)
    rows = lambda lo, hi: spark.createDataFrame([(None, str(i).encode(), i) for i in range(lo, hi)], "key binary, value binary, n long").repartition(4)
    engine.produce("rr", rows(0, 10), ["n"])
    engine.produce("rr", rows(10, 17), ["n"])
    got = {int(bytes(r.value)): r.part for r in engine.log("rr").collect()}
    assert got == {i: i % 3 for i in range(17)}


def test_export_never_overwrites(spark, engine):
    """Batches cut another way after a lost checkpoint add nothing twice, and a writer that was overtaken is refused."""
    fields = [Field("id", "int64", "$.id")]
    engine.create_topic("e", 1, "json", fields)
    engine.produce("e", batch(spark, 0, 6), ["n"])
    table, log = engine.table("e"), engine.log("e")
    table.ensure_schema([{"name": "id", "type": "int64"}], 1)
    export.export_batch(log.where("record_offset < 4"), 0, table, fields)
    before = table.metadata()
    export.export_batch(log.where("record_offset < 5"), 0, table, fields)
    export.export_batch(log, 0, table, fields)
    export.export_batch(log, 1, table, fields)
    assert sorted(r.id for r in table.read().collect()) == list(range(6)) and len(table.metadata()["snapshots"]) == 3
    with pytest.raises(Conflict):
        table.commit("data/late", 2, {"0": 6}, "0:4-5", before["checkpoint"])


def test_group_offsets(engine):
    engine.commit_offsets("g", {"t": {0: 5, 1: 6}})
    engine.commit_offsets("g", {"t": {0: 4}, "u": {2: 1}})
    assert engine.offsets("g") == {"t": {0: 4, 1: 6}, "u": {2: 1}}
    assert engine.offsets("none") == {}
