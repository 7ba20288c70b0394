"""Metadata files of export tables, read by the Avro library of the JVM."""

import json
import uuid

import pytest

from tidelog.sources import avrofile, iceberg
from tidelog.sources.store import Conflict, shared_dir
from tidelog.sources.table import ExportTable
from tidelog.sources.values import DecodeError


def by_library(spark, path):
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.avro.file.DataFileReader(jvm.java.io.File(path.removeprefix("file:").replace("//", "/")), jvm.org.apache.avro.generic.GenericDatumReader())
    rows = []
    while reader.hasNext():
        rows.append(json.loads(reader.next().toString()))
    return json.loads(reader.getSchema().toString()), rows


def test_container():
    schema = {"type": "record", "name": "r", "fields": [{"name": n, "type": t} for n, t in {"a": "long", "b": ["null", "string"], "c": {"type": "array", "items": "int"}, "d": "double", "e": "boolean", "f": "bytes"}.items()]}
    rows = [{"a": -5, "b": None, "c": [], "d": 1.5, "e": True, "f": b"\0x"}, {"a": 1 << 40, "b": "é", "c": [1, -2], "d": 0.0, "e": False, "f": b""}]
    raw = avrofile.write(schema, rows, {"more": "x"})
    meta, back = avrofile.read(raw)
    assert back == rows and meta["more"] == "x" and avrofile.read(avrofile.write(schema, []))[1] == []
    for bad in (b"no", raw[:-1] + b"\xff"):
        with pytest.raises(DecodeError):
            avrofile.read(bad)


def test_snapshots(spark):
    table = ExportTable(spark, f"{shared_dir(spark)}/ice-{uuid.uuid4().hex}")
    table.ensure_schema([{"name": "id", "type": "int64"}, {"name": "at", "type": "timestamp"}], 1)
    for k in range(2):
        rows = spark.range(k * 10, k * 10 + 10).selectExpr("id AS record_offset", "id * 2 AS record_timestamp", "id", "'2024-01-0%d' AS dt" % (k + 1), "CAST(id % 2 AS INT) AS hour")
        rows.repartition(1).write.partitionBy("dt", "hour").parquet(f"{table.root}/data/{k}")
        table.commit(f"data/{k}", 10, {"0": (k + 1) * 10})
    table.commit("data/1", 10, {"0": 20})  # a retry
    table.ensure_schema([{"name": "at", "type": "timestamp"}, {"name": "more", "type": "bool"}], 2)
    table.ensure_schema([{"name": "at", "type": "timestamp"}, {"name": "id", "type": "string"}], 3)
    doc = table.document()
    assert [f["id"] for f in doc["schemas"][-1]["fields"]] == [*range(1, 8), 9, 11] and doc["last-column-id"] == 11  # ids aren't used again
    assert [s["schema-id"] for s in doc["schemas"]] == [0, 1, 2] and doc["current-schema-id"] == 2
    assert [(s["sequence-number"], s.get("parent-snapshot-id")) for s in doc["snapshots"]] == [(1, None), (2, doc["snapshots"][0]["snapshot-id"])]
    assert doc["current-snapshot-id"] == doc["refs"]["main"]["snapshot-id"] == doc["snapshots"][1]["snapshot-id"]
    assert doc["snapshots"][1]["summary"]["total-records"] == "20" and table.store.read_bytes("metadata/version-hint.text") == b"5"
    schema, listed = by_library(spark, doc["snapshots"][1]["manifest-list"])
    assert {f["name"]: f["field-id"] for f in schema["fields"]}["partitions"] == 507
    assert [(m["sequence_number"], m["added_files_count"], m["added_rows_count"]) for m in listed] == [(1, 2, 10), (2, 2, 10)]
    assert "2024-01-02" in json.dumps(listed[1]["partitions"][0]["lower_bound"])
    entries = [e["data_file"] for m in listed for e in by_library(spark, m["manifest_path"])[1]]
    assert sorted(e["record_count"] for e in entries) == [5, 5, 5, 5] and {e["file_format"] for e in entries} == {"PARQUET"}
    found = spark.read.option("recursiveFileLookup", "true").parquet(*(e["file_path"] for e in entries))
    assert sorted(r.id for r in found.collect()) == list(range(20)) == sorted(r.record_offset for r in table.read().collect())
    assert {f["partition"]["dt"] for f in table.files()} == {"2024-01-01", "2024-01-02"}
    with pytest.raises(Conflict):
        table.commit("data/2", 1, {"0": 30}, after={"0": 10})


def test_empty():
    assert iceberg.view({})["snapshots"] == []
    assert iceberg.document({}, iceberg.view({}), "r", 5, None)["current-snapshot-id"] == -1
