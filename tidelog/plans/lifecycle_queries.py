"""Queries of decoder details, table and topic lifecycle, jobs and buffers."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..api import LogEngine, SchemaInvalid
from ..functions import scalars as S
from ..operators import jobs
from ..operators import maintenance as M
from ..sources import recordbatch as R
from ..sources.store import Store, shared_dir
from ..sources.table import ExportTable
from ..sources.values import Field, avro_schema, decoded, encode_avro, encode_protobuf
from .catalog import query
from .fixtures import relation as rel
from .fixtures import with_clause as w


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _json(name: str, fields: list[Field], cases: dict[str, tuple], columns: str):
    """A decoder query over JSON texts: case text -> expected (values as text, error)."""
    expected = ", ".join(f"({k}, {'NULL' if v is None else _sql(v)}, {'NULL' if e is None else _sql(e)})" for k, (v, e) in enumerate(cases.values()))

    @query(name, f"SELECT * FROM (VALUES {expected}) t(n, v, error)")
    def run(spark, sf_dir):
        rows = spark.createDataFrame(list(enumerate(cases)), "n int, raw string")
        rows = rows.withColumn("d", decoded(F.encode("raw", "utf-8"), "json", fields))
        return rows.select("n", F.col(f"d.{columns}").cast("string").alias("v"), "d.error")

    return run


_json("json_int64", [Field("v", "int64", "$.v")], {'{"v":7}': ("7", None), '{"v":007}': ("7", None), '{"v":1.0}': (None, 'field "v" must be int64'), '{"v":1e3}': (None, 'field "v" must be int64'), '{"v":-9223372036854775807}': ("-9223372036854775807", None), '{"v":-9223372036854775808}': (None, 'field "v" must be int64')}, "v")
_json("json_number", [Field("v", "float64", "$.v")], {'{"v":2}': ("2.0", None), '{"v":-1.5e2}': ("-150.0", None), '{"v":"2"}': (None, 'field "v" must be float64')}, "v")
_json("json_string", [Field("v", "string", "$.v")], {'{"v":"a"}': ("a", None), '{"v":1}': (None, 'field "v" must be string'), '{"v":""}': ("", None)}, "v")
_json("json_unescape", [Field("v", "string", "$.v")], {'{"v":"\\u00e9\\n"}': ("é\n", None), '{"v":"\\ud83d\\ude00"}': ("\U0001f600", None), '{"v":"\\ud800x"}': ("�x", None), '{"v":"\\q"}': (None, "value is not valid JSON")}, "v")
_json("json_leaf", [Field("v", "bool", "$.v", True)], {'{"v":true}': ("true", None), '{"v":null}': (None, None), '{"v":{}}': (None, "value is not valid JSON"), '{"v":1}': (None, 'field "v" must be bool')}, "v")
_json("json_skip", [Field("v", "int64", "$.v")], {'{"x":[1,{"y":[]}],"v":1}': ("1", None), '{"x":1-2e,"v":1}': ("1", None), '{"x":[1,"v":1}': (None, "value is not valid JSON")}, "v")
_json("json_path_tree", [Field("a", "string", "$.a", True), Field("b", "int64", "$.a.b", True)], {'{"a":"leaf"}': ("leaf", None), '{"a":{"b":1}}': (None, "value is not valid JSON")}, "a")


@query("decode_dispatch", "SELECT * FROM (VALUES ('json', 5::BIGINT), ('avro', 5), ('protobuf', 5)) t(encoding, id)")
def decode_dispatch(spark, sf_dir):
    fields = [Field("id", "int64", "$.id")]
    raw = {"json": b'{"id":5}', "avro": encode_avro({"id": 5}, fields), "protobuf": encode_protobuf({"id": 5}, fields)}
    out = None
    for encoding, data in raw.items():
        one = spark.createDataFrame([(encoding, bytearray(data))], "encoding string, raw binary").select("encoding", decoded(F.col("raw"), encoding, fields)["id"].alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


def _binary(spark, name: str, encoding: str, rows, fields, registry=None):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "n int, raw binary")
    return df.withColumn("d", decoded(F.col("raw"), encoding, fields, registry)).select("n", F.col(f"d.{name}").alias("v"), F.col("d.error").isNotNull().alias("failed"))


_WIDE = {"type": "record", "name": "r", "fields": [{"name": "m", "type": {"type": "map", "values": "long"}}, {"name": "u", "type": ["null", "string"]}, {"name": "id", "type": "long"}]}


@query("avro_skip", "SELECT * FROM (VALUES (0, 7::BIGINT, false), (1, NULL, true)) t(n, v, failed)")
def avro_skip(spark, sf_dir):
    """A map and a union before the wanted field; then the same cut off."""
    raw = b"\0\0\0\0\x03" + b"\x02\x02k\x08\x00" + b"\x02\x02x" + b"\x0e"
    return _binary(spark, "id", "avro", [(0, raw), (1, raw[:-2])], [Field("id", "int64", "$.id")], {3: json.dumps(_WIDE)})


@query("avro_read", "SELECT * FROM (VALUES (0, 'x', false), (1, NULL, false)) t(n, v, failed)")
def avro_read(spark, sf_dir):
    fields = [Field("note", "string", "$.note", True)]
    return _binary(spark, "note", "avro", [(0, encode_avro({"note": "x"}, fields)), (1, encode_avro({}, fields))], fields)


@query("avro_ts_scale", "SELECT * FROM (VALUES (0, 5000000::BIGINT, false), (1, 5000, false), (2, 5000, false), (3, 5000000, false)) t(n, v, failed)")
def avro_ts_scale(spark, sf_dir):
    """Milliseconds, microseconds, local microseconds and a plain long, as nanoseconds."""
    kinds = ({"type": "long", "logicalType": "timestamp-millis"}, {"type": "long", "logicalType": "timestamp-micros"}, {"type": "long", "logicalType": "local-timestamp-micros"}, "long")
    registry = {k: json.dumps({"type": "record", "name": "r", "fields": [{"name": "at", "type": t}]}) for k, t in enumerate(kinds)}
    return _binary(spark, "at", "avro", [(k, b"\0\0\0\0" + bytes([k]) + b"\x0a") for k in registry], [Field("at", "timestamp", "$.at")], registry)


@query("avro_schema_gen", """SELECT '{"type":"record","name":"value","fields":[{"name":"id","type":"long"},{"name":"note","type":["null","string"]}]}' AS schema""")
def avro_schema_gen(spark, sf_dir):
    fields = [Field("id", "int64", "$.id"), Field("note", "string", "$.note", True)]
    return spark.createDataFrame([(json.dumps(avro_schema(fields), separators=(",", ":")),)], "schema string")


@query("protobuf_skip", "SELECT * FROM (VALUES (0, 5::BIGINT, false), (1, NULL, true)) t(n, v, failed)")
def protobuf_skip(spark, sf_dir):
    """Unknown fields of every wire type before the wanted one, and an unknown type."""
    raw = b"\x48\x01" + b"\x49" + bytes(8) + b"\x4a\x01x" + b"\x4b\x50\x01\x4c" + b"\x4d" + bytes(4) + b"\x08\x05"
    return _binary(spark, "id", "protobuf", [(0, raw), (1, b"\x4e\x00" + raw)], [Field("id", "int64", "$.id")])


@query("protobuf_read", "SELECT * FROM (VALUES (0, -5::BIGINT, false), (1, NULL, true), (2, NULL, true)) t(n, v, failed)")
def protobuf_read(spark, sf_dir):
    fields = [Field("id", "int64", "$.id")]
    return _binary(spark, "id", "protobuf", [(0, encode_protobuf({"id": -5}, fields)), (1, b"\x0a\x01x"), (2, b"")], fields)


@query("protobuf_timestamp", "SELECT * FROM (VALUES (0, 1500000000::BIGINT, false), (1, 0, false)) t(n, v, failed)")
def protobuf_timestamp(spark, sf_dir):
    fields = [Field("at", "timestamp", "$.at")]
    return _binary(spark, "at", "protobuf", [(0, encode_protobuf({"at": 1_500_000_000}, fields)), (1, b"\x0a\x00")], fields)


@query("batch_encode", "SELECT * FROM (VALUES ('none', true, 3), ('gzip', true, 3), ('snappy', true, 3), ('lz4', true, 3), ('zstd', true, 3)) t(codec, valid, n)")
def batch_encode(spark, sf_dir):
    rows = []
    for codec in R.CODECS:
        raw = R.encode(R.Batch(0, [R.Record(k, None, b"value") for k in range(3)], codec=codec))
        rows.append((codec, R.valid(raw), len(R.decode(raw).records)))
    return spark.createDataFrame(rows, "codec string, valid boolean, n int")


@query("export_data_file_key", w("files") + "SELECT dt, hour, cast(count(*) AS bigint) AS n, min(concat('events/data/dt=', dt, '/hour=', lpad(cast(hour AS varchar), 2, '0'), '/', substr(sha256(file_path), 1, 32), '.parquet')) AS first_key FROM files GROUP BY 1, 2")
def export_data_file_key(spark, sf_dir):
    f = rel(spark, sf_dir, "files")
    key = S.export_data_file_key(F.lit("events"), F.col("dt"), F.col("hour"), F.substring(F.sha2("file_path", 256), 1, 32))
    return f.groupBy("dt", "hour").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_immutable_put", "SELECT * FROM (VALUES ('first', true), ('same', true), ('other', false)) t(step, ok)")
def sink_immutable_put(spark, sf_dir):
    """An object is created once; putting equal bytes again is fine, others are a conflict."""
    store, rows = Store(spark, _root(spark, "put")), []
    for step, doc in (("first", {"a": 1}), ("same", {"a": 1}), ("other", {"a": 2})):
        try:
            store.create("x.json", doc)
            rows.append((step, True))
        except Conflict:
            rows.append((step, False))
    return spark.createDataFrame(rows, "step string, ok boolean")


@query("sink_topic_create", "SELECT * FROM (VALUES ('new', true), ('again', true), ('other partitions', false), ('bad field', false)) t(step, ok)")
def sink_topic_create(spark, sf_dir):
    """A topic is created once; the same definition again is fine, another one or an invalid one is refused."""
    engine, rows = LogEngine(spark, _root(spark, "engine")), []
    fields = [Field("id", "int64", "$.id")]
    for step, parts, spec in (("new", 2, fields), ("again", 2, fields), ("other partitions", 3, fields), ("bad field", 2, [Field("id", "bytes", "$.id")])):
        try:
            engine.create_topic("t" if step != "bad field" else "u", parts, "json", spec)
            rows.append((step, True))
        except (Conflict, SchemaInvalid):
            rows.append((step, False))
    return spark.createDataFrame(rows, "step string, ok boolean")


@query("sink_topic_delete", "SELECT * FROM (VALUES ('a', 0::BIGINT, 0::BIGINT), ('b', 1, 3)) t(topic, found, records)")
def sink_topic_delete(spark, sf_dir):
    """A deleted topic is gone with its records; one of its name starts anew, and others stay."""
    engine = LogEngine(spark, _root(spark, "engine"))
    rows = spark.range(3).select(F.col("id").cast("string").cast("binary").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"), "id")
    for name in ("a", "b"):
        engine.create_topic(name)
        engine.produce(name, rows, ["id"])
    engine.delete_topic("a")
    found = [("a", sum(t == "a" for t in engine.topics())), ("b", sum(t == "b" for t in engine.topics()))]
    engine.create_topic("a")
    return spark.createDataFrame([(t, n, engine.log(t).count()) for t, n in found], "topic string, found long, records long")


def _table(spark) -> ExportTable:
    table = ExportTable(spark, _root(spark, "table"))
    table.ensure_schema([{"name": "id", "type": "int64"}], 1)
    for k in range(3):
        table.commit(f"data/batch={k}", k + 1, {"0": k + 1})
    return table


def _appended(spark, sf_dir) -> ExportTable:
    """A snapshot for each log partition, with a file for each half day."""
    table = ExportTable(spark, _root(spark, "table"))
    table.ensure_schema([{"name": "id", "type": "int64"}], 1)
    rows = rel(spark, sf_dir, "ev_log").select("part", "record_offset", "record_timestamp", F.col("event_id").alias("id"), "dt", F.expr("hour div 12 * 12").cast("int").alias("hour"))
    rows.repartition("part", "dt", "hour").write.partitionBy("part", "dt", "hour").parquet(f"{table.root}/data")
    for r in rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        table.commit(f"data/part={r.part}", r.n, {str(r.part): r.n})
    return table


@query("scan_iceberg_files", w("ev_log") + "SELECT part, dt, cast(hour // 12 * 12 AS int) AS hour, cast(count(*) AS bigint) AS record_count, min(record_offset) AS first_offset, max(record_offset) AS last_offset FROM ev_log GROUP BY part, dt, hour // 12")
def scan_iceberg_files(spark, sf_dir):
    """Data files of the current snapshot with their statistics, through its manifest list and manifests."""
    rows = []
    for f in _appended(spark, sf_dir).files():
        low, high = ({b["key"]: int.from_bytes(b["value"], "little", signed=True) for b in f[side]} for side in ("lower_bounds", "upper_bounds"))
        rows.append((int(f["file_path"].split("part=")[1].split("/")[0]), f["partition"]["dt"], f["partition"]["hour"], f["record_count"], low[1], high[1]))
    return spark.createDataFrame(rows, "part int, dt string, hour int, record_count long, first_offset long, last_offset long")


@query("sink_snapshot_append", w("ev_log") + ", f AS (SELECT part, cast(count(*) AS bigint) AS records, cast(count(DISTINCT concat(dt, '/', hour // 12)) AS bigint) AS files FROM ev_log GROUP BY part) SELECT part + 1 AS nth, records, files, cast(sum(records) OVER (ORDER BY part) AS bigint) AS total_records, cast(sum(files) OVER (ORDER BY part) AS bigint) AS total_files, cast(part + 1 AS bigint) AS manifests FROM f")
def sink_snapshot_append(spark, sf_dir):
    """Snapshots one after the other; each has the manifests of those before it."""
    table = _appended(spark, sf_dir)
    document, rows = table.document(), []
    for nth, s in enumerate(document["snapshots"], 1):
        n = lambda name, s=s: int(s["summary"][name])
        manifests = table.manifests(document | {"current-snapshot-id": s["snapshot-id"]})
        rows.append((nth, n("added-records"), n("added-data-files"), n("total-records"), n("total-data-files"), len(manifests)))
    return spark.createDataFrame(rows, "nth int, records long, files long, total_records long, total_files long, manifests long")


@query("sink_cas_commit", "SELECT 4::BIGINT AS version, false AS second_writer")
def sink_cas_commit(spark, sf_dir):
    """Two writers of one version: the second is refused."""
    table = _table(spark)
    try:
        table.store.create(f"metadata/v{table.version()}.metadata.json", {"other": True})
        second = True
    except Conflict:
        second = False
    return spark.createDataFrame([(table.version(), second)], "version long, second_writer boolean")


@query("table_create", "SELECT 1::BIGINT AS version, 1::BIGINT AS fields")
def table_create(spark, sf_dir):
    table = ExportTable(spark, _root(spark, "table"))
    table.ensure_schema([{"name": "id", "type": "int64"}], 1)
    table.ensure_schema([{"name": "id", "type": "int64"}], 1)
    return spark.createDataFrame([(table.version(), len(table.metadata()["fields"]))], "version long, fields long")


@query("table_load", "SELECT 3::BIGINT AS checkpoint")
def table_load(spark, sf_dir):
    table = _table(spark)
    return spark.createDataFrame([(ExportTable(spark, table.root).metadata()["checkpoint"]["0"],)], "checkpoint long")


@query("table_drop", "SELECT 0::BIGINT AS version")
def table_drop(spark, sf_dir):
    table = _table(spark)
    table.drop()
    return spark.createDataFrame([(table.version(),)], "version long")


_V = {0: [("id", "int64", False)], 1: [("id", "int64", False), ("note", "string", True)], 2: [("id", "string", False), ("note", "string", True)], 3: [("note", "string", True)]}


def _fields(spark, version: int):
    return spark.createDataFrame(_V[version], "name string, type string, nullable boolean")


@query("schema_register", "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false)) t(version, accepted)")
def schema_register(spark, sf_dir):
    """Each version against all accepted before it."""
    accepted, rows = [], []
    for v in _V:
        ok = all(M.incompatible(_fields(spark, a), _fields(spark, v)).isEmpty() for a in accepted)
        rows.append((v, ok))
        if ok:
            accepted.append(v)
    return spark.createDataFrame(rows, "version int, accepted boolean")


@query("schema_evolve", "SELECT * FROM (VALUES ('note')) t(added)")
def schema_evolve(spark, sf_dir):
    return _fields(spark, 1).join(_fields(spark, 0), "name", "left_anti").select(F.col("name").alias("added"))


@query("manifest_write_read", w("files") + "SELECT file_path, record_count, dt, hour FROM files")
def manifest_write_read(spark, sf_dir):
    """Manifest entries as a metadata table, written and read back."""
    path = _root(spark, "manifest")
    f = rel(spark, sf_dir, "files").select("file_path", "record_count", "dt", "hour")
    f.write.parquet(path)
    return spark.read.schema(f.schema).parquet(path)


@query("sidecar_write_read", w("batches") + "SELECT part, batch_no, first_offset, max_timestamp FROM batches")
def sidecar_write_read(spark, sf_dir):
    path = _root(spark, "sidecar")
    b = rel(spark, sf_dir, "batches").select("part", "batch_no", "first_offset", "max_timestamp")
    b.sortWithinPartitions("part", "first_offset").write.parquet(path)
    return spark.read.schema(b.schema).parquet(path)


_JOBS = w("segments") + ", j AS (SELECT part, epoch, min(base_offset) AS lo, max(end_offset) AS hi, cast(sum(record_count) AS bigint) AS n FROM segments GROUP BY part, epoch)"


def _planned(spark, sf_dir, kind: str) -> list[dict]:
    """A job for each epoch of each partition, with the folder that holds its records."""
    s = rel(spark, sf_dir, "segments").groupBy("part", "epoch").agg(F.min("base_offset").alias("lo"), F.max("end_offset").alias("hi"))
    return [{"id": jobs.job_id(kind, "events", r.part, r.lo, r.hi), "kind": kind, "topic": "events", "part": r.part, "first": r.lo, "last": r.hi, "data": f"data/part={r.part}/epoch={r.epoch}"} for r in s.collect()]


class _Crash(RuntimeError):
    pass


class _Log:
    """A log's records by partition and epoch, the folders that readers see, and a job store."""

    def __init__(self, spark, sf_dir: str, kind: str):
        self.spark, self.kind = spark, kind
        self.store = Store(spark, _root(spark, kind))
        self.jobs, self.refs, self.now = jobs.JobStore(self.store), jobs.Refs(self.store), 0
        rows = rel(spark, sf_dir, "ev_log").withColumn("epoch", F.expr("cast(record_offset div 300 AS int)"))
        rows.select("part", "epoch", "record_offset", "event_id").repartition("part", "epoch").write.partitionBy("part", "epoch").parquet(f"{self.store.root}/data")
        self.planned = _planned(spark, sf_dir, kind)
        for part in sorted({job["part"] for job in self.planned}):
            self.swap(part, [], [job["data"] for job in self.planned if job["part"] == part])

    def folders(self, part: int) -> list[str]:
        return self.refs.folders(part)

    def swap(self, part: int, gone: list[str], new: list[str]) -> None:
        self.refs.swap(part, gone, new)

    def tick(self) -> int:
        self.now += 1
        return self.now

    def run(self, phases: dict, crashes: tuple[str, ...]) -> None:
        """Plan each job twice; each runs until done, but is lost once after each of ``crashes`` had its effect."""
        for job in self.planned:
            self.jobs.put(job, self.tick())
            self.jobs.put(job, self.tick())
        lost = set()

        def once(name, phase):
            def go(job):
                out = phase(job)
                if name in crashes and (job["id"], name) not in lost:
                    lost.add((job["id"], name))
                    raise _Crash(name)
                return out

            return go

        handlers = {name: once(name, phase) for name, phase in phases.items()}
        for part in sorted({job["part"] for job in self.planned}):
            while found := self.jobs.list("events", part):
                for error in jobs.in_parallel([lambda job=job: jobs.run_job(self.jobs, job, handlers, self.tick) for job in found], 4):
                    if error is not None and not isinstance(error, _Crash):
                        raise error

    def left(self) -> list[tuple]:
        """Of each partition: jobs, refs and folders that are left, and records that can be read by the refs."""
        out = []
        for part in sorted({job["part"] for job in self.planned}):
            folders = self.folders(part)
            n = self.spark.read.parquet(*(f"{self.store.root}/{f}" for f in folders)).count() if folders else 0
            held = [name for name in self.store.names(f"data/part={part}") if "=" in name or name == "merged"]
            out.append((part, len(self.jobs.list("events", part)), len(folders), len(held), n))
        return out


_LEFT = "part int, jobs long, refs long, folders long, records long"


@query("job_store", _JOBS + "SELECT part, lo, hi, row_number() OVER (PARTITION BY part ORDER BY epoch % 3, job_id) AS nth, job_id FROM (SELECT *, substr(sha256(concat('merge|events|', part, '|', lo, '|', hi)), 1, 24) AS job_id FROM j) WHERE epoch % 4 <> 3")
def job_store(spark, sf_dir):
    """Jobs put twice, some of them deleted, listed in the order of their last change."""
    store = jobs.JobStore(Store(spark, _root(spark, "jobs")))
    planned = _planned(spark, sf_dir, "merge")
    for job in planned:
        epoch = int(job["data"].rsplit("=")[-1])
        kept = store.put(job, 99)
        if store.put(job, 100) != kept:
            raise AssertionError("a job was planned twice")
        store.put(kept, epoch % 3)
        if epoch % 4 == 3:
            store.delete(job)
    rows = [(p, job["first"], job["last"], n, job["id"]) for p in sorted({j["part"] for j in planned}) for n, job in enumerate(store.list("events", p), 1)]
    return spark.createDataFrame(rows, "part int, lo long, hi long, nth long, job_id string")


@query("job_retention", _JOBS + "SELECT part, 0::BIGINT AS jobs, cast(count(*) FILTER (epoch % 2 = 0) AS bigint) AS refs, cast(count(*) FILTER (epoch % 2 = 0) AS bigint) AS folders, cast(coalesce(sum(n) FILTER (epoch % 2 = 0), 0) AS bigint) AS records FROM j GROUP BY part")
def job_retention(spark, sf_dir):
    """Every second epoch expires: data go, then what points at them; each job is lost once after each phase."""
    log = _Log(spark, sf_dir, "retention")
    log.planned = [job for job in log.planned if int(job["data"].rsplit("=")[-1]) % 2]
    kept = {"delete_data": lambda job: log.store.delete(job["data"]), "delete_metadata": lambda job: log.swap(job["part"], [job["data"]], [])}
    log.run(kept, ("delete_data", "delete_metadata"))
    log.planned = _planned(spark, sf_dir, "retention")
    return spark.createDataFrame(log.left(), _LEFT)


def _merged(spark, sf_dir, kind: str, grace: int):
    """Each partition's epochs become one folder; sources go after a grace, when no ref names them."""
    log = _Log(spark, sf_dir, kind)
    sources = {p: [j for j in log.planned if j["part"] == p] for p in {j["part"] for j in log.planned}}
    log.planned = [{"id": jobs.job_id(kind, "events", p, min(j["first"] for j in js), max(j["last"] for j in js)), "kind": kind, "topic": "events", "part": p, "first": min(j["first"] for j in js), "sources": [j["data"] for j in js], "data": f"data/part={p}/merged"} for p, js in sources.items()]

    def publish_data(job):
        # no ref names the folder yet, so a second run may write it again
        read = spark.read.parquet(*(f"{log.store.root}/{f}" for f in job["sources"]))
        read.sort("record_offset").write.mode("overwrite").parquet(f"{log.store.root}/{job['data']}")

    def publish_metadata(job):
        log.swap(job["part"], job["sources"], [job["data"]])
        return {"published": log.now}

    def delete_data(job):
        if log.tick() < job["published"] + grace:
            raise jobs.Later(job["id"])
        named = log.folders(job["part"])
        for folder in job["sources"]:
            if folder not in named:
                log.store.delete(folder)

    log.run({"publish_data": publish_data, "publish_metadata": publish_metadata, "delete_data": delete_data}, ("publish_data", "publish_metadata", "delete_data"))
    return spark.createDataFrame(log.left(), _LEFT)


_ONE = _JOBS + "SELECT part, 0::BIGINT AS jobs, 1::BIGINT AS refs, 1::BIGINT AS folders, cast(sum(n) AS bigint) AS records FROM j GROUP BY part"


@query("job_compaction", _ONE)
def job_compaction(spark, sf_dir):
    return _merged(spark, sf_dir, "compaction", 20)


@query("job_merge_classic", _ONE)
def job_merge_classic(spark, sf_dir):
    return _merged(spark, sf_dir, "merge", 0)


@query("job_bounded_parallel", _JOBS + "SELECT cast(count(*) AS bigint) AS tasks, cast(count(*) FILTER (epoch % 3 <> 1) AS bigint) AS done, cast(count(*) FILTER (epoch % 3 = 1) AS bigint) AS failed, true AS bounded FROM j")
def job_bounded_parallel(spark, sf_dir):
    """A task for each epoch, four at a time; some fail, and the others run all the same."""
    lock, running, most, done = threading.Lock(), 0, 0, []

    def task(job):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        try:
            if int(job["data"].rsplit("=")[-1]) % 3 == 1:
                raise RuntimeError(job["id"])
            done.append(job["id"])
        finally:
            with lock:
                running -= 1

    planned = _planned(spark, sf_dir, "retention")
    errors = jobs.in_parallel([lambda job=job: task(job) for job in planned], 4)
    return spark.createDataFrame([(len(planned), len(done), sum(e is not None for e in errors), most <= 4)], "tasks long, done long, failed long, bounded boolean")


def _flushed(most_bytes: int, most_ms: int) -> str:
    """The buffer's steps as a recursion: a row's batch, then the first time and the bytes that are left in the buffer."""
    after = f"CASE WHEN total >= {most_bytes} THEN batch + 1 ELSE batch END AS next, CASE WHEN total < {most_bytes} THEN first END AS first, CASE WHEN total < {most_bytes} THEN total ELSE 0 END AS total"
    step = f"SELECT o.part, o.i, o.record_offset, o.n, f.next + CASE WHEN o.t - f.first >= {most_ms} THEN 1 ELSE 0 END AS batch, CASE WHEN o.t - f.first < {most_ms} THEN f.first ELSE o.t END AS first, CASE WHEN o.t - f.first >= {most_ms} THEN 0 ELSE f.total END + o.n AS total FROM f JOIN o ON o.part = f.part AND o.i = f.i + 1"
    return w("ev_log", recursive=True) + f", o AS (SELECT part, record_offset, record_timestamp AS t, nbytes AS n, row_number() OVER (PARTITION BY part ORDER BY record_offset) AS i FROM ev_log), f AS (SELECT part, i, record_offset, n, batch, {after} FROM (SELECT part, i, record_offset, n, 0 AS batch, t AS first, n AS total FROM o WHERE i = 1) UNION ALL SELECT part, i, record_offset, n, batch, {after} FROM ({step})) "


@query("stream_microbatch_trigger", _flushed(500, 3_600_000) + "SELECT part, cast(batch AS int) AS flush, cast(count(*) AS bigint) AS n, cast(sum(n) AS bigint) AS nbytes FROM f GROUP BY part, batch")
def stream_microbatch_trigger(spark, sf_dir):
    rows = jobs.flushes(rel(spark, sf_dir, "ev_log"), "record_offset", "record_timestamp", "nbytes", 500, 3_600_000)
    return rows.groupBy("part", "flush").agg(F.count("*").alias("n"), F.sum("nbytes").alias("nbytes"))


@query("stream_linger_buffer", _flushed(1 << 60, 7_200_000) + "SELECT part, cast(batch AS int) AS flush, min(record_offset) AS first_offset, cast(count(*) AS bigint) AS n FROM f GROUP BY part, batch")
def stream_linger_buffer(spark, sf_dir):
    rows = jobs.flushes(rel(spark, sf_dir, "ev_log"), "record_offset", "record_timestamp", "nbytes", 1 << 60, 7_200_000)
    return rows.groupBy("part", "flush").agg(F.min("record_offset").alias("first_offset"), F.count("*").alias("n"))


_HELD = range(4)
_OPEN = " + ".join(f"CASE WHEN h{k} > 0 OR o.part = {k} THEN 1 ELSE 0 END" for k in _HELD)
_FITS = f"({' + '.join(f'h{k}' for k in _HELD)} + o.n <= 200 * ({_OPEN}))"
_PUT = ", ".join(f"CASE WHEN o.part <> {k} OR NOT {_FITS} THEN h{k} WHEN h{k} + o.n > 150 THEN 0 ELSE h{k} + o.n END AS h{k}" for k in _HELD)
_BUFFERS = w("ev_log", recursive=True) + f", o AS (SELECT event_type AS producer, part, nbytes AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM ev_log), f AS (SELECT DISTINCT producer, 0::BIGINT AS i, -1 AS part, false AS admitted, {', '.join(f'0::BIGINT AS h{k}' for k in _HELD)} FROM o UNION ALL SELECT o.producer, o.i, o.part, {_FITS} AS admitted, {_PUT} FROM f JOIN o ON o.producer = f.producer AND o.i = f.i + 1) "


@query("stream_backpressure", _BUFFERS + "SELECT producer, part, admitted, cast(count(*) AS bigint) AS n FROM f WHERE i > 0 GROUP BY producer, part, admitted")
def stream_backpressure(spark, sf_dir):
    """A producer for each event type, each with a buffer for each partition, in order of events."""
    rows = rel(spark, sf_dir, "ev_log").withColumn("producer", F.col("event_type"))
    rows = jobs.admitted(rows.select("producer", "part", "event_id", "nbytes"), "producer", "event_id", "nbytes", 200, 150)
    return rows.groupBy("producer", "part", "admitted").agg(F.count("*").alias("n"))


@query("stream_rate_limit", w("ev_log") + ", n AS (SELECT part, record_offset, record_timestamp // 3600000 AS t, row_number() OVER (PARTITION BY part ORDER BY record_offset) AS i FROM ev_log), v AS (SELECT *, max(2 * t - 1 * i) OVER (PARTITION BY part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n) SELECT part, record_offset, cast(ceil(greatest(2 * t, coalesce(m + i - 9, 2 * t)) / 2.0) AS bigint) AS goes_at FROM v")
def stream_rate_limit(spark, sf_dir):
    """Two records a millisecond, ten at once, on a clock that runs an hour a millisecond."""
    rows = rel(spark, sf_dir, "ev_log").withColumn("at", F.expr("record_timestamp div 3600000"))
    return jobs.paced(rows, "record_offset", "at", 2000, 10).select("part", "record_offset", "goes_at")


@query("stream_watermark", w("observed") + "SELECT part, ord, max(hw) OVER (PARTITION BY part ORDER BY ord) AS committed FROM observed")
def stream_watermark(spark, sf_dir):
    """The committed watermark never falls, whatever is reported."""
    top = F.max("hw").over(Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return rel(spark, sf_dir, "observed").select("part", "ord", top.alias("committed"))


@query("stream_epoch_fence", w("epochs") + "SELECT part, epoch, epoch < (SELECT max(e.epoch) FROM epochs e WHERE e.part = epochs.part) AS fenced FROM epochs")
def stream_epoch_fence(spark, sf_dir):
    """A writer of an epoch that is not the newest is fenced."""
    newest = F.max("epoch").over(Window.partitionBy("part"))
    return rel(spark, sf_dir, "epochs").select("part", "epoch", (F.col("epoch") < newest).alias("fenced"))
