"""Queries that run streams over what is there now and read their results back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.store import Store, shared_dir
from ..sources.table import ExportTable
from ..sources.values import Field
from ..streaming import export, state
from .catalog import query
from .fixtures import relation as rel
from .fixtures import relation_by_hours as rel_by_hours
from .fixtures import with_clause as w

_FIELDS = [Field("id", "int64", "$.id"), Field("kind", "string", "$.kind")]
_GOOD = "event_id % 11 <> 0"
#: Offsets of a partition that are dealt to one task.
_BLOCK = 16384


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _log_files(spark, sf_dir, root: str):
    """The emulated log as files, and a stream over them in two batches: offsets below the middle, then the others.

    Tasks get blocks of offsets, so that none has a whole log partition. A stream takes files as they were written, so
    many at a time; the later half has no more rows of any partition than the first, and goes into as many files at most.
    """
    value = F.concat(F.lit('{"id":'), F.when(F.expr(_GOOD), F.col("event_id").cast("string")).otherwise('"x"'), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
    rel_by_hours(spark, sf_dir, "ev_log").select("part", "record_offset", "record_timestamp", "event_id", "user_id", "event_type").write.parquet(f"{root}/rows")
    numbered = spark.read.parquet(f"{root}/rows")
    middle = (numbered.agg(F.max("record_offset")).first()[0] or 0) // 2 + 1
    rows = numbered.select("part", "record_offset", "record_timestamp", F.encode(F.col("user_id").cast("string"), "utf-8").alias("key"), F.encode(value, "utf-8").alias("value"), F.create_map(F.lit("t"), F.col("event_type")).alias("headers"))
    block = F.expr(f"record_offset div {_BLOCK}")
    rows.where(F.col("record_offset") < middle).repartition("part", block).sortWithinPartitions("part", "record_offset").write.parquet(f"{root}/log")
    files = len([n for n in Store(spark, root).names("log") if n.startswith("part-")])
    rows.where(F.col("record_offset") >= middle).repartition(files, "part", block).sortWithinPartitions("part", "record_offset").write.mode("append").parquet(f"{root}/log")
    return spark.readStream.schema(spark.read.parquet(f"{root}/log").schema).option("maxFilesPerTrigger", files).parquet(f"{root}/log")


def _exported(spark, sf_dir, root: str, times: int = 1):
    stream = _log_files(spark, sf_dir, root)
    table = ExportTable(spark, f"{root}/table")
    table.ensure_schema([{"name": f.name, "type": f.type} for f in _FIELDS], 1)
    for k in range(times):
        export.start(stream, table, _FIELDS, f"{root}/checkpoint-{k}", dead_letters=f"{root}/dlq").awaitTermination()
    return table


_EXPORT = w("ev_log") + f"SELECT record_offset, record_timestamp, event_id AS id, event_type AS kind, dt, hour FROM ev_log WHERE {_GOOD}"
_COLUMNS = ("record_offset", "record_timestamp", "id", "kind", "dt", "hour")


@query("stream_export_consumer", _EXPORT)
def stream_export_consumer(spark, sf_dir):
    return _exported(spark, sf_dir, _root(spark, "export")).read().select(*_COLUMNS)


@query("stream_exactly_once", w("ev_log") + f"SELECT dt, cast(count(*) AS bigint) AS n FROM ev_log WHERE {_GOOD} GROUP BY dt")
def stream_exactly_once(spark, sf_dir):
    """The stream runs a second time without its checkpoint; the table stays the same."""
    return _exported(spark, sf_dir, _root(spark, "export"), times=2).read().groupBy("dt").agg(F.count("*").alias("n"))


@query("sink_parquet_chunk", w("ev_log") + "SELECT part AS source_partition, record_offset AS source_offset, 'field \"id\" must be int64' AS error FROM ev_log WHERE event_id % 11 = 0")
def sink_parquet_chunk(spark, sf_dir):
    """The dead letters of the export."""
    root = _root(spark, "export")
    _exported(spark, sf_dir, root)
    return spark.read.parquet(f"{root}/dlq").select(F.col("part").alias("source_partition"), F.col("record_offset").alias("source_offset"), "error")


@query("sink_export_pass", w("ev_log") + "SELECT part, max(record_offset) + 1 AS next_offset FROM ev_log GROUP BY part")
def sink_export_pass(spark, sf_dir):
    """The table's checkpoint after an export; one entry for each partition."""
    marks = _exported(spark, sf_dir, _root(spark, "export")).metadata()["checkpoint"]
    return spark.createDataFrame([(int(p), n) for p, n in marks.items()], "part int, next_offset long")


@query("sink_snapshot_commit", "SELECT 1::BIGINT AS snapshots, 2::BIGINT AS versions")
def sink_snapshot_commit(spark, sf_dir):
    """A snapshot committed twice is there once; the schema makes the other version."""
    table = ExportTable(spark, _root(spark, "table"))
    table.ensure_schema([{"name": "id", "type": "int64"}], 1)
    for _ in range(2):
        table.commit("data/batch=0", 3, {"0": 3})
    return spark.createDataFrame([(len(table.metadata()["snapshots"]), table.version())], "snapshots long, versions long")


@query("table_evolve", "SELECT * FROM (VALUES ('id', 8), ('note', 9), ('more', 10)) t(name, field_id)")
def table_evolve(spark, sf_dir):
    table = ExportTable(spark, _root(spark, "table"))
    table.ensure_schema([{"name": "id", "type": "int64"}, {"name": "note", "type": "string"}], 1)
    table.ensure_schema([{"name": "note", "type": "string"}, {"name": "more", "type": "bool"}, {"name": "id", "type": "int64"}], 2)
    return spark.createDataFrame([(f["name"], f["id"]) for f in table.metadata()["fields"]], "name string, field_id int")


@query("stream_resume", w("ev_log") + "SELECT part, cast(count(*) AS bigint) AS n FROM ev_log WHERE record_offset > 24 GROUP BY part")
def stream_resume(spark, sf_dir):
    """Tail from the offset after the last event id that a client saw."""
    root = _root(spark, "tail")
    stream = _log_files(spark, sf_dir, root).where("record_offset >= 24 + 1").select("part", "record_offset")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("part int, record_offset long").parquet(f"{root}/out").groupBy("part").agg(F.count("*").alias("n"))


@query("scan_stream_sse", w("ev_log") + "SELECT concat('id: ', cast(record_offset AS varchar), chr(10), 'data: ', cast(part AS varchar), chr(10), chr(10)) AS event FROM ev_log WHERE part = 1")
def scan_stream_sse(spark, sf_dir):
    root = _root(spark, "tail")
    stream = _log_files(spark, sf_dir, root).where("part = 1").select(F.format_string("id: %d\ndata: %s\n\n", "record_offset", F.col("part").cast("string")).alias("event"))
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event string").parquet(f"{root}/out")


@query("stream_late_data", w("ev_log") + f"SELECT dt, hour, cast(count(*) AS bigint) AS n FROM ev_log WHERE {_GOOD} GROUP BY 1, 2")
def stream_late_data(spark, sf_dir):
    """No watermark: rows lie in the hour they carry, whenever their batch ran."""
    return _exported(spark, sf_dir, _root(spark, "export")).read().groupBy("dt", "hour").agg(F.count("*").alias("n"))


_FOLD = w("sent", recursive=True) + ", o AS (SELECT *, row_number() OVER (PARTITION BY part, producer_id ORDER BY arrival) AS rn FROM sent), f AS (SELECT part, producer_id, arrival, rn, sequence, CASE WHEN sequence = 0 THEN 'accepted' ELSE 'gap' END AS verdict, CASE WHEN sequence = 0 THEN record_count ELSE 0 END AS nxt FROM o WHERE rn = 1 UNION ALL SELECT o.part, o.producer_id, o.arrival, o.rn, o.sequence, CASE WHEN o.sequence = f.nxt THEN 'accepted' WHEN o.sequence < f.nxt THEN 'duplicate' ELSE 'gap' END, CASE WHEN o.sequence = f.nxt THEN o.sequence + o.record_count ELSE f.nxt END FROM f JOIN o ON o.part = f.part AND o.producer_id = f.producer_id AND o.rn = f.rn + 1) SELECT part, producer_id, arrival, sequence, verdict FROM f"


@query("stream_producer_state", _FOLD)
def stream_producer_state(spark, sf_dir):
    """Two runs in arrival order, so state is carried from one batch to the next; files as the tasks write them."""
    root = _root(spark, "producers")
    sent = rel_by_hours(spark, sf_dir, "sent").withColumn("producer_id", F.col("producer_id").cast("long")).withColumn("arrival", F.col("arrival").cast("long"))
    for k, rows in enumerate((sent.where("arrival < 8"), sent.where("arrival >= 8"))):
        rows.write.mode("append").parquet(f"{root}/in/{k}")
    spark.read.parquet(f"{root}/in/0").write.mode("append").parquet(f"{root}/feed")
    out, done = f"{root}/out", f"{root}/checkpoint"

    def run():
        verdicts = state.producer_sequences(spark.readStream.schema(sent.schema).parquet(f"{root}/feed"))
        verdicts.writeStream.outputMode("append").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", done).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.read.parquet(f"{root}/in/1").write.mode("append").parquet(f"{root}/feed")
    run()
    return spark.read.parquet(out).select("part", "producer_id", "arrival", "sequence", "verdict")


@query("stream_group_state", "SELECT * FROM (VALUES ('a', 5::BIGINT, 'm2', 'm2', 'Stable'), ('b', 4, NULL, '', 'Empty')) t(grp, generation, leader, members, state)")
def stream_group_state(spark, sf_dir):
    events = spark.sql("SELECT * FROM VALUES ('a', 'join', 'm1', 0), ('a', 'join', 'm2', 10), ('a', 'heartbeat', 'm2', 90), ('a', 'join', 'm3', 95), ('a', 'heartbeat', 'm2', 180), ('a', 'leave', 'm9', 181), ('b', 'join', 'm1', 0), ('b', 'leave', 'm1', 5), ('b', 'join', 'm1', 6) t(grp, event, member, at)")
    events = events.where("NOT (grp = 'a' AND member = 'm3')").unionByName(spark.sql("SELECT 'a' AS grp, 'join' AS event, 'm0' AS member, 120 AS at UNION ALL SELECT 'a', 'leave', 'm0', 130")).withColumn("at", F.col("at").cast("long"))
    return state.group_states(events, 100, 200)
