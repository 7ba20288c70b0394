"""Queries of scalar functions and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.generator import LISTS, event_columns
from .catalog import query
from .fixtures import relation as rel
from .fixtures import with_clause as w

_FNV = "cast(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(k::BLOB) + 1), lambda i: ('0x' || hex(array_slice(k::BLOB, i, i)))::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS bigint)"


@query("route_partition", f"SELECT cast(h % 4 AS int) AS part, cast(count(*) AS bigint) AS n FROM (SELECT {_FNV} AS h FROM (SELECT concat('order-', cast(o_orderkey AS varchar)) AS k FROM orders)) GROUP BY 1")
def route_partition(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.encode(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), "utf-8")
    return orders.groupBy(S.route_partition(key, 4).alias("part")).agg(F.count("*").alias("n"))


@query("route_null_keys", w("ev_log") + f", r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast(user_id AS varchar) END AS k, row_number() OVER (ORDER BY event_id) - 1 AS a FROM ev_log) SELECT event_id, cast(CASE WHEN k IS NULL THEN a % 4 ELSE {_FNV} % 4 END AS int) AS part FROM r")
def route_null_keys(spark, sf_dir):
    """Arrival numbers come from the events' dense ids, so no global sort is needed."""
    log = rel(spark, sf_dir, "ev_log")
    key = F.when(F.col("event_id") % 3 != 0, F.encode(F.col("user_id").cast("string"), "utf-8"))
    first = log.agg(F.min("event_id").alias("first"))
    return log.crossJoin(F.broadcast(first)).select("event_id", S.route_partition(key, 4, F.col("event_id") - F.col("first")).alias("part"))


@query("hash_producer_id", w("ev_log") + ", s AS (SELECT DISTINCT concat('dlq-', event_type) AS name FROM ev_log) SELECT name, cast(('0x' || substr(sha256(name), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS bigint) AS producer_id FROM s")
def hash_producer_id(spark, sf_dir):
    names = rel(spark, sf_dir, "ev_log").select(F.concat(F.lit("dlq-"), "event_type").alias("name")).distinct()
    return names.select("name", S.hash_producer_id(F.col("name")).alias("producer_id"))


@query("export_file_id", w("files") + "SELECT file_path, substr(sha256(concat_ws('|', 'events', '0', dt, cast(hour AS varchar), '0', cast(record_count AS varchar), '1', 'seg')), 1, 32) AS file_id FROM files")
def export_file_id(spark, sf_dir):
    f = rel(spark, sf_dir, "files")
    text = lambda c: F.col(c).cast("string")
    return f.select("file_path", S.export_file_id(F.lit("events"), F.lit("0"), F.col("dt"), text("hour"), F.lit("0"), text("record_count"), F.lit("1"), F.lit("seg")).alias("file_id"))


@query("export_object_key", w("files") + "SELECT DISTINCT dt, hour, concat('events/data/dt=', dt, '/hour=', lpad(cast(hour AS varchar), 2, '0'), '/x.parquet') AS object_key FROM files")
def export_object_key(spark, sf_dir):
    f = rel(spark, sf_dir, "files").select("dt", "hour").distinct()
    return f.select("dt", "hour", S.export_data_file_key(F.lit("events"), F.col("dt"), F.col("hour"), F.lit("x")).alias("object_key"))


_NAMES = "(VALUES ('a/b_c'), ('a_b/c'), ('plain'), ('__'), ('x//y'))"


@query("sanitize_name", f"SELECT name, replace(replace(name, '_', '__'), '/', '_') AS safe FROM {_NAMES} t(name)")
def sanitize_name(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_NAMES} t(name)").select("name", S.sanitize_name(F.col("name")).alias("safe"))


@query("sanitize_merge_topic", f"SELECT name, replace(name, '/', '_') AS safe FROM {_NAMES} t(name)")
def sanitize_merge_topic(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_NAMES} t(name)").select("name", S.sanitize_merge_topic(F.col("name")).alias("safe"))


_KEY = "concat('events/', cast(part AS varchar), '/', lpad(cast(base_offset AS varchar), 20, '0'), '-', cast(end_offset AS varchar), '-', cast(epoch AS varchar), '.segment')"


@query("segment_key_format", w("segments") + f"SELECT part, base_offset, {_KEY} AS segment_key FROM segments")
def segment_key_format(spark, sf_dir):
    s = rel(spark, sf_dir, "segments")
    return s.select("part", "base_offset", S.segment_key(F.lit("events"), *map(F.col, ("part", "base_offset", "end_offset", "epoch"))).alias("segment_key"))


@query("segment_key_parse", w("segments") + f"SELECT {_KEY} AS segment_key, 'events' AS topic, part, base_offset, end_offset, epoch FROM segments")
def segment_key_parse(spark, sf_dir):
    s = rel(spark, sf_dir, "segments")
    keys = s.select(S.segment_key(F.lit("events"), *map(F.col, ("part", "base_offset", "end_offset", "epoch"))).alias("segment_key"))
    return keys.withColumn("k", S.parse_segment_key(F.col("segment_key"))).select("segment_key", "k.*")


@query("flush_key_parse", w("ev_log") + "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE record_timestamp END AS upload_ms FROM ev_log")
def flush_key_parse(spark, sf_dir):
    key = F.concat(F.lit("node-a-"), F.col("record_timestamp").cast("string"), F.lit("-7"), F.when(F.col("event_id") % 5 == 0, ".tmp").otherwise(".data"))
    return rel(spark, sf_dir, "ev_log").select("event_id", S.flush_upload_ms(key).alias("upload_ms"))


@query("partition_key_parse", "SELECT * FROM (VALUES ('a#b#3', 'a#b', 3), ('t#0', 't', 0), ('bad', '', NULL)) t(k, topic, part)")
def partition_key_parse(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('a#b#3'), ('t#0'), ('bad') t(k)").withColumn("p", S.parse_partition_key(F.col("k"))).select("k", "p.*")


@query("normalize_ts_ms", w("ev_log") + "SELECT event_id, record_timestamp AS ms FROM ev_log")
def normalize_ts_ms(spark, sf_dir):
    ts = F.when(F.col("event_id") % 2 == 0, F.col("record_timestamp") * 1000000 + 999999).otherwise(F.col("record_timestamp"))
    return rel(spark, sf_dir, "ev_log").select("event_id", S.normalize_ts_ms(ts).alias("ms"))


@query("bucket_dt_hour", w("ev_log") + "SELECT event_id, dt, hour FROM ev_log")
def bucket_dt_hour(spark, sf_dir):
    ms = F.col("record_timestamp")
    return rel(spark, sf_dir, "ev_log").select("event_id", S.bucket_dt(ms).alias("dt"), S.bucket_hour(ms).alias("hour"))


@query("ingest_time", w("ev_log") + "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN record_timestamp + 5 WHEN event_id % 3 = 1 THEN record_timestamp ELSE 0 END AS ingest_ms FROM ev_log")
def ingest_time(spark, sf_dir):
    created = F.expr("CASE WHEN event_id % 3 = 0 THEN record_timestamp + 5 END")
    record = F.expr("CASE WHEN event_id % 3 < 2 THEN record_timestamp END")
    return rel(spark, sf_dir, "ev_log").select("event_id", S.ingest_ms(created, record).alias("ingest_ms"))


@query("parse_timestamp", "SELECT * FROM (VALUES ('2026-08-06T12:00:00Z', 1786017600000000), ('2026-08-06T14:00:00.123456789+02:00', 1786017600123456), ('2263-01-01T00:00:00Z', NULL), ('1677-09-21T00:12:43.145224192Z', -9223372036854776), ('2026-08-06', NULL), ('2026-08-06T12:00:00', NULL), ('2262-04-11T23:47:16.854775807Z', 9223372036854775), ('2262-04-11T23:47:16.854775808Z', NULL)) t(v, us)")
def parse_timestamp(spark, sf_dir):
    values = "('2026-08-06T12:00:00Z'), ('2026-08-06T14:00:00.123456789+02:00'), ('2263-01-01T00:00:00Z'), ('1677-09-21T00:12:43.145224192Z'), ('2026-08-06'), ('2026-08-06T12:00:00'), ('2262-04-11T23:47:16.854775807Z'), ('2262-04-11T23:47:16.854775808Z')"
    return spark.sql(f"SELECT * FROM VALUES {values} t(v)").withColumn("us", S.parse_timestamp_us(F.col("v")))


@query("utf8_or_base64", "SELECT * FROM (VALUES ('6869', 'hi'), ('FE01', '/gE='), ('C3A9', 'é')) t(h, v)")
def utf8_or_base64(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('6869'), ('FE01'), ('C3A9') t(h)").withColumn("v", S.utf8_or_base64(F.unhex("h")))


@query("typed_value_bytes", "SELECT * FROM (VALUES ('avro', '/gE=', 'FE01'), ('json', 'hi', '6869'), ('protobuf', '?', NULL)) t(e, v, h)")
def typed_value_bytes(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('avro', '/gE='), ('json', 'hi'), ('protobuf', '?') t(e, v)").withColumn("h", F.hex(S.typed_value_bytes(F.col("v"), F.col("e"))))


@query("headers_json", w("ev_log") + """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('{"type":"', event_type, '"}') ELSE '' END AS headers FROM ev_log""")
def headers_json(spark, sf_dir):
    headers = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.col("event_type")))
    return rel(spark, sf_dir, "ev_log").select("event_id", S.headers_json(headers).alias("headers"))


@query("envelope_wrap", w("ev_log") + "SELECT event_id, concat('00', lpad(printf('%X', event_id), 8, '0'), hex(encode(event_type))) AS wrapped FROM ev_log")
def envelope_wrap(spark, sf_dir):
    return rel(spark, sf_dir, "ev_log").select("event_id", F.hex(S.envelope_wrap(F.col("event_id"), F.encode("event_type", "utf-8"))).alias("wrapped"))


@query("envelope_unwrap", w("ev_log") + "SELECT event_id, event_id AS schema_id, event_type AS payload FROM ev_log")
def envelope_unwrap(spark, sf_dir):
    wrapped = S.envelope_wrap(F.col("event_id"), F.encode("event_type", "utf-8"))
    rows = rel(spark, sf_dir, "ev_log").withColumn("e", S.envelope_unwrap(wrapped))
    return rows.select("event_id", "e.schema_id", F.col("e.payload").cast("string").alias("payload"))


@query("sink_sse_event", w("ev_log") + "SELECT event_id, concat('id: ', cast(record_offset AS varchar), chr(10), 'data: ', props, chr(10), chr(10)) AS event FROM ev_log")
def sink_sse_event(spark, sf_dir):
    return rel(spark, sf_dir, "ev_log").select("event_id", S.sse_event(F.col("record_offset"), F.col("props")).alias("event"))


@query("readiness_parse_size", "SELECT v, n::BIGINT AS n FROM (VALUES ('1GiB', 1073741824), ('64MB', 64000000), ('512', 512), ('7K', 7000), ('x', NULL), ('2 KiB', 2048)) t(v, n)")
def readiness_parse_size(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('1GiB'), ('64MB'), ('512'), ('7K'), ('x'), ('2 KiB') t(v)").withColumn("n", S.parse_byte_size(F.col("v")))


@query("key_component_check", "SELECT * FROM (VALUES ('ok', true), ('a/b', false), ('a\\b', false), ('..', false), ('', false), ('a b', true)) t(v, ok)")
def key_component_check(spark, sf_dir):
    rows = spark.sql(r"SELECT * FROM VALUES ('ok'), ('a/b'), ('a\\b'), ('..'), (''), ('a b') t(v)")
    return rows.withColumn("ok", S.key_component_ok(F.col("v")))


@query("filter_readiness_key", w("ev_log") + "SELECT event_id FROM ev_log WHERE event_id % 4 <> 0")
def filter_readiness_key(spark, sf_dir):
    key = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("readiness-probe-"), F.col("event_id").cast("string"))).otherwise("k")
    return rel(spark, sf_dir, "ev_log").where(~F.regexp_like(key, F.lit("^readiness-probe-[0-9]+$"))).select("event_id")


@query("latency_mean", w("ev_log") + "SELECT event_type, avg(nbytes) AS p50, avg(nbytes) AS p95, avg(nbytes) AS p99, quantile_disc(nbytes, 0.5) AS true_p50 FROM ev_log GROUP BY 1")
def latency_mean(spark, sf_dir):
    """All three reported percentiles are the mean, as in the report's format; the true median stands beside them."""
    mean = F.avg("nbytes")
    return rel(spark, sf_dir, "ev_log").groupBy("event_type").agg(mean.alias("p50"), mean.alias("p95"), mean.alias("p99"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY nbytes)").cast("long").alias("true_p50"))


@query("agg_target_count", "SELECT target, size, n::BIGINT AS n FROM (VALUES (5368709120, 1024, 5242880), (10, 3, 4), (9, 3, 3)) t(target, size, n)")
def agg_target_count(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES (5368709120L, 1024), (10L, 3), (9L, 3) t(target, size)").withColumn("n", F.expr("(target + size - 1) div size"))


@query("snapshot_id_key", w("files") + "SELECT dt, cast(('0x' || substr(sha256(dt), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS bigint) AS snapshot_id FROM (SELECT DISTINCT dt FROM files)")
def snapshot_id_key(spark, sf_dir):
    return rel(spark, sf_dir, "files").select("dt").distinct().withColumn("snapshot_id", S.hash_producer_id(F.col("dt")))


@query("manifest_content_hash", w("files") + "SELECT dt, substr(sha256(string_agg(concat(file_path, ':', cast(record_count AS varchar)), '|' ORDER BY file_path)), 1, 12) AS content FROM files GROUP BY dt")
def manifest_content_hash(spark, sf_dir):
    entry = F.concat("file_path", F.lit(":"), F.col("record_count").cast("string"))
    return rel(spark, sf_dir, "files").groupBy("dt").agg(F.substring(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(entry))), 256), 1, 12).alias("content"))


def _picked(name: str) -> str:
    values = ", ".join("'" + v.replace("'", "''") + "'" for v in LISTS[name])
    return f"[{values}][event_id % {len(LISTS[name])} + 1] AS {name}"


@query("bench_event_generate", w("ev_log") + f"SELECT 'run' AS run_id, event_id AS id, 'xyz' AS payload, 3::BIGINT AS payload_bytes, event_id AS sequence, event_id, concat('user-', event_id % 10000) AS user_id, concat('session-', (event_id // 3) % 50000) AS session_id, {', '.join(map(_picked, LISTS))}, strftime(to_timestamp(1700000000 + event_id), '%Y-%m-%dT%H:%M:%SZ') AS event_time, event_id % 60000 + 1 AS duration_ms, (event_id % 1000) / 100.0::DOUBLE AS revenue FROM ev_log")
def bench_event_generate(spark, sf_dir):
    """All fields of the events whose sequence numbers the log holds."""
    return rel(spark, sf_dir, "ev_log").select(*event_columns(F.col("event_id"), "run", "xyz"))
