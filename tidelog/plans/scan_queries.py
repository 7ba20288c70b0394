"""Queries of log reads and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import batches, scan
from ..operators.small import small
from .catalog import query
from .decode_queries import batched
from .fixtures import relation as rel
from .fixtures import with_clause as w

_ROW = "part, record_offset, event_id"
_T = 1704900000000  # 2024-01-10T15:20:00Z


@query("scan_offset_range", w("ev_log") + f"SELECT {_ROW} FROM ev_log WHERE part = 1 AND record_offset >= 20 AND record_offset < 70")
def scan_offset_range(spark, sf_dir):
    return scan.offset_range(rel(spark, sf_dir, "ev_log"), 1, 20, 50).select("part", "record_offset", "event_id")


@query("scan_fetch", w("gaps") + f", g AS (SELECT *, record_offset - row_number() OVER (PARTITION BY part ORDER BY record_offset) AS d, min(record_offset) OVER (PARTITION BY part) AS lo FROM gaps WHERE part = 0) SELECT {_ROW} FROM g WHERE d = lo - 1")
def scan_fetch(spark, sf_dir):
    return scan.contiguous_prefix(rel(spark, sf_dir, "gaps").where("part = 0")).select("part", "record_offset", "event_id")


@query("scan_committed", w("ev_log", "ends") + f"SELECT ev_log.part, record_offset, event_id FROM ev_log JOIN ends USING (part) WHERE record_offset < hw")
def scan_committed(spark, sf_dir):
    return scan.committed(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "ends")).select("part", "record_offset", "event_id")


@query("filter_high_watermark", w("ev_log", "ends") + "SELECT ev_log.part, cast(count(*) AS bigint) AS readable FROM ev_log JOIN ends USING (part) WHERE record_offset < hw GROUP BY ev_log.part")
def filter_high_watermark(spark, sf_dir):
    return scan.committed(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "ends")).groupBy("part").agg(F.count("*").alias("readable"))


@query("validate_committed_range", "SELECT * FROM (VALUES (2, 4, 5, true), (4, 2, 5, false), (2, 5, 5, false), (5, 5, 5, false), (4, 4, 5, true)) t(s, e, hw, ok)")
def validate_committed_range(spark, sf_dir):
    rows = []
    for s, e, hw in ((2, 4, 5), (4, 2, 5), (2, 5, 5), (5, 5, 5), (4, 4, 5)):
        try:
            scan.validate_committed_range(s, e, hw)
            rows.append((s, e, hw, True))
        except ValueError:
            rows.append((s, e, hw, False))
    return spark.createDataFrame(rows, "s int, e int, hw int, ok boolean")


_RAW = """, q AS (SELECT part, (part + 1) * 22 AS start_offset, hw FROM ends),
a AS (SELECT DISTINCT b.part, b.batch_no, first_offset, last_offset, nbytes, CASE WHEN first_offset < log_end * 2 // 5 THEN 0 WHEN first_offset < log_end // 2 THEN 1 ELSE 2 END AS source
  FROM batches b JOIN ends USING (part) WHERE NOT (batch_no % 23 = 8 AND first_offset < log_end * 2 // 5 AND b.part <> 1)),
c AS (SELECT a.*, start_offset, sum(nbytes) OVER (PARTITION BY part ORDER BY batch_no) AS s, row_number() OVER (PARTITION BY part ORDER BY batch_no) AS n FROM a JOIN q USING (part) WHERE last_offset >= start_offset AND first_offset < hw)
SELECT part, first_offset, last_offset, nbytes, source FROM c WHERE batch_no = start_offset // 10 + n - 1 AND (s <= 9000 OR n = 1)"""


@query("scan_raw_batches", w("batches", "ends") + _RAW)
def scan_raw_batches(spark, sf_dir):
    """Sealed segments with a hole, those on their way to the store, and the active one; the sources overlap."""
    ends = rel(spark, sf_dir, "ends")
    b = rel(spark, sf_dir, "batches").join(small(ends.select("part", "log_end")), "part")
    sealed = b.where("first_offset < log_end * 2 div 5 AND NOT (batch_no % 23 = 8 AND part <> 1)")
    pending = b.where("first_offset >= log_end * 2 div 5 - 20 AND first_offset < log_end div 2 AND NOT (batch_no % 23 = 8 AND first_offset < log_end * 2 div 5 AND part <> 1)")
    requests = ends.select("part", ((F.col("part") + 1) * 22).alias("start_offset"), F.col("hw").alias("bound"))
    return batches.raw_read([sealed, pending, b.where("first_offset >= log_end div 2")], requests, 9000).select("part", "first_offset", "last_offset", "nbytes", F.col("source").cast("int"))


@query("scan_sealed_range", w("batches") + "SELECT part, min(first_offset) AS base_offset, max(last_offset) AS end_offset, cast(sum(nbytes) AS bigint) AS nbytes FROM (SELECT *, sum(nbytes) OVER (PARTITION BY part ORDER BY first_offset) AS s FROM batches WHERE last_offset >= 33) WHERE s <= 5000 GROUP BY part")
def scan_sealed_range(spark, sf_dir):
    kept = scan.byte_budget(rel(spark, sf_dir, "batches").where("last_offset >= 33"), "nbytes", 5000, "first_offset", "part")
    return kept.groupBy("part").agg(F.min("first_offset").alias("base_offset"), F.max("last_offset").alias("end_offset"), F.sum("nbytes").alias("nbytes"))


@query("scan_page_http", w("ev_log") + "SELECT cast(count(*) AS bigint) AS n, max(record_offset) + 1 AS next_offset FROM ev_log WHERE part = 2 AND record_offset >= 10 AND record_offset < 50")
def scan_page_http(spark, sf_dir):
    return scan.page(rel(spark, sf_dir, "ev_log"), 2, 10, 40)


@query("scan_consume_http", w("ev_log") + f"SELECT {_ROW} FROM ev_log WHERE part = 3 AND record_offset < 100")
def scan_consume_http(spark, sf_dir):
    return scan.read_committed(rel(spark, sf_dir, "ev_log"), 3, 0, 10**9, scan.http_limit(None)).select("part", "record_offset", "event_id")


@query("scan_consume_diskless", w("ev_log", "ends") + "SELECT part, record_offset, event_id FROM ev_log JOIN ends USING (part) WHERE part = 0 AND record_offset >= 5 AND record_offset < least(hw, 45)")
def scan_consume_diskless(spark, sf_dir):
    log = scan.committed(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "ends"))
    return scan.offset_range(log, 0, 5, 40).select("part", "record_offset", "event_id")


@query("scan_diskless_fetch", w("batches", "ends") + """, q AS (SELECT part, part * 13 + 5 AS start_offset, hw // 50 * 50 AS head FROM ends)
SELECT b.part, first_offset, last_offset, record_count, true AS ok FROM batches b JOIN q USING (part) WHERE last_offset >= start_offset AND first_offset < head""")
def scan_diskless_fetch(spark, sf_dir):
    """Files of stored batches of several partitions; each ref's range is read, and its batches get their offsets."""
    stored = batched(spark, sf_dir).withColumn("raw", S.patched_batch(F.col("raw"), F.lit(0), F.lit(-1))).withColumn("k", F.floor(F.col("first_offset") / 50))
    ranges = stored.groupBy("part", "k").agg(F.min("first_offset").alias("base_offset"), F.max("last_offset").alias("last"), F.array_sort(F.collect_list(F.struct("first_offset", "raw"))).alias("b"))
    ranges = ranges.select("part", "base_offset", (F.col("last") + 1).alias("end_offset"), F.concat_ws("-", F.lit("f"), F.floor(F.col("k") / 2), F.floor(F.col("part") / 2)).alias("file_key"), batches.concatenated(F.transform("b", lambda x: x["raw"])).alias("raw"))
    before = F.sum(F.length("raw")).over(Window.partitionBy("file_key").orderBy("part", "base_offset").rowsBetween(Window.unboundedPreceding, -1))
    refs = ranges.select("part", "base_offset", "end_offset", "file_key", F.length("raw").alias("byte_length"), F.coalesce(before, F.lit(0).cast("long")).alias("byte_offset"))
    files = ranges.groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("part", "base_offset", "raw"))).alias("r")).select("file_key", batches.concatenated(F.transform("r", lambda x: x["raw"])).alias("content"))
    requests = rel(spark, sf_dir, "ends").select("part", (F.col("part") * 13 + 5).alias("start_offset"), F.expr("hw div 50 * 50").alias("head"))
    found = batches.fetch(refs, files, requests, 64 << 20)
    return found.select("part", "first_offset", "last_offset", "record_count", batches.intact("raw").alias("ok"))


@query("scan_ref_seek", w("batches", "refs") + "SELECT r.part, r.base_offset, min(b.first_offset) AS batch_offset FROM refs r JOIN batches b ON b.part = r.part AND b.first_offset >= r.base_offset AND b.last_offset < r.end_offset WHERE b.last_offset >= r.base_offset + 25 GROUP BY 1, 2")
def scan_ref_seek(spark, sf_dir):
    # the batch that holds the ref's 26th record: batches never span refs, so they meet on 50-offset blocks
    refs = rel(spark, sf_dir, "refs").withColumn("k", F.floor(F.col("base_offset") / 50))
    batches = rel(spark, sf_dir, "batches").withColumn("k", F.floor(F.col("first_offset") / 50))
    met = refs.select("part", "k", "base_offset").join(batches.select("part", "k", "first_offset", "last_offset"), ["part", "k"]).where("last_offset >= base_offset + 25")
    return met.groupBy("part", "base_offset").agg(F.min("first_offset").alias("batch_offset"))


@query("query_segments", w("refs") + ", r AS (SELECT *, sum(byte_length) OVER (PARTITION BY part ORDER BY base_offset) AS s, row_number() OVER (PARTITION BY part ORDER BY base_offset) AS n FROM refs WHERE end_offset > 75) SELECT part, file_key, base_offset FROM r WHERE s <= 4000 OR n = 1")
def query_segments(spark, sf_dir):
    return scan.byte_budget(rel(spark, sf_dir, "refs").where("end_offset > 75"), "byte_length", 4000, "base_offset", "part").select("part", "file_key", "base_offset")


@query("scan_diskless_export", w("ev_log", "ends") + "SELECT part, cast(count(*) AS bigint) AS n, cast(max(record_offset) AS bigint) AS last_offset FROM ev_log JOIN ends USING (part) WHERE record_offset < hw GROUP BY part")
def scan_diskless_export(spark, sf_dir):
    rows = scan.committed(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "ends"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.max("record_offset").alias("last_offset"))


@query("scan_kafka_fetch", w("batches") + ", r AS (SELECT *, sum(nbytes) OVER (PARTITION BY part ORDER BY first_offset) AS s, row_number() OVER (PARTITION BY part ORDER BY first_offset) AS n FROM batches WHERE last_offset >= 12) SELECT part, cast(sum(record_count) AS bigint) AS records, max(last_offset) + 1 AS next_offset FROM r WHERE s <= 16777216 OR n = 1 GROUP BY part")
def scan_kafka_fetch(spark, sf_dir):
    kept = scan.byte_budget(rel(spark, sf_dir, "batches").where("last_offset >= 12"), "nbytes", 16 << 20, "first_offset", "part")
    return kept.groupBy("part").agg(F.sum("record_count").alias("records"), (F.max("last_offset") + 1).alias("next_offset"))


@query("list_offsets", w("ev_log", "ends") + "SELECT part, min(record_offset) AS earliest, max(record_offset) + 1 AS latest, any_value(hw) AS hw FROM ev_log JOIN ends USING (part) GROUP BY part")
def list_offsets(spark, sf_dir):
    return scan.list_offsets(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "ends"))


@query("seek_timestamp", w("ev_log", "ends") + f"SELECT e.part, coalesce(m, -1) AS record_offset FROM ends e LEFT JOIN (SELECT part, min(record_offset) AS m FROM ev_log WHERE record_timestamp >= {_T} GROUP BY part) USING (part)")
def seek_timestamp(spark, sf_dir):
    return scan.seek_timestamp(rel(spark, sf_dir, "ev_log"), _T, rel(spark, sf_dir, "ends"))


@query("filter_ts_segment", w("segments") + f"SELECT part, min(base_offset) AS base_offset FROM segments WHERE max_timestamp >= {_T} GROUP BY part")
def filter_ts_segment(spark, sf_dir):
    return rel(spark, sf_dir, "segments").where(F.col("max_timestamp") >= _T).groupBy("part").agg(F.min("base_offset").alias("base_offset"))


@query("index_lookup", w("ev_log", "segments") + "SELECT e.part, e.record_offset, s.base_offset, s.end_offset FROM ev_log e JOIN segments s ON e.part = s.part AND e.record_offset BETWEEN s.base_offset AND s.end_offset")
def index_lookup(spark, sf_dir):
    return scan.locate(rel(spark, sf_dir, "ev_log").select("part", "record_offset"), rel(spark, sf_dir, "segments").select("part", "base_offset", "end_offset"), 100)


@query("join_offset_to_segment", w("ev_log", "segments") + "SELECT s.part, s.base_offset, cast(count(*) AS bigint) AS n FROM ev_log e JOIN segments s ON e.part = s.part AND e.record_offset BETWEEN s.base_offset AND s.end_offset GROUP BY 1, 2")
def join_offset_to_segment(spark, sf_dir):
    met = scan.locate(rel(spark, sf_dir, "ev_log").select("part", "record_offset"), rel(spark, sf_dir, "segments").select("part", "base_offset", "end_offset"), 64)
    return met.groupBy("part", "base_offset").agg(F.count("*").alias("n"))


@query("index_segments_from", w("segments") + "SELECT part, base_offset, end_offset FROM segments WHERE part = 1 AND end_offset >= 10 ORDER BY base_offset LIMIT 3")
def index_segments_from(spark, sf_dir):
    return scan.segments_from(rel(spark, sf_dir, "segments"), 1, 10, 3).select("part", "base_offset", "end_offset")


@query("index_bounds", w("segments") + "SELECT part, min(base_offset) AS first_offset, max(end_offset) + 1 AS next_offset FROM segments GROUP BY part")
def index_bounds(spark, sf_dir):
    return scan.bounds(rel(spark, sf_dir, "segments"))


@query("sidecar_lookup", w("batches") + "SELECT part, arg_max(batch_no, first_offset) AS batch_no FROM batches WHERE first_offset <= 37 GROUP BY part")
def sidecar_lookup(spark, sf_dir):
    return scan.last_before(rel(spark, sf_dir, "batches"), "first_offset", 37, "batch_no")


@query("log_active_lookup", w("batches") + "SELECT part, batch_no FROM batches WHERE 42 BETWEEN first_offset AND last_offset")
def log_active_lookup(spark, sf_dir):
    return rel(spark, sf_dir, "batches").where("42 BETWEEN first_offset AND last_offset").select("part", "batch_no")


@query("w_timestamp_index", w("batches") + ", r AS (SELECT *, max(max_timestamp) OVER (PARTITION BY part ORDER BY first_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM batches) SELECT part, first_offset, max_timestamp FROM r WHERE p IS NULL OR max_timestamp > p")
def w_timestamp_index(spark, sf_dir):
    return scan.timestamp_index(rel(spark, sf_dir, "batches")).select("part", "first_offset", "max_timestamp")


@query("lookup_timestamp_index", w("batches") + f"SELECT part, arg_max(first_offset, max_timestamp) AS first_offset FROM batches WHERE max_timestamp <= {_T} GROUP BY part")
def lookup_timestamp_index(spark, sf_dir):
    index = scan.timestamp_index(rel(spark, sf_dir, "batches"))
    return scan.last_before(index, "max_timestamp", _T, "first_offset")


@query("segment_batches", w("batches") + "SELECT part, batch_no, first_offset FROM batches WHERE last_offset >= 25 AND last_offset < 100")
def segment_batches(spark, sf_dir):
    return rel(spark, sf_dir, "batches").where("last_offset >= 25 AND last_offset < 100").select("part", "batch_no", "first_offset")


@query("segment_messages", w("ev_log", "batches") + f"SELECT e.part, e.record_offset, e.event_id FROM ev_log e JOIN batches b ON e.part = b.part AND e.record_offset BETWEEN b.first_offset AND b.last_offset WHERE b.batch_no BETWEEN 2 AND 4 AND e.record_offset >= 27")
def segment_messages(spark, sf_dir):
    """The batch limit applies first, then the offset."""
    batches = rel(spark, sf_dir, "batches").where("batch_no BETWEEN 2 AND 4").select("part", F.col("first_offset").alias("base_offset"), F.col("last_offset").alias("end_offset"))
    rows = rel(spark, sf_dir, "ev_log").where("record_offset >= 27").select("part", "record_offset", "event_id")
    return scan.locate(rows, batches, 10).select("part", "record_offset", "event_id")


@query("scan_partition_head", w("ev_log", "ends") + "SELECT part, max(record_offset) + 1 AS next_offset, any_value(hw) AS committed_offset, min(record_offset) AS start_offset FROM ev_log JOIN ends USING (part) GROUP BY part")
def scan_partition_head(spark, sf_dir):
    out = scan.list_offsets(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "ends"))
    return out.select("part", F.col("latest").alias("next_offset"), F.col("hw").alias("committed_offset"), F.col("earliest").alias("start_offset"))


@query("scan_catalog", "SELECT event_type AS topic, cast(count(DISTINCT user_id % 4) AS bigint) AS partitions FROM events GROUP BY 1")
def scan_catalog(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("event_type").alias("topic")).agg(F.count_distinct(F.col("user_id") % 4).alias("partitions"))


@query("scan_parquet_footer", "SELECT cast(count(*) AS bigint) AS row_count FROM events")
def scan_parquet_footer(spark, sf_dir):
    """A count without columns is answered from the footers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count("*").alias("row_count"))


@query("w_byte_budget", w("ev_log") + f", r AS (SELECT *, sum(nbytes) OVER (PARTITION BY part ORDER BY record_offset) AS s, row_number() OVER (PARTITION BY part ORDER BY record_offset) AS n FROM ev_log WHERE record_offset >= 30) SELECT {_ROW} FROM r WHERE s <= 1000 OR n = 1")
def w_byte_budget(spark, sf_dir):
    return scan.byte_budget(rel(spark, sf_dir, "ev_log").where("record_offset >= 30"), "nbytes", 1000, "record_offset", "part").select("part", "record_offset", "event_id")


@query("limit_bytes", w("refs") + ", r AS (SELECT *, sum(byte_length) OVER (PARTITION BY part ORDER BY base_offset) AS s, row_number() OVER (PARTITION BY part ORDER BY base_offset) AS n FROM refs) SELECT part, cast(count(*) AS bigint) AS n_refs, cast(sum(byte_length) AS bigint) AS nbytes FROM r WHERE s <= 1 OR n = 1 GROUP BY part")
def limit_bytes(spark, sf_dir):
    kept = scan.byte_budget(rel(spark, sf_dir, "refs"), "byte_length", 1, "base_offset", "part")
    return kept.groupBy("part").agg(F.count("*").alias("n_refs"), F.sum("byte_length").alias("nbytes"))


@query("limit_records", w("ends") + "SELECT part, least(hw - 10, 1000) AS n FROM ends")
def limit_records(spark, sf_dir):
    return rel(spark, sf_dir, "ends").select("part", F.least(F.col("hw") - 10, F.lit(scan.http_limit(30_000)).cast("long")).alias("n"))


@query("dedup_overlap_last_wins", w("sources") + "SELECT part, record_offset, arg_max(event_id, source_ord) AS event_id, arg_max(value, source_ord) AS value FROM sources GROUP BY 1, 2")
def dedup_overlap_last_wins(spark, sf_dir):
    return scan.dedup_last_wins(rel(spark, sf_dir, "sources")).select("part", "record_offset", "event_id", "value")


@query("topn_lowest_offsets", w("sources") + "SELECT part, record_offset, arg_max(value, source_ord) AS value FROM sources WHERE part = 1 GROUP BY 1, 2 ORDER BY record_offset LIMIT 25")
def topn_lowest_offsets(spark, sf_dir):
    return scan.lowest_offsets(rel(spark, sf_dir, "sources"), 1, 25).select("part", "record_offset", "value")


@query("union_log_sources", w("ev_log") + "SELECT part, record_offset, event_id, CASE WHEN record_offset >= 60 THEN value * 2 ELSE value END AS value FROM ev_log")
def union_log_sources(spark, sf_dir):
    log = rel(spark, sf_dir, "ev_log").select("part", "record_offset", "event_id", "value")
    return scan.union_sources(log.where("record_offset < 50"), log.where("record_offset BETWEEN 40 AND 79"), log.where("record_offset >= 60").withColumn("value", F.col("value") * 2))


@query("w_contiguous_prefix", w("gaps") + f", g AS (SELECT *, record_offset - row_number() OVER (PARTITION BY part ORDER BY record_offset) AS d, min(record_offset) OVER (PARTITION BY part) AS lo FROM gaps) SELECT {_ROW} FROM g WHERE d = lo - 1")
def w_contiguous_prefix(spark, sf_dir):
    return scan.contiguous_prefix(rel(spark, sf_dir, "gaps")).select("part", "record_offset", "event_id")


@query("w_committed_run", w("gaps") + ", g AS (SELECT *, record_offset - row_number() OVER (PARTITION BY part ORDER BY record_offset) AS d, min(record_offset) OVER (PARTITION BY part) AS lo FROM gaps) SELECT part, max(record_offset) + 1 AS committed_head FROM g WHERE d = lo - 1 GROUP BY part")
def w_committed_run(spark, sf_dir):
    return scan.contiguous_prefix(rel(spark, sf_dir, "gaps")).groupBy("part").agg((F.max("record_offset") + 1).alias("committed_head"))


@query("kafka_fetch_hw", w("ends") + "SELECT part, CASE WHEN part % 2 = 0 THEN hw ELSE log_end END AS high_watermark FROM ends")
def kafka_fetch_hw(spark, sf_dir):
    return rel(spark, sf_dir, "ends").select("part", F.coalesce(F.expr("CASE WHEN part % 2 = 0 THEN hw END"), "log_end").alias("high_watermark"))


@query("follower_sealed_sync", w("segments") + "SELECT part, max(end_offset) + 1 AS sealed_end FROM segments GROUP BY part")
def follower_sealed_sync(spark, sf_dir):
    """Segments cover the log side by side, so the contiguous prefix ends with the last one."""
    from pyspark.sql import Window

    order = Window.partitionBy("part").orderBy("base_offset")
    rows = rel(spark, sf_dir, "segments").withColumn("_hole", F.coalesce(F.col("base_offset") - F.lag("end_offset").over(order) - 1, F.lit(0)))
    rows = rows.withColumn("_bad", F.max("_hole").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_bad = 0")
    return rows.groupBy("part").agg((F.max("end_offset") + 1).alias("sealed_end"))
