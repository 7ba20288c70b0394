"""Queries of reports, offset checks and log-integrity windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators.small import small
from .catalog import query
from .fixtures import relation as rel
from .fixtures import with_clause as w


@query("agg_report_topic", w("windows") + "SELECT topic, cast(sum(produced) AS bigint) AS produced, cast(sum(consumed) AS bigint) AS consumed, cast(sum(gaps + seq_errors + decode_errors) AS bigint) AS errors, (max(end_ms) - min(start_ms)) / 1000.0::DOUBLE AS seconds, sum(produced) / ((max(end_ms) - min(start_ms)) / 1000.0::DOUBLE) AS rate FROM windows GROUP BY topic")
def agg_report_topic(spark, sf_dir):
    return A.report_topic(rel(spark, sf_dir, "windows"))


@query("agg_report_partition", w("windows") + "SELECT topic, part, cast(sum(produced) AS bigint) AS produced, cast(sum(consumed) AS bigint) AS consumed, cast(sum(gaps) AS bigint) AS gaps FROM windows GROUP BY 1, 2")
def agg_report_partition(spark, sf_dir):
    return rel(spark, sf_dir, "windows").groupBy("topic", "part").agg(*[F.sum(c).alias(c) for c in ("produced", "consumed", "gaps")])


@query("agg_report_overall", w("windows") + "SELECT cast(sum(produced) AS bigint) AS produced, cast(sum(consumed) AS bigint) AS consumed, (SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT DISTINCT node FROM windows)) AS nodes, cast(count(DISTINCT w) AS bigint) AS windows, max(end_ms) - min(start_ms) AS duration_ms FROM windows")
def agg_report_overall(spark, sf_dir):
    return A.report_overall(rel(spark, sf_dir, "windows"))


@query("agg_anomalies", w("windows") + ", b AS (SELECT topic, part, sum(gaps) g, sum(seq_errors) s, sum(decode_errors) d, sum(produced) - sum(consumed) l FROM windows GROUP BY 1, 2), u AS (SELECT topic, part, 'gap' AS kind, 'error' AS level, g AS n FROM b UNION ALL SELECT topic, part, 'sequence', 'warning', s FROM b UNION ALL SELECT topic, part, 'decode', 'error', d FROM b UNION ALL SELECT topic, part, 'lag', 'warning', l FROM b) SELECT topic, part, kind, level, cast(n AS bigint) AS n FROM u WHERE n > 0")
def agg_anomalies(spark, sf_dir):
    return A.anomalies(rel(spark, sf_dir, "windows"))


@query("agg_stats_window", w("ev_log") + "SELECT event_type, part, (record_timestamp // 3600000) * 3600000 AS start_ms, cast(count(*) AS bigint) AS n, cast(sum(nbytes) AS bigint) AS nbytes FROM ev_log GROUP BY 1, 2, 3")
def agg_stats_window(spark, sf_dir):
    tumbling = F.window(F.timestamp_millis("record_timestamp"), "1 hour")
    out = rel(spark, sf_dir, "ev_log").groupBy("event_type", "part", tumbling.alias("t")).agg(F.count("*").alias("n"), F.sum("nbytes").alias("nbytes"))
    return out.select("event_type", "part", F.unix_millis("t.start").alias("start_ms"), "n", "nbytes")


@query("w_offset_gap", w("gaps") + ", g AS (SELECT part, record_offset, record_offset - lag(record_offset) OVER (PARTITION BY part ORDER BY record_offset) - 1 AS m FROM gaps) SELECT part, record_offset, greatest(coalesce(m, 0), 0) AS missing FROM g WHERE m > 0")
def w_offset_gap(spark, sf_dir):
    return A.gaps(rel(spark, sf_dir, "gaps")).where("missing > 0").select("part", "record_offset", "missing")


@query("agg_offset_check", w("gaps") + ", g AS (SELECT part, record_offset, record_offset - lag(record_offset) OVER (PARTITION BY part ORDER BY record_offset) - 1 AS m FROM gaps) SELECT part, cast(count(*) AS bigint) AS records, min(record_offset) AS first, max(record_offset) AS last, cast(coalesce(sum(m), 0) AS bigint) AS missing, array_to_string(list_slice(list(record_offset - m ORDER BY record_offset) FILTER (WHERE m > 0), 1, 10), ',') AS gap_starts FROM g GROUP BY part")
def agg_offset_check(spark, sf_dir):
    out = A.offset_check(rel(spark, sf_dir, "gaps"))
    return out.withColumn("gap_starts", F.array_join(F.col("gap_starts").cast("array<string>"), ","))


@query("limit_samples", w("gaps") + ", g AS (SELECT part, record_offset, record_offset - lag(record_offset) OVER (PARTITION BY part ORDER BY record_offset) - 1 AS m FROM gaps), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY record_offset) AS k FROM g WHERE m > 0) SELECT part, record_offset FROM r WHERE k <= 10")
def limit_samples(spark, sf_dir):
    found = A.gaps(rel(spark, sf_dir, "gaps")).where("missing > 0")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("record_offset"))).where("k <= 10").select("part", "record_offset")


@query("w_seq_gap", w("gaps") + ", g AS (SELECT part, record_offset * 4 + part AS seq FROM gaps), l AS (SELECT *, lag(seq) OVER (PARTITION BY part ORDER BY seq) AS p FROM g) SELECT part, seq FROM l WHERE p + 4 <> seq")
def w_seq_gap(spark, sf_dir):
    rows = rel(spark, sf_dir, "gaps").select("part", (F.col("record_offset") * 4 + F.col("part")).alias("seq"))
    before = F.lag("seq").over(Window.partitionBy("part").orderBy("seq"))
    return rows.withColumn("p", before).where("p + 4 <> seq").select("part", "seq")


@query("w_run_sequence", w("gaps") + ", g AS (SELECT part, user_id % 2 AS run_id, record_offset * 4 + part AS seq FROM gaps), r AS (SELECT *, (row_number() OVER (PARTITION BY run_id, part ORDER BY seq) - 1) * 4 + min(seq) OVER (PARTITION BY run_id, part) AS e FROM g) SELECT run_id, part, cast(count(*) AS bigint) AS n, cast(sum(CASE WHEN seq <> e THEN 1 ELSE 0 END) AS bigint) AS off_sequence FROM r GROUP BY 1, 2")
def w_run_sequence(spark, sf_dir):
    rows = rel(spark, sf_dir, "gaps").select("part", (F.col("user_id") % 2).alias("run_id"), (F.col("record_offset") * 4 + F.col("part")).alias("seq"))
    by = Window.partitionBy("run_id", "part")
    expected = (F.row_number().over(by.orderBy("seq")) - 1) * 4 + F.min("seq").over(by)
    return rows.withColumn("e", expected).groupBy("run_id", "part").agg(F.count("*").alias("n"), F.count_if(F.col("seq") != F.col("e")).alias("off_sequence"))


@query("agg_delay", w("ends", "checkpoints", "ev_log") + ", l AS (SELECT part, max(record_timestamp) AS produced FROM ev_log GROUP BY part), c AS (SELECT e.part, max(record_timestamp) AS exported FROM ev_log e JOIN checkpoints k USING (part) WHERE record_offset < next_offset GROUP BY e.part) SELECT part, produced - exported AS export_delay, greatest(produced - exported, 100) AS commit_delay FROM l JOIN c USING (part)")
def agg_delay(spark, sf_dir):
    log, marks = rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "checkpoints")
    both = log.join(small(marks.select("part", "next_offset")), "part").groupBy("part").agg((F.max("record_timestamp") - F.max(F.expr("CASE WHEN record_offset < next_offset THEN record_timestamp END"))).alias("export_delay"))
    return both.withColumn("commit_delay", F.greatest("export_delay", F.lit(100).cast("long")))


@query("agg_parquet_files", w("files") + "SELECT cast(count(*) AS bigint) AS n, cast(sum(record_count) AS bigint) AS records, cast(sum(file_size_bytes) AS bigint) AS nbytes, max(dt) AS latest FROM files")
def agg_parquet_files(spark, sf_dir):
    return rel(spark, sf_dir, "files").agg(F.count("*").alias("n"), F.sum("record_count").alias("records"), F.sum("file_size_bytes").alias("nbytes"), F.max("dt").alias("latest"))


@query("agg_merge_files", w("refs") + "SELECT file_key, cast(count(*) AS bigint) AS n, cast(sum(byte_length) AS bigint) AS nbytes, cast(sum(end_offset - base_offset) AS bigint) AS records FROM refs GROUP BY file_key")
def agg_merge_files(spark, sf_dir):
    return rel(spark, sf_dir, "refs").groupBy("file_key").agg(F.count("*").alias("n"), F.sum("byte_length").alias("nbytes"), F.sum(F.col("end_offset") - F.col("base_offset")).alias("records"))


@query("agg_iceberg_meta", w("files") + "SELECT dt, cast(count(*) AS bigint) AS added_files, cast(sum(record_count) AS bigint) AS added_records, dense_rank() OVER (ORDER BY dt) AS sequence_number FROM files GROUP BY dt")
def agg_iceberg_meta(spark, sf_dir):
    """One snapshot per day; the window runs over one row for each."""
    days = rel(spark, sf_dir, "files").groupBy("dt").agg(F.count("*").alias("added_files"), F.sum("record_count").alias("added_records"))
    return days.withColumn("sequence_number", F.dense_rank().over(Window.orderBy("dt")).cast("long"))


@query("agg_verify", w("ends", "checkpoints") + "SELECT part, next_offset = 0 AND log_end > 0 AS data_loss, log_end - next_offset AS behind FROM ends JOIN checkpoints USING (part)")
def agg_verify(spark, sf_dir):
    both = rel(spark, sf_dir, "ends").join(rel(spark, sf_dir, "checkpoints"), "part")
    return both.select("part", F.expr("next_offset = 0 AND log_end > 0").alias("data_loss"), (F.col("log_end") - F.col("next_offset")).alias("behind"))


@query("agg_partition_bounds", w("files") + "SELECT hour % 6 AS manifest, min(dt) AS min_dt, max(dt) AS max_dt, min(hour) AS min_hour, max(hour) AS max_hour FROM files GROUP BY 1")
def agg_partition_bounds(spark, sf_dir):
    return rel(spark, sf_dir, "files").groupBy((F.col("hour") % 6).alias("manifest")).agg(F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.min("hour").alias("min_hour"), F.max("hour").alias("max_hour"))


@query("agg_snapshot_summary", w("files") + "SELECT cast(count(*) AS bigint) AS added_files, cast(sum(record_count) AS bigint) AS added_records FROM files WHERE hour < 12")
def agg_snapshot_summary(spark, sf_dir):
    return rel(spark, sf_dir, "files").where("hour < 12").agg(F.count("*").alias("added_files"), F.sum("record_count").alias("added_records"))


@query("agg_segment_meta", w("batches") + "SELECT part, first_offset // 100 AS segment, cast(sum(last_offset - first_offset + 1) AS bigint) AS record_count, min(first_timestamp) AS min_timestamp, max(max_timestamp) AS max_timestamp FROM batches GROUP BY 1, 2")
def agg_segment_meta(spark, sf_dir):
    b = rel(spark, sf_dir, "batches")
    return b.groupBy("part", F.floor(F.col("first_offset") / 100).alias("segment")).agg(F.sum(F.col("last_offset") - F.col("first_offset") + 1).alias("record_count"), F.min("first_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp"))


@query("segment_meta_build", w("segments") + """SELECT part, base_offset, concat('{"base_offset":', cast(base_offset AS varchar), ',"end_offset":', cast(end_offset AS varchar), ',"record_count":', cast(record_count AS varchar), '}') AS meta FROM segments""")
def segment_meta_build(spark, sf_dir):
    return rel(spark, sf_dir, "segments").select("part", "base_offset", F.to_json(F.struct("base_offset", "end_offset", "record_count")).alias("meta"))


@query("agg_file_index", w("refs") + "SELECT file_key, part, max(created_ms) AS latest, (SELECT max(r2.created_ms) FROM refs r2 WHERE r2.file_key = r.file_key) AS latest_anywhere FROM refs r GROUP BY file_key, part")
def agg_file_index(spark, sf_dir):
    own = rel(spark, sf_dir, "refs").groupBy("file_key", "part").agg(F.max("created_ms").alias("latest"))
    return own.withColumn("latest_anywhere", F.max("latest").over(Window.partitionBy("file_key")))


@query("join_ref_file", w("refs") + "SELECT file_key, cast(count(*) AS bigint) AS refs, string_agg(concat(cast(part AS varchar), ':', cast(base_offset AS varchar)), ',' ORDER BY part, base_offset) AS list FROM refs GROUP BY file_key")
def join_ref_file(spark, sf_dir):
    found = rel(spark, sf_dir, "refs").groupBy("file_key").agg(F.count("*").alias("refs"), F.array_sort(F.collect_list(F.struct("part", "base_offset"))).alias("l"))
    text = F.transform("l", lambda x: F.concat(x["part"].cast("string"), F.lit(":"), x["base_offset"].cast("string")))
    return found.select("file_key", "refs", F.array_join(text, ",").alias("list"))


@query("agg_min_follower", w("ends", "observed") + "SELECT part, min(hw) AS follower FROM observed GROUP BY part")
def agg_min_follower(spark, sf_dir):
    return rel(spark, sf_dir, "observed").groupBy("part").agg(F.min("hw").alias("follower"))


@query("hw_compute", w("ends", "observed") + ", f AS (SELECT part, node, max(hw) + 1 AS o FROM observed GROUP BY 1, 2) SELECT part, CASE WHEN count(*) >= 2 THEN least(any_value(log_end), min(o)) END AS high_watermark FROM f JOIN ends USING (part) GROUP BY part")
def hw_compute(spark, sf_dir):
    """The least of leader and in-sync followers, if there are enough of them."""
    reached = rel(spark, sf_dir, "observed").groupBy("part", "node").agg((F.max("hw") + 1).alias("o"))
    isr = reached.groupBy("part").agg(F.min("o").alias("lowest"), F.count("*").alias("n"))
    return rel(spark, sf_dir, "ends").join(isr, "part").select("part", F.when(F.col("n") >= 2, F.least("log_end", "lowest")).alias("high_watermark"))


@query("hw_readable", w("ends", "observed") + "SELECT e.part, coalesce(CASE WHEN e.part % 2 = 0 THEN e.hw END, (SELECT max(o.hw) FROM observed o WHERE o.part = e.part AND e.part <> 3)) AS readable FROM ends e")
def hw_readable(spark, sf_dir):
    """The replica's watermark, else the follower's, else none."""
    follower = rel(spark, sf_dir, "observed").groupBy("part").agg(F.max("hw").alias("f"))
    both = rel(spark, sf_dir, "ends").join(follower, "part")
    return both.select("part", F.coalesce(F.expr("CASE WHEN part % 2 = 0 THEN hw END"), F.expr("CASE WHEN part <> 3 THEN f END")).alias("readable"))


@query("agg_digest", w("ev_log") + ", b AS (SELECT part, record_offset // 4096 AS k, sha256(string_agg(event_type, '' ORDER BY record_offset)) AS d, count(*) AS n, sum(length(event_type)) AS b FROM ev_log GROUP BY 1, 2) SELECT part, sha256(string_agg(d, '' ORDER BY k)) AS digest, cast(sum(n) AS bigint) AS n, cast(sum(b) AS bigint) AS nbytes FROM b GROUP BY part")
def agg_digest(spark, sf_dir):
    return A.digest(rel(spark, sf_dir, "ev_log"), "event_type")


@query("agg_expected_state", "SELECT cast(event_id % 4 AS int) AS part, cast(count(*) AS bigint) AS n, cast(sum(length(props)) AS bigint) AS nbytes FROM events GROUP BY 1")
def agg_expected_state(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy((F.col("event_id") % 4).cast("int").alias("part")).agg(F.count("*").alias("n"), F.sum(F.length("props")).cast("long").alias("nbytes"))


@query("agg_metrics", w("ev_log") + "SELECT event_type, node, cast(sum(nbytes) AS bigint) AS total, cast(count(*) AS bigint) AS n FROM (SELECT *, concat('n', cast(part % 3 AS varchar)) AS node FROM ev_log) GROUP BY 1, 2")
def agg_metrics(spark, sf_dir):
    log = rel(spark, sf_dir, "ev_log").withColumn("node", F.concat(F.lit("n"), (F.col("part") % 3).cast("string")))
    return log.groupBy("event_type", "node").agg(F.sum("nbytes").alias("total"), F.count("*").alias("n"))


@query("bench_complete", w("ends", "checkpoints") + "SELECT bool_and(next_offset >= log_end) AS complete FROM ends JOIN checkpoints USING (part)")
def bench_complete(spark, sf_dir):
    both = rel(spark, sf_dir, "ends").join(rel(spark, sf_dir, "checkpoints"), "part")
    return both.agg(F.bool_and(F.col("next_offset") >= F.col("log_end")).alias("complete"))


@query("bench_committed_count", w("ends") + "SELECT cast(sum(hw) AS bigint) AS committed FROM ends")
def bench_committed_count(spark, sf_dir):
    return rel(spark, sf_dir, "ends").agg(F.sum("hw").alias("committed"))


_GROUPS = "SELECT grp, topic, cast(count(DISTINCT part) AS bigint) AS members, cast(count(DISTINCT CASE WHEN grp = 'g0' OR part <> 2 THEN part END) AS bigint) AS assigned FROM commits GROUP BY grp, topic UNION ALL SELECT DISTINCT concat(grp, '-new') AS grp, topic, 0 AS members, 0 AS assigned FROM commits"


@query("agg_group_state", w("commits") + f", g AS ({_GROUPS}) SELECT *, CASE WHEN members = 0 THEN 'Empty' WHEN assigned < members THEN 'PreparingRebalance' ELSE 'Stable' END AS state FROM g")
def agg_group_state(spark, sf_dir):
    """A group's members are the partitions it commits for; some of them are assigned."""
    return A.group_state(_groups(spark, sf_dir))


def _groups(spark, sf_dir):
    c = rel(spark, sf_dir, "commits")
    some = c.groupBy("grp", "topic").agg(F.count_distinct("part").alias("members"), F.count_distinct(F.when((F.col("grp") == "g0") | (F.col("part") != 2), F.col("part"))).alias("assigned"))
    new = c.select(F.concat("grp", F.lit("-new")).alias("grp"), "topic", F.lit(0).cast("long").alias("members"), F.lit(0).cast("long").alias("assigned")).distinct()
    return some.unionByName(new)


@query("agg_cluster_readiness", w("produced") + ", c AS (SELECT part, record_offset // 100 AS w, cast(count(DISTINCT CASE WHEN record_offset % 700 >= 100 THEN node END) AS bigint) AS active, cast(count(DISTINCT CASE WHEN record_offset % 700 >= 100 AND NOT (record_offset % 500 // 100 = 2 AND node = 'n1') THEN node END) AS bigint) AS ready, cast(count(DISTINCT process) AS bigint) AS assigned, cast(count(DISTINCT CASE WHEN ok THEN process END) AS bigint) AS initialized, 8::BIGINT AS expected FROM produced GROUP BY 1, 2) SELECT *, CASE WHEN active = 0 THEN 'unavailable' WHEN assigned <> 8 OR initialized <> 8 THEN 'rebalancing' WHEN active <> ready THEN 'degraded' ELSE 'ready' END AS state FROM c")
def agg_cluster_readiness(spark, sf_dir):
    """Windows of 100 records: their nodes are instances, their processes partitions, of which eight are expected."""
    o = F.col("record_offset")
    active = o % 700 >= 100
    rows = rel(spark, sf_dir, "produced").groupBy("part", F.expr("record_offset div 100").alias("w")).agg(F.count_distinct(F.when(active, F.col("node"))).alias("active"), F.count_distinct(F.when(active & ~((F.floor(o % 500 / 100) == 2) & (F.col("node") == "n1")), F.col("node"))).alias("ready"), F.count_distinct("process").alias("assigned"), F.count_distinct(F.when(F.col("ok"), F.col("process"))).alias("initialized"))
    return A.cluster_state(rows.withColumn("expected", F.lit(8).cast("long")))
