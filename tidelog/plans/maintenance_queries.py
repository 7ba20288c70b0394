"""Queries of writes, folds, retention, compaction, references, epochs and registries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate, batches, configs, fold
from ..operators import maintenance as M
from ..operators.small import small
from ..sources import recordbatch as R
from ..sources.store import shared_dir
from .catalog import query
from .decode_queries import batched
from .fixtures import relation as rel
from .fixtures import with_clause as w

_T = 1704900000000


@query("w_assign_offsets", w("ev_log", "checkpoints") + "SELECT e.event_id, e.part, c.next_offset + row_number() OVER (PARTITION BY e.part ORDER BY e.record_timestamp, e.event_id) - 1 AS assigned FROM ev_log e JOIN checkpoints c USING (part)")
def w_assign_offsets(spark, sf_dir):
    return M.assign_offsets(rel(spark, sf_dir, "ev_log"), rel(spark, sf_dir, "checkpoints"), ["record_timestamp", "event_id"]).select("event_id", "part", "assigned")


@query("sink_append", w("ev_log", "ends") + "SELECT e.part, min(e2.log_end) AS base_offset, cast(count(*) AS bigint) AS n, min(e2.log_end) + count(*) AS next_offset FROM ev_log e JOIN ends e2 USING (part) GROUP BY e.part")
def sink_append(spark, sf_dir):
    heads = rel(spark, sf_dir, "ends").select("part", F.col("log_end").alias("next_offset"))
    rows = M.assign_offsets(rel(spark, sf_dir, "ev_log"), heads, ["event_id"])
    return rows.groupBy("part").agg(F.min("assigned").alias("base_offset"), F.count("*").alias("n"), (F.max("assigned") + 1).alias("next_offset"))


@query("w_assign_refs", w("batches") + "SELECT part, batch_no, cast(coalesce(sum(record_count) OVER (PARTITION BY part ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS base, cast(sum(record_count) OVER (PARTITION BY part ORDER BY batch_no) AS bigint) AS \"end\" FROM batches")
def w_assign_refs(spark, sf_dir):
    return M.assign_ref_offsets(rel(spark, sf_dir, "batches"), "batch_no").select("part", "batch_no", "base", "end")


@query("sink_diskless_commit", w("batches") + "SELECT part, cast(sum(record_count) AS bigint) AS next_offset, cast(count(*) AS bigint) AS refs FROM batches GROUP BY part")
def sink_diskless_commit(spark, sf_dir):
    return M.assign_ref_offsets(rel(spark, sf_dir, "batches"), "batch_no").groupBy("part").agg(F.max("end").alias("next_offset"), F.count("*").alias("refs"))


@query("sink_flush_pack", w("batches") + ", r AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY batch_no) - 1) // 25 AS chunk FROM batches) SELECT part, chunk, cast(count(*) AS bigint) AS n, min(batch_no) AS first_batch FROM r GROUP BY 1, 2")
def sink_flush_pack(spark, sf_dir):
    return M.pack_commits(rel(spark, sf_dir, "batches"), "batch_no").groupBy("part", "chunk").agg(F.count("*").alias("n"), F.min("batch_no").alias("first_batch"))


@query("commit_partition_guard", w("batches") + "SELECT batch_no // 5 AS c, count(DISTINCT part) = 1 AS ok FROM batches GROUP BY 1")
def commit_partition_guard(spark, sf_dir):
    return rel(spark, sf_dir, "batches").groupBy(F.floor(F.col("batch_no") / 5).alias("c")).agg((F.count_distinct("part") == 1).alias("ok"))


_FOLD = w("sent", recursive=True) + ", o AS (SELECT *, row_number() OVER (PARTITION BY part, producer_id ORDER BY arrival) AS rn FROM sent), f AS (SELECT part, producer_id, arrival, rn, sequence, record_count, CASE WHEN sequence = 0 THEN 'accepted' ELSE 'gap' END AS verdict, CASE WHEN sequence = 0 THEN record_count ELSE 0 END AS nxt FROM o WHERE rn = 1 UNION ALL SELECT o.part, o.producer_id, o.arrival, o.rn, o.sequence, o.record_count, CASE WHEN o.sequence = f.nxt THEN 'accepted' WHEN o.sequence < f.nxt THEN 'duplicate' ELSE 'gap' END, CASE WHEN o.sequence = f.nxt THEN o.sequence + o.record_count ELSE f.nxt END FROM f JOIN o ON o.part = f.part AND o.producer_id = f.producer_id AND o.rn = f.rn + 1) "


@query("w_producer_sequence", _FOLD + "SELECT part, producer_id, arrival, sequence, verdict FROM f")
def w_producer_sequence(spark, sf_dir):
    return fold.classic_sequence(rel(spark, sf_dir, "sent")).select("part", "producer_id", "arrival", "sequence", "verdict")


@query("producer_seq_rollback", _FOLD + "SELECT part, producer_id, max(nxt) AS next_sequence FROM f GROUP BY 1, 2")
def producer_seq_rollback(spark, sf_dir):
    """Only appended batches count, so a failed append leaves nothing to undo."""
    done = fold.classic_sequence(rel(spark, sf_dir, "sent"))
    end = F.when(F.col("verdict") == fold.ACCEPTED, F.col("sequence") + F.col("record_count"))
    return done.groupBy("part", "producer_id").agg(F.coalesce(F.max(end), F.lit(0).cast("long")).alias("next_sequence"))


@query("w_producer_sequence_diskless")
def w_producer_sequence_diskless(spark, sf_dir):
    return fold.recent_sequence(rel(spark, sf_dir, "sent")).select("part", "producer_id", "arrival", "sequence", "verdict")


@query("w_producer_rebuild", w("sent") + "SELECT part, producer_id, max(sequence + record_count) AS next_sequence, arg_max(arrival, sequence * 100000 + arrival) AS last_arrival FROM sent GROUP BY 1, 2")
def w_producer_rebuild(spark, sf_dir):
    return rel(spark, sf_dir, "sent").groupBy("part", "producer_id").agg(F.max(F.col("sequence") + F.col("record_count")).alias("next_sequence"), F.max_by("arrival", F.col("sequence") * 100000 + F.col("arrival")).alias("last_arrival"))


@query("producer_state_tail", w("sent") + "SELECT part, producer_id, max(sequence + record_count) AS next_sequence FROM sent WHERE arrival >= 4 GROUP BY 1, 2")
def producer_state_tail(spark, sf_dir):
    return rel(spark, sf_dir, "sent").where("arrival >= 4").groupBy("part", "producer_id").agg(F.max(F.col("sequence") + F.col("record_count")).alias("next_sequence"))


@query("producer_last_offset", w("batches") + "SELECT part, producer_id, arg_max(last_offset, batch_no) AS last_offset FROM batches GROUP BY 1, 2")
def producer_last_offset(spark, sf_dir):
    return rel(spark, sf_dir, "batches").groupBy("part", "producer_id").agg(F.max_by("last_offset", "batch_no").alias("last_offset"))


@query("producer_duplicate_base", w("batches") + ", l AS (SELECT part, producer_id, max(batch_no) AS batch_no FROM batches GROUP BY 1, 2) SELECT b.part, b.producer_id, b.first_offset AS base_offset, b.last_offset FROM batches b JOIN l ON b.part = l.part AND b.producer_id = l.producer_id AND b.batch_no = l.batch_no")
def producer_duplicate_base(spark, sf_dir):
    """A retry of the latest batch is answered with its whole range."""
    latest = F.max_by(F.struct("first_offset", "last_offset"), "batch_no").alias("b")
    return rel(spark, sf_dir, "batches").groupBy("part", "producer_id").agg(latest).select("part", "producer_id", F.col("b.first_offset").alias("base_offset"), "b.last_offset")


@query("producer_id_alloc", w("batches") + "SELECT max(producer_id) + 1 AS producer_id FROM batches")
def producer_id_alloc(spark, sf_dir):
    return rel(spark, sf_dir, "batches").agg((F.max("producer_id") + 1).alias("producer_id"))


_RUNS = w("segments", recursive=True) + ", o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY base_offset) AS rn FROM segments), f AS (SELECT part, base_offset, end_offset, rn, 1 AS run, 1 AS n, size_bytes AS total FROM o WHERE rn = 1 UNION ALL SELECT o.part, o.base_offset, o.end_offset, o.rn, CASE WHEN f.n >= 3 OR f.total + o.size_bytes > 12000 THEN f.run + 1 ELSE f.run END, CASE WHEN f.n >= 3 OR f.total + o.size_bytes > 12000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR f.total + o.size_bytes > 12000 THEN o.size_bytes ELSE f.total + o.size_bytes END FROM f JOIN o ON o.part = f.part AND o.rn = f.rn + 1) "


@query("w_compaction_runs", _RUNS + "SELECT part, base_offset, cast(run AS int) AS run FROM f")
def w_compaction_runs(spark, sf_dir):
    return fold.compaction_runs(rel(spark, sf_dir, "segments"), 3, 12_000, 1 << 40).select("part", "base_offset", "run")


@query("merge_segments", _RUNS + "SELECT part, cast(run AS int) AS run, min(base_offset) AS base_offset, max(end_offset) AS end_offset, cast(count(*) AS bigint) AS n, cast(sum(end_offset - base_offset + 1) AS bigint) AS records, cast(sum((end_offset - base_offset + 10) // 10) AS bigint) AS batches, true AS ok FROM f GROUP BY 1, 2")
def merge_segments(spark, sf_dir):
    """Each run's segments as one object, byte by byte; its batches are taken apart again and checked."""

    def check(pdfs):
        for pdf in pdfs:
            parts = [R.split(bytes(raw)) for raw in pdf.pop("raw")]
            whole = [sum(map(len, p)) == n for p, n in zip(parts, pdf.pop("size").tolist(), strict=True)]
            yield pdf.assign(records=[sum(R.header(x)["count"] for x in p) for p in parts], batches=[len(p) for p in parts], ok=[w and all(map(R.valid, p)) for w, p in zip(whole, parts, strict=True)])

    raws = batched(spark, sf_dir).groupBy("part", (F.floor(F.col("first_offset") / 100) * 100).alias("base_offset")).agg(F.array_sort(F.collect_list(F.struct("first_offset", "raw"))).alias("b"))
    raws = raws.select("part", "base_offset", batches.concatenated(F.transform("b", lambda x: x["raw"])).alias("raw"))
    runs = fold.compaction_runs(rel(spark, sf_dir, "segments"), 3, 12_000, 1 << 40).join(raws, ["part", "base_offset"])
    out = batches.merged(runs, "part", "run").select("part", "run", "base_offset", "end_offset", F.col("n").cast("long"), F.length("raw").alias("size"), "raw")
    return out.mapInPandas(check, "part int, run int, base_offset long, end_offset long, n long, records long, batches long, ok boolean")


@query("w_range_coalesce", w("refs", recursive=True) + ", g AS (SELECT file_key, byte_length AS n, coalesce(sum(byte_length) OVER (PARTITION BY file_key ORDER BY part, base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY file_key ORDER BY part, base_offset) AS i FROM refs), f AS (SELECT file_key, i, b, n, 1 AS k, n AS total FROM g WHERE i = 1 UNION ALL SELECT g.file_key, g.i, g.b, g.n, CASE WHEN f.total + g.n > 6000 THEN f.k + 1 ELSE f.k END, CASE WHEN f.total + g.n > 6000 THEN g.n ELSE f.total + g.n END FROM f JOIN g ON g.file_key = f.file_key AND g.i = f.i + 1) SELECT file_key, cast(k AS int) AS range_no, cast(min(b) AS bigint) AS byte_offset, cast(sum(n) AS bigint) AS byte_length FROM f GROUP BY file_key, k")
def w_range_coalesce(spark, sf_dir):
    before = Window.partitionBy("file_key").orderBy("part", "base_offset").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rel(spark, sf_dir, "refs").withColumn("byte_offset", F.coalesce(F.sum("byte_length").over(before), F.lit(0).cast("long")))
    return fold.coalesce_ranges(ranges, 6000).groupBy("file_key", "range_no").agg(F.min("byte_offset").alias("byte_offset"), F.sum("byte_length").alias("byte_length"))


@query("w_merge_adjacent", w("segments") + ", l AS (SELECT *, lead(base_offset) OVER (PARTITION BY part ORDER BY base_offset) AS nb, lead(epoch) OVER (PARTITION BY part ORDER BY base_offset) AS ne, lead(end_offset) OVER (PARTITION BY part ORDER BY base_offset) AS next_end FROM segments) SELECT part, min(base_offset) AS base_offset, arg_min(next_end, base_offset) AS next_end FROM l WHERE nb = end_offset + 1 AND ne = epoch GROUP BY part")
def w_merge_adjacent(spark, sf_dir):
    return M.adjacent_pair(rel(spark, sf_dir, "segments"))


@query("w_archive_run", w("refs", "checkpoints") + "SELECT r.part, r.file_key, r.base_offset FROM refs r JOIN checkpoints c USING (part) WHERE r.end_offset <= c.next_offset")
def w_archive_run(spark, sf_dir):
    return M.archive_run(rel(spark, sf_dir, "refs"), rel(spark, sf_dir, "checkpoints")).select("part", "file_key", "base_offset")


@query("w_in_flight", w("segments", "refs") + "SELECT s.part, s.base_offset FROM segments s WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.part = s.part AND r.base_offset < 60 AND r.base_offset <= s.end_offset AND s.base_offset < r.end_offset)")
def w_in_flight(spark, sf_dir):
    """Segments that no running merge covers; ranges in flight are few."""
    busy = rel(spark, sf_dir, "refs").where("base_offset < 60").select(F.col("part").alias("p"), F.col("base_offset").alias("b"), F.col("end_offset").alias("e"))
    s = rel(spark, sf_dir, "segments")
    return s.join(busy, (F.col("part") == F.col("p")) & (F.col("b") <= F.col("end_offset")) & (F.col("base_offset") < F.col("e")), "left_anti").select("part", "base_offset")


@query("w_error_islands", w("ev_log") + ", e AS (SELECT part, record_offset, CASE WHEN event_id % 11 < 3 THEN 'bad int' WHEN event_id % 11 < 5 THEN 'missing' END AS error FROM ev_log), c AS (SELECT *, CASE WHEN error IS NOT DISTINCT FROM lag(error) OVER (PARTITION BY part ORDER BY record_offset) THEN 0 ELSE 1 END AS ch FROM e), r AS (SELECT *, sum(ch) OVER (PARTITION BY part ORDER BY record_offset) AS run FROM c) SELECT part, error, min(record_offset) AS first, max(record_offset) AS last, cast(count(*) AS bigint) AS n FROM r WHERE error IS NOT NULL GROUP BY part, run, error")
def w_error_islands(spark, sf_dir):
    rows = rel(spark, sf_dir, "ev_log").withColumn("error", F.expr("CASE WHEN event_id % 11 < 3 THEN 'bad int' WHEN event_id % 11 < 5 THEN 'missing' END"))
    return M.error_islands(rows, "error", "record_offset", "part").where("error IS NOT NULL")


@query("filter_retention_classic", w("segments", "checkpoints") + f"SELECT s.part, s.base_offset, s.end_offset FROM segments s LEFT JOIN checkpoints c USING (part) WHERE s.created_ms <= {_T} AND s.end_offset <= coalesce(c.next_offset, 0) - 1")
def filter_retention_classic(spark, sf_dir):
    return M.expired_segments(rel(spark, sf_dir, "segments"), rel(spark, sf_dir, "checkpoints"), _T, True).select("part", "base_offset", "end_offset")


@query("retention_gate", w("segments", "checkpoints") + f"SELECT s.part, bool_and(s.end_offset <= coalesce(c.next_offset, 0) - 1) AS may_run FROM segments s LEFT JOIN checkpoints c USING (part) WHERE s.created_ms <= {_T} GROUP BY s.part")
def retention_gate(spark, sf_dir):
    old = M.expired_segments(rel(spark, sf_dir, "segments"), None, _T, False)
    both = old.join(small(rel(spark, sf_dir, "checkpoints").select("part", "next_offset")), "part", "left")
    return both.groupBy("part").agg(F.bool_and(F.expr("end_offset <= coalesce(next_offset, 0) - 1")).alias("may_run"))


@query("filter_retention_diskless", w("refs") + f"SELECT file_key, max(created_ms) AS latest FROM refs GROUP BY 1 HAVING max(created_ms) <= {_T}")
def filter_retention_diskless(spark, sf_dir):
    return M.expired_files(rel(spark, sf_dir, "refs"), _T)


@query("refs_plan_expired", w("refs", "checkpoints") + f"SELECT file_key FROM refs r LEFT JOIN checkpoints c USING (part) GROUP BY 1 HAVING max(created_ms) <= {_T} AND bool_and(end_offset <= coalesce(next_offset, 0))")
def refs_plan_expired(spark, sf_dir):
    refs = rel(spark, sf_dir, "refs")
    return M.expired_files(refs, _T).select("file_key").join(M.exported_files(refs, rel(spark, sf_dir, "checkpoints")), "file_key", "left_semi")


@query("filter_exported", w("refs", "checkpoints") + "SELECT file_key FROM refs LEFT JOIN checkpoints USING (part) GROUP BY 1 HAVING bool_and(end_offset <= coalesce(next_offset, 0))")
def filter_exported(spark, sf_dir):
    return M.exported_files(rel(spark, sf_dir, "refs"), rel(spark, sf_dir, "checkpoints"))


@query("join_refs_checkpoint", w("refs", "checkpoints") + "SELECT r.part, r.base_offset, coalesce(c.next_offset, 0) - r.end_offset AS slack FROM refs r LEFT JOIN (SELECT * FROM checkpoints WHERE part <> 2) c USING (part)")
def join_refs_checkpoint(spark, sf_dir):
    marks = small(rel(spark, sf_dir, "checkpoints").where("part <> 2").select("part", "next_offset"))
    return rel(spark, sf_dir, "refs").join(marks, "part", "left").select("part", "base_offset", F.expr("coalesce(next_offset, 0) - end_offset").alias("slack"))


@query("index_remove_before", w("segments") + "SELECT part, base_offset FROM segments WHERE end_offset >= 120")
def index_remove_before(spark, sf_dir):
    return rel(spark, sf_dir, "segments").where("end_offset >= 120").select("part", "base_offset")


@query("index_remove_expired", w("segments") + f"SELECT part, base_offset FROM segments WHERE created_ms > {_T}")
def index_remove_expired(spark, sf_dir):
    return rel(spark, sf_dir, "segments").where(F.col("created_ms") > _T).select("part", "base_offset")


@query("index_remove_keys", w("segments") + "SELECT part, base_offset FROM segments WHERE NOT (base_offset % 200 = 0 AND part < 2)")
def index_remove_keys(spark, sf_dir):
    s = rel(spark, sf_dir, "segments")
    return s.join(s.where("base_offset % 200 = 0 AND part < 2").select("part", "base_offset"), ["part", "base_offset"], "left_anti").select("part", "base_offset")


@query("anti_unreferenced_files", w("uploads", "refs") + "SELECT file_key FROM uploads WHERE file_key NOT IN (SELECT file_key FROM refs)")
def anti_unreferenced_files(spark, sf_dir):
    return M.unreferenced(rel(spark, sf_dir, "uploads"), rel(spark, sf_dir, "refs"))


@query("refs_unreferenced_dynamo", w("uploads", "refs") + "SELECT cast(count(*) AS bigint) AS n FROM uploads WHERE file_key NOT IN (SELECT file_key FROM refs)")
def refs_unreferenced_dynamo(spark, sf_dir):
    return M.unreferenced(rel(spark, sf_dir, "uploads"), rel(spark, sf_dir, "refs")).agg(F.count("*").alias("n"))


@query("anti_orphan_sweep", w("uploads", "refs") + "SELECT file_key FROM uploads WHERE file_key NOT IN (SELECT file_key FROM refs) AND length(file_key) >= 3 ORDER BY file_key LIMIT 1000")
def anti_orphan_sweep(spark, sf_dir):
    """At most 1,000 objects a pass, in key order; the length stands for the age."""
    return M.unreferenced(rel(spark, sf_dir, "uploads").where("length(file_key) >= 3"), rel(spark, sf_dir, "refs")).orderBy("file_key").limit(1000)


@query("anti_orphan_sidecars", w("segments") + "SELECT part, base_offset, 'sidecar' AS kind FROM segments WHERE base_offset % 300 = 0 UNION ALL SELECT part, base_offset, 'segment' FROM segments WHERE base_offset % 300 = 100")
def anti_orphan_sidecars(spark, sf_dir):
    """Two anti-joins in one full join: sidecars without a segment, and segments without metadata."""
    s = rel(spark, sf_dir, "segments").select("part", "base_offset")
    segments = s.where("base_offset % 300 <> 0").withColumn("seg", F.lit(True))
    sidecars = s.where("base_offset % 300 <> 100").withColumn("side", F.lit(True))
    both = segments.join(sidecars, ["part", "base_offset"], "full")
    return both.where("seg IS NULL OR side IS NULL").select("part", "base_offset", F.when(F.col("seg").isNull(), "sidecar").otherwise("segment").alias("kind"))


def _links(spark, sf_dir, newest):
    """Checkpoints named by a digest, each with the one before it, and heads that are ``newest`` behind the last."""
    b = rel(spark, sf_dir, "batches").select("part", "batch_no")
    name = lambda n: F.sha2(F.concat_ws("/", "part", n), 256)
    links = b.select("part", "batch_no", name(F.col("batch_no")).alias("key"), F.when(F.col("batch_no") > 0, name(F.col("batch_no") - 1)).alias("previous"))
    heads = b.groupBy("part").agg((F.max("batch_no") - newest).alias("n")).select("part", name(F.col("n")).alias("key"))
    return links, heads, f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"


@query("anti_orphan_checkpoints", w("batches") + "SELECT part, batch_no FROM batches WHERE batch_no > (SELECT max(batch_no) FROM batches b WHERE b.part = batches.part) - 2")
def anti_orphan_checkpoints(spark, sf_dir):
    """Checkpoints that no head's chain reaches: those written after it, whose publishing was lost."""
    links, heads, folder = _links(spark, sf_dir, 2)
    return links.join(M.walk_chain(links, heads, folder), ["part", "key"], "left_anti").select("part", "batch_no")


@query("metadata_orphans", w("files") + "SELECT file_path FROM files WHERE hour % 5 = 2")
def metadata_orphans(spark, sf_dir):
    f = rel(spark, sf_dir, "files").select("file_path", "hour")
    return f.join(f.where("hour % 5 <> 2").select("file_path"), "file_path", "left_anti").select("file_path")


@query("validate_table", w("files") + "SELECT file_path, CASE WHEN hour = 7 THEN 'missing' ELSE 'unlisted' END AS problem FROM files WHERE hour IN (7, 9)")
def validate_table(spark, sf_dir):
    """Files of the table against a storage listing."""
    f = rel(spark, sf_dir, "files")
    listed, stored = f.where("hour <> 9").select("file_path", F.lit(1).alias("l")), f.where("hour <> 7").select("file_path", F.lit(1).alias("s"))
    both = listed.join(stored, "file_path", "full").where("l IS NULL OR s IS NULL")
    return both.select("file_path", F.when(F.col("s").isNull(), "missing").otherwise("unlisted").alias("problem"))


@query("anti_schema_gc", "SELECT * FROM (VALUES (3), (5)) t(schema_id)")
def anti_schema_gc(spark, sf_dir):
    objects = spark.sql("SELECT explode(sequence(1, 5)) AS schema_id")
    return objects.join(spark.sql("SELECT * FROM VALUES (1), (2), (4) t(schema_id)"), "schema_id", "left_anti")


@query("join_writer_schema", w("ev_log") + "SELECT event_id, cast(event_id % 3 AS int) AS schema_id, CASE event_id % 3 WHEN 0 THEN 'v0' WHEN 1 THEN 'v1' END AS version FROM ev_log")
def join_writer_schema(spark, sf_dir):
    registry = F.broadcast(spark.sql("SELECT * FROM VALUES (0, 'v0'), (1, 'v1') t(schema_id, version)"))
    rows = rel(spark, sf_dir, "ev_log").select("event_id", (F.col("event_id") % 3).cast("int").alias("schema_id"))
    return rows.join(registry, "schema_id", "left").select("event_id", "schema_id", "version")


_ACLS = "(VALUES ('topic', 'orders', 'LITERAL'), ('topic', 'or', 'PREFIXED'), ('topic', '*', 'LITERAL'), ('group', 'orders', 'LITERAL'))"
_FILTERS = "(VALUES (1, 'topic', 'orders', 'MATCH'), (2, 'ANY', 'orders', 'LITERAL'), (3, 'ANY', NULL, 'ANY'), (4, 'topic', 'or', 'PREFIXED'))"


def _acls(spark):
    return spark.sql(f"SELECT * FROM {_ACLS} t(resource, name, pattern)"), spark.sql(f"SELECT * FROM {_FILTERS} t(f_id, resource, name, pattern)")


@query("filter_acl", "SELECT * FROM (VALUES (1, 'topic', 'orders'), (1, 'topic', 'or'), (1, 'topic', '*'), (2, 'topic', 'orders'), (2, 'group', 'orders'), (3, 'topic', 'orders'), (3, 'topic', 'or'), (3, 'topic', '*'), (3, 'group', 'orders'), (4, 'topic', 'or')) t(f_id, resource, name)")
def filter_acl(spark, sf_dir):
    return M.acl_matches(*_acls(spark)).select("f_id", "resource", "name")


@query("join_acl_filters", "SELECT * FROM (VALUES ('topic', 'or'), ('topic', '*')) t(resource, name)")
def join_acl_filters(spark, sf_dir):
    """What stays after deleting all that filter 2 names."""
    acls, filters = _acls(spark)
    gone = M.acl_matches(acls, filters.where("f_id = 2")).select("resource", "name", "pattern")
    return acls.join(gone, ["resource", "name", "pattern"], "left_anti").select("resource", "name")


@query("join_assignment_members", "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false)) t(grp, same)")
def join_assignment_members(spark, sf_dir):
    assigned = spark.sql("SELECT * FROM VALUES ('a', 'm1'), ('a', 'm2'), ('b', 'm1'), ('c', 'm1') t(grp, member)").withColumn("x", F.lit(1))
    members = spark.sql("SELECT * FROM VALUES ('a', 'm1'), ('a', 'm2'), ('b', 'm2'), ('c', 'm1'), ('c', 'm3') t(grp, member)").withColumn("y", F.lit(1))
    both = assigned.join(members, ["grp", "member"], "full")
    return both.groupBy("grp").agg(F.bool_and(F.expr("x IS NOT NULL AND y IS NOT NULL")).alias("same"))


@query("filter_group_state", w("commits") + "SELECT grp, topic FROM commits GROUP BY grp, topic HAVING count(DISTINCT CASE WHEN grp = 'g0' OR part <> 2 THEN part END) < count(DISTINCT part)")
def filter_group_state(spark, sf_dir):
    """Groups in one of the wanted states."""
    c = rel(spark, sf_dir, "commits")
    groups = c.groupBy("grp", "topic").agg(F.count_distinct("part").alias("members"), F.count_distinct(F.when((F.col("grp") == "g0") | (F.col("part") != 2), F.col("part"))).alias("assigned"))
    return aggregate.group_state(groups).where(F.col("state").isin("PreparingRebalance", "Dead")).select("grp", "topic")


@query("join_epoch_asof", w("ev_log", "epochs") + "SELECT e.part, e.record_offset, p.epoch FROM ev_log e ASOF JOIN epochs p ON e.part = p.part AND e.record_offset >= p.start_offset")
def join_epoch_asof(spark, sf_dir):
    return M.epoch_of(rel(spark, sf_dir, "ev_log").select("part", "record_offset"), rel(spark, sf_dir, "epochs")).select("part", "record_offset", "epoch")


@query("divergence_point", w("epochs", "ends") + ", e AS (SELECT *, lead(start_offset) OVER (PARTITION BY part ORDER BY epoch) AS nx FROM epochs), f AS (SELECT part, epoch, start_offset + 310 - part * 100 AS fo FROM epochs) SELECT f.part, f.epoch, fo AS follower_offset, CASE WHEN fo > nx THEN nx END AS truncate_to FROM f JOIN e ON f.part = e.part AND f.epoch = e.epoch")
def divergence_point(spark, sf_dir):
    epochs = rel(spark, sf_dir, "epochs")
    followers = epochs.select("part", "epoch", (F.col("start_offset") + 310 - F.col("part") * 100).alias("follower_offset"))
    return M.divergence(followers, epochs).select("part", "epoch", "follower_offset", "truncate_to")


@query("epoch_ensure", w("epochs") + ", n AS (SELECT part, max(epoch) - part % 2 AS epoch, max(start_offset) + 7 - 300 * (part % 2) AS start_offset FROM epochs GROUP BY part) SELECT part, epoch, start_offset FROM epochs WHERE (part, epoch) IN (SELECT part, epoch FROM n) UNION ALL SELECT e.part, e.epoch, e.start_offset FROM epochs e JOIN n USING (part) WHERE e.epoch < n.epoch UNION ALL SELECT part, epoch, start_offset FROM n WHERE (part, epoch) NOT IN (SELECT part, epoch FROM epochs)")
def epoch_ensure(spark, sf_dir):
    """Each partition's epoch is ensured: later ones go, a known one keeps its start, a new one is added."""
    epochs = rel(spark, sf_dir, "epochs")
    wanted = epochs.groupBy("part").agg((F.max("epoch") - F.col("part") % 2).alias("epoch"), (F.max("start_offset") + 7 - 300 * (F.col("part") % 2)).alias("start_offset"))
    return M.ensure_epoch(epochs, wanted)


@query("replace_refs", w("refs") + "SELECT part, base_offset, end_offset, file_key FROM refs WHERE NOT (base_offset < 100 AND part = 1) UNION ALL SELECT 1, 0, 100, 'merged'")
def replace_refs(spark, sf_dir):
    refs = rel(spark, sf_dir, "refs").select("part", "base_offset", "end_offset", "file_key")
    added = spark.sql("SELECT 1 AS part, 0L AS base_offset, 100L AS end_offset, 'merged' AS file_key")
    once = M.replace_refs(refs, refs.where("base_offset < 100 AND part = 1"), added)
    return M.replace_refs(once, refs.where("base_offset < 100 AND part = 1"), added)


@query("index_add_replace", w("segments") + "SELECT part, base_offset, end_offset FROM segments WHERE NOT (part = 0 AND base_offset >= 100 AND end_offset <= 320) UNION ALL SELECT 0, 100, 320")
def index_add_replace(spark, sf_dir):
    new = spark.sql("SELECT 0 AS part, 100L AS base_offset, 320L AS end_offset")
    return M.add_segments(rel(spark, sf_dir, "segments").select("part", "base_offset", "end_offset"), new)


@query("merge_manifests", w("files") + "SELECT concat(file_path, '+') AS path, 1 AS status, 99::BIGINT AS manifest FROM files WHERE hour = 0 UNION ALL SELECT file_path, 0, -1 FROM files WHERE hour <> 3")
def merge_manifests(spark, sf_dir):
    f = rel(spark, sf_dir, "files")
    parents = f.select(F.col("file_path").alias("path"), F.when(F.col("hour") == 3, 2).otherwise(1).alias("status"), F.col("hour").cast("long").alias("manifest"))
    added = f.where("hour = 0").select(F.concat("file_path", F.lit("+")).alias("path"), F.lit(99).cast("long").alias("manifest"))
    return M.merge_manifests(parents, added)


@query("partition_refs_union", w("refs") + "SELECT part, base_offset, end_offset FROM refs")
def partition_refs_union(spark, sf_dir):
    refs = rel(spark, sf_dir, "refs").select("part", "base_offset", "end_offset")
    return refs.where("base_offset < 100").unionByName(refs.where("base_offset >= 100"))


@query("refs_load_checkpoints", w("batches", recursive=True) + ", c AS (SELECT part, max(batch_no) AS k, 0 AS depth FROM batches GROUP BY part UNION ALL SELECT part, k - 1, depth + 1 FROM c WHERE k > 0) SELECT part, k AS batch_no, cast(depth AS bigint) AS depth FROM c")
def refs_load_checkpoints(spark, sf_dir):
    """The chain of checkpoints from each head, by the names that they give."""
    links, heads, folder = _links(spark, sf_dir, 0)
    return M.walk_chain(links, heads, folder).join(links, ["part", "key"]).select("part", "batch_no", "depth")


@query("refs_delete_file", w("refs") + "SELECT part, base_offset FROM refs WHERE file_key <> 'f0-0'")
def refs_delete_file(spark, sf_dir):
    return rel(spark, sf_dir, "refs").where("file_key <> 'f0-0'").select("part", "base_offset")


@query("refs_rewrite_checkpoints", w("refs") + "SELECT file_key, cast(count(*) AS bigint) AS n FROM refs WHERE file_key NOT LIKE 'f1-%' GROUP BY 1")
def refs_rewrite_checkpoints(spark, sf_dir):
    return rel(spark, sf_dir, "refs").where("file_key NOT LIKE 'f1-%'").groupBy("file_key").agg(F.count("*").alias("n"))


@query("refs_delete_topic", w("windows") + "SELECT topic, cast(count(*) AS bigint) AS n FROM windows WHERE topic <> 'click' GROUP BY topic")
def refs_delete_topic(spark, sf_dir):
    return rel(spark, sf_dir, "windows").where("topic <> 'click'").groupBy("topic").agg(F.count("*").alias("n"))


@query("sort_refs", w("refs") + "SELECT part, base_offset, row_number() OVER (PARTITION BY part ORDER BY base_offset) AS nth FROM refs")
def sort_refs(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("part").orderBy("base_offset")).cast("long")
    return rel(spark, sf_dir, "refs").select("part", "base_offset", nth.alias("nth"))


@query("sort_jobs", w("segments") + ", j AS (SELECT part, base_offset, created_ms // 3600000 AS updated, substr(sha256(concat('merge|events|', cast(part AS varchar), '|', cast(base_offset AS varchar), '|', cast(end_offset AS varchar))), 1, 24) AS job_id FROM segments) SELECT part, job_id, updated, row_number() OVER (PARTITION BY part ORDER BY updated, job_id) AS nth FROM j")
def sort_jobs(spark, sf_dir):
    """All jobs of a partition, the oldest first, ties by id."""
    parts = [F.lit("merge"), F.lit("events"), *(F.col(c).cast("string") for c in ("part", "base_offset", "end_offset"))]
    rows = rel(spark, sf_dir, "segments").select("part", F.expr("created_ms div 3600000").alias("updated"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24).alias("job_id"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("updated", "job_id")).cast("long"))


@query("sort_members", w("produced") + "SELECT node AS grp, string_agg(DISTINCT 'm' || process, ',' ORDER BY 'm' || process) AS members, 'm' || min(process) AS leader FROM produced WHERE process % 3 <> part % 3 GROUP BY node")
def sort_members(spark, sf_dir):
    """Members of each group by id; the first one leads."""
    rows = rel(spark, sf_dir, "produced").where("process % 3 <> part % 3")
    members = F.array_sort(F.collect_set(F.concat(F.lit("m"), F.col("process").cast("string"))))
    return rows.groupBy(F.col("node").alias("grp")).agg(F.array_join(members, ",").alias("members"), F.element_at(members, 1).alias("leader"))


@query("sink_offsets", w("commits") + "SELECT grp, topic, part, arg_max(committed, commit_ord) AS committed FROM commits GROUP BY 1, 2, 3")
def sink_offsets(spark, sf_dir):
    return rel(spark, sf_dir, "commits").groupBy("grp", "topic", "part").agg(F.max_by("committed", "commit_ord").alias("committed"))


@query("sink_offset_delete", w("commits") + "SELECT grp, topic, part, arg_max(committed, commit_ord) AS committed FROM commits WHERE NOT (topic = 'view' OR part = 2 AND grp = 'g1') GROUP BY 1, 2, 3")
def sink_offset_delete(spark, sf_dir):
    latest = sink_offsets(spark, sf_dir)
    gone = latest.where("topic = 'view' OR part = 2 AND grp = 'g1'").select("grp", "topic", "part")
    return latest.join(gone, ["grp", "topic", "part"], "left_anti")


@query("offset_fetch_commit_kafka", w("commits", "ends") + ", l AS (SELECT part, arg_max(committed, commit_ord) AS c FROM commits WHERE grp = 'g0' AND topic = 'click' AND part <> 3 GROUP BY 1) SELECT part, coalesce(c, -1) AS committed FROM ends LEFT JOIN l USING (part)")
def offset_fetch_commit_kafka(spark, sf_dir):
    """Known partitions only; -1 where nothing was committed."""
    latest = rel(spark, sf_dir, "commits").where("grp = 'g0' AND topic = 'click' AND part <> 3").groupBy("part").agg(F.max_by("committed", "commit_ord").alias("c"))
    return rel(spark, sf_dir, "ends").join(latest, "part", "left").select("part", F.coalesce("c", F.lit(-1).cast("long")).alias("committed"))


@query("sink_checkpoint", w("commits") + ", r AS (SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY commit_ord) AS generation, lag(committed) OVER (PARTITION BY topic, part ORDER BY commit_ord) AS p FROM commits) SELECT topic, part, generation, committed FROM r WHERE committed < p")
def sink_checkpoint(spark, sf_dir):
    """Publications that would move a checkpoint back."""
    order = Window.partitionBy("topic", "part").orderBy("commit_ord")
    rows = rel(spark, sf_dir, "commits").withColumn("generation", F.row_number().over(order).cast("long")).withColumn("p", F.lag("committed").over(order))
    return rows.where("committed < p").select("topic", "part", "generation", "committed")


_OLD = "(VALUES ('id', 1, 'int64', false), ('note', 2, 'string', true), ('flag', 3, 'bool', true))"
_NEW = "(VALUES ('id', 1, 'int64', false), ('note', 2, 'int64', true), ('flag', 3, 'bool', false), ('extra', 4, 'string', true), ('more', 5, 'string', true))"


@query("build_table_schema", "SELECT * FROM (VALUES ('id', 1), ('note', 2), ('flag', 3), ('extra', 4), ('more', 5)) t(name, field_id)")
def build_table_schema(spark, sf_dir):
    return M.table_schema(spark.sql(f"SELECT * FROM {_OLD} t(name, field_id, type, nullable)"), spark.sql(f"SELECT * FROM {_NEW} t(name, position, type, nullable)"))


@query("schema_compat", "SELECT * FROM (VALUES ('note', 'retyped'), ('flag', 'required')) t(name, reason)")
def schema_compat(spark, sf_dir):
    return M.incompatible(spark.sql(f"SELECT * FROM {_OLD} t(name, field_id, type, nullable)"), spark.sql(f"SELECT * FROM {_NEW} t(name, position, type, nullable)"))


@query("schema_validate", "SELECT * FROM (VALUES ('a', 'x', 'type'), ('a', 'Key', 'reserved'), ('b', 'n', 'duplicate'), ('b', 'N', 'duplicate'), ('b', 'p', 'path')) t(topic, name, reason)")
def schema_validate(spark, sf_dir):
    fields = spark.sql("SELECT * FROM VALUES ('a', 'x', 'bytes', '$.x'), ('a', 'Key', 'string', '$.k'), ('a', 'ok', 'int64', '$.a.b'), ('b', 'n', 'bool', '$.n'), ('b', 'N', 'bool', '$.m'), ('b', 'p', 'string', 'p') t(topic, name, type, path)")
    return M.invalid_fields(fields)


@query("assign_partitions", "SELECT * FROM (VALUES (0::BIGINT, 'a'), (1, 'b'), (2, 'c'), (3, 'a'), (4, 'b')) t(part, instance)")
def assign_partitions(spark, sf_dir):
    return M.round_robin(spark.range(5).withColumnRenamed("id", "part"), spark.sql("SELECT * FROM VALUES ('c'), ('a'), ('b') t(instance)"))


_LEADERS = ", r AS (SELECT topic, part, min(node) AS failed, max(w) % 5 AS e FROM windows GROUP BY topic, part)"


@query("elect_leader", w("windows") + _LEADERS + " SELECT topic, part, CASE WHEN part % 4 <> 3 THEN 'n' || cast((part % 3 + 1) % 3 AS varchar) END AS leader, CASE WHEN part % 4 <> 3 THEN e + 1 END AS epoch FROM r")
def elect_leader(spark, sf_dir):
    """The first in-sync replica that has not failed, in a new epoch; the last partition has only one replica."""
    rows = rel(spark, sf_dir, "windows").groupBy("topic", "part").agg(F.min("node").alias("failed"), (F.max("w") % 5).alias("e"))
    other = F.concat(F.lit("n"), (F.col("part") % 3 + 1) % 3)
    isr = F.when(F.col("part") % 4 == 3, F.array("failed")).otherwise(F.array("failed", other))
    return M.elect(rows.withColumn("isr", isr))


_CHANGES = [
    ("retention", "retention.ms", "set", "+1000"), ("retention", "retention.ms", "set", "86400000"), ("retention", "cleanup.policy", "set", "delete"), ("retention", "cleanup.policy", "delete", None),
    ("replicas", "min.insync.replicas", "set", "2"), ("replicas", "unclean.leader.election.enable", "set", "T"),
    ("back", "retention.ms", "delete", None), ("back", "tidelog.export.enabled", "delete", None), ("back", "tidelog.storage.mode", "set", "diskless"),
    ("negative", "retention.ms", "set", "-1"), ("huge", "retention.ms", "set", "9223372036854775808"), ("word", "tidelog.export.enabled", "set", "yes"),
    ("policy", "cleanup.policy", "set", "compact"), ("bytes", "retention.bytes", "set", "5"), ("schema", "tidelog.schema", "set", "{}"), ("mode", "tidelog.storage.mode", "set", "classic"),
    ("mode gone", "tidelog.storage.mode", "delete", None), ("bad mode", "tidelog.storage.mode", "set", "x"), ("op", "retention.ms", "append", "5"), ("two", "a.b", "set", "1"), ("two", "retention.ms", "set", "x"),
]
# case -> error, retention, export, unclean; the error of "replicas" depends on the topic
_ALTERED = "('retention', NULL, '86400000', 'true', 'false'), ('replicas', NULL, '5000', 'true', 'true'), ('back', NULL, '604800000', 'false', 'false'), ('none', NULL, '5000', 'true', 'false'), " + ", ".join(
    f"('{case}', '{error}', '5000', 'true', 'false')"
    for case, error in {
        "negative": "invalid retention.ms", "huge": "invalid retention.ms", "word": "invalid tidelog.export.enabled", "policy": "only cleanup.policy=delete is supported",
        "bytes": "retention.bytes is unsupported; use retention.ms (time-based retention only)", "schema": "tidelog.schema is immutable", "mode": "tidelog.storage.mode is immutable",
        "mode gone": "tidelog.storage.mode is immutable", "bad mode": "invalid tidelog.storage.mode", "op": 'unsupported incremental alter op for "retention.ms"', "two": 'unsupported topic config "a.b"',
    }.items()
)
_CONFIGS = w("windows") + f""", t AS (SELECT DISTINCT topic, length(topic) % 3 + 1 AS replicas FROM windows), a AS (SELECT * FROM (VALUES {_ALTERED}) v(c, error, retention, export, unclean)),
r AS (SELECT concat(topic, '/', c) AS topic, CASE WHEN c = 'replicas' AND replicas < 2 THEN 'invalid min.insync.replicas' ELSE error END AS error, retention, export, CASE WHEN c = 'replicas' AND replicas < 2 THEN 'false' ELSE unclean END AS unclean, CASE WHEN c = 'replicas' AND replicas >= 2 THEN '2' ELSE '1' END AS sync FROM t CROSS JOIN a)
"""


def _altered(spark, sf_dir):
    """Every topic in a copy for each case of changes."""
    cases = F.explode(F.array(*map(F.lit, sorted({c[0] for c in _CHANGES} | {"none"})))).alias("case")
    topics = rel(spark, sf_dir, "windows").select("topic").distinct().select(F.col("topic").alias("t"), cases)
    set_before = F.create_map(*map(F.lit, ("tidelog.storage.mode", "diskless", "retention.ms", "5000", "tidelog.export.enabled", "true")))
    topics = topics.select(F.concat("t", F.lit("/"), "case").alias("topic"), (F.length("t") % 3 + 1).alias("replicas"), set_before.alias("config"), "case")
    changes = spark.createDataFrame([(k, *c) for k, c in enumerate(_CHANGES)], "ord int, case string, name string, op string, value string")
    return configs.alter(topics.drop("case"), topics.select("topic", "case").join(changes, "case"))


@query("topic_configs", _CONFIGS + """SELECT topic, error, u.name, u.value, u.is_default FROM r, LATERAL (VALUES ('tidelog.schema', NULL, true), ('tidelog.storage.mode', 'diskless', false), ('tidelog.export.enabled', export, export = 'false'), ('cleanup.policy', 'delete', true), ('min.insync.replicas', sync, false), ('retention.ms', retention, false), ('unclean.leader.election.enable', unclean, unclean = 'false')) u(name, value, is_default)""")
def topic_configs(spark, sf_dir):
    """Changes of each kind, then all values; a bad change leaves its topic as it was."""
    done = _altered(spark, sf_dir)
    return configs.describe(done).join(done.select("topic", "error"), "topic")


@query("assign_replicated")
def assign_replicated(spark, sf_dir):
    """Three instances, one of them new; topics have two replicas a partition, some of them assigned before."""
    windows = rel(spark, sf_dir, "windows")
    before = windows.groupBy("topic", "part").agg(F.min("node").alias("leader"), F.max("w").alias("epoch")).withColumn("replicas", F.when(F.col("part") < 3, F.array("leader", F.lit("n1"))))
    return M.assign_replicated(before, spark.sql("SELECT * FROM VALUES ('n1'), ('n2'), ('n3') t(instance)"), 2).withColumn("replicas", F.array_join("replicas", ","))


@query("assign_diskless", w("windows") + ", b AS (SELECT topic, part, min(node) AS leader, max(w) AS epoch FROM windows GROUP BY 1, 2) SELECT topic, part, 'n' || cast(part % 2 + 1 AS varchar) AS leader, CASE WHEN leader = 'n' || cast(part % 2 + 1 AS varchar) THEN epoch ELSE epoch + 1 END AS epoch FROM b")
def assign_diskless(spark, sf_dir):
    before = rel(spark, sf_dir, "windows").groupBy("topic", "part").agg(F.min("node").alias("leader"), F.max("w").alias("epoch"))
    return M.assign_diskless(before, spark.sql("SELECT * FROM VALUES ('n2'), ('n1') t(instance)"))


@query("config_filter", _CONFIGS + "SELECT topic, 'retention.ms' AS name, retention AS value, false AS is_default FROM r")
def config_filter(spark, sf_dir):
    return configs.describe(_altered(spark, sf_dir), ["retention.ms", "unknown"])


@query("group_protocol_select", w("commits") + "SELECT DISTINCT grp, topic, CASE grp WHEN 'g0' THEN CASE WHEN length(topic) % 3 = 0 THEN 'sticky' WHEN length(topic) % 3 = 1 THEN 'range' END WHEN 'g1' THEN CASE WHEN length(topic) % 3 = 0 THEN 'range' WHEN length(topic) % 3 = 1 THEN 'range' END END AS protocol FROM commits")
def group_protocol_select(spark, sf_dir):
    """Groups without a protocol, with one that is offered and with one that is not; the last group's members offer none."""
    joins = rel(spark, sf_dir, "commits").select("grp", "topic").distinct()
    joins = joins.withColumn("current", F.expr("CASE length(topic) % 3 WHEN 1 THEN 'range' WHEN 2 THEN 'gone' END"))
    offered = F.expr("CASE grp WHEN 'g0' THEN array('sticky', 'range') WHEN 'g1' THEN array('range') ELSE cast(array() AS array<string>) END")
    return M.select_protocol(joins.withColumn("offered", offered)).select("grp", "topic", "protocol")


@query("group_delete_describe", "SELECT * FROM (VALUES ('a', true), ('b', false)) t(grp, deletable)")
def group_delete_describe(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('a', 0), ('b', 2) t(grp, members)").select("grp", (F.col("members") == 0).alias("deletable"))


@query("routing_map", w("windows") + "SELECT topic, part, CASE WHEN min(node) <> 'n2' THEN 'host-' || min(node) || ':90' || substr(min(node), 2) END AS address FROM windows GROUP BY topic, part")
def routing_map(spark, sf_dir):
    """Each partition's leader by its address; a leader that is not registered has none."""
    windows = rel(spark, sf_dir, "windows")
    leaders = windows.groupBy("topic", "part").agg(F.min("node").alias("node"))
    known = windows.select("node").distinct().where("node <> 'n2'").withColumn("address", F.concat(F.lit("host-"), "node", F.lit(":90"), F.substring("node", 2, 9)))
    return leaders.join(known, "node", "left").select("topic", "part", "address")


@query("cluster_status", w("produced") + "SELECT node, cast(count(*) AS bigint) AS ops, bool_or(NOT ok) AS failing FROM produced GROUP BY node")
def cluster_status(spark, sf_dir):
    return rel(spark, sf_dir, "produced").groupBy("node").agg(F.count("*").alias("ops"), F.bool_or(~F.col("ok")).alias("failing"))


@query("assignments_diff", w("windows") + ", o AS (SELECT topic, part, min(node) AS node FROM windows GROUP BY 1, 2), n AS (SELECT topic, part, 'n' || cast((part + CASE WHEN topic < 'd' THEN 0 ELSE 1 END) % 3 AS varchar) AS node FROM o) SELECT o.topic, o.part, o.node AS old_node, n.node AS new_node FROM o JOIN n USING (topic, part) WHERE o.node <> n.node")
def assignments_diff(spark, sf_dir):
    """Partitions whose node changes between two assignments; topics from 'd' on move by one."""
    old = rel(spark, sf_dir, "windows").groupBy("topic", "part").agg(F.min("node").alias("node"))
    new = old.withColumn("node", F.concat(F.lit("n"), (F.col("part") + F.when(F.col("topic") < "d", 0).otherwise(1)) % 3))
    return M.moved(old, new)


@query("isr_lag", w("observed") + ", l AS (SELECT part, node, max(ord) AS seen FROM observed GROUP BY 1, 2) SELECT part, node FROM l WHERE seen >= (SELECT max(ord) FROM observed) - 40")
def isr_lag(spark, sf_dir):
    seen = rel(spark, sf_dir, "observed").groupBy("part", "node").agg(F.max("ord").alias("seen"))
    return seen.crossJoin(F.broadcast(seen.agg(F.max("seen").alias("now")))).where("seen >= now - 40").select("part", "node")


@query("isr_stale_gc", w("windows") + "SELECT DISTINCT topic, part FROM windows WHERE topic = 'click' OR part > length(topic) % 4")
def isr_stale_gc(spark, sf_dir):
    """One topic is gone; others have as many partitions as their names say."""
    objects = rel(spark, sf_dir, "windows").select("topic", "part").distinct()
    topics = objects.select("topic").distinct().where("topic <> 'click'").withColumn("partitions", F.length("topic") % 4 + 1)
    return M.stale_objects(objects, topics)


@query("log_recover", w("batches") + "SELECT part, coalesce(min(first_offset) FILTER (batch_no % 17 = 13 OR batch_no % 29 = 24), max(last_offset) + 1) AS next_offset FROM batches GROUP BY part")
def log_recover(spark, sf_dir):
    """Logs with flipped and cut-off batches go on at the first of them, found by its checksum."""
    raw = F.expr("CASE WHEN batch_no % 17 = 13 THEN concat(substring(raw, 1, 60), unhex('FFFE'), substring(raw, 63)) WHEN batch_no % 29 = 24 THEN substring(raw, 1, 40) ELSE raw END")
    return batches.recovered(batched(spark, sf_dir).withColumn("raw", raw))


@query("log_truncate_from", w("ev_log") + "SELECT part, cast(count(*) AS bigint) AS n FROM ev_log WHERE record_offset < 64 GROUP BY part")
def log_truncate_from(spark, sf_dir):
    return rel(spark, sf_dir, "ev_log").where("record_offset < 64").groupBy("part").agg(F.count("*").alias("n"))


@query("log_compact_through", w("batches") + "SELECT part, min(first_offset) AS first_offset FROM batches WHERE last_offset > 64 GROUP BY part")
def log_compact_through(spark, sf_dir):
    return rel(spark, sf_dir, "batches").where("last_offset > 64").groupBy("part").agg(F.min("first_offset").alias("first_offset"))


@query("segment_refs_load", w("segments") + "SELECT part, base_offset, CASE WHEN base_offset % 200 = 0 THEN record_count END AS record_count FROM segments")
def segment_refs_load(spark, sf_dir):
    s = rel(spark, sf_dir, "segments")
    return s.select("part", "base_offset").join(s.where("base_offset % 200 = 0").select("part", "base_offset", "record_count"), ["part", "base_offset"], "left")
