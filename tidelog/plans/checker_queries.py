"""Queries of history checkers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import checkers as C
from .catalog import query
from .fixtures import relation as rel
from .fixtures import with_clause as w

_PD = w("produced", "drained")


def _both(spark, sf_dir):
    return rel(spark, sf_dir, "produced").where("ok"), rel(spark, sf_dir, "drained")


@query("anti_data_loss", _PD + "SELECT part, record_offset FROM produced p WHERE ok AND NOT EXISTS (SELECT 1 FROM drained d WHERE d.part = p.part AND d.record_offset = p.record_offset)")
def anti_data_loss(spark, sf_dir):
    return C.data_loss(*_both(spark, sf_dir))


@query("anti_committed_durability", _PD + "SELECT DISTINCT part, op_key FROM produced p WHERE ok AND op_key NOT IN (SELECT op_key FROM drained)")
def anti_committed_durability(spark, sf_dir):
    return C.lost_keys(*_both(spark, sf_dir))


@query("anti_truncation", _PD + "SELECT part, cast(count(*) AS bigint) AS lost FROM produced p WHERE ok AND op_key NOT IN (SELECT op_key FROM drained) GROUP BY part")
def anti_truncation(spark, sf_dir):
    return C.lost_keys(*_both(spark, sf_dir)).groupBy("part").agg(F.count("*").alias("lost"))


@query("anti_replica_convergence", _PD + ", r AS (SELECT n.node, p.op_key, p.record_offset FROM produced p CROSS JOIN (VALUES ('n0', 3), ('n1', 5)) n(node, m) WHERE ok), h AS (SELECT * FROM r WHERE record_offset % 50 <> CASE node WHEN 'n0' THEN 3 ELSE 5 END) SELECT node, op_key FROM r EXCEPT SELECT node, op_key FROM h")
def anti_replica_convergence(spark, sf_dir):
    acked = rel(spark, sf_dir, "produced").where("ok")
    replicas = F.explode(F.array(F.struct(F.lit("n0").alias("node"), F.lit(3).alias("m")), F.struct(F.lit("n1").alias("node"), F.lit(5).alias("m"))))
    wanted = acked.select("op_key", "record_offset", replicas.alias("r")).select("op_key", "record_offset", "r.*")
    held = wanted.where("record_offset % 50 <> m").select("node", "op_key")
    return wanted.select("node", "op_key").join(held, ["node", "op_key"], "left_anti")


@query("semi_read_your_writes", _PD + "SELECT p.part, p.op_key FROM produced p WHERE ok AND EXISTS (SELECT 1 FROM drained d WHERE d.part = p.part AND d.op_time > p.op_time) AND NOT EXISTS (SELECT 1 FROM drained d WHERE d.part = p.part AND d.op_key = p.op_key)")
def semi_read_your_writes(spark, sf_dir):
    return C.unseen_writes(*_both(spark, sf_dir)).select("part", "op_key")


@query("asof_recovery_time", w("produced") + ", r AS (SELECT f.node, p.op_time - f.op_time AS recovery FROM produced f ASOF JOIN (SELECT node, op_time FROM produced WHERE ok) p ON f.node = p.node AND f.op_time <= p.op_time WHERE NOT f.ok) SELECT node, min(recovery) AS shortest, max(recovery) AS longest, avg(recovery) AS mean FROM r GROUP BY node")
def asof_recovery_time(spark, sf_dir):
    p = rel(spark, sf_dir, "produced")
    times = C.recovery_time(p.where("NOT ok"), p.where("ok"))
    return times.groupBy("node").agg(F.min("recovery").alias("shortest"), F.max("recovery").alias("longest"), F.avg("recovery").alias("mean"))


@query("agg_availability", w("produced") + "SELECT process, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS availability FROM produced GROUP BY process")
def agg_availability(spark, sf_dir):
    return rel(spark, sf_dir, "produced").groupBy("process").agg(F.avg(F.col("ok").cast("double")).alias("availability"))


@query("agg_split_brain", w("sources") + "SELECT part, record_offset, cast(count(DISTINCT value) AS bigint) AS n FROM sources GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def agg_split_brain(spark, sf_dir):
    return A.repeated(rel(spark, sf_dir, "sources"), ["part", "record_offset"], "value")


@query("agg_single_leader", w("produced") + "SELECT part, record_offset // 40 AS epoch, cast(count(DISTINCT node) AS bigint) AS n FROM produced GROUP BY 1, 2 HAVING count(DISTINCT node) > 1")
def agg_single_leader(spark, sf_dir):
    rows = rel(spark, sf_dir, "produced").withColumn("epoch", F.floor(F.col("record_offset") / 40))
    return A.repeated(rows, ["part", "epoch"], "node")


@query("agg_exactly_once", _PD + ", a AS (SELECT op_key FROM produced WHERE ok), d AS (SELECT op_key, count(*) AS n FROM drained GROUP BY 1) SELECT op_key, 'missing' AS kind FROM a WHERE op_key NOT IN (SELECT op_key FROM d) UNION ALL SELECT op_key, 'ghost' FROM d WHERE op_key NOT IN (SELECT op_key FROM a) UNION ALL SELECT op_key, 'duplicate' FROM d WHERE n > 1 AND op_key IN (SELECT op_key FROM a)")
def agg_exactly_once(spark, sf_dir):
    return C.exactly_once(*_both(spark, sf_dir))


@query("set_difference_keys", _PD + "SELECT op_key FROM drained EXCEPT SELECT op_key FROM produced")
def set_difference_keys(spark, sf_dir):
    return rel(spark, sf_dir, "drained").select("op_key").subtract(rel(spark, sf_dir, "produced").select("op_key"))


@query("agg_drain_coverage", "SELECT * FROM (VALUES (1, 'missing'), (4, 'missing'), (5, 'missing')) t(part, state)")
def agg_drain_coverage(spark, sf_dir):
    return C.drain_coverage(rel(spark, sf_dir, "drained").where("part <> 1"), 6)


@query("agg_ghost_reads", w("drained", "ends") + "SELECT d.part, d.record_offset, op_key FROM drained d JOIN ends USING (part) WHERE d.record_offset >= hw")
def agg_ghost_reads(spark, sf_dir):
    return C.ghost_reads(rel(spark, sf_dir, "drained"), rel(spark, sf_dir, "ends")).select("part", "record_offset", "op_key")


@query("w_offset_monotonicity", _PD + ", c AS (SELECT part, record_offset, count(*) AS n FROM drained GROUP BY 1, 2), g AS (SELECT *, record_offset - lag(record_offset) OVER (PARTITION BY part ORDER BY record_offset) - 1 AS m FROM c) SELECT part, cast(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS bigint) AS duplicates, cast(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS bigint) AS gaps FROM g GROUP BY part")
def w_offset_monotonicity(spark, sf_dir):
    counted = rel(spark, sf_dir, "drained").groupBy("part", "record_offset").agg(F.count("*").alias("n"))
    return A.gaps(counted).groupBy("part").agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("missing") > 0).alias("gaps"))


@query("w_total_order", w("ev_log") + ", r AS (SELECT part, record_offset, event_id, lag(record_offset) OVER (PARTITION BY part ORDER BY event_id) AS p FROM ev_log) SELECT part, cast(sum(CASE WHEN p IS NOT NULL AND record_offset <> p + 1 OR p IS NULL AND record_offset <> 0 THEN 1 ELSE 0 END) AS bigint) AS violations FROM r GROUP BY part")
def w_total_order(spark, sf_dir):
    before = F.lag("record_offset").over(Window.partitionBy("part").orderBy("event_id"))
    rows = rel(spark, sf_dir, "ev_log").withColumn("e", F.coalesce(before + 1, F.lit(0)))
    return rows.groupBy("part").agg(F.count_if(F.col("record_offset") != F.col("e")).alias("violations"))


@query("w_hw_monotonicity", w("observed") + ", r AS (SELECT *, lag(hw) OVER (PARTITION BY process, part, node ORDER BY ord) AS b FROM observed) SELECT process, part, node, ord FROM r WHERE hw < b")
def w_hw_monotonicity(spark, sf_dir):
    return C.monotonic(rel(spark, sf_dir, "observed"), "hw", "ord", "process", "part", "node").select("process", "part", "node", "ord")


@query("w_hw_global", w("observed") + ", r AS (SELECT *, max(hw) OVER (PARTITION BY process, part ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM observed) SELECT process, part, ord, b - hw AS behind FROM r WHERE hw < b")
def w_hw_global(spark, sf_dir):
    rows = C.below_running_max(rel(spark, sf_dir, "observed"), "hw", "ord", "process", "part")
    return rows.select("process", "part", "ord", (F.col("top") - F.col("hw")).alias("behind"))


@query("w_consumer_offsets", w("commits") + ", r AS (SELECT *, max(committed) OVER (PARTITION BY grp, topic, part ORDER BY commit_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM commits) SELECT grp, cast(sum(CASE WHEN committed < b THEN 1 ELSE 0 END) AS bigint) AS regressions, cast(count(*) AS bigint) AS n FROM r GROUP BY grp")
def w_consumer_offsets(spark, sf_dir):
    top = F.max("committed").over(Window.partitionBy("grp", "topic", "part").orderBy("commit_ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rel(spark, sf_dir, "commits").withColumn("b", top)
    return rows.groupBy("grp").agg(F.count_if(F.col("committed") < F.col("b")).alias("regressions"), F.count("*").alias("n"))
