"""History checkers: operations that were acknowledged, compared with what a drain of the log returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .small import small


def data_loss(acked: DataFrame, drained: DataFrame) -> DataFrame:
    """Acknowledged (part, record_offset) that the drain lacks."""
    return acked.select("part", "record_offset").distinct().join(drained, ["part", "record_offset"], "left_anti")


def lost_keys(acked: DataFrame, drained: DataFrame) -> DataFrame:
    return acked.select("part", "op_key").distinct().join(drained, "op_key", "left_anti")


def exactly_once(acked: DataFrame, drained: DataFrame) -> DataFrame:
    """Keys drained twice, acknowledged and missing, or drained and never acknowledged; one grouping for all three."""
    both = acked.select("op_key", F.lit(1).alias("a"), F.lit(0).alias("d")).unionByName(drained.select("op_key", F.lit(0).alias("a"), F.lit(1).alias("d")))
    by = both.groupBy("op_key").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    kind = F.when((F.col("a") > 0) & (F.col("d") == 0), "missing").when((F.col("a") == 0) & (F.col("d") > 0), "ghost").when(F.col("d") > 1, "duplicate")
    return by.withColumn("kind", kind).where("kind IS NOT NULL").select("op_key", "kind")


def drain_coverage(drained: DataFrame, partitions: int) -> DataFrame:
    expected = drained.sparkSession.range(partitions).select(F.col("id").cast("int").alias("part"))
    seen = drained.select("part").distinct().withColumn("seen", F.lit(True))
    out = expected.withColumn("expected", F.lit(True)).join(seen, "part", "full")
    return out.select("part", F.when(F.col("seen").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").alias("state")).where("state IS NOT NULL")


def ghost_reads(reads: DataFrame, ends: DataFrame) -> DataFrame:
    return reads.join(small(ends.select("part", "hw")), "part").where("record_offset >= hw").drop("hw")


def unseen_writes(produced: DataFrame, consumed: DataFrame) -> DataFrame:
    """Writes with a later read of their partition, whose key no read of that partition ever returned.

    Later reads are known from each partition's last one, so the inequality join is an equi-join on partitions.
    """
    last = consumed.groupBy("part").agg(F.max("op_time").alias("last_read"))
    later = produced.join(small(last), "part").where("last_read > op_time").drop("last_read")
    return later.join(consumed.select("part", "op_key"), ["part", "op_key"], "left_anti")


def recovery_time(faults: DataFrame, ok_ops: DataFrame, block: int = 3_600_000) -> DataFrame:
    """For each fault the time to the next successful operation of its node; a fault without one has no row.

    Rows are ordered within blocks of ``block`` milliseconds, so no task orders a whole node. A fault without a success
    left in its block takes the first success of the next block that has one. A success at a fault's own time counts.
    """
    both = faults.select("node", F.col("op_time").alias("t"), F.lit(1).alias("fault")).unionByName(ok_ops.select("node", F.col("op_time").alias("t"), F.lit(0).alias("fault")))
    both = both.withColumn("block", F.floor(F.col("t") / block)).withColumn("ok_at", F.when(F.col("fault") == 0, F.col("t")))
    # backwards in time, so that the frame grows by a row at a time
    within = Window.partitionBy("node", "block").orderBy(F.desc("t"), "fault").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("node").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("node", "block").agg(F.min("ok_at").alias("first_ok")).select("node", "block", F.last("first_ok", ignorenulls=True).over(after).alias("later"))
    found = both.withColumn("next_ok", F.last("ok_at", ignorenulls=True).over(within)).where("fault = 1").join(blocks, ["node", "block"])
    return found.select("node", (F.coalesce("next_ok", "later") - F.col("t")).alias("recovery")).where("recovery IS NOT NULL")


def monotonic(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Rows whose value is below the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("before", before).where(f"{value} < before")


def below_running_max(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    top = F.max(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("top", top).where(f"{value} < top")
