"""Reports, checks and summaries over logs and histories. Aggregates combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_state(rows: DataFrame) -> DataFrame:
    """ready, unavailable, rebalancing or degraded, by the instances active and ready, and the partitions assigned, initialized and expected."""
    settled = (F.col("assigned") == F.col("expected")) & (F.col("initialized") == F.col("expected"))
    state = F.when((F.col("active") > 0) & (F.col("active") == F.col("ready")) & settled, "ready").when(F.col("active") == 0, "unavailable").when(~settled, "rebalancing")
    return rows.withColumn("state", state.otherwise("degraded"))


def group_state(rows: DataFrame) -> DataFrame:
    """Empty without members, Stable when all have assignments, else PreparingRebalance."""
    return rows.withColumn("state", F.when(F.col("members") == 0, "Empty").when(F.col("assigned") == F.col("members"), "Stable").otherwise("PreparingRebalance"))


def gaps(rows: DataFrame, by: str = "part", order: str = "record_offset") -> DataFrame:
    """missing before each row: the first row is the baseline, a step back counts as none."""
    before = F.lag(order).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("missing", F.greatest(F.coalesce(F.col(order) - before - 1, F.lit(0)), F.lit(0)).cast("long"))


def offset_check(rows: DataFrame, samples: int = 10, block: int = 4096) -> DataFrame:
    """records, first, last, missing and the first gaps by partition.

    Blocks of offsets are looked at by themselves; only a row for each block is ordered within its partition.
    """
    inside = rows.groupBy("part", F.floor(F.col("record_offset") / block).alias("b")).agg(F.sort_array(F.collect_set("record_offset")).alias("a"))
    n, first, last = F.size("a"), F.element_at("a", 1), F.element_at("a", -1)
    steps = F.zip_with(F.slice("a", F.lit(1), n - 1), F.slice("a", F.lit(2), n - 1), lambda x, y: F.when(y > x + 1, x + 1))
    blocks = inside.select("part", "b", n.alias("n"), first.alias("lo"), last.alias("hi"), F.slice(F.array_compact(steps), 1, samples).alias("gaps"))
    before = F.lag("hi").over(Window.partitionBy("part").orderBy("b"))
    blocks = blocks.withColumn("gaps", F.concat(F.array_compact(F.array(F.when(F.col("lo") > before + 1, before + 1))), "gaps"))
    totals = blocks.groupBy("part").agg(F.sum("n").alias("records"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    holes = blocks.where(F.size("gaps") > 0).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("b"))).where(F.col("k") <= samples)
    starts = holes.groupBy("part").agg(F.slice(F.sort_array(F.flatten(F.collect_list("gaps"))), 1, samples).alias("gap_starts"))
    found = totals.join(starts, "part", "left").withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("records"))
    return found.select("part", "records", "first", "last", "missing", F.coalesce("gap_starts", F.array().cast("array<bigint>")).alias("gap_starts"))


def report_topic(windows: DataFrame) -> DataFrame:
    seconds = (F.max("end_ms") - F.min("start_ms")) / F.lit(1000.0)
    out = windows.groupBy("topic").agg(F.sum("produced").alias("produced"), F.sum("consumed").alias("consumed"), F.sum(F.col("gaps") + F.col("seq_errors") + F.col("decode_errors")).alias("errors"), seconds.alias("seconds"))
    return out.withColumn("rate", F.when(F.col("seconds") > 0, F.col("produced") / F.col("seconds")).otherwise(0.0))


def report_overall(windows: DataFrame) -> DataFrame:
    return windows.agg(F.sum("produced").alias("produced"), F.sum("consumed").alias("consumed"), F.concat_ws(",", F.array_sort(F.collect_set("node"))).alias("nodes"), F.count_distinct("w").alias("windows"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"))


def anomalies(windows: DataFrame) -> DataFrame:
    """One row per topic, partition and kind: gaps and undecodable values are errors, sequence errors warnings, and
    consumption behind production is lag."""
    by = windows.groupBy("topic", "part").agg(*[F.sum(c).alias(c) for c in ("gaps", "seq_errors", "decode_errors", "produced", "consumed")])
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), n.alias("n")) for kind, level, n in (("gap", "error", F.col("gaps")), ("sequence", "warning", F.col("seq_errors")), ("decode", "error", F.col("decode_errors")), ("lag", "warning", F.col("produced") - F.col("consumed")))])
    return by.select("topic", "part", F.inline(kinds)).where("n > 0")


def digest(rows: DataFrame, value: str, by: str = "part", order: str = "record_offset", block: int = 4096) -> DataFrame:
    """A digest of each partition's values in offset order, with rows and bytes.

    Blocks of offsets are hashed first and the partition's digest is of its blocks' digests, so that no task holds
    more than a block of values.
    """
    blocks = rows.groupBy(by, F.floor(F.col(order) / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("v"), F.count("*").alias("n"), F.sum(F.length(value)).alias("b"))
    blocks = blocks.select(by, "_block", "n", "b", F.sha2(F.array_join(F.transform("v", lambda x: x[value].cast("string")), ""), 256).alias("d"))
    return blocks.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("n"), F.sum("b").cast("long").alias("nbytes"))


def repeated(rows: DataFrame, keys: list[str], value: str, name: str = "n") -> DataFrame:
    """Keys with more than one distinct value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias(name)).where(f"{name} > 1")
