"""Reads of an offset-ordered log. Rows carry part, record_offset, record_timestamp; other columns pass through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .small import small

MAX_HTTP_LIMIT, MAX_HTTP_PAGE, DEFAULT_HTTP_LIMIT = 20_000, 1_000, 100
EARLIEST, LATEST, LATEST_TIERED = -2, -1, -4
#: Offsets of a block: the most rows of a log without repeats that one task orders at a time.
BLOCK = 1 << 16


class OffsetOutOfRange(ValueError):
    """A read that starts beyond the high watermark."""


def offset_range(log: DataFrame, part: int, start: int, limit: int, order: str = "record_offset") -> DataFrame:
    """Rows of one partition from ``start`` up to the first hole, at most ``limit``.

    The offset span bounds the read before any ordering: without holes no more than ``limit`` offsets can qualify.
    """
    rows = log.where((F.col("part") == part) & (F.col(order) >= start) & (F.col(order) < start + limit))
    rank = F.dense_rank().over(Window.partitionBy("part").orderBy(order)) - 1
    return rows.withColumn("_gap", F.col(order) - start - rank).where("_gap = 0").drop("_gap")


def contiguous_prefix(rows: DataFrame, start: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of each partition before its first hole; with ``start``, a first row beyond it is a hole.

    Blocks of offsets are counted first, and only the blocks' totals are ordered by partition. Rows are ordered within
    their block, up to the block with the first hole: no task holds a whole log partition.
    """
    rows = rows.withColumn("_block", F.floor(F.col("record_offset") / block))
    totals = rows.groupBy("part", "_block").agg(F.min("record_offset").alias("_lo"), F.max("record_offset").alias("_hi"), F.count_distinct("record_offset").alias("_n"))
    w = Window.partitionBy("part").orderBy("_block")
    first = F.min("_lo").over(Window.partitionBy("part")) if start is None else start
    totals = totals.withColumn("_from", F.coalesce(F.lag("_hi").over(w) + 1, first))
    broken = (F.col("_lo") != F.col("_from")) | (F.col("_n") != F.col("_hi") - F.col("_lo") + 1)
    totals = totals.withColumn("_broken", broken).withColumn("_before", F.max("_broken").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    kept = rows.join(totals.where("NOT coalesce(_before, false)").select("part", "_block", "_from"), ["part", "_block"])
    rank = F.dense_rank().over(Window.partitionBy("part", "_block").orderBy("record_offset")) - 1
    return kept.withColumn("_gap", F.col("record_offset") - F.col("_from") - rank).where("_gap = 0").drop("_gap", "_block", "_from")


def committed(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows below their partition's high watermark. ``ends``: part, hw."""
    return log.join(small(ends.select("part", "hw")), "part").where(F.col("record_offset") < F.col("hw")).drop("hw")


def read_committed(log: DataFrame, part: int, start: int, high_watermark: int, limit: int) -> DataFrame:
    if start > high_watermark:
        raise OffsetOutOfRange(f"offset {start} is beyond the high watermark {high_watermark}")
    return offset_range(log.where(F.col("record_offset") < high_watermark), part, start, max(0, min(limit, high_watermark - start)))


def validate_committed_range(start: int, end: int, high_watermark: int) -> None:
    """An inclusive range that must be committed."""
    if end < start:
        raise ValueError(f"range end {end} is before its start {start}")
    if end >= high_watermark:
        raise ValueError(f"range end {end} is not committed (high watermark {high_watermark})")


def page(log: DataFrame, part: int, start: int, limit: int) -> DataFrame:
    """One page's row count and next offset; an empty page stays at ``start``."""
    rows = offset_range(log, part, start, limit)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.max("record_offset") + 1, F.lit(start).cast("long")).alias("next_offset"))


def http_limit(limit: int | None) -> int:
    """The limit of one response: 100 unless asked, at most 20,000, and 1,000 rows at a time."""
    asked = DEFAULT_HTTP_LIMIT if limit is None else limit
    return min(min(asked, MAX_HTTP_LIMIT), MAX_HTTP_PAGE)


def byte_budget(rows: DataFrame, size: str, budget: int, order: str, *by: str, block: int = BLOCK) -> DataFrame:
    """The prefix whose running size stays within ``budget``, and the first row in any case.

    Blocks of ``order``, a number, are summed first; only rows of blocks that begin within the budget are ordered.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy(*by, "_block").agg(F.sum(size).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    begun = totals.withColumn("_before", F.coalesce(before, F.lit(0))).where(f"_before <= {budget}").select(*by, "_block")
    w = Window.partitionBy(*by).orderBy(order)
    kept = rows.join(begun, [*by, "_block"]).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_rank", F.row_number().over(w))
    return kept.where(f"_sum <= {budget} OR _rank = 1").drop("_sum", "_rank", "_block")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sealed, pending and active parts of a log; later sources win where they overlap."""
    out = None
    for k, source in enumerate(sources):
        source = source.withColumn("source_ord", F.lit(k))
        out = source if out is None else out.unionByName(source)
    return dedup_last_wins(out).drop("source_ord")


def dedup_last_wins(rows: DataFrame) -> DataFrame:
    """For each offset the row of the highest source_ord, by an aggregate that combines before the shuffle."""
    keys = ["part", "record_offset"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "source_ord").alias("r")).select(*keys, "r.*")


def lowest_offsets(rows: DataFrame, part: int, limit: int) -> DataFrame:
    return dedup_last_wins(rows.where(F.col("part") == part)).orderBy("record_offset").limit(limit)


def list_offsets(log: DataFrame, ends: DataFrame) -> DataFrame:
    found = log.groupBy("part").agg(F.min("record_offset").alias("earliest"), (F.max("record_offset") + 1).alias("latest"))
    return found.join(small(ends.select("part", "hw")), "part", "left")


def seek_timestamp(log: DataFrame, ts: int, parts: DataFrame | None = None) -> DataFrame:
    """First offset at or after ``ts``; with ``parts``, -1 for those without one. The filter reaches the scan."""
    found = log.where(F.col("record_timestamp") >= ts).groupBy("part").agg(F.min("record_offset").alias("record_offset"))
    if parts is None:
        return found
    return parts.select("part").join(small(found), "part", "left").select("part", F.coalesce("record_offset", F.lit(-1).cast("long")).alias("record_offset"))


def bounds(segments: DataFrame) -> DataFrame:
    return segments.groupBy("part").agg(F.min("base_offset").alias("first_offset"), (F.max("end_offset") + 1).alias("next_offset"))


def locate(offsets: DataFrame, segments: DataFrame, block: int) -> DataFrame:
    """The segment that contains each offset: a range join turned into an equi-join on offset blocks.

    A segment is listed in every block that it touches, so any segment length is right; ``block`` only sets the cost.
    """
    listed = segments.withColumn("_block", F.explode(F.sequence(F.floor(F.col("base_offset") / block), F.floor(F.col("end_offset") / block))))
    return offsets.withColumn("_block", F.floor(F.col("record_offset") / block)).join(listed, ["part", "_block"]).where("record_offset BETWEEN base_offset AND end_offset").drop("_block")


def segments_from(segments: DataFrame, part: int, start: int, limit: int) -> DataFrame:
    return segments.where((F.col("part") == part) & (F.col("end_offset") >= start)).orderBy("base_offset").limit(limit)


def last_before(index: DataFrame, key: str, target: int, value: str) -> DataFrame:
    """Value of the largest key up to ``target`` in each partition."""
    return index.where(F.col(key) <= target).groupBy("part").agg(F.max_by(value, key).alias(value))


def first_from(index: DataFrame, key: str, target: int, value: str) -> DataFrame:
    return index.where(F.col(key) >= target).groupBy("part").agg(F.min_by(value, key).alias(value))


def timestamp_index(batches: DataFrame, ts: str = "max_timestamp", order: str = "first_offset") -> DataFrame:
    """Batches that raise their partition's largest timestamp."""
    before = F.max(ts).over(Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("_before", before).where(f"_before IS NULL OR {ts} > _before").drop("_before")
