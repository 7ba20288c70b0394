"""Mixing sources to target weights by entropy balancing.

Document rates are as near to 1 as possible (in relative entropy) among those that meet each source's target of words
and stay within ``most``. They are tilts exp(lambda * size / mean), cut off at ``most``, with one multiplier for each
source. The dual is convex and falls apart by source; Newton steps, kept within brackets, solve it. Each step is one
aggregation over the histogram (source, size, documents), in integers, so reruns agree to the last bit.

Rates become copies block by block (about ``block_rows`` different documents of one source), from the largest document
down: each rate is rounded up or down, whichever leaves the block's words nearer to their sum of rates so far; of equal
rows as many are rounded up as come nearest. What is left at the end of a block is about half of its smallest document.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch

_UNIT = 1 << 20  # of rates, so that their sums are exact
_TOP = 700.0
_BROADCAST_SOURCES = 100_000
_LINE = 10_000  # equal rows in one line of a plan
_STRING, _DOUBLE, _LONG = pa.string(), pa.float64(), pa.int64()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Each source's share of all words by repeating weights, at most ``most`` times its size; the excess is reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))  # Python compares by code point
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), sum(n for _, n in order)
    full: set = set()
    while True:
        rest = total - sum(most * size[s] for s in full)
        by = sum(weight[s] for s in size if s not in full)
        found = {s: float(most * size[s]) if s in full else rest * weight[s] / by for s in size}
        over = {s for s in size if s not in full and found[s] > most * size[s]}
        if not over:
            return found
        full |= over


def _small(spark: SparkSession, rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """A table with a row for each source; broadcast only while there are few."""
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    table = spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names))
    return F.broadcast(table) if len(rows) <= _BROADCAST_SOURCES else table


def _rate(tilt: Column, size: Column, mean: Column, most: int) -> Column:
    """In 1 / _UNIT; the exponent is bounded before the exponential."""
    return F.round(F.least(F.exp(F.least(tilt * size / mean, F.lit(math.log(most)))), F.lit(float(most))) * _UNIT).cast("long")


def balance(histogram: DataFrame, goal: dict[str | None, float], size: dict[str | None, int], count: dict[str | None, int], most: int = 3, rounds: int = 100, tolerance: float = 1e-4) -> dict[str | None, tuple[float, float]]:
    """For each source its multiplier and mean size. Distributed Newton steps on all sources at once."""
    spark = histogram.sparkSession
    mean = {s: max(1.0, size[s] / max(1, count[s])) for s in goal}
    at = {s: (0.0, -_TOP, _TOP) for s in goal if size[s]}
    done = {s: 0.0 for s in goal if not size[s]}
    for s in list(at):
        if goal[s] >= most * size[s]:
            done[s] = _TOP
            del at[s]
    for _ in range(rounds):
        if not at:
            break
        table = _small(spark, [(s, x[0], mean[s]) for s, x in at.items()], ["s", "tilt", "mean"], [_STRING, _DOUBLE, _DOUBLE])
        rated = histogram.join(table, histogram.source.eqNullSafe(F.col("s"))).withColumn("rate", _rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
        words = (F.col("n") * F.col("size")).cast("decimal(20,0)") * F.col("rate")
        slope = F.when(F.col("rate") < most * _UNIT, words * F.round(F.col("size") / F.col("mean") * 1024).cast("long")).otherwise(0)
        for r in rated.groupBy("s").agg(F.sum(words).alias("f"), F.sum(slope).alias("g")).collect():  # a row for each source
            x, lo, hi = at[r.s]
            f, g = float(r.f) / _UNIT, float(r.g) / _UNIT / 1024
            miss = f - goal[r.s]
            if abs(miss) <= tolerance * goal[r.s] or hi - lo < 1e-12:
                done[r.s] = x
                del at[r.s]
                continue
            lo, hi = (lo, x) if miss > 0 else (x, hi)
            step = x - miss / g if g > 0 else math.nan
            if not lo < step < hi:
                # out of the bracket: halve it, or double the distance while one side is unknown
                step = (lo + hi) / 2 if lo > -_TOP and hi < _TOP else (2 * x + 1 if miss < 0 else 2 * x - 1)
                step = min(max(step, (x + lo) / 2), (x + hi) / 2)
            at[r.s] = (step, lo, hi)
    if at:
        raise RuntimeError(f"multipliers of {len(at)} sources did not converge")
    return {s: (done[s], mean[s]) for s in goal}


def _rounded(most: int):
    """Copies of each row of a block of (doc_id, size, text hash): ``n`` equal rows share one line for each number of copies."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "place", "doc_id", "t"], ascending=[False, True, True, True], kind="stable")
        owed, at, copies, rows = 0, [], [], []
        for k, (size, rate, n) in enumerate(zip(block["size"].tolist(), block["rate"].tolist(), block["n"].tolist(), strict=True)):
            low = rate // _UNIT
            high = min(most, -(-rate // _UNIT))
            owed += n * size * (rate - low * _UNIT)
            step = size * (high - low) * _UNIT
            up = min(n, max(0, (2 * owed + step - 1) // (2 * step))) if step else 0  # the nearest, the lower of two
            owed -= up * step
            for c, m in ((low, n - up), (high, up)):
                while m:
                    at.append(k)
                    copies.append(c)
                    rows.append(min(m, _LINE))
                    m -= rows[-1]
        return block.iloc[at].assign(copies=copies, n=rows)[["doc_id", "t", "size", "source_size", "target", "copies", "n"]]

    return run


def _taken(rows: DataFrame, weights, most: int, block_rows: int, scratch: Scratch) -> DataFrame:
    """For rows (doc_id, source, size, t): doc_id, t, size, source_size, target, copies, and n equal rows that get them."""
    spark = rows.sparkSession
    entries = scratch.keep(rows.groupBy("source", "doc_id", "size", "t").agg(F.count("*").alias("n")), "sizes")
    histogram = scratch.keep(entries.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("entries")), "histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("n"), F.sum("entries").alias("entries")).collect()
    size, count = {r.source: int(r.words) for r in totals}, {r.source: int(r.n) for r in totals}
    goal = targets(list(size.items()), weights, most)
    tilts = balance(histogram, goal, size, count, most)
    facts = [(r.source, size[r.source], goal[r.source], *tilts[r.source], max(1, -(-r.entries // block_rows))) for r in totals]
    table = _small(spark, facts, ["s", "source_size", "target", "tilt", "mean", "blocks"], [_STRING, _LONG, _DOUBLE, _DOUBLE, _DOUBLE, _LONG])
    rated = entries.join(table, entries.source.eqNullSafe(F.col("s"))).withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)).otherwise(_UNIT))
    place = F.xxhash64(F.lit(11), "doc_id", "size", "t")
    blocked = rated.withColumn("place", place).withColumn("block", F.pmod(F.xxhash64(F.lit(13), "place"), F.col("blocks")))
    slim = blocked.select("doc_id", "t", "size", "source_size", "target", "rate", "n", "place", "source", "block")
    return slim.groupBy("source", "block").applyInPandas(_rounded(most), "doc_id long, t long, size long, source_size long, target double, copies int, n long")


def mix(docs: DataFrame, weights=(5, 2, 1), most: int = 3, block_rows: int = 1000, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, copies.

    size is the number of words of the whole text, however long (null text: 0), taken is size times copies. A null
    source is a source, the last in order. Documents without words are taken once and count for nothing. Sources
    without words have a target of 0. No document is taken more than ``most`` times. Rows with the same doc_id, source
    and size, and rows without an id, are rounded together; however many they are, they are one entry of a block. Other
    columns are ignored, whatever their names. The driver holds one entry for each source, not for each document. An
    empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.lit(0).cast("long").alias("t"))
    out = _taken(rows, weights, most, block_rows, scratch)
    several = out.where("n > 1")
    spread = several.repartition("doc_id", "size", "copies", F.monotonically_increasing_id()).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("_")
    return out.where("n = 1").unionByName(spread).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat(docs: DataFrame, weights=(5, 2, 1), most: int = 3, block_rows: int = 1000, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as the mix takes it: none to ``most`` times.

    Equal rows are taken as often as all of them together are. Ids may be null or repeated, and columns may have any
    names. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.lit(1), *docs.columns).alias("_t"))
    row = whole.withColumns({"_id": F.col("_row.doc_id").cast("long"), "_size": word_count(F.col("_row.text").cast("string"))})
    rows = row.select(F.col("_id").alias("doc_id"), F.col("_row.source").cast("string").alias("source"), F.col("_size").alias("size"), F.col("_t").alias("t"))
    taken = _taken(rows, weights, most, block_rows, scratch).where("copies > 0")
    z, d = F.isnull("doc_id").alias("_z"), F.coalesce("doc_id", F.lit(0)).alias("_d")
    taken = taken.select(z, d, F.col("t").alias("_t"), (F.col("copies") * F.col("n")).alias("_n"))
    key = ["_z", "_d", "_t"]
    once = whole.withColumns({"_z": F.isnull(F.col("_row.doc_id").cast("long")), "_d": F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(0))}).dropDuplicates(key)
    return once.join(taken, key).withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
