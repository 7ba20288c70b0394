"""Record batches by their bytes: part, first_offset, last_offset, raw. Windows order sizes, never the bytes themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from ..sources import recordbatch as R
from .scan import byte_budget
from .small import small

KEY = ["part", "first_offset"]
_OUT = "part int, first_offset long, last_offset long, record_count long, raw binary"


def raw_read(sources: list[DataFrame], requests: DataFrame, budget: int) -> DataFrame:
    """Whole batches for each partition's request (part, start_offset, bound): sealed, then pending, then active ones.

    A batch that stands in two sources is read from the earlier. Reading stops at the first hole, whatever lies behind
    it, at ``bound`` (a batch that begins below it is whole) and at ``budget`` bytes, but one batch is always read.
    """
    every = None
    for k, source in enumerate(sources):
        source = source.select(*KEY, "last_offset", "nbytes", F.lit(k).alias("source"))
        every = source if every is None else every.unionByName(source)
    every = every.join(small(requests), "part").where("last_offset >= start_offset AND first_offset < bound")
    one = every.groupBy(*KEY).agg(F.min_by(F.struct("last_offset", "nbytes", "source", "start_offset"), "source").alias("b")).select(*KEY, "b.*")
    # what the budget leaves is few rows of each partition, so that one task orders them
    kept = byte_budget(one, "nbytes", budget, "first_offset", "part")
    w = Window.partitionBy("part").orderBy("first_offset")
    hole = F.col("first_offset") > F.coalesce(F.lag("last_offset").over(w) + 1, F.col("start_offset"))
    kept = kept.withColumn("hole", hole).withColumn("stopped", F.max("hole").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where("NOT stopped").drop("hole", "stopped", "start_offset")


def in_ranges(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Batches in the byte ranges of ``refs``, with the offsets that these give them: stored batches count from anywhere.

    refs: part, file_key, byte_offset, byte_length, base_offset; files: file_key, content.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for part, base, raw in zip(pdf["part"].tolist(), pdf["base_offset"].tolist(), pdf["raw"], strict=True):
                raw, at = bytes(raw), 0
                for one in R.split(raw):
                    n = R.header(one)["count"]
                    out.append((part, base, base + n - 1, n, R.patch(one, base)))
                    base, at = base + n, at + len(one)
                if at != len(raw):
                    raise ValueError(f"partition {part}: a range ends inside a batch")
            yield pd.DataFrame(out, columns=["part", "first_offset", "last_offset", "record_count", "raw"])

    piece = F.expr("substring(content, cast(byte_offset AS int) + 1, cast(byte_length AS int))")
    return refs.join(files, "file_key").select("part", "base_offset", piece.alias("raw")).mapInPandas(run, _OUT)


def fetch(refs: DataFrame, files: DataFrame, requests: DataFrame, budget: int) -> DataFrame:
    """Whole batches of packed files from each request's offset (part, start_offset, head) on.

    A ref that ends above the committed head isn't read. Refs are chosen by their lengths before any bytes are.
    """
    open_refs = refs.join(small(requests), "part").where("end_offset > start_offset AND end_offset <= head")
    # the first ref may begin before the offset, and what it holds up to there doesn't count: its length is left out
    w = Window.partitionBy("part").orderBy("base_offset")
    ranked = open_refs.withColumn("rank", F.row_number().over(w)).withColumn("size", F.when(F.col("rank") > 1, F.col("byte_length")).otherwise(0))
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranked.withColumn("before", before).where(F.col("before") < budget)
    found = in_ranges(chosen, files).join(small(requests.select("part", "start_offset")), "part")
    found = found.where("last_offset >= start_offset").drop("start_offset").withColumn("nbytes", F.length("raw"))
    kept = byte_budget(found.select(*KEY, "nbytes"), "nbytes", budget, "first_offset", "part").select(*KEY)
    return found.join(kept, KEY)


@F.pandas_udf(BinaryType())
def concatenated(raws: pd.Series) -> pd.Series:
    """Arrays of byte strings, each as one."""
    return raws.map(lambda parts: b"".join(bytes(p) for p in parts))


def merged(sources: DataFrame, *by: str) -> DataFrame:
    """One object of each group, byte by byte in order of offsets; fails on a group with a hole.

    sources: base_offset, end_offset (inclusive), raw. A group is bounded by the planner's target size.
    """
    rows = sources.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("base_offset", "end_offset", "raw"))).alias("s"))
    holes = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda k: F.element_at("s", k + 1)["base_offset"] != F.element_at("s", k)["end_offset"] + 1)
    checked = F.when((F.size("s") > 1) & holes, F.raise_error(F.lit("sources of a merge aren't contiguous"))).otherwise(F.transform("s", lambda x: x["raw"]))
    return rows.select(*by, F.element_at("s", 1)["base_offset"].alias("base_offset"), F.element_at("s", -1)["end_offset"].alias("end_offset"), F.size("s").alias("n"), concatenated(checked).alias("raw"))


@F.pandas_udf(BooleanType())
def intact(raw: pd.Series) -> pd.Series:
    def one(x) -> bool:
        try:
            return R.valid(bytes(x))
        except R.DecodeError:
            return False

    return raw.map(one).astype("boolean")


def recovered(batches: DataFrame, ok: Callable[[str], Column] = intact) -> DataFrame:
    """Where each partition's log goes on after a crash: at its first damaged batch, or behind the last one."""
    seen = batches.select(*KEY, "last_offset", ok("raw").alias("ok"))
    bad = F.min(F.when(~F.col("ok"), F.col("first_offset")))
    return seen.groupBy("part").agg(F.coalesce(bad, F.max("last_offset") + 1).alias("next_offset"))
