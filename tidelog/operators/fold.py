"""Sequential folds over ordered keys, where a rejected row does not advance the state.

Rows are dealt by key and sorted within partitions; each task then streams its batches and keeps one state at a time,
so a key's rows never have to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[object, tuple], tuple[object, tuple]]


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], values: list[str], start: Callable[[], object], step: Step, added: str) -> DataFrame:
    """Columns ``keys + order + values`` and those that ``step`` adds. step(state, values) -> (state, added values)."""
    columns = list(dict.fromkeys([*keys, *order, *values]))
    names = [c.split()[0] for c in added.split(",")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    nk = len(keys)
    at = [columns.index(v) for v in values]

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:nk] != key:
                    key, state = row[:nk], start()
                state, more = step(state, tuple(row[k] for k in at))
                out.append((*row, *more))
            yield pd.DataFrame(out, columns=columns + names)

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {added}")


ACCEPTED, DUPLICATE, GAP, CONFLICT = "accepted", "duplicate", "gap", "conflict"


def classic_sequence(batches: DataFrame) -> DataFrame:
    """Verdict on each producer batch: the next sequence is accepted, a lower one a duplicate, a higher one a gap.

    A producer that is not known must start with 0.
    """

    def step(state, row):
        sequence, count = row
        if sequence == state:
            return state + count, (ACCEPTED,)
        return state, (DUPLICATE if sequence < state else GAP,)

    return ordered_fold(batches, ["part", "producer_id"], ["arrival"], ["sequence", "record_count"], lambda: 0, step, "verdict string")


def recent_sequence(batches: DataFrame, depth: int = 5) -> DataFrame:
    """The same with a memory of the last batches: any first sequence is accepted, an exact retry of one of the last
    ``depth`` is a duplicate, the same sequence with another count a conflict, anything else a gap."""

    def step(state, row):
        sequence, count = int(row[0]), int(row[1])
        following, recent = state
        for s, c in recent:
            if s == sequence:
                return state, (DUPLICATE if c == count else CONFLICT,)
        if following is not None and sequence != following:
            return state, (GAP,)
        return (sequence + count, (*recent, (sequence, count))[-depth:]), (ACCEPTED,)

    return ordered_fold(batches, ["part", "producer_id"], ["arrival"], ["sequence", "record_count"], lambda: (None, ()), step, "verdict string")


def compaction_runs(segments: DataFrame, most_segments: int, most_bytes: int, oversized: int) -> DataFrame:
    """Greedy runs of neighbouring segments: a hole, an oversized segment or a full run starts another.

    run numbers count from 1 in each partition; oversized segments have run 0 and are not merged.
    """

    def step(state, row):
        base, end, size = map(int, row)
        run, n, total, following = state
        if size > oversized:
            return (run, 0, 0, None), (0,)
        if n == 0 or base != following or n >= most_segments or total + size > most_bytes:
            run, n, total = run + 1, 0, 0
        return (run, n + 1, total + size, end + 1), (run,)

    return ordered_fold(segments, ["part"], ["base_offset"], ["base_offset", "end_offset", "size_bytes"], lambda: (0, 0, 0, None), step, "run int")


def coalesce_ranges(ranges: DataFrame, most_bytes: int) -> DataFrame:
    """Adjacent byte ranges merged up to ``most_bytes``; numbered from 1 in each file."""

    def step(state, row):
        begin, length = map(int, row)
        k, total, following = state
        if following != begin or total + length > most_bytes:
            k, total = k + 1, 0
        return (k, total + length, begin + length), (k,)

    return ordered_fold(ranges, ["file_key"], ["byte_offset"], ["byte_offset", "byte_length"], lambda: (0, 0, None), step, "range_no int")
