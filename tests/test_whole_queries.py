"""Lookups over all rows, against plain Python beside their SQL."""

import os
from bisect import bisect_left

import pytest

from tidelog.plans import catalog
from tidelog.plans.fixtures import relation as rel

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _run(spark, name):
    return catalog.queries()[name](spark, DATA).collect()


def test_all_faults(spark):
    rows = rel(spark, DATA, "produced").collect()
    want = {}
    for node in {r.node for r in rows}:
        good = sorted(r.op_time for r in rows if r.ok and r.node == node)
        faults = [r.op_time for r in rows if not r.ok and r.node == node]
        times = [good[k] - t for t in faults for k in [bisect_left(good, t)] if k < len(good)]
        if times:
            want[node] = (min(times), max(times), pytest.approx(sum(times) / len(times)))
    assert {r.node: (r.shortest, r.longest, r.mean) for r in _run(spark, "asof_recovery_time")} == want


def test_all_keys(spark):
    rows = rel(spark, DATA, "ev_log").collect()
    want = sorted((r.event_id, -1 if r.event_id % 5 == 0 else r.record_timestamp) for r in rows)
    assert sorted((r.event_id, -1 if r.upload_ms is None else r.upload_ms) for r in _run(spark, "flush_key_parse")) == want


def test_all_lookups(spark):
    segments = rel(spark, DATA, "segments").collect()
    want = []
    for r in rel(spark, DATA, "ev_log").collect():
        want += [(r.part, r.record_offset, s.base_offset, s.end_offset) for s in segments if s.part == r.part and s.base_offset <= r.record_offset <= s.end_offset]
    assert sorted(map(tuple, _run(spark, "index_lookup"))) == sorted(want)
