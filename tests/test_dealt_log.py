"""Logs dealt by hours and by blocks of offsets: the same rows, and no task with a whole log partition."""

import glob
import os
import uuid
from datetime import datetime

import pytest

from tidelog.plans import fixtures, stream_queries
from tidelog.sources.store import shared_dir

DATA = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["ev_log", "sent"])
def test_same_rows(spark, name):
    assert _rows(fixtures.relation_by_hours(spark, DATA, name)) == _rows(fixtures.relation(spark, DATA, name))


def test_odd_times(spark, tmp_path):
    """Times before 1970, equal times, and rows without a time or user."""
    at = [None, datetime(1969, 12, 31, 23, 59), datetime(1970, 1, 1), datetime(1970, 1, 1), datetime(2024, 3, 31, 2, 30), datetime(2024, 3, 31, 3, 0)]
    rows = [(k, at[k * 5 % 6], k % 3 or None, "view", 1.0, "{}") for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert _rows(fixtures.relation_by_hours(spark, str(tmp_path), "ev_log")) == _rows(fixtures.relation(spark, str(tmp_path), "ev_log"))


def test_log_files_hold_blocks(spark, monkeypatch):
    """Each file has whole blocks, not whole partitions; the first files have the lower half of the offsets."""
    monkeypatch.setattr(stream_queries, "_BLOCK", 20)
    root = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        stream_queries._log_files(spark, DATA, root)
    finally:
        spark.conf.unset(conf)
    files = sorted(glob.glob(f"{root.removeprefix('file://')}/log/part-*.parquet"), key=os.path.getmtime)
    assert len(files) == 8
    found = [spark.read.parquet(f).select("part", "record_offset").collect() for f in files]
    whole = {p: sum(r.part == p for f in found for r in f) for p in range(4)}
    assert all(sum(r.part == p for r in f) < whole[p] * 3 // 4 for f in found for p in range(4) if whole[p] > 100)
    assert max(r.record_offset for f in found[:4] for r in f) < min(r.record_offset for f in found[4:] for r in f)
