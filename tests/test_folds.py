"""Folds with a memory, row by row."""

from tidelog.operators import aggregate, fold, jobs, maintenance
from tidelog.streaming.state import fold_group


def verdicts(spark, rows, f):
    df = spark.createDataFrame([(0, 1, k, s, c) for k, (s, c) in enumerate(rows)], "part int, producer_id long, arrival long, sequence long, record_count long")
    return [r.verdict for r in f(df).orderBy("arrival").collect()]


def test_classic_sequence(spark):
    assert verdicts(spark, [(0, 2), (2, 3), (2, 3), (9, 1), (5, 1)], fold.classic_sequence) == ["accepted", "accepted", "duplicate", "gap", "accepted"]
    assert verdicts(spark, [(4, 1), (0, 1)], fold.classic_sequence) == ["gap", "accepted"]


def test_recent_sequence(spark):
    """Any first sequence; exact retries within the last five; then they are gaps."""
    assert verdicts(spark, [(7, 2), (9, 1), (7, 2), (7, 3), (12, 1), (10, 1)], fold.recent_sequence) == ["accepted", "accepted", "duplicate", "conflict", "gap", "accepted"]
    rows = [(k, 1) for k in range(6)] + [(0, 1), (1, 1)]
    assert verdicts(spark, rows, fold.recent_sequence)[-2:] == ["gap", "duplicate"]


def test_compaction_and_ranges(spark):
    rows = [(0, b, e, s) for b, e, s in ((0, 9, 10), (10, 19, 10), (20, 29, 90), (30, 39, 10), (50, 59, 10), (60, 69, 999), (70, 79, 10))]
    df = spark.createDataFrame(rows, "part int, base_offset long, end_offset long, size_bytes long")
    assert [r.run for r in fold.compaction_runs(df, 3, 100, 500).orderBy("base_offset").collect()] == [1, 1, 2, 2, 3, 0, 4]
    ranges = spark.createDataFrame([("f", 0, 4), ("f", 4, 4), ("f", 8, 4), ("f", 20, 4)], "file_key string, byte_offset long, byte_length long")
    assert [r.range_no for r in fold.coalesce_ranges(ranges, 8).orderBy("byte_offset").collect()] == [1, 1, 2, 3]


def test_buffers(spark):
    df = spark.createDataFrame([(0, k, at, n) for k, (at, n) in enumerate([(0, 5), (1, 5), (2, 1), (100, 1), (101, 20)])], "part int, k long, at long, n long")
    assert [r.flush for r in jobs.flushes(df, "k", "at", "n", 10, 50).orderBy("k").collect()] == [0, 0, 1, 2, 2]
    paced = [r.goes_at for r in jobs.paced(df.selectExpr("part", "k", "0L AS at"), "k", "at", 10, 2).orderBy("k").collect()]
    assert paced == [0, 0, 100, 200, 300]


def test_group():
    events = [("join", "b", 0), ("join", "a", 5), ("heartbeat", "b", 50), ("join", "a", 60)]
    assert fold_group(events, 100, 90) == {"generation": 2, "leader": "a", "members": ["a", "b"], "state": "Stable"}
    assert fold_group(events, 100, 155)["members"] == ["a"]
    assert fold_group([], 100, 0) == {"generation": 0, "leader": None, "members": [], "state": "Empty"}


def test_back_pressure(spark):
    """Each active part allows 10 bytes; more than 8 in one buffer flush it."""
    rows = [(0, 6), (0, 5), (1, 4), (1, 4), (0, 3), (2, 25), (0, 7), (1, 1)]
    df = spark.createDataFrame([("p", k, part, n) for k, (part, n) in enumerate(rows)], "producer string, k long, part int, nbytes long")
    got = [r.admitted for r in jobs.admitted(df, "producer", "k", "nbytes", 10, 8).orderBy("k").collect()]
    # 6; 11 refused; 6 + 4; 6 + 8; 9 + 8, so the first is flushed; 8 + 25 of 20 refused; 7 + 8; 7 + 9 flushes the second
    assert got == [True, False, True, True, True, False, True, True]


def test_replicated_assignment(spark):
    known = [("t", 0, ["a", "b"], "a", 4), ("t", 1, ["a", "x"], "x", 2), ("t", 2, ["x", "y"], "x", 7), ("t", 3, None, None, None), ("t", 4, ["b", "c"], "q", 1)]
    df = spark.createDataFrame(known, "topic string, part int, replicas array<string>, leader string, epoch long")
    active = spark.createDataFrame([("c",), ("a",), ("b",)], "instance string")
    got = {r.part: (r.replicas, r.leader, r.epoch) for r in maintenance.assign_replicated(df, active, 2).collect()}
    # 0 keeps; 1 falls to a and, with a replica away, is not balanced; 2 has nobody left: c, a; 3 is new: a, b; 4 is led by one of its own
    assert got == {0: (["a", "b"], "a", 4), 1: (["a", "x"], "a", 3), 2: (["c", "a"], "c", 8), 3: (["a", "b"], "b", 2), 4: (["b", "c"], "b", 1)}
    few = spark.createDataFrame([("z",)], "instance string")
    stay = {r.part: (r.replicas, r.leader, r.epoch) for r in maintenance.assign_replicated(df.where("part = 2"), few, 2).collect()}
    assert stay == {2: (["x", "y"], "x", 7)}


def test_offset_check_by_blocks(spark):
    offsets = [o for o in range(5, 40) if o not in (7, 8, 16, 17, 18, 30)] + [12, 12]
    df = spark.createDataFrame([(0, o) for o in offsets] + [(1, 3)], "part int, record_offset long")
    for block in (4096, 8, 1):
        got = {r.part: tuple(r)[1:] for r in aggregate.offset_check(df, 2, block).collect()}
        assert got == {0: (29, 5, 39, 6, [7, 16]), 1: (1, 3, 3, 0, [])}


def test_paced_as_a_bucket(spark):
    """The closed form against a bucket with its tokens counted."""
    import random
    from fractions import Fraction

    rng = random.Random(4)
    at = sorted(rng.randrange(400) for _ in range(60))
    for rate, burst in ((100, 1), (100, 7), (30, 3), (1500, 4)):
        tokens, last, want = Fraction(burst), Fraction(at[0]), []
        for t in at:
            now = max(Fraction(t), last)
            tokens = min(Fraction(burst), tokens + (now - last) * rate / 1000)
            wait = max(Fraction(0), (1 - tokens) * 1000 / rate)
            tokens, last = tokens + wait * rate / 1000 - 1, now + wait
            want.append(-(-last.numerator // last.denominator))
        df = spark.createDataFrame([(0, k, t) for k, t in enumerate(at)], "part int, k long, at long")
        assert [r.goes_at for r in jobs.paced(df, "k", "at", rate, burst).orderBy("k").collect()] == want
