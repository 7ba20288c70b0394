"""Deterministic log relations over the events table, for queries and their oracles.

Each relation is SQL in the dialect that Spark and DuckDB share; $DIV is integer division. ``relation`` gives it as a
DataFrame, ``with_clause`` as common table expressions for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = 4

_PARTED = """(SELECT *, cast(aggregate(transform(sequence(1, length(b)), i -> cast(conv(hex(substring(b, i, 1)), 16, 10) AS bigint)),
              2166136261L, (h, x) -> ((h ^ x) * 16777619L) & 4294967295L) % 4 AS int) AS part
      FROM (SELECT *, encode(cast(user_id AS string), 'utf-8') AS b FROM {events}))
"""

_SPARK_LOG = """
SELECT part, row_number() OVER (PARTITION BY part ORDER BY ts, event_id) - 1L AS record_offset,
       unix_millis(cast(ts AS timestamp)) AS record_timestamp, event_id, user_id, event_type, value, props,
       date_format(ts, 'yyyy-MM-dd') AS dt, hour(ts) AS hour, event_id % 97 + 1 AS nbytes
FROM """ + _PARTED

#: The same rows, numbered within hours from what came before them, so that no task orders a whole log partition.
_SPARK_LOG_BY_HOURS = (
    """
WITH parted AS (SELECT *, coalesce(part, -1) AS at_part, coalesce(unix_date(cast(ts AS date)) * 24 + hour(ts), -2147483648) AS at_hour FROM """
    + _PARTED
    + """),
     hours AS (SELECT at_part, at_hour, sum(n) OVER (PARTITION BY at_part ORDER BY at_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before
               FROM (SELECT at_part, at_hour, count(*) AS n FROM parted GROUP BY at_part, at_hour)),
     placed AS (SELECT *, row_number() OVER (PARTITION BY at_part, at_hour ORDER BY ts, event_id) AS nth FROM parted)
SELECT part, before + nth - 1L AS record_offset, unix_millis(cast(ts AS timestamp)) AS record_timestamp, event_id, user_id, event_type, value, props,
       date_format(ts, 'yyyy-MM-dd') AS dt, hour(ts) AS hour, event_id % 97 + 1 AS nbytes
FROM placed JOIN hours USING (at_part, at_hour)
"""
)

_DUCK_LOG = """
SELECT part, row_number() OVER (PARTITION BY part ORDER BY ts, event_id) - 1 AS record_offset,
       epoch_us(ts) // 1000 AS record_timestamp, event_id, user_id, event_type, value, props,
       strftime(ts, '%Y-%m-%d') AS dt, cast(hour(ts) AS int) AS hour, event_id % 97 + 1 AS nbytes
FROM (SELECT *, cast(list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(k::BLOB) + 1),
              lambda i: ('0x' || hex(array_slice(k::BLOB, i, i)))::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 4 AS int) AS part
      FROM (SELECT *, cast(user_id AS varchar) AS k FROM events))
"""

#: In order of dependence.
RELATIONS = {
    "gaps": "SELECT * FROM ev_log WHERE event_id % 10 <> 3",
    "ends": "SELECT part, max(record_offset) + 1 AS log_end, ((max(record_offset) + 1) * 4) $DIV 5 AS hw FROM ev_log GROUP BY part",
    "sources": "SELECT part, record_offset, event_id, value, 0 AS source_ord FROM ev_log UNION ALL SELECT part, record_offset, event_id, value + 1 AS value, 1 AS source_ord FROM ev_log WHERE event_id % 7 = 0",
    "segments": "SELECT part, min(record_offset) AS base_offset, max(record_offset) AS end_offset, min(record_timestamp) AS min_timestamp, max(record_timestamp) AS max_timestamp, (record_offset $DIV 100) $DIV 3 AS epoch, cast(count(*) AS bigint) AS record_count, cast(sum(nbytes) AS bigint) AS size_bytes, max(record_timestamp) AS created_ms FROM ev_log GROUP BY part, record_offset $DIV 100",
    "refs": "SELECT part, concat('f', cast((record_offset $DIV 50) $DIV 2 AS varchar(20)), '-', cast(part $DIV 2 AS varchar(20))) AS file_key, min(record_offset) AS base_offset, max(record_offset) + 1 AS end_offset, cast(sum(nbytes) AS bigint) AS byte_length, max(record_timestamp) AS created_ms FROM ev_log GROUP BY part, record_offset $DIV 50",
    "uploads": "SELECT DISTINCT file_key FROM refs UNION SELECT concat('x', cast(event_id AS varchar(20))) AS file_key FROM ev_log WHERE event_id % 211 = 0",
    "batches": "SELECT part, record_offset $DIV 10 AS batch_no, (record_offset $DIV 10) % 5 AS producer_id, cast(count(*) AS bigint) AS record_count, min(record_offset) AS first_offset, max(record_offset) AS last_offset, cast(sum(nbytes) AS bigint) AS nbytes, min(record_timestamp) AS first_timestamp, max(record_timestamp) AS max_timestamp FROM ev_log GROUP BY part, record_offset $DIV 10",
    "sent": "SELECT part, producer_id, batch_no * 2 AS arrival, cast(coalesce(sum(record_count) OVER (PARTITION BY part, producer_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS sequence, record_count FROM batches WHERE batch_no % 13 <> 6 UNION ALL SELECT part, producer_id, batch_no * 2 + 1 AS arrival, cast(coalesce(sum(record_count) OVER (PARTITION BY part, producer_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS sequence, record_count FROM batches WHERE batch_no % 7 = 3",
    "checkpoints": "SELECT part, (log_end * 3) $DIV 4 AS next_offset, part + 1 AS generation FROM ends",
    "files": "SELECT concat('data/dt=', dt, '/hour=', lpad(cast(hour AS varchar(4)), 2, '0'), '/', cast(part AS varchar(4)), '.parquet') AS file_path, dt, hour, cast(count(*) AS bigint) AS record_count, cast(sum(nbytes) AS bigint) AS file_size_bytes FROM ev_log GROUP BY dt, hour, part",
    "epochs": "SELECT part, epoch, min(base_offset) AS start_offset FROM segments GROUP BY part, epoch",
    "produced": "SELECT part, record_offset, concat('k', cast(event_id AS varchar(20))) AS op_key, record_timestamp AS op_time, user_id % 8 AS process, concat('n', cast(event_id % 3 AS varchar(4))) AS node, event_id % 11 <> 4 AS ok FROM ev_log",
    "drained": "SELECT part, record_offset, op_key, op_time FROM produced WHERE ok AND record_offset % 89 <> 7 UNION ALL SELECT part, record_offset, op_key, op_time FROM produced WHERE ok AND record_offset % 101 = 5 UNION ALL SELECT part, record_offset + 1000000 AS record_offset, concat(op_key, 'g') AS op_key, op_time FROM produced WHERE record_offset % 307 = 9",
    "windows": "SELECT event_type AS topic, part, record_timestamp $DIV 21600000 AS w, cast(count(*) AS bigint) AS produced, cast(sum(CASE WHEN event_id % 19 = 0 THEN 0 ELSE 1 END) AS bigint) AS consumed, cast(sum(CASE WHEN event_id % 53 = 0 THEN 1 ELSE 0 END) AS bigint) AS gaps, cast(sum(CASE WHEN event_id % 41 = 0 THEN 1 ELSE 0 END) AS bigint) AS seq_errors, cast(sum(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) AS bigint) AS decode_errors, min(record_timestamp) AS start_ms, max(record_timestamp) AS end_ms, concat('n', cast(part % 3 AS varchar(4))) AS node FROM ev_log GROUP BY event_type, part, record_timestamp $DIV 21600000",
    "commits": "SELECT concat('g', cast(user_id % 3 AS varchar(4))) AS grp, event_type AS topic, part, record_offset AS committed, ((event_id * 37) % 1009) * 1000000 + event_id AS commit_ord FROM ev_log WHERE event_id % 5 = 0",
    "observed": "SELECT part, event_id AS ord, user_id % 4 AS process, concat('n', cast(event_id % 3 AS varchar(4))) AS node, record_offset - (CASE WHEN event_id % 17 = 0 THEN 40 ELSE 0 END) AS hw FROM ev_log",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    found: set[str] = set()

    def add(name: str) -> None:
        if name in found or name == "ev_log":
            return
        for other in RELATIONS:
            if re.search(rf"\b{other}\b", RELATIONS[name]) and other != name and list(RELATIONS).index(other) < list(RELATIONS).index(name):
                add(other)
        found.add(name)

    for name in names:
        add(name)
    return [x for x in RELATIONS if x in found]


def _text(names: tuple[str, ...], log: str, div: str) -> str:
    parts = [("ev_log", log.strip())] + [(n, RELATIONS[n].replace("$DIV", div)) for n in _needed(names)]
    return ", ".join(f"{n} AS ({body})" for n, body in parts)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _over(spark, sf_dir, name, _SPARK_LOG)


def relation_by_hours(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same relation from a log that is dealt by partition and hour, for queries that do more than small steps with it."""
    return _over(spark, sf_dir, name, _SPARK_LOG_BY_HOURS)


def _over(spark: SparkSession, sf_dir: str, name: str, log: str) -> DataFrame:
    text = f"WITH {_text((name,), log, 'div')} SELECT * FROM {name}"
    # braces of the log's own text must not be taken for references
    return spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_clause(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_text(names, _DUCK_LOG, '//')}"
