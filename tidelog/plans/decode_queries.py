"""Queries of typed decoding and record batches."""

from __future__ import annotations

from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import maintenance as M
from ..sources import recordbatch as R
from ..sources.values import Field, avro_schema, decoded, encode_avro, encode_protobuf, envelope
from .catalog import query
from .fixtures import relation as rel
from .fixtures import relation_by_hours as rel_by_hours
from .fixtures import with_clause as w

_FIELDS = [Field("id", "int64", "$.id"), Field("kind", "string", "$.event.kind"), Field("score", "float64", "$.score", True), Field("even", "bool", "$.even")]
_FLAT = [Field("id", "int64", "$.id"), Field("kind", "string", "$.kind"), Field("score", "float64", "$.score", True), Field("even", "bool", "$.even"), Field("at", "timestamp", "$.at")]


def _json_text():
    return F.concat(F.lit('{"id":'), F.expr("CASE event_id % 11 WHEN 0 THEN concat('\"', event_id, '\"') WHEN 5 THEN 'true' ELSE cast(event_id AS string) END"), F.lit(',"event":{"kind":"'), F.col("event_type"), F.lit('","more":[1,{"a":null}]},"score":'), F.expr("CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '1.5' END"), F.expr("CASE WHEN event_id % 13 = 7 THEN '' ELSE concat(',\"even\":', cast(event_id % 2 = 0 AS string)) END"), F.lit("}"), F.expr("CASE WHEN event_id % 17 = 9 THEN ' x' ELSE '' END"))


_ERROR = "CASE WHEN event_id % 11 = 0 THEN 'field \"id\" must be int64' WHEN event_id % 11 = 5 THEN 'field \"id\" must be bool' WHEN event_id % 17 = 9 THEN 'value has trailing data' WHEN event_id % 13 = 7 THEN 'required field \"even\" is missing' END"
_DECODED = f"SELECT *, {_ERROR} AS error FROM ev_log"


def _json_rows(spark, sf_dir):
    rows = rel_by_hours(spark, sf_dir, "ev_log").withColumn("v", decoded(F.encode(_json_text(), "utf-8"), "json", _FIELDS))
    return rows.select("part", "record_offset", "event_id", "v.*")


@query("decode_json", w("ev_log") + f"SELECT event_id, CASE WHEN error IS NULL THEN event_id END AS id, CASE WHEN error IS NULL THEN event_type END AS kind, CASE WHEN error IS NULL AND event_id % 3 <> 0 THEN 1.5::DOUBLE END AS score, CASE WHEN error IS NULL THEN event_id % 2 = 0 END AS even, error FROM ({_DECODED})")
def decode_json(spark, sf_dir):
    return _json_rows(spark, sf_dir).select("event_id", "id", "kind", "score", "even", "error")


@query("filter_schema_valid", w("ev_log") + f"SELECT event_id FROM ({_DECODED}) WHERE error IS NULL")
def filter_schema_valid(spark, sf_dir):
    return _json_rows(spark, sf_dir).where("error IS NULL").select("event_id")


@query("sink_dlq", w("ev_log") + f"SELECT part AS source_partition, record_offset AS source_offset, error, 'json' AS schema_encoding FROM ({_DECODED}) WHERE error IS NOT NULL")
def sink_dlq(spark, sf_dir):
    return _json_rows(spark, sf_dir).where("error IS NOT NULL").select(F.col("part").alias("source_partition"), F.col("record_offset").alias("source_offset"), "error", F.lit("json").alias("schema_encoding"))


@query("sink_dlq_group", w("ev_log") + f", d AS ({_DECODED}), c AS (SELECT *, CASE WHEN error IS NOT DISTINCT FROM lag(error) OVER (PARTITION BY part ORDER BY record_offset) THEN 0 ELSE 1 END AS ch FROM d), r AS (SELECT *, sum(ch) OVER (PARTITION BY part ORDER BY record_offset) AS run FROM c) SELECT part, error, min(record_offset) AS first, max(record_offset) AS last, cast(count(*) AS bigint) AS n FROM r WHERE error IS NOT NULL GROUP BY part, run, error")
def sink_dlq_group(spark, sf_dir):
    return M.error_islands(_json_rows(spark, sf_dir).select("part", "record_offset", "error"), "error", "record_offset", "part").where("error IS NOT NULL")


def _encoded(form: str):
    @F.pandas_udf("binary")
    def run(i: pd.Series, kind: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for n, k, t in zip(i.tolist(), kind.tolist(), at.tolist(), strict=True):
            values = {"id": n, "kind": k, "score": None if n % 3 == 0 else n / 2, "even": n % 2 == 0, "at": t * 10**6}
            out.append(envelope(7, encode_avro(values, _FLAT)) if form == "avro" else encode_protobuf(values, _FLAT))
        return pd.Series(out, dtype=object)

    return run("event_id", "event_type", "record_timestamp")


_BACK = "SELECT event_id, event_id AS id, event_type AS kind, CASE WHEN event_id % 3 <> 0 THEN event_id / 2.0::DOUBLE END AS score, event_id % 2 = 0 AS even, record_timestamp AS at_ms FROM ev_log"


@query("decode_avro", w("ev_log") + _BACK)
def decode_avro(spark, sf_dir):
    import json

    rows = rel_by_hours(spark, sf_dir, "ev_log").withColumn("raw", _encoded("avro"))
    rows = rows.withColumn("v", decoded(F.col("raw"), "avro", _FLAT, {7: json.dumps(avro_schema(_FLAT))}))
    return rows.select("event_id", "v.id", "v.kind", "v.score", "v.even", F.expr("v.at div 1000000").alias("at_ms"))


@query("decode_protobuf", w("ev_log") + _BACK)
def decode_protobuf(spark, sf_dir):
    rows = rel_by_hours(spark, sf_dir, "ev_log").withColumn("raw", _encoded("protobuf")).withColumn("v", decoded(F.col("raw"), "protobuf", _FLAT))
    return rows.select("event_id", "v.id", "v.kind", "v.score", "v.even", F.expr("v.at div 1000000").alias("at_ms"))


def batched(spark, sf_dir):
    """Batches of ten records of one partition, encoded with a codec by number."""
    names = ["part", "batch_no", "record_offset", "record_timestamp", "event_id", "event_type"]
    log = rel(spark, sf_dir, "ev_log").withColumn("batch_no", F.floor(F.col("record_offset") / 10)).select(*names)

    def pack(key, rows) -> tuple:
        rows = list(rows)
        records = [R.Record(t, str(i).encode() if i % 5 else None, k.encode(), {"h": b"1"} if i % 2 else {}) for _, _, _, t, i, k in rows]
        raw = R.encode(R.Batch(0, records, producer_id=key[1] % 5, sequence=key[1], codec=R.CODECS[key[1] % 5]))
        return *key, rows[0][2], rows[-1][2], R.patch(raw, rows[0][2])

    def run(pdfs):
        rows = chain.from_iterable(zip(*(pdf[c].tolist() for c in names), strict=True) for pdf in pdfs)
        packed = (pack(key, group) for key, group in groupby(rows, key=itemgetter(0, 1)))
        while some := list(islice(packed, 2000)):
            yield pd.DataFrame(some, columns=["part", "batch_no", "first_offset", "last_offset", "raw"])

    near = log.repartition("part", F.floor(F.col("batch_no") / 64)).sortWithinPartitions("part", "record_offset")
    return near.mapInPandas(run, "part int, batch_no long, first_offset long, last_offset long, raw binary")


#: Decoded records that are held at once.
_SLICE = 5000


@query("batch_decode", w("ev_log") + "SELECT part, record_offset, record_timestamp, CASE WHEN event_id % 5 <> 0 THEN cast(event_id AS varchar) END AS record_key, event_type AS record_value, cast(event_id % 2 AS int) AS headers FROM ev_log")
def batch_decode(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            records = ((part, r) for part, raw in zip(pdf["part"].tolist(), pdf["raw"], strict=True) for r in R.decode(bytes(raw)).records)
            rows = ((part, r.offset, r.timestamp, None if r.key is None else r.key.decode(), r.value.decode(), len(r.headers)) for part, r in records)
            # records of a frame's batches in slices: they are many times its rows
            while some := list(islice(rows, _SLICE)):
                yield pd.DataFrame(some, columns=["part", "record_offset", "record_timestamp", "record_key", "record_value", "headers"])

    return batched(spark, sf_dir).mapInPandas(run, "part int, record_offset long, record_timestamp long, record_key string, record_value string, headers int")


@query("kafka_produce_decode", w("batches") + "SELECT part, batch_no, producer_id, batch_no AS sequence, record_count FROM batches")
def kafka_produce_decode(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            found = [R.header(bytes(x)) for x in pdf["raw"]]
            yield pd.DataFrame({"part": pdf["part"], "batch_no": pdf["batch_no"], "producer_id": [h["producer_id"] for h in found], "sequence": [h["sequence"] for h in found], "record_count": [h["count"] for h in found]})

    return batched(spark, sf_dir).mapInPandas(run, "part int, batch_no long, producer_id long, sequence long, record_count long")


@query("batch_header", w("batches") + "SELECT part, batch_no, first_offset AS base_offset, record_count, producer_id FROM batches")
def batch_header(spark, sf_dir):
    """The header's fields by native expressions: big-endian numbers at fixed places."""
    number = lambda at, n: F.conv(F.hex(F.substring("raw", at, n)), 16, 10).cast("long")
    return batched(spark, sf_dir).select("part", "batch_no", number(1, 8).alias("base_offset"), number(58, 4).alias("record_count"), number(44, 8).alias("producer_id"))


@query("batch_crc", w("batches") + "SELECT part, batch_no, batch_no % 9 <> 4 AS ok FROM batches")
def batch_crc(spark, sf_dir):
    @F.pandas_udf("boolean")
    def ok(raw: pd.Series) -> pd.Series:
        return pd.Series([R.valid(bytes(x)) for x in raw], dtype="boolean")

    damaged = F.when(F.col("batch_no") % 9 == 4, F.concat("raw", F.unhex(F.lit("00")))).otherwise(F.col("raw"))
    return batched(spark, sf_dir).select("part", "batch_no", ok(damaged).alias("ok"))


@query("batch_patch", w("batches", "refs") + "SELECT b.part, b.batch_no, b.first_offset AS patched, b.first_offset + b.record_count - 1 AS last_record, cast(b.part + 3 AS bigint) AS epoch, true AS ok FROM batches b JOIN refs r ON b.part = r.part AND b.first_offset >= r.base_offset AND b.first_offset < r.end_offset")
def batch_patch(spark, sf_dir):
    """Stored batches get their ref's base and a running count as base offset, in their bytes, and are decoded again."""

    def run(batches):
        for pdf in batches:
            found = [R.header(bytes(x)) for x in pdf["raw"]]
            last = [R.decode(bytes(x)).records[-1].offset for x in pdf["raw"]]
            yield pd.DataFrame({"part": pdf["part"], "batch_no": pdf["batch_no"], "patched": [h["base_offset"] for h in found], "last_record": last, "epoch": [h["leader_epoch"] for h in found], "ok": [R.valid(bytes(x)) for x in pdf["raw"]]})

    b = rel(spark, sf_dir, "batches").withColumn("k", F.floor(F.col("first_offset") / 50))
    before = F.sum("record_count").over(Window.partitionBy("part", "k").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1))
    refs = rel(spark, sf_dir, "refs").select("part", F.floor(F.col("base_offset") / 50).alias("k"), F.col("base_offset").alias("base"))
    placed = b.withColumn("n", F.coalesce(before, F.lit(0).cast("long"))).join(refs, ["part", "k"]).select("part", "batch_no", (F.col("base") + F.col("n")).alias("base"))
    unplaced = batched(spark, sf_dir).withColumn("raw", S.patched_batch(F.col("raw"), F.lit(0), F.lit(-1)))
    raw = S.patched_batch(F.col("raw"), F.col("base"), F.col("part") + 3)
    return unplaced.join(placed, ["part", "batch_no"]).select("part", "batch_no", raw.alias("raw")).mapInPandas(run, "part int, batch_no long, patched long, last_record long, epoch long, ok boolean")


@query("batch_split", w("batches") + "SELECT part, cast(count(*) AS bigint) AS n, cast(sum(record_count) AS bigint) AS records FROM batches GROUP BY part")
def batch_split(spark, sf_dir):
    """Concatenations of up to ten batches, taken apart again."""

    def run(groups):
        for pdf in groups:
            parts = [[R.header(x)["count"] for x in R.split(bytes(raw))] for raw in pdf["raw"]]
            yield pd.DataFrame({"part": pdf["part"], "n": [len(p) for p in parts], "records": [sum(p) for p in parts]})

    joined = batched(spark, sf_dir).groupBy("part", F.floor(F.col("batch_no") / 10).alias("g")).agg(F.array_sort(F.collect_list(F.struct("batch_no", "raw"))).alias("b"))
    joined = joined.select("part", F.aggregate(F.transform("b", lambda x: x["raw"]), F.unhex(F.lit("")), lambda a, x: F.concat(a, x)).alias("raw"))
    return joined.mapInPandas(run, "part int, n long, records long").groupBy("part").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


# bytes of a number in groups of seven bits
_SIZE = "(length(bin({0})) + 6) // 7"
_SECONDS, _NANOS = "record_timestamp // 1000", "record_timestamp % 1000 * 1000000"
_STAMP = f"(2 + {_SIZE.format(_SECONDS)} + {_SIZE.format(_NANOS)})"


@query("encode_avro", w("ev_log") + f"SELECT event_id, cast(5 + {_SIZE.format('2 * event_id')} + {_SIZE.format('2 * octet_length(event_type::BLOB)')} + octet_length(event_type::BLOB) + 1 + CASE WHEN event_id % 3 <> 0 THEN 8 ELSE 0 END + 1 + {_SIZE.format('2 * record_timestamp')} AS bigint) AS nbytes, '0000000007' AS envelope FROM ev_log")
def encode_avro_rows(spark, sf_dir):
    """Each value's size as its types give it, behind the envelope with the schema's id."""
    rows = rel_by_hours(spark, sf_dir, "ev_log").withColumn("raw", _encoded("avro"))
    return rows.select("event_id", F.length("raw").cast("long").alias("nbytes"), F.hex(F.substring("raw", 1, 5)).alias("envelope"))


@query("encode_protobuf", w("ev_log") + f"SELECT event_id, cast(1 + {_SIZE.format('event_id')} + 1 + {_SIZE.format('octet_length(event_type::BLOB)')} + octet_length(event_type::BLOB) + CASE WHEN event_id % 3 <> 0 THEN 9 ELSE 0 END + 2 + 1 + {_SIZE.format(_STAMP)} + {_STAMP} AS bigint) AS nbytes, '08' AS first_tag FROM ev_log")
def encode_protobuf_rows(spark, sf_dir):
    rows = rel_by_hours(spark, sf_dir, "ev_log").withColumn("raw", _encoded("protobuf"))
    return rows.select("event_id", F.length("raw").cast("long").alias("nbytes"), F.hex(F.substring("raw", 1, 1)).alias("first_tag"))
