"""Scalar functions of the log model, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: RFC 3339 with a zone; fractions up to nanoseconds.
RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
_MIN_NS, _MAX_NS = "-9223372036854775808", "9223372036854775807"


def fnv1a32(data: Column) -> Column:
    """FNV-1a of the bytes, 32 bits, as a long."""
    octets = F.transform(F.sequence(F.lit(1), F.length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    hashed = F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.when(F.length(data) == 0, F.lit(2166136261).cast("long")).otherwise(hashed)


def route_partition(key: Column, partitions: int, arrival: Column | None = None) -> Column:
    """Partition of a key; null (or empty) keys go round robin in ``arrival`` order, which must number them from 0."""
    hashed = (fnv1a32(key) % partitions).cast("int")
    if arrival is None:
        return hashed
    return F.when(key.isNull() | (F.length(key) == 0), (arrival % partitions).cast("int")).otherwise(hashed)


def hash_producer_id(name: Column) -> Column:
    """The first eight bytes of the SHA-256, top bit cleared."""
    top = F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (top % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def export_file_id(topic: Column, part: Column, dt: Column, hour: Column, base: Column, end: Column, version: Column, source: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", topic, part, dt, hour, base, end, version, source), 256), 1, 32)


def export_data_file_key(topic: Column, dt: Column, hour: Column, file_id: Column) -> Column:
    return F.concat(topic, F.lit("/data/dt="), dt, F.lit("/hour="), F.lpad(hour.cast("string"), 2, "0"), F.lit("/"), file_id, F.lit(".parquet"))


def sanitize_name(topic: Column) -> Column:
    """Injective: underscores double, slashes become one underscore."""
    return F.replace(F.replace(topic, F.lit("_"), F.lit("__")), F.lit("/"), F.lit("_"))


def sanitize_merge_topic(topic: Column) -> Column:
    return F.replace(topic, F.lit("/"), F.lit("_"))


def segment_key(topic: Column, part: Column, base: Column, end: Column, epoch: Column) -> Column:
    return F.concat(topic, F.lit("/"), part.cast("string"), F.lit("/"), F.lpad(base.cast("string"), 20, "0"), F.lit("-"), end.cast("string"), F.lit("-"), epoch.cast("string"), F.lit(".segment"))


_SEGMENT = r"^(.+)/(\d+)/(\d{20})-(\d+)-(\d+)\.segment$"


def parse_segment_key(key: Column) -> Column:
    """A struct of the key's parts; null if it isn't one."""
    part = lambda k: F.regexp_extract(key, _SEGMENT, k)
    fields = F.struct(part(1).alias("topic"), part(2).try_cast("int").alias("part"), part(3).try_cast("long").alias("base_offset"), part(4).try_cast("long").alias("end_offset"), part(5).try_cast("long").alias("epoch"))
    return F.when(F.regexp_like(key, F.lit(_SEGMENT)), fields)


def flush_upload_ms(key: Column) -> Column:
    """Upload time in {node}-{ms}-{seq}.data; the node may hold hyphens."""
    return F.regexp_extract(key, r"-([0-9]+)-[^-]+\.data$", 1).try_cast("long")


def parse_partition_key(key: Column) -> Column:
    return F.struct(F.regexp_extract(key, r"^(.*)#([0-9]+)$", 1).alias("topic"), F.regexp_extract(key, r"^(.*)#([0-9]+)$", 2).try_cast("int").alias("part"))


def normalize_ts_ms(ts: Column) -> Column:
    return F.when(ts > 10**15, F.floor(ts / F.lit(1000000).cast("decimal(20,0)")).cast("long")).otherwise(ts)


def bucket_dt(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def bucket_hour(ms: Column) -> Column:
    return F.hour(F.timestamp_millis(ms))


def ingest_ms(created: Column, record: Column) -> Column:
    return F.coalesce(created, record, F.lit(0).cast("long"))


def utf8_or_base64(value: Column) -> Column:
    return F.coalesce(F.try_validate_utf8(value.cast("string")), F.base64(value))


def typed_value_bytes(value: Column, encoding: Column) -> Column:
    """Bytes of a value given as text: Base64 for binary encodings, null if it isn't."""
    return F.when(encoding.isin("avro", "protobuf"), F.try_to_binary(value, F.lit("base64"))).otherwise(F.encode(value, "utf-8"))


def headers_json(headers: Column) -> Column:
    return F.when(headers.isNull() | (F.size(headers) == 0), "").otherwise(F.to_json(headers))


def envelope_wrap(schema_id: Column, value: Column) -> Column:
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(schema_id), 8, "0")), value)


def envelope_unwrap(data: Column) -> Column:
    """schema_id and payload; null if there is no envelope."""
    ok = (F.length(data) >= 5) & (F.hex(F.substring(data, 1, 1)) == "00")
    return F.when(ok, F.struct(F.conv(F.hex(F.substring(data, 2, 4)), 16, 10).cast("long").alias("schema_id"), F.substring(data, F.lit(6), F.length(data)).alias("payload")))


def parse_timestamp_us(text: Column) -> Column:
    """Microseconds of an RFC 3339 instant that int64 nanoseconds can hold; null otherwise."""
    ok = F.regexp_like(text, F.lit(RFC3339))
    us = F.unix_micros(F.try_to_timestamp(F.when(ok, F.regexp_replace(text, r"(\.\d{6})\d+", "$1"))))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 9, "0")
    below = F.when(fraction == "", 0).otherwise(F.substring(fraction, 7, 3).cast("int"))
    ns = us.cast("decimal(38,0)") * 1000 + below
    return F.when(ok & (ns >= F.lit(_MIN_NS).cast("decimal(38,0)")) & (ns <= F.lit(_MAX_NS).cast("decimal(38,0)")), us)


def sse_event(offset: Column, data: Column) -> Column:
    return F.format_string("id: %d\ndata: %s\n\n", offset, data)


def parse_byte_size(text: Column) -> Column:
    """1GiB, 64MB, 512 and so on, in bytes; null if it isn't a size."""
    pattern = r"^\s*([0-9]+)\s*([KMGT]?i?B?)\s*$"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("long"), F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(None).cast("long")
    for k, letter in enumerate("kmgt", 1):
        factor = F.when(unit.isin(letter + "b", letter), F.lit(1000**k)).when(unit == letter + "ib", F.lit(1024**k)).otherwise(factor)
    factor = F.when(unit.isin("", "b"), F.lit(1).cast("long")).otherwise(factor)
    return F.when(F.regexp_like(text, F.lit(pattern)), number * factor)


def key_component_ok(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[^/\\\x00-\x1F\x7F]+$")) & ~name.isin(".", "..")


def arrival_number(order: str, *parts: str) -> Column:
    return (F.row_number().over(Window.partitionBy(*parts).orderBy(order)) - 1).cast("long")


def patched_batch(raw: Column, base_offset: Column, leader_epoch: Column) -> Column:
    """A record batch with another base offset and leader epoch: bytes 0 to 7 and 12 to 15, which no checksum covers."""
    wide = lambda n: F.lpad(F.hex(n.cast("long")), 16, "0")
    rest = F.substring(raw, F.lit(17), F.length(raw))
    return F.concat(F.unhex(wide(base_offset)), F.substring(raw, 9, 4), F.unhex(F.substring(wide(leader_epoch), 9, 8)), rest)
