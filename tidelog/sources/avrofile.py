"""Avro object container files, for small metadata files: uncompressed, one schema, rows as dictionaries."""

from __future__ import annotations

import hashlib
import json
import struct

from .values import DecodeError, _Bytes, _zigzag

MAGIC = b"Obj\x01"


def _put(schema, value) -> bytes:
    if isinstance(schema, list):  # null, or the other branch
        k = schema.index("null") if value is None else next(n for n, s in enumerate(schema) if s != "null")
        return _zigzag(k) + _put(schema[k], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return b"".join(_put(f["type"], value.get(f["name"])) for f in schema["fields"])
    if kind == "array":
        body = b"".join(_put(schema["items"], v) for v in value)
        return (_zigzag(len(value)) + body if value else b"") + b"\0"
    if kind in ("int", "long"):
        return _zigzag(value)
    if kind in ("string", "bytes"):
        raw = value.encode() if kind == "string" else value
        return _zigzag(len(raw)) + raw
    if kind == "boolean":
        return b"\x01" if value else b"\0"
    if kind == "double":
        return struct.pack("<d", value)
    if kind == "null":
        return b""
    raise ValueError(f"no Avro type of metadata: {kind}")


def _get(schema, b: _Bytes):
    if isinstance(schema, list):
        return _get(schema[b.zigzag()], b)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return {f["name"]: _get(f["type"], b) for f in schema["fields"]}
    if kind == "array":
        out = []
        while n := b.zigzag():
            if n < 0:
                b.zigzag()
            out += [_get(schema["items"], b) for _ in range(abs(n))]
        return out
    if kind in ("int", "long"):
        return b.zigzag()
    if kind in ("string", "bytes"):
        raw = bytes(b.take(b.zigzag()))
        return raw.decode() if kind == "string" else raw
    if kind == "boolean":
        return b.take(1) == b"\x01"
    if kind == "double":
        return struct.unpack("<d", b.take(8))[0]
    if kind == "null":
        return None
    raise DecodeError(f"no Avro type of metadata: {kind}")


def write(schema: dict, rows: list[dict], meta: dict[str, str] | None = None) -> bytes:
    """The same rows give the same bytes."""
    meta = {"avro.schema": json.dumps(schema), "avro.codec": "null"} | (meta or {})
    head = MAGIC + _zigzag(len(meta)) + b"".join(_put("string", k) + _put("bytes", v.encode()) for k, v in meta.items()) + b"\0"
    body = b"".join(_put(schema, r) for r in rows)
    sync = hashlib.sha256(head + body).digest()[:16]
    return head + sync + (_zigzag(len(rows)) + _zigzag(len(body)) + body + sync if rows else b"")


def read(raw: bytes) -> tuple[dict[str, str], list[dict]]:
    if raw[:4] != MAGIC:
        raise DecodeError("not an Avro file")
    b, meta = _Bytes(raw[4:]), {}
    while n := b.zigzag():
        if n < 0:
            b.zigzag()
        for _ in range(abs(n)):
            name = _get("string", b)
            meta[name] = _get("bytes", b).decode()
    if meta.get("avro.codec", "null") != "null":
        raise DecodeError(f"codec {meta['avro.codec']}")
    schema, sync, rows = json.loads(meta["avro.schema"]), b.take(16), []
    while b.at < len(raw) - 4:
        n, _ = b.zigzag(), b.zigzag()
        rows += [_get(schema, b) for _ in range(n)]
        if b.take(16) != sync:
            raise DecodeError("an Avro block ends elsewhere")
    return meta, rows
