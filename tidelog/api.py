"""LogEngine: topics that are written and read as DataFrames.

A topic's records are Parquet below ``<root>/topics/<name>``. A write puts its files first and then commits them by
creating the next document of the topic's commit log; readers see committed files only, and two writers can't both
create one document. Offsets are dense in each partition, given in arrival order behind the last commit.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import maintenance, scan
from .sources.store import Conflict, Store
from .sources.table import TRIES, ExportTable
from .sources.values import Field, decoded
from .sources.workers import make_importable
from .streaming import export

LOG_SCHEMA = "part int, record_offset long, record_timestamp long, key binary, value binary, headers map<string,string>"
RECENT = 5


class UnknownTopic(KeyError):
    pass


class SequenceGap(ValueError):
    pass


class SequenceConflict(ValueError):
    """A retry under a known sequence with another number of records."""


class SchemaInvalid(ValueError):
    pass


class LogEngine:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        make_importable(spark)
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.store = Store(spark, root)

    # topics

    def create_topic(self, name: str, partitions: int = 1, encoding: str | None = None, fields: list[Field] | None = None, dead_letters: str | None = None) -> None:
        """Create if absent; the same definition again is fine, another is a conflict."""
        spec = [vars(f) for f in fields or []]
        if spec:
            rows = self.spark.createDataFrame([(name, f["name"], f["type"], f["path"]) for f in spec], "topic string, name string, type string, path string")
            bad = maintenance.invalid_fields(rows).collect()
            if bad or encoding not in ("json", "avro", "protobuf"):
                raise SchemaInvalid(f"{name}: {[(r.name, r.reason) for r in bad] or encoding}")
        self.store.create(f"catalog/{safe_name(name)}.json", {"name": name, "partitions": partitions, "encoding": encoding, "fields": spec, "dead_letters": dead_letters})

    def topics(self) -> list[str]:
        return [self.store.read(f"catalog/{n}")["name"] for n in self.store.names("catalog")]

    def delete_topic(self, name: str) -> None:
        """The catalog entry goes first, so nobody finds a half-deleted topic."""
        self._topic(name)
        self.store.delete(f"catalog/{safe_name(name)}.json")
        self.store.delete(f"topics/{safe_name(name)}")

    def _topic(self, name: str) -> dict:
        path = f"catalog/{safe_name(name)}.json"
        if not self.store.exists(path):
            raise UnknownTopic(name)
        return self.store.read(path)

    def _home(self, name: str) -> str:
        return f"topics/{safe_name(name)}"

    def _head(self, name: str) -> tuple[int, dict]:
        names = self.store.names(f"{self._home(name)}/commits")
        if not names:
            return 0, {"ends": {}, "starts": {}, "data": [], "producers": {}}
        return int(names[-1][:-5]), self.store.read(f"{self._home(name)}/commits/{names[-1]}")

    # writes

    def produce(self, name: str, rows: DataFrame, order: list[str], producer_id: int | None = None, sequence: int | None = None) -> dict[int, tuple[int, int]]:
        """Append ``rows`` (key, value; timestamp and headers if given) and return each partition's offset range.

        Keys choose the partition; rows without one go round robin, by their number of arrival in the topic. A producer
        that repeats one of its last batches gets the range of the first time; with another number of records it is a
        conflict. Values of a typed topic must decode.
        """
        topic = self._topic(name)
        for c, kind in (("timestamp", "long"), ("headers", "map<string,string>")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        if topic["fields"]:
            v = decoded(F.col("value"), topic["encoding"], [Field(**f) for f in topic["fields"]])
            bad = rows.select(v.alias("v")).where("v.error IS NOT NULL").select("v.error").limit(1).collect()
            if bad:
                raise SchemaInvalid(bad[0].error)
        key = F.when(F.length("key") > 0, F.col("key"))
        rows = rows.withColumn("key", key).withColumn("record_timestamp", F.coalesce("timestamp", F.lit(self.clock())))
        directory, incoming = (f"{self._home(name)}/{kind}/{uuid.uuid4().hex}" for kind in ("data", "incoming"))
        keyless = rows.where("key IS NULL")
        count = 0 if keyless.isEmpty() else keyless.count()
        if count:
            keyless = maintenance.numbered(keyless, order, f"{self.root}/{incoming}")
        try:
            return self._append(name, topic, rows, keyless, count, order, directory, producer_id, sequence)
        finally:
            self.store.delete(incoming)

    def _append(self, name: str, topic: dict, rows: DataFrame, keyless: DataFrame, count: int, order: list[str], directory: str, producer_id: int | None, sequence: int | None) -> dict[int, tuple[int, int]]:
        n = topic["partitions"]
        for _ in range(TRIES):
            number, head = self._head(name)
            routed = rows.where("key IS NOT NULL").withColumn("part", S.route_partition(F.col("key"), n))
            if count:
                part = F.pmod(F.col("arrival") + head.get("arrivals", 0), F.lit(n)).cast("int")
                routed = routed.unionByName(keyless.withColumn("part", part).drop("arrival"))
            known = head["producers"].get(str(producer_id), [])
            for s, size, ranges in known:
                if producer_id is not None and s == sequence:
                    if (got := rows.count()) != size:
                        raise SequenceConflict(f"producer {producer_id}: sequence {sequence} had {size} records, not {got}")
                    return {int(p): tuple(r) for p, r in ranges.items()}
            if producer_id is not None and known and sequence != known[-1][0] + known[-1][1]:
                raise SequenceGap(f"producer {producer_id}: sequence {sequence} after {known[-1][0] + known[-1][1]}")
            heads = self.spark.createDataFrame([(int(p), n) for p, n in head["ends"].items()], "part int, next_offset long")
            placed = maintenance.assign_offsets(routed, heads, order).withColumn("record_offset", F.col("assigned"))
            placed.select("part", "record_offset", "record_timestamp", "key", "value", "headers").sortWithinPartitions("part", "record_offset").write.mode("overwrite").parquet(f"{self.root}/{directory}")
            written = self.spark.read.parquet(f"{self.root}/{directory}").groupBy("part").agg(F.min("record_offset").alias("lo"), F.max("record_offset").alias("hi"), F.count("*").alias("n")).collect()
            ranges = {str(r.part): [r.lo, r.hi] for r in written}
            new = head | {"ends": head["ends"] | {p: r[1] + 1 for p, r in ranges.items()}, "data": head["data"] + [{"dir": directory, "ranges": ranges, "at": self.clock()}], "arrivals": head.get("arrivals", 0) + count}
            if producer_id is not None:
                new["producers"] = head["producers"] | {str(producer_id): (known + [[sequence, sum(r.n for r in written), ranges]])[-RECENT:]}
            try:
                self.store.create(f"{self._home(name)}/commits/{number + 1:012d}.json", new)
                return {int(p): tuple(r) for p, r in ranges.items()}
            except Conflict:
                continue
        raise Conflict(name)

    # reads

    def log(self, name: str) -> DataFrame:
        """All committed records; files that can't hold a wanted offset are pruned by their statistics."""
        self._topic(name)
        found = [f"{self.root}/{d['dir']}" for d in self._head(name)[1]["data"]]
        if not found:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(*found)

    def consume(self, name: str, part: int, offset: int, limit: int | None = None) -> DataFrame:
        end = self._head(name)[1]["ends"].get(str(part), 0)
        return scan.read_committed(self.log(name), part, offset, end, scan.http_limit(limit))

    def list_offsets(self, name: str, at: int = scan.LATEST) -> dict[int, int]:
        """Earliest, latest, or the first offset at or after a time; -1 where there is none."""
        head, parts = self._head(name)[1], range(self._topic(name)["partitions"])
        if at in (scan.LATEST, scan.LATEST_TIERED):
            return {p: head["ends"].get(str(p), 0) for p in parts}
        if at == scan.EARLIEST:
            return {p: head["starts"].get(str(p), 0) for p in parts}
        found = {r.part: r.record_offset for r in scan.seek_timestamp(self.log(name), at).collect()}
        return {p: found.get(p, -1) for p in parts}

    # consumer groups

    def commit_offsets(self, group: str, offsets: dict[str, dict[int, int]]) -> None:
        """Merged over what is there; the last write wins."""
        folder = f"groups/{safe_name(group)}"
        for _ in range(TRIES):
            names = self.store.names(folder)
            old = self.store.read(f"{folder}/{names[-1]}") if names else {}
            new = {t: old.get(t, {}) | {str(p): o for p, o in offsets.get(t, {}).items()} for t in {*old, *offsets}}
            try:
                self.store.create(f"{folder}/{len(names) + 1:012d}.json", new)
                return
            except Conflict:
                continue
        raise Conflict(group)

    def offsets(self, group: str) -> dict[str, dict[int, int]]:
        names = self.store.names(f"groups/{safe_name(group)}")
        found = self.store.read(f"groups/{safe_name(group)}/{names[-1]}") if names else {}
        return {t: {int(p): o for p, o in v.items()} for t, v in found.items()}

    # export and maintenance

    def table(self, name: str) -> ExportTable:
        return ExportTable(self.spark, f"{self.root}/exports/{safe_name(name)}")

    def export(self, name: str) -> str | None:
        """Export what is new since the table's checkpoint as one snapshot; nothing new, nothing done."""
        topic, table = self._topic(name), self.table(name)
        fields = [Field(**f) for f in topic["fields"]]
        if fields:
            table.ensure_schema([{"name": f.name, "type": f.type} for f in fields], 1)
        done = table.metadata()["checkpoint"]
        marks = self.spark.createDataFrame([(int(p), n) for p, n in done.items()], "p int, next_offset long")
        rows = self.log(name).join(marks, F.col("part") == F.col("p"), "left").where(F.col("record_offset") >= F.coalesce("next_offset", F.lit(0))).drop("p", "next_offset")
        if rows.isEmpty():
            return None
        number = len(table.metadata()["snapshots"])
        letters = f"{self.root}/{self._home(topic['dead_letters'])}/letters" if topic["dead_letters"] else None
        export.export_batch(rows, number, table, fields, topic["encoding"] or "json", letters)
        return table.metadata()["snapshots"][-1]["id"]

    def expire(self, name: str, retention_ms: int) -> int:
        """Drop the oldest writes whose records are all past retention and, where the topic is exported, exported."""
        number, head = self._head(name)
        cutoff, done = self.clock() - retention_ms, self.table(name).metadata()["checkpoint"] if self._topic(name)["fields"] else None
        keep = list(head["data"])
        starts = dict(head["starts"])
        while keep and keep[0]["at"] <= cutoff and (done is None or all(r[1] < done.get(p, 0) for p, r in keep[0]["ranges"].items())):
            for p, r in keep.pop(0)["ranges"].items():
                starts[p] = r[1] + 1
        gone = head["data"][: len(head["data"]) - len(keep)]
        if gone:
            self.store.create(f"{self._home(name)}/commits/{number + 1:012d}.json", head | {"data": keep, "starts": starts})
            for d in gone:
                self.store.delete(d["dir"])
        return len(gone)

    def compact(self, name: str, files: int = 1) -> None:
        """Rewrite all committed files as few sorted ones; records and offsets stay, the swap is one commit."""
        number, head = self._head(name)
        if len(head["data"]) < 2:
            return
        directory = f"{self._home(name)}/data/{uuid.uuid4().hex}"
        self.log(name).repartitionByRange(files, "part", "record_offset").sortWithinPartitions("part", "record_offset").write.parquet(f"{self.root}/{directory}")
        ranges: dict[str, list[int]] = {}
        for d in head["data"]:
            for p, (lo, hi) in d["ranges"].items():
                old = ranges.get(p, [lo, hi])
                ranges[p] = [min(lo, old[0]), max(hi, old[1])]
        # the newest source's time, so a merged file does not live longer than its records
        self.store.create(f"{self._home(name)}/commits/{number + 1:012d}.json", head | {"data": [{"dir": directory, "ranges": ranges, "at": max(d["at"] for d in head["data"])}]})
        for d in head["data"]:
            self.store.delete(d["dir"])


def safe_name(name: str) -> str:
    """A name as a path component, injectively."""
    if not name or name in (".", ".."):
        raise ValueError(f"not a name: {name!r}")
    return name.replace("_", "__").replace("/", "_")
