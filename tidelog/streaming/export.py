"""Streaming export: typed decode, dead letters first, Parquet by dt and hour, one snapshot a batch, checkpoint last."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.table import ExportTable
from ..sources.values import Field, decoded

#: Poll intervals of a running export: while there is data, and while there is none.
ACTIVE, IDLE = "200 milliseconds", "2 seconds"


def export_batch(rows: DataFrame, batch_id: int, table: ExportTable, fields: list[Field], encoding: str = "json", dead_letters: str | None = None) -> None:
    """One batch: what the table's checkpoint has not passed yet, however the stream cuts its batches.

    ``rows``: part, record_offset, record_timestamp, key, value, headers. Rows that fail go to ``dead_letters`` before
    anything is committed, or are skipped where there is none; the checkpoint passes them either way. The batch is
    known by its offset ranges. Each attempt writes a directory of its own and never overwrites files; the commit is
    refused if another writer has moved the checkpoint on, and a directory that was not committed is deleted.
    """
    done = table.metadata()["checkpoint"]
    if done:
        passed = F.create_map(*[x for p, n in done.items() for x in (F.lit(int(p)), F.lit(int(n)))])  # an entry for each partition
        rows = rows.where(F.col("record_offset") >= F.coalesce(F.try_element_at(passed, F.col("part")), F.lit(0)))
    rows = rows.withColumn("_v", decoded(F.col("value"), encoding, fields)).persist()
    try:
        marks = rows.groupBy("part").agg(F.min("record_offset").alias("first"), F.max("record_offset").alias("last"), F.count_if(F.col("_v.error").isNull()).alias("n")).orderBy("part").collect()  # a row for each partition
        if not marks:
            return
        batch = ";".join(f"{r.part}:{r['first']}-{r['last']}" for r in marks)
        name = hashlib.sha256(batch.encode()).hexdigest()[:32]
        if dead_letters:
            bad = rows.where("_v.error IS NOT NULL").select("part", "record_offset", F.base64("key").alias("original_key"), F.base64("value").alias("original_value"), F.col("_v.error").alias("error"), F.lit(encoding).alias("schema_encoding"))
            bad.write.mode("overwrite").parquet(f"{dead_letters}/batch={name}")
        good = rows.where("_v.error IS NULL")
        ms = F.col("record_timestamp")
        out = good.select("record_offset", "record_timestamp", F.coalesce("key", F.unhex(F.lit(""))).alias("key"), "value", S.headers_json(F.col("headers")).alias("headers"), *[F.col(f"_v.{f.name}").alias(f.name) for f in fields], S.bucket_dt(ms).alias("dt"), S.bucket_hour(ms).alias("hour"))
        directory = f"data/{name}/{uuid.uuid4().hex}"
        # hours of any size in files of a good size: small ones together, large ones split
        out.hint("rebalance", "dt", "hour").write.mode("errorifexists").partitionBy("dt", "hour").parquet(f"{table.root}/{directory}")
        try:
            table.commit(directory, sum(r.n for r in marks), {str(r.part): r["last"] + 1 for r in marks}, batch, done)
        finally:
            if all(s["directory"] != directory for s in table.metadata()["snapshots"]):
                table.store.delete(directory)
    finally:
        rows.unpersist()


def start(stream: DataFrame, table: ExportTable, fields: list[Field], checkpoint: str, encoding: str = "json", dead_letters: str | None = None, once: bool = True):
    """Run the export: over what is there now, or until it is stopped."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, k: export_batch(rows, k, table, fields, encoding, dead_letters))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=ACTIVE)).start()
