"""Topic configurations: what is set, what is default, and which changes are allowed. All native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA, STORAGE, EXPORT = "tidelog.schema", "tidelog.storage.mode", "tidelog.export.enabled"
UNCLEAN, RETENTION, IN_SYNC, CLEANUP = "unclean.leader.election.enable", "retention.ms", "min.insync.replicas", "cleanup.policy"
#: A week of retention, one replica in sync.
DEFAULTS = {SCHEMA: None, STORAGE: "classic", EXPORT: "false", CLEANUP: "delete", IN_SYNC: "1", RETENTION: "604800000", UNCLEAN: "false"}
_TRUE, _FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def _map(pairs: dict):
    return F.create_map(*(F.lit(x).cast("string") for pair in pairs.items() for x in pair))


def describe(topics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Values of every topic, set or default; with ``names``, of these only, and unknown names give nothing.

    topics: topic, config (a map of what is set). Retention and replicas in sync always count as set.
    """
    rows = topics.select("topic", "config", F.explode(_map(DEFAULTS)).alias("name", "default"))
    if names:
        rows = rows.where(F.col("name").isin(names))
    value = F.coalesce(F.col("config")[F.col("name")], F.col("default"))
    return rows.select("topic", "name", value.alias("value"), (value.eqNullSafe(F.col("default")) & ~F.col("name").isin(IN_SYNC, RETENTION)).alias("is_default"))


def alter(topics: DataFrame, changes: DataFrame, reset: bool = False) -> DataFrame:
    """Topics with their new config and an error; a topic with any bad change keeps its config as it was.

    topics: topic, replicas, config. changes: topic, ord, name, op (set or delete), value; of several changes of one
    name the last counts. ``reset`` gives all that isn't named its default, but for the schema and the storage mode.
    The error is that of the first name in order; changes of unknown topics give no row.
    """
    last = changes.groupBy("topic", "name").agg(F.max_by(F.struct("op", "value"), "ord").alias("c"))
    last = last.select("topic", "name", F.col("c.op").alias("op"), F.when(F.col("c.op") == "set", F.col("c.value")).alias("value"))
    name, value = F.col("name"), F.col("value")
    number = F.when(value.rlike("^[+-]?[0-9]+$"), F.expr("try_cast(value AS bigint)"))
    error = (
        F.when(~F.col("op").isin("set", "delete"), F.format_string('unsupported incremental alter op for "%s"', name))
        .when(name == SCHEMA, F.lit(f"{SCHEMA} is immutable"))
        .when((name == STORAGE) & value.isNotNull() & ~value.isin("classic", "diskless"), F.lit(f"invalid {STORAGE}"))
        .when((name == STORAGE) & ~value.eqNullSafe(F.coalesce(F.col("config")[STORAGE], F.lit("classic"))), F.lit(f"{STORAGE} is immutable"))
        .when(name.isin(EXPORT, UNCLEAN) & ~value.isin(*_TRUE, *_FALSE), F.concat(F.lit("invalid "), name))
        .when((name == CLEANUP) & (value != "delete"), F.lit("only cleanup.policy=delete is supported"))
        .when(name == "retention.bytes", F.lit("retention.bytes is unsupported; use retention.ms (time-based retention only)"))
        .when((name == RETENTION) & value.isNotNull() & (number.isNull() | (number < 0)), F.lit(f"invalid {RETENTION}"))
        .when((name == IN_SYNC) & value.isNotNull() & (number.isNull() | ~number.between(1, F.col("replicas"))), F.lit(f"invalid {IN_SYNC}"))
        .when(~name.isin(list(DEFAULTS)), F.format_string('unsupported topic config "%s"', name))
    )
    plain = F.when(name.isin(EXPORT, UNCLEAN), value.isin(*_TRUE).cast("string")).when(name.isin(RETENTION, IN_SYNC), number.cast("string")).otherwise(value)
    judged = last.join(topics, "topic").select("topic", "name", error.alias("error"), plain.alias("value"))
    wanted = judged.groupBy("topic").agg(F.min_by("error", F.when(F.col("error").isNotNull(), name)).alias("error"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("wanted"))
    rows = topics.join(wanted, "topic", "left")
    kept = F.map_filter("config", lambda k, _: k.isin(SCHEMA, STORAGE) if reset else F.lit(True))
    kept = F.map_filter(kept, lambda k, _: ~F.coalesce(F.map_contains_key("wanted", k), F.lit(False)))
    new = F.map_concat(kept, F.coalesce(F.map_filter("wanted", lambda _, v: v.isNotNull()), F.expr("cast(map() AS map<string,string>)")))
    changed = F.col("error").isNull() & (F.col("wanted").isNotNull() | F.lit(reset))
    return rows.select("topic", "replicas", F.when(changed, new).otherwise(F.col("config")).alias("config"), "error")
