"""Retention, compaction, references, epochs and assignments, as plans over metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .small import small

from .fold import ordered_fold


def assign_offsets(rows: DataFrame, heads: DataFrame, order: list[str]) -> DataFrame:
    """Dense offsets in arrival order behind each partition's head. ``heads``: part, next_offset."""
    n = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return rows.join(small(heads.select("part", "next_offset")), "part", "left").withColumn("assigned", F.coalesce("next_offset", F.lit(0).cast("long")) + n).drop("next_offset")


def assign_ref_offsets(batches: DataFrame, order: str) -> DataFrame:
    before = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("record_count").over(before), F.lit(0)).cast("long")
    return batches.withColumn("base", base).withColumn("end", F.col("base") + F.col("record_count"))


def pack_commits(batches: DataFrame, order: str, most: int = 25) -> DataFrame:
    """Commit chunks of at most ``most`` batches of one partition, in submission order."""
    n = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return batches.withColumn("chunk", F.floor(n / most))


def expired_segments(segments: DataFrame, checkpoints: DataFrame, cutoff_ms: int, exporting: bool) -> DataFrame:
    """Segments older than the cutoff that an exporting topic has exported; a missing checkpoint exports nothing."""
    old = segments.where(F.col("created_ms") <= cutoff_ms)
    if not exporting:
        return old
    marks = small(checkpoints.select("part", F.col("next_offset").alias("_next")))
    return old.join(marks, "part", "left").where(F.col("end_offset") <= F.coalesce("_next", F.lit(0)) - 1).drop("_next")


def expired_files(refs: DataFrame, cutoff_ms: int) -> DataFrame:
    """Files whose latest reference in any partition is old enough."""
    return refs.groupBy("file_key").agg(F.max("created_ms").alias("latest")).where(F.col("latest") <= cutoff_ms)


def exported_files(refs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files all of whose references lie before their partition's export boundary."""
    marks = small(checkpoints.select("part", F.col("next_offset").alias("_next")))
    done = F.col("end_offset") <= F.coalesce("_next", F.lit(0))
    return refs.join(marks, "part", "left").groupBy("file_key").agg(F.bool_and(done).alias("done")).where("done").select("file_key")


def unreferenced(uploads: DataFrame, refs: DataFrame) -> DataFrame:
    return uploads.join(refs.select("file_key"), "file_key", "left_anti")


def replace_refs(refs: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(refs - removed) + added; a second application changes nothing."""
    keys = ["part", "base_offset", "end_offset"]
    return refs.join(removed.select(*keys), keys, "left_anti").join(added.select(*keys), keys, "left_anti").unionByName(added)


def add_segments(index: DataFrame, new: DataFrame) -> DataFrame:
    """New segments replace those they contain; partial overlaps stay. Few new segments meet an index of any size."""
    n = new.select(F.col("part").alias("p"), F.col("base_offset").alias("nb"), F.col("end_offset").alias("ne"))
    kept = index.join(n, (F.col("part") == F.col("p")) & (F.col("base_offset") >= F.col("nb")) & (F.col("end_offset") <= F.col("ne")), "left_anti")
    return kept.unionByName(new)


def merge_manifests(parents: DataFrame, added: DataFrame, most: int = 8) -> DataFrame:
    """Entries of the next manifest list: parents' entries are carried along until there are more than ``most``
    manifests; then they merge, deleted ones drop out and the others become existing (status 0)."""
    count = parents.agg(F.count_distinct("manifest").alias("n"))
    full = F.col("n") + 1 > most
    carried = parents.crossJoin(F.broadcast(count))
    merged = carried.where(~(full & (F.col("status") == 2))).select("path", F.when(full, 0).otherwise(F.col("status")).alias("status"), F.when(full, F.lit(-1).cast("long")).otherwise(F.col("manifest")).alias("manifest"))
    return merged.unionByName(added.select("path", F.lit(1).alias("status"), "manifest"))


def epoch_of(rows: DataFrame, epochs: DataFrame) -> DataFrame:
    """The epoch in force at each offset: intervals from one start to the next, few enough for a broadcast when small."""
    nxt = F.lead("start_offset").over(Window.partitionBy("part").orderBy("start_offset"))
    spans = epochs.withColumn("_next", nxt).withColumnRenamed("part", "_part")
    return rows.join(spans, (F.col("part") == F.col("_part")) & (F.col("record_offset") >= F.col("start_offset")) & (F.col("_next").isNull() | (F.col("record_offset") < F.col("_next")))).drop("_part", "_next")


def divergence(followers: DataFrame, epochs: DataFrame) -> DataFrame:
    """Where a follower must truncate: at the next epoch's start if its own offset is beyond that, else nowhere."""
    nxt = F.lead("start_offset").over(Window.partitionBy("part").orderBy("epoch"))
    return followers.join(epochs.withColumn("next_start", nxt), ["part", "epoch"]).withColumn("truncate_to", F.when(F.col("follower_offset") > F.col("next_start"), F.col("next_start")))


def adjacent_pair(segments: DataFrame) -> DataFrame:
    """The first two neighbouring segments of one epoch in each partition."""
    order = Window.partitionBy("part").orderBy("base_offset")
    pairs = segments.withColumn("next_base", F.lead("base_offset").over(order)).withColumn("next_epoch", F.lead("epoch").over(order)).withColumn("next_end", F.lead("end_offset").over(order))
    pairs = pairs.where("next_base = end_offset + 1 AND next_epoch = epoch")
    return pairs.groupBy("part").agg(F.min_by(F.struct("base_offset", "next_end"), "base_offset").alias("m")).select("part", "m.*")


def archive_run(refs: DataFrame, below: DataFrame) -> DataFrame:
    """The leading run of references that end at or before their partition's boundary."""
    marked = refs.join(small(below.select("part", "next_offset")), "part").withColumn("_ok", F.col("end_offset") <= F.col("next_offset"))
    lead = F.bool_and("_ok").over(Window.partitionBy("part").orderBy("base_offset").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_lead", lead).where("_lead").drop("_ok", "_lead", "next_offset")


def error_islands(rows: DataFrame, error: str, order: str, *by: str) -> DataFrame:
    """Neighbouring rows with one error: first, last and count."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.col(error).eqNullSafe(F.lag(error).over(w)), 0).otherwise(1)
    runs = rows.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    return runs.groupBy(*by, "_run", error).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def table_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field ids: known names keep theirs, new names follow the largest in order of position. One row per field."""
    both = new.join(old.select("name", "field_id"), "name", "left").crossJoin(F.broadcast(old.agg(F.max("field_id").alias("top"))))
    fresh = F.row_number().over(Window.partitionBy(F.col("field_id").isNull()).orderBy("position"))
    return both.select("name", F.coalesce("field_id", F.col("top") + fresh).cast("int").alias("field_id"))


def incompatible(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields that break readers: removed, retyped, or no longer nullable."""
    n = new.select("name", F.col("type").alias("new_type"), F.col("nullable").alias("new_nullable"))
    reason = F.when(F.col("new_type").isNull(), "removed").when(F.col("new_type") != F.col("type"), "retyped").when(F.col("nullable") & ~F.col("new_nullable"), "required")
    return old.join(n, "name", "left").withColumn("reason", reason).where("reason IS NOT NULL").select("name", "reason")


RESERVED = ("record_offset", "record_timestamp", "key", "value", "headers", "dt", "hour")
TYPES = ("string", "int64", "float64", "bool", "timestamp")


def invalid_fields(fields: DataFrame) -> DataFrame:
    """Fields with a reason against them: unknown type, reserved or repeated name, bad path."""
    dup = F.count("*").over(Window.partitionBy("topic", F.lower("name"))) > 1
    bad_path = ~F.regexp_like("path", F.lit(r"^\$\.[^\['.]+(\.[^\['.]+)*$"))
    reason = F.when(~F.col("type").isin(*TYPES), "type").when(F.lower("name").isin(*RESERVED), "reserved").when(dup, "duplicate").when(bad_path, "path")
    return fields.withColumn("reason", reason).where("reason IS NOT NULL").select("topic", "name", "reason")


def numbered(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """``rows`` with ``arrival``, their number from 0 in the order of ``order``; they are written to ``path`` on the way.

    Rows are sorted by ranges and each task numbers its own, so no task sees them all; the driver holds a count of each.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    kept = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    task = F.shiftright("_m", 33)
    counts = sorted((r.t, r["count"]) for r in kept.groupBy(task.alias("t")).count().collect())
    base, at = [], 0
    for t, n in counts:
        base.append((t, at))
        at += n
    table = rows.sparkSession.createDataFrame(base, "_t long, _base long")
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(table, task == F.col("_t")).withColumn("arrival", F.col("_base") + within).drop("_m", "_t", "_base")


def assign_replicated(partitions: DataFrame, instances: DataFrame, factor: int) -> DataFrame:
    """For (topic, part) and, where there is one, its assignment (replicas, leader, epoch): the next assignment.

    A new partition p has the replicas p, p + 1, ... in the order of instances, and its first one leads in epoch 1. A
    known one keeps its replicas; an inactive leader is followed by the first active replica, or by a new replica set
    where no replica is active and there are enough instances, each time in a new epoch. Then partition by partition,
    where all replicas are active, the one that leads fewest partitions of the topic leads; a change is a new epoch.
    """
    all_ = instances.agg(F.sort_array(F.collect_set("instance")).alias("active"))
    n = F.size("active")
    fresh = F.transform(F.sequence(F.lit(0), F.least(F.lit(factor), n) - 1), lambda r: F.element_at("active", (F.pmod(F.col("part") + r, n) + 1).cast("int")))
    known = F.size(F.coalesce("replicas", F.array())) > 0
    led = F.when(F.array_contains("replicas", F.col("leader")), F.col("leader")).otherwise(F.element_at("replicas", 1))
    p = partitions.crossJoin(all_).withColumn("fresh", fresh).withColumn("known", known).withColumn("led", led)  # one row
    gone = F.col("known") & ~F.array_contains("active", F.col("led"))
    heir = F.try_element_at(F.filter("replicas", lambda x: F.array_contains("active", x)), F.lit(1))
    again = ~F.col("known") | (gone & heir.isNull() & (n >= factor))
    moved = gone & (heir.isNotNull() | (n >= factor))
    p = p.select("topic", "part", "active", F.when(again, F.col("fresh")).otherwise(F.col("replicas")).alias("replicas"), F.when(again, F.element_at("fresh", 1)).when(gone, F.coalesce(heir, "led")).otherwise(F.col("led")).alias("leader"), F.when(~F.col("known"), F.lit(1)).otherwise(F.col("epoch") + moved.cast("int")).cast("long").alias("epoch"))

    def step(state, row):
        active, replicas, leader, epoch = row
        if set(replicas) <= set(active):
            best = min(replicas, key=lambda r: state.get(r, 0))  # the first of several
            epoch, leader = epoch + (best != leader), best
            state = {**state, best: state.get(best, 0) + 1}
        return state, (leader, epoch)

    out = ordered_fold(p, ["topic"], ["part"], ["active", "replicas", "leader", "epoch"], dict, step, "new_leader string, new_epoch long")
    return out.select("topic", "part", "replicas", F.col("new_leader").alias("leader"), F.col("new_epoch").alias("epoch"))


def assign_diskless(partitions: DataFrame, instances: DataFrame) -> DataFrame:
    """For (topic, part) with the last leader and epoch, if any: leaders dealt anew over the instances; a change is a new epoch."""
    all_ = instances.agg(F.sort_array(F.collect_set("instance")).alias("active"))
    leader = F.element_at("active", (F.pmod(F.col("part"), F.size("active")) + 1).cast("int"))
    epoch = F.when(F.col("epoch").isNull(), F.lit(1)).otherwise(F.col("epoch") + (leader != F.col("leader")).cast("int"))
    return partitions.crossJoin(all_).select("topic", "part", leader.alias("leader"), epoch.cast("long").alias("epoch"))  # one row


def elect(rows: DataFrame) -> DataFrame:
    """For (topic, part, isr, failed, e): the first in-sync replica but the failed one leads, in the epoch after ``e``."""
    leader = F.try_element_at(F.filter("isr", lambda x: x != F.col("failed")), F.lit(1))
    return rows.select("topic", "part", leader.alias("leader"), F.when(leader.isNotNull(), F.col("e") + 1).alias("epoch"))


def moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions (topic, part) whose node differs between two assignments; a side without the partition is null."""
    n = new.select("topic", "part", F.col("node").alias("new_node"))
    both = old.select("topic", "part", F.col("node").alias("old_node")).join(n, ["topic", "part"], "full")
    return both.where(~F.col("old_node").eqNullSafe(F.col("new_node")))


def ensure_epoch(epochs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(part, epoch, start_offset) with each ``wanted`` epoch as its part's newest: later ones go, a known one stays as it is."""
    w = wanted.select("part", F.col("epoch").alias("_e"), F.col("start_offset").alias("_s"))
    kept = epochs.join(w, "part", "left").where("_e IS NULL OR epoch <= _e").select("part", "epoch", "start_offset")
    added = wanted.select("part", "epoch", "start_offset").join(epochs.select("part", "epoch"), ["part", "epoch"], "left_anti")
    return kept.unionByName(added.select("part", "epoch", "start_offset"))


def round_robin(partitions: DataFrame, instances: DataFrame) -> DataFrame:
    """Partition p belongs to the instance at p modulo their number, in order of ids."""
    ranked = instances.withColumn("k", (F.row_number().over(Window.orderBy("instance")) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy()))
    return partitions.join(F.broadcast(ranked), F.col("part") % F.col("n") == F.col("k")).select("part", "instance")


def acl_matches(acls: DataFrame, filters: DataFrame) -> DataFrame:
    """ACLs that a filter names: any field may be ANY; MATCH also takes prefixes and the wildcard."""
    f = filters.select(F.col("f_id"), F.col("resource").alias("fr"), F.col("name").alias("fn"), F.col("pattern").alias("fp"))
    literal = F.col("name") == F.col("fn")
    named = F.when(F.col("fp").isin("LITERAL", "PREFIXED"), (F.col("pattern") == F.col("fp")) & literal).when(F.col("fp") == "ANY", literal).otherwise(literal | (F.col("name") == "*") | ((F.col("pattern") == "PREFIXED") & F.startswith("fn", "name")))
    return acls.join(F.broadcast(f), ((F.col("fr") == "ANY") | (F.col("fr") == F.col("resource"))) & (F.col("fn").isNull() | named))


class BrokenChain(ValueError):
    """A checkpoint names one before it that isn't there, or the chain comes back to itself."""


#: Stands for a key that is named but isn't there.
_LOST = -1


def walk_chain(links: DataFrame, heads: DataFrame, folder: str) -> DataFrame:
    """Checkpoints that each partition's head reaches, with their distance from it.

    links: part, key, previous (null at the oldest); heads: part, key. Steps double each round, so that a chain of n
    takes log2(n) rounds, over numbers that stand for the keys; each round's tables are written below ``folder``, a shared
    one. Fails on a broken chain.
    """
    spark = links.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = keep(links.select("part", "key", "previous"), "links")
    keys = keep(links.select("part", "key").distinct().withColumn("id", F.monotonically_increasing_id()), "keys")
    before = keys.select("part", F.col("key").alias("previous"), F.col("id").alias("far"))
    first = keep(links.where("previous IS NOT NULL").join(before, ["part", "previous"], "left").join(keys, ["part", "key"]).select("id", F.coalesce("far", F.lit(_LOST)).alias("far")), "jump-0")
    started = heads.join(keys, ["part", "key"], "left").select("part", "key", "id")
    lost = started.where("id IS NULL").limit(1).collect()
    if lost:
        raise BrokenChain(f"partition {lost[0].part}: checkpoint {lost[0].key} is missing")
    reached, steps, most = keep(started.select("id", F.lit(0).cast("long").alias("depth")), "reached-0"), 1, links.count()
    jump, n = first, reached.count()
    while True:
        further = reached.join(jump, "id").select(F.col("far").alias("id"), (F.col("depth") + steps).alias("depth"))
        reached_now = keep(reached.unionByName(further), f"reached-{steps}")
        if (now := reached_now.count()) == n:
            break
        if steps > most:
            raise BrokenChain("a chain of checkpoints comes back to itself")
        jump = keep(jump.alias("a").join(jump.alias("b"), F.expr("a.far = b.id")).select("a.id", "b.far"), f"jump-{steps}")
        reached, n, steps = reached_now, now, steps * 2
    lost = first.where(F.col("far") == _LOST).join(reached_now.select("id"), "id").limit(1)
    lost = lost.join(keys, "id").join(links, ["part", "key"]).select("part", "previous").limit(1).collect()
    if lost:
        raise BrokenChain(f"partition {lost[0].part}: checkpoint {lost[0].previous} is missing")
    return reached_now.join(keys, "id").select("part", "key", "depth")


def select_protocol(joins: DataFrame) -> DataFrame:
    """The protocol of a group that a member joins: the group's own if the member offers it, the first if it has none.

    joins: current (null or empty if the group has none yet), offered (in the member's order). ``protocol`` is null
    where they can't agree.
    """
    none = F.coalesce(F.col("current"), F.lit("")) == ""
    return joins.withColumn("protocol", F.when(none, F.try_element_at("offered", F.lit(1))).when(F.array_contains("offered", F.col("current")), F.col("current")))


def stale_objects(objects: DataFrame, topics: DataFrame) -> DataFrame:
    """Objects (topic, part) whose topic is gone, or never had that partition. topics: topic, partitions."""
    known = objects.join(topics, "topic", "left")
    return known.where(F.col("partitions").isNull() | (F.col("part") >= F.col("partitions"))).select("topic", "part")
