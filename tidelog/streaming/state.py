"""Keyed state in streams: producers' sequences, and members of consumer groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def producer_sequences(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A verdict on each batch of (part, producer_id, arrival, sequence, record_count): accepted, duplicate or gap.

    The state is the next sequence; it goes after ``idle_ms`` without batches.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        following = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("arrival")
        verdicts = []
        for sequence, count in zip(rows["sequence"].tolist(), rows["record_count"].tolist(), strict=True):
            verdicts.append("accepted" if sequence == following else "duplicate" if sequence < following else "gap")
            if sequence == following:
                following += count
        state.update((int(following),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows[["part", "producer_id", "arrival", "sequence"]].assign(verdict=verdicts)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    schema = "part int, producer_id long, arrival long, sequence long, verdict string"
    return stream.groupBy("part", "producer_id").applyInPandasWithState(step, schema, "following long", "append", timeout)


def fold_group(events: list[tuple[str, str, int]], timeout_ms: int, now: int) -> dict:
    """A group's state after (event, member, time) in order: join, heartbeat, leave; the clock is given.

    Every join or leave starts a generation; members silent for longer than ``timeout_ms`` are expired, and the leader
    is the smallest member id.
    """
    members: dict[str, int] = {}
    generation = 0

    def expire(at: int) -> None:
        nonlocal generation
        gone = [m for m, seen in members.items() if at - seen > timeout_ms]
        for m in gone:
            del members[m]
        generation += bool(gone)

    for event, member, at in events:
        expire(at)
        if event == "join":
            generation += member not in members
            members[member] = at
        elif event == "heartbeat" and member in members:
            members[member] = at
        elif event == "leave" and member in members:
            del members[member]
            generation += 1
    expire(now)
    return {"generation": generation, "leader": min(members, default=None), "members": sorted(members), "state": "Stable" if members else "Empty"}


def group_states(events: DataFrame, timeout_ms: int, now: int) -> DataFrame:
    """State of every group from its events (grp, event, member, at); a group's events are bounded by its membership churn."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["at", "member", "event"])
        found = fold_group(list(zip(g["event"], g["member"], g["at"].tolist(), strict=True)), timeout_ms, now)
        return pd.DataFrame([{"grp": g["grp"].iloc[0], "generation": found["generation"], "leader": found["leader"], "members": ",".join(found["members"]), "state": found["state"]}])

    return events.groupBy("grp").applyInPandas(run, "grp string, generation long, leader string, members string, state string")
