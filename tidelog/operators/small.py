"""Tables with a row for each log partition: broadcast after a count, joined by their key otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100_000


def small(table: DataFrame, most: int = MOST) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``most`` rows, else as it is: a shuffled join on its key.

    The count stops at ``most`` + 1 rows. The hint keeps a log from being shuffled by partition for a few bounds.
    """
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
