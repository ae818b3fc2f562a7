"""Work queue over a log of events: state of items, batches of claims, running cells. State is plain grouped aggregation, so each function gives the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a claim without a sign of life for so long is stale.
STALE = "INTERVAL 10 MINUTES"
#: Items that a worker claims at once (fixed value).
CLAIM = 10


def item_states(log: DataFrame) -> DataFrame:
    """county_id, item, added, completed_at, decision (the last claim or release, with its worker) and beat of each item. log: county_id, item, worker, action, ts, seq.

    An action is one of populate, claim, heartbeat, complete, release; seq orders those of one moment.
    """
    when = lambda *actions: F.col("action").isin(*actions)
    return log.groupBy("county_id", "item").agg(
        F.min(F.when(when("populate"), F.col("ts"))).alias("added"), F.min(F.when(when("complete"), F.col("ts"))).alias("completed_at"),
        F.max(F.when(when("claim", "release"), F.struct("ts", "seq", "action", "worker"))).alias("decision"), F.max(F.when(when("heartbeat"), F.col("ts"))).alias("beat"),
    )


def queue_state(states: DataFrame, now: Column) -> DataFrame:
    """county_id, item, status (done, claimed, stale, pending), worker and claimed_at (the claim's last sign of life) at a time."""
    claimed = F.col("decision.action") == "claim"
    alive = F.when(claimed, F.greatest("decision.ts", F.col("beat")))
    status = F.when(F.col("completed_at").isNotNull(), "done").when(claimed & (alive < now - F.expr(STALE)), "stale").when(claimed, "claimed").otherwise("pending")
    held = status.isin("claimed", "stale")
    return states.select("county_id", "item", status.alias("status"), F.when(held, F.col("decision.worker")).alias("worker"), F.when(held, alive).alias("claimed_at"))


def claims(state: DataFrame, workers: int, size: int = CLAIM) -> DataFrame:
    """county_id, item, worker, nth: free items (pending or stale) in their order, the first `size` of a county for its first worker and so on; without locks, since one job deals them out."""
    nth = F.row_number().over(Window.partitionBy("county_id").orderBy("item"))
    dealt = state.where(F.col("status").isin("pending", "stale")).withColumn("nth", nth).where(F.col("nth") <= workers * size)
    return dealt.select("county_id", "item", F.floor((F.col("nth") - 1) / size).cast("int").alias("worker"), "nth")


def running_cells(changes: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, ix, iy, n, total of tax changes (record, ts, ix, iy, amount) by window and cell, repeats of a record once. On a stream, rows later than `late` are dropped, and records are known so long."""
    if changes.isStreaming:
        once = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["record"])
    else:
        once = changes.dropDuplicates(["record"])
    cells = once.groupBy(F.window("ts", window), "ix", "iy").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return cells.select(F.col("window.start").alias("start"), "ix", "iy", "n", F.round("total", 4).alias("total"))
