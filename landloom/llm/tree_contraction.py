"""Totals of all subtrees of a forest by parallel tree contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import staged


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """id and, for each column of `values` (longs), its sum over the subtree below id, itself included. nodes: id (unique, not null), parent (null at a root), values.

    Each round rakes all leaves into their parents (sums by parent, combined before the shuffle) and
    compresses chains: of the nodes with one child left, those whose coin shows heads while their child isn't such a node are
    spliced out. A spliced node leaves its sum on the edge of its child, and a record (id, child, what it adds to the
    child's total). Half of the tree goes in about every round, however deep or bushy, so rounds grow with the
    logarithm of the nodes. Afterwards the rounds are read backwards: the child of a spliced node always goes in a later round, so its
    total is known. Every round's tables are written to the shared folder. An empty table gives an empty result.
    """
    load = {c: f"_load_{c}" for c in values}  # what lies on the edge to the parent, of spliced nodes
    alive = staged(nodes.select("id", "parent", *[F.col(c).cast("long").alias(c) for c in values], *[F.lit(0).cast("long").alias(x) for x in load.values()]))
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        parents = alive.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().withColumn("_inner", F.lit(True))
        known = staged(alive.join(parents, "id", "left"))
        raked = known.where("_inner IS NULL").select("id", *values)
        up = known.where("parent IS NOT NULL").groupBy("parent").agg(
            F.count("_inner").alias("_kids"), F.min(F.when(F.col("_inner"), F.col("id"))).alias("_only"),
            *[F.coalesce(F.sum(F.when(F.col("_inner").isNull(), F.col(c) + F.col(load[c]))), F.lit(0)).alias(f"_up_{c}") for c in values],
        )
        inner = known.where("_inner").join(up.withColumnRenamed("parent", "id"), "id")
        coin = F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(2)) == 0
        heads = (F.col("_kids") == 1) & F.col("parent").isNotNull() & coin
        inner = staged(inner.select("id", "parent", *[(F.col(c) + F.col(f"_up_{c}")).alias(c) for c in values], *load.values(), F.when(heads, F.col("_only")).alias("_heads_of")))
        if inner.isEmpty():
            rounds.append((raked, inner.select("id", F.col("_heads_of").alias("child"), *values)))
            break
        chosen = inner.where("_heads_of IS NOT NULL")
        settled = chosen.select(F.col("id").alias("_heads_of"))  # a child that is heads itself keeps its parent from being spliced
        spliced = staged(chosen.join(settled, "_heads_of", "left_anti").select("id", "parent", F.col("_heads_of").alias("child"), *values, *load.values()))
        handed = spliced.select(F.col("child").alias("id"), F.col("parent").alias("_to"), *[(F.col(c) + F.col(load[c])).alias(f"_add_{c}") for c in values])
        held = inner.join(spliced.select("id"), "id", "left_anti").join(handed, "id", "left")
        left = staged(held.select("id", F.coalesce("_to", "parent").alias("parent"), *values, *[(F.col(load[c]) + F.coalesce(f"_add_{c}", F.lit(0))).alias(load[c]) for c in values]))
        on_edge = inner.select(F.col("id").alias("child"), *[F.col(x).alias(f"_had_{c}") for c, x in load.items()])  # as it was before this round
        rounds.append((raked, spliced.join(on_edge, "child").select("id", "child", *[(F.col(c) + F.col(f"_had_{c}")).alias(c) for c in values])))
        alive = left
    totals = rounds[-1][0]
    for raked, spliced in reversed(rounds[:-1]):
        below = totals.select(F.col("id").alias("child"), *[F.col(c).alias(f"_below_{c}") for c in values])
        grown = spliced.join(below, "child").select("id", *[(F.col(c) + F.col(f"_below_{c}")).alias(c) for c in values])
        totals = staged(totals.unionByName(raked).unionByName(grown))
    return totals

