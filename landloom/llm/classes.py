"""Classes of linked rows: connected components, and links inside large buckets found in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.llm.common import staged


def components(links: DataFrame, vertices: tuple[str, str] = ("a", "b")) -> DataFrame:
    """id, root of every linked vertex: the least id it is connected with. Labels spread along links and jump to their label's label, until nothing changes."""
    u, v = vertices
    both = staged(links.select(F.col(u).alias("u"), F.col(v).alias("v")).union(links.select(F.col(v), F.col(u))).distinct())
    labels = staged(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")))
    while True:
        near = both.join(labels, both.v == labels.id).groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("far"))
        moved = staged(spread.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("next"), "root"))
        if moved.where("next < root").isEmpty():
            return labels
        labels = moved.select("id", F.col("next").alias("root"))


def contracted(links: DataFrame, vertices: tuple[str, str] = ("a", "b"), passes: int = 2) -> DataFrame:
    """Links (a, b) with the same components, but fewer where many join one group: the links that a batch of rows holds are joined there, and each of its
    vertices is linked to the least one it is connected with; a batch is held, no group. By turns links come by their lesser vertex, so that one group's
    share batches, and by their greater one, so that a member that was linked to the leasts of many batches keeps about one link."""
    u, v = vertices

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above: dict[int, int] = {}

            def root_of(r: int) -> int:
                while (up := above.setdefault(r, r)) != r:  # noqa: B023
                    above[r] = above[up]  # noqa: B023
                    r = up
                return r

            for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                x, y = root_of(x), root_of(y)
                above[max(x, y)] = min(x, y)
            pairs = [(root, m) for m in above if (root := root_of(m)) != m]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    left = links.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
    for n in range(passes):
        order = ["a", "b"] if n % 2 == 0 else ["b", "a"]
        left = staged(left.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stars, "a long, b long").distinct())
    return left


def pivot_pairs(met: DataFrame, bucket: list[str], small: int) -> DataFrame:
    """a, b of the pivots of buckets of over `small` members with all other members. met: bucket, rep, n (members of the bucket); with root, the class so far, only with those of other classes.

    A bucket's pivot is the member that most others meet in all buckets, so that buckets of one group mostly have one pivot.
    """
    weights = met.groupBy("rep").agg(F.sum("n").alias("weight"))
    large = met.where(F.col("n") > small).join(weights, "rep")
    of = "root" if "root" in met.columns else "rep"
    pivots = large.groupBy(*bucket).agg(F.max(F.struct("weight", "rep", *{of} - {"rep"})).alias("pivot")).select(*bucket, F.col("pivot.rep").alias("pivot"), F.col(f"pivot.{of}").alias("pivots"))
    return large.join(pivots, bucket).where(f"{of} <> pivots").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))


def joined_in_blocks(members: DataFrame, payloads: DataFrame, bucket: list[str], rows: int, size: int, links: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """a, b: classes that links join, of buckets of several classes.

    members: bucket, rep, root (its class so far), size. payloads: rep, payload. Members are
    dealt into blocks of about `rows` of them or `size` in all; each block of members
    outside the bucket's largest class meets every block of it, so rows of the join
    are pairs of blocks. links(*bucket, xs, ys) gets the two blocks as lists of dicts
    (rep, root, main: the largest class, size, payload) and gives pairs of classes.
    """
    classes = members.groupBy(*bucket, "root").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))
    mixed = classes.groupBy(*bucket).agg(F.max_by(F.struct("root", "n", "sizes"), F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("sizes").alias("sizes"), F.count("*").alias("classes")).where("classes > 1")
    blocks = lambda n, sizes: F.ceil(F.greatest(n / rows, sizes / size)).cast("int")
    mixed = mixed.select(*bucket, F.col("main.root").alias("main"), blocks(F.col("n"), F.col("sizes")).alias("blocks"), blocks(F.col("n") - F.col("main.n"), F.col("sizes") - F.col("main.sizes")).alias("open_blocks"))
    met = members.join(staged(mixed), bucket)
    number = lambda of: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(of)).cast("int")
    all_, open_ = met.withColumn("block", number("blocks")), met.where("root != main").withColumn("open_block", number("open_blocks"))
    held = lambda side, *keys: side.join(payloads, "rep").groupBy(*bucket, *keys).agg(F.collect_list(F.struct("rep", "root", "main", "size", "payload")).alias("held"))
    x = held(open_, "open_block", "blocks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select(*bucket, "block", F.col("held").alias("xs")).hint("merge")
    y = held(all_, "block").select(*bucket, "block", F.col("held").alias("ys")).hint("merge")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in range(batch.num_rows):
                found.update(links(*(batch[c][row].as_py() for c in (*bucket, "xs", "ys"))))
            a, b = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return x.join(y, [*bucket, "block"]).select(*bucket, "xs", "ys").mapInArrow(verify, "a long, b long")


def joining(pairs: list[tuple[int, int, object]], linked: Callable[[object], bool]) -> list[tuple[int, int]]:
    """Of (class, class, what) in their order those that are linked and whose classes no link before has joined."""
    joined: dict[int, int] = {}

    def root_of(r: int) -> int:
        while r in joined:
            r = joined[r]
        return r

    out = []
    for x, y, what in pairs:
        rx, ry = root_of(x), root_of(y)
        if rx != ry and linked(what):
            joined[rx] = ry
            out.append((min(rx, ry), max(rx, ry)))
    return out
