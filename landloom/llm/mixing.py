"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is a number of blocks of equally many tokens. They are apportioned twice, both
times by highest quotients (votes / (2 seats + 1)): first the sources compete for all
blocks of the mix, their targets being the votes; then the shards of a source compete for
its blocks, their tokens being the votes. So each shard has an integer quota of blocks, and
the quotas of a source are its blocks. A source is dealt into shards of about
DOCS_PER_SHARD documents by a hash of the document, small sources into one. A block is so
small that it is a 2048th of the least share of a target that a shard has on average
(MAX_BLOCK at most, one token at least): no source is too small to win blocks.

A shard's documents are laid end to end in an order drawn by the seed and cut into blocks;
as many as the quota are taken from the start, going round a second time if need be. A
document is taken twice at most; where rounding gives a shard more than that, at most half
a block is left out.

Which quotients win is decided without handing out seats one by one. The divisor that gives
n seats to k competitors lies between total / (n + k / 2) and total / (n - k / 2), since
rounding moves each by half a seat at most. What a competitor has at the upper divisor is
sure; only quotients between both, about two for each competitor, are ranked, over ranges,
so that no task holds all shards of a source.

Cases: a null or empty text has size 0, its document takes nothing, and a source of such
texts has target 0; whole texts are counted, however long; the null source is a source
of its own, the last; rows that repeat a doc_id are each mixed; ties in the seeded order are broken by id and size, so
that reruns agree (rows alike in all of these are interchangeable); equal quotients go by source (null first) or shard; an empty table
gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.llm.common import read, staged, text_of
from landloom.operators.ranking import running_totals

#: Documents a shard holds on average; bounds what a shard's window sorts, whatever share of the rows a source has.
DOCS_PER_SHARD = 512
#: Tokens of a block at most, and blocks of a shard's share at least (unless a block is one token).
MAX_BLOCK, BLOCKS_PER_SHARD = 256, 2048
#: Weights of the sources in order, repeating (fixed values of the task).
WEIGHTS = (3, 1, 2)
#: Sources whose targets are broadcast; more of them are joined by a shuffle, each source's rows dealt by so many salts.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: A document is taken so many times at most.
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(totals: DataFrame, weights: tuple, share: float, most: int = MAX_REPEATS) -> DataFrame:
    """source, source_size and target of totals (source, size): share of all sizes by weight (repeating, in order of the sources, null last),
    what exceeds most times a source's size reshared by weight until none is above.

    Sources fill up in order of their size to their weight; before each, what is left is
    shared by those that are not full. One task sees a row for each source.
    """
    number = F.row_number().over(Window.orderBy(F.isnull("source"), "source"))
    weighted = totals.withColumn("number", number).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1).cast("double"))
    filling, all_ = Window.orderBy(F.col("size") / F.col("weight"), "number"), Window.partitionBy()
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    level = (share * F.sum("size").over(all_) - most * so_far("size")) / (F.sum("weight").over(all_) - so_far("weight"))
    placed = weighted.select("source", "size", "weight", F.row_number().over(filling).alias("at"), level.alias("level")).withColumn("full", F.col("level") * F.col("weight") > most * F.col("size"))
    last = F.min(F.when(~F.col("full"), F.struct("at", "level"))).over(all_)["level"]
    return placed.select("source", F.col("size").alias("source_size"), F.coalesce(F.least(last * F.col("weight"), F.lit(most) * F.col("size")), F.lit(most) * F.col("size")).cast("double").alias("target"))


def apportioned(rows: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """group, item and won: the seats of each item by highest quotients, votes / (2 won + 1).

    rows: group, item (unique in its group, breaks ties), votes; and of the group: total (of the votes), places (items, or more) and seats.
    """
    at = lambda seats: F.when((F.col("votes") > 0) & (seats > 0), F.floor(F.col("votes") * seats / F.col("total") + 0.5)).otherwise(0).cast("long")
    low = F.greatest(at(F.col("seats") - F.col("places") / 2) - 1, F.lit(0).cast("long"))  # one less and one more than the bounds: the divisions are rounded
    bounds = rows.withColumn("low", low).withColumn("high", F.when((F.col("votes") > 0) & (F.col("seats") > 0), at(F.col("seats") + F.col("places") / 2) + 1).otherwise(0))
    sure = F.struct(F.lit(float("-inf")).alias("behind"), F.col("low").alias("weight"))
    open_ = F.transform(F.when(F.col("high") > F.col("low"), F.sequence("low", F.col("high") - 1)).otherwise(F.array().cast("array<long>")), lambda n: F.struct((-F.col("votes") / (2 * n + 1)).cast("double").alias("behind"), F.lit(1).cast("long").alias("weight")))
    quotients = bounds.select(*group, *item, "seats", F.explode(F.concat(F.array(sure), open_)).alias("q")).select(*group, *item, "seats", "q.*")
    placed = running_totals(quotients, group, ["behind", *item], {"handed_out": F.col("weight")})
    return placed.groupBy(*group, *item).agg(F.sum(F.when(F.col("handed_out") <= F.col("seats"), F.col("weight")).otherwise(0)).alias("won"))


def source_blocks(totals: DataFrame, weights: tuple, share: float) -> tuple[DataFrame, int]:
    """source, source_size, target, shards and blocks (of the whole mix) of totals (source, size, n rows); and the tokens of a block."""
    named = totals.select(F.col("source").alias("name"), F.ceil(F.col("n") / DOCS_PER_SHARD).cast("long").alias("shards"))
    table = source_targets(totals, weights, share)
    table = staged(table.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name"))
    least, mixed, sources = table.agg(F.min(F.when(F.col("target") > 0, F.col("target") / F.col("shards"))), F.sum("target"), F.count("*")).first()
    block = max(1, min(MAX_BLOCK, int((least or 0) / BLOCKS_PER_SHARD)))
    votes = table.select("source", F.col("target").alias("votes"), F.lit(mixed or 0.0).alias("total"), F.lit(sources).alias("places"), F.lit(round((mixed or 0) / block)).cast("long").alias("seats"))
    won = apportioned(votes, [], ["source"]).select(F.col("source").alias("name"), F.col("won").alias("blocks"))
    return staged(table.join(won, F.col("source").eqNullSafe(F.col("name"))).drop("name")), block


def mix_sources(sized: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, seed: int = 42, carried: str | None = None) -> DataFrame:
    """sized: doc_id, source, size (long). Adds source_size, target and taken (tokens of the document in the mix, repeats counted). A column carried goes on with its row and tells apart rows of one doc_id."""
    totals = staged(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    known, block = source_blocks(totals, weights, share)
    known = known.withColumnRenamed("source", "name")

    tie = ["tie"] if carried else []
    sized = sized.withColumn("tie", F.xxhash64(carried)) if carried else sized
    drawn = sized.withColumn("draw", F.xxhash64(F.col("doc_id"), F.lit(seed), *tie))
    same = F.col("source").eqNullSafe(F.col("name"))
    if totals.count() <= BROADCAST_SOURCES:
        told = drawn.join(F.broadcast(known), same)
    else:
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = drawn.withColumn("own_salt", F.pmod("draw", F.lit(SALTS)).cast("int")).join(spread, same & (F.col("own_salt") == F.col("salt"))).drop("own_salt", "salt")
    dealt = told.withColumn("shard", F.pmod(F.xxhash64("draw"), F.col("shards"))).drop("name")

    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("votes"), F.first("source_size").alias("total"), F.first("shards").alias("places"), F.first("blocks").alias("seats"))
    cells = staged(cells)
    quotas = apportioned(cells, ["source"], ["shard"]).select(F.col("source").alias("cell_source"), F.col("shard").alias("cell_shard"), F.col("won"))
    sizes = cells.select("source", "shard", F.col("votes").alias("cell"))
    quotas = sizes.join(quotas, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("shard") == F.col("cell_shard")))
    quotas = quotas.select("cell_source", "cell_shard", "cell", F.least(F.col("won") * block, MAX_REPEATS * F.col("cell")).alias("quota"))
    before = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = dealt.withColumn("before", before).join(quotas, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("shard") == F.col("cell_shard")))
    passed = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - start))
    taken = passed(F.col("before")) + passed(F.col("before") + F.col("cell"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *([carried] if carried else []))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix_sources(staged(sized_documents(read(spark, sf_dir, "documents")))).drop("source")


QUERIES = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {}
