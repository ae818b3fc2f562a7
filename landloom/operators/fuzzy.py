"""Text joins for search: by prefix and by trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.normalize import trigrams
from landloom.operators.staging import staged

THRESHOLD = 0.3


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams of all, of two arrays of distinct ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared > 0, shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def starting_with(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, text for every distinct text that begins with q. queries: query_id, q; texts: text.

    Texts are posted under their beginnings, of the lengths that queries have (a few
    dozen numbers, asked first), and met by equality.
    """
    lengths = sorted(r[0] for r in queries.select(F.length("q")).where("q IS NOT NULL").distinct().collect())
    posted = texts.where(F.col("text").isNotNull()).select("text").distinct()
    heads = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("text"))
    return posted.select("text", F.explode(F.transform(heads, lambda n: F.left("text", n))).alias("q")).join(queries.select("query_id", "q"), "q").select("query_id", "text")


def similar_texts(queries: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, text, similarity for every distinct text at the threshold or above. queries: query_id, q; texts: text.

    Sides meet in trigrams by an inverted index. Each posts only its rarest trigrams, as
    many as leave too few for the threshold without one of them; so very common ones
    hardly meet. shared / (a + b - shared) is the similarity.
    """
    a = staged(queries.select("query_id", F.col("q").alias("text"), trigrams(F.col("q")).alias("grams")))
    b = staged(texts.where(F.col("text").isNotNull()).select("text").distinct().withColumn("grams", trigrams(F.col("text"))))
    held = staged(b.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("held")))

    def posted(side: DataFrame, key: str) -> DataFrame:
        rows = side.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(held, "gram", "left")
        nth = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("held", F.lit(0)), "gram"))
        return rows.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select(key, "n", "gram")

    x, y = posted(a, "query_id").withColumnRenamed("n", "na"), posted(b, "text").withColumnRenamed("n", "nb")
    met = y.join(x, "gram").where((F.col("nb") >= threshold * F.col("na")) & (F.col("na") >= threshold * F.col("nb"))).select("query_id", "text").distinct()
    both = met.join(a.select("query_id", F.col("grams").alias("ga")), "query_id").join(b.withColumnRenamed("grams", "gb"), "text")
    return both.select("query_id", "text", similarity(F.col("ga"), F.col("gb")).alias("similarity")).where(F.col("similarity") >= threshold)
