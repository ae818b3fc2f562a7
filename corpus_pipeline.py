"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
all but the last return the columns of documents. Rows are judged
by their own text in every stage, also those whose doc_id is null or repeated. Null and empty texts have no letter: the language stage
rejects them. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import read, staged, text_of
from landloom.llm.decontamination import without_leaks
from landloom.llm.languages import learn_prototypes, predict_languages
from landloom.llm.mixing import mix_sources, word_count
from landloom.llm.near_duplicates import keyed, text_classes
from landloom.llm.secrets import with_secrets
from landloom.llm.spans import redacted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, which are in no language."""
    langs, prototypes = learn_prototypes(docs)
    if not langs:
        return docs.select(*COLUMNS)
    return predict_languages(docs.select(*COLUMNS), langs, prototypes).where("lang_pred != 'und'").select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: of its least doc_id (null last), there of its least text key, there the least in its columns."""
    rows = text_classes(docs).groupBy("root", "doc_id", "key").agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "key", "n")).alias("of"))
    kept = staged(least.select(F.col("of.doc_id").alias("id"), F.col("of.key").alias("of_key"), "of.n"))
    stay = keyed(docs.select(*COLUMNS)).join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of_key")))
    more = stay.where("n > 1").groupBy("doc_id", "key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return stay.where("n = 1").select(*COLUMNS).union(more.select("row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return without_leaks(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each secret in its place."""
    found = with_secrets(docs.select(*COLUMNS))
    hit = F.coalesce(F.size("secrets") > 0, F.lit(False))
    text = F.when(hit, redacted(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, target of the source, and taken."""
    sized = docs.select("doc_id", "source", word_count(text_of()).alias("size"), F.struct(*COLUMNS).alias("row"))
    return mix_sources(sized, carried="row").where("taken > 0").select("row.*", "size", "target", "taken")


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: Language profiles and sketches can't be said in SQL; tests/llm compares near duplicates with brute force, the other stages with planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
