"""Quality classifier: logistic regression on hashed word n-grams, learned with follow-the-regularised-leader updates.

Features of a text are the hashes of its words, word pairs, word shapes (runs of
capitals, small letters, digits, marks) and shape pairs, valued by the square root
of their count and scaled to unit length. SHARDS shards of the learning sample, each a
group of its own, are learned side by side by FTRL-proximal, one example after another
in a seeded order, and their weights averaged. A score is the logistic of a sparse dot
product.

Cases: null and empty texts have no feature and score by the bias alone; whole texts
are read, however long; labels other than 0 and 1 are not learned from; if a document
has several labels each counts; examples that tie in the seeded order are equal in id
and text and follow by label; repeated rows are each scored; an empty table gives an empty result;
without labels every score is 0.5; other columns are kept or ignored, whatever their
names (score is replaced).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.common import bounded_sample, read

BITS = 18
#: Labelled documents learned from, at most (chosen by a hash of doc_id), and shards that learn them.
LEARN_ROWS, SHARDS = 12_000, 6
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.1, 3
#: Score from which a text is predicted to be good (fixed value of the task).
THRESHOLD = 0.3


class _Shapes(dict):
    """What stands for a character in a word's shape."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = shape = "0" if c.isdigit() else "A" if "A" <= c <= "Z" else "a" if c.isalpha() else c if point < 128 else "#"
        return shape


_SHAPES = _Shapes()
_RUN = re.compile(r"(.)\1+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Sparse features of texts; keeps the hashes of words it has met."""

    def __init__(self) -> None:
        self.met: dict[str, int] = {}

    def _hashes(self, word: str) -> int:
        if len(self.met) > 400_000:
            self.met.clear()
        shape = _RUN.sub(r"\1", word.translate(_SHAPES))[:12]
        h = self.met[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape.encode())
        return h

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        met = self.met
        both = np.array([met.get(w) or self._hashes(w) for w in (text or "").split()], np.uint64)
        if not both.size:
            return np.empty(0, np.int64), np.empty(0, np.float64)
        words, shapes = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)) + np.uint64(1 << 33)
        grams = [words, shapes] + [(x[:-1] * _MIX ^ x[1:]) + np.uint64(1) for x in (words, shapes)]
        slots = ((np.concatenate(grams) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)
        slots, counts = np.unique(slots, return_counts=True)
        values = np.sqrt(counts)
        return slots, values / np.linalg.norm(values)


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, x))))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the bias) by FTRL-proximal updates over the examples in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for slots, values, label in examples:
            i, x = np.append(slots, 1 << BITS), np.append(values, 1.0)
            w = weight(i)
            g = (_logistic(float(w @ x)) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange((1 << BITS) + 1))


def learn_quality(labelled: DataFrame, bound: int = LEARN_ROWS) -> np.ndarray:
    """labelled: doc_id, text, label. A group for each shard, of bound / SHARDS rows or so; the weights (2^18 numbers a shard) are averaged here."""

    def learn(rows: pa.Table) -> pa.Table:
        features = Features()
        examples = sorted(zip(rows["draw"].to_pylist(), rows["label"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda r: r[:2])
        weights = ftrl([(*features(text), label) for _, label, text in examples]).astype(np.float32)
        return pa.table({"shard": rows["shard"][:1], "n": pa.array([len(examples)], pa.int64()), "w": pa.array([weights.tobytes()], pa.binary())})

    dealt = labelled.select(F.xxhash64("doc_id", "text", F.lit(3)).alias("draw"), F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    dealt = dealt.withColumn("shard", F.pmod("draw", F.lit(SHARDS)).cast("int"))
    parts = dealt.groupBy("shard").applyInArrow(learn, "shard int, n long, w binary").collect()
    whole = np.zeros((1 << BITS) + 1)
    for r in sorted(parts, key=lambda r: r["shard"]):
        whole += np.frombuffer(r["w"], np.float32) * r["n"] / sum(p["n"] for p in parts)
    return whole.astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with score added (a column of this name is replaced)."""
    rest = docs.drop("score")
    at = rest.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(), shared.value
        for batch in batches:
            scores = []
            for text in batch.column(at).to_pylist():
                slots, values = features(text)
                scores.append(_logistic(float(w[slots] @ values) + float(w[-1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return rest.mapInArrow(judge, T.StructType([*rest.schema.fields]).add("score", "double"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents").withColumn("held_out", fold).select("doc_id", "held_out", "text")
    labels = bounded_sample(read(spark, sf_dir, "labels").where(~fold & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label")), "doc_id", LEARN_ROWS, 5)
    labelled = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # LEARN_ROWS rows of two numbers
    scored = score_quality(docs, learn_quality(bounded_sample(labelled, "doc_id", LEARN_ROWS, 6)))  # again, since a doc_id may have many texts
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
