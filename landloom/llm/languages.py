"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A trigram's
vector binds its letters' vectors, permuted by their place, by multiplication; a text's
vector bundles its trigrams' vectors by addition. A language's prototype bundles the
texts learned for it; a text gets the language whose prototype has the highest cosine
with it.

Cases: null texts and texts without a letter are ``und`` with score 0; a text with letters
gets the best language, with score 0 if no cosine is positive; whole texts are read, however long; ties go to
the language first by code point; repeated rows are each judged (but learned from
once); every language of the learning sample is learned, so there are LEARN_ROWS of them
at most; without a row to learn from every text is ``und``; an
empty table gives an empty result; columns named lang_pred and score are replaced,
others kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.common import bounded_sample, read, staged

DIMENSIONS = 512
#: Bits of a code point in a trigram's code; 0 stands for the gap between words.
POINT = 21
#: Labelled documents that prototypes are learned from, at most (chosen by a hash of doc_id).
LEARN_ROWS = 20_000
#: Tasks that bundle the learning sample, at most.
LEARN_TASKS = 12
#: Rows that a worker turns into vectors at once, and trigram vectors it keeps.
BATCH, KEPT = 256, 60_000


class Encoder:
    """Vectors of texts; keeps the trigram vectors it has made."""

    def __init__(self, seed: int = 7) -> None:
        self.seed = seed
        self._clear()

    def _clear(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, DIMENSIONS), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if (v := self.letters.get(point)) is None:
            v = self.letters[point] = np.random.default_rng((self.seed, point)).choice(np.array([-1, 1], np.int8), DIMENSIONS)
        return v

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the letter trigrams of a text and how often each occurs."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.where(points < 128, (points >= 97) & (points <= 122), points >= 0xAA)
        if (odd := points[points >= 0x250]).size:
            letters = {p for p in np.unique(odd).tolist() if chr(p).isalpha()}
            known &= (points < 0x250) | np.isin(points, list(letters))
        known &= (points != 0xD7) & (points != 0xF7) & ~((points >= 0xAB) & (points <= 0xBF) & (points != 0xB5) & (points != 0xBA))
        if not known.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        slots = np.where(known, points, 0).astype(np.int64)
        slots = np.concatenate([[0], slots[(slots > 0) | np.concatenate([[True], slots[:-1] > 0])], [0]])
        return np.unique(slots[:-2] << 2 * POINT | slots[1:-1] << POINT | slots[2:], return_counts=True)

    def rows_of(self, codes: np.ndarray) -> np.ndarray:
        if len(self.rows) > KEPT:
            self._clear()
        missing = [c for c in codes.tolist() if c not in self.rows]
        if missing:
            new = np.array(missing)
            a, b, c = (np.stack([self.letter(p) for p in (new >> shift & (1 << POINT) - 1).tolist()]) for shift in (2 * POINT, POINT, 0))
            made = np.roll(a, 2, 1) * np.roll(b, 1, 1) * c
            start = len(self.rows)
            while start + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[start : start + len(new)] = made
            self.rows.update(zip(missing, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, codes.tolist()), np.int64, len(codes))

    def vector(self, text: str | None) -> np.ndarray | None:
        codes, counts = self.trigrams(text or "")
        if not len(codes):
            return None
        parts = (slice(i, i + KEPT // 4) for i in range(0, len(codes), KEPT // 4))
        return sum(counts[part].astype(np.float32) @ self.table[rows] for part in parts for rows in [self.rows_of(codes[part])])


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bound: int = LEARN_ROWS, key: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Prototype of each language: unit bundles of texts are added up within tasks, then by Spark by language and dimension."""
    sample = bounded_sample(docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(key, F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), key, bound, 11)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums, counts = Encoder(), {}, Counter()
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if (v := encoder.vector(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64) / max(float(np.linalg.norm(v)), 1e-12)
                    counts[lang] += 1
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "n": [counts[lang] for lang in sums], "v": [x.round(6).tolist() for x in sums.values()]}, pa.schema([("lang", pa.string()), ("n", pa.int64()), ("v", pa.list_(pa.float64()))]))

    parts = staged(sample.select("text", "lang").coalesce(LEARN_TASKS).mapInArrow(bundle, "lang string, n long, v array<double>"))
    sums = parts.select("lang", F.posexplode("v").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum(F.col("x").cast("decimal(20,6)")).cast("double").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("lang", "v.x").collect()  # a row for each language of the sample
    langs = sorted(r["lang"] for r in rows)
    told = {r["lang"]: r["x"] for r in rows}
    out = np.array([told[lang] for lang in langs], np.float32).reshape(len(langs), DIMENSIONS)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict_languages(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 where negative) added; columns of these names are replaced."""
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                names, scores = [], []
                for text in batch.column(at).to_pylist():
                    v = encoder.vector(text) if langs else None
                    if v is None:
                        names.append("und"), scores.append(0.0)
                    else:
                        cosines = prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                        best = int(np.argmax(cosines))
                        names.append(langs[best]), scores.append(min(1.0, max(0.0, float(cosines[best]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(judge, T.StructType([*rest.schema.fields]).add("lang_pred", "string").add("score", "double"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    langs, prototypes = learn_prototypes(docs.where("NOT held_out"))
    return predict_languages(docs.select("doc_id", "held_out", "text"), langs, prototypes).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
