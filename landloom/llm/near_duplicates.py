"""Near-duplicate classes by Order MinHash.

Texts alike but for case and punctuation are one class from the start; one
representative of each goes on. Its k-mers are word shingles labelled with their
occurrence, so that none is found twice. For each of several hash functions the
SAMPLED least k-mers are taken and hashed in the order in which they stand in the
text: two sketches agree only where the same k-mers come in the same order.
Representatives that agree on LEAST_AGREED (two) sketches are candidates if their
lengths allow the threshold.

Buckets (texts with one sketch in common) of up to SMALL_BUCKET are compared in full.
In a larger one every member is first compared with the pivot, the member whose
sketches most other texts share: of the copies of one text that is the least edited
one. What is not one class then is compared in blocks, each text outside the bucket's
largest class with every member of another class, so that no candidate pair is passed
over; a pair only in the bucket of the first sketch it agrees on. A block counts the
k-mers that its pairs share by matrix products; as no alignment can match more, only
pairs with enough of them are aligned. So a group whose members are alike to its pivot
costs rows in proportion to its size; of one that is not, the texts outside the largest
class meet all members, as pairs of blocks.

A pair is verified by a banded alignment: the longest common subsequence of the
labelled k-mers within the band that the threshold leaves, as matched / (na + nb -
matched). Classes are the connected components of the links.

Cases: null counts as empty; texts without a word form classes of equal texts; texts
of fewer than five words have one shingle; whole texts are read, however long (a block
holds BLOCK_KMERS k-mers or one text); rows that repeat a doc_id are alike to each other
only by their text, whose key stands for it throughout; near_duplicates leaves out rows
with a null doc_id (a class can't name them), text_classes does not; ties between pivots
go to the greater number; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.llm.classes import components, joined_in_blocks, joining, pivot_pairs
from landloom.llm.common import read, staged
from landloom.llm.shingles import Words, mix, occurrence_labelled, shingles

THRESHOLD = 0.8
#: Hash functions, and k-mers sampled by each. At the threshold a pair is missed with a probability of about (1 - 0.8**3)**14 < 0.0001.
SKETCHES, SAMPLED = 14, 3
#: Sketches that a candidate pair agrees on (at the threshold about 7 of 14 do; fewer than 2 with a probability below 0.001), and buckets that are compared in full.
LEAST_AGREED, SMALL_BUCKET = 2, 6
#: What names a bucket, texts and k-mers that a block of one holds, about, and k-mers of one matrix product.
BUCKET, BLOCK_TEXTS, BLOCK_KMERS, PRODUCT_KMERS = ["band", "value"], 256, 60_000, 4_096
#: Ids that may be broadcast to pick the texts to align; with more of them, texts are shuffled by id instead.
BROADCAST_IDS = 1_000_000

#: Two numbers for each hash function: k-mers, well spread as they are, are flipped by one and multiplied by the other.
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)


def order_sketches(kmers: np.ndarray) -> np.ndarray:
    """One hash a hash function, of its least k-mers in text order."""
    if len(kmers) <= SAMPLED:
        least = np.tile(np.arange(len(kmers)), (SKETCHES, 1))
    else:
        least = np.empty((SKETCHES, SAMPLED), np.int64)
        for t in range(SKETCHES):
            least[t] = np.argpartition((kmers ^ _SEEDS[t]) * _ODD[t], SAMPLED - 1)[:SAMPLED]
        least.sort(1)
    out = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for place in least.T:
        out = mix(out + kmers[place])
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity of two sequences of labelled k-mers by banded alignment; 0 where it can't reach the threshold."""
    most = len(a) + len(b)
    if not most:
        return 0.0
    least = threshold / (1 + threshold) * most - 1e-9
    if min(len(a), len(b)) < least:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    band = most - 2 * least
    inside = np.abs(ia - ib) <= band
    ia, ib = ia[inside], ib[inside]
    if len(ia) < least:
        return 0.0
    ib = ib[np.argsort(ia)]
    if (np.diff(ib) > 0).all():
        matched = len(ib)
    else:
        tails: list[int] = []
        for x in ib.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        matched = len(tails)
    return matched / (most - matched) if matched >= least else 0.0


def text_key(text: str | None, w: np.ndarray) -> bytes:
    """The key of a text of the words w: equal for texts of equal words, of texts without words for equal ones."""
    return hashlib.blake2b(w.tobytes() or b"\0" + (text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (equal for texts of equal words), n (its k-mers), bands (one sketch a hash function; none without words)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch["text"].to_pylist():
                w = words(text)
                keys.append(text_key(text, w))
                kmers = occurrence_labelled(shingles(w))
                sizes.append(len(kmers))
                bands.append(order_sketches(kmers).view(np.int64) if len(w) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "key", "n", "bands"])

    return docs.mapInArrow(sketch, "doc_id long, key binary, n long, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keys = pa.array([text_key(t, words(t or "")) for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "key"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("key", T.BinaryType())]))


def _sequences(docs: DataFrame) -> DataFrame:
    """key, seq: the labelled k-mers as bytes, 64 bits each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keys, seqs = [], []
            for text in batch["text"].to_pylist():
                w = words(text)
                keys.append(text_key(text, w))
                seqs.append(occurrence_labelled(shingles(w)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(seqs, pa.binary())], ["key", "seq"])

    return docs.mapInArrow(make, "key binary, seq binary")


def _verified(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """a, b of the pairs at the threshold or above. Neither side has a bound, so that the joins shuffle at every size."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [aligned_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.float64())], ["a", "b", "similarity"])

    b = seqs.select(F.col("rep").alias("b"), F.col("seq").alias("sb")).hint("merge")
    a = seqs.select(F.col("rep").alias("a"), F.col("seq").alias("sa")).hint("merge")
    judged = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, similarity double")
    return judged.where("similarity > 0").select("a", "b")


def shared_counts(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many numbers each x shares with each y; none holds a number twice."""
    owners = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (xs, ys)]
    values = [np.concatenate(side) for side in (xs, ys)]
    both = np.intersect1d(*values)
    places = [np.searchsorted(both, v) for v in values]
    known = [both[np.minimum(at, len(both) - 1)] == v if len(both) else np.zeros(len(v), bool) for at, v in zip(places, values, strict=True)]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for low in range(0, len(both), PRODUCT_KMERS):
        width = min(PRODUCT_KMERS, len(both) - low)
        sides = []
        for n, owner, at, hit in zip(out.shape, owners, places, known, strict=True):
            inside = hit & (at >= low) & (at < low + width)
            m = np.zeros((n, width), np.float32)
            m[owner[inside], at[inside] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _small_pairs(met: DataFrame) -> DataFrame:
    """a, b of all pairs in small buckets. met: BUCKET, rep, n."""
    x, y = (met.where(F.col("n") <= SMALL_BUCKET).select(*BUCKET, F.col("rep").alias(c)) for c in "ab")
    return x.join(y, BUCKET).where("a < b").select("a", "b")


def _candidates(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs that agree on LEAST_AGREED sketches and whose numbers of k-mers allow the threshold."""
    pairs = pairs.distinct()
    for c in "ba":
        pairs = pairs.join(sketches.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}"), F.col("bands").alias(f"bands_{c}")), c)
    agreed = F.size(F.filter(F.zip_with("bands_a", "bands_b", lambda p, q: p == q), lambda same: same))
    fit = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-6
    return pairs.where((agreed >= LEAST_AGREED) & fit).select("a", "b")


def block_links(band: int, xs: list[dict], ys: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Classes joined by links of texts xs (outside the bucket's main class) with ys, of pairs that agree on this band's sketch, on another one, and on none before."""
    column = lambda side, name: np.array([t[name] for t in side])
    bands = [np.array([t["payload"]["bands"] for t in side]) for side in (xs, ys)]
    same = bands[0][:, None] == bands[1][None]
    size_x, size_y = column(xs, "size")[:, None], column(ys, "size")[None]
    met = same[:, :, band] & (same.sum(2) >= LEAST_AGREED) & ~same[:, :, :band].any(2) & (column(xs, "root")[:, None] != column(ys, "root")[None])
    met &= np.minimum(size_x, size_y) >= threshold * np.maximum(size_x, size_y) - 1e-6
    met &= (column(ys, "root") == column(ys, "main"))[None] | (column(xs, "rep")[:, None] < column(ys, "rep")[None])  # others are met from the other side
    if not met.any():
        return []
    in_x, in_y = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
    seq_x, seq_y = ({i: np.frombuffer(side[i]["payload"]["seq"], np.uint64) for i in at.tolist()} for side, at in ((xs, in_x), (ys, in_y)))
    enough = shared_counts(list(seq_x.values()), list(seq_y.values())) >= (threshold / (1 + threshold) * (size_x + size_y) - 1e-9)[np.ix_(in_x, in_y)]
    met[np.ix_(in_x, in_y)] &= enough
    pairs = [(xs[i]["root"], ys[j]["root"], (i, j)) for i, j in np.argwhere(met).tolist()]
    return joining(pairs, lambda at: aligned_similarity(seq_x[at[0]], seq_y[at[1]], threshold) > 0)


def _of_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among ids (null for null), without a shuffle of rows while the ids are few enough to broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.select(F.col(column).alias("wanted")).hint("broadcast" if few else "merge")
    return rows.join(ids, F.col(column).eqNullSafe(F.col("wanted")), "left_semi")


def _numbered(reps: DataFrame) -> tuple[DataFrame, Callable[[], Column]]:
    """reps with a number of each key, rep, and the expression that makes it: a hash under the first seed that gives no two keys the same."""
    for seed in count(1):
        number = partial(F.xxhash64, "key", F.lit(seed))
        if reps.groupBy(number().alias("rep")).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return reps.withColumn("rep", number()), number


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, key (of the text), class_id (the least doc_id of its class; null if it has none) and root (a number of the class), one row for each row of docs. The text alone decides; doc_id may repeat or be null."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = staged(sketched(texts))
    reps = staged(table.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n", "bands")).alias("of")).select("key", "doc_id", "of.*"))
    reps, number = _numbered(reps)
    sketches = reps.where("bands IS NOT NULL").select("rep", F.col("n").alias("size"), "bands")
    entries = sketches.select("rep", F.posexplode("bands").alias(*BUCKET))
    met = staged(entries.join(entries.groupBy(*BUCKET).agg(F.count("*").alias("n")).where("n > 1"), BUCKET))
    sketches = staged(sketches.join(met.select("rep").distinct(), "rep", "left_semi"))
    pairs = staged(_candidates(_small_pairs(met).union(pivot_pairs(met, BUCKET, SMALL_BUCKET)), sketches, threshold))

    needed = staged(pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(met.where(F.col("n") > SMALL_BUCKET).select("rep")).distinct())
    ids = staged(reps.select("rep", "doc_id").join(needed, "rep").select("doc_id").distinct())
    seqs = _sequences(_of_ids(texts, ids, "doc_id")).select(number().alias("rep"), "seq")
    seqs = staged(_of_ids(seqs, needed, "rep").groupBy("rep").agg(F.first("seq").alias("seq")))
    roots = components(staged(_verified(pairs, seqs, threshold)))
    large = met.where(F.col("n") > SMALL_BUCKET).join(roots, F.col("rep") == F.col("id"), "left").select(*BUCKET, "rep", F.coalesce("root", "rep").alias("root"))
    payloads = sketches.join(seqs, "rep").select("rep", F.struct("bands", "seq").alias("payload"))
    rooted = staged(large.join(sketches.select("rep", "size"), "rep"))
    links = lambda band, value, xs, ys: block_links(band, xs, ys, threshold)
    joined = components(staged(joined_in_blocks(rooted, payloads, BUCKET, BLOCK_TEXTS, BLOCK_KMERS, links)))

    classes = reps.select("key", "doc_id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("key", "doc_id", F.coalesce("root", "rep").alias("id"), F.col("root").isNotNull().alias("linked"))
    classes = classes.join(joined, "id", "left").select("key", "doc_id", F.coalesce("root", "id").alias("root"), (F.col("linked") | F.col("root").isNotNull()).alias("linked"))
    classes = staged(classes)
    names = classes.where("linked").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = classes.where("linked").join(names, "root").select("key", "class_id", "root")
    classes = named.union(classes.where("NOT linked").select("key", F.col("doc_id").alias("class_id"), "root"))
    return table.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "class_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class), one row for each row of docs."""
    return text_classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, threshold).select("doc_id", "class_id")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
ORACLES: dict[str, str] = {}
