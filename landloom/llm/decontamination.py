"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash over its word shingles, weighted by how
often each occurs. In a document, windows of the items' sizes slide over its
shingles; those that hold too few shingles of any item to reach the threshold are
passed over (that loses nothing), the others get a SimHash. A multi-index of the
items' fingerprints in five blocks, each filed under all values within three bits,
finds every item within RADIUS = 19 bits: of 19 wrong bits, some block has three at
most. Exact weighted-shingle similarity, sum of least weights over sum of greatest,
verifies the candidates.

Items come to the tasks in blocks of ITEM_BLOCK, one pass each, so what is broadcast
is bounded whatever the benchmark's size.

Cases: null or wordless texts and items match nothing; items of fewer than five
words have one shingle of all their words; items of one id and different texts are each
reported, rows equal in both are one item; of windows of one similarity the first is
told; repeated rows of docs are each judged; whole texts are searched, however long;
rows of a null item_id are left out; empty tables give an empty result; other columns
are ignored by find_leaks and kept by without_leaks, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import read
from landloom.llm.shingles import SHINGLE_WORDS, Words, mix, shingles

THRESHOLD = 0.8
#: Bits of the five blocks and the radius within which nothing is missed.
BLOCKS, BLOCK_RADIUS = (13, 13, 13, 13, 12), 3
RADIUS = len(BLOCKS) * (BLOCK_RADIUS + 1) - 1
#: Items in one pass over the documents.
ITEM_BLOCK = 4_000

_BITS = np.arange(64, dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """SimHash of shingles given with repeats, which weighs them by their count."""
    bits = (mix(hashes)[:, None] >> _BITS) & np.uint64(1)
    up = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int((up.astype(np.uint64) << _BITS).sum())


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of greatest counts of two bags of shingles."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = np.minimum(ca[ia], cb[ib]).sum()
    return float(shared / (len(a) + len(b) - shared))


class ItemIndex:
    """Items with shingles of k words: their bags, and fingerprints filed by block value."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.items = items
        self.sizes = sorted({len(s) for _, s in items})
        self.known = np.unique(np.concatenate([s for _, s in items]))
        #: Which sizes of item hold a shingle.
        self.held_by = np.zeros((len(self.known), len(self.sizes)), bool)
        for _, s in items:
            self.held_by[np.searchsorted(self.known, s), self.sizes.index(len(s))] = True
        self.prints = np.array([simhash(s) for _, s in items], np.uint64)
        self.files, shift = [], 0
        for bits in BLOCKS:
            flips = np.array([sum(1 << i for i in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(bits), r)], np.uint64)
            values = (((self.prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1))[:, None] ^ flips).astype(np.int64)
            owners = np.repeat(np.arange(len(items)), len(flips))
            order = np.argsort(values.ravel(), kind="stable")
            starts = np.searchsorted(values.ravel()[order], np.arange((1 << bits) + 1))
            self.files.append((shift, (1 << bits) - 1, owners[order].astype(np.int32), starts))
            shift += bits

    def near(self, fingerprint: int) -> np.ndarray:
        """Items within RADIUS bits."""
        found = [owners[starts[v := (fingerprint >> shift) & mask] : starts[v + 1]] for shift, mask, owners, starts in self.files]
        owners = np.unique(np.concatenate(found))
        return owners[np.bitwise_count(self.prints[owners] ^ np.uint64(fingerprint)) <= RADIUS]

    def leaks(self, grams: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """Best window by item (its place in items): similarity, start, shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = self.known[at] == grams
        if not hit.any():
            return best
        places = np.flatnonzero(hit)
        holders = self.held_by[at[places]]
        seen: dict[bytes, list[tuple[int, float]]] = {}
        for number in np.flatnonzero(holders.sum(0) >= threshold * np.array(self.sizes) - 1e-9).tolist():
            size = self.sizes[number]
            n = min(size, len(grams))
            of_size = np.zeros(len(grams) + 1, np.int64)
            of_size[places + 1] = holders[:, number]
            sums = np.cumsum(of_size)
            held = sums[n:] - sums[:-n]
            for start in np.flatnonzero(held >= threshold * size - 1e-9).tolist():
                window = grams[start : start + n]
                key = window.tobytes()
                if key not in seen:
                    seen[key] = [(int(i), s) for i in self.near(simhash(window)) if (s := weighted_similarity(window, self.items[i][1])) >= threshold]
                for i, s in seen[key]:
                    if i not in best or s > best[i][0]:
                        best[i] = (s, start, n)
        return best


def _index_passes(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[Broadcast]:
    """The items' indexes by words of a shingle, one broadcast for each block of items."""
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    passes = -(-items.count() // ITEM_BLOCK)
    for number in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number) if passes > 1 else items
        words, by_k = Words(), {}
        for r in block.collect():
            w = words(r["text"])
            if len(w):
                by_k.setdefault(min(SHINGLE_WORDS, len(w)), []).append((r["item_id"], shingles(w)))
        if by_k:
            yield benchmark.sparkSession.sparkContext.broadcast({k: ItemIndex(v) for k, v in sorted(by_k.items())})


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs and item it leaks: doc_id, item_id, similarity, start (first word of the best window), n_words."""
    schema = "doc_id long, item_id long, similarity double, start int, n_words int"
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _index_passes(benchmark, item_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, indexes = Words(), shared.value
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    w = words(text)
                    for k, index in indexes.items():
                        if len(w) >= k:
                            rows += [(doc, index.items[i][0], s, start, n + k - 1) for i, (s, start, n) in index.leaks(shingles(w, k), threshold).items()]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "similarity", "start", "n_words"])

        out = out.union(texts.mapInArrow(search, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that leak no item, each judged by its own text, whatever its id."""
    for shared in _index_passes(benchmark, item_col, item_text_col):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, indexes = Words(), shared.value
            for batch in batches:
                clean = []
                for text in batch[text_col].to_pylist():
                    w = words(text)
                    clean.append(not any(len(w) >= k and index.leaks(shingles(w, k), threshold) for k, index in indexes.items()))
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES: dict[str, str] = {}
