"""Removal of repeated byte strings by suffix arrays.

Every byte that a string of LENGTH bytes covers goes, if that string also starts
earlier (in a smaller doc_id, or earlier in the same document).

Strings that can repeat are found first. Of the GRAM-byte strings inside each
LENGTH-byte string the one with the least hash is its anchor; equal strings have
equal anchors, so each repeat shows as an anchor hash that two places share. The
bytes that an anchor stands for (all strings whose anchor it is) are its context.
Contexts are dealt by anchor hash; equal ones of a batch are reduced to the earliest
before that. Where an anchor has several different contexts, a task builds their suffix
array by two-stage sorting: suffixes smaller than their successors are sorted
directly, the rest is induced from them by one scan over the buckets of first
bytes. Neighbours with a common prefix of LENGTH bytes or more are repeats of the
earliest among them. Suffixes are sorted by their first LENGTH bytes and a few more,
which is all that repeats depend on.

An anchor with more than HOT_CONTEXTS different contexts is split: every string around
it holds either the bytes on its left up to half of what the string has besides, or
those on its right, so each context goes on in two parts under longer anchors, and the
parts are dealt anew. At most seven such rounds make the anchor the string itself,
whose contexts are all equal.

Cases: null counts as empty; texts under LENGTH bytes lose nothing; texts may be very
long (each is read whole by one task, time and memory grow with its length); a null
doc_id comes first; different texts under one doc_id are ordered by their MD5; rows
equal in doc_id and text are one document and each get its result; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.llm.common import read, staged
from landloom.llm.shingles import mix

LENGTH, GRAM = 100, 32
#: Different contexts of an anchor that one task sorts, and bytes of contexts sorted at once.
HOT_CONTEXTS, SORTED_BYTES = 1_000, 600_000
#: Texts whose contexts a worker holds at once.
CONTEXT_ROWS = 500

_FIRST = -(2**63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _packed(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as one big-endian number; zeros after the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x[:-step] = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x[: len(data)]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, and first and last start of the LENGTH-byte strings, of every anchor."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none
    x = _packed(np.frombuffer(data, np.uint8))
    h = mix(x[:-8] * _STEP + x[8:])
    h = mix(h[: len(data) - GRAM + 1] * _STEP + h[16 : 16 + len(data) - GRAM + 1])
    least, place = h, np.arange(len(h))
    span, width = 1, LENGTH - GRAM + 1
    while span < width:
        step = min(span, width - span)
        right = least[step:] <= least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        span += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]], place[first], first, np.concatenate([first[1:], [n]]) - 1


def two_stage_suffix_array(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the contexts in a row, each closed by a separator below all bytes (earlier ones below later ones);
    with it the eight bytes from each place on, zeros from its separator on, and how many bytes its context still has there."""
    lengths = np.array([len(c) for c in contexts])
    n = int(lengths.sum()) + len(contexts)
    text = np.zeros(n, np.int16)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1
    left = np.repeat(ends, lengths + 1) - np.arange(n)
    keys = _packed(np.where(inside, text - 1, 0).astype(np.uint8))
    short = left < 8
    keys[short] &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))) - np.uint64(1)) if short.any() else np.uint64(0)
    keys[left == 0] = 0

    # A suffix is smaller than its successor if at the first change of byte the text rises.
    rise = np.concatenate([text[:-1] < text[1:], [True]])
    flat = np.concatenate([text[:-1] == text[1:], [False]])
    change = np.where(flat, n - 1, np.arange(n))
    change = np.minimum.accumulate(change[::-1])[::-1]
    rising = rise[change] | ~inside
    done = np.flatnonzero(rising & inside)
    done = _sorted_by(done, keys, left, (text == 1).any())

    sizes = np.bincount(text, minlength=257)
    starts = np.cumsum(sizes) - sizes
    firsts = text[done]
    counts = np.bincount(firsts, minlength=257)
    array = np.full(n, -1, np.int64)
    array[: len(ends)] = ends
    array[(starts + sizes - counts)[firsts] + np.arange(len(done)) - (np.cumsum(counts) - counts)[firsts]] = done
    heads = starts.copy()
    heads[0] = len(ends)
    for c in np.flatnonzero(sizes).tolist():
        wave = array[starts[c] : heads[c]] if c else ends[:0]
        while len(wave):  # predecessors of the same letter stand in this bucket, behind those that are known
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            array[heads[c] : heads[c] + len(wave)] = wave
            heads[c] += len(wave)
        before = array[starts[c] : starts[c] + sizes[c]]
        before = before[before > 0] - 1
        letters = text[before]
        before, letters = before[letters > c], letters[letters > c]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        into = np.bincount(letters, minlength=257)
        array[heads[letters] + np.arange(len(letters)) - (np.cumsum(into) - into)[letters]] = before
        heads += into
    return array, keys, left


def _sorted_by(places: np.ndarray, keys: np.ndarray, left: np.ndarray, zeros: bool, most: int = LENGTH) -> np.ndarray:
    """The places (ascending) by the first bytes from there on, most and up to seven more; ties stay in order. zeros: whether the bytes hold zeros, which only the bytes left tell from an end."""
    tie = lambda rest: (np.minimum(rest, 8),) if zeros else ()
    order = np.lexsort((*tie(left[places]), keys[places])) if zeros else np.argsort(keys[places], kind="stable")
    done = places[order]
    group = np.zeros(len(done), np.int64)
    active, depth, n = np.arange(len(done)), 0, len(keys)
    while True:
        at, rest = done[active] + depth, np.maximum(left[done[active]] - depth, 0)
        k = np.where(rest > 0, keys[np.minimum(at, n - 1)], 0)
        if depth:
            sort = np.lexsort((*tie(rest), k, group[active]))
            done[active] = done[active][sort]
            k, rest = k[sort], rest[sort]
        g, r = group[active], np.minimum(rest, 8)
        new = np.ones(len(active), bool)
        new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        alone = new & np.concatenate([new[1:], [True]])[: len(new)]
        active = active[~alone & (rest > 8)]
        depth += 8
        if not len(active) or depth >= most:
            return done


def common_prefixes(array: np.ndarray, keys: np.ndarray, left: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the array, most at most."""
    a, b = array[:-1], array[1:]
    limit = np.minimum(np.minimum(left[a], left[b]), most)
    shared = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for depth in range(0, most, 8):
        open_ = open_[limit[open_] > depth]
        x = keys[a[open_] + depth] ^ keys[b[open_] + depth]
        same = np.full(len(x), 8)
        for byte in range(8):
            same = np.minimum(same, np.where((x >> np.uint64(8 * (7 - byte))) & np.uint64(255), byte, 8))
        shared[open_] += same
        open_ = open_[same == 8]
    return np.concatenate([[0], np.minimum(shared, limit)])


def repeated_starts(contexts: list[bytes], heads: list[tuple]) -> list[np.ndarray]:
    """Of each context the offsets of the strings that some context has earlier. heads: (first doc_id, key, start of the context)."""
    array, keys, left = two_stage_suffix_array(contexts)
    array_of = array[left[array] >= LENGTH]
    where = np.cumsum([0] + [len(c) + 1 for c in contexts])
    owner = np.searchsorted(where, array_of, "right") - 1
    prefix = common_prefixes(array_of, keys, left)
    group = np.cumsum(prefix < LENGTH) - 1
    docs = {d: i for i, d in enumerate(sorted({h[:2] for h in heads}))}
    doc = np.array([docs[h[:2]] for h in heads])[owner]
    start = np.array([h[2] for h in heads])[owner] + array_of - where[owner]
    order = np.lexsort((start, doc, group))
    heads_of = order[np.searchsorted(group[order], group[order])]
    hit = order[(doc[order] != doc[heads_of]) | (start[order] != start[heads_of])]
    offsets, whose = (array_of - where[owner])[hit], owner[hit]
    sort = np.lexsort((offsets, whose))
    offsets = offsets[sort]
    cuts = np.searchsorted(whose[sort], np.arange(len(contexts) + 1)).tolist()
    return [offsets[cuts[i] : cuts[i + 1]] for i in range(len(contexts))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges that strings from the starts (ascending) cover, those next to each other joined."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + LENGTH).tolist(), strict=True))


def _anchored(docs: DataFrame) -> DataFrame:
    """deal, known, key, pos of every anchor, copies of a text in one batch once.

    An anchor that a batch holds several times is known to be shared there: one of its
    rows goes on under the anchor's hash and speaks for all in other batches, the rest
    is dealt out at random. So no hash has more rows to itself than there are batches.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {key: i for i, key in enumerate(batch["key"].to_pylist())}
            texts = batch["text"].cast(pa.binary())
            found = [(i, *anchors(texts[i].as_py())[:2]) for i in at.values()]
            fp, pos = np.concatenate([f for _, f, _ in found]), np.concatenate([p for _, _, p in found])
            row = np.repeat([i for i, _, _ in found], [len(f) for _, f, _ in found])
            order = np.argsort(fp, kind="stable")
            ranked = fp[order]
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(fp)]
            known = np.empty(len(fp), bool)
            known[order] = ~new | np.concatenate([~new[1:], [False]])[: len(fp)]
            extra = order[~new]
            fp[extra] = mix(fp[extra] + mix(pos[extra].astype(np.uint64) * _STEP + row[extra].astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(known), batch["key"].take(pa.array(row)), pa.array(pos.astype(np.int32))], ["deal", "known", "key", "pos"])

    return docs.select("key", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(make, "deal long, known boolean, key binary, pos int")


_CONTEXT = pa.schema([("deal", pa.int64()), ("ctx", pa.binary()), ("first", pa.int64()), ("key", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()), ("at", pa.int32()), ("size", pa.int32())])
_CONTEXT_DDL = "deal long, ctx binary, first long, key binary, start int, stop int, at int, size int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_CONTEXT), _CONTEXT, strict=True)], schema=_CONTEXT)


def _merged(dropped: dict[tuple, list]) -> list[tuple]:
    """Rows without a context of ranges by (first, key), those that overlap made one, dealt at random."""
    rows = []
    for (first, key), ranges in dropped.items():
        ranges.sort()
        start, stop = ranges[0]
        for a, b in [*ranges[1:], (2**31, 0)]:
            if a > stop:
                rows.append((hash((key, start)), None, first, key, start, stop, None, None))
                start, stop = a, b
            elif b > stop:
                stop = b
    return rows


def halves(ctx: bytes, at: int, size: int) -> list[tuple[int, int, int, int]]:
    """A context whose strings all hold the size bytes at `at`, in two: (start, stop, at, size), offsets in ctx, of the strings that hold what lies left of those bytes too, and of the others, which hold what lies right of them."""
    slack = LENGTH - size
    half = -(-slack // 2)
    last = len(ctx) - LENGTH
    cut = min(last, at - half)
    left = [(0, cut + LENGTH, at - half, size + half)] if cut >= 0 else []
    right = [(cut + 1, len(ctx), at, size + slack - half + 1)] if cut < last else []
    return left + [(max(0, a), b, c, d) for a, b, c, d in right]


def _contexts(texts: DataFrame) -> DataFrame:
    """deal, ctx, first, key, start, stop, at, size: the context of every wanted anchor (size bytes at `at`), dealt by its hash. texts: first, key, text, places.

    Of equal contexts in a batch the earliest goes on; the others are repeats at once: ranges without a context, merged and dealt at random.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, CONTEXT_ROWS) for whole in batches for i in range(0, whole.num_rows, CONTEXT_ROWS)):
            earliest: dict[tuple[int, bytes], tuple] = {}
            dropped: dict[tuple, list] = {}
            for first, key, data, places in zip(batch["first"].to_pylist(), batch["key"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["places"].to_pylist(), strict=True):
                fps, at, lo, hi = anchors(data)
                keep = np.isin(at, places)
                for fp, p, a, b in zip(fps[keep].view(np.int64).tolist(), at[keep].tolist(), lo[keep].tolist(), (hi[keep] + LENGTH).tolist(), strict=True):
                    own = (first, key, a, b, p - a)
                    name = (fp, data[a:b])
                    held = earliest.setdefault(name, own)
                    if held != own:
                        if own < held:
                            earliest[name], own = own, held
                        dropped.setdefault(own[:2], []).append(own[2:4])
            yield _batch([(fp, ctx, *own, GRAM) for (fp, ctx), own in earliest.items()] + _merged(dropped))

    return texts.mapInArrow(make, _CONTEXT_DDL)


def _repeats(contexts: DataFrame) -> DataFrame:
    """Ranges that repeat, by suffix arrays: rows without a context (key, start, stop); with one: parts of the contexts of an anchor with very many, under longer anchors.
    contexts: all of an anchor in one partition and in a row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts: list[bytes] = []
        rows: list[tuple] = []
        group: dict[bytes, tuple] = {}
        out: list[tuple] = []
        dropped: dict[tuple, list] = {}
        held, n_dropped, hot = 0, 0, False

        def close() -> None:
            """The group ends: to the contexts to be sorted, if it has several."""
            nonlocal held
            if len(group) > 1:
                contexts.extend(group)
                rows.extend(group.values())
                held += sum(map(len, group))
            group.clear()

        def split() -> None:
            for ctx, (first, key, start, _, at, size) in group.items():
                for a, b, c, d in halves(ctx, at, size):
                    deal = int.from_bytes(hashlib.blake2b(ctx[c : c + d], digest_size=8).digest(), "little", signed=True)
                    out.append((deal, ctx[a:b], first, key, start + a, start + b, c - a, d))
            group.clear()

        def told() -> pa.RecordBatch:
            nonlocal held, n_dropped
            if rows:
                for (first, key, start, *_), starts in zip(rows, repeated_starts(contexts, rows), strict=True):
                    if len(starts):
                        dropped.setdefault((first, key), []).extend((start + a, start + b) for a, b in _runs(starts))
            out.extend(_merged(dropped))
            batch = _batch(out)
            contexts.clear(), rows.clear(), dropped.clear(), out.clear()
            held = n_dropped = 0
            return batch

        last = None
        for batch in batches:
            columns = [batch[c].to_pylist() for c in _CONTEXT.names]
            for deal, ctx, own in zip(*columns[:2], zip(*columns[2:], strict=True), strict=True):
                if ctx is None:
                    dropped.setdefault((own[0], own[1]), []).append((own[2], own[3]))
                    n_dropped += 1
                else:
                    if deal != last:
                        close()
                        last, hot = deal, False
                        if held > SORTED_BYTES:
                            yield told()
                    earliest = group.setdefault(ctx, own)
                    if earliest != own:
                        if own < earliest:
                            group[ctx], own = own, earliest
                        dropped.setdefault((own[0], own[1]), []).append((own[2], own[2] + len(ctx)))
                        n_dropped += 1
                    if hot or len(group) > HOT_CONTEXTS:
                        split()
                        hot = True
                if len(out) + n_dropped > 30_000:
                    yield told()
        close()
        yield told()

    return contexts.mapInArrow(make, _CONTEXT_DDL)


def _kept(texts: DataFrame) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 and kept (the remaining bytes). texts: key, text, ranges."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data, ranges in zip(batch["key"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["ranges"].to_pylist(), strict=True):
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, [r["start"] for r in ranges], 1)
                np.add.at(edges, [r["stop"] for r in ranges], -1)
                gone = np.cumsum(edges[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((key, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            names, kinds = ["key", "n_removed", "n_spans", "kept_sha256", "kept"], (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names)

    return texts.mapInArrow(make, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, null where the text stays whole)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(_FIRST)).alias("rank"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    earliest = texts.groupBy("key").agg(F.min("rank").alias("first"))
    same = Window.partitionBy("deal")  # as many rows as there are batches at most
    several = lambda c: F.min(c).over(same) < F.max(c).over(same)
    shared = _anchored(texts).withColumn("met", several("key") | several("pos") | F.max("known").over(same)).where("met")
    places = shared.groupBy("key").agg(F.collect_set("pos").alias("places"))
    wanted = staged(places.join(earliest, "key"))
    chosen = staged(texts.join(wanted, "key").where("rank = first").select("key", "first", "text", "places"))
    dealt, ranges = _contexts(chosen), None
    while True:  # a round for each time that hot anchors are split, seven at most
        found = staged(_repeats(dealt.repartition("deal").sortWithinPartitions("deal")))
        told = found.where("ctx IS NULL").select("key", "start", "stop")
        ranges = ranges.union(told) if ranges else told
        dealt = found.where("ctx IS NOT NULL")
        if dealt.isEmpty():
            break
    found = _kept(chosen.select("key", "text").join(ranges.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")), "key"))
    found = found.dropDuplicates(["key"])
    whole = texts.select("doc_id", "rank", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    told = whole.join(earliest.join(found, "key", "left"), "key")
    copy = (F.col("rank") > F.col("first")) & (F.col("n_bytes") >= LENGTH)
    return told.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeats are removed."""
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
