"""Copies in an image column by local descriptors.

Corners (Harris) are found on a pyramid of scales, one for every CORNER_PIXELS pixels;
each gets the orientation of its patch's intensity centroid and BITS binary intensity
tests, turned by it. The two points of a test lie equally far along that orientation, so
that none of its answers is the likelier one. Hamming tables (TABLES keys of KEY_BITS
sampled bits for each descriptor) join images that agree on a key; of these pairs all
descriptors are matched, and a pair is linked if enough of the matches agree on one
scale, turn and shift (each match proposes one, the others vote). Classes are the
connected components of the links.

First the least keys of each table alone are asked, by which most copies of a large group find
their class; then all keys, but those that only images of one class have, since their
pairs would join nothing.

A key that up to SMALL_BUCKET images have pairs them all. One that more have pairs each
with its pivot, the image that most others meet; what then is not one class is compared in blocks, every image
outside the key's largest class with all members of other classes, so that no pair that
agrees on a key is passed over.

Cases: images equal in size and pixels are one class from the start; null or empty
pixels, or sizes that don't fit them, have no corner and are alike to equal ones
only; images smaller than a patch have no corner; pictures with a side over
MAX_SIDE are halved until it fits; ties between corners go to the upper, then the left one; rows
with a null id are left out; rows of one id with different pictures are pictures of their own, each with its class; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.classes import components, contracted, joined_in_blocks, joining, pivot_pairs
from landloom.llm.common import read, staged

#: Pixels for each corner, corners of the smallest pictures, longest side that is described, and scales of the pyramid.
CORNER_PIXELS, LEAST_CORNERS, MAX_SIDE, SCALES, STEP = 96, 12, 256, 3, 1.4
BITS, TABLES, KEY_BITS, RADIUS, TURNS = 256, 12, 40, 7, 32
MAX_HAMMING, SMALL_BUCKET = 48, 2
#: Matches that agree in a link: so many, and this share of the corners of the picture with fewer of them.
MIN_VOTES, VOTE_SHARE = 6, 0.1
#: Images of a block of a key's holders, and corners.
BLOCK_IMAGES, BLOCK_CORNERS = 64, 3_000
#: Pixels that a worker works on at once.
BATCH_PIXELS = 1_000_000

_rng = np.random.default_rng(17)
_across = _rng.uniform(-RADIUS, RADIUS, (BITS, 2))
_across[:, 1] = np.where(np.abs(_across[:, 0] - _across[:, 1]) < 2, -_across[:, 0], _across[:, 1])
_TESTS = np.stack([np.repeat(_rng.uniform(2 - RADIUS, RADIUS - 2, (BITS, 1)), 2, 1), _across], -1)
_angles = np.arange(TURNS) * 2 * np.pi / TURNS
_TURNED = np.clip(np.rint(np.stack([np.stack([_TESTS[..., 0] * np.cos(a) - _TESTS[..., 1] * np.sin(a), _TESTS[..., 0] * np.sin(a) + _TESTS[..., 1] * np.cos(a)], -1) for a in _angles])), -RADIUS - 1, RADIUS + 1).astype(int)
_SAMPLED = np.stack([_rng.choice(BITS, KEY_BITS, replace=False) for _ in range(TABLES)])
_DISC = np.array([(x, y) for x in range(-RADIUS, RADIUS + 1) for y in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS])


def resized(images: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resizing of a stack of images."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, images.shape[1]), (width, images.shape[2])))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, images.shape[1] - 1), np.minimum(x0 + 1, images.shape[2] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = images[:, y0][:, :, x0] * (1 - fx) + images[:, y0][:, :, x1] * fx
    return top * (1 - fy) + (images[:, y1][:, :, x0] * (1 - fx) + images[:, y1][:, :, x1] * fx) * fy


def _box(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), "edge")
    p = p[:, :-2] + p[:, 1:-1] + p[:, 2:]
    return p[:, :, :-2] + p[:, :, 1:-1] + p[:, :, 2:]


def describe(images: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Of each image of a stack (n, height, width): x, y (pixels of the described picture), scale, turn (radians) and bits of its corners, strongest first."""
    while max(images.shape[1:]) > MAX_SIDE and min(images.shape[1:]) > 1:
        images = images[:, : images.shape[1] // 2 * 2, : images.shape[2] // 2 * 2]
        images = (images[:, ::2, ::2] + images[:, 1::2, ::2] + images[:, ::2, 1::2] + images[:, 1::2, 1::2]) / 4
    found: list[list[tuple]] = [[] for _ in images]
    margin, corners = RADIUS + 2, max(LEAST_CORNERS, images.shape[1] * images.shape[2] // CORNER_PIXELS)
    for level in range(SCALES):
        scale = STEP**level
        height, width = round(images.shape[1] / scale), round(images.shape[2] / scale)
        if min(height, width) <= 2 * margin:
            break
        im = images if level == 0 else resized(images, height, width)
        smooth = _box(im) / 9
        gx, gy = np.zeros_like(smooth), np.zeros_like(smooth)
        gx[:, :, 1:-1], gy[:, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2], smooth[:, 2:] - smooth[:, :-2]
        xx, yy, xy = _box(gx * gx), _box(gy * gy), _box(gx * gy)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[:, margin - 1 : height - margin + 1, margin - 1 : width - margin + 1]
        core = inner[:, 1:-1, 1:-1]
        peak = core > 0
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    side = inner[:, dy : dy + core.shape[1], dx : dx + core.shape[2]]
                    peak &= core > side if (dy, dx) < (1, 1) else core >= side
        which, y, x = np.nonzero(peak)
        strength = core[which, y, x]
        order = np.lexsort((x, y, -strength, which))
        which, y, x, strength = which[order], y[order] + margin, x[order] + margin, strength[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        top = place < corners
        which, y, x, strength = which[top], y[top], x[top], strength[top]
        patch = im[which[:, None], y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
        turn = np.arctan2(patch @ _DISC[:, 1], patch @ _DISC[:, 0])
        tests = _TURNED[np.rint(turn / (2 * np.pi) * TURNS).astype(int) % TURNS]
        at = lambda k: smooth[which[:, None], y[:, None] + tests[:, :, k, 1], x[:, None] + tests[:, :, k, 0]]  # noqa: E731, B023
        bits = at(0) < at(1)
        for i, w in enumerate(which.tolist()):
            found[w].append((-strength[i] * scale, x[i] * scale, y[i] * scale, scale, turn[i], bits[i]))
    out = []
    for rows in found:
        rows = sorted(rows, key=lambda r: r[:4])[:corners]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        out.append({"x": np.array(cols[1]), "y": np.array(cols[2]), "scale": np.array(cols[3]), "turn": np.array(cols[4]), "bits": np.array(cols[5], bool).reshape(len(rows), BITS)})
    return out


def hamming_keys(bits: np.ndarray) -> np.ndarray:
    """Keys of every descriptor, one a table; the table stands in the high bits."""
    values = (bits[:, _SAMPLED] * (1 << np.arange(KEY_BITS, dtype=np.int64))).sum(2)
    return values + (np.arange(TABLES, dtype=np.int64) << KEY_BITS)


def agreeing(a: dict, b: dict) -> int:
    """Matches that agree on scale, turn and shift. a, b: geometry (n, 4: x, y, scale, turn) and words (n, BITS / 64)."""
    if not len(a["words"]) or not len(b["words"]):
        return 0
    distance = np.bitwise_count(a["words"][:, None] ^ b["words"][None]).sum(2, dtype=int)
    nearest = distance.argmin(1)
    i = np.flatnonzero((distance[np.arange(len(nearest)), nearest] <= MAX_HAMMING) & (distance.argmin(0)[nearest] == np.arange(len(nearest))))
    if len(i) < MIN_VOTES:
        return len(i)
    p, q = a["geometry"][i], b["geometry"][nearest[i]]
    turn, scale = q[:, 3] - p[:, 3], np.log(q[:, 2] / p[:, 2])
    c, d = np.exp(scale) * np.cos(turn), np.exp(scale) * np.sin(turn)
    moved = q[None, :, :2] - np.stack([c[:, None] * p[:, 0] - d[:, None] * p[:, 1], d[:, None] * p[:, 0] + c[:, None] * p[:, 1]], 2)
    own = moved[np.arange(len(i)), np.arange(len(i))]
    agree = (np.abs(scale - scale[:, None]) < 0.4) & (np.abs((turn - turn[:, None] + np.pi) % (2 * np.pi) - np.pi) < 0.4)
    return int((agree & (np.abs(moved - own[:, None]).max(2) < 5)).sum(1).max())


def _shape(geometry: bytes, words: bytes) -> dict:
    return {"geometry": np.frombuffer(geometry, np.float32).reshape(-1, 4), "words": np.frombuffer(words, np.uint64).reshape(-1, BITS // 64)}


def linked(a: dict, b: dict) -> bool:
    return agreeing(a, b) >= max(MIN_VOTES, VOTE_SHARE * min(len(a["words"]), len(b["words"])))


def block_links(xs: list[dict], ys: list[dict]) -> list[tuple[int, int]]:
    """Classes joined by links of images xs (outside the key's main class) with ys."""
    shapes = [[_shape(t["payload"]["geometry"], t["payload"]["words"]) for t in side] for side in (xs, ys)]
    pairs = [(x["root"], y["root"], (i, j)) for i, x in enumerate(xs) for j, y in enumerate(ys) if x["root"] != y["root"] and (y["root"] == y["main"] or x["rep"] < y["rep"])]
    return joining(pairs, lambda at: linked(shapes[0][at[0]], shapes[1][at[1]]))


def image_features(images: DataFrame) -> DataFrame:
    """image_id, keys, geometry and words (bytes) of the corners. images: image_id, width, height, pixels (8-bit grey)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stacks = defaultdict(list)
            for i, w, h, p in zip(*(batch[c].to_pylist() for c in ("image_id", "width", "height", "pixels")), strict=True):
                if p and w and h and w > 0 and h > 0 and w * h == len(p):
                    stacks[h, w].append((i, p))
            rows: list[tuple] = []
            for (h, w), held in stacks.items():
                step = max(1, BATCH_PIXELS // (h * w))
                for start in range(0, len(held), step):
                    part = held[start : start + step]
                    stack = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(len(part), h, w).astype(np.float64)
                    for (i, _), f in zip(part, describe(stack), strict=True):
                        if len(f["x"]):
                            geometry = np.stack([f["x"], f["y"], f["scale"], f["turn"]], 1).astype(np.float32)
                            rows.append((i, np.unique(hamming_keys(f["bits"])), geometry.tobytes(), np.packbits(f["bits"], 1).tobytes()))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["image_id", "keys", "geometry", "words"])

    return images.mapInArrow(make, "image_id long, keys array<long>, geometry binary, words binary")


def image_copies(images: DataFrame) -> DataFrame:
    """image_id, class_id (the least image_id of its class)."""
    pixel_key = F.md5(F.concat_ws(":", F.col("width"), F.col("height"), F.hex("pixels")))
    images = images.where("image_id IS NOT NULL").select("image_id", "width", "height", "pixels", pixel_key.alias("key"))
    table = staged(images.select("image_id", "key"))
    reps = staged(table.groupBy("key").agg(F.min("image_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()))  # different pictures are numbered
    firsts = images.join(reps, "key").where("image_id = least").dropDuplicates(["rep"])
    feats = staged(image_features(firsts.select(F.col("rep").alias("image_id"), "width", "height", "pixels")).withColumnRenamed("image_id", "rep"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [linked(_shape(*r[:2]), _shape(*r[2:])) for r in zip(*(batch[c].to_pylist() for c in ("ga", "wa", "gb", "wb")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(found, pa.bool_())], ["a", "b", "linked"])

    sides = [feats.select(F.col("rep").alias(c), F.col("geometry").alias(f"g{c}"), F.col("words").alias(f"w{c}")) for c in "ab"]

    def links(met: DataFrame) -> DataFrame:
        x, y = (met.where(F.col("n") <= SMALL_BUCKET).select("table_key", "root", F.col("rep").alias(c)) for c in "ab")
        pairs = x.join(y.withColumnRenamed("root", "other"), "table_key").where("a < b AND root <> other").select("a", "b").union(pivot_pairs(met, ["table_key"], SMALL_BUCKET)).distinct()
        judged = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "ga", "wa", "gb", "wb").mapInArrow(verify, "a long, b long, linked boolean")
        return staged(judged.where("linked").select("a", "b"))

    def mixed(entries: DataFrame) -> DataFrame:
        """entries (rep, root, table_key) of keys that images of several classes have, and how many images have the key."""
        crowds = entries.groupBy("table_key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("table_key", "n")
        return staged(entries.join(crowds, "table_key"))

    leads = F.filter("keys", lambda k, i: (i == 0) | (F.shiftright(k, KEY_BITS) != F.shiftright(F.get("keys", i - 1), KEY_BITS)))  # the least key of each table; keys are in order
    early = components(contracted(links(mixed(feats.select("rep", F.col("rep").alias("root"), F.explode(leads).alias("table_key"))))))
    so_far = feats.select("rep", "keys").join(early.withColumnRenamed("id", "rep"), "rep", "left")
    met = mixed(so_far.select("rep", F.coalesce("root", "rep").alias("root"), F.explode("keys").alias("table_key")))
    large = met.where(F.col("n") > SMALL_BUCKET).drop("root")
    roots = components(contracted(links(met).union(early.where("id <> root").select("root", "id"))))
    sizes = feats.select("rep", (F.octet_length("words") / (BITS // 8)).alias("size"))
    rooted = large.join(roots, F.col("rep") == F.col("id"), "left").select("table_key", "rep", F.coalesce("root", "rep").alias("root")).join(sizes, "rep")
    payloads = feats.select("rep", F.struct("geometry", "words").alias("payload"))
    joined = components(contracted(staged(joined_in_blocks(staged(rooted), payloads, ["table_key"], BLOCK_IMAGES, BLOCK_CORNERS, lambda _, xs, ys: block_links(xs, ys)))))
    classes = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("key", "least", F.coalesce("root", "rep").alias("id"))
    classes = staged(classes.join(joined, "id", "left").select("key", "least", F.coalesce("root", "id").alias("class")))
    named = classes.groupBy("class").agg(F.min("least").alias("class_id"))
    return table.join(classes.join(named, "class").select("key", "class_id"), "key").select("image_id", "class_id")


def pictures(vectors: DataFrame, tiles: int = 24, pixels: int = 2) -> DataFrame:
    """Grey pictures of vectors (vec_id, embedding): a square of tiles, each a fixed random mixture of the components. Vectors that are null or empty have no pixels."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixtures: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for v in batch["embedding"].to_pylist():
                if not v:
                    out.append(None)
                    continue
                if len(v) not in mixtures:
                    mixtures[len(v)] = np.random.default_rng(5).normal(size=(tiles * tiles, len(v)))
                shade = mixtures[len(v)] @ np.nan_to_num(np.array(v, float))
                low, high = shade.min(), shade.max()
                shade = np.rint((shade - low) / (high - low if high > low else 1) * 255).astype(np.uint8)
                out.append(shade.reshape(tiles, tiles).repeat(pixels, 0).repeat(pixels, 1).tobytes())
            size = pa.array([tiles * pixels] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], size, size, pa.array(out, pa.binary())], ["image_id", "width", "height", "pixels"])

    return vectors.select("vec_id", "embedding").mapInArrow(paint, "image_id long, width int, height int, pixels binary")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures of all embeddings (the tables hold no images of their own)."""
    return image_copies(pictures(read(spark, sf_dir, "embeddings")))


QUERIES = {"op6_media_columns": op6_media_columns}
ORACLES: dict[str, str] = {}
