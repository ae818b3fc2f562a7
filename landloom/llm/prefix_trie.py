"""Trie of conversation prefixes: members, children, leaves and shared tokens of every prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import read, staged
from landloom.llm.tree_contraction import subtree_totals
from landloom.operators.ranking import ranked, running_totals

#: Turns that a conversation may take over from the first of its family, and conversations of a family.
MOST_HEAD, FAMILY = 8, 5


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, nth (from 1), digest of (role, text), bytes of the text. Turns stand in their order, null first; equal ones by digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return ranked(rows, ["conv_id"], ["turn", "digest"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns conv_id, depth, digest, bytes; convs conv_id, length) of conversations that begin as the first of their family does.

    A conversation's first h turns (its own are dropped) are those of conversation c - c % FAMILY; h is crc32(c) % (MOST_HEAD + 1).
    """
    sizes = staged(turns.groupBy("conv_id").agg(F.max("nth").alias("n")))
    c = F.col("conv_id")
    asked = sizes.select("conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % (MOST_HEAD + 1)).alias("h"), (c - c % FAMILY).alias("first"))
    held = asked.join(sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("of_first")), "first", "left")
    taken = F.least("h", F.coalesce("of_first", F.lit(0)))
    convs = staged(held.select("conv_id", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = turns.where(F.col("nth") <= MOST_HEAD).withColumnRenamed("conv_id", "first").join(convs, "first").where("nth <= taken").select("conv_id", F.col("nth").alias("depth"), "digest", "bytes")
    tails = turns.join(convs, "conv_id").where("nth > h").select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes")
    return heads.unionByName(tails), convs.select("conv_id", "length")


def _words(value: Column) -> list[Column]:
    """The four 32-bit words of an MD5 in hex."""
    return [F.conv(F.substring(value, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent (key of the prefix one shorter; null at the root), bytes of the last text, ends (whether the conversation ends here): one row for each prefix of each conversation.

    A prefix's key is its depth with the sums, over its turns, of a digest of (place, turn): sums that run over a conversation in
    any number of tasks, and that make equal prefixes, and only these, equal (128 bits).
    """
    told = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("digest")))
    rows = running_totals(turns.withColumn("own", told), ["conv_id"], ["depth"], {f"s{i}": w for i, w in enumerate(_words(F.col("own")))})
    sums, own = [F.col(f"s{i}") for i in range(4)], _words(F.col("own"))
    parent = _key(F.col("depth") - 1, [s - o for s, o in zip(sums, own, strict=True)])
    inner = rows.join(convs, "conv_id").select("conv_id", "depth", _key(F.col("depth"), sums).alias("key"), parent.alias("parent"), "bytes", (F.col("depth") == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return inner.unionByName(root)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of its conv_ids, comma-joined; rows come by (key, conv_id), so only the running hash is held."""
    key, running = None, hashlib.sha256()
    for batch in batches:
        keys, hashes = [], []
        for k, conv in zip(batch["key"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if k == key:
                running.update(b",")
            else:
                if key is not None:
                    keys.append(key)
                    hashes.append(running.hexdigest())
                key, running = k, hashlib.sha256()
            running.update(str(conv).encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ... without gaps), digest, bytes; convs: conv_id, length (0 for one without turns, which is a
    member of the root only). Leaves and saved bytes are summed over subtrees by tree contraction. A prefix's ending members are hashed
    in one stream (SHA-256 goes byte by byte), sorted by Spark and never held. No conversations give no rows, not even a root.
    """
    rows = staged(prefixes(turns, convs))
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    kids = F.coalesce("n_children", F.lit(0).cast("long"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = staged(staged(nodes).join(children, "key", "left").withColumn("n_children", kids))
    own = nodes.select(F.col("key").alias("id"), "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"]).withColumnRenamed("id", "key")
    ends = rows.where("ends").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_listed, "key binary, ends_sha256 string")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(totals, "key").join(ends, "key", "left").join(above, "parent", "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the rebuilt conversations. Rows without a conv_id belong to no conversation and are left out; null roles and texts are empty; repeated turns all count."""
    return prefix_trie(*rebuilt(numbered_turns(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
#: DuckDB: the table of CRC-32 as `crc(t)`, and a text's CRC-32 by it, byte by byte (texts of ASCII).
CRC_TABLE = "crc AS (SELECT list(list_reduce([i::UBIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, n: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    return f"xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(1, length({text}) + 1), lambda k: ascii(({text})[k])::UBIGINT), lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])))::BIGINT"


ORACLES = {
    "op11_prefix_trie": f"""WITH {CRC_TABLE}, own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
      sizes AS (SELECT conv_id, max(nth) AS n FROM own GROUP BY conv_id), asked AS (SELECT conv_id, n, conv_id - conv_id % {FAMILY} AS first, {crc_sql("conv_id::VARCHAR")} % {MOST_HEAD + 1} AS h FROM sizes, crc),
      convs AS (SELECT a.*, least(h, coalesce(f.n, 0)) AS taken FROM asked a LEFT JOIN sizes f ON f.conv_id = a.first),
      turns AS (SELECT c.conv_id, nth AS depth, role, text FROM convs c JOIN own o ON o.conv_id = c.first WHERE nth <= taken UNION ALL SELECT c.conv_id, nth - h + taken, role, text FROM convs c JOIN own o USING (conv_id) WHERE nth > h),
      pre AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS bytes FROM convs UNION ALL SELECT conv_id, depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth), strlen(text) FROM turns),
      told AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM pre),
      nodes AS (SELECT depth, k, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM told GROUP BY depth, k),
      kids AS (SELECT parent AS k, depth - 1 AS depth, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY ALL), full_ AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (k, depth)),
      sums AS (SELECT p.k, p.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * f.bytes)::BIGINT AS saved_tokens FROM full_ f JOIN pre p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL)
      SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM full_ f JOIN sums USING (k, depth) LEFT JOIN nodes u ON u.k = f.parent AND u.depth = f.depth - 1""",
}
