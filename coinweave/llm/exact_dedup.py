"""Exact dedup of a batch against immutable snapshots, screened by static binary-fuse filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.llm.common import mix, ship, without_white_space
from coinweave.session import materialize

#: Digests a filter holds on average; a filter is about 1.2 bytes a digest.
SHARD_KEYS = 2048


def _slots(keys: np.ndarray, seed: int, segment: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots, in neighbouring segments, and the 8-bit fingerprint of each key."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed))
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Binary-fuse filter (Graf and Lemire, 2022) of distinct 64-bit keys: (seed, segment length, start
    segments, fingerprints). Keys are peeled in rounds: slots that one key touches give up that key."""
    n = len(keys)
    if n == 0:
        return 0, 1, 1, bytes(3)
    segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    seed = 0
    while True:
        count = max(1, -(-int(n * factor) // segment) - 2 + seed // 8)
        slots, prints = _slots(keys, seed, segment, count)
        size = (count + 2) * segment
        degree = np.bincount(slots.ravel(), minlength=size)
        keys_of = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(keys_of, row, np.arange(n))
        alive, layers = np.ones(n, bool), []
        while True:
            free = np.flatnonzero(degree == 1)
            if not len(free):
                break
            owner, where = np.unique(keys_of[free], return_index=True)
            layers.append((owner, free[where]))
            alive[owner] = False
            for row in slots[:, owner]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(keys_of, row, owner)
        if not alive.any():
            break
        seed += 1
    table = np.zeros(size, np.uint8)
    for owner, slot in reversed(layers):
        table[slot] = 0
        a, b, c = slots[:, owner]
        table[slot] = prints[owner] ^ table[a] ^ table[b] ^ table[c]
    return seed, segment, count, table.tobytes()


def fuse_probe(keys: np.ndarray, seed: int, segment: int, count: int, table: bytes) -> np.ndarray:
    """True for every key of the filter and for about one in 256 others."""
    data = np.frombuffer(table, np.uint8)
    (a, b, c), prints = _slots(keys, seed, segment, count)
    return (data[a] ^ data[b] ^ data[c]) == prints


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, segment, count, table = fuse_build(pdf["h"].to_numpy().view(np.uint64))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "segment": [segment], "starts": [count], "bits": [table]})


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(keys) or not len(filters):
        return keys[["h"]].iloc[:0]
    f = filters.iloc[0]
    return keys.loc[fuse_probe(keys["h"].to_numpy().view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["starts"]), f["bits"]), ["h"]]


def snapshot_filters(digests: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) of a snapshot's distinct digests ``h``: one small filter for each shard of them."""
    sharded = digests.select("h").distinct().withColumn("shard", F.pmod("h", F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(_build, "shard long, seed long, segment long, starts long, bits binary")


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The distinct digests ``h`` that the filters may hold: all that they hold, and few others. Repeated
    digests are merged before the shuffle, so a hot digest is one row."""
    sharded = digests.select("h").distinct().withColumn("shard", F.pmod("h", F.lit(shards)))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_probe, "h long")


def exact_dedup(docs: DataFrame, in_snapshot: Column, digest=F.xxhash64, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, keep_id, group_size, kept,
    text_sha256, origin, text_hash (of the original text; with the id it names the row).

    Rows with ``in_snapshot`` form the immutable snapshot, the others the incoming batch. Each side's
    duplicates are grouped among themselves. The snapshot's digests become binary-fuse filters, and the
    batch's groups are routed by them: positives are joined with the snapshot's exact buckets and share their
    keeper and size there; negatives, and positives that the join finds false, stay groups of the batch.
    Groups of two rows or more are checked by the bytes of their normalised texts (white space deleted), so
    a weak digest costs time and never merges two texts.

    Of equal texts the one with most code points in the original, then the smallest doc_id (null last)
    stays, of identical rows one. Null text counts as empty; an empty table gives no rows. ``origin`` says
    where the group lives: snapshot, both or batch. A group of any size is aggregated before the shuffle
    and joined back as the skewed side of a join that has one row per group."""
    ship(docs.sparkSession)
    base = docs.select(
        F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.coalesce(in_snapshot, F.lit(False)).alias("snap")
    ).withColumn("norm", without_white_space(F.col("t")))
    keyed = base.select("doc_id", "snap", "norm", digest("norm").cast("bigint").alias("h"), F.xxhash64("t").alias("text_hash"), F.sha2("norm", 256).alias("sha"), F.char_length("t").alias("chars"))
    # The number tells identical rows apart; it is stored once, so a task that runs again reads the same one.
    slim = materialize(keyed.drop("norm").withColumn("row", F.monotonically_increasing_id()), "digests")

    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("row").alias("k"))).alias("best")
    sides = materialize(slim.groupBy("h", "sha", "snap").agg(best, F.count("*").alias("size")), "sides")
    old, new = sides.filter("snap").drop("snap"), sides.filter("NOT snap").drop("snap")

    shards = max(1, math.ceil(old.count() / shard_keys))
    maybe = materialize(screen(new, materialize(snapshot_filters(old, shards), "filters"), shards), "maybe")
    routed = new.join(maybe.withColumn("positive", F.lit(True)), "h", "left")
    buckets = old.withColumnsRenamed({"best": "old_best", "size": "old_size"})
    met = materialize(routed.filter("positive").drop("positive").join(buckets, ["h", "sha"], "left"), "met")
    both = met.select("h", "sha", F.least("best", F.coalesce("old_best", "best")).alias("best"), (F.col("size") + F.coalesce("old_size", F.lit(0))).alias("size"),
                      F.when(F.col("old_size").isNull(), F.lit("batch")).otherwise(F.lit("both")).alias("origin"))
    negatives = routed.filter("positive IS NULL").drop("positive").withColumn("origin", F.lit("batch"))
    alone = old.join(met.filter("old_size IS NOT NULL").select("h", "sha"), ["h", "sha"], "left_anti").withColumn("origin", F.lit("snapshot"))
    groups = materialize(both.unionByName(negatives).unionByName(alone), "groups")

    # Groups of one row need no byte check; of the others' texts there may be one for each SHA-256.
    texts = keyed.select("h", "sha", "norm").join(groups.filter("size > 1").select("h", "sha"), ["h", "sha"], "left_semi").groupBy("h", "sha", "norm").agg(F.lit(1).alias("one"))
    checked = texts.groupBy("h", "sha").agg(F.count("*").alias("texts")).select(
        "h", "sha", F.assert_true(F.col("texts") == 1, F.lit("two texts share a SHA-256 digest")).isNull().alias("same_bytes")
    )
    decided = groups.join(checked, ["h", "sha"], "left").filter("size = 1 OR same_bytes")
    return slim.join(decided, ["h", "sha"]).select(
        "doc_id", F.col("best.i").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.k")).alias("kept"),
        F.col("sha").alias("text_sha256"), "origin", "text_hash",
    )
