"""Per-transaction heuristics over the ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.operators.ledger import Ledger

# Default time windows in seconds and fan sizes.
PEEL_DELTA_SECONDS = 25
FAN_DELTA_SECONDS = 25
FAN_MANY = 5
FAN_FEW = 2


def micros(c):
    return F.unix_micros(c)


def parent_time_delta(children: DataFrame) -> DataFrame:
    """Smallest absolute distance in seconds to the latest receipt of any input (see ``tx_children``)."""
    gap = F.abs(micros(F.col("child_ts")) - micros(F.col("parent_ts")))
    return children.groupBy(F.col("child").alias("tx_id")).agg(
        (F.min(gap) / 1_000_000.0).alias("parent_time_delta")
    )


def _bucket(width: int):
    """Number of the time bucket; buckets of no width hold one microsecond."""
    return F.floor(micros(F.col("ts")) / F.lit(float(max(1, width)))).cast("bigint")


def spend_buckets(spends: DataFrame, width: int) -> DataFrame:
    """One row per (address, time bucket) that summarises the spends in it and in its two neighbours.

    Each spend bucket is reduced to its extremes before it is copied to the neighbouring buckets, so
    a wallet with any number of spends costs at most three rows per bucket."""
    bucket = _bucket(width)
    reduced = spends.groupBy("address", bucket.alias("b")).agg(
        F.min(micros(F.col("ts"))).alias("lo"),
        F.max(micros(F.col("ts"))).alias("hi"),
        F.min("tx_id").alias("tx_lo"),
        F.max("tx_id").alias("tx_hi"),
    )
    copied = reduced.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"))
    at = lambda shift, c: F.when(F.col("shift") == shift, F.col(c))
    return copied.groupBy("address", (F.col("b") + F.col("shift")).alias("bucket")).agg(
        F.max(at(1, "hi")).alias("before_hi"),
        F.min(at(-1, "lo")).alias("after_lo"),
        F.min(at(0, "tx_lo")).alias("same_tx_lo"),
        F.max(at(0, "tx_hi")).alias("same_tx_hi"),
    )


def rapid_context(
    candidates: DataFrame, ledger: Ledger, latest: DataFrame, delta_s: int = FAN_DELTA_SECONDS
) -> DataFrame:
    """True where a related transaction lies within ``delta_s`` seconds or none is related at all.

    Related are the latest receipts of the inputs and the spends of the outputs by other
    transactions. The receipt x spend pairs of a busy wallet are never formed: the nearest spends come
    from per-bucket extremes, and whether any other spender exists from two ids per address."""
    width = delta_s * 1_000_000
    ids = candidates.select("tx_id")
    own = F.col("tx_id")
    upstream = (
        ledger.spends.join(ids, "tx_id", "left_semi")
        .join(latest, "address")
        .filter(F.col("parent_tx") != own)
        .select(
            "tx_id",
            F.lit(True).alias("related"),
            (F.abs(micros(F.col("ts")) - micros(F.col("parent_ts"))) <= width).alias("near"),
        )
    )
    outputs = ledger.receipts.join(ids, "tx_id", "left_semi").select("address", "tx_id", "ts").distinct()
    now = micros(F.col("ts"))
    outputs = outputs.withColumn("bucket", _bucket(width))
    # Only spends of wallets that a candidate paid matter below.
    spends = ledger.spends.join(outputs.select("address").distinct(), "address", "left_semi")
    anyone = spends.groupBy("address").agg(F.min("tx_id").alias("any_lo"), F.max("tx_id").alias("any_hi"))
    other = lambda lo, hi: F.coalesce((F.col(lo) != own) | (F.col(hi) != own), F.lit(False))
    near = (
        F.coalesce(now - F.col("before_hi") <= width, F.lit(False))
        | F.coalesce(F.col("after_lo") - now <= width, F.lit(False))
        # The transaction's own spends share its timestamp, hence its bucket.
        | other("same_tx_lo", "same_tx_hi")
    )
    downstream = (
        outputs.join(anyone, "address")
        .filter(other("any_lo", "any_hi"))
        .join(spend_buckets(spends, width), ["address", "bucket"], "left")
        .select("tx_id", F.lit(True).alias("related"), near.alias("near"))
    )
    seen = upstream.unionAll(downstream).groupBy("tx_id").agg(F.max("near").alias("near"))
    return ids.join(seen, "tx_id", "left").select("tx_id", F.coalesce("near", F.lit(True)).alias("rapid"))


def fan_patterns(ledger: Ledger, latest: DataFrame, delta_s: int = FAN_DELTA_SECONDS) -> DataFrame:
    """``fan_out`` (one input, many outputs) and ``fan_in`` (many inputs, few outputs) members."""
    out_shape = (F.col("n_in") == 1) & (F.col("n_out") >= FAN_MANY)
    in_shape = (F.col("n_in") >= FAN_MANY) & (F.col("n_out") <= FAN_FEW)
    candidates = ledger.sides.filter(out_shape | in_shape).select(
        "tx_id", out_shape.alias("fan_out"), in_shape.alias("fan_in")
    )
    rapid = rapid_context(candidates, ledger, latest, delta_s)
    return candidates.join(rapid.filter("rapid"), "tx_id", "left_semi")


def fan_out(ledger: Ledger, latest: DataFrame, delta_s: int = FAN_DELTA_SECONDS) -> DataFrame:
    return fan_patterns(ledger, latest, delta_s).filter("fan_out").select("tx_id")


def fan_in(ledger: Ledger, latest: DataFrame, delta_s: int = FAN_DELTA_SECONDS) -> DataFrame:
    return fan_patterns(ledger, latest, delta_s).filter("fan_in").select("tx_id")


def tx_entity_ids(spends: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (tx_id, entity_id) of the inputs; ``entities`` has one row per address."""
    return spends.select("tx_id", "address").join(entities, "address").select("tx_id", "entity_id").distinct()


def reused_addresses(spends: DataFrame, receipts: DataFrame) -> DataFrame:
    """(tx_id, address) pairs on both sides of one transaction, from long tables."""
    return spends.select("tx_id", "address").intersect(receipts.select("tx_id", "address"))
