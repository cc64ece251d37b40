"""The ledger: one header row per transaction plus long tables of spends and receipts.

``tx``        tx_id, ts, label, ...           one row per transaction
``spends``    address, tx_id, pos, amount_sats, ts
``receipts``  address, tx_id, pos, amount_sats, ts, is_exchange
``sides``     per-transaction totals and the chosen change output

A ledger comes either from transactions that carry their inputs and outputs as arrays (the sides are
then computed inside the row, without a shuffle) or from long tables (then by partial aggregation).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.functions import normalize as N
from coinweave.session import materialize


@dataclass(frozen=True)
class Ledger:
    tx: DataFrame
    spends: DataFrame
    receipts: DataFrame
    sides: DataFrame

    def materialized(self) -> "Ledger":
        return replace(
            self,
            **{n: materialize(getattr(self, n), n) for n in ("tx", "spends", "receipts", "sides")},
        )


def change_score(address: Column, amount: Column, first_input: Column, reused: Column) -> Column:
    """Same script as the first input, plus an amount that is not a multiple of 0.01 BTC, minus reuse."""
    btc = N.sats_to_btc(amount)
    same_script = (N.script_type(address) == N.script_type(F.coalesce(first_input, F.lit("")))).cast("int")
    odd_amount = (F.abs(btc - F.round(btc, 2)) > 0.00000001).cast("int")
    return same_script + odd_amount - reused.cast("int")


def change_output(inputs: Column, outputs: Column) -> Column:
    """Most likely change address of one transaction, null with fewer than two outputs. In-row."""
    first = F.get(inputs, F.lit(0))["address"]
    ranked = F.transform(
        outputs,
        lambda o: F.struct(
            change_score(
                o["address"], o["amount_sats"], first, F.exists(inputs, lambda i: i["address"] == o["address"])
            ).alias("score"),
            o["amount_sats"].alias("amount_sats"),
            o["address"].alias("address"),
        ),
    )
    return F.when(F.size(outputs) >= 2, F.array_max(ranked)["address"])


def address_reuse(inputs: Column, outputs: Column) -> Column:
    """Sorted distinct input addresses that are also outputs."""
    return F.array_sort(F.array_intersect(inputs["address"], outputs["address"]))


def terminal_exchange(outputs: Column, exchange_addresses: Column) -> Column:
    return F.coalesce(F.arrays_overlap(outputs["address"], exchange_addresses), F.lit(False))


def base_features(total_in: Column, total_out: Column, n_in: Column, n_out: Column) -> dict[str, Column]:
    fee = F.greatest(total_in - total_out, F.lit(0).cast("bigint"))
    return {
        "tx_volume": N.sats_to_btc(total_in),
        "fee_ratio": fee.cast("double") / F.greatest(total_in, F.lit(1).cast("bigint")).cast("double"),
        "input_count": n_in.cast("double"),
        "output_count": n_out.cast("double"),
    }


_SIDE_COLUMNS = [
    "tx_id", "n_in", "n_out", "total_in", "total_out", "smallest_output", "first_input", "only_input",
    "change_address", "reused", "change_spent", "terminal_exchange", "pair_overlap",
]


def from_transactions(tx: DataFrame) -> Ledger:
    """Long tables and sides of transactions with ``inputs`` / ``outputs`` / ``exchange_addresses`` arrays."""
    change = change_output(F.col("inputs"), F.col("outputs"))
    reuse = address_reuse(F.col("inputs"), F.col("outputs"))
    count_in = lambda side, a: F.size(F.filter(side, lambda s: s["address"] == a))
    sides = tx.select(
        "tx_id",
        F.size("inputs").alias("n_in"),
        F.size("outputs").alias("n_out"),
        N.total(F.col("inputs.amount_sats")).alias("total_in"),
        N.total(F.col("outputs.amount_sats")).alias("total_out"),
        F.array_min("outputs.amount_sats").alias("smallest_output"),
        F.get("inputs", F.lit(0))["address"].alias("first_input"),
        F.when(F.size("inputs") == 1, F.get("inputs", F.lit(0))["address"]).alias("only_input"),
        change.alias("change_address"),
        (F.size(reuse) > 0).alias("reused"),
        F.coalesce(F.array_contains(F.col("inputs.address"), change), F.lit(False)).alias("change_spent"),
        terminal_exchange(F.col("outputs"), F.col("exchange_addresses")).alias("terminal_exchange"),
        # Wallets on both sides: how many of the parallel links coincide when directions are ignored.
        F.aggregate(
            reuse,
            F.lit(0),
            lambda acc, a: acc + F.least(count_in(F.col("inputs"), a), count_in(F.col("outputs"), a)),
        ).alias("pair_overlap"),
    )
    spends = tx.select("tx_id", "ts", F.posexplode("inputs").alias("pos", "s")).select(
        F.col("s.address").alias("address"), "tx_id", F.col("pos").cast("bigint").alias("pos"),
        F.col("s.amount_sats").alias("amount_sats"), "ts",
    )
    receipts = tx.select("tx_id", "ts", "exchange_addresses", F.posexplode("outputs").alias("pos", "s")).select(
        F.col("s.address").alias("address"), "tx_id", F.col("pos").cast("bigint").alias("pos"),
        F.col("s.amount_sats").alias("amount_sats"), "ts",
        F.coalesce(F.array_contains("exchange_addresses", F.col("s.address")), F.lit(False)).alias("is_exchange"),
    )
    return Ledger(tx, spends, receipts, sides.select(*_SIDE_COLUMNS))


def pair_counts(spends: DataFrame, receipts: DataFrame) -> DataFrame:
    """Links per (tx, wallet) in each direction; repeated pairs collapse map-side."""
    one, zero = F.lit(1), F.lit(0)
    both = spends.select("tx_id", "address", one.alias("i"), zero.alias("o")).unionAll(
        receipts.select("tx_id", "address", zero.alias("i"), one.alias("o"))
    )
    return both.groupBy("tx_id", "address").agg(F.sum("i").alias("n_spent"), F.sum("o").alias("n_received"))


def from_lines(tx: DataFrame, spends: DataFrame, receipts: DataFrame) -> Ledger:
    """Ledger over long tables; no transaction is ever gathered into an array."""
    pairs = pair_counts(spends, receipts)
    shared = pairs.filter("n_spent > 0 and n_received > 0")
    ins = spends.groupBy("tx_id").agg(
        F.count("*").cast("int").alias("n_in"),
        F.sum("amount_sats").alias("total_in"),
        F.min_by("address", F.struct("pos", "address")).alias("first_input"),
    )
    # Each distinct output of a transaction, with what the change rule needs to know about it.
    outs = receipts.join(ins.select("tx_id", "first_input"), "tx_id", "left").join(
        shared.select("tx_id", "address", F.lit(True).alias("__reused")), ["tx_id", "address"], "left"
    )
    reused = F.coalesce("__reused", F.lit(False))
    best = F.max(
        F.struct(
            change_score(F.col("address"), F.col("amount_sats"), F.col("first_input"), reused).alias("score"),
            "amount_sats", "address", reused.alias("reused"),
        )
    )
    outgo = outs.groupBy("tx_id").agg(
        F.count("*").cast("int").alias("n_out"),
        F.sum("amount_sats").alias("total_out"),
        F.min("amount_sats").alias("smallest_output"),
        F.max("is_exchange").alias("terminal_exchange"),
        best.alias("best"),
    )
    overlap = shared.groupBy("tx_id").agg(
        F.sum(F.least("n_spent", "n_received")).cast("int").alias("pair_overlap")
    )
    joined = tx.select("tx_id").join(ins, "tx_id", "left").join(outgo, "tx_id", "left").join(overlap, "tx_id", "left")
    zero = F.lit(0)
    picked = F.when(F.col("n_out") >= 2, F.col("best"))
    sides = joined.select(
        "tx_id",
        F.coalesce("n_in", zero).alias("n_in"),
        F.coalesce("n_out", zero).alias("n_out"),
        F.coalesce("total_in", zero.cast("bigint")).alias("total_in"),
        F.coalesce("total_out", zero.cast("bigint")).alias("total_out"),
        "smallest_output", "first_input",
        F.when(F.col("n_in") == 1, F.col("first_input")).alias("only_input"),
        picked["address"].alias("change_address"),
        (F.coalesce("pair_overlap", zero) > 0).alias("reused"),
        F.coalesce(picked["reused"], F.lit(False)).alias("change_spent"),
        F.coalesce("terminal_exchange", F.lit(False)).alias("terminal_exchange"),
        F.coalesce("pair_overlap", zero).alias("pair_overlap"),
    )
    return Ledger(tx, spends, receipts, sides.select(*_SIDE_COLUMNS))


def link_parents(tx: DataFrame) -> DataFrame:
    """Append the last output of every declared, existing parent to the child's inputs.

    A parent's output is skipped when its address is already an input (also one appended before it).
    The lookup carries one struct per declared parent; parents are unique by id."""
    last = F.element_at("outputs", -1)
    parents = tx.filter(F.size("outputs") > 0).select(F.col("tx_id").alias("__parent"), last.alias("__last"))
    wanted = tx.select("tx_id", F.posexplode("parent_tx_ids").alias("__pos", "__parent"))
    found = wanted.join(parents, "__parent")
    # One row per declared parent of a single input row, so a group is bounded by that row's own list.
    links = found.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("__pos", "__last"))).alias("__links"))
    appended = F.aggregate(
        F.col("__links.__last"),
        F.col("inputs"),
        lambda acc, x: F.when(F.exists(acc, lambda i: i["address"] == x["address"]), acc).otherwise(
            F.concat(acc, F.array(x))
        ),
    )
    return (
        tx.join(links, "tx_id", "left")
        .withColumn("inputs", F.when(F.col("__links").isNull(), F.col("inputs")).otherwise(appended))
        .drop("__links")
    )


def latest_receipt(receipts: DataFrame) -> DataFrame:
    """Per address the last receiving transaction in (time, id, position) order."""
    last = F.max_by(F.struct("tx_id", "amount_sats", "ts"), F.struct("ts", "tx_id", "pos"))
    return receipts.groupBy("address").agg(last.alias("r")).select(
        "address",
        F.col("r.tx_id").alias("parent_tx"),
        F.col("r.amount_sats").alias("parent_amount"),
        F.col("r.ts").alias("parent_ts"),
    )


def spenders(spends: DataFrame) -> DataFrame:
    return spends.select("address", "tx_id", "ts")


def tx_children(spends: DataFrame, latest: DataFrame) -> DataFrame:
    """(parent, child) per spend of an address that another transaction received last; duplicates kept.

    ``latest`` has one row per address, so a hot address only makes the spend side of the join large,
    which adaptive execution splits."""
    return (
        spends.join(latest, "address")
        .filter(F.col("tx_id") != F.col("parent_tx"))
        .select(F.col("parent_tx").alias("parent"), F.col("tx_id").alias("child"), "address",
                F.col("ts").alias("child_ts"), "parent_ts")
    )
