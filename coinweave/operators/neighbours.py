"""Transactions that share a wallet, without forming every pair of a busy wallet.

For a transaction with wallets W the neighbours are the union of the wallets' transaction sets, minus
itself. Sums over that union are computed in two exact parts:

* light wallets (at most ``heavy_degree`` transactions): pairs within a wallet, at most ``heavy_degree``
  times the number of incidences, each counted at one wallet only and summed inside the join's task;
* heavy wallets: transactions with the same set of heavy wallets form one *unit*. For units with at
  most ``MAX_SUBSET`` heavy wallets the union is an inclusion-exclusion over subset sums, one aggregated
  row per subset and no pairs. Transactions with more heavy wallets are one unit if their sets are equal; the
  units such a wide unit meets are a bitmap over numbered units, the union of its wallets' bitmaps, and sums over
  them are products of bits and values. So wide sets make no pairs either.

A light pair that also shares a heavy wallet is dropped from the first part, so nothing counts twice.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.operators.ordering import row_number
from coinweave.session import materialize

HEAVY_DEGREE = 64
MAX_SUBSET = 8
MAX_LIGHT_SET = 32
#: Units to a bitmap (Spark's bitmap functions), and wide units that are multiplied with one bitmap's units at a time.
BITMAP_UNITS, WIDE_CHUNK = 32_768, 1024


def incidence(spends: DataFrame, receipts: DataFrame) -> DataFrame:
    """Distinct (address, tx_id) in any role."""
    return spends.select("address", "tx_id").unionAll(receipts.select("address", "tx_id")).distinct()


def neighbours_of(inc: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (tx_id, neighbour) for the requested transactions only: the answer's own size."""
    mine = inc.join(roots.select("tx_id").distinct(), "tx_id", "left_semi")
    theirs = inc.select("address", F.col("tx_id").alias("neighbour"))
    return mine.join(theirs, "address").filter(F.col("tx_id") != F.col("neighbour")).select(
        "tx_id", "neighbour"
    ).distinct()


def _subsets(wallets: Column) -> Column:
    """All non-empty subsets of a short sorted array."""
    return F.filter(
        F.aggregate(
            wallets,
            F.array(F.array().cast("array<string>")),
            lambda acc, w: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(w)))),
        ),
        lambda s: F.size(s) > 0,
    )


class Links(NamedTuple):
    """What the sums need to know about an incidence table, independent of the summed values."""

    light: DataFrame
    sets: DataFrame
    unit_wallets: DataFrame | None
    #: (unit, n, wide): all units numbered, and (unit, n, bucket, bitmap): the units each wide unit shares a wallet with.
    numbers: DataFrame | None
    meets: DataFrame | None
    has_long: bool


def prepare_links(inc: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> Links:
    # A wallet seen once links nobody. The degree table has one row per wallet, so a busy wallet is
    # large on one side of this join only.
    inc = materialize(inc, "incidence")
    degrees = inc.groupBy("address").agg(F.count("*").alias("degree")).filter("degree > 1")
    linked = materialize(
        inc.join(degrees, "address").select("tx_id", "address", (F.col("degree") > heavy_degree).alias("heavy")),
        "linked",
    )
    sizes = linked.groupBy("tx_id").agg(
        F.sum((~F.col("heavy")).cast("int")).alias("n_light"), F.sum(F.col("heavy").cast("int")).alias("n_heavy"), *_set_digest()
    )
    most = sizes.agg(F.max("n_light").alias("light"), F.max("n_heavy").alias("heavy")).head()
    has_long, has_wide = (most["light"] or 0) > MAX_LIGHT_SET, (most["heavy"] or 0) > MAX_SUBSET
    sets = materialize(_tx_sets(linked, sizes, has_long or has_wide), "sets")
    light = linked.filter("not heavy").select("tx_id", "address")
    if not most["heavy"]:
        return Links(light, sets, None, None, None, has_long)
    narrow = sets.filter("unit is not null and not wide").groupBy("unit").agg(F.any_value("heavy_set").alias("wallets"))
    unit_wallets = materialize(narrow, "units")
    numbers = meets = None
    if has_wide:
        numbers, meets = _wide_units(linked, sets, unit_wallets)
    return Links(light, sets, unit_wallets, numbers, meets, has_long)


def _set_digest() -> list[Column]:
    """An order-free digest of a transaction's heavy wallets: with their number, over a hundred bits of hash."""
    h = lambda salt: F.when(F.col("heavy"), F.xxhash64("address", F.lit(salt)))
    low = F.pmod(h(2), F.lit(1 << 40))
    return [F.bit_xor(h(1)).alias("set_x"), F.sum(low).alias("set_s")]


def _wide_units(linked: DataFrame, sets: DataFrame, unit_wallets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers of all units, and a bitmap of the units each wide unit meets. One transaction stands for each wide unit."""
    spokesman = sets.filter("wide").groupBy("unit").agg(F.min("tx_id").alias("tx_id"))
    wide = materialize(linked.filter("heavy").join(spokesman, "tx_id").select("unit", "address"), "wide_wallets")
    every = wide.unionAll(unit_wallets.select("unit", F.explode("wallets").alias("address")))
    units = spokesman.select("unit", F.lit(True).alias("wide")).unionAll(unit_wallets.select("unit", F.lit(False)))
    numbers = materialize(row_number(units, ["unit"], "n"), "unit_numbers")
    busy = wide.select("address").distinct()
    owners = every.join(busy, "address", "left_semi").join(numbers.select("unit", "n"), "unit")
    bucket, bit = F.bitmap_bucket_number("n").alias("bucket"), F.bitmap_bit_position("n")
    by_wallet = owners.groupBy("address", bucket).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    met = wide.join(by_wallet, "address").groupBy("unit", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return numbers, materialize(met.join(numbers.select("unit", "n"), "unit"), "unit_bitmaps")


def _wide_sums(links: Links, stats: DataFrame, sums: list[str]) -> DataFrame:
    """(unit, sums): for each wide unit over the units it meets, for each other unit over the wide ones it meets. A task
    has one bitmap's units and at most ``WIDE_CHUNK`` wide units."""
    named = links.numbers.join(stats, "unit")
    kinds = {c: stats.schema[c].dataType.simpleString() for c in sums}
    whole = [kinds[c] in ("bigint", "int") for c in sums]

    def values(frame: pd.DataFrame, dtype: type, prefix: str = "") -> np.ndarray:
        return np.stack([frame[prefix + c].to_numpy().astype(dtype) for c in sums], axis=1)

    def multiply(met: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(met) or not len(around):
            return pd.DataFrame({c: [] for c in ["n", *sums]})
        # Whole numbers stay whole numbers: the two kinds are multiplied apart.
        place = ((around["m"].to_numpy() - 1) % BITMAP_UNITS).astype(np.int64)
        wide = around["wide"].to_numpy().astype(bool)
        out, back = [], {t: np.zeros((len(around), len(sums)), t) for t in (np.int64, np.float64)}
        for first in range(0, len(met), 64):
            part = met.iloc[first : first + 64]
            bits = np.stack([np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")[place] for b in part["bitmap"]])
            made = {}
            for t in (np.int64, np.float64):
                made[t] = bits.astype(t) @ values(around, t, "m_")
                back[t] += bits.T.astype(t) @ values(part, t)
            columns = {c: made[np.int64 if w else np.float64][:, k] for k, (c, w) in enumerate(zip(sums, whole))}
            out.append(pd.DataFrame({"n": part["n"].to_numpy(), **columns}))
        columns = {c: back[np.int64 if w else np.float64][~wide, k] for k, (c, w) in enumerate(zip(sums, whole))}
        out.append(pd.DataFrame({"n": around["m"].to_numpy()[~wide], **columns}))
        return pd.concat(out)

    chunk = F.floor(F.col("n") / WIDE_CHUNK).cast("bigint").alias("chunk")
    met = links.meets.join(stats, "unit").select("n", "bucket", "bitmap", chunk, *sums)
    chunks = met.select(F.col("bucket").alias("b"), F.col("chunk").alias("k")).distinct()
    # Names of its own, as both sides of the cogroup come from the same tables.
    around = named.select(F.col("n").alias("m"), "wide", F.bitmap_bucket_number("n").alias("at"), *[F.col(c).alias(f"m_{c}") for c in sums])
    around = around.join(chunks, F.col("at") == F.col("b")).select("m", "wide", "b", "k", *[f"m_{c}" for c in sums])
    schema = ", ".join(["n bigint", *[f"{c} {kinds[c]}" for c in sums]])
    found = met.groupBy("bucket", "chunk").cogroup(around.groupBy("b", "k")).applyInPandas(multiply, schema)
    total = found.groupBy("n").agg(*[F.sum(c).alias(c) for c in sums])
    return total.join(links.numbers.select("unit", "n"), "n").select("unit", *sums)


def _share_heavy(links: Links, pairs: DataFrame) -> DataFrame:
    """Pairs of transactions (unit, unit_b, ...) of which one is in a wide unit that meets the other's unit, taken out."""
    is_wide = lambda c: F.coalesce(F.col(c).startswith("wide:"), F.lit(False))
    marked = pairs.withColumns({
        "__w": F.when(is_wide("unit"), F.col("unit")).when(is_wide("unit_b"), F.col("unit_b")),
        "__o": F.when(is_wide("unit"), F.col("unit_b")).when(is_wide("unit_b"), F.col("unit")),
    })
    plain = marked.filter("__w IS NULL OR __o IS NULL").drop("__w", "__o")
    numbered = marked.filter("__w IS NOT NULL AND __o IS NOT NULL").join(links.numbers.select(F.col("unit").alias("__o"), "n"), "__o")
    place = F.bitmap_bit_position("n")
    held = links.meets.select(F.col("unit").alias("__w"), "bucket", "bitmap")
    joined = numbered.withColumns({"bucket": F.bitmap_bucket_number("n"), "__p": place}).join(held, ["__w", "bucket"], "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("__p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.expr("power(2, __p % 8)")), F.lit(2))
    return plain.unionByName(joined.filter(F.coalesce(bit, F.lit(0)) == 0).select(*plain.columns))


def _tx_sets(linked: DataFrame, sizes: DataFrame, bounded: bool) -> DataFrame:
    """One row per linked transaction with its short wallet sets and the unit it belongs to.

    ``light_set`` is null beyond ``MAX_LIGHT_SET`` light wallets, ``heavy_set`` beyond ``MAX_SUBSET`` heavy
    ones (``wide``). Where longer lists exist (``bounded``) their rows are dropped before anything is
    gathered."""
    rows = linked
    if bounded:
        short = (F.col("heavy") & (F.col("n_heavy") <= MAX_SUBSET)) | (~F.col("heavy") & (F.col("n_light") <= MAX_LIGHT_SET))
        rows = linked.join(sizes, "tx_id").filter(short)
    sets = rows.groupBy("tx_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("heavy"), F.col("address")))).alias("light_set"),
        F.array_sort(F.collect_list(F.when(F.col("heavy"), F.col("address")))).alias("heavy_set"),
    )
    if bounded:
        empty = F.array().cast("array<string>")
        kept = lambda name, n, most: F.when(F.col(n) <= most, F.coalesce(F.col(name), empty)).alias(name)
        sets = sizes.join(sets, "tx_id", "left").select(
            "tx_id", "n_heavy", "set_x", "set_s", kept("light_set", "n_light", MAX_LIGHT_SET), kept("heavy_set", "n_heavy", MAX_SUBSET)
        )
    else:
        sets = sets.withColumns({"n_heavy": F.size("heavy_set"), "set_x": F.lit(None).cast("bigint"), "set_s": F.lit(None).cast("bigint")})
    # Length-prefixed names, so that different sets never share one.
    name = F.concat(
        F.lit("set:"), F.array_join(F.transform("heavy_set", lambda w: F.concat(F.length(w), F.lit(":"), w)), ",")
    )
    wide = F.col("heavy_set").isNull()
    unit = F.when(F.col("n_heavy") > 0, F.when(wide, F.concat_ws(":", F.lit("wide"), "n_heavy", "set_x", "set_s")).otherwise(name))
    return sets.select("tx_id", "light_set", "heavy_set", wide.alias("wide"), unit.alias("unit"))


def _unit_sums(links: Links, stats: DataFrame, sums: list[str]) -> DataFrame:
    """Per unit the sums over all units that share a heavy wallet with it (itself included)."""
    narrow = links.unit_wallets.join(stats, "unit")
    exploded = narrow.select("unit", *sums, F.explode(_subsets(F.col("wallets"))).alias("subset"))
    per_subset = exploded.groupBy("subset").agg(*[F.sum(c).alias(c) for c in sums])
    sign = F.when(F.pmod(F.size("subset"), F.lit(2)) == 1, F.lit(1)).otherwise(F.lit(-1))
    total = [F.sum(c).alias(c) for c in sums]
    by_subset = exploded.select("unit", "subset").join(per_subset, "subset").groupBy("unit").agg(
        *[F.sum(sign * F.col(c)).alias(c) for c in sums]
    )
    if links.meets is None:
        return by_subset
    return by_subset.unionByName(_wide_sums(links, stats, sums)).groupBy("unit").agg(*total)


def _light_sums(links: Links, vals: DataFrame, sums: list[str]) -> DataFrame:
    """Sums over transactions that share a light wallet but no heavy one.

    Every pair is counted at its smallest common light wallet: a row carries its own smaller wallets, and
    a pair counts unless one of them occurs on the other side. So pairs need no deduplicating shuffle and
    collapse into per-transaction sums inside the join's task. Only pairs with a long wallet list are
    deduplicated explicitly."""
    sets = links.sets.select("tx_id", "light_set", "heavy_set", "unit")
    rows = links.light.join(sets, "tx_id")
    earlier = F.filter("light_set", lambda w: w < F.col("address"))
    mine = rows.withColumn("earlier", earlier).drop("light_set")
    theirs = links.light.join(sets.join(vals, "tx_id"), "tx_id").select(
        F.col("tx_id").alias("other"), "address", F.col("light_set").alias("light_b"), F.col("heavy_set").alias("heavy_b"),
        F.col("unit").alias("unit_b"), *sums,
    )
    apart = lambda x, y: ~F.coalesce(F.arrays_overlap(x, y), F.lit(False))
    pairs = mine.join(theirs, "address").filter("tx_id <> other").filter(apart("heavy_set", "heavy_b"))
    known = F.col("earlier").isNotNull() & F.col("light_b").isNotNull()
    cols = ["tx_id", "unit", "unit_b", *sums]
    counted = pairs.filter(known & apart("earlier", "light_b")).select(*cols)
    if links.has_long:
        rest = pairs.filter(~known).groupBy("tx_id", "other").agg(*[F.any_value(c).alias(c) for c in cols[1:]])
        counted = counted.unionByName(rest.select(*cols))
    if links.meets is not None:
        counted = _share_heavy(links, counted)
    return counted.groupBy("tx_id").agg(*[F.sum(c).alias(c) for c in sums])


def neighbour_sums(
    inc: DataFrame | None, values: DataFrame, columns: list[str], heavy_degree: int = HEAVY_DEGREE, links: Links | None = None
) -> DataFrame:
    """Per transaction ``n_neighbours`` and the sum of each value column over its distinct neighbours.

    ``values`` has one row per transaction; the result has one row per transaction of ``values``. Pass
    ``links`` to reuse a prepared incidence."""
    links = links or prepare_links(inc, heavy_degree)
    sums = ["n_neighbours", *columns]
    vals = values.select("tx_id", F.lit(1).cast("bigint").alias("n_neighbours"), *columns)
    near = _light_sums(links, vals, sums)
    if links.unit_wallets is None:
        return _complete(values, near, sums)
    owners = links.sets.filter("unit is not null").select("tx_id", "unit").join(vals, "tx_id")
    stats = materialize(owners.groupBy("unit").agg(*[F.sum(c).alias(c) for c in sums]), "unit_stats")
    shared = _unit_sums(links, stats, sums)
    # The unit's sums include the transaction itself once.
    around = owners.select("tx_id", "unit").join(shared, "unit").select("tx_id", *sums)
    itself = owners.select("tx_id", *[(-F.col(c)).alias(c) for c in sums])
    merged = near.unionByName(around).unionByName(itself).groupBy("tx_id").agg(*[F.sum(c).alias(c) for c in sums])
    return _complete(values, merged, sums)


def _complete(values: DataFrame, found: DataFrame, sums: list[str]) -> DataFrame:
    return values.select("tx_id").join(found, "tx_id", "left").select(
        "tx_id", *[F.coalesce(F.col(c), F.lit(0).cast(found.schema[c].dataType)).alias(c) for c in sums]
    )


def neighbour_illicit_ratio(inc: DataFrame, tx: DataFrame, heavy_degree: int = HEAVY_DEGREE) -> DataFrame:
    """Share of distinct wallet-sharing transactions labelled illicit; 0 without neighbours."""
    flags = tx.select("tx_id", F.coalesce((F.col("label") == "illicit").cast("bigint"), F.lit(0)).alias("n_illicit"))
    sums = neighbour_sums(inc, flags, ["n_illicit"], heavy_degree)
    ratio = F.when(F.col("n_neighbours") > 0, F.col("n_illicit") / F.col("n_neighbours")).otherwise(F.lit(0.0))
    return sums.select("tx_id", "n_neighbours", "n_illicit", ratio.alias("neighbor_illicit_ratio"))


def tx_edge_index(pairs: DataFrame, tx: DataFrame) -> DataFrame:
    """Both directions of the given neighbour pairs plus one self loop per transaction."""
    forward = pairs.select(F.col("tx_id").alias("src"), F.col("neighbour").alias("dst"))
    loops = tx.select(F.col("tx_id").alias("src"), F.col("tx_id").alias("dst"))
    return forward.unionAll(forward.select(F.col("dst"), F.col("src"))).unionAll(loops).distinct()


def gcn_propagate(
    inc: DataFrame, nodes: DataFrame, columns: list[str], hops: int = 2, heavy_degree: int = HEAVY_DEGREE
) -> DataFrame:
    """Symmetric-normalised propagation with self loops over wallet-sharing transactions.

    x_i' = sum_j x_j / sqrt(d_i d_j) over neighbours and i itself, d counting the self loop. Per hop one
    ``neighbour_sums`` of x_j / sqrt(d_j); the pair list itself is never needed."""
    base = nodes.select("tx_id", *[F.col(c).cast("double").alias(c) for c in columns])
    links = prepare_links(inc, heavy_degree)
    degree = neighbour_sums(None, base, [], links=links).select(
        "tx_id", (F.col("n_neighbours") + 1).cast("double").alias("__d")
    )
    current = materialize(base.join(degree, "tx_id"), "propagated")
    for _ in range(hops):
        scaled = current.select("tx_id", *[(F.col(c) / F.sqrt("__d")).alias(c) for c in columns])
        around = neighbour_sums(None, scaled, columns, links=links).drop("n_neighbours")
        around = around.select("tx_id", *[F.col(c).alias(f"__n_{c}") for c in columns])
        current = materialize(
            current.join(around, "tx_id").select(
                "tx_id", "__d",
                *[(F.col(f"__n_{c}") / F.sqrt("__d") + F.col(c) / F.col("__d")).alias(c) for c in columns],
            ),
            "propagated",
        )
    return current.drop("__d")
