"""Global order without a single-task window.

A window without a partition key, or with one hot key, sorts everything in one task. Here rows are
range-partitioned on the full order key, so one hot group spreads over many blocks; whatever crosses
a block border travels through one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweave.session import materialize

BLOCK = "__block"


def _columns(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def ordered_blocks(df: DataFrame, keys) -> DataFrame:
    """Rows with a block number; blocks are contiguous in the order of ``keys`` (a total order)."""
    ranged = df.repartitionByRange(*_columns(keys)).withColumn(BLOCK, F.spark_partition_id())
    return materialize(ranged, "blocks")


def _carry(blocks: DataFrame, summary: list[Column], carried: list[Column]) -> DataFrame:
    """Window over one summary row per block; as many rows as the range shuffle has partitions."""
    per_block = blocks.groupBy(BLOCK).agg(*summary)
    return F.broadcast(per_block.select(BLOCK, *carried))


def running_sums(df: DataFrame, keys, values: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """Inclusive running sums (one column per name) in the order of ``keys``; with ``group`` (a prefix of
    the order) the sums restart for every group, still without gathering a group in one task."""
    group = group or []
    names = list(values)
    v, o = {n: f"__v_{n}" for n in names}, {n: f"__o_{n}" for n in names}
    # The values are taken from the blocks, so that they need not move with the rows.
    blocks = ordered_blocks(df, keys).withColumns({v[n]: values[n] for n in names})
    totals = [F.sum(v[n]).alias(o[n]) for n in names]
    inside = Window.partitionBy(BLOCK, *group).orderBy(*_columns(keys)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(o[n]).over(before), F.lit(0)).alias(o[n]) for n in names]
    if not group:
        out = blocks.join(_carry(blocks, totals, earlier), BLOCK)
    else:
        # Only groups that cross a block border need an offset: at most two rows per block.
        spanning = blocks.groupBy(*group).agg(
            F.min(BLOCK).alias("__lo"), F.max(BLOCK).alias("__hi")
        ).filter("__lo < __hi").select(*group)
        parts = blocks.groupBy(BLOCK, *group).agg(*totals).join(F.broadcast(spanning), group, "left_semi")
        out = blocks.join(F.broadcast(parts.select(BLOCK, *group, *earlier)), [BLOCK, *group], "left")
    sums = {n: F.sum(v[n]).over(inside) + F.coalesce(F.col(o[n]), F.lit(0)) for n in names}
    return out.withColumns(sums).drop(BLOCK, *v.values(), *o.values())


def running_sum(df: DataFrame, keys, value: Column, name: str, group: list[str] | None = None) -> DataFrame:
    return running_sums(df, keys, {name: value}, group)


def row_number(df: DataFrame, keys, name: str, group: list[str] | None = None) -> DataFrame:
    """1-based position in the order of ``keys`` (per ``group`` if given)."""
    return running_sum(df, keys, F.lit(1).cast("bigint"), name, group)


def neighbour_in_order(df: DataFrame, keys, group: list[str], take: list[str], back: bool = False) -> DataFrame:
    """``lead`` (or ``lag`` with ``back``) of the ``take`` columns within ``group``, spread over blocks.

    Adds ``next_<c>`` / ``prev_<c>`` columns; ``group`` columns must lead ``keys``."""
    prefix = "prev_" if back else "next_"
    blocks = ordered_blocks(df, keys)
    order = _columns(keys)
    w = Window.partitionBy(BLOCK).orderBy(*order)
    shift = F.lag if back else F.lead
    seen = F.struct(*[F.col(c) for c in dict.fromkeys([*group, *take])])
    key = F.struct(*order)
    # The row of a neighbouring block that touches this one.
    edge = (F.max_by if back else F.min_by)(seen, key).alias("__edge")
    border = (F.lag if back else F.lead)("__edge").over(Window.orderBy(BLOCK))
    borders = _carry(blocks, [edge], [border.alias("__border")])
    out = blocks.join(borders, BLOCK).withColumn("__n", F.coalesce(shift(seen).over(w), F.col("__border")))
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"__n.{g}").eqNullSafe(F.col(g))
    for c in take:
        out = out.withColumn(prefix + c, F.when(F.col("__n").isNotNull() & same, F.col(f"__n.{c}")))
    return out.drop(BLOCK, "__n", "__border")


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 0-based index in reading order: partition-local index plus one offset per partition."""
    numbered = df.withColumn("__m", F.monotonically_increasing_id())
    numbered = materialize(
        numbered.withColumn(BLOCK, F.shiftright("__m", 33).cast("int")), "indexed"
    )
    local = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = _carry(
        numbered, [F.count("*").alias("__t")], [F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o")]
    )
    return (
        numbered.join(offsets, BLOCK)
        .withColumn(name, local + F.col("__o"))
        .drop("__m", BLOCK, "__o")
    )


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row."""
    keyed = F.broadcast(one_row.withColumn("__one", F.lit(1)))
    return df.withColumn("__one", F.lit(1)).join(keyed, "__one").drop("__one")


def exact_quantile(df: DataFrame, value: str, q: float, name: str = "quantile") -> DataFrame:
    """Linearly interpolated quantile as a one-row table: counts per value, then ranks in blocks."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__x")).agg(F.count("*").alias("__c"))
    ranked = running_sum(counts, ["__x"], F.col("__c"), "__upto")
    total = counts.agg((F.sum("__c") - 1).alias("__last"))
    # Zero-based ranks __upto - __c .. __upto - 1 carry value __x.
    joined = with_scalar(ranked, total).withColumn("__p", F.lit(float(q)) * F.col("__last"))
    first, last = F.col("__upto") - F.col("__c"), F.col("__upto") - 1
    lo, hi = F.floor("__p"), F.ceil("__p")
    picked = joined.agg(
        F.max(F.when((first <= lo) & (lo <= last), F.col("__x").cast("double"))).alias("__lo"),
        F.max(F.when((first <= hi) & (hi <= last), F.col("__x").cast("double"))).alias("__hi"),
        F.max(F.col("__p") - F.floor("__p")).alias("__f"),
    )
    return picked.select((F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias(name))
