"""From raw text columns to typed transactions, with fail-fast or quarantine validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coinweave.functions import normalize as N
from coinweave.operators.ordering import with_row_index
from coinweave.sources.readers import MalformedInput, check_columns

# Fixed value: the dataset name recorded in the provenance of every row.
DATASET = "elliptic_augmented"


def provenance(amounts_supplied: Column, network_supplied: Column) -> Column:
    """Which layers came from the file and which were filled in."""
    layer = lambda supplied: F.when(supplied, F.lit("supplied")).otherwise(F.lit("synthetic"))
    return F.struct(
        F.lit(DATASET).alias("dataset"),
        layer(amounts_supplied).alias("ledger_layer"),
        layer(network_supplied).alias("network_layer"),
        (~(amounts_supplied & network_supplied)).alias("semi_synthetic"),
    )


def _sides(addresses: Column, amounts: Column) -> Column:
    return F.zip_with(addresses, amounts, lambda a, m: F.struct(a.alias("address"), m.alias("amount_sats")))


def normalize_transactions(raw: DataFrame, index: str | None = None) -> DataFrame:
    """Typed transaction columns plus ``row_index`` and ``errors``; one narrow projection, no shuffle
    (apart from numbering the rows when no ``index`` column is named)."""
    check_columns(raw)
    if index is None:
        raw, index = with_row_index(raw, "__row"), "__row"
    types = {f.name: f.dataType for f in raw.schema.fields}
    source = raw.drop(index)
    idx = F.col(f"`{index}`").cast("bigint")

    def text(field: str, default: Column | None = None) -> Column:
        return N.first_present(source, N.ALIASES[field], default)

    def native(field: str) -> bool:
        return any(isinstance(types.get(n), T.ArrayType) for n in N.ALIASES[field])

    # Stage 1 resolves aliases once; later stages refer to plain columns.
    resolved = raw.select(
        idx.alias("row_index"),
        *[text(f).alias(f"raw_{f}") for f in N.ALIASES],
        *[c.alias(n) for n, c in N.ext_feature_summary(source).items()],
    )
    i = F.col("row_index")
    tx_id = F.coalesce("raw_tx_id", N.surrogate_key(i))
    label = N.normalize_label(F.coalesce("raw_label", F.lit("unknown")))
    step = N.normalize_time_step(F.col("raw_time_step"))
    lists = {
        f: N.parse_list(F.col(f"raw_{f}"), native(f))
        for f in ("input_addresses", "output_addresses", "parent_tx_ids", "exchange_addresses")
    }
    amounts = {f: N.parse_amounts(F.col(f"raw_{f}"), native(f)) for f in ("input_amounts", "output_amounts")}
    ips = ("src_ip", "dst_ip")
    ports = {f: N.normalize_port(F.col(f"raw_{f}"), f) for f in ("src_port", "dst_port")}
    when = N.normalize_timestamp(F.col("raw_timestamp"))
    network = F.lit(True)
    for f in ("src_ip", "dst_ip", "src_port", "dst_port"):
        network = network & F.col(f"raw_{f}").isNotNull()

    typed = resolved.select(
        "row_index",
        tx_id.alias("tx_id"),
        label.value.alias("label"),
        F.when(F.col("raw_time_step").isNull(), N.default_time_step(i)).otherwise(step.value).alias("time_step"),
        *[f.value.alias(n) for n, f in {**lists, **amounts}.items()],
        *[N.ip_value(F.col(f"raw_{f}")).alias(f) for f in ips],
        *[f"raw_{f}" for f in ips],
        F.when(F.col("raw_src_port").isNull(), N.DEFAULT_PORT + F.pmod(i, F.lit(200)).cast("int"))
        .otherwise(ports["src_port"].value).alias("src_port"),
        F.when(F.col("raw_dst_port").isNull(), F.lit(N.DEFAULT_PORT))
        .otherwise(ports["dst_port"].value).alias("dst_port"),
        when.value.alias("__ts"),
        network.alias("__network"),
        "ext_feature_count", "ext_feature_mean", "ext_feature_std",
        F.array(
            step.error, label.error, *[f.error for f in lists.values()], *[f.error for f in amounts.values()]
        ).alias("__before"),
        F.array(*[f.error for f in ports.values()], when.error).alias("__after"),
    )
    has_sides = (F.size("input_addresses") > 0) & (F.size("output_addresses") > 0)
    given = (F.size("input_amounts") > 0) & (F.size("output_amounts") > 0)
    filled = typed.withColumn("__given", given & has_sides).withColumn(
        "input_amounts", N.impute_inputs(F.col("input_amounts"), F.col("input_addresses"), i)
    )
    filled = filled.withColumn(
        "output_amounts",
        N.impute_outputs(F.col("output_amounts"), F.col("output_addresses"), F.col("input_amounts"), i),
    )

    def mismatch(side: str) -> Column:
        a, m = F.size(f"{side}_addresses"), F.size(f"{side}_amounts")
        return F.when((a > 0) & (a != m), F.concat(a, F.lit(f" {side} addresses but "), m, F.lit(f" {side} amounts")))

    paid = F.when(
        N.total(F.col("input_amounts")) < N.total(F.col("output_amounts")), F.lit("outputs exceed inputs")
    )
    def overflow(side: str) -> Column:
        amounts = F.col(f"{side}_amounts")
        readable = F.forall(amounts, lambda x: x.isNotNull())
        return F.when(readable & N.total(amounts).isNull(), F.lit(f"{side} amounts are too large together"))

    structural = F.array(
        F.when(F.size("input_addresses") == 0, F.lit("no input addresses")),
        F.when(F.size("output_addresses") == 0, F.lit("no output addresses")),
        mismatch("input"), mismatch("output"), overflow("input"), overflow("output"), F.when(has_sides, paid),
    )
    # Errors of the addresses follow from the parsed columns, so the parser appears once per column.
    addresses = F.array(*[N.ip_error(F.col(f"raw_{f}"), F.col(f), f) for f in ips])
    fallback_ts = N.timestamp_from_step(F.col("time_step"), F.pmod(i, F.lit(20)))
    return filled.select(
        "row_index", "tx_id", "label", F.coalesce("__ts", fallback_ts).alias("ts"), "time_step",
        "src_ip", "dst_ip", "src_port", "dst_port",
        _sides(F.col("input_addresses"), F.col("input_amounts")).alias("inputs"),
        _sides(F.col("output_addresses"), F.col("output_amounts")).alias("outputs"),
        "parent_tx_ids", "exchange_addresses",
        "ext_feature_count", "ext_feature_mean", "ext_feature_std",
        provenance(F.col("__given"), F.col("__network")).alias("provenance"),
        F.filter(F.concat("__before", structural, addresses, "__after"), lambda e: e.isNotNull()).alias("errors"),
    )


def flag_duplicates(tx: DataFrame) -> DataFrame:
    """Add an error to every row that repeats an earlier row's id. Ids are counted with partial
    aggregation; only repeated ids take part in the join."""
    repeated = tx.groupBy("tx_id").agg(F.min("row_index").alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    later = F.coalesce(F.col("row_index") > F.col("__first"), F.lit(False))
    note = F.concat(F.lit("duplicate transaction id "), F.col("tx_id"))
    return (
        tx.join(repeated, "tx_id", "left")
        .withColumn("errors", F.when(later, F.concat("errors", F.array(note))).otherwise(F.col("errors")))
        .drop("__first", "__n")
    )


def validate(tx: DataFrame, mode: str = "fail_fast") -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``. ``fail_fast`` raises for the first bad row in file order, ``quarantine`` splits."""
    checked = flag_duplicates(tx)
    good = checked.filter(F.size("errors") == 0).drop("errors")
    bad = checked.filter(F.size("errors") > 0)
    if mode == "quarantine":
        return good, bad
    if mode != "fail_fast":
        raise ValueError("mode is fail_fast or quarantine")
    first = bad.orderBy("row_index").select("row_index", F.get("errors", F.lit(0)).alias("error")).head()
    if first is not None:
        raise MalformedInput(f"Row {first['row_index'] + 1}: {first['error']}")
    return good, bad
