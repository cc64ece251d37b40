"""Engineered node and edge tables: clusters, change flags, reuse links, indicator columns, checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coinweave.operators import metrics
from coinweave.operators.links import cross_partition_edges, drop_existing_pairs
from coinweave.operators.ordering import exact_quantile, neighbour_in_order, with_scalar

# Hub quantile, round-amount unit in satoshis, smallest cluster that gets reuse links.
HUB_QUANTILE = 0.995
ROUND_SATS = 1_000_000
MIN_REUSE_CLUSTER = 3


def hub_clusters(clusters: DataFrame, q: float = HUB_QUANTILE) -> DataFrame:
    """(cluster, size, flag): clusters at or above the interpolated size quantile are flagged."""
    sizes = clusters.groupBy("cioh_cluster_id").agg(F.count("*").alias("size"))
    threshold = exact_quantile(sizes, "size", q, "threshold")
    return with_scalar(sizes, threshold).select(
        "cioh_cluster_id", "size", (F.col("size") >= F.col("threshold")).cast("int").alias("is_vasp_excluded_cluster")
    )


def with_clusters(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    flags = hub_clusters(clusters).select("cioh_cluster_id", "is_vasp_excluded_cluster")
    return nodes.join(clusters.select("txId", "cioh_cluster_id"), "txId").join(flags, "cioh_cluster_id")


def edge_change_flag(edges: DataFrame, clusters: DataFrame, amount: str = "amount_sats") -> DataFrame:
    """1 where both ends share a cluster and the amount is not a multiple of 0.01 BTC."""
    c = clusters.select("txId", "cioh_cluster_id")
    same = F.coalesce(F.col("c_s") == F.col("c_t"), F.lit(False)) & (F.pmod(F.col(amount), F.lit(ROUND_SATS)) != 0)
    return (
        edges.join(c.toDF("source", "c_s"), "source", "left")
        .join(c.toDF("target", "c_t"), "target", "left")
        .withColumn("is_change_output", same.cast("int"))
        .drop("c_s", "c_t")
    )


def any_change_received(nodes: DataFrame, flagged: DataFrame) -> DataFrame:
    got = flagged.groupBy(F.col("target").alias("txId")).agg(F.max("is_change_output").alias("any_change_received"))
    return nodes.join(got, "txId", "left").withColumn("any_change_received", F.coalesce("any_change_received", F.lit(0)))


def reuse_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links between consecutive transactions of every non-hub cluster of three or more.

    ``nodes`` carries txId, time_step, cioh_cluster_id and is_vasp_excluded_cluster. The successor in
    (cluster, txId) order is found in blocks, so a cluster of any size spreads over many tasks."""
    sizes = nodes.groupBy("cioh_cluster_id").agg(F.count("*").alias("__n")).filter(F.col("__n") >= MIN_REUSE_CLUSTER)
    eligible = nodes.filter("is_vasp_excluded_cluster = 0").select("cioh_cluster_id", "txId", "time_step").join(
        sizes.select("cioh_cluster_id"), "cioh_cluster_id", "left_semi"
    )
    paired = neighbour_in_order(eligible, ["cioh_cluster_id", "txId"], ["cioh_cluster_id"], ["txId"])
    candidates = paired.filter("next_txId is not null").select(
        F.col("txId").alias("source"), F.col("next_txId").alias("target")
    )
    return drop_existing_pairs(candidates, edges).select(
        "source", "target", F.lit("heuristic_reuse").alias("edge_type"), F.lit(1).alias("is_change_output")
    )


def all_edges(original: DataFrame, reuse: DataFrame) -> DataFrame:
    return original.unionByName(reuse, allowMissingColumns=True)


def one_hot(df: DataFrame, column: str, prefix: str, categories: Iterable[str] | None = None) -> DataFrame:
    """One 0/1 column per category. Categories are looked up when not given; they become columns of the plan,
    so all of them come to the driver."""
    if categories is None:
        categories = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().toLocalIterator())
    return df.withColumns(
        {f"{prefix}_{c}": F.coalesce((F.col(column) == F.lit(c)).cast("int"), F.lit(0)) for c in categories}
    ).drop(column)


def un_one_hot(columns: list[str]) -> Column:
    """Name of the first column that holds the row maximum."""
    best = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    name = F.lit(None).cast("string")
    for c in reversed(columns):
        name = F.when(F.col(c) == best, F.lit(c)).otherwise(name)
    return name


def order_columns(nodes: DataFrame) -> DataFrame:
    """Ids, features, heuristics, network indicators, in that order."""
    features = [c for c in nodes.columns if c.startswith("feat_")]
    heuristics = ["cioh_cluster_id", "is_vasp_excluded_cluster", "any_change_received"]
    network = [c for c in nodes.columns if c.startswith(("asn_", "port_"))] + ["is_tor_exit", "is_high_risk_vpn_asn"]
    wanted = ["txId", "class", "time_step", *features, *heuristics, *network]
    return nodes.select(*[c for c in wanted if c in nodes.columns])


def non_numeric_columns(nodes: DataFrame) -> list[str]:
    return [f.name for f in nodes.schema.fields if f.name != "txId" and not isinstance(f.dataType, T.NumericType)]


def assert_numeric(nodes: DataFrame) -> DataFrame:
    bad = non_numeric_columns(nodes)
    if bad:
        raise ValueError(f"non-numeric columns: {bad}")
    return nodes


CHECK_SCHEMA = "check string, passed boolean, detail string"


def verify_nodes_edges(
    nodes: DataFrame, edges: DataFrame, expected: dict[str, int], min_columns: int = 170, min_features: int = 165,
    max_v: float = 0.05,
) -> DataFrame:
    """All data checks as one table (check, passed, detail).

    Shape checks read the schema only; the class-independence checks, presence flags, step crossing and
    counts are aggregates of a few rows each."""
    spark = nodes.sparkSession
    rows: list[tuple[str, bool, str]] = []
    width = len(nodes.columns)
    rows.append(("columns", width > min_columns, str(width)))
    bad = non_numeric_columns(nodes)
    rows.append(("numeric", not bad, ",".join(bad)))
    n_features = len([c for c in nodes.columns if c.startswith("feat_")])
    rows.append(("features", n_features >= min_features, str(n_features)))
    table = spark.createDataFrame(rows, CHECK_SCHEMA)
    labelled = nodes.filter(F.col("class").isin(0, 1))
    for prefix in ("asn_", "port_"):
        columns = [c for c in nodes.columns if c.startswith(prefix)]
        if not columns:
            continue
        category = labelled.select(un_one_hot(columns).alias("category"), "class")
        v = metrics.cramers_v(category, "category", "class")
        table = table.unionAll(
            v.select(
                F.lit(f"independent:{prefix}").alias("check"), (F.col("v") < max_v).alias("passed"),
                F.round("v", 6).cast("string").alias("detail"),
            )
        )
    for flag in ("is_tor_exit", "is_high_risk_vpn_asn", "port_p_8333_mainnet"):
        if flag in nodes.columns:
            both = metrics.present_in_both_classes(labelled, flag)
            table = table.unionAll(
                both.select(
                    F.lit(f"both_classes:{flag}").alias("check"), F.col("in_both").alias("passed"),
                    F.round("illicit_share", 6).cast("string").alias("detail"),
                )
            )
    crossing = cross_partition_edges(edges, nodes).agg(F.count("*").alias("n"))
    table = table.unionAll(
        crossing.select(F.lit("step_crossing").alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("string"))
    )
    return table.unionAll(metrics.assert_counts(nodes, edges, expected))
