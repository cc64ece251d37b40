"""Feature vectors, the additive rule score, bands, anomalies and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.functions import normalize as N
from coinweave.operators.graph import tx_degree
from coinweave.operators.heuristics import parent_time_delta
from coinweave.operators.ledger import Ledger, base_features, tx_children

# Feature order, terms of the rule score (feature, divisor or factor, points), bands.
FEATURE_ORDER = [
    "tx_volume", "fee_ratio", "input_count", "output_count", "neighbor_illicit_ratio", "parent_time_delta",
    "degree_centrality", "tor_or_bulletproof_asn", "peel_chain", "fan_out", "fan_in", "change_reuse",
    "terminal_exchange", "ext_feature_count", "ext_feature_mean", "ext_feature_std",
]
FLAG_POINTS = {"tor_or_bulletproof_asn": 22, "peel_chain": 18, "fan_out": 16, "fan_in": 16, "change_reuse": 8}
LABEL_POINTS = 10
RAPID_SECONDS = 25
ALERT_THRESHOLD = 50
BANDS = [(90, "CRITICAL"), (75, "HIGH"), (50, "MEDIUM")]
ILLICIT_SHARE, ANOMALOUS_SHARE = 0.72, 0.28
ANOMALIES = {
    "peel_chain": "Peel Chain to Exchange",
    "fan_out": "Rapid Fan-Out Smurfing",
    "fan_in": "Fan-In Pre-Cashout Aggregation",
    "risky_asn": "Physical IP Anomaly",
    "reuse": "Address Reuse (Input = Output)",
    "other": "GNN Transaction Anomaly",
}


def feature_vector(
    ledger: Ledger, latest: DataFrame, neighbours: DataFrame, peel: DataFrame, fans: DataFrame, n_nodes: int
) -> DataFrame:
    """One row per transaction: the sixteen features plus what scoring and evidence read.

    ``neighbours`` from ``neighbour_illicit_ratio``, ``peel`` and ``fans`` member tables, ``n_nodes`` the
    node count of the evidence graph. Every join is one row per transaction on ``tx_id``."""
    delta = parent_time_delta(tx_children(ledger.spends, latest))
    head = ledger.tx.select(
        "tx_id", "ts", "label", "asn", "asn_description",
        *[
            F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in ledger.tx.columns else F.lit(0.0).alias(c)
            for c in ("ext_feature_count", "ext_feature_mean", "ext_feature_std")
        ],
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    joined = (
        head.join(ledger.sides, "tx_id")
        .join(tx_degree(ledger), "tx_id", "left")
        .join(neighbours.select("tx_id", "neighbor_illicit_ratio"), "tx_id", "left")
        .join(delta, "tx_id", "left")
        .join(peel.select("tx_id", F.lit(True).alias("__peel")), "tx_id", "left")
        .join(fans.select("tx_id", F.col("fan_out").alias("__out"), F.col("fan_in").alias("__in")), "tx_id", "left")
    )
    base = base_features(F.col("total_in"), F.col("total_out"), F.col("n_in"), F.col("n_out"))
    return joined.select(
        "tx_id", "ts", "label", "asn", "asn_description", "change_address", "reused", "change_spent",
        *[c.alias(n) for n, c in base.items()],
        F.coalesce("neighbor_illicit_ratio", F.lit(0.0)).alias("neighbor_illicit_ratio"),
        F.coalesce("parent_time_delta", F.lit(0.0)).alias("parent_time_delta"),
        (F.coalesce("degree", F.lit(0)) / F.lit(float(max(n_nodes - 1, 1)))).alias("degree_centrality"),
        N.risky_asn_flag(F.col("asn_description")).cast("double").alias("tor_or_bulletproof_asn"),
        flag(F.col("__peel")).alias("peel_chain"),
        flag(F.col("__out")).alias("fan_out"),
        flag(F.col("__in")).alias("fan_in"),
        F.col("reused").cast("double").alias("change_reuse"),
        F.col("terminal_exchange").cast("double").alias("terminal_exchange"),
        "ext_feature_count", "ext_feature_mean", "ext_feature_std",
    )


def assemble(features: DataFrame, columns: list[str] = FEATURE_ORDER, name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol=name).transform(features)


def attribution_terms() -> list[tuple[str, Column]]:
    """The twelve additive terms by feature, in their fixed order, without the label bonus."""
    capped = lambda c: F.least(c, F.lit(1.0))
    rapid = (F.col("parent_time_delta") > 0) & (F.col("parent_time_delta") <= RAPID_SECONDS)
    terms = [
        ("tx_volume", capped(F.col("tx_volume") / 5.0) * 12),
        ("fee_ratio", capped(F.col("fee_ratio") * 80) * 8),
        ("input_count", capped(F.col("input_count") / 8) * 7),
        ("output_count", capped(F.col("output_count") / 8) * 7),
        ("neighbor_illicit_ratio", F.col("neighbor_illicit_ratio") * 10),
        ("parent_time_delta", F.when(rapid, F.lit(10.0)).otherwise(F.lit(0.0))),
        ("degree_centrality", capped(F.col("degree_centrality") * 50) * 6),
    ]
    for name, points in FLAG_POINTS.items():
        terms.append((name, F.when(F.col(name) != 0, F.lit(float(points))).otherwise(F.lit(0.0))))
    return terms


def rule_score(features: DataFrame, label_bonus: bool = True) -> DataFrame:
    """Probability, 0-100 score (half to even) and class shares.

    ``label_bonus`` adds points to rows already labelled illicit, as the method prescribes; switch it off
    where the label must not leak into the score."""
    score = F.lit(0.0)
    for _, term in attribution_terms():
        score = score + term
    if label_bonus:
        score = score + F.when(F.col("label") == "illicit", F.lit(float(LABEL_POINTS))).otherwise(F.lit(0.0))
    p = F.col("probability")
    scored = features.withColumn("probability", F.greatest(F.lit(0.0), F.least(score / 100.0, F.lit(1.0))))
    return scored.withColumns(
        {
            "threat_score": F.rint(p * 100).cast("int"),
            "p_licit": F.round(F.greatest(F.lit(0.0), 1.0 - p), 6),
            "p_illicit": F.round(p * ILLICIT_SHARE, 6),
            "p_anomalous": F.round(p * ANOMALOUS_SHARE, 6),
        }
    )


def normalize_probabilities(licit: Column, illicit: Column, anomalous: Column) -> dict[str, Column]:
    """Clamped and normalised class shares; the score is the share that is not licit, in percent."""
    clean = [F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))) for c in (licit, illicit, anomalous)]
    total = clean[0] + clean[1] + clean[2]
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    share = [c / total for c in clean]
    first, second = F.round(share[0], 6), F.round(share[1], 6)
    return {
        "threat_score": F.rint((share[1] + share[2]) * 100).cast("int"),
        "p_licit": first,
        "p_illicit": second,
        "p_anomalous": F.round(F.greatest(F.lit(0.0), 1.0 - first - second), 6),
    }


def risk_level(score: Column) -> Column:
    out = F.lit("LOW")
    for low, name in reversed(BANDS):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def prediction(score: Column) -> Column:
    return F.when(score >= 0.5, F.lit("suspicious")).otherwise(F.lit("licit"))


def primary_anomaly() -> Column:
    """The most telling pattern of a transaction; earlier ones take precedence."""
    return (
        F.when(F.col("peel_chain") != 0, F.lit(ANOMALIES["peel_chain"]))
        .when(F.col("fan_out") != 0, F.lit(ANOMALIES["fan_out"]))
        .when(F.col("fan_in") != 0, F.lit(ANOMALIES["fan_in"]))
        .when(F.col("tor_or_bulletproof_asn") != 0, F.lit(ANOMALIES["risky_asn"]))
        .when(F.col("reused") | F.col("change_spent"), F.lit(ANOMALIES["reuse"]))
        .otherwise(F.lit(ANOMALIES["other"]))
    )


def alerts(scored: DataFrame, threshold: int = ALERT_THRESHOLD) -> DataFrame:
    return scored.filter(F.col("threat_score") >= threshold).select(
        "tx_id", "threat_score", "ts", primary_anomaly().alias("primary_anomaly"),
        risk_level(F.col("threat_score")).alias("risk_level"),
    )


def rank_alerts(alerts_df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the ranking; a top-k per partition, never a full sort."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500 and offset at least 0")
    return alerts_df.orderBy(F.desc("threat_score"), F.desc("ts"), "tx_id").offset(offset).limit(limit)


def model_run(spark, engine: str, validation: dict[str, float]) -> DataFrame:
    row = (engine, float(validation.get("validation_size", 0.0)), float(validation.get("validation_accuracy", 0.0)))
    schema = "engine string, validation_size double, validation_accuracy double"
    return spark.createDataFrame([row], schema).withColumn("created_at", F.current_timestamp())
