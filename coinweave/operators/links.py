"""Enrichment and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.functions import normalize as N
from coinweave.operators.ordering import row_number
from coinweave.session import broadcast_if_small


def _masks(length: int) -> tuple[int, int]:
    """Both halves of the mask of a prefix of 128-bit addresses, as signed numbers."""
    bits = ((1 << length) - 1) << (128 - length)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(bits >> 64), signed(bits & ((1 << 64) - 1))


def prefix_table(df: DataFrame) -> DataFrame:
    """Typed prefixes from ``cidr`` text such as ``10.1.0.0/16`` or ``2001:db8::/32``: both halves of the network's
    16 bytes (``high``, ``low``; host bits cleared) and its length in 128 bits, an IPv4 network at its mapped place.
    Text that is no prefix is left out."""
    parts = F.split("cidr", "/")
    address, bits = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int")
    added = F.when(address.contains(":"), F.lit(0)).otherwise(F.lit(N.MAPPED_BITS))
    keyed = df.select(
        N.ip_key(address).alias("key"), F.when((bits >= 0) & (bits + added <= 128), bits + added).alias("prefix_length"), "country", "asn", "asn_description"
    ).filter("key is not null and prefix_length is not null")
    mask = lambda i: F.get(F.array(*[F.lit(_masks(n)[i]).cast("bigint") for n in range(129)]), F.col("prefix_length"))
    return keyed.select(
        F.col("key.high").bitwiseAND(mask(0)).alias("high"), F.col("key.low").bitwiseAND(mask(1)).alias("low"), "prefix_length", "country", "asn", "asn_description"
    )


def match_prefixes(ips: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Country and system of each distinct ``ip``, each from its longest matching prefix that has one.

    An address of either family is masked to every prefix length in use (at most 129), which turns the range join
    into one equality join for both: no address meets a prefix that does not contain it. An IPv4 address, or an
    IPv6 address that maps one, meets prefixes inside the mapped block alone, never a short IPv6 prefix around it.
    Text that is no address finds nothing."""
    lengths = sorted(r["prefix_length"] for r in prefixes.select("prefix_length").distinct().collect())  # 0..128
    if not lengths:
        lengths = [0]
    key = ips.select("ip", N.ip_key(F.col("ip")).alias("key")).filter("key is not null")
    masked = [
        F.struct(F.lit(n).alias("prefix_length"), F.col("key.high").bitwiseAND(F.lit(high).cast("bigint")).alias("high"), F.col("key.low").bitwiseAND(F.lit(low).cast("bigint")).alias("low"))
        for n, (high, low) in ((n, _masks(n)) for n in lengths)
    ]
    mapped = (F.col("key.high") == 0) & (F.shiftrightunsigned("key.low", 32) == 0xFFFF)
    candidates = key.select("ip", mapped.alias("mapped"), F.explode(F.array(*masked)).alias("m")).filter(f"NOT mapped OR m.prefix_length >= {N.MAPPED_BITS}")
    unique = prefixes.groupBy("high", "low", "prefix_length").agg(
        F.max(F.when(F.col("asn").isNotNull(), F.struct("asn", "asn_description"))).alias("system"), F.max("country").alias("country")
    )
    length = lambda c: F.when(F.col(c).isNotNull(), F.col("prefix_length"))
    return (
        candidates.select("ip", "m.*").join(broadcast_if_small(unique), ["high", "low", "prefix_length"])
        .groupBy("ip")
        .agg(F.max_by("system", length("system")).alias("system"), F.max_by("country", length("country")).alias("country"))
        .select("ip", "system.asn", "system.asn_description", "country")
    )


def enrich_ip(
    tx: DataFrame, prefixes: DataFrame, fallback_asn: str = "AS0", fallback_description: str = "Unallocated"
) -> DataFrame:
    """Country, system number and description of ``src_ip``; each distinct address is resolved once."""
    found = match_prefixes(tx.select(F.col("src_ip").alias("ip")).distinct(), prefixes)
    looked_up = found.select(
        F.col("ip").alias("src_ip"), F.col("country"), F.col("asn"), F.col("asn_description")
    )
    return tx.join(looked_up, "src_ip", "left").withColumns(
        {
            "asn_description": F.when(F.col("asn").isNull(), F.lit(fallback_description)).otherwise(
                F.coalesce(F.when(F.col("asn_description") != "", F.col("asn_description")), F.lit(fallback_description))
            ),
            "asn": F.coalesce("asn", F.lit(fallback_asn)),
        }
    )


# ---------------------------------------------------------------- engineered node/edge tables


def attach_classes(features: DataFrame, classes: DataFrame) -> DataFrame:
    """Left join of the class; every node must get one."""
    joined = features.join(classes, "txId", "left")
    missing = joined.filter("class is null").select("txId").head()
    if missing is not None:
        raise ValueError(f"no class for node {missing['txId']}")
    return joined


def cross_partition_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends lie in different time steps; an end without a node counts as different."""
    steps = nodes.select("txId", "time_step")
    return (
        edges.join(steps.toDF("source", "source_step"), "source", "left")
        .join(steps.toDF("target", "target_step"), "target", "left")
        .filter(~F.coalesce(F.col("source_step") == F.col("target_step"), F.lit(False)))
    )


def drop_existing_pairs(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates that are not yet linked in either direction."""
    known = edges.select("source", "target")
    both = known.unionAll(known.select(F.col("target"), F.col("source"))).distinct()
    return candidates.join(both, ["source", "target"], "left_anti")


def ego_node_ids(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, txId): each root and its direct neighbours."""
    r = roots.select(F.col("txId").alias("root")).distinct()
    both = edges.select("source", "target").unionAll(edges.select(F.col("target"), F.col("source")))
    near = both.join(r.withColumnRenamed("root", "source"), "source").select(
        F.col("source").alias("root"), F.col("target").alias("txId")
    )
    return near.unionAll(r.select("root", F.col("root").alias("txId"))).distinct()


def ego_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("txId").distinct(), "txId", "left_semi")


def ego_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(root, source, target): edges with both ends in the same root's set."""
    first = ids.select("root", F.col("txId").alias("source"))
    second = ids.select("root", F.col("txId").alias("target"))
    return edges.select("source", "target").join(first, "source").join(second, ["root", "target"], "left_semi").select(
        "root", "source", "target"
    )


def alerts_with_tx(alerts: DataFrame, tx: DataFrame) -> DataFrame:
    return alerts.join(tx.select("tx_id", *[c for c in tx.columns if c not in alerts.columns]), "tx_id")


def investigate(alerts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Investigation answer per alert: score as a share, fixed verdict, five leading contributions."""
    return alerts.join(evidence.select("tx_id", "xai_breakdown"), "tx_id").select(
        "tx_id", "risk_level", F.round(F.col("threat_score") / 100, 6).alias("risk_score"),
        F.lit("suspicious").alias("prediction"), F.slice("xai_breakdown", 1, 5).alias("feature_weights"),
    )


def unflagged(tx: DataFrame, evidence: DataFrame) -> DataFrame:
    return tx.join(evidence.select("tx_id"), "tx_id", "left_anti")


def annotate_nodes(nodes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Score, level and anomaly of alerted transactions on their graph nodes."""
    marks = alerts.select(F.col("tx_id").alias("id"), "threat_score", "risk_level", "primary_anomaly")
    kept = nodes.drop("threat_score", "risk_level", "primary_anomaly")
    return kept.join(marks, "id", "left").withColumn("risk", F.coalesce(F.lower("risk_level"), F.col("risk")))


def latest_feedback(feedback: DataFrame, by: str = "tx_id") -> DataFrame:
    return feedback.groupBy(by).agg(
        F.max_by("human_label", F.struct("timestamp", "human_label")).alias("human_label")
    )


def apply_feedback(nodes: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(patched, unknown)``: the last label per node wins and puts the node into the training set."""
    # "7" and "07" are reviews of one node, so ids are cast before they are grouped.
    typed = feedback.withColumn("txId", F.col("tx_id").try_cast("bigint"))
    last = latest_feedback(typed.filter("txId is not null"), "txId")
    patched = (
        nodes.join(last, "txId", "left")
        .withColumn("class", F.coalesce("human_label", "class"))
        .withColumn("is_train", F.coalesce("is_train", F.lit(False)) | F.col("human_label").isNotNull())
        .drop("human_label")
    )
    unknown = latest_feedback(typed.join(nodes.select("txId").distinct(), "txId", "left_anti"))
    return patched, unknown


def index_nodes(nodes: DataFrame) -> DataFrame:
    """Dense 0-based number per node in id order, without a single-task sort."""
    return row_number(nodes.select("txId"), ["txId"], "__n").select("txId", (F.col("__n") - 1).alias("idx"))


def index_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges as number pairs; an edge without both ends is dropped as a whole."""
    return (
        edges.join(index.toDF("source", "src"), "source").join(index.toDF("target", "dst"), "target").select("src", "dst")
    )
