"""Ledgers derived from the shared tables, with the same definitions as SQL for comparison.

``E`` one transaction per event: spends the change of the same user's previous event, pays a hub.
``O`` one transaction per order: returned lines are inputs, the others outputs.
``V`` order nodes and order-to-order links inside one time step.
``R`` the event ledger as raw text columns, with malformed cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinweave.operators.components import entities
from coinweave.operators.graph import build_edges, build_nodes
from coinweave.operators.heuristics import fan_patterns
from coinweave.operators.ledger import Ledger, from_lines, from_transactions, latest_receipt
from coinweave.operators.links import enrich_ip, prefix_table
from coinweave.operators.neighbours import incidence, neighbour_illicit_ratio
from coinweave.operators.ordering import neighbour_in_order
from coinweave.operators.peel import peel_chains
from coinweave.operators.scoring import feature_vector, rule_score
from coinweave.plans.pipeline import graph_size
from coinweave.session import materialize, memo

# The event ledger is sparse in time, so its chains are followed over six hours.
CHAIN_SECONDS = 21_600
ORDER_FAN_SECONDS = 3_600

PREFIXES = [
    ("10.0.0.0/16", "NL", "AS208323", "Tor Transit"),
    ("10.1.0.0/16", "US", "AS13335", "Cloudflare"),
    ("10.1.7.0/24", "RO", "AS9009", "M247 Europe SRL"),
    ("10.2.0.0/16", "US", "AS8075", "Microsoft Corporation"),
    ("10.3.0.0/16", "IE", "AS16509", "Amazon.com"),
]

# ---------------------------------------------------------------- definitions shared by both engines

EVENT_BASE = """
SELECT 'tx_' || event_id AS tx_id, event_id, user_id, event_type, k, ts, {us} AS us,
  CASE event_type WHEN 'error' THEN 'illicit' WHEN 'purchase' THEN 'licit' ELSE 'unknown' END AS label,
  CAST(1 + least(48, floor(({us} - 1704067200000000) / 5.4e10)) AS INT) AS time_step,
  CASE WHEN prev IS NULL THEN 'bc1seed' || user_id WHEN prev % 2 = 1 THEN 'bc1c' || prev ELSE '1c' || prev END AS in_addr,
  120000000 + (event_id % 500) * 2000000 AS in_amt,
  CASE WHEN k % 3 = 0 THEN 'bc1m' || k ELSE '1m' || k END AS pay_addr,
  CASE WHEN event_type = 'signup' THEN CAST(9000000 AS BIGINT) ELSE 8000000 + (event_id % 3) * 50000 END AS pay_amt,
  CASE WHEN event_id % 2 = 1 THEN 'bc1c' || event_id ELSE '1c' || event_id END AS chg_addr,
  k % 10 = 0 AS pays_exchange,
  '10.' || (user_id % 5) || '.' || k || '.' || (event_id % 250 + 1) AS src_ip,
  '192.0.2.' || (event_id % 200 + 1) AS dst_ip,
  CAST(8333 + event_id % 200 AS INT) AS src_port, CAST(8333 AS INT) AS dst_port
FROM {source}
"""

ORDER_LINES = """
SELECT 'o_' || l_orderkey AS tx_id,
  CASE WHEN l_partkey % 2 = 1 THEN 'bc1w' || l_partkey ELSE '1w' || l_partkey END AS address,
  CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS amount_sats,
  CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos,
  l_returnflag = 'R' AS is_input, l_partkey % 50 = 0 AS is_exchange
FROM {source}
"""

RAW_TEXT = """
SELECT event_id, tx_id AS txId,
  CASE WHEN event_id % 101 = 3 THEN 'bogus' WHEN label = 'illicit' THEN ' Illicit ' WHEN label = 'licit' THEN '2'
       WHEN event_id % 2 = 0 THEN 'class-3' ELSE 'UNKNOWN' END AS class,
  CASE WHEN event_id % 103 = 5 THEN '50' WHEN event_id % 103 = 6 THEN '2.5' WHEN event_id % 103 = 7 THEN 'x'
       WHEN event_id % 103 = 8 THEN NULL ELSE CAST(time_step AS STRING) END AS time_step,
  in_addr AS inputs,
  CASE WHEN event_id % 2 = 0 THEN pay_addr || '; ' || chg_addr || ';' ELSE '["' || pay_addr || '", "' || chg_addr || '"]' END AS outputs,
  CASE WHEN event_id % 107 = 2 THEN '1;2' WHEN event_id % 107 = 3 THEN 'abc' WHEN event_id % 107 = 4 THEN '100.5'
       WHEN event_id % 107 = 5 THEN '-1' WHEN event_id % 107 = 6 THEN '1' ELSE CAST(in_amt AS STRING) END AS input_satoshis,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE pay_amt || '|' || (in_amt - pay_amt - 15000) END AS output_satoshis,
  CASE WHEN event_id % 109 = 4 THEN '10.0.0.256' ELSE src_ip END AS source_ip,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE dst_ip END AS dst_ip,
  CASE WHEN event_id % 113 = 9 THEN '70000' WHEN event_id % 113 = 10 THEN '8333.5' ELSE CAST(src_port AS STRING) END AS src_port,
  '8333' AS destination_port,
  CASE WHEN event_id % 127 = 1 THEN 'yesterday' WHEN event_id % 5 = 0 THEN NULL
       WHEN event_id % 5 = 1 THEN CAST(us / 1000000 AS STRING) ELSE '2024-01-02T03:04:05Z' END AS time,
  '' AS parent_tx_id, CASE WHEN pays_exchange THEN pay_addr END AS exchange_address,
  CAST(event_id % 10 AS STRING) AS feature_1, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE '2.5' END AS feature_2
FROM {source}
"""

# ---------------------------------------------------------------- the same as common table expressions

E = (
    "ev AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),\n"
    "eb AS (" + EVENT_BASE.format(us="epoch_us(ts)", source="ev") + "),\n"
    """e AS (SELECT *, in_amt - pay_amt - 15000 AS chg_amt,
  CASE user_id % 5 WHEN 0 THEN 'AS208323' WHEN 1 THEN CASE WHEN k = 7 THEN 'AS9009' ELSE 'AS13335' END
       WHEN 2 THEN 'AS8075' WHEN 3 THEN 'AS16509' ELSE 'AS0' END AS asn,
  CASE user_id % 5 WHEN 0 THEN 'Tor Transit' WHEN 1 THEN CASE WHEN k = 7 THEN 'M247 Europe SRL' ELSE 'Cloudflare' END
       WHEN 2 THEN 'Microsoft Corporation' WHEN 3 THEN 'Amazon.com' ELSE 'Unallocated' END AS asn_description,
  CASE user_id % 5 WHEN 0 THEN 'NL' WHEN 1 THEN CASE WHEN k = 7 THEN 'RO' ELSE 'US' END
       WHEN 2 THEN 'US' WHEN 3 THEN 'IE' END AS country
  FROM eb)"""
)
E_LONG = """sp AS (SELECT in_addr AS address, tx_id, 0 AS pos, in_amt AS amount_sats, us FROM e),
rc AS (SELECT pay_addr AS address, tx_id, 0 AS pos, pay_amt AS amount_sats, us, pays_exchange AS is_exchange FROM e
  UNION ALL SELECT chg_addr, tx_id, 1, chg_amt, us, false FROM e)"""
O = (  # noqa: E741
    "ot AS (SELECT 'o_' || o_orderkey AS tx_id, epoch_us(o_orderdate) + (o_orderkey % 600) * 1000000 AS us, "
    "CASE o_orderstatus WHEN 'F' THEN 'licit' WHEN 'P' THEN 'illicit' ELSE 'unknown' END AS label FROM orders),\n"
    "ol AS (SELECT l.*, us FROM (" + ORDER_LINES.format(source="lineitem") + ") l JOIN ot USING (tx_id)),\n"
    """sp AS (SELECT address, tx_id, pos, amount_sats, us FROM ol WHERE is_input),
rc AS (SELECT address, tx_id, pos, amount_sats, us, is_exchange FROM ol WHERE NOT is_input)"""
)
LATEST = """lr AS (SELECT address, tx_id AS parent_tx, amount_sats AS parent_amount, us AS parent_us FROM rc
  QUALIFY row_number() OVER (PARTITION BY address ORDER BY us DESC, tx_id DESC, pos DESC) = 1)"""
CHILDREN = """ch AS (SELECT lr.parent_tx AS parent, sp.tx_id AS child, sp.address, sp.us AS child_us, lr.parent_us
  FROM sp JOIN lr USING (address) WHERE sp.tx_id <> lr.parent_tx)"""
INCIDENCE = "inc AS (SELECT address, tx_id FROM sp UNION SELECT address, tx_id FROM rc)"
NEIGHBOURS = """nb AS (SELECT DISTINCT a.tx_id, b.tx_id AS neighbour FROM inc a JOIN inc b USING (address)
  WHERE a.tx_id <> b.tx_id)"""
PEEL_E = f"""m AS (SELECT tx_id, least(pay_amt, chg_amt) AS m FROM e),
oc AS (SELECT parent, min(child) AS child, min(child_us) AS child_us, min(parent_us) AS parent_us FROM ch
  GROUP BY parent HAVING count(*) = 1),
ln AS (SELECT parent AS prev, child AS next FROM oc WHERE child_us - parent_us BETWEEN 0 AND {CHAIN_SECONDS}000000),
wk AS (SELECT tx_id AS start, tx_id AS cur, [tx_id] AS path, CAST([] AS BIGINT[]) AS amts FROM e
  UNION ALL SELECT wk.start, ln.next, list_append(path, ln.next), list_concat(amts, [a.m, b.m])
  FROM wk JOIN ln ON wk.cur = ln.prev JOIN m a ON a.tx_id = ln.prev JOIN m b ON b.tx_id = ln.next
  WHERE len(path) < 10000),
pl AS (SELECT DISTINCT unnest(path) AS tx_id FROM (
  SELECT path, list_aggregate(amts, 'median') AS md, list_max(amts) AS hi, list_min(amts) AS lo FROM wk
  WHERE cur NOT IN (SELECT prev FROM ln) AND len(path) >= 3)
  WHERE abs(hi - md) / greatest(md, 1) <= 0.08 AND abs(lo - md) / greatest(md, 1) <= 0.08)"""
SCORED_E = """fe AS (SELECT e.*, in_amt / 1e8 AS tx_volume, greatest(in_amt - pay_amt - chg_amt, 0) / greatest(in_amt, 1) AS fee_ratio,
    CAST(1 AS DOUBLE) AS input_count, CAST(2 AS DOUBLE) AS output_count,
    coalesce(r.ratio, 0.0) AS neighbor_illicit_ratio, coalesce(d.delta, 0.0) AS parent_time_delta,
    CAST(4 AS DOUBLE) / (SELECT count(*) - 1 FROM (SELECT tx_id FROM e UNION SELECT address FROM inc
      UNION SELECT src_ip FROM e UNION SELECT asn FROM e)) AS degree_centrality,
    CASE WHEN asn_description IN ('Tor Transit', 'NForce Entertainment B.V.', 'M247 Europe SRL') THEN 1.0 ELSE 0.0 END AS tor,
    CASE WHEN pl.tx_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS peel
  FROM e LEFT JOIN (SELECT nb.tx_id, CAST(count(*) FILTER (x.label = 'illicit') AS DOUBLE) / count(*) AS ratio
      FROM nb JOIN e x ON x.tx_id = nb.neighbour GROUP BY 1) r USING (tx_id)
    LEFT JOIN (SELECT child AS tx_id, min(abs(child_us - parent_us)) / 1e6 AS delta FROM ch GROUP BY 1) d USING (tx_id)
    LEFT JOIN pl USING (tx_id)),
te AS (SELECT *, least(tx_volume / 5.0::DOUBLE, 1.0::DOUBLE) * 12 AS t1, least(fee_ratio * 80, 1.0::DOUBLE) * 8 AS t2,
    least(input_count / 8, 1.0::DOUBLE) * 7 AS t3, least(output_count / 8, 1.0::DOUBLE) * 7 AS t4,
    neighbor_illicit_ratio * 10 AS t5, CASE WHEN parent_time_delta > 0 AND parent_time_delta <= 25 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS t6,
    least(degree_centrality * 50, 1.0::DOUBLE) * 6 AS t7, CAST(tor * 22 AS DOUBLE) AS t8, CAST(peel * 18 AS DOUBLE) AS t9 FROM fe),
sc AS (SELECT *, greatest(0.0::DOUBLE, least((t1+t2+t3+t4+t5+t6+t7+t8+t9 + CASE WHEN label = 'illicit' THEN 10 ELSE 0 END) / 100.0::DOUBLE, 1.0::DOUBLE)) AS p FROM te),
se AS (SELECT *, CAST(round_even(p * 100, 0) AS INT) AS threat_score FROM sc),
al AS (SELECT tx_id, threat_score, us,
    CASE WHEN peel = 1 THEN 'Peel Chain to Exchange' WHEN tor = 1 THEN 'Physical IP Anomaly' ELSE 'GNN Transaction Anomaly' END AS primary_anomaly,
    CASE WHEN threat_score >= 90 THEN 'CRITICAL' WHEN threat_score >= 75 THEN 'HIGH' WHEN threat_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM se WHERE threat_score >= 50)"""
ALERTS_E = (E, E_LONG, LATEST, CHILDREN, INCIDENCE, NEIGHBOURS, PEEL_E, SCORED_E)
V = """vn AS (SELECT o_orderkey AS txId, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 ELSE -1 END AS class,
    CAST(1 + o_orderkey % 49 AS INT) AS time_step, o_totalprice AS feat_1, CAST(o_custkey % 97 AS DOUBLE) AS feat_2,
    o_orderpriority AS priority FROM orders),
vr AS (SELECT l_orderkey AS source, l_orderkey + 49 * l_linenumber AS target,
    max(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS amount_sats
  FROM lineitem GROUP BY 1, 2),
ve AS (SELECT vr.* FROM vr WHERE source IN (SELECT txId FROM vn) AND target IN (SELECT txId FROM vn))"""
# Rounds go on until a state equals the one two rounds before; alternating nodes take the smaller label.
COMMUNITIES = """vs AS MATERIALIZED (SELECT DISTINCT source, target FROM (SELECT source, target FROM ve UNION ALL SELECT target, source FROM ve) WHERE source <> target),
vl AS MATERIALIZED (SELECT source, target FROM vs UNION ALL SELECT txId, txId FROM vn),
cr AS (SELECT 0 AS round, txId, txId AS label, CAST(NULL AS BIGINT) AS before FROM vn
  UNION ALL SELECT round + 1, txId, fresh, label FROM (SELECT *, max(CAST(fresh IS DISTINCT FROM before AS INT)) OVER () AS news FROM (
    SELECT c.round, c.txId, c.label, c.before, w.label AS fresh FROM cr c JOIN (
      SELECT vl.target AS txId, x.label, row_number() OVER (PARTITION BY vl.target ORDER BY count(*) DESC, x.label) AS r
      FROM vl JOIN cr x ON x.txId = vl.source GROUP BY 1, 2) w ON w.txId = c.txId AND w.r = 1)) WHERE news = 1),
cl AS MATERIALIZED (SELECT txId, time_step, least(label, before) AS label, dense_rank() OVER (ORDER BY time_step, least(label, before)) - 1 AS cioh_cluster_id
  FROM cr JOIN vn USING (txId) WHERE round = (SELECT max(round) FROM cr))"""
HUBS = """cs AS (SELECT cioh_cluster_id, count(*) AS size FROM cl GROUP BY 1),
hb AS (SELECT cioh_cluster_id, size, CAST(size >= (SELECT quantile_cont(size, 0.995) FROM cs) AS INT) AS is_vasp_excluded_cluster FROM cs)"""
CHANGES_V = """vf AS (SELECT ve.*, CAST(coalesce(a.cioh_cluster_id = b.cioh_cluster_id, false) AND amount_sats % 1000000 <> 0 AS INT) AS is_change_output
  FROM ve LEFT JOIN cl a ON a.txId = ve.source LEFT JOIN cl b ON b.txId = ve.target)"""
REUSE_V = """ru AS (SELECT txId AS source, nx AS target FROM (SELECT cl.txId, lead(cl.txId) OVER (PARTITION BY cl.cioh_cluster_id ORDER BY cl.txId) AS nx
    FROM cl JOIN hb USING (cioh_cluster_id) WHERE is_vasp_excluded_cluster = 0 AND size >= 3) t
  WHERE nx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ve WHERE (ve.source = t.txId AND ve.target = t.nx) OR (ve.source = t.nx AND ve.target = t.txId)))"""


# ---------------------------------------------------------------- Spark side


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prefixes(spark: SparkSession) -> DataFrame:
    return prefix_table(spark.createDataFrame(PREFIXES, "cidr string, country string, asn string, asn_description string"))


def _sql_over(df: DataFrame, text: str, **names: str) -> DataFrame:
    return df.sparkSession.sql(text.format(source="{source}", **names), source=df)


def event_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the scalar parts of its transaction."""

    def build() -> DataFrame:
        events = load(spark, sf_dir, "events").select(
            "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )
        linked = neighbour_in_order(events, ["user_id", "ts", "event_id"], ["user_id"], ["event_id"], back=True)
        base = _sql_over(linked.withColumnRenamed("prev_event_id", "prev"), EVENT_BASE, us="unix_micros(ts)")
        return materialize(base.withColumn("chg_amt", F.expr("in_amt - pay_amt - 15000")), "events")

    return memo(spark, ("event_base", sf_dir), build)


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger E in the transaction schema, system numbers resolved through the prefix table."""

    def build() -> DataFrame:
        side = lambda a, m: F.struct(F.col(a).alias("address"), F.col(m).alias("amount_sats"))
        none = F.array().cast("array<string>")
        tx = event_base(spark, sf_dir).select(
            "tx_id", "event_id", "label", "ts", "time_step", "src_ip", "dst_ip", "src_port", "dst_port",
            F.array(side("in_addr", "in_amt")).alias("inputs"),
            F.array(side("pay_addr", "pay_amt"), side("chg_addr", "chg_amt")).alias("outputs"),
            none.alias("parent_tx_ids"),
            F.when(F.col("pays_exchange"), F.array("pay_addr")).otherwise(none).alias("exchange_addresses"),
        )
        return materialize(enrich_ip(tx, prefixes(spark)), "event_tx")

    return memo(spark, ("event_tx", sf_dir), build)


def event_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return memo(
        spark, ("event_ledger", sf_dir), lambda: from_transactions(event_transactions(spark, sf_dir)).materialized()
    )


def order_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    def build() -> Ledger:
        tx = load(spark, sf_dir, "orders").select(
            F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("tx_id"),
            F.timestamp_micros(
                F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 600) * 1_000_000
            ).alias("ts"),
            F.when(F.col("o_orderstatus") == "F", "licit").when(F.col("o_orderstatus") == "P", "illicit").otherwise("unknown").alias("label"),
            *[F.lit(None).cast("string").alias(c) for c in ("src_ip", "asn", "asn_description")],
        )
        lines = _sql_over(load(spark, sf_dir, "lineitem"), ORDER_LINES).join(tx.select("tx_id", "ts"), "tx_id")
        cols = ["address", "tx_id", "pos", "amount_sats", "ts"]
        lines = materialize(lines, "order_lines")
        spends = lines.filter("is_input").select(*cols)
        receipts = lines.filter("not is_input").select(*cols, "is_exchange")
        return from_lines(tx, spends, receipts).materialized()

    return memo(spark, ("order_ledger", sf_dir), build)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(
        spark, ("raw", sf_dir), lambda: materialize(_sql_over(event_base(spark, sf_dir), RAW_TEXT), "raw")
    )


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("txId"),
        F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 0).otherwise(-1).alias("class"),
        (1 + F.col("o_orderkey") % 49).cast("int").alias("time_step"),
        F.col("o_totalprice").alias("feat_1"),
        (F.col("o_custkey") % 97).cast("double").alias("feat_2"),
        F.col("o_orderpriority").alias("priority"),
    )


def order_links_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct order-to-order links, some of which point past the last order."""
    amount = F.round(F.col("l_extendedprice") * 100).cast("bigint") * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("source"), (F.col("l_orderkey") + 49 * F.col("l_linenumber")).alias("target"))
        .agg(F.max(amount).alias("amount_sats"))
    )


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with both ends of every edge present."""

    def build():
        nodes = materialize(order_nodes(spark, sf_dir), "nodes")
        ids = nodes.select("txId")
        edges = order_links_raw(spark, sf_dir)
        edges = edges.join(ids.withColumnRenamed("txId", "source"), "source", "left_semi").join(
            ids.withColumnRenamed("txId", "target"), "target", "left_semi"
        )
        return nodes, materialize(edges.select("source", "target", "amount_sats"), "edges")

    return memo(spark, ("order_graph", sf_dir), build)


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence graph of ledger E."""

    def build():
        ledger = event_ledger(spark, sf_dir)
        peel = event_peel(spark, sf_dir)
        return (
            materialize(build_nodes(ledger, entities(ledger.spends, ledger.receipts), peel), "graph_nodes"),
            materialize(build_edges(ledger), "graph_edges"),
        )

    return memo(spark, ("event_graph", sf_dir), build)


def event_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(
        spark, ("event_latest", sf_dir),
        lambda: materialize(latest_receipt(event_ledger(spark, sf_dir).receipts), "latest"),
    )


def event_peel_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peel_chains(event_ledger(spark, sf_dir), event_latest(spark, sf_dir), CHAIN_SECONDS)


def event_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(spark, ("event_peel", sf_dir), lambda: materialize(event_peel_plan(spark, sf_dir), "peel"))


def event_feature_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, latest = event_ledger(spark, sf_dir), event_latest(spark, sf_dir)
    inc = incidence(ledger.spends, ledger.receipts)
    return feature_vector(
        ledger, latest, neighbour_illicit_ratio(inc, ledger.tx), event_peel(spark, sf_dir),
        fan_patterns(ledger, latest), graph_size(ledger),
    )


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memo(
        spark, ("event_features", sf_dir), lambda: materialize(event_feature_plan(spark, sf_dir), "features")
    )


def event_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_score(event_features(spark, sf_dir))
