"""Queries over the ledgers: links, heuristics, graph features, scoring and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinweave.functions import normalize as N
from coinweave.operators import balls, components, evidence, graph, heuristics, ledger, links, neighbours, scoring
from coinweave.operators.audit import audit_evidence, audit_shapes, audit_summary
from coinweave.operators.peel import repeated_small_amount
from coinweave.plans import ledgers as L
from coinweave.plans.catalog import query, with_
from coinweave.session import materialize, memo

us = F.unix_micros


def _order_latest(spark, d):
    return memo(spark, ("order_latest", d), lambda: materialize(ledger.latest_receipt(L.order_ledger(spark, d).receipts), "latest"))


# ---------------------------------------------------------------- joins over addresses


@query("j2_latest_receipt", with_(L.O, L.LATEST, select="SELECT address, parent_tx, parent_amount, parent_us FROM lr"))
def _(spark, d):
    return ledger.latest_receipt(L.order_ledger(spark, d).receipts).select("address", "parent_tx", "parent_amount", us("parent_ts").alias("parent_us"))


@query("j3_spenders", with_(L.O, select="SELECT address, count(*) AS n_spends, min(tx_id) AS first_tx, max(tx_id) AS last_tx FROM sp GROUP BY 1"))
def _(spark, d):
    s = ledger.spenders(L.order_ledger(spark, d).spends)
    return s.groupBy("address").agg(F.count("*").alias("n_spends"), F.min("tx_id").alias("first_tx"), F.max("tx_id").alias("last_tx"))


@query("j4_tx_children", with_(L.O, L.LATEST, L.CHILDREN, select="SELECT parent, child, address FROM ch"))
def _(spark, d):
    return ledger.tx_children(L.order_ledger(spark, d).spends, _order_latest(spark, d)).select("parent", "child", "address")


@query(
    "j5_tx_neighbors",
    with_(L.O, L.INCIDENCE, L.NEIGHBOURS, select="""SELECT ot.tx_id, count(nb.neighbour) AS n_neighbours,
      count(*) FILTER (x.label = 'illicit') AS n_illicit FROM ot LEFT JOIN nb USING (tx_id) LEFT JOIN ot x ON x.tx_id = nb.neighbour GROUP BY 1"""),
)
def _(spark, d):
    """Wallet-sharing transactions per transaction, summed without forming the pairs of busy wallets."""
    o = L.order_ledger(spark, d)
    return neighbours.neighbour_illicit_ratio(neighbours.incidence(o.spends, o.receipts), o.tx).select(
        "tx_id", "n_neighbours", "n_illicit"
    )


@query(
    "j6_tx_edge_index",
    with_(
        *L.ALERTS_E, "pg AS (SELECT tx_id FROM al ORDER BY threat_score DESC, us DESC, tx_id LIMIT 50)",
        select="""SELECT nb.tx_id AS src, nb.neighbour AS dst FROM nb WHERE nb.tx_id IN (SELECT tx_id FROM pg)
          UNION SELECT nb.neighbour, nb.tx_id FROM nb WHERE nb.tx_id IN (SELECT tx_id FROM pg) UNION SELECT tx_id, tx_id FROM e""",
    ),
)
def _(spark, d):
    """Edge list around the first page of alerts, both directions, with one loop per transaction."""
    e = L.event_ledger(spark, d)
    page = scoring.rank_alerts(alerts(spark, d))
    pairs = neighbours.neighbours_of(neighbours.incidence(e.spends, e.receipts), page)
    return neighbours.tx_edge_index(pairs, e.tx)


#: IPv6 prefixes, one without a system and one without a country: each is taken from the longest prefix that has it.
SIX = [
    ("2001:db8::/32", "DE", "AS64500", "Documentation"),
    ("2001:db8:1::/48", None, "AS64501", "Second site"),
    ("2001:db8:2:4::/62", "FR", None, None),
    ("2001:db8::/61", "SE", "AS64502", "Third site"),
]


@query(
    "j7_enrich_ip",
    with_(
        L.E,
        "pf AS (SELECT * FROM (VALUES " + ", ".join(
            f"({sum(int(o) << s for o, s in zip(c.split('/')[0].split('.'), (24, 16, 8, 0)))}, {c.split('/')[1]}, '{k}', '{a}', '{t}')"
            for c, k, a, t in L.PREFIXES
        ) + ") t(lo, len, country, asn, asn_description))",
        "ip AS (SELECT tx_id, event_id, src_ip, split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536 + split_part(src_ip, '.', 3)::BIGINT * 256 + split_part(src_ip, '.', 4)::BIGINT AS v FROM e)",
        """six AS (SELECT tx_id, '2001:db8:' || replace(substr(src_ip, 4, length(src_ip) - 3 - length(split_part(src_ip, '.', 4)) - 1), '.', ':') || '::' || split_part(src_ip, '.', 4) AS src_ip,
          ('0x' || split_part(src_ip, '.', 2))::BIGINT AS g3, ('0x' || split_part(src_ip, '.', 3))::BIGINT AS g4 FROM e WHERE event_id % 3 = 1)""",
        select="""(SELECT ip.tx_id, CASE WHEN event_id % 3 = 2 THEN '::ffff:' ELSE '' END || ip.src_ip AS src_ip, pf.country, coalesce(pf.asn, 'AS0') AS asn, coalesce(pf.asn_description, 'Unallocated') AS asn_description
          FROM ip LEFT JOIN pf ON v BETWEEN lo AND lo + (1::BIGINT << (32 - len)) - 1 WHERE event_id % 3 <> 1
          QUALIFY row_number() OVER (PARTITION BY ip.tx_id ORDER BY len DESC) = 1)
          UNION ALL SELECT tx_id, src_ip, CASE WHEN g3 = 2 AND g4 // 4 = 1 THEN 'FR' WHEN g3 = 0 AND g4 // 8 = 0 THEN 'SE' ELSE 'DE' END,
            CASE WHEN g3 = 1 THEN 'AS64501' WHEN g3 = 0 AND g4 // 8 = 0 THEN 'AS64502' ELSE 'AS64500' END,
            CASE WHEN g3 = 1 THEN 'Second site' WHEN g3 = 0 AND g4 // 8 = 0 THEN 'Third site' ELSE 'Documentation' END FROM six""",
    ),
)
def _(spark, d):
    """A third of the addresses as they are, a third mapped into IPv6, a third IPv6 with the same numbers."""
    base = L.event_base(spark, d)
    parts = F.split("src_ip", r"\.")
    six = F.concat(F.lit("2001:db8:"), F.get(parts, F.lit(1)), F.lit(":"), F.get(parts, F.lit(2)), F.lit("::"), F.get(parts, F.lit(3)))
    src = F.when(F.col("event_id") % 3 == 1, six).when(F.col("event_id") % 3 == 2, F.concat(F.lit("::ffff:"), "src_ip")).otherwise(F.col("src_ip"))
    more = links.prefix_table(spark.createDataFrame(SIX, "cidr string, country string, asn string, asn_description string"))
    return links.enrich_ip(base.select("tx_id", src.alias("src_ip")), L.prefixes(spark).unionByName(more)).select("tx_id", "src_ip", "country", "asn", "asn_description")


@query(
    "j1_link_parents",
    with_(L.E, select="""SELECT a.tx_id, CAST(1 + count(b.tx_id) AS INT) AS n_inputs, a.in_addr || coalesce(';' || max(b.chg_addr), '') AS addresses
        FROM e a LEFT JOIN e b ON b.event_id = a.event_id - 3 AND b.chg_addr <> a.in_addr GROUP BY a.tx_id, a.in_addr"""),
)
def _(spark, d):
    """Every transaction declares the one three numbers earlier, twice, and one that does not exist."""
    earlier = F.concat(F.lit("tx_"), (F.col("event_id") - 3).cast("string"))
    tx = L.event_transactions(spark, d).withColumn("parent_tx_ids", F.array(earlier, F.lit("tx_none"), earlier))
    return ledger.link_parents(tx).select(
        "tx_id", F.size("inputs").alias("n_inputs"), F.array_join("inputs.address", ";").alias("addresses")
    )


# ---------------------------------------------------------------- heuristics

SIDES_O = """fi AS (SELECT tx_id, address AS first_input FROM sp QUALIFY row_number() OVER (PARTITION BY tx_id ORDER BY pos, address) = 1),
su AS (SELECT tx_id, count(*) AS n_in, sum(amount_sats) AS total_in FROM sp GROUP BY 1),
ru0 AS (SELECT tx_id, count(*) AS n_out, sum(amount_sats) AS total_out, min(amount_sats) AS smallest_output, bool_or(is_exchange) AS terminal FROM rc GROUP BY 1),
sr AS (SELECT DISTINCT tx_id, address FROM sp SEMI JOIN rc USING (tx_id, address)),
cg AS (SELECT rc.tx_id, rc.address, rc.amount_sats,
    (CASE WHEN (rc.address LIKE 'bc1%') = (coalesce(fi.first_input, '') LIKE 'bc1%') THEN 1 ELSE 0 END)
    + (CASE WHEN abs(amount_sats / 1e8 - round(amount_sats / 1e8, 2)) > 0.00000001 THEN 1 ELSE 0 END)
    - (CASE WHEN sr.address IS NOT NULL THEN 1 ELSE 0 END) AS score
  FROM rc LEFT JOIN fi USING (tx_id) LEFT JOIN sr ON sr.tx_id = rc.tx_id AND sr.address = rc.address),
co AS (SELECT cg.tx_id, cg.address AS change_address FROM cg JOIN ru0 USING (tx_id) WHERE n_out >= 2
  QUALIFY row_number() OVER (PARTITION BY cg.tx_id ORDER BY score DESC, amount_sats DESC, cg.address DESC) = 1)"""


@query("g5_change_output", with_(L.O, SIDES_O, select="SELECT ot.tx_id, co.change_address FROM ot LEFT JOIN co USING (tx_id)"))
def _(spark, d):
    return L.order_ledger(spark, d).sides.select("tx_id", "change_address")


@query(
    "g5_change_output_in_row",
    with_(L.E, select="""SELECT tx_id, CASE WHEN (s1, chg_amt, chg_addr) > (s0, pay_amt, pay_addr) THEN chg_addr ELSE pay_addr END AS change_address FROM (
      SELECT *, (CASE WHEN (pay_addr LIKE 'bc1%') = (in_addr LIKE 'bc1%') THEN 1 ELSE 0 END) + (CASE WHEN abs(pay_amt / 1e8 - round(pay_amt / 1e8, 2)) > 0.00000001 THEN 1 ELSE 0 END) AS s0,
        (CASE WHEN (chg_addr LIKE 'bc1%') = (in_addr LIKE 'bc1%') THEN 1 ELSE 0 END) + (CASE WHEN abs(chg_amt / 1e8 - round(chg_amt / 1e8, 2)) > 0.00000001 THEN 1 ELSE 0 END) AS s1 FROM e)"""),
)
def _(spark, d):
    """The same rule over the arrays of each transaction, without a shuffle."""
    return L.event_transactions(spark, d).select(
        "tx_id", ledger.change_output(F.col("inputs"), F.col("outputs")).alias("change_address")
    )


@query("g6_address_reuse", with_(L.O, SIDES_O, select="SELECT tx_id, address FROM sr"))
def _(spark, d):
    o = L.order_ledger(spark, d)
    return heuristics.reused_addresses(o.spends, o.receipts)


@query("g8_terminal_exchange", with_(L.E, select="SELECT tx_id, pays_exchange AS terminal_exchange FROM e"))
def _(spark, d):
    return L.event_transactions(spark, d).select(
        "tx_id", ledger.terminal_exchange(F.col("outputs"), F.col("exchange_addresses")).alias("terminal_exchange")
    )


@query(
    "g9_base_features",
    with_(L.O, SIDES_O, select="""SELECT ot.tx_id, coalesce(total_in, 0) / 1e8 AS tx_volume,
      round(greatest(coalesce(total_in, 0) - coalesce(total_out, 0), 0) / greatest(coalesce(total_in, 0), 1), 6) AS fee_ratio,
      CAST(coalesce(n_in, 0) AS DOUBLE) AS input_count, CAST(coalesce(n_out, 0) AS DOUBLE) AS output_count
      FROM ot LEFT JOIN su USING (tx_id) LEFT JOIN ru0 USING (tx_id)"""),
)
def _(spark, d):
    b = ledger.base_features(F.col("total_in"), F.col("total_out"), F.col("n_in"), F.col("n_out"))
    return L.order_ledger(spark, d).sides.select(
        "tx_id", b["tx_volume"].alias("tx_volume"), F.round(b["fee_ratio"], 6).alias("fee_ratio"),
        b["input_count"].alias("input_count"), b["output_count"].alias("output_count"),
    )


ENTITIES_O = """ed0 AS (SELECT DISTINCT fi.first_input AS a, sp.address AS b FROM sp JOIN fi USING (tx_id) WHERE fi.first_input <> sp.address),
ed AS (SELECT a, b FROM ed0 UNION SELECT b, a FROM ed0),
cc(address, root) USING KEY (address) AS (
  SELECT DISTINCT address, address AS root FROM inc
  UNION SELECT u.address, min(u.root) FROM (SELECT ed.b AS address, cc.root FROM cc JOIN ed ON ed.a = cc.address) u
    JOIN recurring.cc AS r ON r.address = u.address WHERE u.root < r.root GROUP BY u.address)"""


def _order_entities(spark, d):
    o = L.order_ledger(spark, d)
    return memo(spark, ("order_entities", d), lambda: materialize(components.entities(o.spends, o.receipts), "entities"))


@query("g3_entities", with_(L.O, L.INCIDENCE, SIDES_O, ENTITIES_O, select="SELECT address, root FROM cc"))
def _(spark, d):
    o = L.order_ledger(spark, d)
    return components.entities(o.spends, o.receipts).select("address", "root")


@query("g4_entity_id", with_(L.O, L.INCIDENCE, SIDES_O, ENTITIES_O, select="SELECT 'entity_' || sha256(root) AS entity_id, count(*) AS n_wallets FROM cc GROUP BY 1"))
def _(spark, d):
    return _order_entities(spark, d).groupBy("entity_id").agg(F.count("*").alias("n_wallets"))


@query("g7_tx_entity_ids", with_(L.O, L.INCIDENCE, SIDES_O, ENTITIES_O, select="SELECT DISTINCT sp.tx_id, 'entity_' || sha256(root) AS entity_id FROM sp JOIN cc USING (address)"))
def _(spark, d):
    return heuristics.tx_entity_ids(L.order_ledger(spark, d).spends, _order_entities(spark, d))


@query(
    "g10_degree_centrality",
    with_(L.O, L.INCIDENCE, """pr AS (SELECT tx_id, address, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS n FROM
        (SELECT tx_id, address, count(*) AS n FROM sp GROUP BY 1, 2) a FULL JOIN (SELECT tx_id, address, count(*) AS n FROM rc GROUP BY 1, 2) b USING (tx_id, address)),
      dg AS (SELECT id, sum(n) AS degree FROM (SELECT tx_id AS id, n FROM pr UNION ALL SELECT address, n FROM pr) GROUP BY 1),
      nd AS (SELECT tx_id AS id FROM ot UNION SELECT address FROM inc)""",
      select="SELECT nd.id, CAST(coalesce(degree, 0) AS BIGINT) AS degree, round(coalesce(degree, 0) / (SELECT count(*) - 1 FROM nd), 9) AS degree_centrality FROM nd LEFT JOIN dg USING (id)"),
)
def _(spark, d):
    o = L.order_ledger(spark, d)
    nodes = o.tx.select(F.col("tx_id").alias("id")).unionAll(
        neighbours.incidence(o.spends, o.receipts).select(F.col("address").alias("id"))
    )
    both = o.spends.select(F.col("address").alias("source"), F.col("tx_id").alias("target")).unionAll(
        o.receipts.select(F.col("tx_id").alias("source"), F.col("address").alias("target"))
    )
    return graph.degree_centrality(nodes, both).select("id", "degree", F.round("degree_centrality", 9).alias("degree_centrality"))


@query(
    "g11_neighbor_illicit_ratio",
    with_(L.E, L.E_LONG, L.INCIDENCE, L.NEIGHBOURS, select="""SELECT e.tx_id, round(coalesce(count(*) FILTER (x.label = 'illicit') / nullif(count(x.tx_id), 0), 0.0), 9) AS neighbor_illicit_ratio
      FROM e LEFT JOIN nb USING (tx_id) LEFT JOIN e x ON x.tx_id = nb.neighbour GROUP BY 1"""),
)
def _(spark, d):
    e = L.event_ledger(spark, d)
    r = neighbours.neighbour_illicit_ratio(neighbours.incidence(e.spends, e.receipts), e.tx)
    return r.select("tx_id", F.round("neighbor_illicit_ratio", 9).alias("neighbor_illicit_ratio"))


@query(
    "g12_parent_time_delta",
    with_(L.E, L.E_LONG, L.LATEST, L.CHILDREN, select="""SELECT e.tx_id, coalesce(min(abs(child_us - parent_us)) / 1e6, 0.0) AS parent_time_delta
      FROM e LEFT JOIN ch ON ch.child = e.tx_id GROUP BY 1"""),
)
def _(spark, d):
    e = L.event_ledger(spark, d)
    delta = heuristics.parent_time_delta(ledger.tx_children(e.spends, L.event_latest(spark, d)))
    return e.tx.select("tx_id").join(delta, "tx_id", "left").select("tx_id", F.coalesce("parent_time_delta", F.lit(0.0)).alias("parent_time_delta"))


@query("g13_peel_chains", with_(L.E, L.E_LONG, L.LATEST, L.CHILDREN, L.PEEL_E, select="SELECT tx_id FROM pl"))
def _(spark, d):
    return L.event_peel_plan(spark, d)


@query(
    "g14_repeated_small_amount",
    with_(L.E, select="""SELECT tx_id, abs(list_max(a) - md) / greatest(md, 1) <= 0.08 AND abs(list_min(a) - md) / greatest(md, 1) <= 0.08 AS repeated
      FROM (SELECT tx_id, a, list_aggregate(a, 'median') AS md FROM (SELECT tx_id, [pay_amt, 8050000, 8100000, 7600000] AS a FROM e))"""),
)
def _(spark, d):
    amounts = F.array("pay_amt", *[F.lit(x).cast("bigint") for x in (8_050_000, 8_100_000, 7_600_000)])
    return L.event_base(spark, d).select("tx_id", repeated_small_amount(amounts).alias("repeated"))


FANS_O = f"""rl AS (SELECT sp.tx_id, abs(sp.us - lr.parent_us) AS dt FROM sp JOIN lr USING (address) WHERE lr.parent_tx <> sp.tx_id
  UNION ALL SELECT rc.tx_id, abs(rc.us - s.us) FROM rc JOIN sp s USING (address) WHERE s.tx_id <> rc.tx_id),
rp AS (SELECT ot.tx_id, coalesce(bool_or(dt <= {L.ORDER_FAN_SECONDS}000000), true) AS rapid FROM ot LEFT JOIN rl USING (tx_id) GROUP BY 1),
fa AS (SELECT ot.tx_id, rapid, coalesce(n_in, 0) = 1 AND coalesce(n_out, 0) >= 5 AS fan_out, coalesce(n_in, 0) >= 5 AND coalesce(n_out, 0) <= 2 AS fan_in
  FROM ot JOIN rp USING (tx_id) LEFT JOIN su USING (tx_id) LEFT JOIN ru0 USING (tx_id))"""


@query("g15_fan_out", with_(L.O, L.LATEST, SIDES_O, FANS_O, select="SELECT tx_id FROM fa WHERE fan_out AND rapid"))
def _(spark, d):
    return heuristics.fan_out(L.order_ledger(spark, d), _order_latest(spark, d), L.ORDER_FAN_SECONDS)


@query("g15_fan_in", with_(L.O, L.LATEST, SIDES_O, FANS_O, select="SELECT tx_id FROM fa WHERE fan_in AND rapid"))
def _(spark, d):
    return heuristics.fan_in(L.order_ledger(spark, d), _order_latest(spark, d), L.ORDER_FAN_SECONDS)


@query("g16_rapid_context", with_(L.O, L.LATEST, SIDES_O, FANS_O, select="SELECT tx_id, rapid FROM fa"))
def _(spark, d):
    o = L.order_ledger(spark, d)
    return heuristics.rapid_context(o.tx, o, _order_latest(spark, d), L.ORDER_FAN_SECONDS)


@query(
    "g17_feature_vector",
    with_(*L.ALERTS_E, select="""SELECT tx_id, tx_volume, round(fee_ratio, 9) AS fee_ratio, input_count, output_count, round(neighbor_illicit_ratio, 9) AS neighbor_illicit_ratio,
      parent_time_delta, round(degree_centrality, 12) AS degree_centrality, CAST(tor AS DOUBLE) AS tor_or_bulletproof_asn, CAST(peel AS DOUBLE) AS peel_chain,
      0.0::DOUBLE AS fan_out, 0.0::DOUBLE AS fan_in, 0.0::DOUBLE AS change_reuse, CAST(CAST(pays_exchange AS INT) AS DOUBLE) AS terminal_exchange FROM fe"""),
)
def _(spark, d):
    f = L.event_feature_plan(spark, d)
    digits = {"fee_ratio": 9, "neighbor_illicit_ratio": 9, "degree_centrality": 12}
    return f.select(
        "tx_id", *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in scoring.FEATURE_ORDER[:13]]
    )


@query(
    "g32_gcn_propagate",
    with_(L.O, L.INCIDENCE, L.NEIGHBOURS, """dd AS (SELECT ot.tx_id, 1.0::DOUBLE + count(nb.neighbour) AS deg FROM ot LEFT JOIN nb USING (tx_id) GROUP BY 1),
      x0 AS (SELECT ot.tx_id, CASE WHEN label = 'illicit' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x FROM ot),
      sn AS (SELECT nb.tx_id, dd.deg, x0.x, nb.neighbour FROM nb JOIN x0 ON x0.tx_id = nb.neighbour JOIN dd ON dd.tx_id = nb.neighbour)""",
      select="""SELECT dd.tx_id, round(any_value(x0.x) / any_value(dd.deg) + coalesce(sum(sn.x / sqrt(sn.deg)), 0) / sqrt(any_value(dd.deg)), 6) AS x
        FROM dd JOIN x0 USING (tx_id) LEFT JOIN sn ON sn.tx_id = dd.tx_id GROUP BY 1"""),
)
def _(spark, d):
    o = L.order_ledger(spark, d)
    x = o.tx.select("tx_id", (F.col("label") == "illicit").cast("double").alias("x"))
    out = neighbours.gcn_propagate(neighbours.incidence(o.spends, o.receipts), x, ["x"], hops=1)
    return out.select("tx_id", F.round("x", 6).alias("x"))


# ---------------------------------------------------------------- scoring and alerts


def alerts(spark, d):
    return memo(spark, ("alerts", d), lambda: materialize(scoring.alerts(L.event_scored(spark, d)), "alerts"))


@query(
    "m1_rule_score",
    with_(*L.ALERTS_E, select="""SELECT tx_id, threat_score, round(p, 9) AS probability, round(greatest(0.0, 1.0 - p), 5) AS p_licit FROM se"""),
)
def _(spark, d):
    s = L.event_scored(spark, d)
    return s.select("tx_id", "threat_score", F.round("probability", 9).alias("probability"), F.round(F.greatest(F.lit(0.0), 1.0 - F.col("probability")), 5).alias("p_licit"))


@query(
    "m2_normalize_probabilities",
    with_(L.E, """pr AS (SELECT tx_id, CAST(event_id % 7 AS DOUBLE) AS a, CAST(event_id % 5 - 1 AS DOUBLE) AS b, CAST(event_id % 3 AS DOUBLE) AS c FROM e),
      cl AS (SELECT tx_id, greatest(a, 0) AS a, greatest(b, 0) AS b, greatest(c, 0) AS c FROM pr),
      sh AS (SELECT tx_id, a / t AS a, b / t AS b, c / t AS c FROM (SELECT *, CASE WHEN a + b + c = 0 THEN 1 ELSE a + b + c END AS t FROM cl))""",
      select="""SELECT tx_id, CAST(round_even((b + c) * 100, 0) AS INT) AS threat_score, round(a, 6) AS p_licit, round(b, 6) AS p_illicit,
        round(greatest(0.0, 1.0 - round(a, 6) - round(b, 6)), 6) AS p_anomalous FROM sh"""),
)
def _(spark, d):
    b = L.event_base(spark, d)
    parts = scoring.normalize_probabilities(F.col("event_id") % 7, F.col("event_id") % 5 - 1, F.col("event_id") % 3)
    return b.select("tx_id", *[c.alias(n) for n, c in parts.items()])


@query("n21_risk_level", with_(*L.ALERTS_E, select="SELECT CASE WHEN threat_score >= 90 THEN 'CRITICAL' WHEN threat_score >= 75 THEN 'HIGH' WHEN threat_score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, count(*) AS n FROM se GROUP BY 1"))
def _(spark, d):
    return L.event_scored(spark, d).groupBy(scoring.risk_level(F.col("threat_score")).alias("risk_level")).agg(F.count("*").alias("n"))


@query("n22_primary_anomaly", with_(*L.ALERTS_E, select="SELECT tx_id, CASE WHEN peel = 1 THEN 'Peel Chain to Exchange' WHEN tor = 1 THEN 'Physical IP Anomaly' ELSE 'GNN Transaction Anomaly' END AS primary_anomaly FROM se"))
def _(spark, d):
    return L.event_scored(spark, d).select("tx_id", scoring.primary_anomaly().alias("primary_anomaly"))


@query("n23_node_risk", with_(*L.ALERTS_E, select="""SELECT se.tx_id, coalesce(lower(al.risk_level), CASE WHEN peel = 1 OR tor = 1 THEN 'high' ELSE 'medium' END) AS risk FROM se LEFT JOIN al USING (tx_id)"""))
def _(spark, d):
    nodes, _ = L.event_graph(spark, d)
    marked = links.annotate_nodes(nodes.filter("label = 'Transaction'"), alerts(spark, d))
    return marked.select(F.col("id").alias("tx_id"), "risk")


@query("n24_prediction", with_(*L.ALERTS_E, select="SELECT tx_id, CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'licit' END AS prediction FROM se"))
def _(spark, d):
    return L.event_scored(spark, d).select("tx_id", scoring.prediction(F.col("probability")).alias("prediction"))


ALERT_SQL = with_(*L.ALERTS_E, select="SELECT tx_id, threat_score, us AS ts_us, primary_anomaly, risk_level FROM al")


@query("n25_alerts", ALERT_SQL)
def _(spark, d):
    return scoring.alerts(L.event_scored(spark, d)).select("tx_id", "threat_score", us("ts").alias("ts_us"), "primary_anomaly", "risk_level")


@query("w1_rank_alerts", with_(*L.ALERTS_E, select="SELECT tx_id, threat_score, us AS ts_us, primary_anomaly, risk_level FROM al ORDER BY threat_score DESC, us DESC, tx_id LIMIT 50 OFFSET 10"))
def _(spark, d):
    page = scoring.rank_alerts(scoring.alerts(L.event_scored(spark, d)), 50, 10)
    return page.select("tx_id", "threat_score", us("ts").alias("ts_us"), "primary_anomaly", "risk_level")


@query("j13_alerts_with_tx", with_(*L.ALERTS_E, select="SELECT al.tx_id, al.threat_score, e.time_step, e.src_ip, e.label FROM al JOIN e USING (tx_id)"))
def _(spark, d):
    return links.alerts_with_tx(alerts(spark, d), L.event_ledger(spark, d).tx).select("tx_id", "threat_score", "time_step", "src_ip", "label")


@query("j16_annotate_nodes", with_(*L.ALERTS_E, select="SELECT e.tx_id AS id, al.threat_score, al.risk_level, al.primary_anomaly FROM e LEFT JOIN al USING (tx_id)"))
def _(spark, d):
    nodes, _ = L.event_graph(spark, d)
    return links.annotate_nodes(nodes, alerts(spark, d)).filter("label = 'Transaction'").select("id", "threat_score", "risk_level", "primary_anomaly")


@query("a1_count_alerts", with_(*L.ALERTS_E, select="SELECT count(*) AS total_count FROM al"))
def _(spark, d):
    return alerts(spark, d).agg(F.count("*").alias("total_count"))


# ---------------------------------------------------------------- evidence

TERMS_SQL = """tr AS (SELECT tx_id, threat_score, unnest(['tx_volume', 'fee_ratio', 'input_count', 'output_count', 'neighbor_illicit_ratio', 'parent_time_delta', 'degree_centrality', 'tor_or_bulletproof_asn', 'peel_chain']) AS feature,
    unnest([t1, t2, t3, t4, t5, t6, t7, t8, t9]) AS raw, unnest([1,2,3,4,5,6,7,8,9]) AS i FROM se WHERE threat_score >= 50),
tp AS (SELECT *, raw / total * threat_score AS exact FROM (SELECT *, sum(raw ORDER BY i) OVER (PARTITION BY tx_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM tr WHERE raw > 0)),
tq AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY exact - floor(exact) DESC, feature DESC) AS r, threat_score - sum(floor(exact)) OVER (PARTITION BY tx_id) AS missing FROM tp),
ct AS (SELECT tx_id, threat_score, feature, i, CAST(floor(exact) + CASE WHEN r <= missing THEN 1 ELSE 0 END AS INT) AS points FROM tq),
cx AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY points DESC, i) AS place FROM ct WHERE points > 0)"""
LABEL_SQL = "CASE feature " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in evidence.FEATURE_LABELS.items()) + " END"


def explained_plan(spark, d):
    return evidence.explain(L.event_scored(spark, d).filter(F.col("threat_score") >= scoring.ALERT_THRESHOLD))


def explained(spark, d):
    return memo(spark, ("explained", d), lambda: materialize(explained_plan(spark, d), "explained"))


@query("e1_local_attribution", with_(*L.ALERTS_E, TERMS_SQL, select="SELECT tx_id, feature, round(raw, 6) AS raw FROM tr WHERE raw > 0"))
def _(spark, d):
    s = L.event_scored(spark, d).filter(F.col("threat_score") >= scoring.ALERT_THRESHOLD)
    return s.select("tx_id", F.inline(evidence.local_attribution())).filter("raw > 0").select("tx_id", "feature", F.round("raw", 6).alias("raw"))


@query("e2_contributions", with_(*L.ALERTS_E, TERMS_SQL, select="SELECT tx_id, feature, points FROM cx"))
def _(spark, d):
    return explained_plan(spark, d).select("tx_id", F.inline("points"))


@query("w3_largest_remainder", with_(*L.ALERTS_E, TERMS_SQL, select="SELECT tx_id, threat_score, CAST(sum(points) AS INT) AS total, count(*) AS n_features FROM cx GROUP BY 1, 2"))
def _(spark, d):
    return explained(spark, d).select("tx_id", "threat_score", F.inline("points")).groupBy("tx_id", "threat_score").agg(
        F.sum("points").cast("int").alias("total"), F.count("*").alias("n_features")
    )


@query("w8_dominant_order", with_(*L.ALERTS_E, TERMS_SQL, select="SELECT tx_id, CAST(place AS INT) AS place, feature FROM cx"))
def _(spark, d):
    return explained(spark, d).select("tx_id", F.posexplode("points").alias("place", "p")).select("tx_id", (F.col("place") + 1).alias("place"), "p.feature")


@query("e3_feature_labels", with_(*L.ALERTS_E, TERMS_SQL, select=f"SELECT {LABEL_SQL} AS label, count(*) AS n FROM cx GROUP BY 1"))
def _(spark, d):
    return explained(spark, d).select(F.explode("xai_breakdown.feature").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("e4_feature_value", with_(*L.ALERTS_E, TERMS_SQL, select="""SELECT cx.tx_id, feature, CASE feature WHEN 'tor_or_bulletproof_asn' THEN asn_description || ' (' || asn || ')' WHEN 'peel_chain' THEN 'Peel Chain Structure'
   WHEN 'input_count' THEN '1.0' WHEN 'output_count' THEN '2.0' END AS value FROM cx JOIN e USING (tx_id) WHERE feature IN ('tor_or_bulletproof_asn', 'peel_chain', 'input_count', 'output_count')"""))
def _(spark, d):
    x = explained(spark, d).select("tx_id", F.explode(F.arrays_zip("points", "xai_breakdown")).alias("z"))
    x = x.select("tx_id", F.col("z.points.feature").alias("feature"), F.col("z.xai_breakdown.value").alias("value"))
    return x.filter(F.col("feature").isin("tor_or_bulletproof_asn", "peel_chain", "input_count", "output_count"))


@query("a9_contribution_total", with_(*L.ALERTS_E, select="SELECT tx_id, CAST(threat_score AS DOUBLE) AS total FROM al"))
def _(spark, d):
    from coinweave.operators.metrics import contribution_total

    return contribution_total(explained(spark, d))


# ---------------------------------------------------------------- evidence graph

GRAPH_NODES = """wr AS (SELECT address, max(p) AS p FROM (SELECT address, CASE WHEN is_exchange THEN 4 ELSE 1 END AS p FROM rc
    UNION ALL SELECT address, 2 FROM sp UNION ALL SELECT change_address, 3 FROM ce) GROUP BY 1),
gn AS (SELECT tx_id AS id, 'Transaction' AS label, 'hub' AS type, NULL AS info FROM e
  UNION ALL SELECT address, 'WalletAddress', CASE p WHEN 4 THEN 'exchange' WHEN 3 THEN 'change' WHEN 2 THEN 'input' ELSE 'output' END, NULL FROM wr
  UNION ALL SELECT src_ip, 'IPAddress', 'network', max(country) FROM e GROUP BY src_ip
  UNION ALL SELECT asn, 'ASN', 'infrastructure', max(asn_description) FROM e GROUP BY asn)"""
CHANGE_E = """ce AS (SELECT tx_id, CASE WHEN (s1, chg_amt, chg_addr) > (s0, pay_amt, pay_addr) THEN chg_addr ELSE pay_addr END AS change_address FROM (
  SELECT *, (CASE WHEN (pay_addr LIKE 'bc1%') = (in_addr LIKE 'bc1%') THEN 1 ELSE 0 END) + (CASE WHEN abs(pay_amt / 1e8 - round(pay_amt / 1e8, 2)) > 0.00000001 THEN 1 ELSE 0 END) AS s0,
    (CASE WHEN (chg_addr LIKE 'bc1%') = (in_addr LIKE 'bc1%') THEN 1 ELSE 0 END) + (CASE WHEN abs(chg_amt / 1e8 - round(chg_amt / 1e8, 2)) > 0.00000001 THEN 1 ELSE 0 END) AS s1 FROM e))"""
GRAPH_EDGES = """ge AS (SELECT address AS source, tx_id AS target, 'SPENT' AS relationship, amount_sats, us, NULL AS src_port, NULL AS dst_ip, NULL AS dst_port FROM sp
  UNION ALL SELECT tx_id, address, 'RECEIVED', amount_sats, us, NULL, NULL, NULL FROM rc
  UNION ALL SELECT tx_id, src_ip, 'BROADCAST_FROM', NULL, us, src_port, dst_ip, dst_port FROM e
  UNION ALL SELECT src_ip, asn, 'BELONGS_TO', NULL, NULL, NULL, NULL, NULL FROM e)"""


@query("g1_build_nodes", with_(L.E, L.E_LONG, CHANGE_E, GRAPH_NODES, select="SELECT id, label, type, info, CASE WHEN label = 'WalletAddress' THEN 'entity_' || sha256(id) END AS entity_id FROM gn"))
def _(spark, d):
    led = L.event_ledger(spark, d)
    nodes = graph.build_nodes(led, components.entities(led.spends, led.receipts), L.event_peel(spark, d))
    return nodes.select("id", "label", "type", F.coalesce("country", "description").alias("info"), "entity_id")


@query("g2_build_edges", with_(L.E, L.E_LONG, GRAPH_EDGES, select="SELECT source, target, relationship, amount_sats, us AS ts_us, src_port, dst_ip, dst_port FROM ge"))
def _(spark, d):
    edges = graph.build_edges(L.event_ledger(spark, d))
    return edges.select("source", "target", "relationship", "amount_sats", us("ts").alias("ts_us"), "src_port", "dst_ip", "dst_port")


ISO_SQL = "strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ')"
HOPS = graph.DEFAULT_HOPS
# Every node with all it shows in a payload, and every link with a number of its own.
PAYLOAD_SQL = """nd AS MATERIALIZED (SELECT gn.id, gn.label, gn.type, CASE WHEN se.tx_id IS NULL THEN NULL ELSE coalesce(lower(al.risk_level), CASE WHEN peel = 1 OR tor = 1 THEN 'high' ELSE 'medium' END) END AS risk,
    se.us, se.src_port, se.dst_ip, se.dst_port, CASE WHEN gn.label = 'IPAddress' THEN info END AS country, CASE WHEN gn.label = 'ASN' THEN info END AS description,
    CASE WHEN gn.label = 'WalletAddress' THEN 'entity_' || sha256(gn.id) END AS entity_id, al.threat_score, al.risk_level, al.primary_anomaly
  FROM gn LEFT JOIN se ON se.tx_id = gn.id LEFT JOIN al ON al.tx_id = gn.id),
ed AS MATERIALIZED (SELECT row_number() OVER () AS eid, * FROM ge),
pg AS MATERIALIZED (SELECT tx_id AS root FROM al),
rn AS MATERIALIZED (SELECT root, (row_number() OVER (ORDER BY root) - 1) // 512 AS batch, (row_number() OVER (ORDER BY root) - 1) % 512 AS place FROM pg)"""
ALL_NODES = (*L.ALERTS_E, CHANGE_E, GRAPH_NODES, GRAPH_EDGES, PAYLOAD_SQL)


def _balls_sql(nodes: str = "nd", edges: str = "ed", links: str = "pe") -> str:
    """rr: every node within four steps of each alert and the exchange wallets paid there; pn, pe: its nodes and links."""
    step = "h{k} AS MATERIALIZED (SELECT DISTINCT root, b AS id FROM h{j} JOIN li ON li.a = h{j}.id),"
    return (
        f"""li AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM {edges} UNION ALL SELECT target, source FROM {edges})),
h0 AS MATERIALIZED (SELECT root, root AS id FROM pg),
""" + "\n".join(step.format(k=k, j=k - 1) for k in range(1, HOPS + 1)) + """
rd AS MATERIALIZED (SELECT root, id, min(depth) AS depth FROM (""" + " UNION ALL ".join(f"SELECT root, id, {k} AS depth FROM h{k}" for k in range(HOPS + 1)) + f""") GROUP BY 1, 2),
rx AS (SELECT DISTINCT rd.root, {edges}.target AS id FROM rd JOIN {edges} ON {edges}.source = rd.id AND relationship = 'RECEIVED' JOIN {nodes} x ON x.id = {edges}.target AND x.type = 'exchange'),
rr AS MATERIALIZED (SELECT root, id, depth FROM rd UNION ALL SELECT rx.root, rx.id, {HOPS + 1} FROM rx ANTI JOIN rd ON rd.root = rx.root AND rd.id = rx.id),
pn AS (SELECT rr.root, x.* FROM rr JOIN {nodes} x ON x.id = rr.id),
{links} AS (SELECT a.root, x.* FROM {edges} x JOIN rr a ON a.id = x.source JOIN rr b ON b.root = a.root AND b.id = x.target)"""
    )


BALLS = (*ALL_NODES, _balls_sql())
BITS_SQL = "CAST(bitstring_agg(place, 0, 511) AS VARCHAR)"


def graph_nodes(spark, d):
    """Nodes of the evidence graph with what alerts add to them."""
    return memo(spark, ("annotated", d), lambda: materialize(links.annotate_nodes(L.event_graph(spark, d)[0], alerts(spark, d)), "annotated"))


def graph_edges(spark, d):
    return L.event_graph(spark, d)[1]


def numbered(spark, d):
    return memo(spark, ("roots", d), lambda: balls.number_roots(graph_nodes(spark, d), alerts(spark, d)))


def alert_balls(spark, d):
    return memo(spark, ("balls", d), lambda: balls.bit_balls(graph_nodes(spark, d), graph_edges(spark, d), numbered(spark, d)))


def reached(spark, d):
    return memo(spark, ("reached", d), lambda: balls.reach(alert_balls(spark, d)))


def ball_edges(spark, d):
    return memo(spark, ("ball_edges", d), lambda: balls.edge_bits(graph_edges(spark, d), reached(spark, d)).change(lambda rows: materialize(rows, "ball_edges")))


def label_sums(spark, d):
    return memo(spark, ("label_sums", d), lambda: materialize(balls.root_sums(balls.node_bits(graph_nodes(spark, d), reached(spark, d)), numbered(spark, d), F.col("label")), "label_sums"))


def relationship_sums(spark, d):
    return memo(spark, ("relationship_sums", d), lambda: materialize(balls.root_sums(ball_edges(spark, d), numbered(spark, d), F.col("relationship")), "relationship_sums"))


def steps(spark, d):
    return memo(spark, ("steps", d), lambda: balls.both_ways(graph_edges(spark, d)))


@query("g18_n_hop", with_(*BALLS, select=f"SELECT batch, id, depth, {BITS_SQL} AS roots FROM rr JOIN rn USING (root) GROUP BY 1, 2, 3"))
def _(spark, d):
    """Balls of all alerts: for each node, distance and batch of alerts the bitmap of the alerts that are that far away."""
    return alert_balls(spark, d).told("roots").select("batch", "id", "depth", "roots")


def _pack_sql(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN '-' ELSE length({expr}) || ':' || {expr} END"


NODE_ELEMENT = "'node|' || " + " || '|' || ".join(
    _pack_sql(x) for x in (
        "id", "label", "type", "risk", ISO_SQL, "CAST(src_port AS VARCHAR)", "dst_ip", "CAST(dst_port AS VARCHAR)", "country", "description",
        "entity_id", "CAST(threat_score AS VARCHAR)", "risk_level", "primary_anomaly")
)
EDGE_ELEMENT = "'edge|' || " + " || '|' || ".join(
    _pack_sql(x) for x in ("source", "target", "relationship", "CAST(amount_sats AS VARCHAR)", ISO_SQL, "CAST(src_port AS VARCHAR)", "dst_ip", "CAST(dst_port AS VARCHAR)")
)


@query("g19_subgraph_payload", with_(*BALLS, select=f"""SELECT element, batch, count(*) AS n_roots, sha256({BITS_SQL}) AS roots_sha256 FROM (
    SELECT root, id AS eid, {NODE_ELEMENT} AS element FROM pn UNION ALL SELECT root, CAST(eid AS VARCHAR), {EDGE_ELEMENT} FROM pe) JOIN rn USING (root) GROUP BY element, eid, batch"""))
def _(spark, d):
    """Payloads of all alerts, factorised: every element once a batch, with the alerts whose payload has it."""
    # Texts are made once an element, ahead of the batches.
    told = lambda kind, names: lambda rows: rows.select(graph.canonical(kind, names).alias("element"), *[c for c in rows.columns if c.startswith("__")])
    inside = balls.node_bits(graph_nodes(spark, d), reached(spark, d)).change(told("node", graph.PAYLOAD_NODE))
    lines = ball_edges(spark, d).change(told("edge", graph.EDGE_COLUMNS))
    return inside.told("n_roots", "roots_sha256").unionAll(lines.told("n_roots", "roots_sha256"))


def _combine_sql(name: str, rows: str) -> str:
    return f"""{name}_l AS (SELECT id, sha256(h || 'x' || count(*)) AS l FROM {rows} GROUP BY id, h),
{name}_b AS (SELECT id, substr(l, 1, 4) || sha256(string_agg(l, '' ORDER BY l)) AS l FROM {name}_l GROUP BY id, substr(l, 1, 4)),
{name} AS MATERIALIZED (SELECT id, sha256(string_agg(l, '' ORDER BY l)) AS h FROM {name}_b GROUP BY id)"""


def _digests_sql(out: str = "hd", nodes: str = "nd", edges: str = "ed") -> str:
    """Custody hash (tx_id, h) of every alert: four rounds of messages along the links."""
    o = out
    parts = [
        f"{o}_n AS MATERIALIZED (SELECT id, type, sha256({NODE_ELEMENT}) AS e FROM {nodes})",
        f"{o}_e AS (SELECT source, target, sha256({EDGE_ELEMENT}) AS l FROM {edges})",
        f"{o}_w AS MATERIALIZED (SELECT source AS id, target AS other, l FROM {o}_e UNION ALL SELECT target, source, l FROM {o}_e WHERE source <> target)",
        f"{o}_t AS (SELECT w.id, sha256(l || e) AS h FROM {o}_w w JOIN {o}_n n ON n.id = w.other AND n.type = 'exchange')",
        _combine_sql(f"{o}_c", f"{o}_t"),
        f"{o}_0 AS MATERIALIZED (SELECT n.id, sha256(e || coalesce(h, '')) AS own, own AS d FROM {o}_n n LEFT JOIN {o}_c c ON c.id = n.id)",
    ]
    for k in range(1, HOPS + 1):
        parts += [
            f"{o}_m{k} AS (SELECT w.id, sha256(l || d) AS h FROM {o}_w w JOIN {o}_{k - 1} x ON x.id = w.other)",
            _combine_sql(f"{o}_k{k}", f"{o}_m{k}"),
            f"{o}_{k} AS MATERIALIZED (SELECT s.id, own, sha256(own || coalesce(h, '')) AS d FROM {o}_0 s LEFT JOIN {o}_k{k} k ON k.id = s.id)",
        ]
    parts.append(f"{o} AS MATERIALIZED (SELECT al.tx_id, sha256(d || '|' || {ISO_SQL} || '|' || al.tx_id) AS h FROM al JOIN {o}_{HOPS} x ON x.id = al.tx_id)")
    return ",\n".join(parts)


def hashes_plan(spark, d):
    return balls.custody_digests(graph_nodes(spark, d), graph_edges(spark, d), alerts(spark, d))


def hashes(spark, d):
    return memo(spark, ("hashes", d), lambda: materialize(hashes_plan(spark, d), "hashes"))


@query("e5_custody_hash", with_(*ALL_NODES, _digests_sql(), select="SELECT tx_id, h AS chain_of_custody_hash FROM hd"))
def _(spark, d):
    return hashes_plan(spark, d)


MINIMAL_SQL = """pb AS MATERIALIZED (SELECT * FROM pe), ph AS MATERIALIZED (SELECT DISTINCT root, target AS host FROM pb WHERE relationship = 'BROADCAST_FROM' AND source = root),
mn AS MATERIALIZED (SELECT root, source, target, relationship FROM pb WHERE source = root OR target = root
  UNION ALL SELECT pb.root, source, target, relationship FROM pb SEMI JOIN ph ON ph.root = pb.root AND ph.host = pb.source
    WHERE relationship = 'BELONGS_TO' AND source <> pb.root AND target <> pb.root)"""


# Subgraphs that need no ball are answered for all alerts.
ALL_ROOTS = (*L.ALERTS_E, CHANGE_E, GRAPH_NODES, GRAPH_EDGES, "pg AS MATERIALIZED (SELECT tx_id AS root FROM al)")
CASE_SQL = """hs AS MATERIALIZED (SELECT DISTINCT root, target AS host FROM pg JOIN ge ON ge.source = pg.root AND relationship = 'BROADCAST_FROM'),
pe AS (SELECT cm.root, ge.* FROM cm JOIN ge ON ge.source = cm.tx WHERE relationship IN ('RECEIVED', 'BROADCAST_FROM')
  UNION ALL SELECT cm.root, ge.* FROM cm JOIN ge ON ge.target = cm.tx WHERE relationship = 'SPENT'
  UNION ALL SELECT hs.root, ge.* FROM hs JOIN ge ON ge.source = hs.host WHERE relationship = 'BELONGS_TO')"""
OWN_SQL = "cm AS (SELECT root, root AS tx FROM pg)"
PARTNERS_SQL = "cm AS (SELECT root, root AS tx FROM pg UNION SELECT root, CASE WHEN src = root THEN dst ELSE src END FROM im)"


def root_nodes(spark, d):
    return alerts(spark, d).select(F.col("tx_id").alias("root"), F.col("tx_id").alias("id"), F.lit("Transaction").alias("label"))


@query("g20_minimal_subgraph", with_(*ALL_ROOTS, OWN_SQL, CASE_SQL, MINIMAL_SQL, select="SELECT root, source, target, relationship FROM mn"))
def _(spark, d):
    found = graph.case_edges(L.event_graph(spark, d)[1], alerts(spark, d))
    return graph.minimal_subgraph(found, root_nodes(spark, d)).select("root", "source", "target", "relationship")


# Rule weights play the linear model: one weight per feature that both engines know.
EDGE_WEIGHTS = {"tx_volume": 0.5, "peel_chain": 2.0, "tor_or_bulletproof_asn": 1.0}
WEIGHTS_SQL = """dg AS (SELECT e.tx_id, CAST(1 + count(nb.neighbour) AS DOUBLE) AS deg FROM e LEFT JOIN nb USING (tx_id) GROUP BY 1),
st AS (SELECT fe.tx_id, deg, abs(tx_volume * 0.5 + peel * 2.0 + tor * 1.0) / sqrt(deg) AS s FROM fe JOIN dg USING (tx_id)),
ew AS (SELECT pg.root, j.tx_id AS src, pg.root AS dst, j.s / sqrt(i.deg) AS weight FROM pg JOIN (SELECT tx_id, neighbour FROM nb UNION ALL SELECT tx_id, tx_id FROM e) x ON x.tx_id = pg.root
    JOIN st j ON j.tx_id = x.neighbour JOIN st i ON i.tx_id = pg.root),
im0 AS (SELECT root, src, dst FROM ew QUALIFY row_number() OVER (PARTITION BY root ORDER BY weight DESC, src, dst) <= 8),
im AS (SELECT root, src, dst FROM im0 WHERE src <> dst UNION SELECT root, dst, src FROM im0 WHERE src <> dst)"""


def important_plan(spark, d):
    from coinweave.operators.models import edge_attributions

    e = L.event_ledger(spark, d)
    weights = edge_attributions(
        neighbours.incidence(e.spends, e.receipts), L.event_features(spark, d), EDGE_WEIGHTS, alerts(spark, d)
    )
    return graph.important_edges(weights)


def important(spark, d):
    return memo(spark, ("important", d), lambda: materialize(important_plan(spark, d), "important"))


@query("g21_important_edges", with_(*ALL_ROOTS, WEIGHTS_SQL, select="SELECT root, src, dst FROM im"))
def _(spark, d):
    return important_plan(spark, d)


EXPLAINED_SQL = """sh AS (SELECT r.root, r.source AS parent, r.target AS wallet, s.target AS child FROM pe r JOIN im ON im.root = r.root AND im.src = r.source
    JOIN pe s ON s.root = r.root AND s.source = r.target AND s.target = im.dst WHERE r.relationship = 'RECEIVED' AND s.relationship = 'SPENT'),
ex AS (SELECT root, source, target, relationship, 'edge_weights' AS method FROM pe WHERE root IN (SELECT root FROM im) AND ((relationship = 'RECEIVED' AND (root, source, target) IN (SELECT (root, parent, wallet) FROM sh))
    OR (relationship = 'SPENT' AND (root, source, target) IN (SELECT (root, wallet, child) FROM sh)) OR (relationship = 'BROADCAST_FROM' AND source = root)
    OR (relationship = 'BELONGS_TO' AND (root, source) IN (SELECT (root, target) FROM pe WHERE relationship = 'BROADCAST_FROM' AND source = root)))
  UNION ALL SELECT root, source, target, relationship, 'heuristic_fallback' FROM mn WHERE root NOT IN (SELECT root FROM im))"""


def explained_edges(spark, d):
    found = graph.case_edges(graph_edges(spark, d), alerts(spark, d), important(spark, d))
    return graph.explained_subgraph(found, root_nodes(spark, d), important(spark, d))


@query("g22_explained_subgraph", with_(*ALL_ROOTS, WEIGHTS_SQL, PARTNERS_SQL, CASE_SQL, MINIMAL_SQL, EXPLAINED_SQL, select="SELECT root, source, target, relationship, method FROM ex"))
def _(spark, d):
    return explained_edges(spark, d).select("root", "source", "target", "relationship", "method")


KEPT_NODES_SQL = "SELECT root, id FROM (SELECT root, source AS id FROM {t} UNION SELECT root, target FROM {t} UNION SELECT root, root FROM pg)"


@query("g20_minimal_nodes", with_(*ALL_ROOTS, OWN_SQL, CASE_SQL, MINIMAL_SQL, select=KEPT_NODES_SQL.format(t="mn")))
def _(spark, d):
    found = graph.case_edges(graph_edges(spark, d), alerts(spark, d))
    return graph.kept_nodes(graph.minimal_subgraph(found, root_nodes(spark, d)), alerts(spark, d))


@query("g22_explained_nodes", with_(*ALL_ROOTS, WEIGHTS_SQL, PARTNERS_SQL, CASE_SQL, MINIMAL_SQL, EXPLAINED_SQL, select=KEPT_NODES_SQL.format(t="ex")))
def _(spark, d):
    return graph.kept_nodes(explained_edges(spark, d), alerts(spark, d))


INSIGHTS_SQL = """tg AS (SELECT pe.*, x.type AS t_type FROM pe JOIN nd x ON x.id = pe.target WHERE relationship = 'RECEIVED'),
gi AS (SELECT root, 'direct_input' AS section, CAST(eid AS VARCHAR) AS eid, source AS id, amount_sats, pe.us, x.entity_id AS detail, source FROM pe JOIN nd x ON x.id = source WHERE relationship = 'SPENT' AND target = root
  UNION ALL SELECT root, 'direct_output', CAST(eid AS VARCHAR), target, amount_sats, us, t_type, source FROM tg WHERE source = root
  UNION ALL SELECT root, 'exchange_output', CAST(eid AS VARCHAR), target, amount_sats, us, CASE WHEN source = root THEN 'root cashout' ELSE 'from ' || source END, source FROM tg WHERE t_type = 'exchange'
  UNION ALL SELECT root, 'network_step', CAST(eid AS VARCHAR), target, NULL, us, CASE WHEN source = root THEN 'root broadcast' ELSE 'linked broadcast from ' || source END, source FROM pe WHERE relationship = 'BROADCAST_FROM'
  UNION ALL SELECT root, 'system', id, id, NULL, NULL, description, NULL FROM pn WHERE label = 'ASN')"""


@query("g29_graph_insights", with_(*BALLS, INSIGHTS_SQL, select=f"""SELECT section, id, amount_sats, us AS ts_us, detail, batch, sha256({BITS_SQL}) AS roots_sha256
  FROM gi JOIN rn USING (root) GROUP BY section, eid, id, amount_sats, us, detail, batch"""))
def _(spark, d):
    """The rows an investigator reads, each once a batch with the alerts that have it."""
    found = balls.ball_insights(graph_nodes(spark, d), ball_edges(spark, d), reached(spark, d), numbered(spark, d), ("roots_sha256",))
    return found.select("section", "id", "amount_sats", us("ts").alias("ts_us"), "detail", "batch", "roots_sha256")


@query("g29_label_counts", with_(*BALLS, select="""SELECT root, count(*) FILTER (label = 'Transaction') AS transactions, count(*) FILTER (label = 'WalletAddress') AS wallets,
  count(*) FILTER (label = 'IPAddress') AS hosts, count(*) FILTER (label = 'ASN') AS systems FROM pn GROUP BY 1"""))
def _(spark, d):
    names = {"Transaction": "transactions", "WalletAddress": "wallets", "IPAddress": "hosts", "ASN": "systems"}
    return label_sums(spark, d).groupBy("root").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(v) for k, v in names.items()])


@query("g29_relationship_counts", with_(*BALLS, select="SELECT root, relationship, count(*) AS n FROM pe GROUP BY 1, 2"))
def _(spark, d):
    return relationship_sums(spark, d).select("root", F.col("kind").alias("relationship"), "n")


@query("g30_exchange_exposure", with_(*BALLS, INSIGHTS_SQL, select="""SELECT pg.root, CAST(coalesce(sum(amount_sats), 0) AS BIGINT) AS exchange_sats, count(gi.id) AS n_exchange_outputs
  FROM pg LEFT JOIN gi ON gi.root = pg.root AND section = 'exchange_output' GROUP BY 1"""))
def _(spark, d):
    return balls.ball_exposure(graph_nodes(spark, d), ball_edges(spark, d), numbered(spark, d))


@query("w7_head_per_root", with_(*BALLS, INSIGHTS_SQL, select="""SELECT root, section, id, amount_sats, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY root ORDER BY id, amount_sats, us, source) AS rank FROM gi WHERE section = 'exchange_output'
    OR (section = 'direct_output' AND root NOT IN (SELECT root FROM gi WHERE section = 'exchange_output'))) WHERE rank <= 8"""))
def _(spark, d):
    found = balls.leading_payments(graph_nodes(spark, d), graph_edges(spark, d), steps(spark, d), alerts(spark, d))
    return found.select("root", "section", "id", "amount_sats", "rank")


@query("w6_top_suspicious", with_(*BALLS, select="""SELECT root, id, threat_score, CAST(rank AS INT) AS rank FROM (SELECT root, id, threat_score,
  row_number() OVER (PARTITION BY root ORDER BY coalesce(threat_score, 0) DESC, id) AS rank FROM pn WHERE label = 'Transaction') WHERE rank <= 10"""))
def _(spark, d):
    order = [F.desc(F.coalesce("threat_score", F.lit(0))), F.col("id")]
    return balls.leading_transactions(graph_nodes(spark, d), steps(spark, d), alerts(spark, d), order, 10, reached=reached(spark, d), numbered=numbered(spark, d)).select("root", "id", "threat_score", "rank")


@query("w5_timeline", with_(*BALLS, select="""SELECT root, id, CAST(row_number() OVER (PARTITION BY root ORDER BY us, id) AS INT) AS step FROM (SELECT root, id, us,
  row_number() OVER (PARTITION BY root ORDER BY us DESC, id DESC) AS back FROM pn WHERE label = 'Transaction') WHERE back <= 7"""))
def _(spark, d):
    last = balls.leading_transactions(graph_nodes(spark, d), steps(spark, d), alerts(spark, d), [F.desc("ts"), F.desc("id")], 7, reached=reached(spark, d), numbered=numbered(spark, d))
    return graph.head_per_root(last.drop("rank"), [F.col("ts"), F.col("id")], 7, "step").select("root", "id", "step")


# ---------------------------------------------------------------- evidence tables and audit


def evidence_rows(spark, d):
    return memo(
        spark, ("evidence", d),
        lambda: materialize(evidence.evidence(explained(spark, d), hashes(spark, d), explained_edges(spark, d)), "evidence"),
    )


XAI_SQL = _combine_sql("xs", "xr") + """,
xm AS (SELECT root, max(method) AS method, count(*) AS n FROM ex GROUP BY 1), xn AS (SELECT root, count(*) AS n FROM (""" + KEPT_NODES_SQL.format(t="ex") + ") GROUP BY 1)"
XAI_ROWS_SQL = f"""xr AS (SELECT root AS id, sha256({EDGE_ELEMENT}) AS h FROM xe)"""
# The explained subgraph again, with all columns of its links.
XAI_EDGES_SQL = """xe AS MATERIALIZED (SELECT pb.* FROM pb SEMI JOIN ex ON ex.root = pb.root AND ex.source = pb.source AND ex.target = pb.target AND ex.relationship = pb.relationship)"""
EVIDENCE_SQL = (*ALL_NODES, WEIGHTS_SQL, PARTNERS_SQL, CASE_SQL, MINIMAL_SQL, EXPLAINED_SQL, XAI_EDGES_SQL, XAI_ROWS_SQL, XAI_SQL, TERMS_SQL, _digests_sql())


@query("e6_evidence", with_(*EVIDENCE_SQL, select=f"""SELECT al.tx_id, al.threat_score AS overall_threat_score, string_agg({LABEL_SQL} || '=' || points, ';' ORDER BY place) AS breakdown,
  any_value(hd.h) AS chain_of_custody_hash, any_value(xm.method) AS xai_method, any_value(xn.n) AS xai_nodes, any_value(xm.n) AS xai_edges, any_value(xs.h) AS xai_sha256
  FROM al JOIN cx USING (tx_id) JOIN hd USING (tx_id) LEFT JOIN xm ON xm.root = al.tx_id LEFT JOIN xn ON xn.root = al.tx_id LEFT JOIN xs ON xs.id = al.tx_id GROUP BY al.tx_id, al.threat_score"""))
def _(spark, d):
    parts = F.transform("xai_breakdown", lambda x: F.concat(x["feature"], F.lit("="), x["contribution_percentage"].cast("int").cast("string")))
    xai = [F.col(f"xai_subgraph.{k}").alias(f"xai_{k}") for k in ("method", "nodes", "edges", "sha256")]
    return evidence_rows(spark, d).select("tx_id", "overall_threat_score", F.array_join(parts, ";").alias("breakdown"), "chain_of_custody_hash", *xai)


@query("j14_investigate", with_(*L.ALERTS_E, TERMS_SQL, select=f"""SELECT pt.tx_id, pt.risk_level, round(pt.threat_score / 100.0::DOUBLE, 6) AS risk_score, 'suspicious' AS prediction,
  string_agg({LABEL_SQL} || '=' || points, ';' ORDER BY place) AS feature_weights FROM al pt JOIN cx USING (tx_id) WHERE place <= 5 GROUP BY 1, 2, pt.threat_score"""))
def _(spark, d):
    out = links.investigate(alerts(spark, d), explained(spark, d))
    parts = F.transform("feature_weights", lambda x: F.concat(x["feature"], F.lit("="), x["contribution_percentage"].cast("int").cast("string")))
    return out.withColumn("feature_weights", F.array_join(parts, ";"))


@query("j15_unflagged", with_(*L.ALERTS_E, select="SELECT tx_id FROM e WHERE tx_id NOT IN (SELECT tx_id FROM al)"))
def _(spark, d):
    return links.unflagged(L.event_ledger(spark, d).tx, explained(spark, d)).select("tx_id")


@query("s15_case_files", with_(*EVIDENCE_SQL[:-1], _balls_sql(links="pq"), _digests_sql(), select=f"""SELECT al.tx_id, 'dossier_' || al.tx_id AS file_name, threat_score, al.risk_level, primary_anomaly, {ISO_SQL} AS timestamp, n_nodes, n_edges, hd.h AS chain_of_custody_hash,
    xm.method AS explained_by, selected_nodes, selected_edges, attribution FROM al JOIN hd USING (tx_id) JOIN xm ON xm.root = al.tx_id
  JOIN (SELECT root, count(*) AS n_nodes, string_agg({NODE_ELEMENT}, chr(10) ORDER BY id) FILTER (nth <= 24) AS selected_nodes FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY id) AS nth FROM pn) GROUP BY 1) a ON a.root = tx_id
  JOIN (SELECT root, count(*) AS n_edges, string_agg({EDGE_ELEMENT}, chr(10) ORDER BY nth) FILTER (nth <= 32) AS selected_edges FROM (
      SELECT *, row_number() OVER (PARTITION BY root ORDER BY source, target, relationship, amount_sats NULLS FIRST, us NULLS FIRST, {EDGE_ELEMENT}) AS nth FROM pq) GROUP BY 1) b ON b.root = tx_id
  JOIN (SELECT tx_id, string_agg({LABEL_SQL} || '=' || points, chr(10) ORDER BY place) AS attribution FROM cx GROUP BY 1) c USING (tx_id)"""))
def _(spark, d):
    """Reports of all alerts, with the text of the leading nodes and links."""
    nodes = balls.leading_nodes(graph_nodes(spark, d), graph_edges(spark, d), steps(spark, d), alerts(spark, d), evidence.REPORT_NODES, reached=reached(spark, d), numbered=numbered(spark, d))
    lines = balls.leading_edges(graph_edges(spark, d), reached(spark, d), numbered(spark, d), evidence.REPORT_EDGES)
    counts = label_sums(spark, d).groupBy("root").agg(F.sum("n").alias("n_nodes")).join(relationship_sums(spark, d).groupBy("root").agg(F.sum("n").alias("n_edges")), "root", "left")
    files = evidence.case_reports(alerts(spark, d), evidence_rows(spark, d), counts, nodes, lines)
    points = F.transform("xai_breakdown", lambda x: F.concat(x["feature"], F.lit("="), x["contribution_percentage"].cast("int").cast("string")))
    attribution = evidence_rows(spark, d).select("tx_id", F.array_join(points, "\n").alias("attribution"))
    texts = [F.array_join(F.transform(c, lambda x: x["element"]), "\n").alias(c) for c in ("selected_nodes", "selected_edges")]
    return files.drop("attribution").join(attribution, "tx_id").select(
        "tx_id", "file_name", "threat_score", "risk_level", "primary_anomaly", "timestamp", "n_nodes", "n_edges", "chain_of_custody_hash", "explained_by", *texts, "attribution"
    )


# A store in which some rows were damaged after the evidence was written: transactions without risk or links, broadcasts without a
# port, and evidence rows that are gone, have another score or another hash.
EVENT_SQL = "CAST(substr({c}, 4) AS BIGINT)"
BROKEN_SQL = f"""bt AS MATERIALIZED (SELECT tx_id FROM e WHERE event_id % 97 = 5),
nx AS MATERIALIZED (SELECT * REPLACE (CASE WHEN label = 'Transaction' AND {EVENT_SQL.format(c="id")} % 50 = 7 THEN NULL ELSE risk END AS risk) FROM nd),
ex0 AS (SELECT * FROM ed ANTI JOIN bt ON bt.tx_id = ed.source),
ex1 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN relationship = 'BROADCAST_FROM' AND {EVENT_SQL.format(c="source")} % 60 = 9 THEN NULL ELSE dst_port END AS dst_port) FROM ex0 ANTI JOIN bt ON bt.tx_id = ex0.target)"""


def _event(c: str):
    return F.try_element_at(F.split(c, "_"), F.lit(2)).cast("bigint")


def stored_graph(spark, d, broken: bool):
    """(nodes, edges) as tables on disk, the damaged ones if asked."""

    def build():
        nodes, edges = graph_nodes(spark, d), graph_edges(spark, d)
        if not broken:
            return nodes, edges
        gone = lambda c: F.col(c).startswith("tx_") & (_event(c) % 97 == 5)
        nodes = nodes.withColumn("risk", F.when((F.col("label") == "Transaction") & (_event("id") % 50 == 7), F.lit(None)).otherwise(F.col("risk")))
        no_port = (F.col("relationship") == "BROADCAST_FROM") & (_event("source") % 60 == 9)
        edges = edges.filter(~gone("source") & ~gone("target")).withColumn("dst_port", F.when(no_port, F.lit(None)).otherwise(F.col("dst_port")))
        return materialize(nodes, "stored_nodes"), materialize(edges, "stored_edges")

    return memo(spark, ("stored_graph", d, broken), build)


def stored_evidence(spark, d, broken: bool):
    """The evidence rows on disk, the damaged ones if asked."""

    def build():
        rows = evidence_rows(spark, d)
        if not broken:
            return rows
        n = _event("tx_id") % 31
        rows = rows.filter(n != 4).withColumns({
            "overall_threat_score": F.when(n == 6, F.col("overall_threat_score") + 1).otherwise(F.col("overall_threat_score")),
            "chain_of_custody_hash": F.when(n == 8, F.lit("ff")).otherwise(F.col("chain_of_custody_hash")),
        })
        return materialize(rows, "stored_evidence")

    return memo(spark, ("stored_evidence", d, broken), build)


def _shape_failures(spark, d, broken: bool):
    nodes, edges = stored_graph(spark, d, broken)
    roots = numbered(spark, d)
    near = balls.reach(balls.bit_balls(nodes, edges, roots)) if broken else reached(spark, d)
    return audit_shapes(alerts(spark, d), *balls.ball_shapes(nodes, edges, near, roots))


def _evidence_failures(spark, d, broken: bool):
    nodes, edges = stored_graph(spark, d, broken)
    return audit_evidence(alerts(spark, d), stored_evidence(spark, d, broken), balls.custody_digests(nodes, edges, alerts(spark, d)))


BROKEN_BALLS = (*ALL_NODES, BROKEN_SQL, _balls_sql("nx", "ex1"))
SHAPE_FAILURES_SQL = """q1 AS MATERIALIZED (SELECT root AS tx_id, unnest([{f: 'no nodes', n: CAST(coalesce(nn, 0) = 0 AS BIGINT)}, {f: 'no edges', n: CAST(coalesce(ne, 0) = 0 AS BIGINT)}, {f: 'missing node labels', n: 4 - coalesce(nl, 0)},
    {f: 'missing edge types', n: 4 - coalesce(nr, 0)}, {f: 'not exactly one root', n: CAST(coalesce(own, 0) <> 1 AS BIGINT)}, {f: 'root fields missing', n: coalesce(CAST(holes AS BIGINT), 0)}, {f: 'edge fields missing', n: coalesce(CAST(bad AS BIGINT), 0)}]) AS x
  FROM pg LEFT JOIN (SELECT root, count(*) AS nn, count(DISTINCT label) AS nl, count(*) FILTER (id = root) AS own, sum(CASE WHEN id = root THEN CAST(risk IS NULL AS INT) + CAST(threat_score IS NULL AS INT) END) AS holes FROM pn GROUP BY 1) USING (root)
  LEFT JOIN (SELECT root, count(*) AS ne, count(DISTINCT relationship) AS nr, sum(CAST(relationship <> 'BELONGS_TO' AND (us IS NULL OR (relationship = 'BROADCAST_FROM' AND (src_port IS NULL OR dst_ip IS NULL OR dst_port IS NULL))
    OR (relationship <> 'BROADCAST_FROM' AND amount_sats IS NULL)) AS INT)) AS bad FROM pe GROUP BY 1) USING (root))"""
EVIDENCE_FAILURES_SQL = f"""q2 AS MATERIALIZED (SELECT tx_id, unnest([{{f: 'missing evidence', n: CAST(m = 4 AS BIGINT)}}, {{f: 'score differs from alert', n: CAST(m = 6 AS BIGINT)}}, {{f: 'contributions do not add up', n: CAST(m = 6 AS BIGINT)}},
    {{f: 'hash is not 64 hex digits', n: CAST(m = 8 AS BIGINT)}}, {{f: 'hash does not match the subgraph', n: CAST(m <> 4 AND (m = 8 OR hd.h <> hx.h) AS BIGINT)}}]) AS x
  FROM (SELECT tx_id, {EVENT_SQL.format(c="tx_id")} % 31 AS m FROM al) JOIN hd USING (tx_id) JOIN hx USING (tx_id))"""


@query("q1_audit_graph", with_(*BROKEN_BALLS, SHAPE_FAILURES_SQL, select="SELECT tx_id, x.f AS failure, x.n AS n FROM q1 WHERE x.n > 0"))
def _(spark, d):
    """Shape failures of the damaged store, for all alerts."""
    return _shape_failures(spark, d, True)


@query("q2_audit_evidence", with_(*ALL_NODES, BROKEN_SQL, _digests_sql(), _digests_sql("hx", "nx", "ex1"), EVIDENCE_FAILURES_SQL, select="SELECT tx_id, x.f AS failure, x.n AS n FROM q2 WHERE x.n > 0"))
def _(spark, d):
    """Evidence failures of the damaged store, for all alerts."""
    return _evidence_failures(spark, d, True)


@query("q3_audit_summary", with_(
    *BROKEN_BALLS, SHAPE_FAILURES_SQL, _digests_sql(), _digests_sql("hx", "nx", "ex1"), EVIDENCE_FAILURES_SQL,
    """good AS (SELECT root, count(DISTINCT relationship) AS r, count(*) FILTER (relationship <> 'BELONGS_TO' AND us IS NULL) AS b FROM (SELECT pg.root, relationship, us FROM pg LEFT JOIN ed ON ed.source = pg.root OR ed.target = pg.root) GROUP BY 1)""",
    select="""SELECT store, CASE WHEN failures = 0 THEN 'success' ELSE 'error' END AS status, (SELECT count(*) FROM e) AS transactions, (SELECT count(*) FROM al) AS alerts_audited, failures FROM (
  SELECT 'damaged' AS store, CAST((SELECT sum(x.n) FROM q1) + (SELECT sum(x.n) FROM q2) AS BIGINT) AS failures
  UNION ALL SELECT 'intact', (SELECT count(*) FROM good WHERE b > 0) + (SELECT count(*) FROM al WHERE threat_score IS NULL OR risk_level IS NULL OR primary_anomaly IS NULL))"""))
def _(spark, d):
    """Both audits of the intact and of the damaged store."""
    tx = L.event_ledger(spark, d).tx
    rows = [audit_summary(tx, alerts(spark, d), _shape_failures(spark, d, broken), _evidence_failures(spark, d, broken)).select(F.lit(name).alias("store"), "*") for name, broken in (("intact", False), ("damaged", True))]
    return rows[0].unionAll(rows[1])


@query("n17_sats_to_btc", with_(L.O, select="SELECT tx_id, address, sum(amount_sats) / 1e8 AS btc FROM rc GROUP BY 1, 2"))
def _(spark, d):
    r = L.order_ledger(spark, d).receipts.groupBy("tx_id", "address").agg(F.sum("amount_sats").alias("s"))
    return r.select("tx_id", "address", N.sats_to_btc(F.col("s")).alias("btc"))


@query("n18_script_type", with_(L.O, L.INCIDENCE, select="SELECT address, CASE WHEN address LIKE 'bc1%' THEN 'bech32' ELSE 'base58' END AS script FROM (SELECT DISTINCT address FROM inc)"))
def _(spark, d):
    o = L.order_ledger(spark, d)
    return neighbours.incidence(o.spends, o.receipts).select("address").distinct().select("address", N.script_type(F.col("address")).alias("script"))


@query("n19_risky_asn_flag", with_(L.E, select="SELECT tx_id, asn_description IN ('Tor Transit', 'NForce Entertainment B.V.', 'M247 Europe SRL') AS risky FROM e"))
def _(spark, d):
    return L.event_ledger(spark, d).tx.select("tx_id", N.risky_asn_flag(F.col("asn_description")).alias("risky"))
