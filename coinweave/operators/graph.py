"""The evidence graph as node and edge tables, and the subgraphs around alerts.

Subgraphs of many roots live in long tables keyed by ``root``; nothing gathers a whole subgraph in one
row, because a hub can put a large part of the graph into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweave.functions import normalize as N
from coinweave.operators.ledger import Ledger
from coinweave.session import materialize

# Wallet roles by priority, defaults of the subgraph search and of the report sections.
ROLE_PRIORITY = {"exchange": 4, "change": 3, "input": 2, "output": 1}
DEFAULT_HOPS = 4
MAX_IMPORTANT = 8

NODE_COLUMNS = ["id", "label", "type", "risk", "ts", "src_port", "dst_ip", "dst_port", "country", "description", "entity_id"]
EDGE_COLUMNS = ["source", "target", "relationship", "amount_sats", "ts", "src_port", "dst_ip", "dst_port"]


def wallet_roles(ledger: Ledger) -> DataFrame:
    """(address, type): the highest-priority role an address ever had."""
    rank = F.create_map(*[x for k, v in ROLE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    changes = ledger.sides.filter("change_address is not null").select(
        F.col("change_address").alias("address"), F.lit(ROLE_PRIORITY["change"]).alias("p")
    )
    plain = ledger.receipts.select(
        "address", F.when(F.col("is_exchange"), ROLE_PRIORITY["exchange"]).otherwise(ROLE_PRIORITY["output"]).alias("p")
    )
    spent = ledger.spends.select("address", F.lit(ROLE_PRIORITY["input"]).alias("p"))
    best = plain.unionAll(changes).unionAll(spent).groupBy("address").agg(F.max("p").alias("p"))
    name = F.map_keys(F.map_filter(rank, lambda k, v: v == F.col("p")))
    return best.select("address", F.get(name, F.lit(0)).alias("type"))


def node_risk(peel: Column, risky_asn: Column) -> Column:
    return F.when(peel | risky_asn, F.lit("high")).otherwise(F.lit("medium"))


def build_nodes(ledger: Ledger, entities: DataFrame | None = None, peel_members: DataFrame | None = None) -> DataFrame:
    """Transactions, wallets, addresses of broadcasting hosts and autonomous systems in one table."""
    tx = ledger.tx
    if peel_members is not None:
        tx = tx.join(peel_members.select("tx_id", F.lit(True).alias("__peel")), "tx_id", "left")
    else:
        tx = tx.withColumn("__peel", F.lit(False))
    peel = F.coalesce("__peel", F.lit(False))
    none = lambda t="string": F.lit(None).cast(t)
    fill = {"src_port": "int", "dst_port": "int", "ts": "timestamp"}

    def shaped(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(*[columns.get(c, none(fill.get(c, "string"))).alias(c) for c in NODE_COLUMNS])

    transactions = shaped(
        tx, id=F.col("tx_id"), label=F.lit("Transaction"), type=F.lit("hub"),
        risk=node_risk(peel, N.risky_asn_flag(F.col("asn_description"))), ts=F.col("ts"),
        src_port=F.col("src_port"), dst_ip=F.col("dst_ip"), dst_port=F.col("dst_port"),
    )
    roles = wallet_roles(ledger)
    if entities is not None:
        roles = roles.join(entities.select("address", "entity_id"), "address", "left")
    else:
        roles = roles.withColumn("entity_id", none())
    wallets = shaped(
        roles, id=F.col("address"), label=F.lit("WalletAddress"), type=F.col("type"), entity_id=F.col("entity_id")
    )
    latest = F.struct("ts", "tx_id")
    hosts = ledger.tx.filter("src_ip is not null").groupBy("src_ip").agg(F.max_by("country", latest).alias("country"))
    hosts = shaped(hosts, id=F.col("src_ip"), label=F.lit("IPAddress"), type=F.lit("network"), country=F.col("country"))
    systems = ledger.tx.filter("asn is not null").groupBy("asn").agg(F.max_by("asn_description", latest).alias("d"))
    systems = shaped(systems, id=F.col("asn"), label=F.lit("ASN"), type=F.lit("infrastructure"), description=F.col("d"))
    return transactions.unionAll(wallets).unionAll(hosts).unionAll(systems)


def build_edges(ledger: Ledger) -> DataFrame:
    """SPENT, RECEIVED, BROADCAST_FROM and BELONGS_TO links; repeated links stay repeated rows."""
    tx = ledger.tx.filter("src_ip is not null")
    spent = ledger.spends.select(
        F.col("address").alias("source"), F.col("tx_id").alias("target"), F.lit("SPENT").alias("relationship"),
        "amount_sats", "ts",
    )
    received = ledger.receipts.select(
        F.col("tx_id").alias("source"), F.col("address").alias("target"), F.lit("RECEIVED").alias("relationship"),
        "amount_sats", "ts",
    )
    broadcast = tx.select(
        F.col("tx_id").alias("source"), F.col("src_ip").alias("target"), F.lit("BROADCAST_FROM").alias("relationship"),
        "ts", "src_port", "dst_ip", "dst_port",
    )
    belongs = tx.filter("asn is not null").select(
        F.col("src_ip").alias("source"), F.col("asn").alias("target"), F.lit("BELONGS_TO").alias("relationship")
    )
    every = spent.unionAll(received).unionByName(broadcast, True).unionByName(belongs, True)
    return every.select(*EDGE_COLUMNS)


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree over (number of nodes - 1) in the undirected multigraph.

    Parallel links count; a pair linked both ways counts the larger direction. Links are first counted
    per pair with map-side combining, so repeated links of a hub do not travel."""
    pairs = edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(
        F.sum((F.col("source") <= F.col("target")).cast("int")).alias("f"),
        F.sum((F.col("source") > F.col("target")).cast("int")).alias("r"),
    )
    loops = F.when(F.col("a") == F.col("b"), F.lit(2)).otherwise(F.lit(1))
    weighted = pairs.select("a", "b", (F.greatest("f", "r") * loops).alias("n"))
    ends = weighted.select(F.col("a").alias("id"), "n").unionAll(
        weighted.filter("a <> b").select(F.col("b").alias("id"), "n")
    )
    degrees = ends.groupBy("id").agg(F.sum("n").alias("degree"))
    others = nodes.select("id").distinct().count() - 1
    return nodes.select("id").distinct().join(degrees, "id", "left").select(
        "id", F.coalesce("degree", F.lit(0)).alias("degree"),
        (F.coalesce("degree", F.lit(0)) / F.lit(float(max(others, 1)))).alias("degree_centrality"),
    )


def tx_degree(ledger: Ledger) -> DataFrame:
    """Degree of the transaction nodes alone, straight from the sides: no edge table, one join of the two transaction tables."""
    broadcast = F.col("src_ip").isNotNull().cast("int")
    return ledger.sides.join(ledger.tx.select("tx_id", broadcast.alias("__b")), "tx_id").select(
        "tx_id", (F.col("n_in") + F.col("n_out") - F.col("pair_overlap") + F.col("__b")).alias("degree")
    )


def n_hop(nodes: DataFrame, edges: DataFrame, roots: DataFrame, hops: int = DEFAULT_HOPS) -> DataFrame:
    """(root, id, depth): nodes within ``hops`` undirected steps of each root, plus exchange wallets paid
    by any reached transaction (depth ``hops + 1`` when not reached otherwise).

    A frontier per root moves through the distinct links; visited pairs are removed by an anti join."""
    links = edges.select("source", "target").unionAll(edges.select(F.col("target"), F.col("source"))).distinct()
    links = materialize(links.filter("source <> target"), "links")
    known = roots.select(F.col("tx_id").alias("root")).distinct()
    frontier = known.join(nodes.select(F.col("id").alias("root")).distinct(), "root", "left_semi").select(
        "root", F.col("root").alias("id"), F.lit(0).alias("depth")
    )
    reached = frontier = materialize(frontier, "frontier")
    for depth in range(1, hops + 1):
        step = frontier.join(links, F.col("id") == F.col("source")).select("root", F.col("target").alias("id"))
        fresh = step.distinct().join(reached.select("root", "id"), ["root", "id"], "left_anti")
        frontier = materialize(fresh.withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionAll(frontier)
    exchanges = nodes.filter("label = 'WalletAddress' and type = 'exchange'").select(F.col("id").alias("target"))
    paid = edges.filter("relationship = 'RECEIVED'").select("source", "target").distinct()
    cashed = paid.join(exchanges, "target", "left_semi")
    extra = (
        reached.join(cashed, F.col("id") == F.col("source")).select("root", F.col("target").alias("id")).distinct()
        .join(reached.select("root", "id"), ["root", "id"], "left_anti")
        .withColumn("depth", F.lit(hops + 1))
    )
    return reached.unionAll(extra)


def subgraph_nodes(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    return reached.select("root", "id").join(nodes, "id").select("root", *nodes.columns)


def subgraph_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Induced links: both ends reached from the same root."""
    first = reached.select("root", F.col("id").alias("source"))
    second = reached.select("root", F.col("id").alias("target"))
    return edges.join(first, "source").join(second, ["root", "target"], "left_semi").select("root", *edges.columns)


def iso(c: Column) -> Column:
    """ISO text in UTC with microseconds, from the instant itself (independent of the session zone)."""
    us = F.unix_micros(c)
    whole = F.floor(us / 1_000_000).cast("bigint")
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86_400).cast("int")), "yyyy-MM-dd")
    s = F.pmod(whole, F.lit(86_400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    fraction = F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0")
    return F.concat(
        day, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(F.pmod(s, F.lit(3600)) / 60)), F.lit(":"),
        two(F.pmod(s, F.lit(60))), F.lit("."), fraction, F.lit("Z"),
    )


def _packed(c: Column) -> Column:
    """Length-prefixed text, so that joined fields stay unambiguous; a null field is just ``-``."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def canonical(kind: str, names: list[str]) -> Column:
    """Canonical text of one payload element: its kind and its fields in a fixed order."""
    cells = [_packed(iso(F.col(c)) if c == "ts" else F.col(c).cast("string")) for c in names]
    return F.concat(F.lit(kind + "|"), F.concat_ws("|", *cells))


PAYLOAD_NODE = [*NODE_COLUMNS, "threat_score", "risk_level", "primary_anomaly"]


def node_document() -> Column:
    """JSON object of a node, null attributes dropped."""
    return F.to_json(F.struct(*[iso(F.col("ts")).alias("timestamp") if c == "ts" else F.col(c) for c in PAYLOAD_NODE]))


def edge_document() -> Column:
    amount = N.sats_to_btc(F.col("amount_sats")).alias("amount_btc")
    return F.to_json(
        F.struct(*[
            iso(F.col("ts")).alias("timestamp") if c == "ts" else amount if c == "amount_sats" else F.col(c)
            for c in EDGE_COLUMNS
        ])
    )


def subgraph_payload(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(root, kind, element, document, sort keys): one row per node and link of every root's subgraph.

    ``document`` is the JSON object with null attributes dropped; ordering by the sort keys within a root
    gives the payload order (nodes by id, links by ends, relationship, amount and time)."""
    for c, t in (("threat_score", "int"), ("risk_level", "string"), ("primary_anomaly", "string")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(t))
    n, e = subgraph_nodes(nodes, reached), subgraph_edges(edges, reached)
    empty = F.lit("")
    node_doc, edge_doc = node_document(), edge_document()
    node_rows = n.select(
        "root", F.lit("node").alias("kind"), canonical("node", PAYLOAD_NODE).alias("element"), node_doc.alias("document"),
        F.col("id").alias("k1"), empty.alias("k2"), empty.alias("k3"), F.lit(None).cast("bigint").alias("k4"),
        F.lit(None).cast("timestamp").alias("k5"),
    )
    edge_rows = e.select(
        "root", F.lit("edge").alias("kind"), canonical("edge", EDGE_COLUMNS).alias("element"), edge_doc.alias("document"),
        F.col("source").alias("k1"), F.col("target").alias("k2"), F.col("relationship").alias("k3"),
        F.col("amount_sats").alias("k4"), F.col("ts").alias("k5"),
    )
    return node_rows.unionAll(edge_rows)


def case_edges(edges: DataFrame, roots: DataFrame, important: DataFrame | None = None) -> DataFrame:
    """(root, source, ...): links of each root's transaction and of its important partners, and the system links
    of the root's hosts. All that the minimal and the explained subgraph can hold, without a ball around the
    root: each root meets the links of at most nine transactions, in one join by transaction."""
    members = roots.select(F.col("tx_id").alias("root")).distinct().select("root", F.col("root").alias("tx"))
    if important is not None:
        other = F.when(F.col("src") == F.col("root"), F.col("dst")).otherwise(F.col("src"))
        members = members.unionAll(important.select("root", other)).distinct()
    paid = edges.filter("relationship IN ('RECEIVED', 'BROADCAST_FROM')").join(members.withColumnRenamed("tx", "source"), "source")
    spent = edges.filter("relationship = 'SPENT'").join(members.withColumnRenamed("tx", "target"), "target")
    hosts = paid.filter("relationship = 'BROADCAST_FROM' AND source = root").select("root", F.col("target").alias("source")).distinct()
    system = edges.filter("relationship = 'BELONGS_TO'").join(hosts, "source")
    columns = ["root", *edges.columns]
    return paid.select(columns).unionAll(spent.select(columns)).unionAll(system.select(columns))


def minimal_subgraph(reached_edges: DataFrame, payload_nodes: DataFrame) -> DataFrame:
    """(root, source, target, ...): links that touch the root's transaction and the system links of the
    hosts it was broadcast from.

    A root that is no transaction of its own subgraph is replaced by the first one there; a subgraph
    without transactions, or without any such link, is kept whole."""
    tx = payload_nodes.filter("label = 'Transaction'").groupBy("root").agg(
        F.max(F.col("id") == F.col("root")).alias("own"), F.min("id").alias("first")
    )
    centre = tx.select("root", F.when(F.col("own"), F.col("root")).otherwise(F.col("first")).alias("centre"))
    e = reached_edges.join(centre, "root", "left")
    touching = (F.col("source") == F.col("centre")) | (F.col("target") == F.col("centre"))
    hosts = e.filter((F.col("relationship") == "BROADCAST_FROM") & (F.col("source") == F.col("centre"))).select(
        "root", F.col("target").alias("source"), F.lit(True).alias("__host")
    ).distinct()
    e = e.join(hosts, ["root", "source"], "left")
    system = (F.col("relationship") == "BELONGS_TO") & F.coalesce("__host", F.lit(False)) & ~touching
    marked = e.withColumn("__keep", F.coalesce(touching | system, F.lit(False)))
    # Whether anything is kept is one flag per root.
    any_kept = marked.groupBy("root").agg(F.max("__keep").alias("__some"))
    return (
        marked.join(any_kept, "root")
        .filter(F.col("__keep") | ~F.col("__some"))
        .select("root", *reached_edges.columns[1:])
    )


def important_edges(weights: DataFrame) -> DataFrame:
    """Per root the leading max(1, min(8, n // 4 or 1)) of its ``n`` weighted pairs, loops dropped, both ways.

    ``weights``: root, src, dst, weight and ``n_edges`` (the number of pairs that were ranked)."""
    order = Window.partitionBy("root").orderBy(F.desc("weight"), "src", "dst")
    # The number of pairs may be beyond an int; what is cut to is not.
    cut = F.greatest(F.lit(1), F.least(F.lit(MAX_IMPORTANT).cast("bigint"), F.floor(F.col("n_edges") / 4).cast("bigint")).cast("int"))
    # The literal bound lets Spark discard lower ranks before the shuffle.
    top = weights.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= MAX_IMPORTANT)
    top = top.filter((F.col("__r") <= cut) & (F.col("src") != F.col("dst"))).select("root", "src", "dst")
    return top.unionAll(top.select("root", F.col("dst"), F.col("src"))).distinct()


def explained_subgraph(reached_edges: DataFrame, payload_nodes: DataFrame, important: DataFrame) -> DataFrame:
    """Links through wallets shared by an important (parent, child) pair, plus the root's broadcast and
    its system links; a root without an important pair has the minimal subgraph. ``method`` tells which."""
    received = reached_edges.filter("relationship = 'RECEIVED'").select(
        "root", F.col("source").alias("parent"), F.col("target").alias("wallet")
    ).distinct()
    spent = reached_edges.filter("relationship = 'SPENT'").select(
        "root", F.col("target").alias("child"), F.col("source").alias("wallet")
    ).distinct()
    pairs = important.select("root", F.col("src").alias("parent"), F.col("dst").alias("child"))
    # At most sixteen pairs per root, so this stays far from a wallet-by-wallet product.
    shared = received.join(pairs, ["root", "parent"]).join(spent, ["root", "child", "wallet"])
    ways = shared.select("root", F.col("parent").alias("source"), F.col("wallet").alias("target"), F.lit("RECEIVED").alias("relationship")).unionAll(
        shared.select("root", F.col("wallet").alias("source"), F.col("child").alias("target"), F.lit("SPENT").alias("relationship"))
    ).distinct()
    money = reached_edges.join(ways, ["root", "source", "target", "relationship"], "left_semi")
    own = reached_edges.filter((F.col("relationship") == "BROADCAST_FROM") & (F.col("source") == F.col("root")))
    hosts = own.select("root", F.col("target").alias("source")).distinct()
    system = reached_edges.filter("relationship = 'BELONGS_TO'").join(hosts, ["root", "source"], "left_semi")
    weighed = important.select("root").distinct()
    found = money.unionByName(own).unionByName(system).join(weighed, "root", "left_semi").withColumn("method", F.lit("edge_weights"))
    rest = reached_edges.join(weighed, "root", "left_anti")
    fallback = minimal_subgraph(rest.select("root", *reached_edges.columns[1:]), payload_nodes).withColumn(
        "method", F.lit("heuristic_fallback")
    )
    return found.unionByName(fallback)


def kept_nodes(kept_edges: DataFrame, alerts: DataFrame) -> DataFrame:
    """(root, id): the ends of a reduced subgraph's links, and the root itself."""
    ends = kept_edges.select("root", F.col("source").alias("id")).unionAll(kept_edges.select("root", F.col("target")))
    return ends.unionAll(alerts.select("tx_id", "tx_id")).distinct()


# ---------------------------------------------------------------- insights per root


def label_counts(payload_nodes: DataFrame) -> DataFrame:
    return payload_nodes.groupBy("root").agg(
        *[
            F.sum((F.col("label") == label).cast("int")).alias(name)
            for label, name in (
                ("Transaction", "transactions"), ("WalletAddress", "wallets"), ("IPAddress", "hosts"), ("ASN", "systems"),
            )
        ]
    )


def relationship_counts(payload_edges: DataFrame) -> DataFrame:
    return payload_edges.groupBy("root", "relationship").agg(F.count("*").alias("n"))


def graph_insights(payload_nodes: DataFrame, payload_edges: DataFrame) -> DataFrame:
    """(root, section, id, amount_sats, ts, detail): the rows an investigator reads for each alert.

    Sections: direct_input, direct_output, exchange_output, network_step, system."""
    info = payload_nodes.select("root", "id", "label", "type", "entity_id", "description")
    target = info.toDF("root", "target", "t_label", "t_type", "t_entity", "t_description")
    source = info.toDF("root", "source", "s_label", "s_type", "s_entity", "s_description")
    base = payload_edges
    is_root = lambda c: F.col(c) == F.col("root")

    def rows(df: DataFrame, section: str, ident: str, detail: Column) -> DataFrame:
        return df.select(
            "root", F.lit(section).alias("section"), F.col(ident).alias("id"), "amount_sats", "ts", detail.alias("detail")
        )

    inputs = base.filter((F.col("relationship") == "SPENT") & is_root("target")).join(source, ["root", "source"])
    received = base.filter("relationship = 'RECEIVED'").join(target, ["root", "target"])
    cashed = received.filter("t_type = 'exchange'")
    steps = base.filter("relationship = 'BROADCAST_FROM'")
    systems = payload_nodes.filter("label = 'ASN'").select(
        "root", F.lit("system").alias("section"), "id", F.lit(None).cast("bigint").alias("amount_sats"),
        F.lit(None).cast("timestamp").alias("ts"), F.col("description").alias("detail"),
    )
    return (
        rows(inputs, "direct_input", "source", F.col("s_entity"))
        .unionAll(rows(received.filter(is_root("source")), "direct_output", "target", F.col("t_type")))
        .unionAll(rows(cashed, "exchange_output", "target", F.when(is_root("source"), F.lit("root cashout")).otherwise(F.concat(F.lit("from "), "source"))))
        .unionAll(rows(steps, "network_step", "target", F.when(is_root("source"), F.lit("root broadcast")).otherwise(F.concat(F.lit("linked broadcast from "), "source"))))
        .unionAll(systems)
    )


def exchange_exposure(payload_nodes: DataFrame, payload_edges: DataFrame) -> DataFrame:
    """(root, exchange_sats, n_exchange_outputs): money reaching exchange wallets in the subgraph."""
    wallets = payload_nodes.filter("type = 'exchange'").select("root", F.col("id").alias("target"))
    paid = payload_edges.filter("relationship = 'RECEIVED'").join(wallets, ["root", "target"], "left_semi")
    sums = paid.groupBy("root").agg(F.sum("amount_sats").alias("s"), F.count("*").alias("n"))
    return payload_nodes.select("root").distinct().join(sums, "root", "left").select(
        "root", F.coalesce("s", F.lit(0)).alias("exchange_sats"), F.coalesce("n", F.lit(0)).alias("n_exchange_outputs")
    )


def head_per_root(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per root; Spark drops later rows before the shuffle (rank limit)."""
    w = Window.partitionBy("root").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def money_rows(insights: DataFrame, n: int = 8) -> DataFrame:
    """Exchange outputs of a root, or its direct outputs where it has none; the first ``n``."""
    cashed = insights.filter("section = 'exchange_output'")
    direct = insights.filter("section = 'direct_output'").join(cashed.select("root").distinct(), "root", "left_anti")
    return head_per_root(cashed.unionByName(direct), [F.col("id"), F.col("amount_sats"), F.col("ts"), F.col("detail")], n)


def top_suspicious(payload_nodes: DataFrame, n: int) -> DataFrame:
    tx = payload_nodes.filter("label = 'Transaction'")
    return head_per_root(tx, [F.desc(F.coalesce("threat_score", F.lit(0))), F.col("id")], n)


def timeline(payload_nodes: DataFrame, n: int = 7) -> DataFrame:
    """The last ``n`` transactions of a root's subgraph, re-numbered in ascending time."""
    last = head_per_root(payload_nodes.filter("label = 'Transaction'"), [F.desc("ts"), F.desc("id")], n, "back")
    return head_per_root(last.drop("back"), [F.col("ts"), F.col("id")], n, "step")
