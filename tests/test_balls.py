"""Balls, digests and leading rows of all alerts, against a direct search on small random graphs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from coinweave.operators import balls, evidence, graph
from coinweave.operators.audit import audit_graph, audit_shapes
from helpers import column

EDGES = "source string, target string, relationship string, amount_sats long, ts timestamp, src_port int, dst_ip string, dst_port int"
NODES = "id string, label string, type string, risk string, ts timestamp, src_port int, dst_ip string, dst_port int, country string, description string, entity_id string, threat_score int, risk_level string, primary_anomaly string"


def world(spark, seed=1, transactions=90):
    """Transactions, wallets and hosts with a hub, repeated links, exchange wallets that also spend, and islands."""
    from datetime import datetime, timedelta, timezone

    rng = random.Random(seed)
    at = lambda i: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=i % 7)
    tx, wallets, hosts = [f"t{i}" for i in range(transactions)], [f"w{i}" for i in range(60)], [f"h{i}" for i in range(9)]
    cash = set(wallets[:6])
    nodes = [(t, "Transaction", "hub", rng.choice(["high", None]), at(i), 1, "d", 2, None, None, None, rng.choice([None, 50, 90]), "HIGH", "x") for i, t in enumerate(tx)]
    nodes += [(w, "WalletAddress", "exchange" if w in cash else "output", None, None, None, None, None, None, None, f"e{w}", None, None, None) for w in wallets]
    nodes += [(h, "IPAddress", "network", None, None, None, None, None, "NL", None, None, None, None, None) for h in hosts]
    nodes += [("as1", "ASN", "infrastructure", None, None, None, None, None, None, "D", None, None, None, None)]
    edges = []
    for i, t in enumerate(tx[:-3]):  # the last three are islands
        for w in rng.sample(wallets, rng.randrange(1, 3)):
            edges.append((t, w, "RECEIVED", rng.randrange(4), at(i), None, None, None))
        if rng.random() < 0.5:
            edges.append((rng.choice(wallets), t, "SPENT", rng.choice([None, 5]), at(i), None, None, None))
        if rng.random() < 0.3:
            h = rng.choice(hosts)
            edges.append((t, h, "BROADCAST_FROM", None, at(i), 1, "d", rng.choice([None, 7])))
            if h in hosts[:2]:
                edges += [(h, "as1", "BELONGS_TO", None, None, None, None, None)] * 2
    edges += edges[:5]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), nodes, edges, tx


def near(edges, root, hops, nodes):
    links = defaultdict(set)
    for s, t, *_ in edges:
        links[s].add(t), links[t].add(s)
    depth, last = {root: 0}, {root}
    for d in range(1, hops + 1):
        last = {v for u in last for v in links[u]} - depth.keys()
        depth.update(dict.fromkeys(last, d))
    cash = {n[0] for n in nodes if n[2] == "exchange"}
    extra = {t for s, t, r, *_ in edges if r == "RECEIVED" and s in depth and t in cash} - depth.keys()
    return depth | dict.fromkeys(extra, hops + 1)


@pytest.fixture(scope="module")
def case(spark):
    nodes, edges, n, e, tx = world(spark)
    roots = tx[::2] + tx[-3:]
    alerts = nodes.filter(F.col("id").isin(roots)).select(F.col("id").alias("tx_id"), "ts", F.lit(50).alias("threat_score"))
    alerts = alerts.unionByName(alerts.limit(3)).unionByName(alerts.limit(1).withColumn("tx_id", F.lit("unknown")))
    return nodes, edges, n, e, roots, alerts


@pytest.mark.parametrize("hops", [1, 4])
def test_bit_balls_against_a_search(spark, case, hops):
    nodes, edges, n, e, roots, alerts = case
    numbered = balls.number_roots(nodes, alerts)
    assert sorted(column(numbered, "root")) == sorted(set(roots))
    found = balls.bit_balls(nodes, edges, numbered, hops)
    place = {r.place: r.root for r in numbered.collect()}
    got = {(place[i], r.id, r.depth) for r in found.select("id", "depth", balls.bits_text().alias("t")).collect() for i, x in enumerate(r.t) if x == "1"}
    want = {(r, v, d) for r in set(roots) for v, d in near(e, r, hops, n).items()}
    assert got == want
    reached = balls.reach(found)
    inside = balls.edge_bits(edges, reached)
    sums = {(r.root, r.kind): (r.n, r.total) for r in balls.root_sums(inside, numbered, F.col("relationship"), F.col("amount_sats")).collect()}
    have, money = Counter(), Counter()
    for r in set(roots):
        ball = near(e, r, hops, n)
        for x in e:
            if x[0] in ball and x[1] in ball:
                have[r, x[2]] += 1
                money[r, x[2]] += x[3] or 0
    assert sums == {k: (have[k], money[k]) for k in have}
    if hops < 4:
        return
    ranked = edges.withColumn("rank", F.xxhash64(*edges.columns))
    held = ranked.collect()
    lowest = [
        (r, x) for r in set(roots) for ball in [near(e, r, hops, n)]
        for x in sorted(row["rank"] for row in held if row.source in ball and row.target in ball)[:3]
    ]
    assert sorted(column(balls.first_of_roots(balls.edge_bits(ranked, reached), numbered, 3), "root", "rank")) == sorted(lowest)


def test_batches_of_roots(spark):
    """More roots than a batch holds: a chain in which every node is an alert."""
    ids = [f"{i:04d}" for i in range(balls.WIDTH + 40)]
    nodes = spark.createDataFrame([(i, "Transaction", "hub") for i in ids], "id string, label string, type string")
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "source string, target string").withColumn("relationship", F.lit("SPENT"))
    numbered = balls.number_roots(nodes, nodes.select(F.col("id").alias("tx_id")))
    assert sorted(column(numbered.groupBy("batch").count(), "batch", "count")) == [(0, balls.WIDTH), (1, 40)]
    sums = balls.root_sums(balls.node_bits(nodes, balls.reach(balls.bit_balls(nodes, edges, numbered, 2))), numbered, F.col("label"))
    assert {r.root: r.n for r in sums.collect()} == {i: 1 + min(2, k) + min(2, len(ids) - 1 - k) for k, i in enumerate(ids)}


def test_shapes_agree_with_rows_for_each_root(spark, case):
    nodes, edges, n, e, roots, alerts = case
    numbered = balls.number_roots(nodes, alerts)
    known = alerts.filter("tx_id <> 'unknown'").distinct()
    reached = graph.n_hop(nodes, edges, known, 4)
    want = audit_graph(known, graph.subgraph_nodes(nodes, reached), graph.subgraph_edges(edges, reached))
    shapes = balls.ball_shapes(nodes, edges, balls.reach(balls.bit_balls(nodes, edges, numbered)), numbered)
    got = audit_shapes(known, *shapes)
    rows = lambda df: sorted(map(tuple, df.select("tx_id", "failure", "n").collect()))
    assert rows(got) == rows(want) and {"edge fields missing", "no edges", "root fields missing"} <= {r[1] for r in rows(got)}
    assert ("unknown", "no nodes", 1) in rows(audit_shapes(alerts, *shapes))


def test_leading_rows_agree_with_rows_for_each_root(spark, case):
    nodes, edges, n, e, roots, alerts = case
    known = alerts.filter("tx_id <> 'unknown'").distinct()
    links, numbered = balls.both_ways(edges), balls.number_roots(nodes, alerts)
    reached = graph.n_hop(nodes, edges, known, 4)
    inside = graph.subgraph_nodes(nodes, reached)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    order = [F.desc(F.coalesce("threat_score", F.lit(0))), F.col("id")]
    assert rows(balls.leading_transactions(nodes, links, known, order, 5), "root", "id", "rank") == rows(graph.top_suspicious(inside, 5), "root", "id", "rank")
    payload = graph.subgraph_payload(nodes, edges, reached)
    want = graph.head_per_root(payload.filter("kind = 'node'"), [F.col("k1")], 6)
    assert rows(balls.leading_nodes(nodes, edges, links, known, 6), "root", "rank", "document") == rows(want, "root", "rank", "document")
    keys = [F.col(f"k{i}") for i in range(1, 6)] + [F.col("element")]
    want = graph.head_per_root(payload.filter("kind = 'edge'"), keys, 7)
    got = balls.leading_edges(edges, balls.reach(balls.bit_balls(nodes, edges, numbered)), numbered, 7)
    assert rows(got, "root", "rank", "element") == rows(want, "root", "rank", "element")
    paid = balls.leading_payments(nodes, edges, links, known, 4)
    for r in set(roots):
        ball = near(e, r, 4, n)
        cash = sorted((x[1], x[3], x[4].isoformat(), x[0]) for x in e if x[2] == "RECEIVED" and x[0] in ball and x[1] in {m[0] for m in n if m[2] == "exchange"})
        own = sorted((x[1], x[3], x[4].isoformat(), x[0]) for x in e if x[2] == "RECEIVED" and x[0] == r)
        kind = "exchange_output" if cash else "direct_output"
        assert rows(paid.filter(F.col("root") == r), "rank", "section", "id", "amount_sats") == [(i + 1, kind, x[0], x[1]) for i, x in enumerate((cash or own)[:4])]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def combined(digests):
    leaves = [sha(f"{h}x{n}") for h, n in Counter(digests).items()]
    buckets = defaultdict(list)
    for leaf in leaves:
        buckets[leaf[:4]].append(leaf)
    return sha("".join(sorted(p + sha("".join(sorted(x))) for p, x in buckets.items())))


def test_digests_against_a_recursion_and_their_reach(spark, case):
    nodes, edges, n, e, roots, alerts = case
    payload = {r[0]: sha(r[1]) for r in nodes.select("id", graph.canonical("node", graph.PAYLOAD_NODE)).collect()}
    links = [(r[0], r[1], sha(r[2])) for r in edges.select("source", "target", graph.canonical("edge", graph.EDGE_COLUMNS)).collect()]
    cash = {x[0] for x in n if x[2] == "exchange"}
    ways = defaultdict(list)
    for s, t, link in links:
        ways[s].append((t, link)), ways[t].append((s, link))
    own = {}
    for v in payload:
        tills = [sha(link + payload[o]) for o, link in ways[v] if o in cash]
        own[v] = sha(payload[v] + (combined(tills) if tills else ""))
    state = own
    for _ in range(2):
        state = {v: sha(own[v] + (combined([sha(link + state[o]) for o, link in ways[v]]) if ways[v] else "")) for v in own}
    got = dict(column(balls.node_digests(nodes, edges, 2), "id", "digest"))
    assert got == state
    some = dict(column(balls.node_digests(nodes.repartition(7), edges.repartition(5), 2, alerts), "id", "digest"))
    assert some == {r: state[r] for r in set(roots)}
    # A changed payload is seen from within two steps, and from nowhere else but behind an exchange payment.
    target = next(x[1] for x in e if x[2] == "BROADCAST_FROM")
    changed = nodes.withColumn("country", F.when(F.col("id") == target, F.lit("XX")).otherwise(F.col("country")))
    after = dict(column(balls.node_digests(changed, edges, 2), "id", "digest"))
    assert {v for v in got if got[v] != after[v]} == {v for v in payload if target in near(e, v, 2, [])}
    one = dict(column(balls.custody_digests(nodes, edges, alerts.distinct()), "tx_id", "chain_of_custody_hash"))
    assert len(one) == len(set(roots)) + 1 and all(len(h) == 64 for h in one.values())


def test_insights_agree_with_rows_for_each_root(spark, case):
    nodes, edges, n, e, roots, alerts = case
    known, numbered = alerts.filter("tx_id <> 'unknown'").distinct(), balls.number_roots(nodes, alerts)
    reached = graph.n_hop(nodes, edges, known, 4)
    inside = graph.subgraph_nodes(nodes, reached), graph.subgraph_edges(edges, reached)
    want = Counter(map(tuple, graph.graph_insights(*inside).select("root", "section", "id", "amount_sats", "detail").collect()))
    place = {r.place: r.root for r in numbered.collect()}
    near_bits = balls.reach(balls.bit_balls(nodes, edges, numbered))
    held = balls.edge_bits(edges, near_bits)
    got = Counter()
    for r in balls.ball_insights(nodes, held, near_bits, numbered).select("section", "id", "amount_sats", "detail", balls.bits_text().alias("t")).collect():
        got.update((place[i], r.section, r.id, r.amount_sats, r.detail) for i, x in enumerate(r.t) if x == "1")
    assert got == want
    assert sorted(map(tuple, balls.ball_exposure(nodes, held, numbered).collect())) == sorted(map(tuple, graph.exchange_exposure(*inside).collect()))


def test_evidence_holds_the_reduced_subgraph(spark, case):
    nodes, edges, n, e, roots, alerts = case
    known = alerts.filter("tx_id <> 'unknown'").distinct()
    kept = graph.minimal_subgraph(graph.case_edges(edges, known), known.select(F.col("tx_id").alias("root"), F.col("tx_id").alias("id"), F.lit("Transaction").alias("label")))
    kept = kept.withColumn("method", F.lit("m"))
    ends = defaultdict(set)
    for r in kept.collect():
        ends[r.root] |= {r.source, r.target, r.root}
    ids = graph.kept_nodes(kept, known)
    assert {r.root for r in ids.collect()} == set(roots)
    found = {r.tx_id: r.xai_subgraph for r in evidence.reduced_subgraphs(kept, known).collect()}
    assert {t: x.nodes for t, x in found.items()} == {t: len(v) for t, v in ends.items()}
    assert {t: x.edges for t, x in found.items()} == dict(Counter(r.root for r in kept.collect()))


def test_digests_of_nodes_with_many_links_are_the_same_by_levels(spark, case):
    """Findings F1, F2: bytes instead of digits, repeated links counted before they move, one shuffle for nodes with few links."""
    nodes, edges, n, e, roots, alerts = case
    want = dict(column(balls.node_digests(nodes, edges, 3), "id", "digest"))
    assert want == dict(column(balls.node_digests(nodes, edges, 3, busy_links=2), "id", "digest"))
    few = dict(column(balls.node_digests(nodes, edges, 3, alerts, busy_links=2), "id", "digest"))
    assert few == {r: want[r] for r in set(roots)}
    links = balls._link_digests(edges)
    assert dict(links.dtypes)["l"] == "binary" and links.filter("target = 'as1'").count() == len({x[0] for x in e if x[1] == "as1"})
    assert links.agg(F.sum("n").alias("n")).head()["n"] == len(e)
