"""Labels of balls, with few links enough to be busy, against a direct search on small random graphs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from coinweave.operators import balls, graph, labels
from helpers import column
from test_balls import near, world


@pytest.mark.parametrize("links,most,hops", [(1, 1000, 4), (4, 3, 3)])
def test_labels_with_busy_nodes_against_a_search(spark, monkeypatch, links, most, hops):
    monkeypatch.setattr(labels, "GROUP", 1)  # groups of one batch
    nodes, edges, n, e, tx = world(spark, seed=links, transactions=70)
    roots = tx + ["w0", "w7", "as1"]  # roots that are busy themselves
    numbered = balls.number_roots(nodes, nodes.filter(F.col("id").isin(roots)).select(F.col("id").alias("tx_id")))
    held = {r: near(e, r, hops, n) for r in roots}
    found = balls.bit_balls(nodes, edges, numbered, hops, links, most)
    place = {r.place: r.root for r in numbered.collect()}
    got = [(place[i], r.id, r.depth) for r in found.select("id", "depth", balls.bits_text().alias("t")).collect() for i, x in enumerate(r.t) if x == "1"]
    assert sorted(got) == sorted((r, v, d) for r in roots for v, d in held[r].items())
    reached = balls.reach(found)
    assert not reached.roots.filter("size(codes) > 0").isEmpty()
    labelled = {x[0]: x[1] for x in n}
    counts = {(r.root, r.kind): r.n for r in balls.root_sums(balls.node_bits(nodes, reached), numbered, F.col("label")).collect()}
    assert counts == Counter((r, labelled[v]) for r in roots for v in held[r])
    inside = [(r, x) for r in roots for x in e if x[0] in held[r] and x[1] in held[r]]
    sums = balls.root_sums(balls.edge_bits(edges, reached), numbered, F.col("relationship"), F.col("amount_sats") - 2).collect()
    money = Counter()
    for r, x in inside:
        money[r, x[2]] += (x[3] - 2) if x[3] is not None else 0
    assert {(r.root, r.kind): (r.n, r.total) for r in sums} == {k: (v, money[k]) for k, v in Counter((r, x[2]) for r, x in inside).items()}
    bits = balls.edge_bits(edges, reached).select("source", "target", balls.bits_text().alias("t")).collect()
    assert Counter((place[i], r.source, r.target) for r in bits for i, x in enumerate(r.t) if x == "1") == Counter((r, *x[:2]) for r, x in inside)
    if hops == graph.DEFAULT_HOPS:
        alerts = numbered.select(F.col("root").alias("tx_id"))
        rows = lambda df: sorted(map(tuple, df.select("root", "rank", "document").collect()))
        args = nodes, edges, balls.both_ways(edges), alerts, 5
        assert rows(balls.leading_nodes(*args, reached=reached, numbered=numbered)) == rows(balls.leading_nodes(*args))
        shown = lambda df: sorted(map(tuple, df.select("root", "rank", "id").collect()))
        args = nodes, args[2], alerts, [F.desc(F.coalesce("threat_score", F.lit(0))), F.col("id")], 6
        assert shown(balls.leading_transactions(*args, reached=reached, numbered=numbered)) == shown(balls.leading_transactions(*args))


def test_a_hub_brings_no_row_for_each_pair(spark):
    """300 alerts around one wallet: 301 nodes and 300 roots have a few labels each, where their balls hold 90,000 pairs."""
    tx = [f"t{i:03d}" for i in range(300)]
    nodes = spark.createDataFrame([(t, "Transaction", "hub") for t in tx] + [("w", "WalletAddress", "output")], "id string, label string, type string")
    edges = spark.createDataFrame([(t, "w", "RECEIVED", 1) for t in tx], "source string, target string, relationship string, amount_sats long")
    numbered = balls.number_roots(nodes, nodes.filter("label = 'Transaction'").select(F.col("id").alias("tx_id")))
    reached = balls.reach(balls.bit_balls(nodes, edges, numbered))
    size = reached.table.selectExpr("sum(size(codes) + size(near) + size(more) + size(also))").head()[0]
    assert size + reached.roots.selectExpr("sum(size(codes) + size(more))").head()[0] < 1000
    sums = balls.root_sums(balls.edge_bits(edges, reached), numbered, F.lit("all"), F.col("amount_sats"))
    assert column(sums, "n", "total") == [(300, 300)] * 300
