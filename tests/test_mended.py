"""Cells and rows that used to be read wrongly."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from coinweave import session
from coinweave.functions import normalize as N
from coinweave.operators import components, graph, heuristics, ledger, links, training_tables
from coinweave.sources import ingest, readers
from helpers import column, frame, tx
from test_normalize import parse


@pytest.mark.parametrize(
    "text,value,error",
    [
        ("5.00000000001", None, "not an integer"), ("5.000", 5, None), ("+7", 7, None), ("1e3", 1000, None), ("1.5e1", 15, None), ("15e-1", None, "not an integer"),
        ("1e30", None, "too large"), ("9223372036854775807", 9223372036854775807, None), ("9223372036854775808", None, "too large"),
        ("-1", -1, "negative"), ("x", None, "not numeric"), ("NaN", None, "not numeric"), ("-0.5", None, "not an integer"),
    ],
)
def test_amount_cells(spark, text, value, error):
    (items, message), = parse(spark, N.parse_amounts(F.col("v")), [text])
    assert (items == [value] or error) and (message is None) == (error is None) and (error or "") in (message or "")


def test_short_and_basic_times(spark):
    cells = ["2024-08-29 13:45", "2024-08-29T13:45Z", "2024-08-29T13", "20240829T134500Z", "20240829T1345", "2024-08-29T15:45+02:00", "2024-08-29", "2024-08-29T13:45:00.5Z", "2024-08-29T25:00", "2024-08-29Tx"]
    got = spark.createDataFrame([(c,) for c in cells], "v string").select(F.unix_micros(N.normalize_timestamp(F.col("v")).value)).collect()
    day = 1_724_889_600_000_000
    minutes = [13 * 60 + 45, 13 * 60 + 45, 13 * 60, 13 * 60 + 45, 13 * 60 + 45, 13 * 60 + 45, 0]
    assert [r[0] for r in got][:7] == [day + m * 60_000_000 for m in minutes]
    assert got[7][0] == day + 49_500_500_000 and got[8][0] is None and got[9][0] is None


def test_overflowing_sums_are_quarantined(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'tx_id,class,time_step,input_addresses,output_addresses,input_amounts,output_amounts\n'
        'a,1,1,x;y,z,9000000000000000000;9000000000000000000,5\n"b\nb",1,1,x,z,10,5\n'
    )
    good, bad = ingest.validate(ingest.normalize_transactions(readers.read_transactions(spark, str(path))), "quarantine")
    assert [r.tx_id for r in good.collect()] == ["b\nb"]  # a cell with a line break is one cell
    assert "input amounts are too large together" in bad.head().errors


def test_reviews_of_one_node_are_one(spark):
    nodes = spark.createDataFrame([(7, -1), (8, -1)], "txId long, class int").withColumn("is_train", F.lit(False))
    reviews = spark.createDataFrame([("7", 1, 1), ("07", 0, 2), ("x", 1, 1), ("99", 1, 1)], "tx_id string, human_label int, timestamp int")
    patched, unknown = links.apply_feedback(nodes, reviews)
    assert sorted((r.txId, r["class"], r.is_train) for r in patched.collect()) == [(7, 0, True), (8, -1, False)]
    assert sorted(r.tx_id for r in unknown.collect()) == ["99", "x"]


def test_each_field_has_its_own_longest_prefix(spark):
    prefixes = spark.createDataFrame([("10.0.0.0/8", "US", "AS1", "one"), ("10.1.0.0/16", None, "AS2", "two"), ("10.1.2.0/24", "FR", None, None)], "cidr string, country string, asn string, asn_description string")
    ips = spark.createDataFrame([("10.1.1.1",), ("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",)], "ip string")
    got = {r.ip: (r.country, r.asn, r.asn_description) for r in links.match_prefixes(ips, links.prefix_table(prefixes)).collect()}
    assert got == {"10.1.1.1": ("US", "AS2", "two"), "10.1.2.3": ("FR", "AS2", "two"), "10.9.9.9": ("US", "AS1", "one")}


def test_fans_at_the_same_instant(spark):
    rows = [tx("p", [("s", 900)], [("i", 800)]), tx("out", [("i", 800)], [(f"o{k}", 100) for k in range(5)]), tx("late", [("s2", 800)], [(f"q{k}", 100) for k in range(5)]), tx("next", [("q0", 100)], [("z", 1)], at=1)]
    led = ledger.from_transactions(frame(spark, rows))
    latest = ledger.latest_receipt(led.receipts)
    assert sorted(r.tx_id for r in heuristics.fan_out(led, latest, delta_s=0).collect()) == ["out"]


def test_root_without_important_pair_has_its_minimal_subgraph(spark):
    rows = [tx("a", [("w", 10)], [("v", 5)]), tx("b", [("v", 5)], [("u", 4)], src_ip="192.0.2.9")]
    led = ledger.from_transactions(frame(spark, rows))
    nodes, edges = graph.build_nodes(led), graph.build_edges(led)
    roots = spark.createDataFrame([("a",), ("b",)], "tx_id string")
    reached = graph.n_hop(nodes, edges, roots, 4)
    e, n = graph.subgraph_edges(edges, reached), graph.subgraph_nodes(nodes, reached)
    pairs = spark.createDataFrame([("a", "a", "b"), ("a", "b", "a")], "root string, src string, dst string")
    got = {(r.root, r.source, r.target, r.method) for r in graph.explained_subgraph(e, n, pairs).collect()}
    assert ("a", "a", "v", "edge_weights") in got and ("a", "w", "a", "edge_weights") not in got
    assert {("b", "v", "b", "heuristic_fallback"), ("b", "b", "u", "heuristic_fallback")} <= got


def test_any_number_of_categories(spark):
    df = spark.range(1100).select(F.concat(F.lit("c"), "id").alias("port"))
    assert len(training_tables.one_hot(df, "port", "port").columns) == 1100


def test_scratch_tables_can_be_cleared(spark):
    made = session.materialize(spark.range(3).toDF("x"), "gone")
    (path,) = {f.rsplit("/", 1)[0] for f in made.inputFiles()}
    assert spark.read.parquet(path).count() == 3
    session.clear_scratch(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session())


def test_important_edges_of_more_pairs_than_an_int_holds(spark):
    """Findings F3, F4, F16: the number of ranked pairs grows with the square of a busy wallet's transactions."""
    rows = [("a", f"b{i}", "a", float(i), n) for n in (40_000_000_000,) for i in range(12)]
    found = graph.important_edges(spark.createDataFrame(rows, "root string, src string, dst string, weight double, n_edges long"))
    assert column(found.filter("dst = 'a'"), "src") == sorted(f"b{i}" for i in range(4, 12))


@pytest.mark.parametrize("few,busy_links", [(1_000_000, 10_000), (6, 10_000), (0, 3)])
def test_communities_by_regions_are_those_of_whole_rounds(spark, few, busy_links):
    """Finding F5: rounds in which few labels change ask the nodes around them alone; hubs count in each task first."""
    rng = random.Random(few)
    pairs = {(i, i + rng.choice((1, 2, 5))) for i in range(160)} | {(300, i) for i in range(301, 340)} | {(400, 401), (500, 500)}
    nodes = spark.createDataFrame([(i, 1 + (i >= 300)) for i in [*range(170), *range(300, 340), 400, 401, 500, 600]], "txId long, time_step int")
    links = {v: {v} for v, _ in nodes.collect()}
    for a, b in pairs:
        links[a].add(b), links[b].add(a)
    label, before, rounds = {v: v for v in links}, None, 0
    while True:
        fresh = {}
        for v, near in links.items():
            votes = Counter(label[u] for u in near)
            fresh[v] = min(votes, key=lambda x: (-votes[x], x))
        same, before, label, rounds = fresh == before, label, fresh, rounds + 1
        if same:
            break
    got = dict(column(components.communities(nodes, spark.createDataFrame(sorted(pairs), "source long, target long"), few, busy_links), "txId", "label"))
    assert rounds > 4 and got == {v: min(label[v], before[v]) for v in links}


def test_rounds_of_communities_move_no_links(spark, monkeypatch):
    """Links lie dealt by source, so a round's join with the labels shuffles the labels alone."""
    given, plans = components._winners, []

    def winners(links, labels, busy):
        plan = links.join(labels.withColumnRenamed("txId", "source"), "source")._jdf.queryExecution().executedPlan()
        plans.append(plan.toString().split("InMemoryRelation")[0].count("Exchange"))
        return given(links, labels, busy)

    monkeypatch.setattr(components, "_winners", winners)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([(i, 1) for i in range(60)], "txId long, time_step int")
        edges = spark.createDataFrame([(i, i + k) for i in range(57) for k in (1, 2, 3)], "source long, target long")
        found = components.communities(nodes, edges)
        assert found.count() == 60 and plans and max(plans[:1]) <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
