"""Scores, contributions, subgraphs, hashes and audit."""

import random

import pytest
from pyspark.sql import functions as F

from coinweave.operators import evidence, graph, links, metrics, models, ordering, scoring, training_tables
from coinweave.operators.audit import audit_evidence, audit_graph
from coinweave.plans import pipeline
from coinweave.sources.tables import read_table
from helpers import column, frame, tx
from test_heuristics import COIN, peel_rows


def test_probabilities_keep_their_shares(spark):
    df = spark.range(1)
    row = df.select(*[c.alias(n) for n, c in scoring.normalize_probabilities(F.lit(0.25), F.lit(0.35), F.lit(0.40)).items()]).head()
    assert tuple(row) == (75, 0.25, 0.35, 0.4)


def largest_remainder(raw, score):
    used = [(f, v) for f, v in raw if v > 0] or [("tx_volume", 1.0)]
    total = 0.0
    for _, v in used:
        total += v
    exact = [(f, v / total * score) for f, v in used]
    parts = [int(v) for _, v in exact]
    order = sorted(range(len(exact)), key=lambda i: (exact[i][1] - int(exact[i][1]), exact[i][0]), reverse=True)
    for i in order[: score - sum(parts)]:
        parts[i] += 1
    rows = [(exact[i][0], parts[i]) for i in range(len(parts)) if parts[i] > 0]
    return sorted(rows, key=lambda r: -r[1])


def test_contributions_always_add_up(spark):
    rng = random.Random(5)
    names = scoring.FEATURE_ORDER
    cases = [([(n, 1.0) for n in names[:5]], 3), ([], 50), ([("fee_ratio", -1.0)], 7)]
    for _ in range(150):
        raw = [(n, rng.choice([0.0, -1.0, rng.random() * 20, float(rng.randrange(4))])) for n in names]
        cases.append((raw, rng.randrange(0, 101)))
    df = spark.createDataFrame([(i, raw, s) for i, (raw, s) in enumerate(cases)], "i int, raw array<struct<feature: string, raw: double>>, s int")
    got = {r.i: [tuple(x) for x in r.points] for r in df.select("i", evidence.contributions(F.col("raw"), F.col("s")).alias("points")).collect()}
    for i, (raw, score) in enumerate(cases):
        assert sum(p for _, p in got[i]) == score and all(p > 0 for _, p in got[i])
        assert got[i] == largest_remainder(raw, score), (raw, score)


def test_feature_texts(spark):
    base = {n: 0.0 for n in scoring.FEATURE_ORDER} | {"terminal_exchange": 1.0, "ext_feature_mean": 2.0}
    df = spark.createDataFrame([{**base, "asn": "AS9", "asn_description": "Nine", "reused": False, "change_spent": False}])
    value = lambda n: df.select(evidence.feature_value(F.lit(n)).alias("v")).head()["v"]
    assert value("terminal_exchange") == "Terminal Exchange Wallet"
    assert value("ext_feature_mean") == "2.0"
    assert value("tor_or_bulletproof_asn") == "Nine (AS9)"
    assert value("change_reuse") == "Change Address Signal"


def case(spark, rows, hops=4):
    """A pipeline run with every transaction treated as an alert."""
    found = pipeline.detect(frame(spark, rows))
    found["alerts"] = scoring.alerts(found["scored"], 0)
    out = pipeline.investigate(found, hops=hops)
    return dict(found=found, case=out, led=found["ledger"], pn=out["page_nodes"], pe=out["page_edges"], **{
        k: v for k, v in {**found, **out}.items() if k != "ledger"
    })


def chain_rows():
    rows = peel_rows()
    last = list(rows[-1])
    last[12] = [("1desk", 4_985_000), last[12][1]]
    last[14] = ["1desk"]
    # Hosts of their own, so that the chain is reached through the money alone.
    return [tuple(r[:4]) + (f"192.0.2.{i}",) + tuple(r[5:8]) + (f"AS{i}",) + tuple(r[9:]) for i, r in enumerate([*rows[:-1], tuple(last)])]


def test_four_hops_reach_the_chain_and_its_exchange(spark):
    c = case(spark, chain_rows())
    ball = set(column(c["reached"].filter("root = 'hop_1'"), "id"))
    assert {"hop_1", "hop_2", "hop_3", "1desk"} <= ball
    exposure = {r.root: r.exchange_sats for r in graph.exchange_exposure(c["pn"], c["pe"]).collect()}
    assert exposure["hop_1"] == 4_985_000
    near = graph.n_hop(c["nodes"], c["edges"], c["alerts"], 2)
    assert near.select("root", "id").subtract(c["reached"].select("root", "id")).isEmpty()


def test_hash_survives_shuffling_and_sees_every_change(spark):
    rows = chain_rows()
    first = case(spark, rows)
    second = case(spark, rows[::-1])
    h1 = dict(column(evidence.custody_hash(first["payload"], first["alerts"]), "tx_id", "chain_of_custody_hash"))
    h2 = dict(column(evidence.custody_hash(second["payload"].repartition(7), second["alerts"]), "tx_id", "chain_of_custody_hash"))
    assert h1 == h2 and all(len(h) == 64 for h in h1.values())
    altered = first["payload"].withColumn("element", F.when(F.col("k1") == "1desk", F.concat("element", F.lit("!"))).otherwise(F.col("element")))
    h3 = dict(column(evidence.custody_hash(altered, first["alerts"]), "tx_id", "chain_of_custody_hash"))
    assert all(h3[t] != h1[t] for t in h1)
    docs = first["payload"].filter("root = 'hop_1' and kind = 'edge'").orderBy("k1", "k2", "k3", "k4", "k5")
    assert "null" not in "".join(column(docs, "document"))


def test_minimal_subgraph_keeps_root_and_its_network(spark):
    rows = [
        tx("a", [("w1", COIN)], [("shared", COIN)], src_ip="192.0.2.1", asn="AS1"),
        tx("b", [("shared", COIN)], [("w2", COIN)], src_ip="192.0.2.2", asn="AS2"),
    ]
    c = case(spark, rows)
    kept = graph.minimal_subgraph(c["pe"], c["pn"]).filter("root = 'b'")
    ends = {x for pair in column(kept, "source", "target") for x in pair}
    assert ends == {"b", "shared", "w2", "192.0.2.2", "AS2"}


def test_evidence_and_audit(spark):
    c = case(spark, chain_rows())
    hashes, rows = c["hashes"], c["evidence"]
    totals = dict(column(metrics.contribution_total(rows), "tx_id", "total"))
    assert totals == {r.tx_id: float(r.threat_score) for r in c["alerts"].collect()}
    failures = audit_graph(c["alerts"], c["pn"], c["pe"]), audit_evidence(c["alerts"], rows, hashes)
    assert [f.collect() for f in failures] == [[], []]
    summary = pipeline.audit(c["found"], c["case"]).head()
    assert tuple(summary) == ("success", 3, 3, 0)
    broken = rows.withColumn("overall_threat_score", F.col("overall_threat_score") + 1).filter("tx_id <> 'hop_3'")
    found = column(audit_evidence(c["alerts"], broken.withColumn("chain_of_custody_hash", F.lit("ff")), hashes), "tx_id", "failure")
    assert ("hop_3", "missing evidence") in found and ("hop_1", "score differs from alert") in found
    assert ("hop_2", "hash is not 64 hex digits") in found and ("hop_1", "contributions do not add up") in found
    holes = audit_graph(c["alerts"], c["pn"].filter("label <> 'ASN'"), c["pe"].filter("relationship <> 'SPENT'"))
    assert ("hop_1", "missing node labels") in column(holes, "tx_id", "failure")
    files = evidence.case_files(c["alerts"], rows, c["payload"]).filter("tx_id = 'hop_1'").head()
    assert files.n_nodes == len(files.selected_nodes) and files.attribution[0].startswith("- ")


def test_run_writes_its_tables(spark, tmp_path):
    rows = [r[:8] + ("AS1", "Tor Transit") + r[10:] for r in chain_rows()]
    out = pipeline.run_pipeline(frame(spark, rows), str(tmp_path))
    stored = read_table(spark, str(tmp_path / "alerts"))
    assert column(stored, "tx_id") == ["hop_1", "hop_2", "hop_3"]
    assert column(stored, "primary_anomaly")[0] == "Peel Chain to Exchange"
    evidence_rows = read_table(spark, str(tmp_path / "evidence"))
    assert evidence_rows.count() == 3 and out["payload"].count() == read_table(spark, str(tmp_path / "payload")).count()


def test_unflagged_is_known_without_evidence(spark):
    c = case(spark, chain_rows())
    some = c["alerts"].filter("tx_id = 'hop_1'")
    assert column(links.unflagged(c["led"].tx, some), "tx_id") == ["hop_2", "hop_3"]


def test_ranking_pages(spark):
    df = spark.createDataFrame([(f"t{i}", i % 3) for i in range(9)], "tx_id string, threat_score int").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    pages = [[r.tx_id for r in scoring.rank_alerts(df, 4, o).collect()] for o in (0, 4, 8)]
    assert sum(pages, []) == ["t2", "t5", "t8", "t1", "t4", "t7", "t0", "t3", "t6"]
    with pytest.raises(ValueError):
        scoring.rank_alerts(df, 501)


def test_bands(spark):
    got = spark.createDataFrame([(s,) for s in (49, 50, 74, 75, 89, 90)], "s int").select(scoring.risk_level(F.col("s")).alias("r"))
    assert [r.r for r in got.collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


# ---------------------------------------------------------------- ordering and models


@pytest.mark.parametrize("parts", ["1", "5"])
def test_order_helpers_match_windows(spark, parts):
    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), i, rng.randrange(10)) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sums = {r.k: r.s for r in ordering.running_sum(df, ["g", "k"], F.col("v"), "s", ["g"]).collect()}
        nexts = {r.k: r.next_k for r in ordering.neighbour_in_order(df, ["g", "k"], ["g"], ["k"]).collect()}
        prevs = {r.k: r.prev_v for r in ordering.neighbour_in_order(df, ["g", "k"], ["g"], ["v"], back=True).collect()}
        place = {r.k: r.n for r in ordering.row_number(df, ["g", "k"], "n").collect()}
        q = ordering.exact_quantile(df, "v", 0.37).head()["quantile"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    ordered = sorted(rows)
    total, last = {}, {}
    for n, (g, k, v) in enumerate(ordered, 1):
        total[g] = total.get(g, 0) + v
        assert sums[k] == total[g] and place[k] == n
        assert prevs[k] == last.get(g)
        last[g] = v
    for (g, k, _), (g2, k2, _) in zip(ordered, ordered[1:]):
        assert nexts[k] == (k2 if g == g2 else None)
    values = sorted(v for _, _, v in rows)
    at = 0.37 * (len(values) - 1)
    want = values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at))
    assert q == pytest.approx(want)


def test_edge_attributions_hold_the_best_neighbours(spark):
    rng = random.Random(4)
    owns = {f"t{i:02d}": {f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 3))} for i in range(60)}
    x = {t: rng.random() for t in owns}
    inc = spark.createDataFrame([(w, t) for t, ws in owns.items() for w in ws], "address string, tx_id string")
    feats = spark.createDataFrame(list(x.items()), "tx_id string, f double")
    near = {t: {o for o in owns if o != t and owns[o] & owns[t]} for t in owns}
    got = models.edge_attributions(inc, feats, {"f": 2.0}, feats, heavy_degree=10)
    top = graph.important_edges(got)
    chosen = {}
    for root, src, dst in column(top, "root", "src", "dst"):
        chosen.setdefault(root, set()).add((src, dst))
    for t in owns:
        d = {o: len(near[o]) + 1 for o in owns}
        ranked = sorted(near[t] | {t}, key=lambda o: (-abs(2 * x[o]) / d[o] ** 0.5 / d[t] ** 0.5, o))[:8]
        want = {(o, t) for o in ranked if o != t} | {(t, o) for o in ranked if o != t}
        assert chosen.get(t, set()) == want


def test_classifier_needs_enough_rows_and_beats_chance(spark):
    rng = random.Random(8)
    rows, edges = [], []
    for i in range(600):
        y = rng.choice([0, 0, 1, -1])
        rows.append((i, y, 1 + i % 49, rng.gauss(2.0 * max(y, 0), 1.0)))
        edges.append((i, (i + 49) % 600))
    nodes = spark.createDataFrame(rows, "txId bigint, class int, time_step int, f double")
    scored, report = models.suspicion_classifier(nodes, spark.createDataFrame(edges, "source bigint, target bigint"), ["f"])
    test = scored.filter("part = 'test'")
    areas = metrics.auc(test)
    assert areas["roc_auc"] > 0.8
    assert metrics.roc_auc(test).head()[0] == pytest.approx(areas["roc_auc"], abs=1e-6)
    assert report.count() == 5
    small = spark.createDataFrame([("a", 1)], "tx_id string, label int")
    assert not metrics.split_feasible(small).head()[0]


def test_reuse_edges_and_checks(spark):
    nodes = spark.createDataFrame(
        [(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1), (4, 1, 0, 1), (5, 1, 0, 1), (6, 2, 1, 1), (7, 2, 1, 1), (8, 2, 1, 1)],
        "txId bigint, cioh_cluster_id bigint, is_vasp_excluded_cluster int, time_step int",
    )
    edges = spark.createDataFrame([(3, 2)], "source bigint, target bigint")
    assert column(training_tables.reuse_edges(nodes, edges), "source", "target") == [(1, 2)]
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "a", 0)], "txId bigint, kind string, class int")
    hot = training_tables.one_hot(table, "kind", "asn")
    assert hot.columns == ["txId", "class", "asn_a", "asn_b"]
    assert column(hot, training_tables.un_one_hot(["asn_a", "asn_b"])) == ["asn_a", "asn_a", "asn_b"]
    with pytest.raises(ValueError):
        training_tables.assert_numeric(table)


def test_chi_square_agrees_with_the_statistics_package(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice("abc"), rng.randrange(2)) for _ in range(500)], "a string, b int")
    row = metrics.cramers_v(df, "a", "b").head()
    import math

    p = metrics.chi_square_p_value(df, "a", "b")
    assert row.dof == 2 and p == pytest.approx(math.exp(-row.chi2 / 2), abs=1e-9)
    assert row.p_value == pytest.approx(p, abs=1e-9)
    two = df.filter("a <> 'c'")
    plain = metrics.cramers_v(two, "a", "b", correction=False).head()
    assert plain.dof == 1 and plain.p_value == pytest.approx(metrics.chi_square_p_value(two, "a", "b"), abs=1e-9)
    cells = {(r.a, r.b): r.n for r in two.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}
    p, q, r, s = (cells[x, y] for x in "ab" for y in (0, 1))
    n = p + q + r + s
    want = n * max(0, abs(p * s - q * r) - n / 2) ** 2 / ((p + q) * (r + s) * (p + r) * (q + s))
    assert metrics.cramers_v(two, "a", "b").head().chi2 == pytest.approx(want)
    none = metrics.cramers_v(two.limit(0), "a", "b").head()
    assert (none.n, none.dof, none.p_value) == (0, 0, 1.0)


def test_chi_square_tail(spark):
    import math

    cases = [(k, x) for k in (1, 2, 3, 4, 5, 10, 51, 400, 3001) for x in (0.01, 0.5, 3.0, k * 0.6, k * 1.0, k * 1.5, k + 40.0)]
    got = spark.createDataFrame(cases, "k long, x double").select("k", "x", metrics.chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()

    def tail(k, x):
        """Sums of densities: closed form for whole and half steps."""
        h = x / 2
        total = math.erfc(math.sqrt(h)) if k % 2 else 0.0
        a = 0.5 if k % 2 else 0.0
        while a < k / 2:
            total += math.exp(a * math.log(h) - h - math.lgamma(a + 1)) if a + 1 <= k / 2 else 0.0
            a += 1
        return total

    for r in got:
        assert r.p == pytest.approx(tail(r.k, r.x), abs=1e-9), r
