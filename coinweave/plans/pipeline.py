"""The whole run, from typed transactions to stored alerts, evidence and subgraphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coinweave.operators import components, evidence, graph, heuristics, ledger, links, models, neighbours, scoring
from coinweave.operators.audit import audit_evidence, audit_graph, audit_summary
from coinweave.operators.peel import PEEL_DELTA_SECONDS, peel_chains
from coinweave.session import materialize
from coinweave.sources.tables import replace_table


def graph_size(led: ledger.Ledger) -> int:
    """Number of nodes of the evidence graph, without building it."""
    parts = [led.tx.select(F.col("tx_id").alias("id"))]
    parts += [t.select(F.col("address").alias("id")) for t in (led.spends, led.receipts)]
    parts += [led.tx.select(F.col(c).alias("id")).filter(F.col(c).isNotNull()) for c in ("src_ip", "asn")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.distinct().count()


def detect(
    tx: DataFrame, peel_seconds: int = PEEL_DELTA_SECONDS, fan_seconds: int = heuristics.FAN_DELTA_SECONDS,
    label_bonus: bool = True, engine: str = "rules",
) -> dict:
    """Ledger, patterns, features, scores and alerts of enriched transactions; every stage that several
    later ones read is written once. ``engine`` "model" scores with the graph classifier where the labels allow a hold-out
    and with the rules where they do not; "rules" always with the rules."""
    if engine not in ("model", "rules"):
        raise ValueError(f"engine is model or rules: {engine}")
    led = ledger.from_transactions(materialize(ledger.link_parents(tx), "tx")).materialized()
    latest = materialize(ledger.latest_receipt(led.receipts), "latest")
    peel = materialize(peel_chains(led, latest, peel_seconds), "peel")
    inc = neighbours.incidence(led.spends, led.receipts)
    features = materialize(
        scoring.feature_vector(
            led, latest, neighbours.neighbour_illicit_ratio(inc, led.tx), peel,
            heuristics.fan_patterns(led, latest, fan_seconds), graph_size(led),
        ),
        "features",
    )
    held, used, model = {}, "rules", None
    if engine == "model":
        scored, held, used, model = models.classify(features, inc, label_bonus=label_bonus)
        scored = materialize(scored, "scored")
    else:
        scored = scoring.rule_score(features, label_bonus)
    return dict(
        wanted=engine, engine=used, validation=held, model=model,
        ledger=led, latest=latest, peel=peel, incidence=inc, features=features, scored=scored,
        alerts=materialize(scoring.alerts(scored), "alerts"),
    )


def investigate(
    found: dict, roots: DataFrame | None = None, hops: int = graph.DEFAULT_HOPS
) -> dict:
    """Evidence graph, subgraphs, custody hashes, evidence rows and audit for ``roots`` (default: all alerts)."""
    led, alerts = found["ledger"], found["alerts"]
    chosen = alerts if roots is None else alerts.join(roots.select("tx_id"), "tx_id", "left_semi")
    chosen = materialize(chosen, "chosen")
    entities = materialize(components.entities(led.spends, led.receipts), "entities")
    nodes = materialize(links.annotate_nodes(graph.build_nodes(led, entities, found["peel"]), alerts), "nodes")
    edges = materialize(graph.build_edges(led), "edges")
    reached = materialize(graph.n_hop(nodes, edges, chosen, hops), "reached")
    payload = materialize(graph.subgraph_payload(nodes, edges, reached), "payload")
    hashes = materialize(evidence.custody_hash(payload, chosen), "hashes")
    page_nodes = materialize(graph.subgraph_nodes(nodes, reached), "page_nodes")
    page_edges = materialize(graph.subgraph_edges(edges, reached), "page_edges")
    kept = materialize(graph.explained_subgraph(page_edges, page_nodes, _important(found, chosen)), "kept")
    # The surrogate explains the scores where it can be fitted; otherwise the rules' own terms do.
    attributions = models.surrogate_attributions(found["scored"]) if found["wanted"] == "model" else None
    explained = evidence.explain(found["scored"].join(chosen.select("tx_id"), "tx_id", "left_semi"), attributions)
    rows = materialize(evidence.evidence(explained, hashes, kept), "evidence")
    return dict(
        entities=entities, nodes=nodes, edges=edges, reached=reached, payload=payload, hashes=hashes, evidence=rows,
        page_nodes=page_nodes, page_edges=page_edges, kept=kept, roots=chosen,
    )


def _important(found: dict, roots: DataFrame) -> DataFrame:
    """(root, src, dst) of the edges that weigh most in the fitted model; none with the rules."""
    if found["model"] is None:
        return roots.sparkSession.createDataFrame([], "root string, src string, dst string")
    weights = models.fitted_edge_attributions(found["model"], found["incidence"], found["features"], roots)
    return materialize(graph.important_edges(weights), "important")


def audit(found: dict, case: dict) -> DataFrame:
    hashes = evidence.custody_hash(case["payload"], case["roots"])
    return audit_summary(
        found["ledger"].tx, case["roots"],
        audit_graph(case["roots"], case["page_nodes"], case["page_edges"]),
        audit_evidence(case["roots"], case["evidence"], hashes),
    )


def run_pipeline(tx: DataFrame, out_dir: str, engine: str = "model", **options) -> dict:
    """Run everything and store the next version of ``alerts``, ``evidence``, ``explained_edges``, ``payload`` and ``transactions``
    (``tables.read_table`` reads the newest). The run is added to ``model_runs`` and its model, if one was
    fitted, stored under ``models``, where ``models.load_model`` reads it to score other transactions."""
    found = detect(tx, engine=engine, **{k: options[k] for k in ("peel_seconds", "fan_seconds", "label_bonus") if k in options})
    case = investigate(found, **{k: options[k] for k in ("roots", "hops") if k in options})
    model_path = None
    if found["model"] is not None:
        model_path = f"{out_dir}/models/{uuid.uuid4().hex}"
        models.save_model(found["model"], model_path)
    run = scoring.model_run(tx.sparkSession, found["engine"], found["validation"])
    run.withColumn("model_path", F.lit(model_path).cast("string")).write.mode("append").parquet(f"{out_dir}/model_runs")
    replace_table(found["scored"], f"{out_dir}/transactions")
    replace_table(found["alerts"], f"{out_dir}/alerts")
    replace_table(case["evidence"], f"{out_dir}/evidence")
    replace_table(case["kept"], f"{out_dir}/explained_edges")
    replace_table(case["payload"], f"{out_dir}/payload")
    return {**found, **case, "model_path": model_path}
