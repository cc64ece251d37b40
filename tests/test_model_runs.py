"""The model track of the run: fitted, stored, read again, explained; the rules where labels are too few."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from coinweave.operators import models, neighbours, scoring
from coinweave.operators.neighbours import gcn_propagate
from coinweave.plans import pipeline
from coinweave.sources.tables import read_table
from helpers import frame, tx


def labelled_rows():
    """Licit payments of one wallet each to the next; illicit ones split into many outputs over shared wallets."""
    rows = []
    for i in range(40):
        rows.append(tx(f"ok_{i}", [(f"a{i}", 900_000 + i)], [(f"a{i + 1}", 890_000)], at=3600 * i, label="licit"))
    for i in range(16):
        outs = [(f"m{(i + k) % 9}", 40_000 + k) for k in range(7)]
        rows.append(tx(f"bad_{i}", [(f"m{i % 9}", 300_000), (f"n{i}", 9_000)], outs, at=200_000 + 7 * i, label="illicit", asn_description="Tor Transit"))
    for i in range(6):
        rows.append(tx(f"new_{i}", [(f"u{i}", 50_000)], [(f"u{i + 1}", 30_000), (f"m{i}", 10_000)], at=400_000 + 60 * i))
    return rows


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    return out, pipeline.run_pipeline(frame(spark, labelled_rows()), out, hops=2)


def test_run_stores_model_and_explains_with_it(spark, run):
    out, found = run
    assert found["engine"] == "graph_classifier" and found["model_path"]
    stored = spark.read.parquet(f"{out}/model_runs").collect()
    assert [(r.engine, r.model_path) for r in stored] == [("graph_classifier", found["model_path"])]
    assert stored[0].validation_size >= 10 and stored[0].validation_accuracy > 0.7
    scored = {r.tx_id: r.threat_score for r in read_table(spark, f"{out}/transactions").collect()}
    assert min(scored[f"bad_{i}"] for i in range(16)) >= 50 > max(scored[f"ok_{i}"] for i in range(2, 38))
    rows = read_table(spark, f"{out}/evidence").collect()
    assert {r.tx_id for r in rows} == {t for t, s in scored.items() if s >= 50}
    for r in rows:
        assert sum(x.contribution_percentage for x in r.xai_breakdown) == scored[r.tx_id] == r.overall_threat_score
    assert {r.xai_subgraph.method for r in rows if r.tx_id.startswith("bad_")} == {"edge_weights"}
    kept = {(r.root, r.source, r.target) for r in read_table(spark, f"{out}/explained_edges").collect()}
    assert kept <= {(r.root, r.source, r.target) for r in found["page_edges"].collect()}
    (checked,) = pipeline.audit(found, found).collect()
    assert checked.status == "success" and checked.alerts_audited == len(rows)


def test_stored_model_scores_as_before(spark, run):
    _, found = run
    again = models.score_transactions(models.load_model(found["model_path"]), found["features"], found["incidence"])
    want = {r.tx_id: (r.threat_score, r.p_licit, r.p_illicit, r.p_anomalous) for r in found["scored"].collect()}
    assert {r.tx_id: (r.threat_score, r.p_licit, r.p_illicit, r.p_anomalous) for r in again.collect()} == want


def test_weights_over_columns_are_the_models_log_odds(spark, run):
    _, found = run
    columns = scoring.FEATURE_ORDER
    spread = gcn_propagate(found["incidence"], found["features"].select("tx_id", *columns), columns, 2)
    weights, constant = models.feature_weights(found["model"])
    margin = F.lit(constant)
    for name, w in weights.items():
        margin = margin + F.lit(w) * F.col(name)
    rows = found["model"].transform(spread).select(margin.alias("margin"), vector_to_array("probability").alias("p")).collect()
    assert all(abs(r.margin - math.log(r.p[1] / r.p[0])) < 1e-6 for r in rows)
    with pytest.raises(ValueError):
        models.feature_weights(found["model"], "illicit", "other")


def test_few_labels_fall_back_to_the_rules(spark, tmp_path):
    found = pipeline.run_pipeline(frame(spark, labelled_rows()[:8]), str(tmp_path), hops=1)
    assert found["engine"] == "rules" and found["model_path"] is None
    (r,) = spark.read.parquet(f"{tmp_path}/model_runs").collect()
    assert (r.engine, r.validation_size, r.model_path) == ("rules", 0.0, None)
    with pytest.raises(ValueError):
        pipeline.detect(frame(spark, labelled_rows()[:2]), engine="other")
