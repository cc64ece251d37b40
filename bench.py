"""Headline queries at one scale, one JSON line on stdout.

Every query is timed from reading its tables to a complete result (written to a no-op sink). Derived
tables that several queries share are built once per session; their build is timed as its own entry.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from coinweave.plans import ledgers, load_catalog
from coinweave.session import build_session

HEADLINE = [
    "j2_latest_receipt", "j4_tx_children", "j5_tx_neighbors", "j7_enrich_ip", "g3_entities", "g5_change_output", "g10_degree_centrality",
    "g11_neighbor_illicit_ratio", "g16_rapid_context", "m1_rule_score", "w1_rank_alerts", "e2_contributions", "g18_n_hop",
    "e5_custody_hash", "g20_minimal_subgraph", "q3_audit_summary", "n11_validate_quarantine", "g23_communities", "g27_reuse_edges",
    "a6_cramers_v", "a8_quantile", "g31_mean_neighbor_features", "g32_gcn_propagate", "m6_suspicion_classifier",
]
BUILDS = ["event_base", "event_transactions", "event_ledger", "order_ledger", "event_latest", "event_peel", "event_features", "event_graph", "order_graph"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_catalog()
    # Start the JVM's readers and code generator on the smallest scale before anything is timed.
    warm = Path(sf_dir).parent / "sf0.001"
    if warm.exists():
        queries["w1_rank_alerts"](spark, str(warm)).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in BUILDS:
        start = time.perf_counter()
        getattr(ledgers, name)(spark, sf_dir)
        timings[f"build_{name}"] = round(time.perf_counter() - start, 3)
    only = os.environ.get("BENCH_QUERIES")
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": cpus}))


if __name__ == "__main__":
    main()
