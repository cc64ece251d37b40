"""Hand-made transactions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

START = datetime(2024, 8, 29, tzinfo=timezone.utc)
SIDE = "array<struct<address: string, amount_sats: bigint>>"
SCHEMA = (
    "tx_id string, label string, ts timestamp, time_step int, src_ip string, dst_ip string, src_port int, dst_port int, "
    f"asn string, asn_description string, country string, inputs {SIDE}, outputs {SIDE}, parent_tx_ids array<string>, "
    "exchange_addresses array<string>"
)


def tx(tx_id, ins, outs, at=0.0, label="unknown", exchanges=(), parents=(), asn="AS1", asn_description="Example", src_ip="192.0.2.1"):
    side = lambda rows: [(a, int(m)) for a, m in rows]
    return (
        tx_id, label, START + timedelta(seconds=at), 1, src_ip, "198.51.100.1", 8333, 8333, asn, asn_description, "US",
        side(ins), side(outs), list(parents), list(exchanges),
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def column(df, *names):
    rows = df.select(*names).collect()
    return sorted(r[0] if len(names) == 1 else tuple(r) for r in rows)
