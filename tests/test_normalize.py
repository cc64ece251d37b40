"""Field parsers against the standard library and hand-written expectations."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from coinweave.functions import normalize as N


def parse(spark, field, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", field.value.alias("value"), field.error.alias("error")).orderBy("i").collect()]


IPS = [
    "1.2.3.4", " 10.0.0.255 ", "01.2.3.4", "256.1.1.1", "1.2.3", "", "x", "::", "::1", "1::", "2001:DB8:0:0:0:0:0:1", "2001:db8::1",
    "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "0:0:1:0:0:0:0:0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1",
    "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "0001:0000:00a0:0:0:0:0:0", "g::1", "12345::", "0:1:0:1:0:1:0:1", "1:0:2:0:3:0:0:4", "::102:304", "64:ff9b::192.0.2.33",
    "64:ff9b::192.0.2.256", "1:2:3:4:5:6:1.2.3.4", "0:0:0:0:0:0:0:0", "fe80::",
]


def test_ip_matches_standard_library(spark):
    got = parse(spark, N.normalize_ip(F.col("v"), "src_ip"), IPS)
    for text, (value, error) in zip(IPS, got):
        try:
            want = str(ipaddress.ip_address(text.strip()))
        except ValueError:
            want = None
        assert value == want, text
        assert (error is None) == (want is not None), text


def test_random_ipv6_round_trip(spark):
    import random

    rng = random.Random(7)
    texts = []
    for _ in range(300):
        groups = [rng.choice([0, 0, 0, rng.randrange(65536), rng.randrange(16)]) for _ in range(8)]
        texts.append(":".join(f"{g:x}" for g in groups))
    got = parse(spark, N.normalize_ip(F.col("v")), texts)
    assert [g[0] for g in got] == [str(ipaddress.ip_address(t)) for t in texts]


@pytest.mark.parametrize(
    "text,value,error",
    [
        ("1", "illicit", None), (" Illicit ", "illicit", None), ("class-2", "licit", None), ("3", "unknown", None),
        ("UNKNOWN", "unknown", None), ("bogus", None, "label is not recognised: bogus"),
    ],
)
def test_label(spark, text, value, error):
    assert parse(spark, N.normalize_label(F.col("v")), [text]) == [(value, error)]


def test_lists(spark):
    got = parse(spark, N.parse_list(F.col("v")), ["a;b|c", " a ; ;b", '["x", "y z"]', "", None, "  ", "[broken", "single"])
    assert [g[0] for g in got] == [["a", "b", "c"], ["a", "b"], ["x", "y z"], [], [], [], [], ["single"]]
    assert got[6][1] is not None and all(g[1] is None for i, g in enumerate(got) if i != 6)


def test_amounts_are_exact_and_checked(spark):
    got = parse(
        spark, N.parse_amounts(F.col("v")),
        ["100000000000000001;100000000000000000", "[7, 8]", "5.0", "100.5", "-1", "abc", "", "99999999999999999999", "1e3"],
    )
    assert [g[0] for g in got[:3]] == [[100000000000000001, 100000000000000000], [7, 8], [5]]
    assert got[3][1].startswith("amount is not an integer")
    assert got[4][1].startswith("amount is negative")
    assert got[5][1].startswith("amount is not numeric")
    assert got[6] == ([], None)
    assert got[7][1].startswith("amount is too large")
    assert got[8][0] == [1000]


def test_ports_and_steps(spark):
    got = parse(spark, N.normalize_port(F.col("v")), ["8333", "8333.0", "70000", "8333.5", "x", None])
    assert [g[0] for g in got] == [8333, 8333, None, None, None, None]
    assert [bool(g[1]) for g in got] == [False, False, True, True, True, False]
    got = parse(spark, N.normalize_time_step(F.col("v")), ["1", "49", "0", "50", "2.5", "text"])
    assert [g[0] for g in got] == [1, 49, None, None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_are_utc_whatever_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = ["1724939100", "2024-08-29T13:45:00Z", "2024-08-29T13:45:00", "2024-08-29T15:45:00+02:00", "2024-08-29", "yesterday", "2024-08"]
        f = N.normalize_timestamp(F.col("v"))
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = [r[0] for r in df.orderBy("i").select(F.unix_seconds(f.value)).collect()]
        assert got == [1724939100] * 4 + [1724889600, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_feature_summary_ignores_recognised_columns(spark):
    df = spark.createDataFrame([("a", "9", "1", "3", "x")], "tx_id string, time_step string, f1 string, f2 string, f3 string")
    s = N.ext_feature_summary(df)
    row = df.select(*[c.alias(n) for n, c in s.items()]).head()
    assert tuple(row) == (2.0, 2.0, 1.0)


def test_surrogate_key_is_stable(spark):
    import hashlib

    row = spark.range(3).select(N.surrogate_key(F.col("id")).alias("k")).collect()
    assert [r.k for r in row] == ["txid_" + hashlib.sha256(f"coinweave:{i}".encode()).hexdigest()[:24] for i in range(3)]
