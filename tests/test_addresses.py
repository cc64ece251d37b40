"""Addresses of both families: standard text, 16-byte keys, prefixes."""

import ipaddress
import random

from coinweave.functions import normalize as N
from coinweave.operators import links
from pyspark.sql import functions as F

ODD = [
    "::", "::1", "2001:DB8::0001", "1:0:0:2:0:0:0:3", "::ffff:1.2.3.4", "::FFFF:102:304", "::1.2.3.4", "fe80::1%Eth0", "fe80::1%", "fe80::1%a%b",
    "fe80::1%a/b", "1.2.3.4%eth0", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "12345::", "g::1", "1.2.3.4", "256.1.1.1", "", "x", "::ffff:1.2.3.256",
    "::ffff:0:0", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "0:0:0:0:0:ffff:10.0.0.1%x",
]


def standard(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_standard_text_and_keys_of_both_families(spark):
    got = spark.createDataFrame([(x,) for x in ODD], "ip string").select("ip", N.ip_value(F.col("ip")).alias("text"), N.ip_key(F.col("ip")).alias("key")).collect()
    assert len(got) == len(ODD)
    for r in got:
        want = standard(r.ip)
        assert (r.text is None) == (r.key is None) == (want is None), r.ip
        if want is not None:
            mapped = getattr(want, "ipv4_mapped", None)
            text = f"::ffff:{mapped}" + (f"%{want.scope_id}" if want.scope_id else "") if mapped else str(want)
            assert r.text == text
            number = int(want) + (0xFFFF << 32 if want.version == 4 else 0)
            assert ((r.key.high % (1 << 64)) << 64) + r.key.low % (1 << 64) == number, r.ip


def test_prefixes_of_both_families_against_brute_force(spark):
    rng = random.Random(4)
    pool = [rng.getrandbits(128) for _ in range(6)] + [0xFFFF << 32 | rng.getrandbits(32) for _ in range(3)]
    table, ips = [("::/0", "X0", None, None), ("0.0.0.0/0", None, "AS4", "four"), ("bad/8", "B", None, None), ("1.2.3.4/33", "B", None, None), ("::/129", "B", None, None)], []
    for i in range(60):
        base, bits = rng.choice(pool), rng.choice([8, 16, 31, 32, 33, 48, 63, 64, 65, 96, 104, 120, 128])
        if base >> 32 == 0xFFFF and rng.random() < 0.7:
            text, bits = str(ipaddress.IPv4Address(base & 0xFFFFFFFF)), rng.randrange(33)
        else:
            text = str(ipaddress.IPv6Address(base))
        table.append((f"{text}/{bits}", rng.choice([None, f"C{i}"]), rng.choice([None, f"AS{i}"]), f"d{i}"))
    for i in range(120):
        near = rng.choice(pool) ^ rng.getrandbits(rng.choice([1, 8, 24, 32, 64]))
        ips.append(str(ipaddress.IPv4Address(near & 0xFFFFFFFF)) if near >> 32 == 0xFFFF and i % 2 else str(ipaddress.IPv6Address(near)))
    place = lambda a: int(a) + (0xFFFF << 32 if a.version == 4 else 0)
    nets = []
    for cidr, country, asn, text in table:
        try:
            net = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            continue
        nets.append((place(net.network_address), net.prefixlen + (96 if net.version == 4 else 0), country, asn, text))
    want = {}
    for ip in set(ips):
        x = place(ipaddress.ip_address(ip))
        hits = [n for n in nets if x >> (128 - n[1]) == n[0] >> (128 - n[1]) and (x >> 32 != 0xFFFF or n[1] >= 96)]
        country = max(((n[1], n[2]) for n in hits if n[2]), default=(0, None))[1]
        system = max(((n[1], n[3], n[4]) for n in hits if n[3]), default=(0, None, None))[1:]
        if hits:
            want[ip] = (country, *system)
    prefixes = links.prefix_table(spark.createDataFrame(table, "cidr string, country string, asn string, asn_description string"))
    got = links.match_prefixes(spark.createDataFrame([(x,) for x in set(ips)] + [("no address",), (None,)], "ip string"), prefixes).collect()
    assert {r.ip: (r.country, r.asn, r.asn_description) for r in got} == want
