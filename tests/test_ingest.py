"""Reading, validating and storing transactions."""

import json

import pytest
from pyspark.sql import functions as F

from coinweave.operators import links
from coinweave.operators.ordering import with_row_index
from coinweave.sources import ingest, readers, tables
from helpers import column

HEADER = "tx_id,class,time_step,input_addresses,output_addresses,input_amounts,output_amounts,src_ip,dst_ip,src_port,dst_port"
GOOD = ["t1", "illicit", "1", "a;b", "c", "60;40", "90", "192.0.2.1", "198.51.100.1", "8333", "8333"]


def write(tmp_path, rows, header=HEADER, name="in.csv"):
    path = tmp_path / name
    path.write_text("\n".join([header, *[",".join(r) for r in rows]]) + "\n")
    return str(path)


def changed(**cells):
    return [cells.get(n, v) for n, v in zip(HEADER.split(","), GOOD)]


def load(spark, path):
    raw = readers.check_non_empty(readers.check_columns(readers.read_transactions(spark, path)))
    return ingest.normalize_transactions(raw)


def test_full_csv_is_supplied(spark, tmp_path):
    good, bad = ingest.validate(load(spark, write(tmp_path, [GOOD])))
    row = good.head()
    assert (row.tx_id, row.label, row.time_step, row.src_port) == ("t1", "illicit", 1, 8333)
    assert [tuple(x) for x in row.inputs] == [("a", 60), ("b", 40)]
    assert tuple(row.provenance) == ("elliptic_augmented", "supplied", "supplied", False)
    assert bad.isEmpty()


def test_epoch_timestamp_and_aliases(spark, tmp_path):
    header = HEADER.replace("tx_id", "txid").replace("class", "label").replace("src_ip", "source_ip") + ",time"
    good, _ = ingest.validate(load(spark, write(tmp_path, [[*GOOD, "1724939100"]], header)))
    assert good.select(F.unix_seconds("ts")).head()[0] == 1724939100


def test_large_amounts_survive_every_format(spark, tmp_path):
    cells = changed(input_addresses="a", output_addresses="c", input_amounts="100000000000000001", output_amounts="100000000000000000")
    record = dict(zip(HEADER.split(","), cells))
    native = {**record, "input_addresses": ["a"], "output_addresses": ["c"], "input_amounts": [100000000000000001], "output_amounts": [100000000000000000]}
    (tmp_path / "a.json").write_text(json.dumps([native], indent=1))
    (tmp_path / "o.json").write_text(json.dumps(native))
    (tmp_path / "l.jsonl").write_text(json.dumps(native) + "\n")
    (tmp_path / "n.ndjson").write_text(json.dumps(native) + "\n")
    paths = [write(tmp_path, [cells])] + [str(tmp_path / n) for n in ("a.json", "o.json", "l.jsonl", "n.ndjson")]
    for path in paths:
        good, _ = ingest.validate(load(spark, path))
        row = good.head()
        assert (row.inputs[0].amount_sats, row.outputs[0].amount_sats) == (100000000000000001, 100000000000000000), path


def test_json_array_with_features(spark, tmp_path):
    native = {"tx_id": "j", "class": 1, "time_step": 2, "inputs": ["a"], "outputs": ["b"], "input_amounts": [5], "output_amounts": [4], "feature_1": 4.5}
    (tmp_path / "f.json").write_text(json.dumps([native, {**native, "tx_id": "k", "class": 2}]))
    good, _ = ingest.validate(load(spark, str(tmp_path / "f.json")))
    assert column(good, "tx_id", "label", "ext_feature_mean", "ext_feature_count") == [("j", "illicit", 4.5, 1.0), ("k", "licit", 4.5, 1.0)]


def test_missing_output_amounts_are_balanced(spark, tmp_path):
    cells = changed(output_addresses="c;d;e;f", output_amounts="", input_amounts="")
    good, _ = ingest.validate(load(spark, write(tmp_path, [cells])))
    row = good.head()
    assert len(row.outputs) == 4
    assert sum(o.amount_sats for o in row.inputs) >= sum(o.amount_sats for o in row.outputs)
    assert row.provenance.ledger_layer == "synthetic" and row.provenance.semi_synthetic


BAD_CELLS = [
    ({"input_amounts": "100"}, "2 input addresses but 1 input amounts"),
    ({"output_amounts": "101"}, "outputs exceed inputs"),
    ({"class": "nonsense"}, "label is not recognised"),
    ({"time_step": "0"}, "time_step is outside"),
    ({"time_step": "50"}, "time_step is outside"),
    ({"time_step": "2.5"}, "time_step is not an integer"),
    ({"time_step": "soon"}, "time_step is not numeric"),
    ({"src_ip": "999.1.1.1"}, "src_ip is not an IP address"),
    ({"dst_ip": "host"}, "dst_ip is not an IP address"),
    ({"src_port": "70000"}, "src_port is outside"),
    ({"dst_port": "8333.5"}, "dst_port is not an integer"),
    ({"input_amounts": "60;100.5"}, "amount is not an integer"),
    ({"input_amounts": "-1;100"}, "amount is negative"),
    ({"output_amounts": "lots"}, "amount is not numeric"),
    ({"input_addresses": ""}, "no input addresses"),
]


def test_bad_rows_are_quarantined_with_reasons(spark, tmp_path):
    path = write(tmp_path, [GOOD, *[changed(tx_id=f"bad{i:02d}", **cells) for i, (cells, _) in enumerate(BAD_CELLS)]])
    good, bad = ingest.validate(load(spark, path), "quarantine")
    assert column(good, "tx_id") == ["t1"]
    reasons = dict(column(bad, "tx_id", "errors"))
    assert len(reasons) == len(BAD_CELLS)
    for i, (_, message) in enumerate(BAD_CELLS):
        assert any(message in e for e in reasons[f"bad{i:02d}"]), message


@pytest.mark.parametrize("cells,message", BAD_CELLS[:2])
def test_first_bad_row_fails_fast(spark, tmp_path, cells, message):
    path = write(tmp_path, [GOOD, changed(tx_id="t2", **cells), changed(tx_id="t3", time_step="0")])
    with pytest.raises(readers.MalformedInput, match="Row 2: .*" + message):
        ingest.validate(load(spark, path))


def test_duplicate_ids(spark, tmp_path):
    path = write(tmp_path, [GOOD, GOOD, changed(tx_id="t2")])
    with pytest.raises(readers.MalformedInput, match="Row 2: duplicate transaction id t1"):
        ingest.validate(load(spark, path))
    good, bad = ingest.validate(load(spark, path), "quarantine")
    assert column(good, "tx_id") == ["t1", "t2"] and column(bad, "row_index") == [1]


def test_unusable_files(spark, tmp_path):
    with pytest.raises(readers.MalformedInput, match="no recognised"):
        load(spark, write(tmp_path, [["1", "2"]], "foo,bar"))
    with pytest.raises(readers.MalformedInput, match="no transaction rows"):
        load(spark, write(tmp_path, []))
    with pytest.raises(readers.MalformedInput, match="only CSV"):
        readers.read_transactions(spark, str(tmp_path / "x.xlsx"))


def test_row_index_is_dense_over_partitions(spark):
    df = with_row_index(spark.range(0, 1000, 1, 7).selectExpr("id as v"), "i")
    assert df.filter("i <> v").count() == 0 and df.count() == 1000


def test_store_operations(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "tx_id string, v int, ver int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "tx_id string, v int, ver int")
    assert column(tables.upsert(old, new, "tx_id", "ver"), "tx_id", "v") == [("a", 1), ("b", 4), ("c", 5)]
    marks = spark.createDataFrame([("a", None, "note")], "tx_id string, v int, extra string")
    assert column(tables.annotate(old, marks).fillna("-").fillna(0), "tx_id", "v", "extra") == [("a", 0, "note"), ("b", 2, "-")]
    path = str(tmp_path / "feedback")
    batch = spark.createDataFrame([("7", 0.9, 1, "ann")], "tx_id string, ai_score double, human_label int, reviewed_by string")
    tables.append_feedback(batch, path)
    tables.append_feedback(batch.withColumn("human_label", F.lit(0)), path)
    assert column(tables.read_feedback(spark, path), "human_label") == [0, 1]
    with pytest.raises(ValueError, match="0 or 1"):
        tables.append_feedback(batch.withColumn("human_label", F.lit(2)), path)


def test_feedback_patches_last_label_and_reports_unknown(spark):
    nodes = spark.createDataFrame([(1, -1, 40, False), (2, 0, 3, True)], "txId bigint, class int, time_step int, is_train boolean")
    fb = spark.createDataFrame([("1", 0, 1), ("1", 1, 2), ("99", 1, 1), ("x", 1, 1)], "tx_id string, human_label int, t int").withColumn(
        "timestamp", F.timestamp_seconds("t")
    )
    patched, unknown = links.apply_feedback(nodes, fb)
    assert column(patched, "txId", "class", "is_train") == [(1, 1, True), (2, 0, True)]
    assert column(unknown, "tx_id") == ["99", "x"]


def test_prefixes_longest_match_and_fallback(spark):
    table = spark.createDataFrame(
        [("10.0.0.0/8", "A", "AS1", "one"), ("10.1.0.0/16", "B", "AS2", ""), ("10.1.2.3/32", "C", "AS3", "three"), ("0.0.0.0/0", None, "AS9", "nine")],
        "cidr string, country string, asn string, asn_description string",
    )
    tx = spark.createDataFrame([("10.9.9.9",), ("10.1.9.9",), ("10.1.2.3",), ("11.0.0.1",), ("2001:db8::1",), (None,)], "src_ip string")
    got = {r.src_ip: (r.country, r.asn, r.asn_description) for r in links.enrich_ip(tx, links.prefix_table(table)).collect()}
    assert got["10.9.9.9"] == ("A", "AS1", "one")
    assert got["10.1.9.9"] == ("B", "AS2", "Unallocated")
    assert got["10.1.2.3"] == ("C", "AS3", "three")
    assert got["11.0.0.1"] == (None, "AS9", "nine")
    assert got["2001:db8::1"] == got[None] == (None, "AS0", "Unallocated")
