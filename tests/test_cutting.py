"""Files cut into records by several tasks hold the rows that one task reads; communities settle."""

import json
import random

import pytest
from pyspark.sql import functions as F

from coinweave.operators import components
from coinweave.sources import readers
from coinweave.sources.cutting import csv_records, ends_inside, json_records, scan_json
from helpers import column


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks_in_cells(spark, tmp_path, small_blocks, end):
    rng = random.Random(3)
    cells = ["plain", "", quoted("a\nb"), quoted(f"x,{end}{end},y"), quoted('say "hi"\nthere'), quoted(""), 'in"side', quoted("1;2"), quoted("\n" * 900), "é"]
    lines = ["id,a,b"] + [f"{i},{rng.choice(cells)},{rng.choice(cells)}" for i in range(400)]
    lines.insert(7, "")
    for part in (0, 1):
        (tmp_path / f"{part}.csv").write_text(end.join(lines[:1] + lines[1 + part :: 2]) + (end if part else ""), newline="")
    path = str(tmp_path)
    got = readers.read_csv(spark, path)
    want = spark.read.csv(path, header=True, escape='"', multiLine=True, mode="FAILFAST")
    assert got.columns == ["id", "a", "b"] and rows(got.fillna("null")) == rows(want.fillna("null"))
    assert csv_records(spark, path).select("file", "start").distinct().count() > 20


def test_csv_that_never_closes_a_cell(spark, tmp_path, small_blocks):
    (tmp_path / "x.csv").write_text("a,b\n" + "1,2\n" * 500 + '3,"open\n' + "1,2\n" * 500)
    with pytest.raises(Exception, match="never closed"):
        readers.read_csv(spark, str(tmp_path)).collect()


def test_csv_of_a_header_or_nothing(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path)).columns == ["a", "b"] and readers.read_csv(spark, str(tmp_path)).isEmpty()
    (tmp_path / "x.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path)).columns == []


@pytest.mark.parametrize("indent", [None, 2])
def test_json_array(spark, tmp_path, small_blocks, indent):
    rng = random.Random(4)
    texts = ["x", 'br}ace "q" {', "a\\", "[,]", "é" * 5, "line\nbreak", "}" * 900]
    made = [{"tx_id": f"t{i}", "amounts": [rng.randrange(10**17), 5], "note": rng.choice(texts), "more": {"k": [{"z": i}], "t": rng.choice(texts)}} for i in range(300)]
    (tmp_path / "x.json").write_text(" \n" + json.dumps(made, indent=indent, ensure_ascii=False) + "\n")
    got = readers.read_json(spark, str(tmp_path))
    want = readers._exact_numbers(spark.read.json(str(tmp_path), multiLine=True, primitivesAsString=True, mode="FAILFAST"))
    assert got.columns == want.columns and rows(got.select("tx_id", "note", "more", F.to_json("amounts"))) == rows(want.select("tx_id", "note", "more", F.to_json("amounts")))
    assert json_records(spark, str(tmp_path)).select("start").distinct().count() > 20


@pytest.mark.parametrize("text, n", [('{"a": {"b": 1}}', 1), ('{"a": 1}\n', 1), ("[]", 0), ('[{"a": 1}]', 1), (' [ {"a": "}"} , {"a": "]"} ] ', 2)])
def test_small_json_files(spark, tmp_path, text, n):
    (tmp_path / "x.json").write_text(text)
    assert json_records(spark, str(tmp_path)).count() == n


@pytest.mark.parametrize("text", ['{"a": 1', '[{"a": 1}', '[{"a": 1}, 7, {"a": 2}]', '[{"a": "}'])
def test_broken_json_files(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="ends before|other than an object"):
        json_records(spark, str(tmp_path)).collect()


def test_scans_of_single_pieces():
    assert [ends_inside(x, False) for x in ['a,"b', 'a,"b"', 'a,"b""', 'a,b"c', '"a",""",', '"']] == [True, False, True, False, True, True]
    assert [ends_inside(x, True) for x in ["a", 'a"', 'a"" b', 'a","', '"x,"']] == [True, False, True, True, True]
    assert scan_json('{"a": [1, "]{"', False) == (False, 2) and scan_json('x\\" y', True) == (True, 0) and scan_json('x" , [', True) == (False, 1)


def propagate(nodes, edges):
    """Settled labels by loops, and whether some alternate."""
    near = {n: {n} for n in nodes}
    for s, t in edges:
        if s != t and s in near and t in near and nodes[s] == nodes[t]:
            near[s].add(t), near[t].add(s)
    before, label = None, {n: n for n in nodes}
    while True:
        fresh = {}
        for n, around in near.items():
            around = around if len(around) > 1 else {n}
            votes = [label[m] for m in around]
            fresh[n] = min(set(votes), key=lambda x: (-votes.count(x), x))
        if fresh == before:
            return {n: min(before[n], label[n]) for n in nodes}, before != label
        before, label = label, fresh


def test_communities_settle(spark):
    alternating = 0
    rng = random.Random(8)
    graphs = []
    for g in range(25):
        nodes = {g * 1000 + i: 1 + i % 2 for i in range(14)}
        edges = [(g * 1000 + rng.randrange(14), g * 1000 + rng.randrange(14)) for _ in range(rng.randrange(10, 24))]
        graphs.append((nodes, edges))
    for seed in (8, 9, 11, 19, 20):  # links between two halves: labels may swap for ever
        part, base = random.Random(seed), 50_000 + 1000 * seed
        n = part.randrange(6, 40)
        order = list(range(n))
        part.shuffle(order)
        links = [(base + order[part.randrange(n // 2)], base + order[n // 2 + part.randrange(n - n // 2)]) for _ in range(part.randrange(n, 4 * n))]
        graphs.append(({base + i: 1 for i in range(n)}, links))
    star = {90_000 + i: 1 for i in range(60)}
    graphs.append((star, [(90_059, x) for x in star]))
    want = {}
    for nodes, edges in graphs:
        labels, moves = propagate(nodes, edges)
        want |= labels
        alternating += moves
    nodes = spark.createDataFrame([(n, s) for g, _ in graphs for n, s in g.items()], "txId bigint, time_step int")
    edges = spark.createDataFrame([e for _, x in graphs for e in x], "source bigint, target bigint")
    got = components.communities(nodes, edges)
    assert {(r.txId, r.time_step): r.label for r in got.collect()} == {(n, s): want[n] for g, _ in graphs for n, s in g.items()}
    assert alternating and got.columns == ["txId", "time_step", "label"]
    assert column(components.communities(nodes.limit(0), edges.limit(0)), "txId") == []
