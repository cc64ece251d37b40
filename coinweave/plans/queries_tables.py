"""Queries over raw text and engineered tables: sources, normalisation, clusters, metrics, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from coinweave.functions import normalize as N
from coinweave.operators import components, links, metrics, models, training_tables
from coinweave.operators.ordering import row_number
from coinweave.plans import ledgers as L
from coinweave.plans import queries_ledger as Q
from coinweave.plans.catalog import query, with_
from coinweave.session import materialize, memo, scratch_path
from coinweave.sources import ingest, readers, tables

us = F.unix_micros
RAW = "rw AS (" + L.RAW_TEXT.format(source="e") + ")"
CHUNK = 1_000

# ---------------------------------------------------------------- sources and sinks


def _text_columns(df):
    return df.select("txId", "class", "inputs", "outputs", "input_satoshis", "src_port")


RAW_ROWS = with_(L.E, RAW, select='SELECT txId, class, inputs, outputs, input_satoshis, src_port FROM rw')


def _csv_path(spark, d):
    def build():
        path = scratch_path(spark, "raw") + ".csv"
        L.raw_events(spark, d).write.csv(
            path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        )
        return path

    return memo(spark, ("csv", d), build)


def _ndjson_path(spark, d):
    def build():
        path = scratch_path(spark, "raw") + ".ndjson"
        L.raw_events(spark, d).write.json(path)
        return path

    return memo(spark, ("ndjson", d), build)


def _json_path(spark, d):
    """JSON array files: one array of at most ``CHUNK`` consecutive events per file."""

    def build():
        path = scratch_path(spark, "raw") + ".json"
        doc = F.to_json(F.struct(*L.raw_events(spark, d).columns))
        chunk = F.floor(F.col("event_id") / CHUNK).cast("bigint")
        arrays = L.raw_events(spark, d).groupBy(chunk.alias("chunk")).agg(
            F.concat(F.lit("["), F.array_join(F.collect_list(doc), ","), F.lit("]")).alias("value")
        )
        arrays.repartition("chunk").write.partitionBy("chunk").text(path)
        return path

    return memo(spark, ("json", d), build)


@query("s1_read_csv", RAW_ROWS)
def _(spark, d):
    read = readers.read_csv(spark, _csv_path(spark, d))
    return _text_columns(read)


@query("s2_read_json", RAW_ROWS)
def _(spark, d):
    return _text_columns(readers.read_json(spark, _json_path(spark, d)))


@query("s3_read_ndjson", RAW_ROWS)
def _(spark, d):
    return _text_columns(readers.read_ndjson(spark, _ndjson_path(spark, d)))


@query("s4_read_transactions", with_(L.E, RAW, select="SELECT f AS suffix, count(*) AS n, count(DISTINCT txId) AS n_ids, min(inputs) AS lo, max(outputs) AS hi FROM rw, (VALUES ('csv'), ('json'), ('ndjson')) t(f) GROUP BY 1"))
def _(spark, d):
    out = None
    for suffix, path in (("csv", _csv_path), ("json", _json_path), ("ndjson", _ndjson_path)):
        one = readers.read_transactions(spark, path(spark, d)).agg(
            F.count("*").alias("n"), F.countDistinct("txId").alias("n_ids"), F.min("inputs").alias("lo"), F.max("outputs").alias("hi")
        ).select(F.lit(suffix).alias("suffix"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@query("s5_read_elliptic", with_(L.V, select="""SELECT n.txId, n.time_step, n.class, n.feat_1, n.feat_2, count(e.source) AS n_out
  FROM vn n LEFT JOIN ve e ON e.source = n.txId GROUP BY ALL"""))
def _(spark, d):
    """The order tables written in the public dataset's file layout and read back."""

    def build():
        base = scratch_path(spark, "elliptic")
        nodes, edges = L.order_graph(spark, d)
        nodes.select("txId", "time_step", "feat_1", "feat_2").write.csv(f"{base}/features")
        text = F.when(F.col("class") == 1, "1").when(F.col("class") == 0, "2").otherwise("unknown")
        nodes.select("txId", text.alias("class")).write.csv(f"{base}/classes", header=True)
        edges.select(F.col("source").alias("txId1"), F.col("target").alias("txId2")).write.csv(f"{base}/edges", header=True)
        return base

    base = memo(spark, ("elliptic", d), build)
    features, classes, edges = readers.read_elliptic(spark, f"{base}/features", f"{base}/classes", f"{base}/edges")
    out = edges.groupBy(F.col("source").alias("txId")).agg(F.count("*").alias("n_out"))
    joined = links.attach_classes(features, classes).join(out, "txId", "left")
    return joined.select("txId", "time_step", F.col("class").cast("int").alias("class"), "feat_1", "feat_2", F.coalesce("n_out", F.lit(0)).alias("n_out"))


@query("s6_upsert", with_(L.E, select="SELECT tx_id, CASE WHEN event_type = 'signup' THEN 'reviewed' ELSE label END AS label, us AS ts_us FROM e"))
def _(spark, d):
    """Signup transactions arrive again, twice, on top of a stored table that has them already: the last row stays."""
    b = L.event_base(spark, d)
    path = scratch_path(spark, "upserted")
    tables.replace_table(b.select("tx_id", "label", "ts"), path)
    again = lambda label: b.filter("event_type = 'signup'").select("tx_id", F.lit(label).alias("label"), "ts")
    tables.upsert_table(path, again("waiting").union(again("reviewed")), "tx_id")
    return tables.read_table(spark, path).select("tx_id", "label", us("ts").alias("ts_us"))


@query("s7_replace_table", Q.ALERT_SQL)
def _(spark, d):
    path = scratch_path(spark, "alerts")
    a = Q.alerts(spark, d)
    tables.replace_table(a.withColumn("threat_score", F.lit(0)), path)
    tables.replace_table(a, path)
    back = tables.read_table(spark, path)
    tables.replace_table(back.withColumn("threat_score", F.col("threat_score") + 0), path)  # the table it reads
    return tables.read_table(spark, path).select("tx_id", "threat_score", us("ts").alias("ts_us"), "primary_anomaly", "risk_level")


@query("s8_annotate", with_(*L.ALERTS_E, select="SELECT e.tx_id, CASE WHEN al.tx_id IS NULL THEN e.label ELSE al.primary_anomaly END AS label, al.threat_score FROM e LEFT JOIN al USING (tx_id)"))
def _(spark, d):
    notes = Q.alerts(spark, d).select("tx_id", F.col("primary_anomaly").alias("label"), "threat_score")
    path = scratch_path(spark, "annotated")
    tables.replace_table(L.event_base(spark, d).select("tx_id", "label"), path)
    tables.annotate_table(path, notes)
    return tables.read_table(spark, path)


@query("s9_scan_ordered", with_(L.E, select="SELECT tx_id, row_number() OVER (ORDER BY us, tx_id) AS place FROM e"))
def _(spark, d):
    """The place of every row in the ordered scan, numbered in blocks."""
    return row_number(L.event_base(spark, d).select("tx_id", "ts"), ["ts", "tx_id"], "place").select("tx_id", "place")


@query("s10_lookup", with_(L.E, select="SELECT tx_id, label, in_addr, us AS ts_us FROM e WHERE tx_id = 'tx_77'"))
def _(spark, d):
    return tables.lookup(L.event_base(spark, d), "tx_77").select("tx_id", "label", "in_addr", us("ts").alias("ts_us"))


def feedback(spark, d):
    """Reviews: errors are confirmed, purchases are cleared."""

    def build():
        path = scratch_path(spark, "feedback")
        b = L.event_base(spark, d)
        for label, kind in ((1, "error"), (0, "purchase")):
            batch = b.filter(F.col("event_type") == kind).select(
                F.col("event_id").cast("string").alias("tx_id"), F.lit(0.5).alias("ai_score"), F.lit(label).alias("human_label"), F.lit("analyst").alias("reviewed_by")
            )
            tables.append_feedback(batch, path)
        return path

    return tables.read_feedback(spark, memo(spark, ("feedback", d), build))


@query("s11_append_feedback", "SELECT CAST(event_id AS VARCHAR) AS tx_id, 0.5::DOUBLE AS ai_score, CAST(event_type = 'error' AS INT) AS human_label, 'analyst' AS reviewed_by FROM events WHERE event_type IN ('error', 'purchase')")
def _(spark, d):
    return feedback(spark, d).select("tx_id", "ai_score", "human_label", "reviewed_by")


@query("s12_write_nodes_edges", with_(L.V, select="SELECT 'nodes' AS file, count(*) AS n, CAST(sum(txId) AS BIGINT) AS total FROM vn UNION ALL SELECT 'edges', count(*), CAST(sum(source + target) AS BIGINT) FROM ve"))
def _(spark, d):
    base = scratch_path(spark, "engineered")
    nodes, edges = L.order_graph(spark, d)
    tables.write_nodes_edges(nodes, edges, base)
    n = spark.read.csv(f"{base}/nodes.csv", header=True)
    e = spark.read.csv(f"{base}/edges.csv", header=True)
    return n.agg(F.count("*").alias("n"), F.sum(F.col("txId").cast("bigint")).alias("total")).select(F.lit("nodes").alias("file"), "*").unionAll(
        e.agg(F.count("*").alias("n"), F.sum(F.col("source").cast("bigint") + F.col("target").cast("bigint")).alias("total")).select(F.lit("edges").alias("file"), "*")
    )


@query("s13_add_missing_columns", with_(L.E, select="SELECT tx_id, label, CAST(NULL AS INT) AS threat_score, CAST(NULL AS VARCHAR) AS risk_level FROM e"))
def _(spark, d):
    wanted = Q.alerts(spark, d).select("tx_id", "threat_score", "risk_level").schema
    return tables.add_missing_columns(L.event_base(spark, d).select("tx_id", "label"), wanted)


@query("s14_feature_columns", with_(L.V, select="SELECT f AS feature, count(v) AS n FROM (SELECT unnest(['feat_1', 'feat_2', 'priority']) AS f, unnest([CAST(feat_1 AS VARCHAR), CAST(feat_2 AS VARCHAR), priority]) AS v FROM vn) GROUP BY 1"))
def _(spark, d):
    nodes, _ = L.order_graph(spark, d)
    cols = tables.feature_columns(nodes)
    return nodes.select(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "feature", "n")


# ---------------------------------------------------------------- normalisation


def _raw(spark, d):
    return L.raw_events(spark, d)


def _typed(spark, d):
    return memo(spark, ("typed", d), lambda: materialize(ingest.normalize_transactions(_raw(spark, d), "event_id"), "typed"))


@query("n1_first_present", with_(L.E, RAW, select="SELECT txId, coalesce(nullif(parent_tx_id, ''), nullif(output_satoshis, ''), 'none') AS first FROM rw"))
def _(spark, d):
    r = _raw(spark, d)
    return r.select("txId", N.first_present(r, ["absent", "parent_tx_id", "output_satoshis"], F.lit("none")).alias("first"))


@query("n2_normalize_label", with_(L.E, RAW, select="""SELECT txId, CASE WHEN event_id % 101 = 3 THEN NULL ELSE label END AS label, CASE WHEN event_id % 101 = 3 THEN 'label is not recognised: bogus' END AS error
  FROM rw JOIN e USING (event_id)"""))
def _(spark, d):
    f = N.normalize_label(F.col("class"))
    return _raw(spark, d).select("txId", f.value.alias("label"), f.error.alias("error"))


@query("n3_parse_list", with_(L.E, select="SELECT tx_id AS \"txId\", 2 AS n, pay_addr AS first, chg_addr AS last FROM e"))
def _(spark, d):
    f = N.parse_list(F.col("outputs"))
    return _raw(spark, d).select("txId", F.size(f.value).alias("n"), F.get(f.value, F.lit(0)).alias("first"), F.element_at(f.value, -1).alias("last"))


@query("n4_parse_amounts", with_(L.E, select="""SELECT tx_id AS "txId", CASE WHEN event_id % 107 = 2 THEN 1 WHEN event_id % 107 = 3 THEN NULL WHEN event_id % 107 = 4 THEN 100 WHEN event_id % 107 = 5 THEN -1 WHEN event_id % 107 = 6 THEN 1 ELSE in_amt END AS first,
  CASE event_id % 107 WHEN 3 THEN 'amount is not numeric: abc' WHEN 4 THEN 'amount is not an integer: 100.5' WHEN 5 THEN 'amount is negative: -1' END AS error FROM e"""))
def _(spark, d):
    f = N.parse_amounts(F.col("input_satoshis"))
    return _raw(spark, d).select("txId", F.get(f.value, F.lit(0)).alias("first"), f.error.alias("error"))


@query("n5_normalize_ip", with_(L.E, select="""SELECT tx_id AS "txId", CASE WHEN event_id % 109 <> 4 THEN src_ip END AS ip, CASE WHEN event_id % 109 = 4 THEN 'src_ip is not an IP address: 10.0.0.256' END AS error,
  '2001:db8::' || lower(printf('%x', event_id % 65535 + 1)) AS ip6 FROM e"""))
def _(spark, d):
    f = N.normalize_ip(F.col("source_ip"), "src_ip")
    six = F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(F.col("event_id") % 65535 + 1))
    return _raw(spark, d).select("txId", f.value.alias("ip"), f.error.alias("error"), N.normalize_ip(six).value.alias("ip6"))


@query("n6_normalize_port", with_(L.E, select="""SELECT tx_id AS "txId", CASE WHEN event_id % 113 NOT IN (9, 10) THEN src_port END AS port,
  CASE event_id % 113 WHEN 9 THEN 'src_port is outside 0-65535: 70000' WHEN 10 THEN 'src_port is not an integer: 8333.5' END AS error FROM e"""))
def _(spark, d):
    f = N.normalize_port(F.col("src_port"), "src_port")
    return _raw(spark, d).select("txId", f.value.alias("port"), f.error.alias("error"))


@query("n7_normalize_timestamp", with_(L.E, select="""SELECT tx_id AS "txId", CASE WHEN event_id % 127 = 1 OR event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN round(us / 100000.0) ELSE 17041646450 END::BIGINT AS tenths,
  CASE WHEN event_id % 127 = 1 THEN 'timestamp is not readable: yesterday' END AS error FROM e"""))
def _(spark, d):
    f = N.normalize_timestamp(F.col("time"))
    return _raw(spark, d).select("txId", F.round(us(f.value) / 100_000.0).cast("bigint").alias("tenths"), f.error.alias("error"))


STEP_SQL = """CASE WHEN event_id % 103 IN (5, 6, 7) THEN NULL WHEN event_id % 103 = 8 THEN {none} ELSE time_step END"""


@query("n8_normalize_time_step", with_(L.E, select=f"""SELECT tx_id AS "txId", CAST({STEP_SQL.format(none='NULL')} AS INT) AS time_step,
  CASE event_id % 103 WHEN 5 THEN 'time_step is outside 1-49: 50' WHEN 6 THEN 'time_step is not an integer: 2.5' WHEN 7 THEN 'time_step is not numeric: x' END AS error FROM e"""))
def _(spark, d):
    f = N.normalize_time_step(F.col("time_step"))
    return _raw(spark, d).select("txId", f.value.alias("time_step"), f.error.alias("error"))


@query("n9_ext_feature_summary", with_(L.E, select="""SELECT tx_id, CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS DOUBLE) AS n, CASE WHEN event_id % 3 = 0 THEN event_id % 10 ELSE (event_id % 10 + 2.5::DOUBLE) / 2 END AS mean,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE abs(event_id % 10 - 2.5::DOUBLE) / 2 END AS std FROM e"""))
def _(spark, d):
    t = _typed(spark, d)
    return t.select("tx_id", F.col("ext_feature_count").alias("n"), F.col("ext_feature_mean").alias("mean"), F.col("ext_feature_std").alias("std"))


@query("n10_check_columns", with_(L.E, select="SELECT count(*) AS n FROM e"))
def _(spark, d):
    return readers.check_non_empty(readers.check_columns(_raw(spark, d))).agg(F.count("*").alias("n"))


ERRORS_SQL = """er AS (SELECT tx_id, event_id, in_amt, pay_amt, time_step, list_filter([
  CASE event_id % 103 WHEN 5 THEN 'time_step is outside 1-49: 50' WHEN 6 THEN 'time_step is not an integer: 2.5' WHEN 7 THEN 'time_step is not numeric: x' END,
  CASE WHEN event_id % 101 = 3 THEN 'label is not recognised: bogus' END,
  CASE event_id % 107 WHEN 3 THEN 'amount is not numeric: abc' WHEN 4 THEN 'amount is not an integer: 100.5' WHEN 5 THEN 'amount is negative: -1' END,
  CASE WHEN event_id % 107 = 2 THEN '1 input addresses but 2 input amounts' END,
  CASE WHEN event_id % 107 IN (2, 6, 4, 5) AND (event_id % 7 <> 0 OR event_id % 107 <> 4 OR true) THEN 'outputs exceed inputs' END,
  CASE WHEN event_id % 109 = 4 THEN 'src_ip is not an IP address: 10.0.0.256' END,
  CASE event_id % 113 WHEN 9 THEN 'src_port is outside 0-65535: 70000' WHEN 10 THEN 'src_port is not an integer: 8333.5' END,
  CASE WHEN event_id % 127 = 1 THEN 'timestamp is not readable: yesterday' END], lambda x: x IS NOT NULL) AS errors FROM e)"""


@query("n11_validate_quarantine", with_(L.E, ERRORS_SQL, select="""SELECT tx_id, array_to_string(list_filter(errors, lambda x: x <> 'outputs exceed inputs'), '; ') AS errors FROM er
  WHERE len(list_filter(errors, lambda x: x <> 'outputs exceed inputs')) > 0 OR event_id % 107 = 6"""))
def _(spark, d):
    """Quarantined rows and every reason except the balance rule, which has its own query."""
    _, bad = ingest.validate(ingest.normalize_transactions(_raw(spark, d), "event_id"), "quarantine")
    return bad.select("tx_id", F.array_join(F.filter("errors", lambda e: e != "outputs exceed inputs"), "; ").alias("errors"))


@query("n11_balance_rule", with_(L.E, select="""SELECT tx_id FROM (SELECT tx_id, event_id,
  CASE event_id % 107 WHEN 2 THEN 3 WHEN 3 THEN NULL WHEN 4 THEN 100 WHEN 5 THEN -1 WHEN 6 THEN 1 ELSE in_amt END AS total_in,
  CASE WHEN event_id % 7 <> 0 THEN in_amt - 15000 WHEN event_id % 107 IN (2, 4, 5, 6) THEN 2 END AS total_out FROM e) WHERE total_in < total_out"""))
def _(spark, d):
    return _typed(spark, d).filter(F.array_contains("errors", "outputs exceed inputs")).select("tx_id")


@query("n11_duplicates", with_(L.E, select="SELECT tx_id, event_id + 1000000 AS row_index FROM e WHERE event_type = 'signup'"))
def _(spark, d):
    """Signup rows appear twice; the later copy of each is reported."""
    t = _typed(spark, d).select("row_index", "tx_id", F.array().cast("array<string>").alias("errors"))
    ids = L.event_base(spark, d).filter("event_type = 'signup'").select("tx_id")
    again = t.join(ids, "tx_id", "left_semi").select((F.col("row_index") + 1_000_000).alias("row_index"), "tx_id", "errors")
    return ingest.flag_duplicates(t.unionByName(again)).filter("size(errors) > 0").select("tx_id", "row_index")


@query("n12_impute_amounts", with_(L.E, """im AS (SELECT tx_id, 120000000 + (event_id % 500) * 2000000 AS tot, 8000000 + (event_id % 3) * 50000 AS cap FROM e)""",
  select="SELECT tx_id, tot // 3 AS input, least(cap, (tot // 3 * 3 - 15000) // 4) AS payment, tot // 3 * 3 - 3 * least(cap, (tot // 3 * 3 - 15000) // 4) - 15000 AS change, tot // 3 * 3 - 10000 AS single FROM im"))
def _(spark, d):
    """Three inputs and four outputs (or one) without any amount."""
    i = F.col("event_id")
    nothing = F.array().cast("array<bigint>")
    three, four, one = (F.array(*[F.lit(f"a{k}") for k in range(n)]) for n in (3, 4, 1))
    base = L.event_base(spark, d).select("tx_id", "event_id", N.impute_inputs(nothing, three, i).alias("ins"))
    outs = N.impute_outputs(nothing, four, F.col("ins"), i)
    return base.select(
        "tx_id", F.get("ins", F.lit(0)).alias("input"), F.get(outs, F.lit(0)).alias("payment"), F.element_at(outs, -1).alias("change"),
        F.get(N.impute_outputs(nothing, one, F.col("ins"), i), F.lit(0)).alias("single"),
    )


@query("n13_provenance", with_(L.E, select="""SELECT CASE WHEN event_id % 7 = 0 THEN 'synthetic' ELSE 'supplied' END AS ledger_layer, CASE WHEN event_id % 11 = 0 THEN 'synthetic' ELSE 'supplied' END AS network_layer,
  event_id % 7 = 0 OR event_id % 11 = 0 AS semi_synthetic, count(*) AS n FROM e GROUP BY 1, 2, 3"""))
def _(spark, d):
    p = _typed(spark, d).select("provenance.*")
    return p.groupBy("ledger_layer", "network_layer", "semi_synthetic").agg(F.count("*").alias("n"))


@query("n14_timestamp_from_step", with_(L.E, select="SELECT tx_id, 1724889600 + (time_step - 1) * 600 + event_id % 20 AS seconds FROM e"))
def _(spark, d):
    ts = N.timestamp_from_step(F.col("time_step"), F.pmod("event_id", F.lit(20)))
    return L.event_base(spark, d).select("tx_id", F.unix_seconds(ts).alias("seconds"))


@query("n15_default_time_step", with_(L.E, select=f"SELECT tx_id, CAST({STEP_SQL.format(none='event_id % 49 + 1')} AS INT) AS time_step FROM e"))
def _(spark, d):
    return _typed(spark, d).select("tx_id", "time_step")


@query("n16_surrogate_key", with_(L.E, select="SELECT tx_id, 'txid_' || substr(sha256('coinweave:' || event_id), 1, 24) AS surrogate FROM e"))
def _(spark, d):
    return L.event_base(spark, d).select("tx_id", N.surrogate_key(F.col("event_id")).alias("surrogate"))


@query("n20_remap_class", "SELECT o_orderkey AS \"txId\", CAST(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 0 ELSE -1 END AS INT) AS class FROM orders")
def _(spark, d):
    text = F.when(F.col("o_orderstatus") == "P", "1").when(F.col("o_orderstatus") == "F", "2").otherwise("unknown")
    return L.load(spark, d, "orders").select(F.col("o_orderkey").alias("txId"), N.remap_class(text).alias("class"))


CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _encoded(spark, d):
    nodes, _ = L.order_graph(spark, d)
    return training_tables.one_hot(nodes, "priority", "asn", CATEGORIES)


@query("n26_one_hot", with_(L.V, select="SELECT txId, " + ", ".join(f"CAST(priority = '{c}' AS INT) AS \"asn_{c}\"" for c in CATEGORIES) + " FROM vn"))
def _(spark, d):
    return _encoded(spark, d).select("txId", *[F.col(f"`asn_{c}`") for c in CATEGORIES])


@query("n27_un_one_hot", with_(L.V, select="SELECT txId, 'asn_' || priority AS category FROM vn"))
def _(spark, d):
    return _encoded(spark, d).select("txId", training_tables.un_one_hot([f"asn_{c}" for c in CATEGORIES]).alias("category"))


@query("n28_flag_equals", with_(L.V, select="SELECT txId, CAST(priority = '1-URGENT' AS INT) AS is_tor_exit, CAST(priority = '2-HIGH' AS INT) AS is_high_risk_vpn_asn FROM vn"))
def _(spark, d):
    nodes, _ = L.order_graph(spark, d)
    return nodes.select("txId", N.flag_equals(F.col("priority"), "1-URGENT").alias("is_tor_exit"), N.flag_equals(F.col("priority"), "2-HIGH").alias("is_high_risk_vpn_asn"))


def engineered(spark, d):
    """Node table with clusters, change flags, indicators and fixed column order, and all edges."""

    def build():
        nodes, edges = L.order_graph(spark, d)
        c = clusters(spark, d)
        flagged = flagged_edges(spark, d)
        full = training_tables.any_change_received(training_tables.with_clusters(nodes, c), flagged)
        full = full.withColumn("is_tor_exit", N.flag_equals(F.col("priority"), "1-URGENT")).withColumn(
            "is_high_risk_vpn_asn", N.flag_equals(F.col("priority"), "2-HIGH")
        )
        full = training_tables.one_hot(full, "priority", "asn", CATEGORIES)
        reuse = training_tables.reuse_edges(training_tables.with_clusters(nodes, c), edges)
        every = training_tables.all_edges(flagged.withColumn("edge_type", F.lit("original")), reuse)
        return (
            materialize(training_tables.assert_numeric(training_tables.order_columns(full)), "node_table"),
            materialize(every, "edge_table"),
        )

    return memo(spark, ("engineered", d), build)


@query("n29_order_columns", with_(L.V, select="SELECT count(*) AS n, 15 AS width, count(*) FILTER (priority = '5-LOW') AS low FROM vn"))
def _(spark, d):
    nodes, _ = engineered(spark, d)
    return nodes.agg(F.count("*").alias("n"), F.lit(len(nodes.columns)).alias("width"), F.sum("`asn_5-LOW`").alias("low"))


# ---------------------------------------------------------------- joins over node/edge tables


@query("j8_attach_classes", with_(L.V, select="SELECT txId, time_step, class FROM vn"))
def _(spark, d):
    nodes, _ = L.order_graph(spark, d)
    return links.attach_classes(nodes.select("txId", "time_step"), nodes.select("txId", "class"))


@query("j9_cross_partition_edges", with_(L.V, select="""SELECT vr.source, vr.target FROM vr LEFT JOIN vn a ON a.txId = vr.source LEFT JOIN vn b ON b.txId = vr.target
  WHERE a.time_step IS NULL OR b.time_step IS NULL OR a.time_step <> b.time_step"""))
def _(spark, d):
    nodes, _ = L.order_graph(spark, d)
    return links.cross_partition_edges(L.order_links_raw(spark, d), nodes).select("source", "target")


@query("j10_drop_existing_pairs", with_(L.V, select="""SELECT a.txId AS source, a.txId + 98 AS target FROM vn a SEMI JOIN vn b ON b.txId = a.txId + 98
  WHERE NOT EXISTS (SELECT 1 FROM ve WHERE (source = a.txId AND target = a.txId + 98) OR (target = a.txId AND source = a.txId + 98))"""))
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    ids = nodes.select(F.col("txId").alias("target"))
    candidates = nodes.select(F.col("txId").alias("source"), (F.col("txId") + 98).alias("target")).join(ids, "target", "left_semi")
    return links.drop_existing_pairs(candidates, edges)


EGO_SQL = """eg AS (SELECT txId AS root FROM vn WHERE class = 1),
ei AS (SELECT root, root AS txId FROM eg UNION SELECT root, target FROM eg JOIN ve ON source = root UNION SELECT root, source FROM eg JOIN ve ON target = root)"""


def _ego(spark, d):
    """Neighbourhoods of all illicit nodes."""
    nodes, edges = L.order_graph(spark, d)
    return links.ego_node_ids(edges, nodes.filter("class = 1"))


@query("j11_ego_node_ids", with_(L.V, EGO_SQL, select="SELECT root, txId FROM ei"))
def _(spark, d):
    return _ego(spark, d)


@query("j12_ego_nodes", with_(L.V, EGO_SQL, select="SELECT txId, class, time_step FROM vn WHERE txId IN (SELECT txId FROM ei)"))
def _(spark, d):
    return links.ego_nodes(L.order_graph(spark, d)[0], _ego(spark, d)).select("txId", "class", "time_step")


@query("j12_ego_edges", with_(L.V, EGO_SQL, select="SELECT a.root, source, target FROM ve JOIN ei a ON a.txId = source JOIN ei b ON b.txId = target AND b.root = a.root"))
def _(spark, d):
    return links.ego_edges(L.order_graph(spark, d)[1], _ego(spark, d))


FEEDBACK_SQL = "fb AS (SELECT event_id AS txId, CAST(event_type = 'error' AS INT) AS human_label FROM events WHERE event_type IN ('error', 'purchase'))"


@query("j17_apply_feedback", with_(L.V, FEEDBACK_SQL, select="SELECT txId, CAST(coalesce(human_label, class) AS INT) AS class, time_step <= 34 OR human_label IS NOT NULL AS is_train FROM vn LEFT JOIN fb USING (txId)"))
def _(spark, d):
    nodes, _ = L.order_graph(spark, d)
    patched, _ = links.apply_feedback(nodes.withColumn("is_train", F.col("time_step") <= 34), feedback(spark, d))
    return patched.select("txId", "class", "is_train")


@query("j18_index_nodes", with_(L.V, select="SELECT txId, row_number() OVER (ORDER BY txId) - 1 AS idx FROM vn"))
def _(spark, d):
    return links.index_nodes(L.order_graph(spark, d)[0])


@query("j18_index_edges", with_(L.V, "ix AS (SELECT txId, row_number() OVER (ORDER BY txId) - 1 AS idx FROM vn)", select="SELECT a.idx AS src, b.idx AS dst FROM ve JOIN ix a ON a.txId = source JOIN ix b ON b.txId = target"))
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    return links.index_edges(edges, links.index_nodes(nodes))


# ---------------------------------------------------------------- clusters


def labels_plan(spark, d):
    nodes, edges = L.order_graph(spark, d)
    return components.communities(nodes, edges)


def labels(spark, d):
    return memo(spark, ("labels", d), lambda: labels_plan(spark, d))  # already a durable table


def clusters(spark, d):
    return memo(spark, ("clusters", d), lambda: materialize(components.community_ids(labels(spark, d)), "clusters"))


def flagged_edges(spark, d):
    return memo(
        spark, ("flagged", d),
        lambda: materialize(training_tables.edge_change_flag(L.order_graph(spark, d)[1], clusters(spark, d)), "flagged"),
    )


@query("g23_communities", with_(L.V, L.COMMUNITIES, select="SELECT txId, time_step, label, cioh_cluster_id FROM cl"))
def _(spark, d):
    found = labels_plan(spark, d)
    return found.join(components.community_ids(found).select("txId", "cioh_cluster_id"), "txId")


@query("g24_hub_clusters", with_(L.V, L.COMMUNITIES, L.HUBS, select="SELECT cioh_cluster_id, size, is_vasp_excluded_cluster FROM hb"))
def _(spark, d):
    return training_tables.hub_clusters(clusters(spark, d))


@query("g25_edge_change_flag", with_(L.V, L.COMMUNITIES, L.CHANGES_V, select="SELECT source, target, amount_sats, is_change_output FROM vf"))
def _(spark, d):
    return training_tables.edge_change_flag(L.order_graph(spark, d)[1], clusters(spark, d))


@query("g26_any_change_received", with_(L.V, L.COMMUNITIES, L.CHANGES_V, select="SELECT txId, CAST(coalesce(max(is_change_output), 0) AS INT) AS any_change_received FROM vn LEFT JOIN vf ON vf.target = vn.txId GROUP BY 1"))
def _(spark, d):
    return training_tables.any_change_received(L.order_graph(spark, d)[0], flagged_edges(spark, d)).select("txId", "any_change_received")


@query("g27_reuse_edges", with_(L.V, L.COMMUNITIES, L.HUBS, L.REUSE_V, select="SELECT source, target, 'heuristic_reuse' AS edge_type, 1 AS is_change_output FROM ru"))
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    return training_tables.reuse_edges(training_tables.with_clusters(nodes, clusters(spark, d)), edges)


@query("w2_consecutive_pairs", with_(L.V, L.COMMUNITIES, select="SELECT txId, cioh_cluster_id, lead(txId) OVER (PARTITION BY cioh_cluster_id ORDER BY txId) AS next FROM cl"))
def _(spark, d):
    from coinweave.operators.ordering import neighbour_in_order

    c = clusters(spark, d).select("cioh_cluster_id", "txId")
    paired = neighbour_in_order(c, ["cioh_cluster_id", "txId"], ["cioh_cluster_id"], ["txId"])
    return paired.select("txId", "cioh_cluster_id", F.col("next_txId").alias("next"))


EDGES_SQL = (L.V, L.COMMUNITIES, L.HUBS, L.CHANGES_V, L.REUSE_V)


@query("g28_all_edges", with_(*EDGES_SQL, select="SELECT source, target, 'original' AS edge_type, is_change_output FROM vf UNION ALL SELECT source, target, 'heuristic_reuse', 1 FROM ru"))
def _(spark, d):
    return engineered(spark, d)[1].select("source", "target", "edge_type", "is_change_output")


@query("u4_distinct_edges_with_loops", with_(L.V, select="SELECT source AS src, target AS dst FROM ve UNION SELECT txId, txId FROM vn"))
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    loops = nodes.select(F.col("txId").alias("src"), F.col("txId").alias("dst"))
    return edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).unionAll(loops).distinct()


@query("u5_symmetrise", with_(L.V, select="SELECT source, target FROM ve UNION SELECT target, source FROM ve"))
def _(spark, d):
    e = L.order_graph(spark, d)[1].select("source", "target")
    return e.unionAll(e.select(F.col("target"), F.col("source"))).distinct()


@query("g31_mean_neighbor_features", with_(L.V, """m1 AS (SELECT vn.txId, coalesce(avg(s.feat_2), 0) AS a FROM vn LEFT JOIN ve ON ve.target = vn.txId LEFT JOIN vn s ON s.txId = ve.source GROUP BY 1),
  m2 AS (SELECT vn.txId, coalesce(avg(m1.a), 0) AS a FROM vn LEFT JOIN ve ON ve.target = vn.txId LEFT JOIN m1 ON m1.txId = ve.source GROUP BY 1)""",
  select="SELECT txId, feat_2, round(m1.a, 6) AS feat_2_h1, round(m2.a, 6) AS feat_2_h2 FROM vn JOIN m1 USING (txId) JOIN m2 USING (txId)"))
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    out = models.mean_neighbor_features(nodes.select("txId", "feat_2"), edges, ["feat_2"], 2)
    return out.select("txId", "feat_2", *[F.round(c, 6).alias(c) for c in ("feat_2_h1", "feat_2_h2")])


# ---------------------------------------------------------------- aggregates and metrics


@query("a2_count_by_class", with_(L.V, select="SELECT class, count(*) AS n FROM vn GROUP BY 1"))
def _(spark, d):
    return metrics.count_by(L.order_graph(spark, d)[0], "class")


@query("a2_count_by_edge_type", with_(*EDGES_SQL, select="SELECT 'original' AS edge_type, count(*) AS n FROM vf UNION ALL SELECT 'heuristic_reuse', count(*) FROM ru"))
def _(spark, d):
    return metrics.count_by(engineered(spark, d)[1], "edge_type")


@query("a3_count_distinct", with_(L.V, select="SELECT count(DISTINCT time_step) AS n FROM vn"))
def _(spark, d):
    return metrics.count_distinct(L.order_graph(spark, d)[0], "time_step")


@query("a4_crosstab_share", with_(L.V, select="SELECT priority, CAST(class AS VARCHAR) AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY class), 9) AS share FROM vn GROUP BY priority, class"))
def _(spark, d):
    out = metrics.crosstab_share(L.order_graph(spark, d)[0], "priority", "class")
    return out.select("priority", "class", "n", F.round("share", 9).alias("share"))


@query("a5_contingency", with_(L.V, select="SELECT priority, class, count(*) AS n FROM vn GROUP BY 1, 2"))
def _(spark, d):
    return metrics.contingency(L.order_graph(spark, d)[0], "priority", "class")


CRAMER_SQL = """lb AS (SELECT priority, class FROM vn WHERE class <> -1),
ob AS (SELECT priority, class, count(*) AS o FROM lb GROUP BY 1, 2),
x2 AS (SELECT sum((o - ex) * (o - ex) / ex) AS chi2, (SELECT count(*) FROM lb) AS n FROM (
  SELECT o, (SELECT count(*) FROM lb l WHERE l.priority = ob.priority) * (SELECT count(*) FROM lb l WHERE l.class = ob.class)::DOUBLE / (SELECT count(*) FROM lb) AS ex FROM ob))"""


@query("a6_cramers_v", with_(L.V, CRAMER_SQL, select="SELECT n, round(chi2, 5) AS chi2, 4::BIGINT AS dof, round(sqrt(chi2 / n), 6) AS v, round(exp(-chi2 / 2) * (1 + chi2 / 2), 8) AS p_value FROM x2"))
def _(spark, d):
    out = metrics.cramers_v(L.order_graph(spark, d)[0].filter("class <> -1"), "priority", "class")
    return out.select("n", F.round("chi2", 5).alias("chi2"), "dof", F.round("v", 6).alias("v"), F.round("p_value", 8).alias("p_value"))


# Two by two: the deviation is lessened by a half, the tail of one degree is a series.
TWO_BY_TWO_SQL = """tt AS (SELECT CAST(priority = '1-URGENT' AS INT) AS f, class FROM vn WHERE class <> -1),
tc AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(f * class) AS DOUBLE) AS p, CAST(sum(f * (1 - class)) AS DOUBLE) AS q, CAST(sum((1 - f) * class) AS DOUBLE) AS r, CAST(sum((1 - f) * (1 - class)) AS DOUBLE) AS s FROM tt),
tx2 AS (SELECT n, n * pow(greatest(abs(p * s - q * r) - n / 2, 0), 2) / ((p + q) * (r + s) * (p + r) * (q + s)) AS chi2 FROM tc)"""


@query("a6_two_by_two", with_(L.V, TWO_BY_TWO_SQL, select="""SELECT CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2, 1::BIGINT AS dof, round(sqrt(chi2 / n), 6) AS v,
  round(1 - sqrt(chi2 / 2) * exp(-chi2 / 2) * list_sum(list_transform(range(0, 120), lambda k: pow(chi2 / 2, k) / gamma(k + 1.5))), 8) AS p_value FROM tx2"""))
def _(spark, d):
    n = L.order_graph(spark, d)[0].filter("class <> -1").withColumn("flag", N.flag_equals(F.col("priority"), "1-URGENT"))
    out = metrics.cramers_v(n, "flag", "class")
    return out.select("n", F.round("chi2", 6).alias("chi2"), "dof", F.round("v", 6).alias("v"), F.round("p_value", 8).alias("p_value"))


@query("a7_present_in_both_classes", with_(L.V, select="SELECT bool_or(class = 0) AND bool_or(class = 1) AS in_both, round(avg(class), 9) AS illicit_share FROM vn WHERE class <> -1 AND priority = '1-URGENT'"))
def _(spark, d):
    n = L.order_graph(spark, d)[0].filter("class <> -1").withColumn("flag", N.flag_equals(F.col("priority"), "1-URGENT"))
    return metrics.present_in_both_classes(n, "flag").select("in_both", F.round("illicit_share", 9).alias("illicit_share"))


@query("a8_quantile", with_(L.V, select="SELECT round(quantile_cont(feat_1, 0.995), 6) AS q995, round(quantile_cont(feat_1, 0.5), 6) AS q50 FROM vn"))
def _(spark, d):
    n = L.order_graph(spark, d)[0]
    q = metrics.quantile(n, "feat_1", 0.995).select(F.round("quantile", 6).alias("q995"), F.lit(1).alias("one"))
    m = metrics.median(n, "feat_1").select(F.round("median", 6).alias("q50"), F.lit(1).alias("one"))
    return q.join(m, "one").drop("one")


@query("a10_class_balance", with_(L.V, select="SELECT count(*) FILTER (class = 1) AS pos, count(*) FILTER (class = 0) AS neg, round(count(*) FILTER (class = 0) / count(*) FILTER (class = 1)::DOUBLE, 9) AS pos_weight FROM vn WHERE time_step <= 34"))
def _(spark, d):
    out = metrics.class_balance(L.order_graph(spark, d)[0].filter("time_step <= 34"))
    return out.select("pos", "neg", F.round("pos_weight", 9).alias("pos_weight"))


# A fixed scoring rule stands in for a model, so that both engines see the same predictions.
PRED_SQL = "pr AS (SELECT txId, class AS label, feat_2 / 96 AS score, CAST(feat_2 / 96 > 0.5 AS INT) AS prediction FROM vn)"


def _predictions(spark, d):
    s = F.col("feat_2") / 96
    return L.order_graph(spark, d)[0].select("txId", F.col("class").alias("label"), s.alias("score"), (s > 0.5).cast("int").alias("prediction"))


CM_SQL = """cm AS (SELECT count(*) FILTER (label = 0 AND score <= 0.5) AS tn, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
  count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 1 AND score > 0.5) AS tp FROM pr)"""


@query("a11_confusion_matrix", with_(L.V, PRED_SQL, CM_SQL, select="SELECT tn, fp, fn, tp FROM cm"))
def _(spark, d):
    return metrics.confusion_matrix(_predictions(spark, d))


@query("a12_classification_report", with_(L.V, PRED_SQL, CM_SQL, """rp AS (SELECT *, tn / (tn + fn)::DOUBLE AS p0, tn / (tn + fp)::DOUBLE AS r0, tp / (tp + fp)::DOUBLE AS p1, tp / (tp + fn)::DOUBLE AS r1, tn + fp AS s0, tp + fn AS s1 FROM cm),
  rf AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, (tn + tp) / (s0 + s1)::DOUBLE AS acc FROM rp)""",
  select="""SELECT "row", round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
    SELECT 'licit' AS "row", p0 AS "precision", r0 AS recall, f0 AS f1, s0 AS support FROM rf UNION ALL SELECT 'illicit', p1, r1, f1, s1 FROM rf UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM rf
    UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM rf UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM rf)"""))
def _(spark, d):
    out = metrics.classification_report(metrics.confusion_matrix(_predictions(spark, d)))
    return out.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a13_f1", with_(L.V, PRED_SQL, CM_SQL, select="SELECT round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1 FROM cm"))
def _(spark, d):
    return metrics.f1(_predictions(spark, d)).select(F.round("f1", 9).alias("f1"))


@query("a14_accuracy", with_(L.V, PRED_SQL, select="SELECT count(*)::DOUBLE AS validation_size, round(avg(CAST(label = prediction AS INT)), 9) AS validation_accuracy FROM pr WHERE label <> -1"))
def _(spark, d):
    return metrics.accuracy(_predictions(spark, d).filter("label <> -1")).select("validation_size", F.round("validation_accuracy", 9).alias("validation_accuracy"))


@query("a15_auc", with_(L.V, PRED_SQL, """sr AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM pr WHERE label <> -1 GROUP BY 1),
  cu AS (SELECT *, sum(q) OVER (ORDER BY score) - q AS below FROM sr)""", select="SELECT round(CAST(sum(p * below + p * q / 2.0::DOUBLE) AS DOUBLE) / (sum(p) * sum(q))::DOUBLE, 6) AS roc_auc FROM cu"))
def _(spark, d):
    return metrics.roc_auc(_predictions(spark, d)).select(F.round("roc_auc", 6).alias("roc_auc"))


@query("a16_split_feasible", with_(L.V, select="SELECT sum(n) >= 10 AND count(*) > 1 AND min(n) >= 2 AS feasible FROM (SELECT class, count(*) AS n FROM vn GROUP BY 1)"))
def _(spark, d):
    return metrics.split_feasible(L.order_graph(spark, d)[0], "class")


@query("a17_assert_counts", with_(L.V, select="""SELECT 'count:' || k AS "check", n = w AS passed, CAST(n AS VARCHAR) AS detail FROM (
  SELECT 'nodes' AS k, count(*) AS n, 203769 AS w FROM vn UNION ALL SELECT 'time_steps', count(DISTINCT time_step), 49 FROM vn UNION ALL SELECT 'illicit', count(*) FILTER (class = 1), 4545 FROM vn
  UNION ALL SELECT 'licit', count(*) FILTER (class = 0), 42019 FROM vn UNION ALL SELECT 'unknown', count(*) FILTER (class = -1), 157205 FROM vn UNION ALL SELECT 'original_edges', count(*), 234355 FROM ve)"""))
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    return metrics.assert_counts(nodes, edges, EXPECTED_COUNTS)


# Published size of the public dataset.
EXPECTED_COUNTS = {
    "nodes": 203_769, "original_edges": 234_355, "time_steps": 49, "illicit": 4_545, "licit": 42_019, "unknown": 157_205,
}


@query("q4_verify_nodes_edges", with_(*EDGES_SQL, CRAMER_SQL, select="""SELECT 'columns' AS "check", false AS passed UNION ALL SELECT 'numeric', true UNION ALL SELECT 'features', false
  UNION ALL SELECT 'independent:asn_', (SELECT sqrt(chi2 / n) < 0.05 FROM x2)
  UNION ALL SELECT 'both_classes:is_tor_exit', (SELECT bool_or(class = 0) AND bool_or(class = 1) FROM lb WHERE priority = '1-URGENT')
  UNION ALL SELECT 'both_classes:is_high_risk_vpn_asn', (SELECT bool_or(class = 0) AND bool_or(class = 1) FROM lb WHERE priority = '2-HIGH')
  UNION ALL SELECT 'step_crossing', true UNION ALL SELECT 'count:time_steps', (SELECT count(DISTINCT time_step) = 49 FROM vn)"""))
def _(spark, d):
    nodes, edges = engineered(spark, d)
    return training_tables.verify_nodes_edges(nodes, edges, {"time_steps": 49}).select("check", "passed")


@query("w4_top_weights", with_(L.V, select="SELECT priority AS feature, round(avg(feat_1) - (SELECT avg(feat_1) FROM vn), 4) AS weight FROM vn GROUP BY 1 ORDER BY abs(avg(feat_1) - (SELECT avg(feat_1) FROM vn)) DESC LIMIT 3"))
def _(spark, d):
    """Deviations of the mean feature per category play the weights."""
    n = L.order_graph(spark, d)[0]
    from coinweave.operators.ordering import with_scalar

    per = with_scalar(n.groupBy(F.col("priority").alias("feature")).agg(F.avg("feat_1").alias("m")), n.agg(F.avg("feat_1").alias("all")))
    weights = per.select("feature", (F.col("m") - F.col("all")).alias("weight"), F.col("feature").alias("feature_index"))
    return metrics.top_weights(weights, 3).select("feature", F.round("weight", 4).alias("weight"))


@query("m3_stratified_split", with_(L.V, select="SELECT class, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS held, count(*) AS n FROM vn GROUP BY 1"))
def _(spark, d):
    s = metrics.stratified_split(L.order_graph(spark, d)[0], "class", key="txId")
    return s.groupBy("class").agg(F.sum(F.col("is_holdout").cast("bigint")).alias("held"), F.count("*").alias("n"))


@query("m4_temporal_split", with_(L.V, select="SELECT txId, CASE WHEN class = -1 THEN NULL WHEN time_step <= 34 THEN 'train' WHEN time_step <= 42 THEN 'validation' ELSE 'test' END AS part FROM vn"))
def _(spark, d):
    return L.order_graph(spark, d)[0].select("txId", metrics.temporal_split(F.col("time_step"), F.col("class")).alias("part"))


# ---------------------------------------------------------------- models (no SQL counterpart)


@query("m5_graph_classifier")
def _(spark, d):
    from coinweave.operators.neighbours import incidence

    e = L.event_ledger(spark, d)
    scored, _, _ = models.graph_classifier(L.event_features(spark, d), incidence(e.spends, e.receipts))
    return scored.select("tx_id", "threat_score", "p_licit", "p_illicit", "p_anomalous")


@query("m5_stored_model")
def _(spark, d):
    """All transactions scored by the stored model after it was read back, beside the scores when it was fitted and
    the log-odds of illicit against licit from its weights as plain columns."""
    from coinweave.operators.neighbours import gcn_propagate, incidence

    e, features = L.event_ledger(spark, d), L.event_features(spark, d)
    paid, path = incidence(e.spends, e.receipts), scratch_path(spark, "model")
    fitted, split = models.fit_graph_classifier(features, paid)
    models.save_model(fitted, path)
    model = models.load_model(path)
    before = models.class_shares(fitted, split).select("tx_id", F.col("threat_score").alias("fitted_score"))
    weights, constant = models.feature_weights(model)
    odds = F.lit(constant)
    for name, w in weights.items():
        odds = odds + F.lit(w) * F.col(name)
    spread = gcn_propagate(paid, features.select("tx_id", *weights), list(weights), 2)
    again = models.class_shares(model, spread).select("tx_id", "threat_score", "p_licit", "p_illicit")
    return again.join(before, "tx_id").join(spread.select("tx_id", F.round(odds, 4).alias("log_odds")), "tx_id")


@query("m9_fitted_edges")
def _(spark, d):
    """The eight strongest edges into each alert by the weights of the fitted model."""
    from coinweave.operators.graph import head_per_root
    from coinweave.operators.neighbours import incidence

    e, features = L.event_ledger(spark, d), L.event_features(spark, d)
    paid = incidence(e.spends, e.receipts)
    model, _ = models.fit_graph_classifier(features, paid)
    w = models.fitted_edge_attributions(model, paid, features, Q.alerts(spark, d))
    return head_per_root(w, [F.desc("weight"), F.col("src")], 8).select("root", "src", "dst", F.round("weight", 6).alias("weight"))


@query("m6_suspicion_classifier")
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    scored, _ = models.suspicion_classifier(nodes, edges, ["feat_1", "feat_2"])
    return scored


@query("m7_refit_with_feedback")
def _(spark, d):
    nodes, edges = L.order_graph(spark, d)
    scored, _, _ = models.refit_with_feedback(nodes, edges, feedback(spark, d), ["feat_1", "feat_2"])
    return scored


@query("m8_surrogate_attributions")
def _(spark, d):
    raw = models.surrogate_attributions(L.event_scored(spark, d))
    return raw.select("tx_id", F.inline("raw")).withColumn("raw", F.round("raw", 6))


@query("m9_edge_attributions", with_(*Q.ALL_ROOTS, Q.WEIGHTS_SQL, select="SELECT root, src, dst, round(weight, 9) AS weight FROM ew QUALIFY row_number() OVER (PARTITION BY root ORDER BY weight DESC, src) <= 8"))
def _(spark, d):
    """The eight strongest edges into each alert."""
    from coinweave.operators.graph import head_per_root
    from coinweave.operators.neighbours import incidence

    e = L.event_ledger(spark, d)
    w = models.edge_attributions(incidence(e.spends, e.receipts), L.event_features(spark, d), Q.EDGE_WEIGHTS, Q.alerts(spark, d))
    return head_per_root(w, [F.desc("weight"), F.col("src")], 8).select("root", "src", "dst", F.round("weight", 9).alias("weight"))


@query("m10_model_run", with_(L.V, PRED_SQL, select="SELECT 'rules' AS engine, count(*)::DOUBLE AS validation_size, round(avg(CAST(label = prediction AS INT)), 9) AS validation_accuracy FROM pr WHERE label <> -1"))
def _(spark, d):
    from coinweave.operators.scoring import model_run

    held = metrics.accuracy(_predictions(spark, d).filter("label <> -1")).head().asDict()
    return model_run(spark, "rules", held).select("engine", "validation_size", F.round("validation_accuracy", 9).alias("validation_accuracy"))
