"""What lies within some steps of every alert, for all alerts at once.

Three forms, none of which has a row for each pair of an alert and a node on the way:

* Labels (``labels.py``): balls as unions of a few busy nodes' balls. Sets, induced links, counts and leading rows of each
  root come from them; bitmaps of the roots of a batch are made only where a result shows them.
* Digests: messages along the links, one round a step. After ``hops`` rounds a node's digest stands for all within that
  distance; the work does not depend on the number of alerts.
* Best-k lists: the best k of a union are among the best k of its parts, so a node needs k items a round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from coinweave.operators import labels
from coinweave.operators.graph import DEFAULT_HOPS, EDGE_COLUMNS, PAYLOAD_NODE, canonical, edge_document, iso, node_document
from coinweave.operators.labels import W as _W
from coinweave.operators.labels import WIDTH, WORDS, Balls, Labels, Marked, spread
from coinweave.operators.ordering import row_number
from coinweave.session import broadcast_if_small, materialize

#: Links of a node beyond which its messages are combined by levels, each with a shuffle of its own.
BUSY = 10_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(source, target): every pair of linked nodes once in each direction, no loops."""
    links = edges.select("source", "target").unionAll(edges.select("target", "source")).filter("source <> target")
    return materialize(links.distinct(), "links")


def number_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, batch, place): the roots that are nodes, in the order of their ids, ``WIDTH`` to a batch."""
    known = roots.select(F.col("tx_id").alias("root")).distinct().join(nodes.select(F.col("id").alias("root")).distinct(), "root", "left_semi")
    n = F.col("n") - 1
    return materialize(row_number(known, ["root"], "n").select("root", F.floor(n / WIDTH).cast("bigint").alias("batch"), (n % WIDTH).cast("int").alias("place")), "roots")


def _any() -> Column:
    return reduce(lambda a, b: a | b, [F.col(w) != 0 for w in _W])


def _union(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy("batch", key.alias("id")).agg(*[F.bit_or(w).alias(w) for w in _W])


def _without(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Bits of ``df`` that ``seen`` (one row a key) does not have; rows without any are dropped."""
    known = seen.select(F.col("batch").alias("b"), F.col("id").alias("i"), *[F.col(w).alias(f"s_{w}") for w in _W])
    joined = df.join(known, (F.col("batch") == F.col("b")) & (F.col("id") == F.col("i")), "left")
    return joined.select("batch", "id", *[F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"s_{w}", F.lit(0).cast("bigint")))).alias(w) for w in _W]).filter(_any())


def bit_layers(start: DataFrame, links: DataFrame, hops: int) -> list[DataFrame]:
    """(batch, id, w0 ...) by distance: the numbered nodes of ``start`` (id, batch, place) from which a node is that far. All
    batches move in the same jobs."""
    layers = [materialize(start.select("batch", "id", *_single()), "layer")]
    for _ in range(hops):
        step = _union(layers[-1].join(links, F.col("id") == F.col("source")), F.col("target"))
        fresh = materialize(_without(step, _reach(layers)), "layer")
        if fresh.isEmpty():
            break
        layers.append(fresh)
    return layers


def bit_balls(
    nodes: DataFrame, edges: DataFrame, numbered: DataFrame, hops: int = DEFAULT_HOPS, busy_links: int = labels.BUSY_LINKS, most: int = labels.MOST_BUSY
) -> Balls:
    """For each node and distance the roots from which it is that far, plus exchange wallets paid by any reached transaction
    (depth ``hops + 1`` when not reached otherwise). Rows (batch, id, depth, w0 ...) are made when selected."""
    exchanges = nodes.filter("label = 'WalletAddress' AND type = 'exchange'").select(F.col("id").alias("target"))
    paid = edges.filter("relationship = 'RECEIVED'").select("source", "target").distinct().join(exchanges, "target", "left_semi")
    return Balls(labels.build(both_ways(edges), paid, numbered, hops, bit_layers, busy_links, most))


def _reach(layers: list[DataFrame]) -> DataFrame:
    return layers[0] if len(layers) == 1 else _union(reduce(DataFrame.unionByName, layers), F.col("id"))


def reach(balls: Balls) -> Labels:
    """Which roots' balls hold a node, as labels."""
    return balls.labels


def node_bits(nodes: DataFrame, reached: Labels) -> Marked:
    return labels.mark(nodes, reached, "id")


def edge_bits(edges: DataFrame, reached: Labels) -> Marked:
    """Links with the roots whose ball holds both ends. A hub's links meet one row of labels on either side."""
    return labels.mark(edges, reached, "source", "target")


def bits_text() -> Column:
    """The bitmap as text, a digit for each place."""
    return F.concat(*[F.reverse(F.lpad(F.bin(w), 64, "0")) for w in _W])


def root_count() -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in _W]).cast("bigint")


def _roots(found: DataFrame, numbered: DataFrame) -> DataFrame:
    return found.join(broadcast_if_small(numbered.select("root", (F.col("batch") * WIDTH + F.col("place")).alias("n"))), "n").drop("n")


def root_sums(bits: Marked, numbered: DataFrame, kind: Column, amount: Column | None = None) -> DataFrame:
    """(root, kind, n, total): for each root and kind how many rows its ball holds, and the sum of their amounts. ``kind`` is
    text with few distinct values."""
    return _roots(labels.sums(bits, kind, amount), numbered).select("root", "kind", F.col("rows").alias("n"), "total")


def first_of_roots(bits: Marked, numbered: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """(root, rank): the ``k`` lowest ranks among the rows of a root's ball. A task keeps the best k of what it has read for each
    root, so the merge gets k rows a root and task."""
    best = Window.partitionBy("n").orderBy("rank")
    top = labels.first_rows(bits, k, rank).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    return _roots(top, numbered).select("root", "rank")


# ---------------------------------------------------------------- best-k lists along the links


def best_in_balls(links: DataFrame, items: DataFrame, roots: DataFrame, k: int, hops: int = DEFAULT_HOPS) -> DataFrame:
    """(root, rank): the ``k`` lowest ranks among ``items`` (id, rank) of the nodes within ``hops`` of each root.

    Every round a node unites its neighbours' best k with its own; ranks are numbers, so the state is k numbers a
    node. Repeated ranks are merged before the window, whose bound Spark applies before its shuffle too. The last round is
    asked of the roots alone."""
    order = Window.partitionBy("id").orderBy("rank")
    best = lambda df: df.distinct().withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("id", "rank")
    wanted = roots.select(F.col("tx_id").alias("id")).distinct()
    state = materialize(best(items.select("id", "rank")), "best")
    for left in range(hops - 1, -1, -1):
        moved = links if left else links.join(wanted.withColumnRenamed("id", "target"), "target", "left_semi")
        own = state if left else state.join(wanted, "id", "left_semi")
        step = moved.join(state, F.col("source") == F.col("id")).select(F.col("target").alias("id"), "rank")
        state = materialize(best(step.unionAll(own)), "best")
    return state.join(wanted, "id", "left_semi").withColumnRenamed("id", "root")


def best_by_labels(items: DataFrame, reached: Labels, numbered: DataFrame, k: int) -> DataFrame:
    """(root, rank): the same for the balls that ``reached`` stands for, paid wallets included. Each busy node's best k within each
    distance are found once; a root merges those of its few labels and what its list has."""
    code, far = lambda c: F.shiftright(c, labels.SHIFT), lambda c: F.expr(f"{c} & {labels.FAR}")
    best = lambda df, *keys: df.distinct().withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))).filter(F.col("at") <= k).drop("at")
    held = items.join(reached.table, "id")
    apart = best(held.select("rank", F.explode(F.concat("codes", "more")).alias("c")), "c").select(code("c").alias("v"), far("c").alias("d"), "rank")
    within = best(apart.select("v", F.explode(F.sequence("d", F.lit(reached.hops))).alias("left"), "rank"), "v", "left")
    within = broadcast_if_small(materialize(within, "best"))
    doors = reached.roots.select("n", F.explode(F.concat("codes", "more")).alias("c"))
    met = doors.select("n", code("c").alias("v"), (F.lit(reached.hops) - far("c")).alias("left")).join(within, ["v", "left"]).select("n", "rank")
    listed = held.select(F.explode(F.concat("near", "also")).alias("c"), "rank").select(code("c").alias("n"), "rank")
    return _roots(best(met.unionAll(listed), "n"), numbered).select("root", "rank")


def exchange_payments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """RECEIVED links that end at exchange wallets."""
    exchanges = nodes.filter("label = 'WalletAddress' AND type = 'exchange'").select(F.col("id").alias("target"))
    return edges.filter("relationship = 'RECEIVED'").join(exchanges, "target", "left_semi")


# ---------------------------------------------------------------- digests along the links


def _bytes(text: Column) -> Column:
    """SHA-256 of a text as 32 bytes: half of what its hex digits take in a shuffle or a file."""
    return F.unhex(F.sha2(text, 256))


def _digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def combine(rows: DataFrame, key: str = "id", value: str = "h", times: str | None = None, dealt: bool = False) -> DataFrame:
    """(key, h): one digest of each key's multiset of hex digests, by a tree of two levels in digest order. Equal
    digests are counted first; no list is longer than a bucket of four leading digits or than the number of buckets.

    ``times``: how often a row counts. ``dealt``: no key has many rows, so that one shuffle by key serves all levels. Digests
    given as bytes come back as bytes."""
    binary = isinstance(rows.schema[value].dataType, BinaryType)
    if dealt:
        rows = rows.repartition(key)
    counted = rows.groupBy(key, value).agg((F.sum(times) if times else F.count("*")).alias("n"))
    text = _digits(F.col(value)) if binary else F.col(value)
    leaves = counted.select(key, F.sha2(F.concat(text, F.lit("x"), F.col("n").cast("string")), 256).alias("l"))
    listed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    buckets = leaves.groupBy(key, F.substring("l", 1, 4).alias("p")).agg(listed("l").alias("l"))
    found = buckets.select(key, F.concat("p", "l").alias("l")).groupBy(key).agg(listed("l").alias("h"))
    return found.withColumn("h", F.unhex("h")) if binary else found


def _link_digests(edges: DataFrame) -> DataFrame:
    """(source, target, l, n): digests of the links. Links without time and amount, which repeat with every transaction of a
    host, are counted in each task before they move."""
    link = edges.select("source", "target", _bytes(canonical("edge", EDGE_COLUMNS)).alias("l"), (F.col("ts").isNull() & F.col("amount_sats").isNull()).alias("alike"))
    once = link.filter("NOT alike").select("source", "target", "l", F.lit(1).cast("bigint").alias("n"))
    return materialize(once.unionAll(link.filter("alike").groupBy("source", "target", "l").agg(F.count("*").alias("n"))), "link_digests")


def _messages(ways: DataFrame, state: DataFrame, busy: DataFrame) -> DataFrame:
    """(id, h): what each node hears in a round. Nodes with many links, which ``busy`` names, get theirs by levels of their own."""

    def heard(kind: str, dealt: bool) -> DataFrame:
        met = ways.join(busy, "id", kind).join(state.select(F.col("id").alias("other"), "d"), "other")
        return combine(met.select("id", _bytes(F.concat(_digits(F.col("l")), _digits(F.col("d")))).alias("h"), "n"), times="n", dealt=dealt)

    return heard("left_anti", True).unionAll(heard("left_semi", False))


def node_digests(nodes: DataFrame, edges: DataFrame, hops: int = DEFAULT_HOPS, of: DataFrame | None = None, busy_links: int = BUSY) -> DataFrame:
    """(id, digest): what each node (or each of ``of``, by tx_id) and its surroundings look like.

    Round 0: a node's payload and its links with exchange wallets, these wallets' payloads included. Each further round adds
    every link of the node with the digest its other end had the round before. The last digest changes with any payload within
    ``hops`` steps, any link that touches a node nearer than that, and any exchange payment of a transaction within them.

    Digests are kept and moved as bytes. Where the nodes are named, the last three rounds are asked only of those that are
    near enough to them to be heard."""
    for c, t in (("threat_score", "int"), ("risk_level", "string"), ("primary_anomaly", "string")):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast(t))
    link = _link_digests(edges)
    ways = link.select(F.col("source").alias("id"), F.col("target").alias("other"), "l", "n").unionAll(
        link.filter("source <> target").select(F.col("target"), F.col("source"), "l", "n")
    )
    busy = materialize(ways.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > busy_links).select("id"), "busy")
    busy = broadcast_if_small(busy)
    own = _bytes(canonical("node", PAYLOAD_NODE))
    tills = materialize(nodes.filter("type = 'exchange'").select("id", own.alias("d")), "tills")
    cash = _messages(ways.join(broadcast_if_small(tills.select(F.col("id").alias("other"))), "other", "left_semi"), tills, busy).withColumnRenamed("h", "cash")
    start = nodes.select("id", own.alias("e")).join(cash, "id", "left").select("id", _bytes(F.concat(_digits(F.col("e")), F.coalesce(_digits(F.col("cash")), F.lit("")))).alias("own"))
    start = materialize(start, "digests")
    asked = _asked(ways, of, hops) if of is not None else {}
    state = start.withColumnRenamed("own", "d")
    for left in range(hops - 1, -1, -1):
        moved, base = ways, start
        if left in asked:
            moved, base = ways.join(asked[left], "id", "left_semi"), start.join(asked[left], "id", "left_semi")
        near = _messages(moved, state, busy)
        state = materialize(base.join(near, "id", "left").select("id", _bytes(F.concat(_digits(F.col("own")), F.coalesce(_digits(F.col("h")), F.lit("")))).alias("d")), "digests")
    return state.select("id", _digits(F.col("d")).alias("digest"))


def _asked(ways: DataFrame, of: DataFrame, hops: int) -> dict[int, DataFrame]:
    """The nodes whose digests are still heard with so many rounds to go: those that many steps around the named ones, for the
    last three rounds. Wider surroundings cost more to find than they save."""
    near = materialize(of.select(F.col("tx_id").alias("id")).distinct(), "asked")
    found = {0: near}
    for left in range(1, min(hops, 3)):
        near = materialize(near.unionAll(ways.join(near, "id", "left_semi").select("other")).distinct(), "asked")
        found[left] = near
    return found


def custody_digests(nodes: DataFrame, edges: DataFrame, alerts: DataFrame, hops: int = DEFAULT_HOPS) -> DataFrame:
    """(tx_id, chain_of_custody_hash) of every alert: SHA-256 over the digest of its surroundings, its time and its id."""
    found = node_digests(nodes, edges, hops, alerts).withColumnRenamed("id", "tx_id")
    text = F.concat_ws("|", F.coalesce("digest", F.sha2(F.lit(""), 256)), iso(F.col("ts")), F.col("tx_id"))
    return alerts.select("tx_id", "ts").join(found, "tx_id", "left").select("tx_id", F.sha2(text, 256).alias("chain_of_custody_hash"))


# ---------------------------------------------------------------- what reports read


def _single(place: str = "place") -> list[Column]:
    """The bitmap of one root."""
    return [F.when(F.floor(F.col(place) / 64) == i, F.expr(f"shiftleft(1L, {place} % 64)")).otherwise(F.lit(0).cast("bigint")).alias(w) for i, w in enumerate(_W)]


def ball_insights(nodes: DataFrame, inside: Marked, reached: Labels, numbered: DataFrame, tell: tuple[str, ...] = ()) -> DataFrame:
    """(section, id, amount_sats, ts, detail, batch, w0 ... or what ``tell`` names of the bitmap): the rows an investigator reads for each alert, each row once a
    batch with the alerts it belongs to. ``inside``: links with the alerts whose ball holds them.

    Sections: direct_input, direct_output, exchange_output, network_step, system."""
    columns = ["section", "id", "amount_sats", "ts", "detail"]
    target = nodes.select(F.col("id").alias("target"), F.col("type").alias("t_type"))
    source = nodes.select(F.col("id").alias("source"), F.col("entity_id").alias("s_entity"))
    shown = lambda section, ident, detail: [F.lit(section).alias("section"), F.col(ident).alias("id"), "amount_sats", "ts", detail.alias("detail")]

    def mine(links: Marked, key: str, section: str, ident: str, detail: Column) -> DataFrame:
        """Rows of the link's own transaction. A link is in the ball of its own transaction, so these need no other bits."""
        own = numbered.select(F.col("root").alias(key), "batch", "place")
        held = links.rows.join(own, key).select(*shown(section, ident, detail), "batch", *_single())
        texts = {"roots": bits_text(), "roots_sha256": F.sha2(bits_text(), 256), "n_roots": root_count()}
        return held.select(*columns, "batch", *[texts[c].alias(c) for c in tell] or _W)

    def others(links: Marked, section: str, prefix: str) -> DataFrame:
        """Rows of roots other than the link's transaction: its own bit, if it is a root, is taken out."""
        own = numbered.select(F.col("root").alias("source"), (F.col("batch") * WIDTH + F.col("place")).alias("__own"))
        marks = [c for c in links.rows.columns if c.startswith("__")]
        return spread(links.change(lambda df: df.join(own, "source", "left").select(*shown(section, "target", F.concat(F.lit(prefix), "source")), "__own", *marks)), "__own", tell)

    spent = inside.filter("relationship = 'SPENT'").join(source, "source")
    received = inside.filter("relationship = 'RECEIVED'").join(target, "target")
    cashed = received.filter("t_type = 'exchange'")
    hosts = inside.filter("relationship = 'BROADCAST_FROM'")
    systems = spread(node_bits(nodes.filter("label = 'ASN'").select("id", "description"), reached), tell=tell).select(
        F.lit("system").alias("section"), "id", F.lit(None).cast("bigint").alias("amount_sats"), F.lit(None).cast("timestamp").alias("ts"),
        F.col("description").alias("detail"), "batch", *(tell or _W),
    )
    parts = [
        mine(spent, "target", "direct_input", "source", F.col("s_entity")),
        mine(received, "source", "direct_output", "target", F.col("t_type")),
        mine(cashed, "source", "exchange_output", "target", F.lit("root cashout")),
        others(cashed, "exchange_output", "from "),
        mine(hosts, "source", "network_step", "target", F.lit("root broadcast")),
        others(hosts, "network_step", "linked broadcast from "),
        systems,
    ]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*columns, "batch", *(tell or _W)) for p in parts])


def ball_exposure(nodes: DataFrame, inside: Marked, numbered: DataFrame) -> DataFrame:
    """(root, exchange_sats, n_exchange_outputs): money reaching exchange wallets in each alert's ball."""
    sums = root_sums(exchange_payments(nodes, inside), numbered, F.lit("cash"), F.col("amount_sats"))
    return numbered.select("root").join(sums, "root", "left").select(
        "root", F.coalesce("total", F.lit(0)).alias("exchange_sats"), F.coalesce("n", F.lit(0)).alias("n_exchange_outputs")
    )


def ball_shapes(nodes: DataFrame, edges: DataFrame, reached: Labels, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the audit of subgraphs asks of each root's ball: (root, n_nodes, labels, n_root, root_missing) and (root, n_edges, rels,
    incomplete), from bit counts."""
    from coinweave.operators.audit import incomplete_edge, root_fields

    held = root_sums(node_bits(nodes, reached), numbered, F.col("label")).groupBy("root").agg(F.sum("n").alias("n_nodes"), F.collect_set("kind").alias("labels"))
    own = numbered.select("root").join(nodes, F.col("root") == F.col("id")).groupBy("root").agg(*root_fields())
    slim = edges.select("source", "target", "relationship", incomplete_edge().alias("holes"))
    links = root_sums(edge_bits(slim, reached), numbered, F.col("relationship"), F.col("holes")).groupBy("root").agg(
        F.sum("n").alias("n_edges"), F.collect_set("kind").alias("rels"), F.sum("total").alias("incomplete")
    )
    return held.join(own, "root", "left"), links


def _ranked(df: DataFrame, order: list) -> DataFrame:
    return materialize(row_number(df, order, "rank"), "ranked")


def _places(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that ranks name, with their place within each root."""
    w = Window.partitionBy("root").orderBy("order")
    return found.withColumnRenamed("rank", "order").join(rows.withColumnRenamed("rank", "order"), "order").withColumn("rank", F.row_number().over(w)).drop("order")


def leading_transactions(
    nodes: DataFrame, links: DataFrame, alerts: DataFrame, order: list, k: int, hops: int = DEFAULT_HOPS, reached: Labels | None = None, numbered: DataFrame | None = None
) -> DataFrame:
    """(root, node columns, rank): the first ``k`` transactions of each alert's ball in ``order`` (a total order). With labels
    (``reached`` and ``numbered``, of the same alerts) nothing moves along the links."""
    ranked = _ranked(nodes.filter("label = 'Transaction'"), order)
    if reached is not None:
        return _places(best_by_labels(ranked.select("id", "rank"), reached, numbered, k), ranked)
    return _places(best_in_balls(links, ranked.select("id", "rank"), alerts, k, hops), ranked)


def leading_nodes(
    nodes: DataFrame, edges: DataFrame, links: DataFrame, alerts: DataFrame, k: int, hops: int = DEFAULT_HOPS, reached: Labels | None = None, numbered: DataFrame | None = None
) -> DataFrame:
    """(root, rank, element, document): the first ``k`` nodes, by id, of each alert's subgraph. A transaction brings the exchange
    wallets it pays along. With labels (``reached`` and ``numbered``) nothing moves along the links."""
    ranked = _ranked(nodes, [F.col("id")])
    shown = ranked.select("rank", canonical("node", PAYLOAD_NODE).alias("element"), node_document().alias("document"))
    if reached is not None:
        return _places(best_by_labels(ranked.select("id", "rank"), reached, numbered, k), shown)
    paid = exchange_payments(nodes, edges).select(F.col("source").alias("id"), "target").distinct()
    brought = paid.join(ranked.select(F.col("id").alias("target"), "rank"), "target").select("id", "rank")
    found = best_in_balls(links, ranked.select("id", "rank").unionAll(brought), alerts, k, hops)
    return _places(found, shown)


def leading_edges(edges: DataFrame, reached: Labels, numbered: DataFrame, k: int) -> DataFrame:
    """(root, rank, element, document): the first ``k`` links of each alert's subgraph, by ends, relationship, amount and time."""
    keys = [F.col("source"), F.col("target"), F.col("relationship"), F.col("amount_sats").asc_nulls_first(), F.col("ts").asc_nulls_first(), canonical("edge", EDGE_COLUMNS)]
    ranked = _ranked(edges, keys)
    found = first_of_roots(edge_bits(ranked, reached), numbered, k)
    return _places(found, ranked.select("rank", canonical("edge", EDGE_COLUMNS).alias("element"), edge_document().alias("document")))


def leading_payments(nodes: DataFrame, edges: DataFrame, links: DataFrame, alerts: DataFrame, k: int = 8, hops: int = DEFAULT_HOPS) -> DataFrame:
    """(root, section, id, amount_sats, ts, rank): the first ``k`` exchange outputs of each alert's ball by wallet, amount, time and
    payer, or its own outputs where the ball has none."""
    cash = exchange_payments(nodes, edges).select("source", F.col("target").alias("id"), "amount_sats", "ts")
    order = [F.col("id"), F.col("amount_sats"), F.col("ts"), F.col("source")]
    ranked = _ranked(cash, order)
    found = best_in_balls(links, ranked.select(F.col("source").alias("id"), "rank"), alerts, k, hops)
    cashed = _places(found, ranked).select("root", F.lit("exchange_output").alias("section"), "id", "amount_sats", "ts", "rank")
    rest = alerts.select(F.col("tx_id").alias("source")).distinct().join(found.select(F.col("root").alias("source")).distinct(), "source", "left_anti")
    own = edges.filter("relationship = 'RECEIVED'").join(rest, "source").select(
        F.col("source").alias("root"), F.lit("direct_output").alias("section"), F.col("target").alias("id"), "amount_sats", "ts", "source"
    )
    w = Window.partitionBy("root").orderBy(*order)
    direct = own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("source")
    return cashed.unionByName(direct)
