"""Peel chains: runs of 1-in / 2-out transactions that pass the bulk on and shed a similar amount.

A candidate spends one address, so it has at most one parent; only a parent with exactly one candidate
child is followed. The links therefore form disjoint paths (and rings when timestamps are all equal).
Every start walks to the end of its path, so the amounts seen from position ``i`` of a path with
smallest outputs ``m_0 .. m_{L-1}`` are ``m_i, m_{i+1} twice, .., m_{L-2} twice, m_{L-1}``.

Positions come from pointer doubling over injective jumps, so no join key repeats. Short paths are
tested in one grouped row each; paths longer than ``array_limit`` are tested with distributed order
statistics, so no path is ever gathered beyond that limit.
"""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.functions.normalize import let
from coinweave.operators.heuristics import PEEL_DELTA_SECONDS, micros
from coinweave.operators.ledger import Ledger, tx_children
from coinweave.operators.ordering import running_sums
from coinweave.session import materialize

TOLERANCE = 0.08
ARRAY_LIMIT = 8192
MIN_CHAIN = 3
DIGIT_BITS = 4


def _median_of_sorted(a: Column) -> Column:
    n = F.size(a)
    half = F.floor(n / 2).cast("int")
    at = lambda i: F.get(a, i).cast("double")
    return F.when(F.pmod(n, F.lit(2)) == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)


def close_to_median(low: Column, high: Column, median: Column, tol: float) -> Column:
    """All values between ``low`` and ``high`` deviate at most ``tol`` from the median, relatively."""
    scale = F.greatest(median, F.lit(1.0))
    return (F.abs(high.cast("double") - median) / scale <= tol) & (F.abs(low.cast("double") - median) / scale <= tol)


def repeated_small_amount(amounts: Column, tol: float = TOLERANCE) -> Column:
    """At least two amounts, all within ``tol`` of their median."""

    def test(ordered: Column) -> Column:
        ends = F.get(ordered, F.lit(0)), F.element_at(ordered, -1)
        return let(_median_of_sorted(ordered), lambda median: close_to_median(*ends, median, tol))

    return let(F.array_sort(amounts), lambda ordered: F.when(F.size(ordered) >= 2, test(ordered)).otherwise(F.lit(False)))


def chain_links(ledger: Ledger, latest: DataFrame, delta_s: int = PEEL_DELTA_SECONDS) -> DataFrame:
    """(prev, next) between candidates: only child of its parent, 0 <= delay <= ``delta_s``."""
    shaped = ledger.sides.filter("n_in = 1 and n_out = 2").select("tx_id")
    children = tx_children(ledger.spends, latest)
    child_ok = children.join(shaped.withColumnRenamed("tx_id", "child"), "child", "left_semi")
    # Count before the time filter and before the parent is checked, as "exactly one candidate child".
    only = (
        child_ok.groupBy("parent")
        .agg(F.count("*").alias("n"), F.min("child").alias("child"), F.min("child_ts").alias("child_ts"),
             F.min("parent_ts").alias("parent_ts"))
        .filter("n = 1")
    )
    delay = micros(F.col("child_ts")) - micros(F.col("parent_ts"))
    return (
        only.filter((delay >= 0) & (delay <= delta_s * 1_000_000))
        .join(shaped.withColumnRenamed("tx_id", "parent"), "parent", "left_semi")
        .select(F.col("parent").alias("prev"), F.col("child").alias("next"))
    )


def path_positions(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(paths, rings)``: (tx_id, head, pos) for path members, (tx_id, ring) for ring members.

    After round k positions below 2**k are known; a jump of 2**k steps maps them one to one onto the
    next 2**k positions. Keys on both sides of every join are unique."""
    heads = links.select(F.col("prev").alias("tx_id")).join(
        links.select(F.col("next").alias("tx_id")), "tx_id", "left_anti"
    )
    known = [heads.select("tx_id", F.col("tx_id").alias("head"), F.lit(0).cast("bigint").alias("pos"))]
    jump, step = links.select(F.col("prev").alias("a"), F.col("next").alias("b")), 1
    while True:
        placed = known[0]
        for part in known[1:]:
            placed = placed.unionAll(part)
        moved = materialize(
            placed.join(jump, placed["tx_id"] == jump["a"]).select(
                F.col("b").alias("tx_id"), "head", (F.col("pos") + step).alias("pos")
            ),
            "placed",
        )
        if moved.isEmpty():
            break
        known.append(moved)
        onward = jump.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jump = materialize(jump.join(onward, "b").select("a", F.col("c").alias("b")), "jump")
        step *= 2
    # The rest of the jump table belongs to rings: they have no head and never run out of jumps.
    members = links.select(F.col("prev").alias("tx_id")).join(placed.select("tx_id"), "tx_id", "left_anti")
    return placed, _ring_labels(links, materialize(members, "ring"))


def _ring_labels(links: DataFrame, members: DataFrame) -> DataFrame:
    """Smallest id around each ring, by doubling the span that each member has seen."""
    size = members.count()
    label = members.select("tx_id", F.col("tx_id").alias("ring"))
    if size == 0:
        return label
    jump = links.join(members.withColumnRenamed("tx_id", "prev"), "prev", "left_semi")
    span = 1
    while span < size:
        seen = label.select(F.col("tx_id").alias("next"), F.col("ring").alias("other"))
        label = materialize(
            label.join(jump, label["tx_id"] == jump["prev"]).join(seen, "next").select(
                "tx_id", F.least("ring", "other").alias("ring")
            ),
            "ring",
        )
        onward = jump.select(F.col("prev").alias("next"), F.col("next").alias("far"))
        jump = materialize(jump.join(onward, "next").select("prev", F.col("far").alias("next")), "jump")
        span *= 2
    return label


def order_statistics(values: DataFrame, queries: DataFrame, group: str) -> DataFrame:
    """Exact k-th smallest value among the rows of a group at or after a position.

    ``values`` (group, pos, value >= 0), ``queries`` (group, from_pos, k, qid). A descent by value digits,
    ``DIGIT_BITS`` at a time from the top: each level needs running digit counts over rows ordered by
    (group, node, pos), which are computed in blocks, so the groups may be of any size. Returns the
    queries with ``answer``."""
    largest = values.agg(F.max("value").alias("m")).head()["m"]
    levels = max(1, -(-int(largest or 0).bit_length() // DIGIT_BITS))
    size = 1 << DIGIT_BITS
    nothing = F.lit(None)
    points = values.select(group, "pos", "value", F.lit(0).cast("bigint").alias("node"))
    asks = queries.withColumn("node", F.lit(0).cast("bigint"))
    for level in range(levels - 1, -1, -1):
        digit = F.shiftright("value", level * DIGIT_BITS).bitwiseAND(F.lit(size - 1)).cast("int")
        # Descending positions: the running counts at a query cover the points at or after it.
        rows = points.select(
            group, "node", (-F.col("pos")).alias("rank"), F.lit(0).alias("kind"), digit.alias("digit"),
            nothing.cast("bigint").alias("k"), F.lit("").alias("qid"),
        ).unionAll(
            asks.select(
                group, "node", (-F.col("from_pos")).alias("rank"), F.lit(1).alias("kind"), nothing.cast("int").alias("digit"), "k", "qid"
            )
        )
        upto = {f"c{d}": F.when(F.col("digit") <= d, 1).otherwise(0).cast("bigint") for d in range(size - 1)}
        counted = running_sums(rows, [group, "node", "rank", "kind", "qid"], upto, [group, "node"]).filter("kind = 1")
        found, below = F.lit(size - 1), F.col(f"c{size - 2}")
        for d in range(size - 2, -1, -1):
            here = F.col("k") <= F.col(f"c{d}")
            found = F.when(here, F.lit(d)).otherwise(found)
            below = F.when(here, F.col(f"c{d - 1}") if d else F.lit(0)).otherwise(below)
        asks = materialize(
            counted.select(
                group, (-F.col("rank")).alias("from_pos"), "qid", (F.col("k") - below).alias("k"),
                (F.col("node") * size + found).alias("node"),
            ),
            "descent",
        )
        points = points.withColumn("node", F.col("node") * size + digit)
    return asks.select(group, "from_pos", "qid", F.col("node").alias("answer"))


def _first_start(amounts: list[int | None], tol: float) -> int | None:
    """Smallest start from which the walk to the end of the path qualifies.

    From the end towards the head a sorted list takes in each amount: once for the walk that starts there, once more as
    it lies inside the longer ones. So a path costs its length, not the sum over its suffixes."""
    found, ordered = None, []
    for i in range(len(amounts) - 1, -1, -1):
        if amounts[i] is None:
            break
        insort(ordered, amounts[i])
        half = len(ordered) // 2
        if len(amounts) - i >= MIN_CHAIN:
            median = (float(ordered[half - 1]) + float(ordered[half])) / 2
            scale = max(median, 1.0)
            if abs(ordered[-1] - median) / scale <= tol and abs(ordered[0] - median) / scale <= tol:
                found = i
        if i < len(amounts) - 1:
            insort(ordered, amounts[i])
    return found


def _short_path_starts(rows: DataFrame, tol: float) -> DataFrame:
    """Smallest qualifying start per path, every path at most ``array_limit`` rows."""
    paths = rows.groupBy("head").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("ms")
    )
    first = F.udf(lambda ms: _first_start(ms, tol), "bigint", useArrow=True)
    return paths.filter(F.size("ms") >= MIN_CHAIN).select("head", first("ms").alias("start")).filter("start is not null")


def _long_path_starts(rows: DataFrame, lengths: DataFrame, tol: float) -> DataFrame:
    """The same for paths of any length: suffix extremes and both middle values per start.

    Extremes within ``tol`` of one median keep max/min below a fixed ratio, and that ratio only grows
    towards the head, so starts beyond it need no median."""
    rows = rows.join(lengths.select("head", "length"), "head")
    low, high = _suffix_extremes(rows)
    data = rows.join(low, ["head", "pos"]).join(high, ["head", "pos"])
    ratio = (1 + tol) / (1 - tol) * (1 + 1e-9)
    narrow = (F.col("hi") <= F.greatest(F.col("lo"), F.lit(1)) * ratio + 1) & (F.col("length") - F.col("pos") >= MIN_CHAIN)
    asked = materialize(data.filter(narrow), "asked")
    last = F.col("length") - 1
    # Interior positions count twice; the walk's first and last position once. Doubling every position
    # of the suffix and dropping one copy of the first and of the last gives the list; both copies are
    # told apart by the half positions 2*pos and 2*pos + 1, the first copy of the start lying outside.
    copies = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).filter(
        ~((F.col("copy") == 1) & (F.col("pos") == last))
    )
    values = copies.select(
        "head", (F.col("pos") * 2 + F.lit(1) - F.col("copy")).alias("pos"), F.col("m").alias("value")
    )
    # After the filter the last position keeps its copy at 2*pos + 1; a start i sees 2*i + 1 and later.
    half = F.col("length") - 1 - F.col("pos")
    queries = asked.select(
        "head", (F.col("pos") * 2 + 1).alias("from_pos"), half.alias("k"), F.lit("l").alias("qid")
    ).unionAll(
        asked.select("head", (F.col("pos") * 2 + 1).alias("from_pos"), (half + 1).alias("k"), F.lit("u").alias("qid"))
    )
    found = order_statistics(values, queries, "head")
    medians = found.groupBy("head", ((F.col("from_pos") - 1) / 2).cast("bigint").alias("pos")).agg(
        (F.sum(F.col("answer").cast("double")) / 2).alias("median")
    )
    return (
        asked.join(medians, ["head", "pos"])
        .filter(close_to_median(F.col("lo"), F.col("hi"), F.col("median"), tol))
        .groupBy("head")
        .agg(F.min("pos").alias("start"))
    )


def _suffix_extremes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Running minimum and maximum from the end of each path, by doubling the covered span."""
    longest = rows.agg(F.max("length").alias("n")).head()["n"] or 1
    table, span = rows.select("head", "pos", F.col("m").alias("lo"), F.col("m").alias("hi")), 1
    while span < longest:
        ahead = table.select(
            "head", (F.col("pos") - span).alias("pos"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")
        )
        table = materialize(
            table.join(ahead, ["head", "pos"], "left").select(
                "head", "pos", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi")
            ),
            "extremes",
        )
        span *= 2
    return table.select("head", "pos", "lo"), table.select("head", "pos", "hi")


def _ring_members(rings: DataFrame, small: DataFrame, tol: float) -> DataFrame:
    """A walk around a ring of c members sees every amount twice, whatever its start."""
    rows = rings.join(small, "tx_id")
    # Any position will do; a spread one keeps a large ring from sharing a single sort key.
    spread = F.xxhash64("tx_id").bitwiseAND(F.lit((1 << 60) - 1))
    values = rows.select("ring", spread.alias("pos"), F.col("m").alias("value"))
    sizes = rows.groupBy("ring").agg(F.count("*").alias("c"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    middle = F.floor((F.col("c") + 1) / 2).cast("bigint"), F.floor(F.col("c") / 2).cast("bigint") + 1
    queries = sizes.select("ring", F.lit(0).cast("bigint").alias("from_pos"), middle[0].alias("k"), F.lit("l").alias("qid")).unionAll(
        sizes.select("ring", F.lit(0).cast("bigint").alias("from_pos"), middle[1].alias("k"), F.lit("u").alias("qid"))
    )
    medians = order_statistics(values, queries, "ring").groupBy("ring").agg(
        (F.sum(F.col("answer").cast("double")) / 2).alias("median")
    )
    good = sizes.join(medians, "ring").filter(close_to_median(F.col("lo"), F.col("hi"), F.col("median"), tol))
    return rings.join(good, "ring", "left_semi").select("tx_id")


def peel_chains(
    ledger: Ledger,
    latest: DataFrame,
    delta_s: int = PEEL_DELTA_SECONDS,
    tol: float = TOLERANCE,
    array_limit: int = ARRAY_LIMIT,
) -> DataFrame:
    """Ids of all members of a qualifying chain of at least three transactions."""
    links = materialize(chain_links(ledger, latest, delta_s), "links")
    paths, rings = path_positions(links)
    small = ledger.sides.select("tx_id", F.col("smallest_output").alias("m"))
    rows = materialize(paths.join(small, "tx_id"), "paths")
    lengths = rows.groupBy("head").agg(F.count("*").alias("length"))
    long = materialize(lengths.filter(F.col("length") > array_limit), "long")
    has_long = not long.isEmpty()
    short_rows = rows.join(long, "head", "left_anti") if has_long else rows
    starts = _short_path_starts(short_rows, tol)
    if has_long:
        long_rows = materialize(rows.join(long, "head", "left_semi"), "long_rows")
        starts = starts.unionAll(_long_path_starts(long_rows, long, tol))
    members = rows.join(starts, "head").filter(F.col("pos") >= F.col("start")).select("tx_id")
    if not rings.isEmpty():
        members = members.unionAll(_ring_members(rings, small, tol))
    return members.distinct()
