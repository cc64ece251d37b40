"""Merkle manifest of a table: a hash tree in each group, a tree over the groups, and a proof for every row.

Node keys are numbers (tree, level, position), so a node's parent is known without a look-up: parents are one
``groupBy`` of the level below, and every node gets the digests beside it in its run (its segment). Pointers then jump: a node's
pointer and segment are joined with those of the node it points at, which doubles the distance and concatenates the
segments, until all point past the root. Rows take their parent's finished path in a last jump, run by run, so
what rows of one run share is joined once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinweave.operators.ordering import row_number, with_scalar
from coinweave.session import broadcast_if_small, materialize

FANOUT = 16
#: The tree over the groups. Its leaves, at level 0, are the groups' subroots.
TOP = -1
#: Nodes a jump may broadcast: segments of that many stay within some megabytes.
JUMP_NODES = 2048
_KEY = ["tree", "level", "pos"]
_UP = ["up_tree", "up_level", "up_pos"]


def hash_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return hash_of(*[field_text(v) for v in values])


def proof_text(path: Column) -> Column:
    """All siblings of a path, left to right and level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, s: hash_of(s["left"], digest, s["right"]))


def _levels(size: Column, most: int, fanout: int) -> Column:
    """Smallest h with fanout**h >= size, for sizes up to ``most``."""
    steps, reach = [F.lit(0)], 1
    while reach < most:
        steps.append(F.when(size > reach, F.lit(1)).otherwise(F.lit(0)))
        reach *= fanout
    return reduce(lambda a, b: a + b, steps)


def _up(level: Column, height: Column, fanout: int) -> list[Column]:
    """Key of the parent; the last node of a group's tree goes by its name in the tree over the groups."""
    last = (level + 1 >= height) & (F.col("tree") != TOP)
    return [
        F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("up_tree"),
        F.when(last, F.lit(0)).otherwise(level + 1).cast("int").alias("up_level"),
        F.when(last, F.col("tree")).otherwise(F.floor(F.col("pos") / fanout)).cast("bigint").alias("up_pos"),
    ]


def _runs(nodes: DataFrame, fanout: int, *more: str) -> DataFrame:
    """One row per run of ``fanout`` consecutive nodes: (tree, height, run, members in order)."""
    member = F.struct("pos", "digest", *more)
    grouped = nodes.groupBy("tree", "height", F.floor(F.col("pos") / fanout).cast("bigint").alias("run"))
    return grouped.agg(F.sort_array(F.collect_list(member)).alias("members"))


def _beside(fanout: int) -> Column:
    """Segment of the member at index ``i``: the digests left and right of it."""
    digests = F.transform("members", lambda m: m["digest"])
    return F.array(F.struct(
        F.array_join(F.slice(digests, F.lit(1), F.col("i")), "").alias("left"),
        F.array_join(F.slice(digests, F.col("i") + 2, F.lit(fanout)), "").alias("right"),
    ))


def _build(nodes: DataFrame, most: int, fanout: int, first: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels above ``nodes`` (tree, height, pos, digest), which are at level ``first``: pointers with their segments, and the
    last nodes (tree, digest) of the trees that end at each level."""
    pointers, ends, level, reach = [], [nodes.filter(F.col("height") == first).select("tree", "digest")], first, 1
    while reach < most:
        runs = materialize(_runs(nodes.filter(F.col("height") > level), fanout), "runs")
        each = runs.selectExpr("tree", "height", "members", "posexplode(members) AS (i, m)")
        pointers.append(each.select(
            "tree", F.lit(level).alias("level"), F.col("m.pos").alias("pos"), *_up(F.lit(level), F.col("height"), fanout), _beside(fanout).alias("path"),
        ))
        digests = F.array_join(F.transform("members", lambda m: m["digest"]), "")
        nodes = runs.select("tree", "height", F.col("run").alias("pos"), F.sha2(digests, 256).alias("digest"))
        level, reach = level + 1, reach * fanout
        ends.append(nodes.filter(F.col("height") == level).select("tree", "digest"))
    return pointers, ends


def _jump(pointers: DataFrame, longest: int) -> DataFrame:
    """(tree, level, pos, path): pointers doubled until every path reaches the root."""
    distance = 1
    while distance < longest:
        # Who is pointed at lies at least ``distance`` levels above the lowest inner nodes, or in the top tree.
        there = pointers.filter((F.col("tree") == TOP) | (F.col("level") > distance)).select(
            *[F.col(k).alias(f"at_{k}") for k in _KEY], *[F.col(u).alias(f"next_{u}") for u in _UP], F.col("path").alias("more")
        )
        joined = pointers.join(broadcast_if_small(there, JUMP_NODES), [F.col(u) == F.col(f"at_{k}") for u, k in zip(_UP, _KEY)], "left")
        pointers = materialize(joined.select(
            *_KEY, *[F.coalesce(f"next_{u}", u).alias(u) for u in _UP],
            F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
        ), "jumps")
        distance *= 2
    return pointers.select(*_KEY, "path")


def manifest(rows: DataFrame, row_id: str, group: str, leaf: Column, other_leaf: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``rows``: its id under its own name, leaf, other_leaf, subroot, root, and path, the
    array of (left, right) digests beside the way from the leaf to the root; ``proof_text`` and ``fold`` read it.

    ``leaf`` is the digest expression; ``other_leaf`` may be a second one to fold along the same path (null where there
    is none). Groups stand in the order of ``group`` (null first, bytewise), rows of a group by id (null
    first, then by leaf, so that identical rows have identical neighbours whatever their order). Each run of
    ``fanout`` nodes becomes their hash until one is left, in each group and then over the groups; a group of one
    row is its own subroot. No column but the named ones and those of the expressions is read, so further columns may
    have any names. An empty table gives no rows.

    Positions come from range-partitioned blocks, so a group with a third of all rows is spread like any other."""
    sizes = materialize(rows.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("size")), "groups")
    facts = sizes.agg(F.count("*").alias("groups"), F.max("size").alias("most")).first()
    groups, most = facts["groups"], facts["most"] or 0
    ranked = materialize(row_number(sizes, [F.col("g").asc_nulls_first()], "rank").select(
        "g", (F.col("rank") - 1).alias("tree"), _levels(F.col("size"), most, fanout).alias("height")
    ), "trees")

    slim = rows.select(
        F.col(row_id).alias("id"), F.col(group).alias("own"), leaf.alias("digest"), (F.lit(None).cast("string") if other_leaf is None else other_leaf).alias("other")
    )
    placed = slim.join(broadcast_if_small(ranked), F.col("own").eqNullSafe(F.col("g"))).drop("own", "g")
    numbered = row_number(placed, ["tree", F.col("id").asc_nulls_first(), "digest"], "place", ["tree"])
    leaves = materialize(_runs(numbered.withColumn("pos", F.col("place") - 1), fanout, "id", "other"), "leaf_runs")

    digests = F.array_join(F.transform("members", lambda m: m["digest"]), "")
    above = leaves.filter("height > 0").select("tree", "height", F.col("run").alias("pos"), F.sha2(digests, 256).alias("digest"))
    single = leaves.filter("height = 0").select("tree", F.col("members")[0]["digest"].alias("digest"))
    pointers, ends = _build(above, -(-most // fanout), fanout, 1)
    subroots = materialize(reduce(DataFrame.unionByName, [single, *ends]), "subroots")

    high = _levels(F.lit(groups), groups, fanout)
    top, last = _build(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), high.alias("height"), F.col("tree").alias("pos"), "digest"), groups, fanout, 0)
    root = last[-1].select(F.col("digest").alias("root"))

    height = lambda n: sum(fanout**h < n for h in range(64))
    pointers = [*pointers, *top]
    longest = max(0, height(most) - 1) + height(groups)
    key = [F.when(F.col("height") < 2, F.lit(TOP)).otherwise(F.col("tree")), F.when(F.col("height") < 2, F.lit(0)).otherwise(F.lit(1)), F.when(F.col("height") < 2, F.col("tree")).otherwise(F.col("run"))]
    runs = leaves.select("tree", "height", "members", *[k.cast("bigint").alias(f"to_{n}") for k, n in zip(key, _KEY)])
    if pointers:
        paths = _jump(materialize(reduce(DataFrame.unionByName, pointers), "pointers"), longest)
        runs = runs.join(paths.select(*[F.col(k).alias(f"of_{k}") for k in _KEY], "path"), [F.col(f"to_{k}") == F.col(f"of_{k}") for k in _KEY], "left")
    else:
        runs = runs.withColumn("path", F.lit(None).cast("array<struct<left: string, right: string>>"))
    ends_of = broadcast_if_small(subroots.select(F.col("tree").alias("of"), F.col("digest").alias("subroot")))
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    each = (
        with_scalar(runs.join(ends_of, F.col("tree") == F.col("of")), root)
        .select("subroot", "root", "height", "members", F.coalesce("path", nothing).alias("path"), F.posexplode("members").alias("i", "m"))
    )
    return each.select(
        F.col("m.id").alias(row_id), F.col("m.digest").alias("leaf"), F.col("m.other").alias("other_leaf"), "subroot", "root",
        F.when(F.col("height") == 0, F.col("path")).otherwise(F.concat(_beside(fanout), F.col("path"))).alias("path"),
    )
