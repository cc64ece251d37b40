"""Exact Jaccard self-join of word-shingle sets: subsets of small sets, inverted lists of large ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinweave.llm.common import ID_LIMIT, map_arrow, mix, word_hashes
from coinweave.llm.substring_dedup import kmer_hashes, words_of
from coinweave.operators.components import connected_components
from coinweave.session import broadcast_if_small, discard, materialize

WIDTH = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Tokens are dealt to slices by this many hashes at most; the second and later ones serve sets whose slices stay empty too often.
SEEDS = 4
#: Cost of a row of an inverted list, in rows of a subset: it is shuffled more often and may need a comparison.
LIST_COST = 5
#: Sizes up to this are candidates for enumeration.
MOST_ENUMERATED = 24
#: Rounds that compare each list with one of its sets; they end early when few pairs are left.
ROUNDS = 6
#: After so many rounds all pairs across components are compared if they are at most so many for each list row, or if
#: the last round left more than this share of them.
LEAST_ROUNDS, PAIRS_PER_ROW, SHARE_LEFT = 2, 8, 0.75
BITS = 512
#: Sets a task remembers to give equal ones their keys once.
MOST_MET = 1 << 20


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, lower case; shorter texts are one run."""
    joined, starts, ends = words_of(text.lower() if text else text)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    words = word_hashes(joined, starts, ends)
    return np.unique(kmer_hashes(words, min(n, width)) if n >= width else mix(kmer_hashes(words, n) + np.uint64(n)))


def least_overlap(total: int, percent: int = PERCENT) -> int:
    """Smallest intersection at which sets of ``total`` elements together link."""
    return -(-percent * total // (100 + percent))


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of ``n`` shares with a set it links with, one for each partner size."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    return sorted({least_overlap(n + m, percent) for m in partners})


def size_class(n: int) -> tuple[int, int]:
    """Number of the class of size ``n`` and the largest size in it; a class ends two fifths beyond its start."""
    k, low = 0, 1
    while (after := low + max(1, 2 * low // 5)) <= n:
        k, low = k + 1, after
    return k, after - 1


def slice_numbers(largest: int, percent: int = PERCENT) -> tuple[int, int]:
    """Slices of a class and how many of them may be empty. Linked sets of sizes up to ``largest`` differ in at most
    ``far`` elements, so of far + 1 + spare slices more than ``spare`` are equal."""
    far = 2 * largest * (100 - percent) // (100 + percent)
    spare = (far + 1) // 12
    return far + 1 + spare, spare


def slice_keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set's inverted lists: one for each slice of its tokens, in every class that a partner of at least
    its size may have, so that linked sets meet in the class of the larger one.

    Two linked sets have more equal slices than the class may have empty ones; a set with no more empty slices than
    that shares a filled slice with every partner. A set with more takes part under the next hash too, where it meets
    the partners that also have more; under the last hash its empty slices are keys as well."""
    n, out = len(tokens), []
    content = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
    size = n
    while size <= 100 * n // percent:
        k, largest = size_class(size)
        g, spare = slice_numbers(largest, percent)
        for seed in range(SEEDS):
            with np.errstate(over="ignore"):
                at = (mix(tokens + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(g)).astype(np.int64)
                sums = np.zeros(g, np.uint64)
                np.add.at(sums, at, content)
            filled = np.bincount(at, minlength=g) > 0
            enough = g - int(filled.sum()) <= spare
            where = np.arange(g) if seed == SEEDS - 1 and not enough else np.flatnonzero(filled)
            out.append(mix(sums[where] ^ mix(where.astype(np.uint64) + np.uint64((k * SEEDS + seed + 1) << 40))))
            if enough:
                break
        size = largest + 1
    return np.concatenate(out)


def list_rows(n: int, percent: int = PERCENT) -> int:
    """Keys that a set of ``n`` elements has, about."""
    rows, size = 0, n
    while size <= 100 * n // percent:
        largest = size_class(size)[1]
        rows, size = rows + min(n, slice_numbers(largest, percent)[0]), largest + 1
    return rows


def parity_map(tokens: np.ndarray, size: int) -> bytes:
    """Parities of the numbers of tokens by their low bits. Where two sets' maps differ, some token is in one of
    them only, so maps differ in no more places than sets in elements."""
    return np.packbits((np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Places in which two maps differ; the longer one is folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest size whose sets are enumerated, by the least number of rows weighed by their cost."""

    def cost(b: int) -> int:
        small = sum(k * sum(comb(n, s) for s in subset_sizes(n, percent)) for n, k in sizes.items() if n <= b)
        return small + LIST_COST * sum(k * list_rows(n, percent) for n, k in sizes.items() if 100 * n >= percent * (b + 1))

    return min(range(MOST_ENUMERATED + 1), key=lambda b: (cost(b), b))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes | None]]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(n).to_pylist() for n in names]
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            yield {n: c[i] for n, c in zip(names, columns)}, text.as_py()


def _sizes(width: int):
    """Task: (size, sets) of small sizes, by shingles before equal ones are dropped: they choose the boundary alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(MOST_ENUMERATED * 2, np.int64)
        for _, text in _texts(batches):
            words = len(text.split()) if text else 0
            n = min(words, max(1, words - width + 1))
            if n < len(sizes):
                sizes[n] += 1
        at = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sizes[at])], names=["size", "n"])

    return run


def _signatures(width: int, percent: int, boundary: int):
    """Task: set size, two hashes of the set, subset keys of small sets, slice keys of large ones, parity bits. Of equal sets
    that a task meets one row has the keys and ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        names = ["d", "t", "n", "c", "c2", "first", "subsets", "slices", "map", *[f"b{i}" for i in range(BITS // 64)]]
        keys_type = pa.list_(pa.struct([("s", pa.int64()), ("h", pa.int64())]))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            d, t, n, c, c2, first, subsets, keys, wide, bits = zip(*out)
            bits = np.stack(bits)
            return pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in (d, t, n, c, c2)], pa.array(first), pa.array(subsets, keys_type), pa.array(keys, pa.list_(pa.int64())), pa.array(wide, pa.binary()),
                 *[pa.array(bits[:, i]) for i in range(BITS // 64)]],
                names=names,
            )

        for row, text in _texts(batches):
            s = shingle_set(text, width)
            n = len(s)
            with np.errstate(over="ignore"):
                c, c2 = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            subsets, keys, first = [], [], n > 0 and int(c) not in met
            if len(met) == MOST_MET:
                met.clear()
            met.add(int(c))
            if first and n <= boundary:
                own, total = [int(x) for x in mix(s)], int(c)
                for size in subset_sizes(n, percent):
                    for gone in combinations(own, n - size):
                        key = (total - sum(gone)) % (1 << 64)
                        subsets.append({"s": size, "h": key - (1 << 64) if key >> 63 else key})
            if first and 100 * n >= percent * (boundary + 1):
                keys = slice_keys(s, percent).view(np.int64)
            bits = np.frombuffer(parity_map(s, BITS), np.int64)
            wide = parity_map(s, max(BITS, 1 << n.bit_length())) if len(keys) else b""
            out.append((row["d"], row["t"], n, c.astype(np.int64), c2.astype(np.int64), first, subsets, keys, wide, bits))
            if len(out) >= 2000:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, text in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row["c"]], pa.int64()), pa.array([shingle_set(text, width).tobytes()], pa.binary())], names=["c", "members"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near(percent: int):
    """Task: the pairs whose maps, as long as the sets are large, do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), batch.column("m").to_pylist()):
                keep.append(apart(x.as_py(), y.as_py()) <= n + m - 2 * least_overlap(n + m, percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _may_link(percent: int, a: str, b: str) -> Column:
    """Bounds that all linked sets meet: on sizes, and on the distance of their parity bits, which never
    exceeds the number of elements that only one of the sets has."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    far = n + m - 2 * F.ceil(percent * (n + m) / F.lit(100 + percent))
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(BITS // 64)])
    return (100 * n >= percent * m) & (100 * m >= percent * n) & (apart <= far)


def _components(links: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """(c, comp) of the classes that have a link, from earlier ones and further links: only the components that a new
    link touches are worked on, as one vertex each."""
    if comps is None:
        merged = connected_components(links).select(F.col("id").alias("c"), F.col("root").alias("comp"))
        return materialize(merged, "comps")
    for side in ("u", "v"):
        of = comps.toDF(side, "comp")
        links = links.join(of, side, "left").withColumn(side, F.coalesce("comp", side)).drop("comp")
    joined = materialize(connected_components(links), "joined")
    grown = comps.join(joined, comps["comp"] == joined["id"], "left").select("c", F.coalesce("root", "comp").alias("comp"))
    fresh = joined.join(comps, joined["id"] == comps["c"], "left_anti").select(F.col("id").alias("c"), F.col("root").alias("comp"))
    return materialize(grown.unionAll(fresh), "comps")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, any others): doc_id, n_shingles, component_id,
    text_hash (with the id it names the row).

    Sets of distinct shingles of ``width`` lower-case words; two link when 100 * intersection >=
    ``percent`` * union; component_id is the smallest doc_id reachable by links. Null, empty or blank
    texts have no shingle, link with nothing and keep their own id; a null doc_id is later than all ids
    and null as a component of its own. An empty table gives no rows.

    Equal sets become one class (told apart by 64 bits of hash, compared sets by their members). Small
    sets enumerate, for each size an overlap may need, all their subsets of that size: a shared subset
    proves the link, so each group of bearers is a star around its smallest set. Large sets enter inverted
    lists: a list's key is a slice of the token space with all tokens a set has there, and there are more slices
    than linked sets have differences, so that these share a list; sets that merely share passages share few. Boundary: the size with the least cost by the sizes' histogram. In each
    round every list compares its sets with one of them, each set at most once, and linked components
    grow; lists whose sets are all in one component are done, so a large group of near copies costs a few
    comparisons a member and not all pairs. When few pairs across components are left, or rounds no longer
    settle many, or after ROUNDS of them, all of those are compared, so no link is lost."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(ID_LIMIT)).alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"), F.col("text").cast("string").alias("text"))
    sizes = {r["size"]: r["n"] for r in map_arrow(keyed.select("text"), _sizes(width), "size long, n long").filter("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    boundary = choose_boundary(sizes, percent)

    bits = [f"b{i}" for i in range(BITS // 64)]
    schema = "d long, t long, n long, c long, c2 long, first boolean, subsets array<struct<s: long, h: long>>, slices array<long>, map binary, " + ", ".join(f"{b} long" for b in bits)
    signed = materialize(map_arrow(keyed, _signatures(width, percent, boundary), schema), "signed")
    rows = materialize(signed.select("d", "t", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")), "rows")
    lowest = rows.filter("n > 0").groupBy("c").agg(F.min("d").alias("d"))
    classes = materialize(lowest, "classes")
    # A class has its keys once a task that met it, so keys are told apart by their classes. One shuffle serves the count and the join.
    bearers = signed.filter("first")

    subsets = bearers.select("c", "n", F.explode("subsets").alias("k")).select("c", "n", "k.s", "k.h")
    subsets = subsets.dropna().repartition("s", "h")
    bearer = F.struct("n", "c")
    smallest = subsets.groupBy("s", "h").agg(F.min(bearer).alias("lead"), F.max(bearer).alias("last")).filter("lead <> last").select("s", "h", "lead")
    links = materialize(
        subsets.join(smallest, ["s", "h"])
        .filter((F.col("c") != F.col("lead.c")) & ((100 + percent) * F.col("s") >= percent * (F.col("n") + F.col("lead.n"))))
        .select(F.col("lead.c").alias("u"), F.col("c").alias("v"))
        .distinct(),
        "links",
    )

    entries = bearers.select("c", F.explode("slices").alias("token")).dropna().repartition("token")
    several = entries.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("token")
    lists = materialize(entries.join(several, "token").distinct(), "lists")
    marks = materialize(bearers.filter(F.size("slices") > 0).select("c", "n", "d", "t", "map", *bits).dropDuplicates(["c"]), "marks")
    discard(signed)
    mark = F.struct("n", *bits)
    sets = None

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that link. Maps of the sets' own size rule out most others first; members of
        sets that were not needed before are read anew from their texts."""
        nonlocal sets
        maps = pairs.join(marks.select(F.col("c").alias("u"), "n", F.col("map").alias("x")), "u").join(
            marks.select(F.col("c").alias("v"), F.col("n").alias("m"), F.col("map").alias("y")), "v"
        )
        pairs = materialize(map_arrow(maps.select("u", "v", "n", "m", "x", "y"), _near(percent), "u long, v long"), "near")
        needed = pairs.select(F.col("u").alias("c")).unionAll(pairs.select("v")).distinct()
        new = needed if sets is None else needed.join(sets.select("c"), "c", "left_anti")
        where = broadcast_if_small(materialize(marks.select("c", "d", "t").join(new, "c"), "needed"))
        fresh = materialize(map_arrow(keyed.join(where, ["d", "t"]).select("c", "text"), _sets(width), "c long, members binary"), "sets")
        sets = fresh if sets is None else sets.unionAll(fresh)
        used = sets.join(broadcast_if_small(needed), "c", "left_semi").dropDuplicates(["c"])
        with_sets = pairs.join(used.select(F.col("c").alias("u"), F.col("members").alias("x")), "u").join(
            used.select(F.col("c").alias("v"), F.col("members").alias("y")), "v"
        )
        return materialize(map_arrow(with_sets.select("u", "v", "x", "y"), _compare(percent), "u long, v long"), "links")

    done, comps = None, _components(links)
    for turn in range(ROUNDS):
        # Dealt by token once: the lead, the lists that stay open and their pairs all need the lists' rows together.
        dealt = lists.join(comps, "c", "left").select("token", "c", F.coalesce("comp", "c").alias("comp")).repartition("token")
        lead = dealt.groupBy("token").agg(
            F.min_by(F.struct(F.col("c").alias("u"), F.col("comp").alias("ucomp")), F.xxhash64(F.lit(turn), "token", "c")).alias("lead"),
            F.min("comp").alias("low"), F.max("comp").alias("high"),
        ).filter("low < high").select("token", "lead.u", "lead.ucomp")
        opened, closed = materialize(dealt.join(lead, "token"), "opened"), lists
        lists = opened.select("token", "c")
        discard(closed)
        spread = opened.groupBy("token", "comp").agg(F.count("*").alias("m"))
        left = spread.groupBy("token").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("inside")).agg(
            F.sum((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("pairs"), F.sum("all").alias("rows")
        ).head()
        if not left["rows"] or (turn >= LEAST_ROUNDS and (left["pairs"] <= PAIRS_PER_ROW * left["rows"] or left["pairs"] > SHARE_LEFT * before)):
            break
        before = left["pairs"]
        pairs = opened.filter("comp <> ucomp").groupBy("u", F.col("c").alias("v")).agg(F.count("*").alias("common"))
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        near = (
            pairs.join(marks.select(F.col("c").alias("u"), mark.alias("p")), "u").join(marks.select(F.col("c").alias("v"), mark.alias("q")), "v")
            .filter(_may_link(percent, "p", "q"))
            .groupBy("v").agg(F.max_by("u", F.struct("common", "u")).alias("u")).select("u", "v")
        )
        asked = materialize(near, "asked")
        done = asked if done is None else done.unionAll(asked)
        comps = _components(verified(asked), comps)
    if left["rows"]:
        # A pair that has the key before this one in common too, as near copies mostly do, was met there.
        ends = lists.withColumn("past", F.lag("token").over(Window.partitionBy("c").orderBy("token")))
        ends = ends.join(comps, "c", "left").withColumn("comp", F.coalesce("comp", "c")).join(marks.select("c", F.struct("n", *bits).alias("p")), "c")
        ends = materialize(ends.select("token", "c", "comp", "past", "p"), "ends")
        x, y = ends.toDF("token", "u", "cu", "pu", "p"), ends.toDF("token", "v", "cv", "pv", "q")
        across = (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & F.coalesce(F.col("pu") != F.col("pv"), F.lit(True))
        pairs = x.join(y, (x["token"] == y["token"]) & across & _may_link(percent, "p", "q"))
        comps = _components(verified(materialize(pairs.select("u", "v").distinct(), "asked")), comps)

    named = classes.join(comps, "c", "left").select("c", "d", F.coalesce("comp", "c").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("d").alias("low"))
    component = named.join(smallest, "comp").select("c", "low")
    return rows.join(component, "c", "left").select(
        F.nullif("d", F.lit(ID_LIMIT)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("low", "d"), F.lit(ID_LIMIT)).alias("component_id"), F.col("t").alias("text_hash")
    )
