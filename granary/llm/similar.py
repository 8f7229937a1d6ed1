"""Links and components of similar sets, found through buckets that may hold any share of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.batches import map_batches
from granary.llm.components import connected_components
from granary.llm.skew import salted_join
from granary.scratch import discard, free_shuffles, materialize

#: Words of 64 bits that mark the elements of a set: those of a stand-in that a node lacks, others that it has, or all.
MARK_WORDS = 8
_LACKS, _OTHERS, SKETCH = ([f"{name}{i}" for i in range(MARK_WORDS)] for name in ("lack", "other", "mark"))


def set_marks(shingles: np.ndarray) -> np.ndarray:
    """Bit h mod 512 for every shingle h, as 64-bit words."""
    bits = np.zeros(64 * MARK_WORDS, dtype=bool)
    bits[(shingles >> np.uint64(7)) % np.uint64(64 * MARK_WORDS)] = True
    return np.packbits(bits).view(np.int64)


def _compared(pairs: DataFrame, sets: DataFrame, marks: bool = False, width: int = 8) -> DataFrame:
    """Pairs (u, v) with the sizes n_u, n_v of their full sets and the size ``both`` of the intersection.

    Elements have ``width`` bytes. With ``marks`` also the marks of v's
    shingles that u lacks, and of u's that v has not.
    """
    element = np.dtype(f"u{width}")
    one = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u"))
    two = sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
    joined = salted_join(salted_join(pairs, one, "u", "v"), two, "v", "u", like=pairs)
    schema = "u bigint, v bigint, n_u int, n_v int, both int"
    if marks:
        schema += "".join(f", {c} bigint" for c in (*_LACKS, *_OTHERS))

    def start():
        def step(batch):
            if batch is None:
                return
            out = {"u": batch["u"], "v": batch["v"], "n_u": [], "n_v": [], "both": []}
            seen = []
            for one, two in zip(batch["set_u"], batch["set_v"], strict=True):
                a, b = np.frombuffer(one, dtype=element), np.frombuffer(two, dtype=element)
                common = np.intersect1d(a, b, assume_unique=True)
                out["n_u"].append(len(a))
                out["n_v"].append(len(b))
                out["both"].append(len(common))
                if marks:
                    lacks, others = (np.setdiff1d(x, common, assume_unique=True) for x in (b, a))
                    seen.append(np.concatenate([set_marks(lacks), set_marks(others)]))
            if seen:
                out |= dict(zip((*_LACKS, *_OTHERS), np.array(seen).T, strict=True))
            yield out

        return step

    return map_batches(joined.select("u", "v", "set_u", "set_v"), schema, start)


def _similar(both: Column, n_u: Column, n_v: Column, percent: int) -> Column:
    return 100 * both >= percent * (n_u + n_v - both)


def _linked(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(_similar(F.col("both"), F.col("n_u"), F.col("n_v"), percent)).select("u", "v")


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, node, stand_in, part, home) of the buckets that hold several components; home is the stand-in's."""
    placed = members.filter("size > 2").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    placed = materialize(placed.select("key", "node", "stand_in", "part"), "similar-placed")
    home = F.max(F.when(F.col("node") == F.col("stand_in"), F.col("part"))).alias("home")
    mixed = placed.groupBy("key").agg(home, F.min("part").alias("low"), F.max("part").alias("high"))
    mixed = materialize(mixed.filter("low != high").select("key", "home"), "similar-mixed")
    return salted_join(placed.filter("node != stand_in"), mixed, "key", "node")


def _side(rows: DataFrame, end: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{c}_{end}") for c in rows.columns if c != "key"])


def _at_most(names: list[str], sizes: list[Column]) -> Column:
    """An upper bound of the elements that u and v share, from marks and the numbers of elements that made them."""
    agreed = sum((F.bit_count(F.col(f"{c}_u").bitwiseAND(F.col(f"{c}_v"))) for c in names), F.lit(0))
    doubled = [n - sum((F.bit_count(f"{c}_{end}") for c in names), F.lit(0)) for n, end in zip(sizes, "uv", strict=True)]
    return F.least(*sizes, agreed + F.least(*doubled))


def _possible_pairs(placed: DataFrame, bound: Column, percent: int) -> DataFrame:
    """Pairs (u, v) of placed rows that share a bucket but no component, and whose bound of the intersection allows a link.

    One of such a pair is outside the component of the stand-in. These nodes
    are joined with the bucket's, and the bound is part of the join. A pair
    that is outside on both sides is formed once, by the order of its parts.
    """
    n_u, n_v = F.col("n_u"), F.col("n_v")
    once = (F.col("part_v") == F.col("home_v")) | (F.col("part_u") < F.col("part_v"))
    sizes = 100 * F.least(n_u, n_v) >= percent * F.greatest(n_u, n_v)
    possible = (F.col("part_u") != F.col("part_v")) & once & sizes & _similar(bound, n_u, n_v, percent)
    outsiders = _side(placed.filter("part != home"), "u")
    pairs = salted_join(_side(placed, "v"), outsiders, "key", "node_v", possible)
    return pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()


def _across(placed: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that share a bucket but no component, and that may be similar.

    Let c be the stand-in of the bucket, with n elements, of which u lacks l
    and v lacks m. Then u and v have at most n - l - m + x + y elements in
    common, where x of c's are lacking in both, and y not in c are in both.
    Marks bound x and y from above: a bit of both for each, and as many more
    as the elements that share a bit in u, or in v.
    """
    marked = compared.select(
        F.col("u").alias("node"),
        F.col("v").alias("stand_in"),
        F.col("n_u").alias("n"),
        F.col("n_v").alias("n_home"),
        "both",
        *_LACKS,
        *_OTHERS,
    )
    placed = materialize(placed.join(marked, ["node", "stand_in"]), "similar-marked")
    both = [F.col(f"both_{end}") for end in "uv"]
    lacks, others = [F.col("n_home_u") - x for x in both], [F.col(f"n_{end}") - x for x, end in zip(both, "uv", strict=True)]
    bound = F.col("n_home_u") - lacks[0] - lacks[1] + _at_most(_LACKS, lacks) + _at_most(_OTHERS, others)
    return _possible_pairs(placed, bound, percent)


def _across_sketched(placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The same by sketches: marks of a node's whole set, which need no comparison with the stand-in."""
    placed = materialize(placed.join(nodes.select("node", "n", *SKETCH), "node"), "similar-marked")
    return _possible_pairs(placed, _at_most(SKETCH, [F.col("n_u"), F.col("n_v")]), percent)


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""
    for end in "uv":
        own = nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in SKETCH])
        pairs = salted_join(pairs, own, end, "v" if end == "u" else "u", like=pairs.select("u", "v") if end == "u" else None)
    n_u, n_v = F.col("n_u"), F.col("n_v")
    return pairs.filter(_similar(_at_most(SKETCH, [n_u, n_v]), n_u, n_v, percent)).select("u", "v")


def link_nodes(
    nodes: DataFrame, find_sets: Callable[[DataFrame], DataFrame], percent: int, sketched: bool = False, width: int = 8
) -> DataFrame:
    """(node, component) of all nodes that are linked: 100 * intersection >= percent * union of their sets.

    nodes has node, the size n of its set, and keys; nodes that have a key in
    common share a bucket, and links between nodes that share none are not
    looked for. ``find_sets`` gives (node, set) of the nodes of its argument,
    a set as its sorted elements of ``width`` bytes each (8 where there are
    no sketches). With ``sketched`` nodes also have the marks of their whole
    sets, and pairs that these rule out are not compared.

    Each bucket has a stand-in: the member whose buckets hold most nodes,
    which in a group of edited copies is the text that they come from or one
    close to it.

    1. Every node is compared on full sets with the stand-ins of its buckets,
       and components are formed from the links.
    2. In buckets that still hold several components, nodes outside the
       stand-in's component are compared with nodes of other ones if an upper
       bound of the intersection allows a link. The bound is exact, so no
       link between nodes that share a bucket is left out, while pairs of a
       group that are linked through its stand-in, or cannot be linked, are
       never formed.

    A bucket or a stand-in may hold any share of the rows: joins are salted.
    """
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "similar-sizes")
    counts = sizes.select("key", F.col("size").alias("n"))
    shared = materialize(salted_join(keys, sizes, "key", "node", counts=counts), "similar-shared")
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    central = F.max(F.struct("company", F.xxhash64("node").alias("draw"), "node", "n"))
    stand_ins = shared.join(company, "node").groupBy("key").agg(central.alias("c"))
    stand_ins = stand_ins.select("key", F.col("c.node").alias("stand_in"), F.col("c.n").alias("n_home"))
    members = materialize(salted_join(shared, stand_ins, "key", "node", counts=counts), "similar-members")
    discard(shared, sizes)

    alike = 100 * F.least("n", "n_home") >= percent * F.greatest("n", "n_home")
    pairs = members.filter((F.col("node") != F.col("stand_in")) & (alike if sketched else F.lit(True)))
    pairs = materialize(pairs.select(F.col("node").alias("u"), F.col("stand_in").alias("v")).distinct(), "similar-stars")
    if sketched:
        pairs = materialize(_sketched(pairs, nodes, percent), "similar-stars")
    sets = find_sets(members)
    free_shuffles(nodes.sparkSession)
    compared = materialize(_compared(pairs, sets, marks=not sketched, width=width), "similar-compared")
    parts = materialize(connected_components(_linked(compared, percent)), "similar-parts")

    mixed = _mixed(members, parts)
    across = _across_sketched(mixed, nodes, percent) if sketched else _across(mixed, compared, percent)
    across = materialize(across, "similar-across")
    more = materialize(_linked(_compared(across, sets, width=width), percent), "similar-links")
    if not more.isEmpty():
        edges = parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        parts = materialize(connected_components(edges), "similar-parts")
    discard(members, compared, across, sets)
    free_shuffles(nodes.sparkSession)
    return parts
