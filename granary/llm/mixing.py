"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.text import count_words
from granary.scratch import free_name, materialize, with_row_id

#: Rows of one source that are put in order in one window group, about.
ROWS_PER_GROUP = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """source, source_size, rank, target from rows of (source, size).

    Sources in code-point order, null last, weigh the given weights in turn
    and share the total of all sizes. A target stops at ``repeats`` times its
    source's size; what is cut off goes to the others by weight until none is
    above. Taking sources by rising (limit / weight), the first that stays
    within its limit fixes the share of itself and all after it.
    """
    ring = F.array(*[F.lit(int(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(ring, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    )
    limit = F.lit(repeats) * F.col("source_size")
    filling = ranked.withColumn("ratio", limit / F.col("weight"))
    earlier = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    filling = filling.withColumns({"left": left, "weight_left": weight_left})
    free = F.col("ratio") * F.col("weight_left") >= F.col("left")
    first_free = F.min(F.when(free, F.struct("ratio", "rank", "left", "weight_left"))).over(everything)
    filling = filling.withColumn("level", first_free)
    capped = F.struct("ratio", "rank") < F.struct(F.col("level.ratio"), F.col("level.rank"))
    target = F.when(F.col("level").isNull() | capped, limit.cast("double")).otherwise(
        F.col("level.left").cast("double") * F.col("weight") / F.col("level.weight_left")
    )
    return filling.select("source", "source_size", "rows", "rank", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """Decide how often each document goes into the mix.

    docs needs doc_id, source and what ``size`` reads (default: the words of
    text). Returns the columns of docs and, under names that avoid theirs,
    size, source_size, target, copies (0 to ``repeats``); their names are in
    ``mix_columns(docs)``.

    Within a source, documents are shuffled by a hash of doc_id. Copy e of a
    document finishes at virtual time (e * source_size + cumulative size) /
    target. All copies are sorted by that time and are taken while their total
    stays within the total size of all documents.

    A null text has size 0, a null source is a source of its own, documents
    of size 0 are never taken, repeated rows count as documents of their own
    (those alike in doc_id, source and size are interchangeable), an empty
    table gives an empty result. Two runs give the same decisions.

    Within a source, copies finish in the order of the shuffle, so for each
    source and copy number the last document that is taken tells all others.
    That table has a row per source, and documents meet it where they are.
    """
    names = mix_columns(docs)
    size = count_words(F.col("text")) if size is None else size
    kept, rid = with_row_id(docs.withColumn(names["size"], size.cast("long")), "mix-docs")
    facts = kept.select(
        "source", F.col(names["size"]).alias("size"), _order(F.col(names["size"]), F.col(rid), seed).alias("order")
    )
    targets = materialize(source_targets(facts, weights, repeats), "mix-targets")
    budget, largest = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.max("rows")).first()
    queued = _queue(facts, targets, max(64, -(-(largest or 0) // ROWS_PER_GROUP)))
    queued = materialize(queued, "mix-queue")
    last = _last_taken(queued, budget, repeats)
    placed = kept.join(last, F.col("source").eqNullSafe(F.col("__source")))
    copies = sum((F.when(_order(F.col(names["size"]), F.col(rid), seed) <= F.col(f"__last{e}"), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    copies = F.when(F.col(names["size"]) > 0, copies).otherwise(0)
    facts = [F.col("__size").alias(names["source_size"]), F.col("__target").alias(names["target"]), copies.cast("int").alias(names["copies"])]
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], names["size"], *facts)


def mix_columns(docs: DataFrame) -> dict[str, str]:
    return {name: free_name(docs, name) for name in ("size", "source_size", "target", "copies")}


def _order(size: Column, rid: Column, seed: str) -> Column:
    """The place of a document in its source's shuffle."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return F.struct(
        F.shiftrightunsigned(draw, 1).alias("unsigned"), draw.alias("draw"), F.col("doc_id").alias("doc_id"), size.alias("size"), rid.alias("rid")
    )


def _queue(facts: DataFrame, targets: DataFrame, groups: int) -> DataFrame:
    """facts with source_size, rank, target and the running size within the shuffled source.

    The order within a source is ``_order``. Equal ranges of draws are window
    groups, each on top of the sizes of the ranges before, so that a source
    with most of the rows is spread over many tasks.
    """
    ranged = facts.withColumn("range", F.floor(F.col("order.unsigned").cast("double") / F.lit(float(1 << 63)) * groups).cast("int"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    sums = sums.select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base")
    )
    t = targets.select(F.col("source").alias("ts"), "source_size", "rank", "target")
    sums = sums.join(t, F.col("s").eqNullSafe(F.col("ts")))
    inside = Window.partitionBy("source", "range").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("inside", F.sum("size").over(inside))
    return running.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).select(
        "source", "order", "size", "source_size", "rank", "target", (F.col("base") + F.col("inside")).alias("running")
    )


def _last_taken(queued: DataFrame, budget: int, repeats: int) -> DataFrame:
    """For each source its size and target, and for each copy the place of the last document of which that copy is taken."""
    copies = _taken(queued, budget, repeats)
    last = [F.max(F.when(F.col("copies") > e, F.col("order"))).alias(f"__last{e}") for e in range(repeats)]
    facts = [F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target")]
    return materialize(queued.withColumn("copies", copies).groupBy(*facts).agg(*last), "mix-last")


def _taken(queued: DataFrame, budget: int, repeats: int) -> Column:
    """How many copies of a row of queued finish before the budget is spent.

    All copies are put in the order of their finish times by a range sort,
    which is written. The totals of its partitions tell in which of them the
    budget ends, and a running total over that one alone tells where.
    """

    def finish(epoch: int) -> Column:
        return (F.lit(epoch) * F.col("source_size") + F.col("running")) / F.col("target")

    def place(epoch: int) -> Column:
        return F.struct(
            finish(epoch).alias("finish"), F.col("rank").alias("rank"), F.col("running").alias("running"), F.lit(epoch).alias("epoch")
        )

    usable = (F.col("size") > 0) & (F.col("target") > 0)
    copies = queued.filter(usable).select("size", F.explode(F.array(*[place(e) for e in range(repeats)])).alias("place"))
    mix = materialize(copies.orderBy("place").withColumn("at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("at", 33)
    totals = mix.groupBy(part.alias("part")).agg(F.sum("size").alias("sum"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    last = totals.withColumn("upto", F.sum("sum").over(upto)).filter(F.col("upto") > budget).orderBy("part").first()
    if last is None:
        return F.when(usable, F.lit(repeats)).otherwise(0)
    ordered = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.lit(last.upto - last.sum) + F.sum("size").over(ordered)
    first_out = mix.filter(part == last.part).withColumn("upto", end).filter(F.col("upto") > budget).orderBy("at").select("place").first().place
    edge = F.struct(
        F.lit(first_out.finish).alias("finish"), F.lit(first_out["rank"]).alias("rank"), F.lit(first_out.running).cast("long").alias("running"), F.lit(first_out.epoch).alias("epoch")
    )
    taken = sum((F.when(place(e) < edge, 1).otherwise(0) for e in range(repeats)), F.lit(0))
    return F.when(usable, taken).otherwise(0)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken.

    Rows with null or empty texts are never taken, repeated rows each for
    itself, an empty table gives an empty mix. Columns keep their values,
    whatever their names.
    """
    names = mix_columns(docs)
    mixed = mix_sources(docs, **options)
    nth = free_name(mixed, "nth")
    repeated = mixed.filter(F.col(names["copies"]) > 0).withColumn(
        nth, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))
    )
    return repeated.select(*docs.columns)
