"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Divisions of a shard within which slots are numbered; each is one window group.
SLOT_BUCKETS = 1024


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest weighted score for the key.

    Every shard draws a number in (0, 1) from the key and its own index; the
    score is -weight / ln(draw). Adding a shard changes only the keys that it
    wins, and a shard's share follows its weight. Null keys hash like any
    other key.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")

    def score(shard: int) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        draw = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weights[shard])) / F.ln(draw)).alias("score"), F.lit(shard).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return F.greatest(*[score(i) for i in range(len(weights))])["shard"]


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    weights: Sequence[float] | None = None,
    slot_buckets: int = SLOT_BUCKETS,
) -> DataFrame:
    """One row per document: its shard, its slot in the shard, and its shard after one more is added.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law
    ('key'), shard, slot, grown_shard. The shard depends on doc_id and the
    shard count alone. Slots run from 0 without gaps. A null text has no
    bytes: size 8, checksum 0. Repeated rows share a shard and take a slot
    each. An empty table gives an empty result. Other columns are ignored.

    Slots are numbered inside hash divisions of each shard, on top of the
    row counts of the divisions before, so no task holds a whole shard. The
    broadcast counts have at most shards * slot_buckets rows.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight per shard is needed")
    key = F.col("doc_id")
    place = [
        rendezvous_shard(key, weights).alias("shard"),
        F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(slot_buckets)).cast("int").alias("division"),
    ]
    before = Window.partitionBy("shard").orderBy("division").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        docs.select(*place)
        .groupBy("shard", "division")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("shard", "division", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *place,
        rendezvous_shard(key, [*weights, max(weights)]).alias("grown_shard"),
    )
    order = Window.partitionBy("shard", "division").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(offsets), ["shard", "division"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("nth") - 1).alias("slot"),
            "grown_shard",
        )
    )
