"""Joins whose key may hold any share of the rows, and joins that concern few rows of a wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, so there are fewer hot keys than SHARE.
SHARE = 1024
#: Fewer rows than this are never dealt out.
LEAST = 400


def _hot_keys(counts: DataFrame, key: str, total: int) -> list[tuple[int, int]]:
    """(key, salts) of the hot keys of counts (key, n): fewer than SHARE of them, whatever the total."""
    most = max(LEAST, -(-total // SHARE))
    return [(r[key], -(-r.n // most)) for r in counts.filter(F.col("n") > most).collect()]


def salted_join(
    many: DataFrame,
    few: DataFrame,
    key: str,
    spread: str | Column,
    condition: Column | None = None,
    like: DataFrame | None = None,
    counts: DataFrame | None = None,
    how: str = "inner",
    total: int | None = None,
) -> DataFrame:
    """Inner join (or, without a condition, left join) of many and few on ``key`` (a long in both), whatever share of many's rows one key holds.

    The rows of a hot key are dealt by the hash of ``spread`` to as many salts
    as leave a 1024th of many to each; few's rows of that key are copied to
    its salts. All other rows have salt 0 and are joined as usual. The table
    of hot keys is broadcast and has fewer than SHARE rows. Null keys match
    nothing; either table may be empty. ``like`` has many's keys, row for
    row, or ``counts`` (key, n) their numbers, where these are cheaper to get;
    ``total`` is about the number of many's rows, if that is known.
    """
    keyed = (many if like is None else like).select(key)
    if total is None:
        total = keyed.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = _hot_keys(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts, key, total)
    if hot:
        values = ", ".join(f"({k}L, {n})" for k, n in hot)
        salts = F.broadcast(many.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({key}, __salts)"))
        n = F.coalesce("__salts", F.lit(1))
        many = many.join(salts, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), n).cast("int")).drop("__salts")
        few = few.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__salts")
    keys = [key, "__salt"] if hot else [key]
    if condition is None:
        return many.join(few, keys, how).drop("__salt")
    other = few
    for k in keys:
        other = other.withColumnRenamed(k, f"{k}_few")
    same = condition
    for k in keys:
        same = (F.col(k) == F.col(f"{k}_few")) & same
    return many.join(other, same).drop("__salt", *[f"{k}_few" for k in keys])


#: Bits of a filter of keys, in words of 64: at most 2**18 rows, whatever the number of keys.
FILTER_BITS = 24


def _place(key: Column) -> tuple[Column, Column]:
    """The word of a key, and its bit in it."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).cast("int")
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))


def key_filter(keys: DataFrame) -> DataFrame:
    """A filter of the keys (a column ``key`` of longs): one bit for each, as a small table of words.

    It lets every key pass that is among them, and others the more often the
    more there are: a filter of a million keys lets 6 % pass, one of very many
    all, which costs the shuffle that it is there to save and nothing else.
    """
    word, bit = _place(F.col("key"))
    words = keys.select(word.alias("__word"), bit.alias("bit"))
    return words.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))


def split_by_filter(rows: DataFrame, key: Column, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among those of a filter, and rows whose key is not. Nothing is shuffled."""
    word, bit = _place(key)
    flagged = rows.withColumn("__word", word).join(F.broadcast(words), "__word", "left")
    there = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return tuple(flagged.filter(test).drop("__word", "__bits") for test in (there, ~there))
