"""Expressions on texts that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters outside this set.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, BLANK_RUN)).otherwise(
        F.array().cast("array<string>")
    )


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs inside."""
    return F.transform(F.array(value), use)[0]


#: Elements folded at once; folding copies what it has gathered, so long arrays go in blocks.
_BLOCK = 256


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For an array of longs, the array of what ``combine`` makes of 0 and the values before each."""

    def fold(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out")),
            lambda acc, n: F.struct(
                combine(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
        )

    def totals(values: Column) -> Column:
        n_blocks = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), n_blocks - 1), lambda b: fold(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
        )
        return F.when(n_blocks > 0, given(blocks, over_blocks))

    def over_blocks(blocks: Column) -> Column:
        bases = fold(F.transform(blocks, lambda x: x["at"]))["out"]
        return F.flatten(F.zip_with(blocks, bases, lambda x, base: F.transform(x["out"], lambda at: combine(base, at))))

    return F.coalesce(given(values, totals), F.array().cast("array<long>"))


def running_starts(lengths: Column) -> Column:
    """For an array of lengths, the array of their start offsets (exclusive prefix sums)."""
    return _running(lengths, lambda at, n: at + n)


def running_ends(ends: Column) -> Column:
    """For an array of offsets, the greatest offset before each, 0 for the first."""
    return _running(ends, F.greatest)


#: Code points in a cell of a text.
_CELL = 1024


def cells(text: Column) -> Column:
    """The text cut into runs of _CELL code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CELL}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of the text that ``cells`` cut into parts.

    Takes time in proportion to their number, wherever they are, while a
    substring of the text counts its code points from the beginning.
    """
    first, last = F.floor(start / _CELL).cast("int"), F.floor(end / _CELL).cast("int")
    within = lambda cell, at, n: F.substring(F.coalesce(F.get(parts, cell), F.lit("")), at.cast("int"), n.cast("int"))
    one = within(first, start % _CELL + 1, end - start)
    several = F.concat(
        within(first, start % _CELL + 1, F.lit(_CELL)),
        F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        within(last, F.lit(1), end % _CELL),
    )
    return F.when(start >= end, "").when(first == last, one).otherwise(several)


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, match>>.

    Offsets are code points, the end exclusive. Splitting at the pattern gives
    the gaps around the matches, so gap and match lengths add up to offsets.
    """
    gaps = F.split(text, pattern, -1)

    def steps(matches: Column) -> Column:
        return F.zip_with(
            F.slice(gaps, F.lit(1), F.size(matches)),
            matches,
            lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("length"), match.alias("match")),
        )

    def spans(steps: Column) -> Column:
        starts = running_starts(F.transform(steps, lambda s: (s["gap"] + s["length"]).cast("long")))
        return F.zip_with(
            starts,
            steps,
            lambda at, s: F.struct(
                (at + s["gap"]).alias("start"), (at + s["gap"] + s["length"]).alias("end"), s["match"].alias("match")
            ),
        )

    found = given(given(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), steps), spans)
    return F.when(text.rlike(pattern), found).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    )
