"""Quality rules: per-text counts and cross-document line frequency, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.skew import key_filter, salted_join, split_by_filter
from granary.llm.text import BLANKS, words
from granary.scratch import discard, free_name, free_shuffles, materialize

#: Words of a repeated window.
WINDOW = 5
#: A line is common on a host if more different documents than this have it, however large the host.
MOST_DOCUMENTS = 10
#: A document is depleted if a smaller share of its words is left without common lines.
MIN_SHARE_LEFT = 0.2
SYMBOLS = "#*$%&|<>"


def _positions_in_repeats() -> Column:
    """From window_hashes: the sorted first-word positions of windows that occur twice or more, or null.

    Windows are compared by 64-bit hashes within one text. Sorting (hash,
    position) puts equal windows side by side.
    """
    at = F.col("by_hash")
    twice = F.transform(
        at,
        lambda w, k: F.when(
            F.coalesce(w["hash"] == F.get(at, k - 1)["hash"], F.lit(False))
            | F.coalesce(w["hash"] == F.get(at, k + 1)["hash"], F.lit(False)),
            w["position"],
        ),
    )
    return F.sort_array(F.filter(twice, lambda p: p.isNotNull()))


def measured(docs: DataFrame, carry: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Each row (its ``carry`` columns, or all but key) as a struct ``doc`` with text_key, the base counts and its lines as array<struct<hash, words>>.

    Null texts have no words and no lines. A line is a part between ``\\n``
    that has a word; lines are hashed after trimming, lower-casing and
    replacing digits by 0.
    """
    kept = carry or [c for c in docs.columns if c != key]
    text = F.coalesce("text", F.lit(""))
    own_key = F.col(f"`{key}`") if key else F.lit(0).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), own_key.alias("text_key"), text.alias("body"))
    rows = rows.select("doc", "text_key", "body", words(F.col("body")).alias("words"), _with_words(F.col("body")).alias("lines"))
    word = F.col("words")
    windows = F.when(
        F.size(word) > WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(word) - WINDOW), lambda i: F.xxhash64(*[word[i + k] for k in range(WINDOW)])
        ),
    )
    rows = rows.select(
        "doc",
        "text_key",
        F.size(word).cast("long").alias("n_words"),
        F.length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("window_hashes"),
        F.transform(
            "lines", lambda line: F.struct(F.xxhash64(_normal(line)).alias("hash"), F.size(words(line)).alias("words"))
        ).alias("lines"),
    )
    hashes = F.col("window_hashes")
    rows = rows.withColumn(
        "by_hash",
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("position")))),
        ),
    ).drop("window_hashes")
    rows = rows.withColumn("repeats", F.when(F.col("by_hash").isNotNull(), _positions_in_repeats())).drop("by_hash")
    starts = F.col("repeats")
    covered = F.aggregate(
        F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1), p + WINDOW) - p)),
        F.lit(0),
        lambda total, n: total + n,
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("repeats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # a filter on the result must not be pushed below: it would repeat the expressions above inside each other
    return rows.withColumns({"base_failed": failed, "at": F.monotonically_increasing_id()})


def _normal(line: Column) -> Column:
    """A line as it is compared: trimmed, lower-cased, digits replaced by 0."""
    return F.translate(F.lower(F.btrim(line, F.lit(BLANKS))), "123456789", "000000000")


def _with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def _text_key(host: str) -> Column:
    """A hash of a row's host and text: rows that agree in both have the same common lines."""
    return F.xxhash64(F.lit("text"), F.col(f"`{host}`").isNull(), F.col(f"`{host}`"), F.coalesce("text", F.lit("")))


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """(key, host, hash, identity, line) of every line: of its text and host, its own, of all lines of the text, and of host and line."""
    hashes = F.transform(_with_words(F.coalesce("text", F.lit(""))), lambda line: F.xxhash64(_normal(line)))
    rows = docs.select(_text_key(host).alias("key"), F.col(f"`{host}`").alias("host"), hashes.alias("hashes"))
    rows = rows.select("key", "host", F.xxhash64("hashes").alias("identity"), F.explode(F.array_distinct("hashes")).alias("hash"))
    return rows.withColumn("line", F.xxhash64("host", "hash"))


def common_lines(lines: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, hash, line) of lines that more than ``most`` different documents of the host have.

    Documents are told apart by a digest of all their normalised lines, so
    exact copies count once and copying alone makes no line common; texts that
    differ in a line are different documents. Equal (host, hash, identity) are
    combined before they are counted.
    """
    seen = lines.select("host", "hash", "line", "identity").distinct()
    counts = seen.groupBy("host", "hash", "line").agg(F.count(F.lit(1)).alias("documents"))
    return counts.filter(F.col("documents") > most).drop("documents")


def _keys_of(keyed: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """The keys of rows that pass a filter, without anything else of them."""
    return split_by_filter(keyed.select(F.col(key).alias("text_key")), F.col("text_key"), words)[0]


def judge_documents(docs: DataFrame, host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Each row of docs (its ``carry`` columns, or all; host is among them) as a struct ``doc`` with base counts, base_failed, words_left, common (line hashes), kept, and ``at``, a number.

    Common lines of a row's host are taken out; a row that keeps less than
    MIN_SHARE_LEFT of its words is depleted, so a short text with one common
    line is not. kept is false for base failures and depleted rows. A null host is a host of its
    own. Each row is a document; repeated rows do not make a line common. An
    empty table gives an empty result. A line or a host may hold any share of
    the rows.
    """
    found = materialize(_lines(docs, host), "quality-lines")
    common = materialize(common_lines(found), "quality-common").toDF("common_host", "common_hash", "line")
    same = F.col("host").eqNullSafe(F.col("common_host")) & (F.col("hash") == F.col("common_hash"))
    removed = salted_join(found, common, "line", "key", same).groupBy("key").agg(F.collect_set("hash").alias("common"))
    removed = materialize(removed, "quality-removed")
    discard(found)
    free_shuffles(docs.sparkSession)
    # texts without a common line stay where they are; only the others meet theirs in a shuffle
    keyed = docs.withColumn(key := free_name(docs, "text_key"), _text_key(host))
    words = materialize(key_filter(removed.select("key")), "quality-filter")
    likely, clean = split_by_filter(keyed, F.col(key), words)
    likely, clean = (measured(part, carry, key) for part in (likely, clean))
    copies = salted_join(likely, removed.withColumnRenamed("key", "text_key"), "text_key", F.monotonically_increasing_id(), like=_keys_of(keyed, key, words), how="left")
    judged = copies.unionByName(clean.withColumn("common", F.lit(None).cast("array<bigint>")))
    common = F.coalesce("common", F.array().cast("array<bigint>"))
    gone = F.filter("lines", lambda line: F.array_contains(common, line["hash"]))
    words_removed = F.aggregate(gone, F.lit(0), lambda total, line: total + line["words"])
    judged = judged.withColumn("words_removed", F.when(F.size(common) > 0, words_removed))
    left = F.col("n_words") - F.coalesce("words_removed", F.lit(0))
    depleted = left < MIN_SHARE_LEFT * F.col("n_words")
    return judged.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        left.alias("words_left"),
        common.alias("common"),
        "at",
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept rows of docs, without common lines; n_chars, where there is one, follows a changed text.

    Rows with null or empty texts are base failures and go. Repeated rows are
    judged alike and stay or go each for itself. Columns keep their values,
    whatever their names. An empty table gives an empty result.
    """
    rows = judge_documents(docs, host).filter("kept and at >= 0")
    common = F.col("common")
    text = F.when(F.size(common) == 0, F.col("doc.text")).otherwise(
        F.array_join(
            F.filter(F.split("doc.text", "\n"), lambda line: ~F.array_contains(common, F.xxhash64(_normal(line)))), "\n"
        )
    )
    rows = rows.select("doc", text.alias("clean"), (F.size(common) > 0).alias("changed"))
    columns = []
    for c in docs.columns:
        old = F.col("doc")[c]
        if c == "text":
            columns.append(F.col("clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return rows.select(*columns)
