"""Secret scans with multipart credential linking, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.text import between, cells, given, regex_spans, running_ends
from granary.scratch import with_row_id

# The base kinds, in the order that breaks ties of start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_ASSIGNED = 8

# Weak candidates: reported only beside complementary parts.
IDENTIFIER = r"""(?i)\b(?:user(?:name)?|login|client[_-]?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""(?i)\b(?:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)(?::[a-z]+)*://[^\s"'<>]+"""

#: Two parts are in one scope if their starts are at most this many code points apart.
SCOPE = 256

KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")
PARTS = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "access", "identifier": "access", "endpoint": "endpoint"}
#: A weak kind is reported if for one of these sets all parts are in its scope.
COMPLEMENTS = {"identifier": (("secret",),), "opaque": (("access",), ("endpoint",)), "endpoint": (("access", "secret"),)}
_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    found = regex_spans(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["match"]))
    return F.transform(
        found, lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("rank"), s["end"])
    ).cast(_SPAN)


def base_spans(text: Column) -> Column:
    """Base spans as array<struct<start, rank, end>>, sorted by start, then kind.

    A run of 32 or more hex digits, or AKIA and 12 or more of its characters,
    is the leftmost greedy match that is long enough, so the length is part
    of those patterns. A short assigned value uses its match up and is dropped.
    """
    assign = _spans(text, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGNED)
    return F.sort_array(F.concat(assign, _spans(text, "access", ACCESS), _spans(text, "hex", HEX)))


def weak_spans(text: Column) -> Column:
    opaque = _spans(
        text, "opaque", OPAQUE, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
    )
    return F.concat(
        _spans(text, "identifier", IDENTIFIER), opaque, _spans(text, "endpoint", ENDPOINT)
    )


def linked_spans(rows: DataFrame, rid: str) -> DataFrame:
    """Weak spans whose scope holds complementary parts: one row (rid, linked) per row that has any.

    An interval join on cells of SCOPE code points. Each cell first keeps, for
    its neighbours, only the nearest start of each part, so a text with many
    parts gives rows in proportion to them, never their pairs.
    """
    part = F.create_map(*[F.lit(x) for k in KINDS for x in (KINDS.index(k), PARTS[k])])
    parts = (
        rows.filter(F.size("weak") > 0)
        .select(F.col(rid).alias("rid"), F.explode(F.concat("base", "weak")).alias("span"))
        .select(
            "rid",
            "span",
            F.element_at(part, F.col("span.rank")).alias("part"),
            F.floor(F.col("span.start") / SCOPE).alias("cell"),
        )
    )
    side = F.col("at") - F.col("cell")
    start = F.col("span.start")
    near = parts.withColumn("at", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    nearest = []
    for name in ("secret", "access", "endpoint"):
        is_part = F.col("part") == name
        nearest += [
            F.max(F.when(is_part & (side == 1), start)).alias(f"{name}_before"),
            F.max(is_part & (side == 0)).alias(f"{name}_here"),
            F.min(F.when(is_part & (side == -1), start)).alias(f"{name}_after"),
        ]
    index = near.groupBy(F.col("rid").alias("r"), "at").agg(*nearest)

    def in_scope(name: str) -> Column:
        return (
            F.col(f"{name}_here")
            | F.coalesce(start - F.col(f"{name}_before") <= SCOPE, F.lit(False))
            | F.coalesce(F.col(f"{name}_after") - start <= SCOPE, F.lit(False))
        )

    reported = F.lit(False)
    for kind, sets in COMPLEMENTS.items():
        for names in sets:
            all_there = F.lit(True)
            for name in names:
                all_there = all_there & in_scope(name)
            reported = reported | ((F.col("span.rank") == KINDS.index(kind)) & all_there)
    weak = parts.filter(F.col("span.rank") >= KINDS.index("identifier"))
    return (
        weak.join(index, (F.col("rid") == F.col("r")) & (F.col("cell") == F.col("at")))
        .filter(reported)
        .groupBy("rid")
        .agg(F.collect_list("span").alias("linked"))
    )


def scan_documents(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Each row of docs (its ``carry`` columns, or all) as a struct ``doc``, with its ``base`` and ``spans``.

    Both are array<struct<start, rank, end>> in code points, end exclusive,
    sorted by start and kind (``KINDS[rank]``); spans has the base spans and
    the weak ones that linking reports. docs needs text; null texts are empty
    and have no spans. Repeated rows are scanned each for itself. Columns of
    docs keep their values, whatever their names. An empty table gives an
    empty result.
    """
    text = F.coalesce("text", F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc"), text.alias("text"))
    found = packed.select("doc", base_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak"))
    rows, rid = with_row_id(found, "secret-spans")
    linked = linked_spans(rows, rid)
    spans = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(_SPAN))))
    # rows without weak candidates have nothing to be linked and stay where they are
    joined = rows.filter(F.size("weak") > 0).join(linked, F.col(rid) == F.col("rid"), "left")
    alone = rows.filter(F.size("weak") == 0).select("doc", "base", F.col("base").alias("spans"))
    return joined.select("doc", "base", spans.alias("spans")).unionByName(alone)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with every span (sorted by start) replaced by its kind in angle brackets; spans that overlap become one.

    The first span of those that overlap gives the kind. Takes time in
    proportion to the text and the number of spans.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def cut(parts: Column, groups: Column) -> Column:
        pieces = F.transform(groups, lambda g: F.concat(between(parts, g["before"], g["start"]), F.element_at(names, g["rank"] + 1)))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), between(parts, end, F.length(text).cast("long")))

    ends = running_ends(F.transform(spans, lambda s: s["end"]))
    groups = F.filter(
        F.zip_with(spans, ends, lambda s, e: F.struct(s["start"], s["rank"], e.alias("before"))),
        lambda g: g["start"] >= g["before"],
    )
    return F.when(F.size(spans) == 0, text).otherwise(given(cells(text), lambda parts: given(groups, lambda g: cut(parts, g))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars, where there is one, set to the new length of changed texts.

    Null and empty texts and texts without secrets stay as they are, repeated
    rows are changed each for itself, an empty table gives an empty result.
    """
    rows = scan_documents(docs)
    text = redacted(F.col("doc.text"), F.col("spans"))
    out = rows.select("doc", text.alias("clean"), (F.size("spans") > 0).alias("changed"))
    columns = []
    for c in docs.columns:
        old = F.col("doc")[c]
        if c == "text":
            columns.append(F.col("clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return out.select(*columns)
