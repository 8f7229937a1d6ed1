"""Document fingerprints: chains of content words that follow common words.

Fingerprints are compared by pruned Jaccard similarity. Sets are partitioned
by their length, as similar sets have similar lengths, and within neighbouring
partitions only those meet that share one of their rarest signatures.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.batches import bound_batches, map_batches
from granary.llm.similar import SKETCH, link_nodes, set_marks
from granary.llm.skew import salted_join
from granary.scratch import discard, materialize

# Common words of English, French, German and Spanish that anchor signatures.
ANCHORS = frozenset(
    """
    the of and to in is was for that it with on as by at from are this be an
    le la les de des du un une et en que qui dans pour sur est pas au aux elle
    der die das und den von zu mit ist im für nicht ein eine auf dem des als auch sich
    el los las del que y en un una por con para es se no lo como más su al
    """.split()
)
#: Content words in a chain.
CHAIN = 2
#: Words in a plain run, and words for each signature above which runs are added.
PLAIN_RUN = 3
SPARSE = 20
#: Documents are alike if their signatures are, in percent.
ALIKE = 80
#: Cells of the table that tells frequent signatures from rare ones.
CELLS = 1 << 17

_TOKEN = re.compile(r"[^\W_]+")


def signatures(text: str) -> set[int]:
    """32-bit hashes of the spot signatures of a text.

    A signature is a common word with the next CHAIN other words. A text with
    fewer than one in SPARSE words also has all runs of PLAIN_RUN words, one
    without words itself, and the empty text none, so that texts without
    common words differ too.
    """
    words = _TOKEN.findall(text.lower())
    digest = xxhash.xxh32_intdigest
    content = [i for i, w in enumerate(words) if w not in ANCHORS]
    found = set()
    if len(content) < len(words):
        at, last = 0, len(content)
        for i, word in enumerate(words):
            if at < last and content[at] == i:
                at += 1
            elif at < last:
                found.add(digest(" ".join([word, *(words[j] for j in content[at : at + CHAIN])])))
    if len(found) * SPARSE < len(words):
        runs = max(1, len(words) - PLAIN_RUN + 1)
        found |= {digest(" ".join(words[i : i + PLAIN_RUN])) for i in range(runs)}
    if not found and text:
        found = {digest(text)}
    return found


def sorted_signatures(found: set[int]) -> np.ndarray:
    return np.sort(np.fromiter(found, dtype=np.uint32, count=len(found)))


def fingerprint(found: set[int]) -> str:
    """The signatures in order, eight hex digits each."""
    return sorted_signatures(found).astype(">u4").tobytes().hex()


def _digest(found: set[int]) -> bytes:
    return xxhash.xxh3_128_digest(sorted_signatures(found).tobytes())


def likeness(one: set[int], two: set[int]) -> float:
    """Jaccard similarity; two empty sets are alike."""
    if not one and not two:
        return 1.0
    both = len(one & two)
    return both / (len(one) + len(two) - both)


def edited_text(text: str, following: str) -> str:
    """text with its last quarter (code points, rounded down) replaced by as many, or all, from the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def _ranges(docs: DataFrame) -> tuple[list[float], dict[int, int], dict[int | None, int]]:
    """Cuts of doc_id into ranges, the range before each range, and by first doc_id the range it begins.

    As many ranges as four times the shuffle partitions; the driver holds one
    cut and one doc_id for each.
    """
    spark = docs.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", shares, 0.25 / wanted)))
    place = _range_udf(cuts)
    firsts = docs.select("doc_id").groupBy(place("doc_id").alias("range")).agg(F.min("doc_id").alias("first")).collect()
    order = sorted(r["range"] for r in firsts)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    return cuts, before, {r["first"]: r["range"] for r in firsts}


def _range_of(cuts: list[float], doc_id) -> int:
    return len(cuts) + 1 if doc_id is None else bisect_right(cuts, float(doc_id))


def _range_udf(cuts: list[float]):
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        missing = ids.isna().to_numpy()
        out = np.searchsorted(np.array(cuts), ids.fillna(0).to_numpy(dtype=np.float64), side="right")
        return pd.Series(np.where(missing, len(cuts) + 1, out).astype(np.int32))

    return place


def fingerprint_neighbours(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text) and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, group_id. The next document is by ascending doc_id
    (nulls last, ties by text); after the last comes the first. Null texts are
    empty. Two empty fingerprints have likeness 1. Repeated rows follow each
    other. An empty table gives an empty result. group_id is that of
    ``groups`` (see ``document_groups``), and doc_id where there is none.

    Texts are shuffled once, to ranges of doc_id. The first document of each
    range also goes to the range before, as the follower of its last one.
    """
    bound_batches(docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, before, firsts = _ranges(docs.select("doc_id"))

    @F.pandas_udf("array<struct<range:int,follower:boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        out = []
        for doc_id in ids.astype(object).where(ids.notna(), None):
            doc_id = None if doc_id is None else int(doc_id)
            own = _range_of(cuts, doc_id)
            to = [{"range": own, "follower": False}]
            if firsts.get(doc_id, -1) == own:
                to.append({"range": before[own], "follower": True})
            out.append(to)
        return pd.Series(out)

    order = ["range", "follower", "doc_id", "is_text", "text", "digest", "group_id"]
    placed = texts.withColumn("place", F.explode(places("doc_id"))).select(
        "place.range", "place.follower", "doc_id", F.lit(True).alias("is_text"), "text", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("group_id")
    )
    if groups is not None:
        own = groups.withColumn("place", places("doc_id")[0])
        placed = placed.unionByName(
            own.select("place.range", F.lit(False).alias("follower"), "doc_id", F.lit(False).alias("is_text"), F.lit("").alias("text"), "digest", "group_id").select(order)
        )
    ordered = placed.repartition("range").sortWithinPartitions("range", "follower", F.col("doc_id").asc_nulls_last(), "is_text", "text")

    def start():
        waiting = None  # (doc_id, text, signatures, group_id) of the document whose next one is to come
        known: tuple[int | None, dict] = (None, {})  # a doc_id, and the group of each of its fingerprints

        def finished(following: tuple) -> dict:
            doc_id, text, own, group = waiting
            edited = edited_text(text, following[1])
            changed = own if edited == text else signatures(edited)
            return {
                "doc_id": doc_id,
                "n_chars": len(text),
                "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
                "fingerprint": fingerprint(own),
                "edited_fingerprint": fingerprint(changed),
                "near_edited": likeness(own, changed),
                "near_next": likeness(own, following[2]),
                "group_id": group,
            }

        def step(batch):
            nonlocal waiting, known
            if batch is None:
                return
            out = []
            rows = zip(*(batch[c] for c in ("doc_id", "follower", "is_text", "text", "digest", "group_id")), strict=True)
            for doc_id, follower, is_text, text, digest, group in rows:
                if not is_text:
                    if known[0] != doc_id:
                        known = (doc_id, {})
                    known[1][bytes(digest)] = group
                    continue
                if follower and waiting is None:
                    continue
                own = signatures(text)
                mine = known[1].get(_digest(own), doc_id) if known[1] and known[0] == doc_id else doc_id
                row = (doc_id, text, own, mine)
                if waiting is not None:
                    out.append(finished(row))
                waiting = None if follower else row
            if out:
                yield {k: [r[k] for r in out] for k in out[0]}

        return step

    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, group_id bigint"
    )
    return map_batches(ordered, schema, start)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n and set of every text with signatures; a set as its sorted signatures of four bytes each."""

    def start():
        def step(batch):
            if batch is None:
                return
            found = [(d, sorted_signatures(signatures(t or ""))) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
            found = [(d, x) for d, x in found if len(x)]
            packed = [x.tobytes() for _, x in found]
            yield {
                "doc_id": [d for d, _ in found],
                "digest": list(map(xxhash.xxh3_128_digest, packed)),
                "n": [len(x) for _, x in found],
                "set": packed,
            }

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, digest binary, n int, set binary", start)


def _unpacked(blobs: list) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint32) for b in blobs]


def _often(classes: DataFrame) -> np.ndarray:
    """How many classes have a signature of each cell; the driver gets CELLS numbers."""

    def start():
        total = np.zeros(CELLS, dtype=np.int64)

        def step(batch):
            nonlocal total
            if batch is None:
                cells = np.flatnonzero(total)
                yield {"cell": cells, "n": total[cells]}
                return
            sets = _unpacked(batch["set"])
            if sets:
                total += np.bincount(np.concatenate(sets) % CELLS, minlength=CELLS)
            yield from ()

        return step

    counts = map_batches(classes.select("set"), "cell bigint, n bigint", start)
    found = counts.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, dtype=np.int64)
    out[found["cell"].to_numpy(dtype=np.int64)] = found["n"].to_numpy()
    return out


def length_partitions(percent: int, longest: int = 1 << 31) -> np.ndarray:
    """The least length of each partition: a set and one that may be ``percent`` alike are in the same or in neighbouring ones."""
    least = [1]
    while least[-1] < longest:
        least.append(least[-1] * 100 // percent + 1)
    return np.array(least)


def _keyed(classes: DataFrame, percent: int) -> DataFrame:
    """(node, n, keys, marks): a key for each of a set's rarest signatures in its own length partition and in the next.

    Sets that have o signatures in common share one of their first n - o + 1
    in any fixed order of all signatures; the order is by the counts of their
    cells, then by value. Of two that are ``percent`` alike, o is at least
    ``percent`` of each, and at least 2 percent / (100 + percent) of the
    smaller one's n. In the next partition a set meets none that is smaller,
    so it needs fewer keys there than in its own.
    """
    shared = classes.sparkSession.sparkContext.broadcast(_often(classes))
    partitions = length_partitions(percent)
    names = {name: i for i, name in enumerate(SKETCH)}

    def keys(found: np.ndarray) -> np.ndarray:
        n = len(found)
        order = np.lexsort((found, shared.value[found % CELLS]))
        own = int(np.searchsorted(partitions, n, side="right"))
        shared_least = (own, -(-percent * n // 100)), (own + 1, -(-2 * percent * n // (100 + percent)))
        both = np.concatenate([found[order[: n - o + 1]].astype(np.uint64) << np.uint64(32) | np.uint64(p) for p, o in shared_least])
        both = (both ^ (both >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (both ^ (both >> np.uint64(29))).view(np.int64)

    def start():
        def step(batch):
            if batch is None:
                return
            sets = _unpacked(batch["set"])
            marks = [set_marks(x.astype(np.uint64) << np.uint64(7)) for x in sets]
            out = {"node": batch["node"], "n": list(map(len, sets)), "keys": list(map(keys, sets))}
            yield out | {name: [m[i] for m in marks] for name, i in names.items()}

        return step

    marks = ", ".join(f"{name} bigint" for name in SKETCH)
    return map_batches(classes.select("node", "set"), f"node bigint, n bigint, keys array<bigint>, {marks}", start)


def document_groups(docs: DataFrame, percent: int = ALIKE) -> DataFrame:
    """(doc_id, digest, group_id) of the documents whose group has a smaller doc_id than theirs.

    Two documents are linked if the Jaccard similarity of their signatures is
    ``percent`` or more; group_id is the smallest doc_id that links reach
    (nulls count as largest). digest tells the fingerprints of a repeated
    doc_id apart. Texts without signatures (null and empty ones) are linked
    with nothing. Repeated rows give one row. An empty table gives an empty
    result.

    Documents with equal fingerprints are one class. ``link_nodes`` compares
    classes that share a key of ``_keyed``, so no link is left out, and pairs
    that sizes or sketches rule out are pruned before their sets are read. A
    fingerprint, a signature or a group may hold any share of the rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent is in (0, 100]")
    signed = materialize(_signed(docs), "spots-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("source")
    classes = signed.groupBy("digest").agg(first, F.first("set").alias("set")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "spots-classes")
    ids = materialize(signed.select("doc_id", "digest").distinct(), "spots-ids")
    discard(signed)
    nodes = materialize(_keyed(classes, percent), "spots-nodes")

    def find_sets(members: DataFrame) -> DataFrame:
        return materialize(classes.select("node", "set").join(members.select("node").distinct(), "node", "left_semi"), "spots-sets")

    parts = link_nodes(nodes, find_sets, percent, sketched=True, width=4)
    linked = classes.select("node", "source", "digest").join(parts, "node", "left")
    linked = materialize(linked.select("source", "digest", F.coalesce("component", "node").alias("component")), "spots-linked")
    smallest = linked.groupBy("component").agg(F.min("source")["doc_id"].alias("group_id"))
    found = salted_join(linked, smallest, "component", "digest").select(F.xxhash64("digest").alias("key"), F.col("digest").alias("same"), "group_id")
    keyed = ids.withColumn("key", F.xxhash64("digest"))
    out = salted_join(keyed, found, "key", "doc_id", F.col("digest") == F.col("same"))
    out = materialize(out.filter(~F.col("doc_id").eqNullSafe(F.col("group_id"))).select("doc_id", "digest", "group_id"), "spots-groups")
    discard(classes, ids, nodes, linked, parts)
    return out
