"""Near-duplicate groups by MinHash, banding, exact confirmation and connected components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.batches import map_batches
from granary.llm.similar import link_nodes
from granary.llm.skew import key_filter, salted_join, split_by_filter
from granary.scratch import materialize

#: Hash minima per band, and bands. A pair at 0.8 misses all bands once in 7 million.
ROWS = 5
BANDS = 40
SHINGLE_WORDS = 5
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFT = np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: dict, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; of all words, if there are fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(width, len(own))
    mixed = np.full(len(own) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ own[k : k + len(mixed)]) * _MIX[0]
        mixed = (mixed ^ (mixed >> _SHIFT)) * _MIX[1]
    return np.unique(mixed ^ (mixed >> _SHIFT))


def universal_hashes(n: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """n odd multipliers and n offsets of hashes x -> (a x + b) mod 2**64."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, size=n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash over the set, in blocks of bounded memory."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        block = shingles[None, at : at + 512] * a[:, None]
        block += b[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    return least


def band_keys(minima: np.ndarray, rows: int) -> list[int]:
    """One signed 64-bit key per band of ``rows`` minima; the band's number is part of it."""
    bands = minima.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64) * _MIX[2]
    for k in range(rows):
        key = (key ^ bands[:, k]) * _MIX[0]
        key = (key ^ (key >> _SHIFT)) * _MIX[1]
    return (key ^ (key >> _SHIFT)).view(np.int64).tolist()


def _signed(texts: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, text_key, content (a 128-bit digest of the shingle set, null if empty), n_shingles, keys."""

    def start():
        hashes = _WordHashes()
        a, b = universal_hashes(bands * rows)

        def step(batch):
            if batch is None:
                return
            sets = [shingle_set(body, hashes, width) for body in batch["body"]]
            yield {
                "doc_id": batch["doc_id"],
                "text_key": batch["text_key"],
                "content": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "n_shingles": list(map(len, sets)),
                "keys": [band_keys(signature(s, a, b), rows) if len(s) else [] for s in sets],
            }

        return step

    schema = "doc_id bigint, text_key bigint, content binary, n_shingles bigint, keys array<bigint>"
    return map_batches(texts.select("doc_id", "text_key", "body"), schema, start)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, set): the sorted shingles of body, eight bytes each, where their digest is content."""

    def start():
        hashes = _WordHashes()

        def step(batch):
            if batch is None:
                return
            made = [shingle_set(body, hashes, width).tobytes() for body in batch["body"]]
            right = [xxhash.xxh3_128_digest(s) == bytes(c) for s, c in zip(made, batch["content"], strict=True)]
            yield {
                "node": [n for n, ok in zip(batch["node"], right, strict=True) if ok],
                "set": [s for s, ok in zip(made, right, strict=True) if ok],
            }

        return step

    return map_batches(docs, "node bigint, set binary", start)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, body; rows of one doc_id and text_key have one text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.cast("binary").alias("body"))


def _grouped(docs: DataFrame, percent: int, bands: int, rows: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows; the nodes, which are their distinct sets; and (node, component) of the linked nodes."""
    texts = _texts(docs)
    signed = materialize(_signed(texts, bands, rows, width), "minhash-signed")
    source = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = (
        signed.filter("content is not null")
        .groupBy("content")
        .agg(F.min(source).alias("source"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialize(nodes, "minhash-nodes")
    parts = link_nodes(nodes, lambda members: _member_sets(texts, nodes, members, width), percent)
    return signed, nodes, parts


def near_groups(
    docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE_WORDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Two documents are linked if 100 * intersection >= percent * union of
    their shingle sets. component_id is the smallest doc_id that links reach;
    kept says that it is the row's own. Texts without words, and null texts,
    have an empty set and are linked with nothing. Repeated rows have the same
    result each; a null doc_id is larger than all others. An empty table gives
    an empty result.

    Rows with equal sets are one node. Nodes share a bucket if a band of their
    signatures agrees; ``link_nodes`` finds the links of nodes that do. A
    component or a set may hold any share of the rows: joins on them are
    salted.
    """
    signed, nodes, parts = _grouped(docs, percent, bands, rows, width)
    linked = materialize(parts.join(nodes.select("node", "source"), "node"), "minhash-placed")
    smallest = linked.groupBy("component").agg(F.min("source")["doc_id"].alias("component_id"))
    found = salted_join(linked.select("node", "component"), smallest, "component", "node").select("node", "component_id")
    by_content = nodes.join(found, "node", "left").select(
        F.xxhash64("content").alias("digest"),
        F.col("content").alias("same"),
        F.when(F.col("component_id").isNull(), F.col("source.doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    filled = signed.filter("content is not null").select("doc_id", "n_shingles", "content", F.xxhash64("content").alias("digest"))
    counts = nodes.select(F.xxhash64("content").alias("digest"), F.col("rows").alias("n"))
    same = F.col("content") == F.col("same")
    out = salted_join(filled, by_content, "digest", F.monotonically_increasing_id(), same, counts=counts)
    out = out.select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("content is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _member_sets(texts: DataFrame, nodes: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(node, set) of the nodes that share a bucket, from the text of one document of each.

    The sets are made again from these texts alone, which is less to keep than
    the sets of all documents.
    """
    wanted = members.select("node").distinct().join(nodes.select("node", "content", "source"), "node")
    wanted = materialize(wanted, "minhash-wanted")
    ids = wanted.select("node", "content", F.col("source.doc_id").alias("id"), F.col("source.text_key").alias("key"))
    words = materialize(key_filter(ids.select("key")), "minhash-filter")
    likely, _ = split_by_filter(texts, F.col("text_key"), words)
    joined = likely.join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    sets = materialize(_sets(joined.select("node", "content", "body"), width), "minhash-sets")
    if sets.count() > wanted.count():  # rows that are repeated as a whole
        sets = materialize(sets.groupBy("node").agg(F.first("set").alias("set")), "minhash-sets")
    return sets


def keep_one(
    docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE_WORDS
) -> DataFrame:
    """docs without all but one row of each group of linked documents (see ``near_groups``).

    The row with the smallest doc_id stays (nulls last; then by a hash of the
    text; of rows that agree in both, any one). Rows without words are groups
    of their own and all stay. Columns keep their values, whatever their
    names. An empty table gives an empty result.
    """
    signed, nodes, parts = _grouped(docs, percent, bands, rows, width)
    placed = nodes.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component"), "source", "rows")
    groups = placed.groupBy("component").agg(F.min("source").alias("source"), F.sum("rows").alias("rows"))
    kept = groups.filter("rows > 1").select(F.col("source.doc_id").alias("kept_id"), F.col("source.text_key").alias("kept_key"))
    text = F.coalesce("text", F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(text).alias("key"))
    # rows that are alone in their group stay where they are; only the others are shuffled
    linked = nodes.filter("rows > 1").select("content").unionByName(nodes.join(parts, "node", "left_semi").select("content"))
    suspects = materialize(signed.join(linked.distinct(), "content", "left_semi").select("doc_id", F.col("text_key").alias("key")).distinct(), "minhash-suspects")
    words = materialize(key_filter(suspects.select("key")), "minhash-filter")
    likely, alone = split_by_filter(packed, F.col("key"), words)
    of_suspects = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("suspect_key"))
    marked = likely.join(suspects.withColumnRenamed("key", "suspect_key"), of_suspects, "left")
    of_kept = F.col("doc.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key"))
    rows = marked.filter("suspect_key is not null").drop("doc_id", "suspect_key").join(kept, of_kept, "left_semi")
    same = Window.partitionBy("doc.doc_id", "key").orderBy(F.xxhash64("doc"))
    rows = rows.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")
    rows = rows.unionByName(marked.filter("suspect_key is null").drop("doc_id", "suspect_key")).unionByName(alone)
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns])
