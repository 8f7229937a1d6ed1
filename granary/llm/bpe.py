"""Byte-level BPE over overlapping chunks of texts."""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.batches import bound_batches
from granary.scratch import free_name, with_row_id

#: Code points of a chunk, and of its overlap with the next; longer texts are cut up.
CHUNK = 32_768
OVERLAP = 1_024
#: A pre-token boundary is certain only this far before the end of a chunk.
LOOKAHEAD = 4
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 100_000

_WORKERS: dict[int, _Worker] = {}


class _Pieces(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, encoding: tiktoken.Encoding):
        self.encoding = encoding

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoding._encode_single_piece(piece.encode())
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 32:
            self[piece] = raw
        return raw


class _Worker:
    """The vocabulary in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]

    def encode(self, pieces) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, raw: bytes) -> bytes:
        ids = memoryview(raw).cast("I") if raw else ()
        return b"".join(map(self.tokens.__getitem__, ids))


class Tokenizer:
    """A rank file of ranks 0, 1, 2, ... and the pattern that splits texts into pre-tokens, shipped to workers by broadcast.

    The driver reads the file itself if it can open it, else through Spark. A
    vocabulary is of fixed size, so its broadcast does not grow with the data.
    """

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        if os.path.exists(ranks_path):
            lines = Path(ranks_path).read_text().splitlines()
        else:
            lines = [row.value for row in spark.read.text(ranks_path).collect()]
        pairs = (line.split() for line in lines if line.strip())
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.shared = spark.sparkContext.broadcast((ranks, pattern))


def _remembered(key: int, shared) -> _Worker:
    """The vocabulary of a broadcast, built once per Python worker."""
    if key not in _WORKERS:
        _WORKERS[key] = _Worker(*shared.value)
    return _WORKERS[key]


def _worker_of(tokenizer: Tokenizer):
    shared, key = tokenizer.shared, tokenizer.shared._jbroadcast.id()
    return lambda: _remembered(key, shared)


_CODED = "struct<ids:binary,decoded:binary>"


def _coded(worker: _Worker, lists_of_pieces) -> pd.DataFrame:
    """Ids of each list of pre-tokens, and the bytes that these ids decode to."""
    ids = [worker.encode(pieces) for pieces in lists_of_pieces]
    return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(map(worker.decode, ids), dtype=object)})


def code_udf(tokenizer: Tokenizer):
    """Text -> ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    Both come from one Python worker, so a task holds the vocabulary once.
    """
    get = _worker_of(tokenizer)

    @F.pandas_udf(_CODED)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = get()
        for texts in batches:
            yield _coded(worker, map(worker.pattern.findall, texts))

    return code.asNondeterministic()


def decode_udf(tokenizer: Tokenizer):
    """Ids as written by encode -> the raw bytes."""
    get = _worker_of(tokenizer)

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker = get()
        for ids in batches:
            yield pd.Series([worker.decode(bytes(raw)) for raw in ids], dtype=object)

    return decode.asNondeterministic()


def boundaries(pattern: regex.Pattern, chunk: str, overlap: int, lookahead: int = LOOKAHEAD) -> tuple[list, list]:
    """Pre-token starts in the first ``overlap`` places of a chunk, and the certain ones in the last.

    A pre-token depends on the text from its start on, and looks at most
    ``lookahead`` - 1 characters past its end, apart from runs of white space.
    So a boundary is certain if the character before it is no white space and
    enough characters follow.
    """
    starts = [m.start() for m in pattern.finditer(chunk)]
    head = list(itertools.takewhile(lambda p: p < overlap, starts))
    first, last = len(chunk) - overlap, len(chunk) - lookahead
    tail = [p for p in starts if first <= p <= last and p and not chunk[p - 1].isspace()]
    return head, tail


def _code_long(docs: DataFrame, tokenizer: Tokenizer, chunk: int, overlap: int, coded: str) -> DataFrame:
    """Texts of several chunks: pre-tokenise chunks, stitch where both sides of an overlap agree, encode, join."""
    get = _worker_of(tokenizer)

    @F.pandas_udf("struct<head:array<bigint>,tail:array<bigint>>")
    def edges(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = get()
        for texts in batches:
            found = [boundaries(worker.pattern, t, overlap) for t in texts]
            yield pd.DataFrame({"head": [h for h, _ in found], "tail": [t for _, t in found]})

    @F.pandas_udf(_CODED)
    def code_between(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        worker = get()
        for texts, begins, ends in batches:
            yield _coded(
                worker,
                (
                    [m[0] for m in worker.pattern.finditer(t) if a <= m.start() < b]
                    for t, a, b in zip(texts, begins, ends, strict=True)
                ),
            )

    def joined(part: str) -> Column:
        """The parts of all chunks in order; as hex, because only strings can be joined in one go."""
        return F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["coded"][part])), "")).alias(part)

    rows, rid = with_row_id(docs, "bpe-long")
    last = F.floor((F.length("text") - overlap - 1) / chunk)
    chunks = rows.select(F.col(rid).alias("rid"), "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(
        "rid",
        F.col("chunk").cast("int").alias("chunk"),
        F.substring("text", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("part"),
    )
    chunks = chunks.repartition("rid", "chunk")
    by_chunk = Window.partitionBy("rid").orderBy("chunk")
    seams = chunks.select("rid", "chunk", F.length("part").alias("length"), edges("part").alias("edges")).select(
        "rid", "chunk", "length", "edges.head", "edges.tail"
    )
    # Places of a tail, counted from the start of the next chunk: both lie overlap before this chunk's end.
    tail = F.transform("tail", lambda p: p - (F.col("length") - overlap))
    seams = seams.withColumn("before", F.lag(tail).over(by_chunk))
    seams = seams.select(
        "rid", "chunk", "length", F.array_min(F.array_intersect("before", "head")).alias("cut")
    ).withColumns({"next_cut": F.lead("cut").over(by_chunk), "is_last": F.lead("chunk").over(by_chunk).isNull()})
    seams = seams.withColumn(
        "stitched", F.min((F.col("chunk") == 0) | F.col("cut").isNotNull()).over(Window.partitionBy("rid"))
    )
    encoded = (
        chunks.join(seams.filter("stitched"), ["rid", "chunk"])
        .select(
            "rid",
            "chunk",
            code_between(
                "part",
                F.coalesce(F.col("cut"), F.lit(0)),
                F.when(F.col("is_last"), F.col("length")).otherwise(F.col("next_cut") + F.col("length") - overlap),
            ).alias("coded"),
        )
        .groupBy("rid")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "coded"))).alias("parts"))
        .select("rid", F.struct(joined("ids"), joined("decoded")).alias("stitched"))
    )
    # Where no boundary is agreed on, as in one word longer than an overlap, the text is encoded in one go.
    out = rows.join(encoded, F.col(rid) == F.col("rid"), "left")
    whole = out.filter(F.col("stitched").isNull()).select(*docs.columns, code_udf(tokenizer)("text").alias(coded))
    return (
        out.filter(F.col("stitched").isNotNull()).select(*docs.columns, F.col("stitched").alias(coded)).unionByName(whole)
    )


def encode_documents(
    docs: DataFrame,
    tokenizer: Tokenizer,
    ids: str = "ids",
    decoded: str | None = None,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """docs with a binary column ``ids``: the ids of text as little-endian unsigned 32-bit integers.

    With a name for ``decoded`` there is also a binary column of the bytes
    that these ids decode to. docs needs text; null texts are empty and get no
    ids. Every match of the pattern is encoded by itself, without special
    tokens. Texts longer than a chunk and its overlap are cut into overlapping
    chunks that different tasks pre-tokenise and encode. Repeated rows are
    encoded each for itself; an existing column of a result's name is an
    error.
    """
    for name in (ids, decoded):
        if name in docs.columns:
            raise ValueError(f"there is a column {name} already")
    bound_batches(docs)
    coded = free_name(docs, "coded")
    texts = docs.withColumn("text", F.coalesce("text", F.lit("")))
    is_long = F.length("text") > chunk + overlap
    short = texts.filter(~is_long).withColumn(coded, code_udf(tokenizer)("text"))
    out = short.unionByName(_code_long(texts.filter(is_long), tokenizer, chunk, overlap, coded))
    results = [F.col(coded)["ids"].alias(ids)]
    if decoded:
        results.append(F.col(coded)["decoded"].alias(decoded))
    return out.select(*docs.columns, *results)


def decode_documents(encoded: DataFrame, tokenizer: Tokenizer, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with a binary column of the bytes that the ids stand for."""
    bound_batches(encoded)
    return encoded.withColumn(decoded, decode_udf(tokenizer)(F.col(ids)))
