"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, word before).

The class is a softmax over hashed features of the context: the word before,
the word before that (a skip) and both together. Its weights are trained by
distributed gradient steps and are broadcast.

Within its class a word is a softmax too: the logarithm of its smoothed share
of the class, plus a weight of the hashed bigram feature if that occurred
FEATURE_COUNT times or more. These weights lie in a table that grows with the
corpus and is never in one place: it is partitioned by context (the word
before and the class). The weights of a context act on no other, so the point
where the gradient vanishes, at which the expected count of every feature is
its observed one less DISCOUNT, is found exactly, in one step per partition.

Every class has room for unknown words, so the probabilities of a context sum
to 1. Texts are split once, to arrays of word ids, on which all else is NumPy.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.batches import map_batches
from granary.scratch import free_shuffles, materialize, with_row_id

#: Word classes; the last is the end of a text alone.
CLASSES = 16
#: Rows of the class weights: features of contexts are hashed to these.
BUCKETS = 1 << 14
#: Synchronous rounds; each training document takes part in one of them.
ROUNDS = 2
LEARNING_RATE = 0.6
#: Tokens of one gradient step, and of one scoring step.
STEP_TOKENS = 8_192
#: The most frequent words, whose counts go to every worker; the others are joined.
FREQUENT = 100_000
#: Words a worker remembers.
REMEMBERED = 300_000
#: Tokens or counts that a worker gathers before it hands them on.
GATHERED = 1_000_000
#: Training tokens whose bigrams one partition of the weight table holds, about.
PARTITION_TOKENS = 4_000_000
LEAST_PARTITIONS = 12
#: The texts ask for their words' weights and counts in so many turns, one after the other, so that a share of the requests is on disk at once.
TURNS = 4
SMOOTHING = 0.1
#: A bigram is a feature if it occurred so often; its count is lowered by DISCOUNT.
FEATURE_COUNT = 2
DISCOUNT = 0.75
#: No word has a line break, so this stands for the end of a text.
END = b"\n"

_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_CLASS_MASK = CLASSES - 1
#: A bigram key has a hash of its context above so many bits, and a code of its word in them.
_WORD_BITS = np.uint64(24)
#: Codes of frequent words are their rows; others have RARE, their class, and a hash of so many bits.
_RARE, _HASH_BITS = np.uint64(1 << 23), np.uint64(18)


def word_class(word: bytes) -> int:
    """By the first two bytes, which carry language and part of inflection."""
    return CLASSES - 1 if word == END else zlib.crc32(word[:2]) % (CLASSES - 1)


def word_id(word: bytes) -> int:
    """A hash of the word whose lowest bits are its class, as a signed 64-bit number."""
    value = (xxhash.xxh3_64_intdigest(word) & ~_CLASS_MASK) | word_class(word)
    return value - (1 << 64) if value >> 63 else value


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = word_id(word)
        return value


def split(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end; bytes are split at ASCII white space only."""
    found = text.lower().split() if text else []
    found.append(END)
    return found


def to_ids(rows: DataFrame) -> DataFrame:
    """doc_id, held_out and ``ids``, the word ids of body as eight bytes each."""

    def start():
        ids = _Ids()

        def step(batch):
            if batch is None:
                return
            words = [split(body) for body in batch["body"]]
            packed = [np.array(list(map(ids.__getitem__, ws)), dtype=np.int64).tobytes() for ws in words]
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "ids": packed}

        return step

    return map_batches(rows.select("doc_id", "held_out", "body"), "doc_id bigint, held_out boolean, ids binary", start)


def _arrays(blobs: list) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.int64) for b in blobs]


def count_words(training: DataFrame) -> DataFrame:
    """(id, n) over the rows of training."""

    def start():
        held: list[np.ndarray] = []

        def flush() -> Iterator[dict]:
            if held:
                found, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield {"id": found, "n": n}

        def step(batch):
            if batch is not None:
                held.extend(_arrays(batch["ids"]))
            if batch is None or sum(map(len, held)) > GATHERED:
                yield from flush()

        return step

    counts = map_batches(training.select("ids"), "id bigint, n bigint", start)
    return counts.groupBy("id").agg(F.sum("n").alias("n"))


class Batch:
    """Tokens of several texts as arrays: words, those before them, classes, features, and where each text begins."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.begins = np.cumsum(lengths) - lengths
        self.text = np.repeat(np.arange(len(texts)), lengths)
        self.words = np.concatenate(texts).view(np.uint64)
        self.classes = (self.words & np.uint64(_CLASS_MASK)).astype(np.int64)
        before = np.zeros(len(self.words) + 2, dtype=np.uint64)
        before[2:] = self.words
        self.before, self.skipped = before[1:-1].copy(), before[:-2].copy()
        self.before[self.begins] = 0
        self.skipped[self.begins] = 0
        self.skipped[self.begins[lengths > 1] + 1] = 0

    def features(self) -> tuple[np.ndarray, ...]:
        both = self.before * np.uint64(31) + self.skipped * np.uint64(17) + np.uint64(7)
        keys = zip((self.before, self.skipped, both), _SALTS, strict=True)
        return tuple((((key * salt) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64) for key, salt in keys)

    def bigrams(self, shares: Shares) -> np.ndarray:
        """A key per token: a hash of the word before and the class, then the code of the word."""
        context = (self.before ^ (self.classes.astype(np.uint64) + np.uint64(1)) * _SALTS[1]) * _SALTS[0]
        context ^= context >> np.uint64(32)
        return ((context * _SALTS[1]) >> _WORD_BITS << _WORD_BITS) | shares.codes(self.words, self.classes)


def _context(keys: np.ndarray) -> np.ndarray:
    return keys >> _WORD_BITS


def class_logits(weights: np.ndarray, bias: np.ndarray, features, part: slice) -> np.ndarray:
    logits = weights[features[0][part]]
    logits += weights[features[1][part]]
    logits += weights[features[2][part]]
    logits += bias
    return logits


def softmax(logits: np.ndarray) -> np.ndarray:
    """Class probabilities, a row per class: NumPy reduces over the first axis much faster."""
    shares = np.ascontiguousarray(logits.T)
    shares -= shares.max(axis=0)
    np.exp(shares, out=shares)
    shares /= shares.sum(axis=0)
    return shares


def chosen_log_softmax(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log probability of one class per row."""
    by_class = np.ascontiguousarray(logits.T)
    most = by_class.max(axis=0)
    by_class -= most
    np.exp(by_class, out=by_class)
    return logits[np.arange(len(chosen)), chosen] - most - np.log(by_class.sum(axis=0))


def gradient_step(weights: np.ndarray, scale: np.ndarray, bias: np.ndarray, features, classes: np.ndarray, part: slice) -> None:
    """One Adagrad step of the log likelihood on the tokens of part."""
    classes = classes[part]
    grad = softmax(class_logits(weights, bias, features, part))
    np.negative(grad, out=grad)
    grad[classes, np.arange(len(classes))] += 1
    place = np.empty(len(weights), dtype=np.int64)
    for feature in features:
        rows = feature[part]
        used = np.flatnonzero(np.bincount(rows, minlength=len(weights)))
        place[used] = np.arange(len(used))
        at = place[rows]
        step = np.empty((len(used), CLASSES), dtype=np.float32)
        for k in range(CLASSES):
            step[:, k] = np.bincount(at, weights=grad[k], minlength=len(used))
        scale[used] += np.einsum("ij,ij->i", step, step)
        weights[used] += (LEARNING_RATE / np.sqrt(scale[used] + 1.0))[:, None] * step


def _groups(texts: list[np.ndarray], most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Stretches of texts, gathered until they have ``most`` tokens, and where each stretch begins."""
    held, total, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text)
        total += len(text)
        if total >= most:
            yield first, held
            held, total, first = [], 0, i + 1
    if held:
        yield first, held


def train_round(training: DataFrame, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One synchronous round: tasks take gradient steps from the same weights, and their changes are averaged.

    A row of weights moves by the mean change of the tasks that have met its
    features, weighed by their tokens. Spark sums the rows, so the driver gets
    at most BUCKETS of them.
    """
    shared = training.sparkSession.sparkContext.broadcast((weights, bias))
    cells = ", ".join(f"w{i} float" for i in range(CLASSES))

    def start():
        begin, prior = shared.value
        own, scale, tokens = begin.copy(), np.zeros(len(begin), dtype=np.float32), 0

        def step(batch):
            nonlocal tokens
            if batch is None:
                change = (own - begin) * np.float32(tokens)
                used = np.flatnonzero(np.abs(change).max(axis=1) > 0)
                out = {"row": used.astype(np.int32), "tokens": np.full(len(used), tokens)}
                yield out | {f"w{i}": change[used, i] for i in range(CLASSES)}
                return
            for _, group in _groups(_arrays(batch["ids"]), STEP_TOKENS):
                data = Batch(group)
                features = data.features()
                tokens += len(data.words)
                for at in range(0, len(data.words), STEP_TOKENS):
                    gradient_step(own, scale, prior, features, data.classes, slice(at, at + STEP_TOKENS))
            yield from ()

        return step

    changes = map_batches(training.select("ids"), f"row int, tokens bigint, {cells}", start)
    summed = changes.groupBy("row").agg(F.sum("tokens").alias("tokens"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(CLASSES)])
    found = summed.toPandas()
    if len(found):
        weights = weights.copy()
        moved = found[[f"w{i}" for i in range(CLASSES)]].to_numpy() / found.tokens.to_numpy()[:, None]
        weights[found.row.to_numpy()] += moved.astype(np.float32)
    shared.unpersist()
    return weights


@dataclass
class Shares:
    """The share of each word in its class: of frequent words by their counts, equal among all others."""

    ids: np.ndarray
    counts: np.ndarray
    log_share: np.ndarray
    log_other: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, by_class: dict[int, tuple[int, int]]) -> Shares:
        """ids and counts of frequent words; by_class has tokens and distinct words of each class."""
        order = np.argsort(ids)
        ids, counts = ids[order], counts[order]
        classes = ids & _CLASS_MASK
        tokens, words = (np.array([by_class.get(k, (0, 0))[i] for k in range(CLASSES)], dtype=np.float64) for i in (0, 1))
        total = tokens + SMOOTHING * (words + 1)
        taken = np.bincount(classes, weights=counts + SMOOTHING, minlength=CLASSES)
        others = words - np.bincount(classes, minlength=CLASSES) + 1
        log_other = np.log10((total - taken).clip(SMOOTHING * 0.5) / others) - np.log10(total)
        return cls(ids, counts, np.log10(counts + SMOOTHING) - np.log10(total)[classes], log_other)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The row of each word, -1 if it is not frequent."""
        words = words.view(np.int64)
        if not len(self.ids):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.ids, words), len(self.ids) - 1)
        return np.where(self.ids[at] == words, at, -1)

    def codes(self, words: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """What the share of a word is known by, and a rare word told from others of its class."""
        at = self.find(words)
        rare = _RARE | classes.astype(np.uint64) << _HASH_BITS | (words.view(np.uint64) * _SALTS[2]) >> (np.uint64(64) - _HASH_BITS)
        return np.where(at >= 0, at.astype(np.uint64), rare)

    def of_codes(self, codes: np.ndarray) -> np.ndarray:
        """The shares of words by their codes."""
        rare = codes & _RARE != 0
        classes = np.where(rare, (codes ^ _RARE) >> _HASH_BITS, 0).astype(np.int64) % CLASSES
        return 10.0 ** self.logs(np.where(rare, -1, codes.astype(np.int64)), classes)

    def logs(self, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of the share of words whose rows are at."""
        if not len(self.ids):
            return self.log_other[classes]
        return np.where(at >= 0, self.log_share[at], self.log_other[classes])


def solve_contexts(keys: np.ndarray, shares: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bigram weights of whole contexts, from bigram keys, the words' shares of their class, and counts.

    Keys may repeat. Returns the keys of the features with
    log10(P(word | class, word before) / share), and their contexts with the
    same for the words that no feature of the context has.
    """
    order = np.argsort(keys, kind="stable")
    keys, shares, n = keys[order], shares[order].astype(np.float64), n[order].astype(np.float64)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    n = np.add.reduceat(n, first) if len(keys) else n
    keys, shares = keys[first], shares[first]
    contexts = _context(keys)
    begin = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]) != 0)
    if not len(begin):
        none = np.empty(0)
        return keys, none, contexts, none
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    total = np.add.reduceat(n, begin)
    feature = n >= FEATURE_COUNT
    expected = np.where(feature, n - DISCOUNT, 0) / total[owner]
    covered = np.add.reduceat(np.where(feature, shares, 0), begin)
    left = 1 - np.add.reduceat(expected, begin)
    back = np.log10(left.clip(1e-12)) - np.log10((1 - covered).clip(1e-12))
    gains = np.log10(expected[feature]) - np.log10(shares[feature])
    with_features = np.unique(owner[feature])
    return keys[feature], gains, contexts[begin][with_features], back[with_features]


def _by_partition(keys: np.ndarray, partitions: int) -> Iterator[tuple[int, np.ndarray]]:
    """Partitions of contexts, each with the places of its keys."""
    part = (_context(keys) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=partitions))
    for p, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
        if b > a:
            yield p, order[a:b]


_ROW = "part int, kind int, a binary, b binary, c binary, d binary"


def bigram_table(training: DataFrame, shares: Shares, partitions: int) -> DataFrame:
    """The weights of bigrams: rows (part, kind 0, keys, gains, contexts, backs) of arrays; no context is in two parts."""
    shared = training.sparkSession.sparkContext.broadcast(shares)

    def count():
        known, held, total = shared.value, [], 0

        def flush() -> Iterator[dict]:
            nonlocal total
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            total = 0
            out = {c: [] for c in ("part", "kind", "a", "b", "c", "d")}
            for p, at in _by_partition(keys, partitions):
                own, times = keys[at], n[at]
                once = times == 1  # most are, so their counts are left out
                blobs = (own[once], own[~once], times[~once].astype(np.uint32))
                for c, x in zip(out, (p, 0, *(x.tobytes() for x in blobs), None), strict=True):
                    out[c].append(x)
            yield out

        def step(batch):
            nonlocal total
            for _, group in _groups(_arrays(batch["ids"]) if batch else [], GATHERED):
                keys = Batch(group).bigrams(known)
                held.append(keys)
                total += len(keys)
                if total >= GATHERED:
                    yield from flush()
            if batch is None and held:
                yield from flush()

        return step

    def solve():
        known, held, part = shared.value, [], None

        def flush() -> Iterator[dict]:
            once, more = ([np.frombuffer(r[k], dtype=np.uint64) for r in held] for k in (0, 1))
            times = [np.frombuffer(r[2], dtype=np.uint32) for r in held]
            held.clear()
            keys = np.concatenate([*once, *more])
            n = np.concatenate([*(np.ones(len(x), dtype=np.uint32) for x in once), *times])
            keys, gains, contexts, backs = solve_contexts(keys, known.of_codes(keys & (_RARE * np.uint64(2) - np.uint64(1))), n)
            if len(keys):
                blobs = (keys, gains.astype(np.float32), contexts, backs.astype(np.float32))
                yield {"part": [part], "kind": [0]} | {c: [x.tobytes()] for c, x in zip("abcd", blobs, strict=True)}

        def step(batch):
            nonlocal part
            for p, *blobs in zip(*(batch[c] for c in ("part", "a", "b", "c")), strict=True) if batch else ():
                if p != part and held:
                    yield from flush()
                part = p
                held.append(blobs)
            if batch is None and held:
                yield from flush()

        return step

    counted = map_batches(training.select("ids"), _ROW, count)
    return map_batches(counted.repartition(partitions, "part").sortWithinPartitions("part"), _ROW, solve)


def bigram_scores(rows: DataFrame, table: DataFrame, shares: Shares, partitions: int, rid: str) -> DataFrame:
    """(rid, gain): what the bigram weights add to log10 of the shares; a row for each text that meets any part of the table.

    Tokens go to the part that has their context, in the order of their texts,
    as keys; how many of them each text has goes with them. An answer has the
    sums of all texts of a request as arrays, and goes back to where those of
    the same texts (``chunk``, the first one's id) are added up.
    """
    shared = rows.sparkSession.sparkContext.broadcast(shares)

    def ask():
        def step(batch):
            if batch is None:
                return
            ids = np.array(batch[rid], dtype=np.int64)
            for first, group in _groups(_arrays(batch["ids"]), GATHERED):
                data = Batch(group)
                keys, text = data.bigrams(shared.value), data.text
                for at in range(0, len(keys), GATHERED):
                    asked = list(_by_partition(keys[at : at + GATHERED], partitions))
                    owners = [np.unique(text[at : at + GATHERED][places], return_counts=True) for _, places in asked]
                    yield {
                        "part": [p for p, _ in asked],
                        "kind": [1] * len(asked),
                        "a": [keys[at : at + GATHERED][places].tobytes() for _, places in asked],
                        "b": [n.astype(np.uint32).tobytes() for _, n in owners],
                        "c": [ids[first + own].tobytes() for own, _ in owners],
                        "d": [ids[first : first + 1].tobytes()] * len(asked),
                    }

        return step

    def answer():
        part, held, model = None, [], None

        def loaded():
            if not held:
                return None
            columns = [[np.frombuffer(r[k], dtype=t) for r in held] for k, t in enumerate((np.uint64, np.float32, np.uint64, np.float32))]
            return [np.concatenate(c) for c in columns]

        def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            return found, np.where(found, values[at], 0.0)

        def step(batch):
            nonlocal part, held, model
            if batch is None:
                return
            for p, kind, *blobs in zip(*(batch[c] for c in ("part", "kind", "a", "b", "c", "d")), strict=True):
                if p != part:
                    part, held, model = p, [], None
                if kind == 0:
                    held.append(blobs)
                    continue
                if model is None:
                    model = loaded()
                    if model is None:
                        continue
                keys = np.frombuffer(blobs[0], dtype=np.uint64)
                seen, gains = looked_up(model[0], model[1], keys)
                _, backs = looked_up(model[2], model[3], _context(keys))
                ends = np.cumsum(np.frombuffer(blobs[1], dtype=np.uint32), dtype=np.int64)
                sums = np.add.reduceat(np.where(seen, gains, backs).astype(np.float64), np.append(0, ends[:-1]))
                chunk = np.frombuffer(blobs[3], dtype=np.int64)
                yield {"chunk": chunk, "part": [p], "rids": [blobs[2]], "gains": [sums.tobytes()]}

        return step

    def add():
        chunk, rids, gains = None, [], []

        def flush() -> Iterator[dict]:
            found, at = np.unique(np.concatenate(rids), return_inverse=True)
            yield {"rid": found, "gain": np.bincount(at, weights=np.concatenate(gains))}
            rids.clear()
            gains.clear()

        def step(batch):
            nonlocal chunk
            for c, own, sums in zip(*(batch[k] for k in ("chunk", "rids", "gains")), strict=True) if batch else ():
                if c != chunk and rids:
                    yield from flush()
                chunk = c
                rids.append(np.frombuffer(own, dtype=np.int64))
                gains.append(np.frombuffer(sums, dtype=np.float64))
            if batch is None and rids:
                yield from flush()

        return step

    asked = map_batches(rows.select(rid, "ids"), _ROW, ask)
    met = table.unionByName(asked).repartition(partitions, "part").sortWithinPartitions("part", "kind")
    answers = map_batches(met, "chunk bigint, part int, rids binary, gains binary", answer)
    return map_batches(answers.repartition("chunk").sortWithinPartitions("chunk", "part"), "rid bigint, gain double", add)


def score_documents(docs: DataFrame, held_out_every: int = 10) -> DataFrame:
    """Train on the documents whose crc32(doc_id as text) mod ``held_out_every`` is not 0, and score all.

    docs needs doc_id and text; the result has doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score. Scores are log10 probabilities
    of the whole text and its end: base_score of a unigram model, score of
    this one. A null text is empty and has its end alone. Repeated rows are
    scored, and counted, each for itself. With nothing to train on all words
    are unknown. An empty table gives an empty result.

    The counts of the FREQUENT most frequent words go to all workers. A text's
    other words are joined with the table of counts, so none is left out of
    base_score; in ``score`` they share what their class has left equally,
    unless a bigram weight says more.
    """
    body = F.coalesce("text", F.lit("")).cast("binary").alias("body")
    split_rows = to_ids(docs.select("doc_id", (remainder(held_out_every) == 0).alias("held_out"), body))
    rows, rid = with_row_id(split_rows, "maxent-ids")
    training = rows.filter(~F.col("held_out"))
    counts = materialize(count_words(training), "maxent-counts")
    model = fit(training, counts)
    return _scored(rows, rid, counts, model)


@dataclass
class Model:
    """Class weights, class shares, the table of bigram weights, and totals of the training words."""

    weights: np.ndarray
    bias: np.ndarray
    shares: Shares
    bigrams: DataFrame
    partitions: int
    tokens: int
    distinct: int


def fit(training: DataFrame, counts: DataFrame) -> Model:
    """A model of the rows of training (doc_id, ids), whose word counts are counts (id, n)."""
    by_class = {
        r["class"]: (r.n, r.words)
        for r in counts.groupBy(F.col("id").bitwiseAND(F.lit(_CLASS_MASK).cast("long")).alias("class"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
        .collect()
    }
    tokens, distinct = (sum(x[i] for x in by_class.values()) for i in (0, 1))
    shares = Shares.of(*_frequent(counts, FREQUENT), by_class)
    prior = np.array([by_class.get(k, (0, 0))[0] + 1.0 for k in range(CLASSES)])
    bias = np.log(prior / prior.sum()).astype(np.float32)
    weights = np.zeros((BUCKETS, CLASSES), dtype=np.float32)
    if tokens:
        turn = F.pmod(F.xxhash64(F.lit("round"), F.col("doc_id")), F.lit(ROUNDS))
        for i in range(ROUNDS):
            weights = train_round(training.filter(turn == i), weights, bias)
    free_shuffles(training.sparkSession)
    partitions = max(LEAST_PARTITIONS, -(-tokens // PARTITION_TOKENS))
    table = materialize(bigram_table(training, shares, partitions), "maxent-bigrams")
    free_shuffles(training.sparkSession)
    return Model(weights, bias, shares, table, partitions, tokens, distinct)


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the most frequent words, ``most`` at the outside.

    A histogram of counts tells how often a word must occur to be among them;
    the driver gets the histogram and those words, and no more from any task.
    """
    step = F.floor(F.log2("n") * 16)
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for row in histogram:
        total += row.words
        if total > most:
            break
        least = row.step
    if least is None:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    top = counts.filter(step >= least).select("id", "n").toPandas()
    return top["id"].to_numpy(dtype=np.int64), top["n"].to_numpy(dtype=np.int64)


def _scored(rows: DataFrame, rid: str, counts: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.shares))

    def start():
        weights, bias, shares = shared.value

        def step(batch):
            if batch is None:
                return
            for first, group in _groups(_arrays(batch["ids"]), STEP_TOKENS):
                data = Batch(group)
                features, n = data.features(), len(data.words)
                logs = np.empty(n)
                for at in range(0, n, STEP_TOKENS):
                    part = slice(at, at + STEP_TOKENS)
                    logs[part] = chosen_log_softmax(class_logits(weights, bias, features, part), data.classes[part])
                at = shares.find(data.words)
                logs = logs / math.log(10) + shares.logs(at, data.classes)
                frequent = at >= 0
                known = np.where(frequent, np.log10(shares.counts[at] + SMOOTHING), 0.0) if len(shares.ids) else np.zeros(n)
                lengths = np.diff(np.append(data.begins, n))
                rare_words, rare_times = [], []
                ends = np.append(data.begins, n)
                for i in range(len(group)):
                    inside = slice(ends[i], ends[i + 1])
                    words, times = np.unique(data.words[inside][~frequent[inside]].view(np.int64), return_counts=True)
                    rare_words.append(words)
                    rare_times.append(times)
                yield {
                    rid: batch[rid][first : first + len(group)],
                    "doc_id": batch["doc_id"][first : first + len(group)],
                    "held_out": batch["held_out"][first : first + len(group)],
                    "n_tokens": lengths,
                    "n_known": np.add.reduceat(frequent.astype(np.int64), data.begins),
                    "logs": np.add.reduceat(known, data.begins),
                    "context_score": np.add.reduceat(logs, data.begins),
                    "words": rare_words,
                    "times": rare_times,
                }

        return step

    schema = (
        f"{rid} bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, context_score double, "
        "words array<bigint>, times array<bigint>"
    )
    scored = materialize(map_batches(rows, schema, start), "maxent-rows")
    turn = F.pmod(F.xxhash64(F.lit("turn"), F.col(rid)), F.lit(TURNS))
    more = None
    for i in range(TURNS):
        found = materialize(_asked(rows.filter(turn == i), rid, scored.filter(turn == i), counts, model), "maxent-more")
        free_shuffles(rows.sparkSession)
        more = found if more is None else more.unionByName(found)
    nothing = F.lit(0.0)
    joined = scored.drop("words", "times").join(more, F.col(rid) == F.col("rid"), "left")
    logs = F.col("logs") + F.coalesce("more_logs", nothing)
    unit = math.log10(model.tokens + SMOOTHING * (model.distinct + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("context_score") + F.coalesce("gain", nothing)).alias("score"),
    )


def _asked(rows: DataFrame, rid: str, scored: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(rid, more_logs, more_known, gain): what the counts of rare words and the bigram weights add, for each text that meets any."""
    n = F.coalesce(F.col("n"), F.lit(0))
    nothing = F.lit(0.0)
    rare = (
        scored.select(F.col(rid).alias("rid"), F.explode(F.arrays_zip("words", "times")).alias("x"))
        .select("rid", F.col("x.words").alias("id"), F.col("x.times").alias("times"))
        .join(counts, "id", "left")
        .select(
            "rid",
            (F.col("times") * F.log10(n + SMOOTHING)).alias("logs"),
            F.when(n > 0, F.col("times")).otherwise(0).alias("known"),
            nothing.alias("gain"),
        )
    )
    gains = bigram_scores(rows, model.bigrams, model.shares, model.partitions, rid).select(
        "rid", nothing.alias("logs"), F.lit(0).cast("long").alias("known"), "gain"
    )
    return rare.unionByName(gains).groupBy("rid").agg(
        F.sum("logs").alias("more_logs"), F.sum("known").alias("more_known"), F.sum("gain").alias("gain")
    )
