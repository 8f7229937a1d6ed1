"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.batches import map_batches
from granary.scratch import materialize

#: Code points of the training texts of a language, about; texts with the smallest hashes of doc_id are taken.
SAMPLE_CHARS = 6_000_000
LONGEST_GRAM = 5
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Words whose scores a worker remembers.
REMEMBERED = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word; those longer than a letter see where it begins and ends."""
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _hashes(keys: Iterable[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)


class Frequencies:
    """Log frequencies of keys within each language: one sorted array of hashes and one matrix."""

    def __init__(self, keys: list[str], counts: np.ndarray):
        """keys, and for each the counts by language."""
        hashes = _hashes(keys)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        base = np.log(counts.sum(axis=0) + SMOOTHING * (len(keys) + 1))
        self.logs = (np.log(counts[order] + SMOOTHING) - base).astype(np.float32)

    def rows(self, keys: Iterable[str]) -> np.ndarray:
        """The row of each key, -1 if it was never seen."""
        wanted = _hashes(keys)
        if not len(self.hashes):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)


class Model:
    """Per-language log frequencies of words and of n-grams of each length."""

    def __init__(self, langs: list[str], words: Frequencies, by_length: list[Frequencies]):
        self.langs, self.words, self.by_length = langs, words, by_length

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies by language for each word.

        Of the word itself if it was seen, else the mean of its seen n-grams
        of the greatest length that has any, else zeros.
        """
        out = np.zeros((len(words), len(self.langs)))
        at = self.words.rows(words)
        out[at >= 0] = self.words.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(left):
                break
            parts = [grams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            at = self.by_length[n - 1].rows(g for p in parts for g in p)
            owner, at = owner[at >= 0], at[at >= 0]
            seen = np.bincount(owner, minlength=len(left))
            logs = self.by_length[n - 1].logs[at]
            for k in range(len(self.langs)):
                total = np.bincount(owner, weights=logs[:, k], minlength=len(left))
                out[left[seen > 0], k] = total[seen > 0] / seen[seen > 0]
            left = left[seen == 0]
        return out


def _sample(docs: DataFrame, sample_chars: int) -> tuple[list[str], DataFrame]:
    """The languages, and text and lang of about ``sample_chars`` code points of each."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    chars = F.length("text").cast("long")
    fits = chars <= sample_chars
    totals = labelled.filter(fits).groupBy("lang").agg(F.sum(chars).alias("n")).collect()
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30))
    within = F.lit(False)
    for r in totals:
        share = int((1 << 30) * min(1.0, sample_chars / max(1, r.n)))
        within = within | ((F.col("lang") == r.lang) & (draw < F.lit(share)))
    return sorted(r.lang for r in totals), labelled.filter(fits & within).select("text", "lang")


def _counted(sample: DataFrame) -> DataFrame:
    """(lang, word, n) over the sample."""

    def start():
        seen: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, counter in seen.items():
                yield {"lang": [lang] * len(counter), "word": list(counter), "n": list(counter.values())}
            seen.clear()

        def step(batch):
            if batch is None:
                yield from flush()
                return
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                seen[lang].update(letters(text))
            if sum(map(len, seen.values())) > REMEMBERED:
                yield from flush()

        return step

    counted = map_batches(sample, "lang string, word string, n bigint", start)
    return materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")


def train(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of labelled rows: about ``sample_chars`` code points of each language.

    docs needs doc_id, text, lang; rows with a null text or lang teach
    nothing, nor does a single text above the bound. A row is in the sample if
    a hash of its doc_id falls under the fraction that the code points of its
    language call for; repeated rows count each. All words and n-grams of the
    sample are in the model, so its size is bounded by the sample's. They are
    counted on the executors. An empty table gives a model without languages.
    """
    langs, sample = _sample(docs, sample_chars)
    if not langs:
        none = Frequencies([], np.zeros((0, 0)))
        return Model([], none, [none] * LONGEST_GRAM)
    counted = _counted(sample)
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]

    def parts(n: int):
        padded = F.concat(F.lit("<"), F.col("word"), F.lit(">")) if n > 1 else F.col("word")
        places = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - (n - 1)))
        found = F.transform(places, lambda i: F.struct(F.lit(n).alias("length"), F.substring(padded, i, F.lit(n)).alias("key")))
        return F.coalesce(found, F.array().cast("array<struct<length:int,key:string>>"))

    whole = F.array(F.struct(F.lit(0).alias("length"), F.col("word").alias("key")))
    keys = F.concat(whole, *[parts(n) for n in range(1, LONGEST_GRAM + 1)])
    found = counted.select("lang", "n", F.inline(keys)).groupBy("length", "key").agg(*by_lang).toArrow()
    lengths = found["length"].to_numpy()

    def frequencies(n: int) -> Frequencies:
        rows = found.filter(pa.array(lengths == n))
        counts = [rows[f"n{i}"].to_numpy() for i in range(len(langs))]
        return Frequencies(rows["key"].to_pylist(), np.stack(counts, axis=1).astype(np.float64))

    return Model(langs, frequencies(0), [frequencies(n) for n in range(1, LONGEST_GRAM + 1)])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row of docs, from its whole text alone.

    Languages get the sum of the scores of all words of the text; score is
    the share of the best one after softmax. Texts that are null or have no
    letter are 'und' with score 0, and so is everything if nothing was
    learned. Ties go to the language that is first by name. Repeated rows have
    the same result each, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted = shared.value
        index: dict[str, int] = {}
        rows = np.zeros((0, len(fitted.langs)))

        def learn(texts: list[list[str]]) -> None:
            nonlocal rows
            new = list({w for words in texts for w in words}.difference(index))
            if len(index) + len(new) > REMEMBERED:
                index.clear()
                new = list({w for words in texts for w in words})
                rows = rows[:0]
            index.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            rows = np.concatenate([rows, fitted.scores(new)])

        def judge(words: list[str]) -> tuple[str, float]:
            if not words or not fitted.langs:
                return UNDETERMINED, 0.0
            at = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
            logs = rows[at].sum(axis=0)
            best = int(np.argmax(logs))
            return fitted.langs[best], float(1 / np.exp(logs - logs[best]).sum())

        def step(batch):
            if batch is None:
                return
            texts = [letters(t) for t in batch["text"]]
            learn(texts)
            judged = [judge(words) for words in texts]
            yield {
                "doc_id": batch["doc_id"],
                "lang_pred": [lang for lang, _ in judged],
                "score": [score for _, score in judged],
            }

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, lang_pred string, score double", start)
