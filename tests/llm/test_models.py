"""BPE, language id, language model, near-dedup and fingerprints against plain Python."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from granary.llm import bpe, langid, maxent, minhash, queries, similar, skew, spotsigs
from granary.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, node string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", 1, "clash", "clash") for d, t, lang in rows], SCHEMA)


def write(df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "it's 12 é😀 <|endoftext|> \x00\x1c", "en"),
    (5, "word " * 30_000 + "end", "en"), (6, "a" * 5000, "en"), (7, "one two", "en"), (7, "one two", "en"), (None, "no id", "en"),
]


def test_bpe_follows_the_contract(spark, encoding, tmp_path):
    got = queries.op6_bpe_round_trip(spark, write(frame(spark, ODD), tmp_path)).collect()
    want = {}
    for d, t, _ in ODD:
        ids = encoding.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t or ""))
    assert len(got) == len(ODD)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id]


def test_chunks_are_stitched_exactly(spark, encoding):
    draw = random.Random(6)
    pieces = ["word", " ", "  ", "\n\n", "'re", "'", "é", "12", "😀", "...", "\t", " don't", "x" * 40, " " * 30]
    rows = [(i, "".join(draw.choices(pieces, k=draw.randint(50, 800))), "en") for i in range(40)]
    rows += [(100, "z" * 900, "en"), (101, " " * 900, "en"), (102, "ab " * 20 + "q" * 300 + " cd" * 50, "en")]
    tokenizer = bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)
    coded = bpe.encode_documents(frame(spark, rows), tokenizer, decoded="own", chunk=64, overlap=24)
    assert coded.filter("own <> cast(text as binary)").count() == 0
    got = bpe.decode_documents(coded, tokenizer).select("doc_id", "ids", "own", "decoded").collect()
    assert all(r.own == r.decoded for r in got)
    assert len(got) == len(rows)
    text = {d: t for d, t, _ in rows}
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(text[r.doc_id]), r.doc_id


def test_boundaries_are_boundaries():
    pattern, draw = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(200):
        text = "".join(draw.choices(["a", " ", "'", "r", "e", "\n", "1", "."], k=120))
        starts = {m.start() for m in pattern.finditer(text)}
        _, tail = bpe.boundaries(pattern, text[:80], 40)
        assert set(tail) <= starts


def test_language_is_learned_and_held_out(spark, tmp_path):
    words = {"en": "the cat sat on a mat with hats", "de": "der hund und die katze sind nicht müde", "fr": "le chat est sur la table avec nous"}
    draw, rows = random.Random(2), []
    for i in range(400):
        lang = list(words)[i % 3]
        rows.append((i, " ".join(draw.choices(words[lang].split(), k=12)), lang))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "de"), (1003, "Katzen mögen", None), (None, "the cat", "en")]
    got = queries.op7_language(spark, write(frame(spark, rows), tmp_path)).collect()
    assert len(got) == len(rows)
    lang = {d: x for d, _, x in rows}
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und")
    assert all(r.lang_pred == lang[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1003].lang_pred == "de"


def test_unseen_words_back_off(spark):
    model = langid.train(frame(spark, [(i, t, lang) for i, (t, lang) in enumerate([("straßenbahn straßenfest", "de"), ("railway railroad", "en")] * 6)]))
    assert list(model.words.rows(["straßenlicht", "railway"]) >= 0) == [False, True]
    unseen, strange = model.scores(["straßenlicht", "ωωω"])
    assert unseen[model.langs.index("de")] > unseen[model.langs.index("en")]
    assert not strange.any()
    nothing = langid.train(frame(spark, []))
    assert nothing.langs == []
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "a b", "en")]), nothing).collect()] == ["und"]
    assert langid.predict(frame(spark, []), model).collect() == []


def test_language_follows_brute_force(spark, monkeypatch):
    """Every word and n-gram counts, however rare; long, repeated and odd texts too."""
    draw = random.Random(12)
    makers = {"aa": "abcde", "bb": "bcdef", "cc": "defgé"}
    rows = []
    for i in range(90):
        lang = list(makers)[i % 3]
        words = ["".join(draw.choices(makers[lang], k=draw.randint(1, 7))) for _ in range(draw.randint(1, 30))]
        rows.append((i, " ".join(words).title(), lang if i % 11 else None))
    rows += [(3, rows[3][1], "aa"), (200, None, "aa"), (201, "12 _", "bb"), (202, "ωω x ωa", None), (203, "abc dég " * 40_000, None), (None, "fed", None)]
    monkeypatch.setattr(langid, "REMEMBERED", 50)
    df = frame(spark, rows)
    want = brute.languages([r for r in rows if r[2]], [t for _, t, _ in rows])
    got = langid.predict(df, langid.train(df)).collect()
    found = sorted((str(r.doc_id), r.lang_pred, round(r.score, 6)) for r in got)
    assert found == sorted((str(d), lang, round(score, 6)) for (d, _, _), (lang, score) in zip(rows, want, strict=True))


def test_language_model_follows_the_contract(spark, tmp_path):
    draw, rows = random.Random(3), []
    for i in range(300):
        step, words = draw.randint(0, 5), []
        for _ in range(draw.randint(5, 60)):
            step = (step + draw.choice([1, 1, 1, 2])) % 12
            words.append("abcdefghijkl"[step] * 2 + "X")
        rows.append((i, " ".join(words), "en"))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "unseen  word", "en"), (1003, "rare " * 3, "en")]
    got = queries.op5_maxent_score(spark, write(frame(spark, rows), tmp_path)).collect()
    want = brute.unigram({d: t for d, t, _ in rows})
    assert len(got) == len(rows)
    for r in got:
        for k, v in want[r.doc_id].items():
            assert r[k] == pytest.approx(v), (r.doc_id, k)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 1


def test_rare_words_are_joined(spark, monkeypatch):
    rows = [(i, f"common word{i % 50} other{i}", "en") for i in range(120)]
    monkeypatch.setattr(maxent, "FREQUENT", 3)
    got = maxent.score_documents(frame(spark, rows)).collect()
    want = brute.unigram({d: t for d, t, _ in rows})
    for r in got:
        assert (r.n_known, r.base_score) == (want[r.doc_id]["n_known"], pytest.approx(want[r.doc_id]["base_score"]))


def ids(text):
    return np.array([maxent.word_id(w) for w in maxent.split(text)], dtype=np.int64)


def test_class_probabilities_sum_to_one():
    draw = np.random.default_rng(1)
    weights = draw.normal(size=(maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
    data = maxent.Batch([ids(b"a b c d"), ids(None), ids(b"x")])
    logits = maxent.class_logits(weights, np.zeros(maxent.CLASSES, np.float32), data.features(), slice(None))
    shares = maxent.softmax(logits.copy())
    assert np.allclose(shares.sum(axis=0), 1, atol=1e-5) and list(data.begins) == [0, 5, 6]
    picked = maxent.chosen_log_softmax(logits.copy(), data.classes)
    assert np.allclose(np.exp(picked), shares[data.classes, np.arange(len(picked))], atol=1e-5)
    assert list(data.before[[0, 5, 6]]) == [0, 0, 0] and list(data.skipped[[0, 1, 6, 7]]) == [0] * 4


def test_gradient_steps_learn():
    text = b" ".join([b"aa bb cc dd"] * 200)
    weights, scale = np.zeros((maxent.BUCKETS, maxent.CLASSES), np.float32), np.zeros(maxent.BUCKETS, np.float32)
    bias, data = np.zeros(maxent.CLASSES, np.float32), maxent.Batch([ids(text)])
    features = data.features()

    def loss():
        return -maxent.chosen_log_softmax(maxent.class_logits(weights, bias, features, slice(None)), data.classes).mean()

    before = loss()
    for _ in range(20):
        maxent.gradient_step(weights, scale, bias, features, data.classes, slice(None))
    assert loss() < before / 3


def test_bigram_weights_meet_their_constraints():
    """The expected count of a feature is its observed one less the discount; a context's probabilities sum to 1."""
    shares = {1: 0.5, 2: 0.2, 3: 0.2, 4: 0.1}
    observed = [(7, 1, 3), (7, 2, 1), (7, 1, 2), (7, 3, 4), (9, 2, 1), (9, 3, 1)]
    keys = np.array([(c << 24) | w for c, w, _ in observed], dtype=np.uint64)
    found, gains, contexts, backs = maxent.solve_contexts(keys, np.array([shares[w] for _, w, _ in observed]), np.array([n for *_, n in observed]))
    assert list(found) == [(7 << 24) | 1, (7 << 24) | 3] and list(contexts) == [7]
    probability = {w: shares[w] * 10 ** backs[0] for w in shares}
    probability |= {int(k) & 0xFFFFFF: shares[int(k) & 0xFFFFFF] * 10**g for k, g in zip(found, gains, strict=True)}
    assert sum(probability.values()) == pytest.approx(1)
    assert 10 * probability[1] == pytest.approx(5 - maxent.DISCOUNT) and 10 * probability[3] == pytest.approx(4 - maxent.DISCOUNT)
    assert probability[2] / probability[4] == pytest.approx(2)
    assert [len(x) for x in maxent.solve_contexts(keys[:0], np.empty(0), np.empty(0))] == [0, 0, 0, 0]


def test_scores_follow_brute_force(spark, monkeypatch):
    """Class softmax, shares of classes and bigram weights, word by word in plain Python."""
    draw = random.Random(21)
    words = ["".join(draw.choices("abcd", k=draw.randint(1, 4))) for _ in range(60)]
    rows = [(i, " ".join(draw.choices(words, weights=range(60, 0, -1), k=draw.randint(0, 40))), "en") for i in range(150)]
    rows += [(3, rows[3][1], "en"), (None, "a b unseen unseen2", "en"), (900, None, "en"), (901, "ab " * 20_000, "en")]
    monkeypatch.setattr(maxent, "FREQUENT", 25)
    kept = {}
    fit = maxent.fit
    monkeypatch.setattr(maxent, "fit", lambda *a: kept.setdefault("model", fit(*a)))
    got = maxent.score_documents(frame(spark, rows)).collect()
    model = kept["model"]
    training = [t for d, t, _ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    want = brute.maxent_scores(training, [t for _, t, _ in rows], model.weights, model.bias, set(model.shares.ids.tolist()))
    assert 0 < len(model.shares.ids) <= 25
    found = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    expected = sorted((str(d), len(maxent.split((t or "").encode())), x) for (d, t, _), x in zip(rows, want, strict=True))
    for a, b in zip(found, expected, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=2e-4, abs=1e-3), (a, b)


def test_texts_ask_in_turns(spark, monkeypatch):
    """Each text asks for its weights in one turn, no turn has all of them, and the scores are those of a single turn."""
    draw = random.Random(5)
    words = [f"{c}{k}" for c in "abcdef" for k in range(8)]
    df = frame(spark, [(i, " ".join(draw.choices(words, k=draw.randint(0, 30))), "en") for i in range(60)])
    turns, score = [], maxent.bigram_scores

    def watched(rows, table, shares, partitions, rid):
        turns.append([r[rid] for r in rows.select(rid).collect()])
        gains = score(rows, table, shares, partitions, rid)
        assert partitions > 1
        assert gains.count() == gains.select("rid").distinct().count()  # not one for each part that a text meets
        return gains

    monkeypatch.setattr(maxent, "bigram_scores", watched)
    got = sorted(map(tuple, maxent.score_documents(df).collect()))
    assert len(turns) > 1 and max(map(len, turns)) < 60
    assert len({r for t in turns for r in t}) == sum(map(len, turns)) == 60
    monkeypatch.setattr(maxent, "TURNS", 1)
    for one, other in zip(got, sorted(map(tuple, maxent.score_documents(df).collect())), strict=True):
        assert one[:5] == other[:5] and one[5:] == pytest.approx(other[5:])


def test_language_model_of_nothing(spark):
    assert maxent.score_documents(frame(spark, [])).collect() == []
    alone = maxent.score_documents(frame(spark, [(i, "x y", "en") for i in range(40) if zlib.crc32(str(i).encode()) % 10 == 0])).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in alone)


def test_repeated_documents_score_higher(spark):
    """What occurs twice is known to the model, what occurs once is not."""
    draw = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=60)), "en") for i in range(120)]
    rows += [(500 + i, rows[i][1], "en") for i in range(20)]
    got = {r.doc_id: r.score / r.n_tokens for r in maxent.score_documents(frame(spark, rows)).collect()}
    trained = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    twice = [got[i] for i in range(20) if trained(i) and trained(500 + i)]
    once = [got[i] for i in range(20, 120)]
    assert min(twice) > max(once)


def near_rows(seed=8):
    draw = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{draw.randint(0, 60)}" for _ in range(draw.randint(1, 60))]
        for _ in range(draw.randint(1, 12)):
            words = list(base)
            for _ in range(draw.randint(0, max(0, len(words) // 12))):
                words[draw.randrange(len(words))] = f"v{draw.randint(0, 9)}"
            rows.append((i, " ".join(words).replace("w1", "W1"), "en"))
            i += 1
    return rows


def test_near_duplicates_follow_the_contract(spark, tmp_path):
    rows = near_rows() + [(500, None, "en"), (501, "", "en"), (502, " ", "en"), (503, "one", "en"), (504, "ONE", "en"), (505, "One two", "en")]
    got = queries.op8_near_duplicates(spark, write(frame(spark, rows), tmp_path)).collect()
    want = brute.near_groups({d: t for d, t, _ in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    assert sum(not k for _, _, k in want.values()) > 20


def test_links_between_members_are_found(spark):
    """A chain: neighbours are linked, its ends are not, whoever stands for a bucket."""
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60]), "en") for i in range(40)]
    got = minhash.near_groups(frame(spark, rows)).collect()
    want = brute.near_groups({d: t for d, t, _ in rows}, width=5)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_one_of_each_group_stays(spark):
    rows = [*near_rows(), (500, "x y z", "en"), (500, "x y z", "en"), (None, "p q r", "en"), (600, None, "en")]
    df = frame(spark, rows)
    out = minhash.keep_one(df)
    assert out.columns == df.columns
    want = {d for d, (_, _, kept) in brute.near_groups({d: t for d, t, _ in near_rows()}, width=5).items() if kept}
    assert sorted(r.doc_id for r in out.filter("doc_id < 500").collect()) == sorted(want)
    assert out.filter("doc_id = 500").count() == 1 and out.filter("doc_id is null").count() == 1
    assert minhash.keep_one(df.limit(0)).collect() == []


def test_repeated_ids_with_different_texts(spark, monkeypatch):
    """One row a group stays, also where a doc_id comes with two texts, and where groups count as hot."""
    one, two, four = ("a b c d e f g h", "q r s t u v w x", "z y x w v u t s")
    rows = [(1, one, "en"), (2, one, "en"), (2, two, "en"), (3, two, "en"), (None, two, "en"), (2, "", "en"), (2, "", "en"), (4, four, "de")]
    rows += [(4, four, "de")] * 30 + [(10 + i, one, "fr") for i in range(30)]
    monkeypatch.setattr(skew, "LEAST", 4)
    monkeypatch.setattr(skew, "SHARE", 2)
    df = frame(spark, rows)
    kept = sorted(((r.doc_id, r.text) for r in minhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, one), (2, two), (2, ""), (2, ""), (4, four)], key=str)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_groups(df).collect()}
    assert {(2, 1, False), (2, 2, True), (None, 2, False), (3, 2, False), (4, 4, True), (39, 1, False)} <= got


def test_salted_joins_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 5)
    monkeypatch.setattr(skew, "SHARE", 8)
    many = spark.createDataFrame([(k, i) for k in range(20) for i in range(1 if k else 200)] + [(None, 1)], "k long, x long")
    few = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 2)] + [(0, "again")], "k long, v string")
    got = sorted(tuple(r) for r in skew.salted_join(many, few, "k", "x").select("k", "x", "v").collect())
    assert got == sorted(tuple(r) for r in many.join(few, "k").select("k", "x", "v").collect()) and len(got) > 400
    odd = skew.salted_join(many, few, "k", "x", F.col("x") % 2 == 1).select("k", "x", "v")
    assert odd.count() == sum(x % 2 for _, x, _ in got)
    assert skew.salted_join(many.limit(0), few, "k", "x").count() == 0


def test_key_filters_let_every_key_pass(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "key")
    rows = spark.range(3000).withColumn("wide", F.lit("x"))
    words = skew.key_filter(keys)
    likely, others = skew.split_by_filter(rows, F.col("id"), words)
    passed, kept_out = ({r.id for r in part.collect()} for part in (likely, others))
    assert passed >= set(range(0, 3000, 3)) and passed | kept_out == set(range(3000)) and not passed & kept_out
    assert len(passed) < 1010 and likely.columns == rows.columns
    nobody, all_rows = skew.split_by_filter(rows, F.col("id"), skew.key_filter(keys.limit(0)))
    assert nobody.count() == 0 and all_rows.count() == 3000


def test_bounds_lose_no_link(spark):
    """Marks of long sets collide, yet every link is found."""
    draw = random.Random(11)
    base = [f"w{k}" for k in range(900)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(60 + 4 * (i % 6)):
            words[draw.randrange(900)] = f"x{draw.randrange(40)}"
        rows.append((i, " ".join(words), "en"))
    got = minhash.near_groups(frame(spark, rows), width=2).collect()
    want = brute.near_groups({d: t for d, t, _ in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert got == {n: find(n) for u, v in edges if u != v for n in (u, v)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fingerprints_follow_the_contract(spark, tmp_path):
    draw = random.Random(9)
    vocabulary = "the of and to in red green blue cat dog tree house runs sees".split()
    rows = [(3 * i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 90))), "en") for i in range(150)]
    rows += [(1, rows[40][1], "en"), (2, None, "en"), (4, "", "en"), (5, "é😀!?", "en"), (7, "the", "en"), (10**9, "no anchors here whatsoever", "en")]
    rows += [(-5, "### $$$", "en")]
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, write(frame(spark, rows), tmp_path)).collect()}
    text = {d: t or "" for d, t, _ in rows}
    order = sorted(text)
    assert len(got) == len(rows)
    for i, d in enumerate(order):
        t, following = text[d], text[order[(i + 1) % len(order)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited)), d
        assert r.fingerprint == brute.fingerprint(t) and r.edited_fingerprint == brute.fingerprint(edited)
        assert r.near_edited == brute.jaccard(brute.spots(t), brute.spots(edited))
        assert r.near_next == brute.jaccard(brute.spots(t), brute.spots(following))
    assert got[1].fingerprint == got[rows[40][0]].fingerprint
    want = brute.alike_groups({d: brute.spots(t) for d, t in text.items()})
    assert {d: r.group_id for d, r in got.items()} == want and got[rows[40][0]].group_id == 1


def test_fingerprints_of_few_documents(spark, tmp_path):
    one = spotsigs.fingerprint_neighbours(frame(spark, [(1, "the red cat sat", "en")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.fingerprint_neighbours(frame(spark, [])).collect() == []
    twice = spotsigs.fingerprint_neighbours(frame(spark, [(1, "a", "en"), (1, "a", "en"), (None, "b", "en")])).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["1", "1", "None"]


def test_groups_of_like_documents(spark, monkeypatch):
    """Near copies, chains of them, lengths at the edge, repeated ids, and hot keys."""
    draw = random.Random(4)
    vocabulary = [*"the of and to".split(), *(f"w{k}" for k in range(80))]
    rows = []
    for i in range(30):
        words = draw.choices(vocabulary, weights=[8] * 4 + [1] * 80, k=120)
        for j in range(5):
            rows.append((i * 5 + j, " ".join(words)))
            words = list(words)
            for _ in range(3):
                words[draw.randrange(120)] = f"new{draw.randrange(9)}"
    rows += [(1000 + k, " ".join(f"the a{i} b{i}" for i in range(n))) for k, n in enumerate([4, 5, 6, 8, 10, 13, 16, 20, 21])]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(None, rows[0][1]), (None, "the only one"), (7, "another text of id seven"), (3000, None), (3001, "")]
    monkeypatch.setattr(skew, "LEAST", 6)
    monkeypatch.setattr(skew, "SHARE", 16)
    df = frame(spark, [(d, t, "en") for d, t in rows])
    sets = [brute.spots(t or "") for _, t in rows]
    root = brute.alike_groups(dict(enumerate(sets)))
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root[k]] = min([x for x in (least.get(root[k]), d) if x is not None], default=None)
    got = spotsigs.fingerprint_neighbours(df, spotsigs.document_groups(df)).collect()
    found = sorted((str(r.doc_id), r.fingerprint, str(r.group_id)) for r in got)
    want = sorted((str(d), brute.fingerprint(t or ""), str(least[root[k]])) for k, (d, t) in enumerate(rows))
    assert found == want
    assert len({g for _, _, g in want}) < len(rows) - 80
    assert spotsigs.document_groups(df.limit(0)).collect() == []


def test_length_partitions_keep_likely_pairs_together():
    least = spotsigs.length_partitions(80, 10_000)
    for n in range(1, 3000):
        a, b = (int(np.searchsorted(least, m, side="right")) for m in (n, n * 100 // 80))
        assert b - a <= 1


def test_keys_are_few_and_meet(spark):
    """Sets of each size around the edges of partitions share a key with all that are alike; in the next partition they have fewer."""
    draw = random.Random(8)
    sets = {}
    for n in [*range(1, 40), 98, 99, 100, 101, 121, 122, 124, 125, 126]:
        whole = draw.sample(range(1, 1 << 32), n)
        for drop in {0, n // 9, n // 5}:
            sets[len(sets)] = set(whole[drop:])
    rows = [(i, np.sort(np.array(list(s), dtype=np.uint32)).tobytes()) for i, s in sets.items()]
    got = {r.node: r for r in spotsigs._keyed(spark.createDataFrame(rows, "node long, set binary"), 80).collect()}
    for i, s in sets.items():
        assert got[i].n == len(s)
        assert len(got[i]["keys"]) == 2 * len(s) + 2 - -(-80 * len(s) // 100) - -(-160 * len(s) // 180)
        for j in range(i):
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                assert set(got[i]["keys"]) & set(got[j]["keys"])


def test_sets_of_four_bytes_are_compared(spark):
    sets = {1: [3, 5, 1 << 31], 2: [3, 1 << 31, (1 << 32) - 1], 3: [7]}
    rows = [(node, np.array(s, dtype=np.uint32).tobytes()) for node, s in sets.items()]
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "u long, v long")
    got = similar._compared(pairs, spark.createDataFrame(rows, "node long, set binary"), width=4).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 3, 3, 2), (1, 3, 3, 1, 0)]


def test_scratch_needs_a_shared_folder(spark):
    from granary.scratch import shared_root

    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.range(1).select(F.lit(1)).count() == 1
