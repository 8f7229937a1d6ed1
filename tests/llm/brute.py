"""Plain Python versions of the operators' contracts, one text at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shards(text: str | None) -> dict:
    raw = (text or "").encode()
    return {"size": len(raw) + 8, "text_crc32": zlib.crc32(raw)}


def secrets(text: str | None) -> dict:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ("assign", "access", "hex")
    base = [f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)]
    n = Counter(k for _, k, _ in found)
    return {
        "n_assign": n[0],
        "n_access": n[1],
        "n_hex": n[2],
        "base": base,
        "base_sha256": sha(",".join(base)),
    }


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def conversations(rows) -> dict:
    """rows of (conv_id, turn, role, text)."""
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        by_id[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by_id.items():
        turns.sort(key=lambda t: ((t[0] is not None, t[0] or 0), t[1].encode(), t[2].encode()))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = {
            "n_turns": len(turns),
            "turns_sha256": sha("".join(f"{role}\n{t}\n" for _, role, t in turns)),
            "loss_chars": len(loss),
            "loss_sha256": sha(loss),
        }
    return out


def targets(sizes: dict, repeats: int = 3) -> dict:
    """Water filling: sizes by source in rank order -> target by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: repeats * sizes[s] for s in over}


def shingles(text: str | None, width: int = 2) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if len(words) < width:
        return frozenset({tuple(words)} if words else ())
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_groups(docs: dict, percent: int = 80, width: int = 2) -> dict:
    """doc_id -> (set size, component_id, kept), by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(d for d in docs if sets[d])
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small < percent * large:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in docs}


def unigram(docs: dict, modulus: int = 10) -> dict:
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score."""
    import math

    held = {d: zlib.crc32(str(d).encode()) % modulus == 0 for d in docs}
    tokens = {d: [*WORD.findall(lower(t or "")), "\n"] for d, t in docs.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {
        d: {
            "held_out": held[d],
            "n_tokens": len(ws),
            "n_known": sum(counts[w] > 0 for w in ws),
            "train_tokens": total,
            "base_score": sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws),
        }
        for d, ws in tokens.items()
    }


def languages(training: list, texts: list) -> list[tuple[str, float]]:
    """(lang, score) of each text after rows (doc_id, text, lang)."""
    import math

    letters = re.compile(r"[^\W\d_]+")

    def keys(word: str) -> list[tuple[int, str]]:
        found = [(0, word)] + [(1, c) for c in word]
        padded = f"<{word}>"
        return found + [(n, padded[i : i + n]) for n in range(2, 6) for i in range(len(padded) - n + 1)]

    langs = sorted({lang for _, _, lang in training})
    counts: dict = defaultdict(Counter)
    for _, text, lang in training:
        for word in letters.findall((text or "").lower()):
            for key in keys(word):
                counts[key][lang] += 1
    total = {(n, lang): sum(c[lang] for (m, _), c in counts.items() if m == n) for n in range(6) for lang in langs}
    distinct = Counter(n for n, _ in counts)

    def log(key: tuple, lang: str) -> float:
        return math.log(counts[key][lang] + 0.5) - math.log(total[key[0], lang] + 0.5 * (distinct[key[0]] + 1))

    def score(word: str) -> list[float]:
        for n in (0, 5, 4, 3, 2, 1):
            seen = [k for k in keys(word) if k[0] == n and k in counts]
            if seen:
                return [sum(log(k, lang) for k in seen) / len(seen) for lang in langs]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        times = Counter(letters.findall((text or "").lower()))
        if not times:
            out.append(("und", 0.0))
            continue
        logs = [0.0] * len(langs)
        for word, n in times.items():
            logs = [a + n * b for a, b in zip(logs, score(word), strict=True)]
        best = max(range(len(langs)), key=lambda i: logs[i])
        out.append((langs[best], 1 / sum(math.exp(max(-700.0, x - logs[best])) for x in logs)))
    return out


def spots(text: str) -> frozenset:
    """Signatures as texts: a common word with the two other words after it, and plain runs where these are sparse."""
    from granary.llm.spotsigs import ANCHORS

    words = re.findall(r"[^\W_]+", text.lower())
    found = set()
    for i, word in enumerate(words):
        if word in ANCHORS:
            chain = [w for w in words[i + 1 :] if w not in ANCHORS][:2]
            if chain:
                found.add(" ".join([word, *chain]))
    if len({_xx(x) for x in found}) * 20 < len(words):
        found |= {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return frozenset(map(_xx, found or ({text} if text else ())))


def _xx(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text)


def fingerprint(text: str) -> str:
    return "".join(f"{x:08x}" for x in sorted(spots(text)))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def alike_groups(sets: dict, percent: int = 80) -> dict:
    """id -> smallest id that links reach, by comparing all pairs; empty sets are linked with nothing."""
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(d for d in sets if sets[d])
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in sets}


def maxent_scores(training: list, texts: list, weights, bias, frequent: set) -> list[float]:
    """log10 probability of each text by the language model with these class weights and frequent word ids."""
    import math

    from granary.llm import maxent

    def tokens(text):
        return [maxent.word_id(w) for w in maxent.split((text or "").encode())]

    def klass(word):
        return word % maxent.CLASSES

    counts = Counter(w for t in training for w in tokens(t))
    n_class, v_class = Counter(), Counter()
    for w, n in counts.items():
        n_class[klass(w)] += n
        v_class[klass(w)] += 1

    def share(word):
        k = klass(word)
        total = n_class[k] + 0.1 * (v_class[k] + 1)
        if word in frequent:
            return (counts[word] + 0.1) / total
        mine = [w for w in frequent if klass(w) == k]
        left = total - sum(counts[w] + 0.1 for w in mine)
        return left / (v_class[k] - len(mine) + 1) / total

    pairs = Counter()
    for t in training:
        for before, word in zip([0, *tokens(t)], tokens(t), strict=False):
            pairs[before, klass(word), word] += 1
    by_context = defaultdict(dict)
    for (before, k, word), n in pairs.items():
        by_context[before, k][word] = n

    def in_class(before, word):
        seen = by_context.get((before, klass(word)), {})
        features = {w: n for w, n in seen.items() if n >= maxent.FEATURE_COUNT}
        if not features:
            return share(word)
        total = sum(seen.values())
        if word in features:
            return (features[word] - maxent.DISCOUNT) / total
        left = 1 - sum(n - maxent.DISCOUNT for n in features.values()) / total
        return left * share(word) / (1 - sum(map(share, features)))

    def in_classes(before, skipped, word):
        mask = (1 << 64) - 1
        one, two = before & mask, skipped & mask
        both = (one * 31 + two * 17 + 7) & mask
        rows = [((key * int(salt) & mask) >> 40) % maxent.BUCKETS for key, salt in zip((one, two, both), maxent._SALTS, strict=True)]
        logits = [float(bias[k]) + sum(float(weights[r][k]) for r in rows) for k in range(maxent.CLASSES)]
        most = max(logits)
        return math.exp(logits[klass(word)] - most) / sum(math.exp(x - most) for x in logits)

    out, known = [], {}
    for text in texts:
        words = tokens(text)
        total = 0.0
        for i, word in enumerate(words):
            key = (words[i - 1] if i else 0, words[i - 2] if i > 1 else 0, word)
            if key not in known:
                known[key] = math.log10(in_classes(*key)) + math.log10(in_class(key[0], word))
            total += known[key]
        out.append(total)
    return out


def line_frequency(rows: list, most: int, least_share: float) -> list[tuple[bool, int]]:
    """(kept, words left) of each (text, host)."""

    def normal(line):
        return re.sub("[0-9]", "0", line.strip(" \t\n\x0b\x0c\r").lower())

    lines = [[x for x in (t or "").split("\n") if WORD.search(x)] for t, _ in rows]
    seen = defaultdict(set)
    for (_, host), own in zip(rows, lines, strict=True):
        for x in own:
            seen[host, normal(x)].add(tuple(map(normal, own)))
    out = []
    for (text, host), own in zip(rows, lines, strict=True):
        n = len(WORD.findall(text or ""))
        left = n - sum(len(WORD.findall(x)) for x in own if len(seen[host, normal(x)]) > most)
        out.append((not quality(text)["base_failed"] and left >= least_share * n, left))
    return out
