"""Plain versions of the contracts, over lists of rows: no Spark, no hashing, no pruning."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCHMARK_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SECRETS = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spread(n: int, starts, size: int) -> set[int]:
    return {j for k in starts for j in range(k, min(k + size, n))}


def decontaminate(texts, items) -> list[dict]:
    owners = defaultdict(set)
    for item, text in items:
        w = BENCHMARK_WORD.findall(lower(text))
        for k in range(max(len(w) - 13, 0) + 1 if w else 0):
            owners[tuple(w[k : k + 13])].add(str(item))
    out = []
    for text in texts:
        w, hit, found = BENCHMARK_WORD.findall(lower(text)), set(), set()
        for size in {len(k) for k in owners}:
            for k in range(len(w) - size + 1):
                if own := owners.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out.append({
            "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": sha(",".join(sorted(found))),
            "contaminated": len(hit) > 0 and 20 * len(hit) >= len(w),
        })
    return out


def substrings(texts, size: int = 35) -> list[dict]:
    split = [words(t) for t in texts]
    counts = Counter(tuple(w[k : k + size]) for w in split for k in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = spread(len(w), [k for k in range(len(w) - size + 1) if counts[tuple(w[k : k + size])] > 1], size)
        out.append({
            "n_words": len(w), "n_removed": len(gone), "kept_sha256": sha(" ".join(x for k, x in enumerate(w) if k not in gone)),
        })
    return out


def quality(texts) -> list[dict]:
    out = []
    for text in texts:
        w = words(text)
        counts = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = spread(len(w), [k for k in range(len(w) - 4) if counts[tuple(w[k : k + 5])] > 1], 5)
        seen, repeats = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        out.append({
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": repeats, "n_repeat_words": len(again),
            "base_failed": len(w) < 10 or 100 * len(again) > 20 * len(w),
        })
    return out


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    return sorted(
        (m.start(), number, m.end())
        for number, (_, pattern, group, least) in enumerate(SECRETS)
        for m in pattern.finditer(text or "") if len(m[group]) >= least
    )


def secrets(texts) -> list[dict]:
    out = []
    for text in texts:
        spans = secret_spans(text)
        n = Counter(k for _, k, _ in spans)
        out.append({
            "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
            "base_sha256": sha(",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in spans)),
        })
    return out


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(texts) -> tuple[list[int], list[int]]:
    """For each text: the first text of its group, and its links."""
    sets = [shingles(t) for t in texts]
    owners = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            owners[g].append(k)
    shared = Counter(pair for v in owners.values() for pair in combinations(v, 2))
    parent, links = list(range(len(sets))), [0] * len(sets)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return [root(k) for k in range(len(sets))], links


def targets(sizes: dict) -> dict:
    """Shares dealt out again and again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(order)
    while left:
        rest = total - sum(target.values())
        per = rest / sum(weight[s] for s in left)
        over = [s for s in left if per * weight[s] > 2 * sizes[s]]
        for s in over or left:
            target[s] = 2.0 * sizes[s] if over else per * weight[s]
        left -= set(over or left)
    return target


def discounts(counts):
    c = Counter(counts)
    if not (c[1] and c[2] and c[3]):
        return [0, 0.5, 1.0, 1.5]
    y = c[1] / (c[1] + 2 * c[2])
    raw = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]]
    return [0, *[min(max(x, 0.0), k + 1.0) for k, x in enumerate(raw)]]


def scores(train, texts, order):
    """log10 probabilities under interpolated modified Kneser-Ney, from n-grams as tuples."""
    padded = lambda t: ["\0begin"] * (order - 1) + words(lower(t)) + ["\0end"]
    levels = {order: Counter(tuple(p[k : k + order]) for p in map(padded, train) for k in range(len(p) - order + 1))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    d = {n: discounts(c.values()) for n, c in levels.items()}
    followers = {n: defaultdict(list) for n in levels}
    for n, grams in levels.items():
        for g, c in grams.items():
            followers[n][g[:-1]].append(c)
    sums = {n: {u: (sum(d[n][min(x, 3)] for x in seen), sum(seen)) for u, seen in f.items()} for n, f in followers.items()}

    def p(context, w):
        n = len(context) + 1
        below = p(context[1:], w) if context else 1 / (len(levels[1]) + 1)
        if context not in sums[n]:
            return below
        free, seen = sums[n][context]
        c = levels[n][(*context, w)]
        return (max(c - d[n][min(c, 3)], 0) + free * below) / seen

    out = []
    for text in texts:
        t = padded(text)
        out.append(sum(math.log10(p(tuple(t[k - order + 1 : k]), t[k])) for k in range(order - 1, len(t))))
    return out


def kneser_ney(train, texts, order: int) -> list[dict]:
    """The scoring contract, with a model of any order."""
    single = Counter(w for t in train for w in [*words(lower(t)), "\0end"])
    n, v = sum(single.values()), len(single)
    out = []
    for text, score in zip(texts, scores(train, texts, order), strict=True):
        t = [*words(lower(text)), "\0end"]
        out.append({
            "n_tokens": len(t), "n_known": sum(w in single for w in t), "train_tokens": n, "score": score,
            "base_score": sum(math.log10((single[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
        })
    return out


def collocations(rows, least: int, max_words: int = 5) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    often = {p: c for p, c in counts.items() if c >= least}
    covered = {
        (q[0], *q[i:j]) for q, c in often.items() for i in range(1, len(q)) for j in range(i + 1, len(q) + 1)
        if j - i < len(q) - 1 and c >= often[(q[0], *q[i:j])]}
    kept = defaultdict(list)
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = often[(lang, *w[:k])], often[(lang, *w[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        if (lang, *w) not in covered:
            score, _, left, right = min(cuts)
            kept[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in kept.items() for rank, (s, a, p, left, right) in enumerate(sorted(found), 1))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k: int = 10) -> list[tuple]:
    """(item, rank, doc, score) of (doc_id, text) and (item_id, text) rows; documents without an id come last."""
    split = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    split = [(i, c, c.total()) for i, c in split if c]
    total, df = sum(n for _, _, n in split), Counter(t for _, c, _ in split for t in c)
    weight = {t: math.floor(1000 * math.log((2 * len(split) + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c, n in split:
            m = 10 + 90 * n * len(split) // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if lost else i, -s) for r, (s, lost, i) in enumerate(sorted(found)[:k], 1)]
    return out


def licenses(texts, rules, phrases, kinds, strength) -> list[dict]:
    """Rules on words joined by spaces, detections compared pair by pair."""
    out = []
    for text in texts:
        w = BENCHMARK_WORD.findall(lower(text))
        line = f" {' '.join(w)} "
        number = lambda at: line.count(" ", 0, at)
        base = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found = []
        for n, r in enumerate(rules):
            if r.keyword in w:
                found += [(number(m.start() + 1) - 1, number(m.end()), r.kind, n) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line)]
        order = lambda d: (d[0], -d[1], d[2], d[3])
        stay = [d for d in found if not any(
            e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and order(e) < order(d) for e in found)]
        scores = [strength[kinds[d[2]]] for d in stay] + [strength["name"]] * bool(base)
        out.append({
            "n_words": len(w), "n_base": len(base), "first_word": min((k for k, _ in base), default=None),
            "last_word": max((k for k, _ in base), default=None), "base_labels": ",".join(sorted({x for _, x in base})),
            "labels": ",".join(sorted({x for _, x in base} | {rules[d[3]].label for d in stay})), "score": max(scores, default=0.0),
            "spans": sorted(d[:2] for d in stay),
        })
    return out
