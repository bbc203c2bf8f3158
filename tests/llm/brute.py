"""The contracts in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = SPACED.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    best = dict(zip(ids, ids, strict=True))

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            best[max(a, b)] = min(a, b)
    return {x: find(x) for x in best}


def jaccard(docs):
    """doc_id: (n_shingles, component) of (doc_id, text) rows with different ids."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comps = components(ids, links)
    return {i: (len(sets[i]), comps[i]) for i in ids}


def repeats(texts, length, least_words=0):
    """(bytes, removed, runs, kept) of each text; runs with fewer words stay."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        runs = [(a, b) for a, b in runs if len(re.findall(rb"[^\x20\x09-\x0D]+", d[a:b])) >= least_words]
        kept = b"".join(d[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(d)], strict=True))
        out.append((len(d), sum(b - a for a, b in runs), len(runs), kept))
    return out


def benchmark(text, items, window=10):
    """(n_words, hit positions, items)."""
    w = ALNUM.findall(low(text))
    hit, found = set(), set()
    for item, phrase in items:
        p = ALNUM.findall(low(phrase))
        n = min(window, len(p))
        patterns = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in patterns:
                hit.update(range(i, i + n))
                found.add(item or "")
    return len(w), sorted(hit), sorted(found)


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = SPACED.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    w = ALNUM.findall(low(text))
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(p := phrase.split())] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def license_labels(text, rules, least):
    """labels, best priority: every rule whose keyword is in the text, then one detection after another, the best that overlaps none taken."""
    w = ALNUM.findall(low(text))
    said = " " + " ".join(w) + " "
    if not w:
        said = " "
    found = {(*m.span(), p, label) for p, label, key, pattern in rules if key in said for m in re.finditer(f"(?<= )(?:{pattern})(?= )", said)}
    taken = []
    while found:
        best = min(found, key=lambda x: (-x[2], -(x[1] - x[0]), x[0], x[3]))
        taken.append(best)
        found = {x for x in found if x[1] <= best[0] or x[0] >= best[1]}
    return {label for *_, p, label in taken if p >= least}, max((x[2] for x in taken), default=0)


def repeated_chars(text, n):
    """Share of the word characters in n-word windows that occur twice or more."""
    w = SPACED.findall(text or "")
    windows = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    many = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if many[x] > 1 for j in range(n)}
    return sum(len(w[i]) for i in hit) / max(1, sum(map(len, w)))


def repeated_line_chars(text):
    seen, share = set(), 0
    for line in (text or "").split("\n"):
        chars = sum(map(len, SPACED.findall(line)))
        share += chars if chars and line in seen else 0
        seen.add(line)
    return share / max(1, sum(map(len, SPACED.findall(text or ""))))


def lm_base(docs):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    toks = [(i, [*SPACED.findall(low(t)), None]) for i, t in docs]
    c = Counter(x for i, t in toks if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for i, t in toks]


def targets(sizes, weights=(5, 2, 1), most=3):
    """source: target."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def by_key(rows):
    out = defaultdict(list)
    for k, v in rows:
        out[k].append(v)
    return {k: sorted(v, key=str) for k, v in out.items()}
