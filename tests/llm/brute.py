"""Plain-Python versions of the operators, written from their definitions."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import xxhash

BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def late(v):
    return (v is None, v)


def lines(docs, t=0.8):
    """(doc_id, text) pairs without the lines that match an earlier line, in the order of ``docs``."""
    seen, gone = [], {}
    for d, text in sorted(set(docs), key=lambda r: late(r[0])):
        gone[d, text] = out = set()
        for i, line in enumerate((text or "").split("\n")):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if not s:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                out.add(i)
            seen.append(s)
    result = []
    for d, text in docs:
        g = gone[d, text]
        result.append((d, text if not g else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in g), len(g)))
    return result


def simhash(text, ngram):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + ngram]) for i in range(max(1, len(w) - ngram + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(fps, most=4):
    """Index of the class of each fingerprint."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def overlaps(docs, items, window=15, wrong=2):
    """{(doc_id, item_id): most agreeing tokens in a window}."""
    def split(s):
        return [w for w in BETWEEN.split((s or "").lower()) if w]

    found = {}
    for i, text in items:
        item = split(text)
        n = min(window, len(item))
        need = window - wrong if len(item) >= window else n
        if not n:
            continue
        places = collections.defaultdict(list)
        for j, w in enumerate(item):
            places[w].append(j)
        for d, body in docs:
            words = split(body)
            for shift, hits in collections.Counter(p - j for p, w in enumerate(words) for j in places.get(w, ())).items():
                if hits < need:
                    continue
                same = [0 <= shift + j < len(words) and words[shift + j] == item[j] for j in range(len(item))]
                same = same[max(0, -shift):len(words) - shift]
                best = max((sum(same[k:k + n]) for k in range(len(same) - n + 1)), default=0)
                if best >= need:
                    found[d, i] = max(best, found.get((d, i), 0))
    return found


#: Patterns of the personal-data query (fixed values).
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    """Base spans (start, order, kind, end, value)."""
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    return sorted((m.start(), o, k, m.end(), m[0]) for o, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))


def pii_terms(docs, words=4, reach=64, generalise=0.9, remove=0.97):
    """{(doc_id, text): added spans} by the disclosure of terms beside base spans."""
    term, near, mentions, counts = re.compile(r"[^\W_]+"), set(), collections.Counter(), collections.Counter()
    for d, text in docs:
        text = text or ""
        counts.update(w for w in term.findall(text.lower()))
        spans = pii(text)
        for s, _, kind, e, v in spans:
            entity = f"{kind}:{v.lower()}"
            mentions[entity] += 1
            lo = max(0, s - reach)
            before = [(m.start() + lo, m.end() + lo) for m in term.finditer(text[lo:s]) if m.start() > 0 or s <= reach][-words:]
            after = [(m.start() + e, m.end() + e) for m in term.finditer(text[e:e + reach]) if m.end() < reach][:words]
            for a, b in before + after:
                if not any(x[0] < b and x[3] > a for x in spans):
                    near.add((d, text, entity, a, b, text[a:b].lower()))
    both, total, out = collections.Counter((x[2], x[5]) for x in near), sum(counts.values()), collections.defaultdict(dict)
    for d, text, entity, a, b, w in near:
        n = both[entity, w]
        if n < 2:
            continue
        disclosed = 1 + math.log2(min(1, n / counts.get(w, n))) / math.log2(max(2, total / mentions[entity]))
        if disclosed >= generalise:
            kind = (5, "remove") if disclosed >= remove else (4, "generalise")
            out[d, text][a, b] = max(kind, out[d, text].get((a, b), (0, "")))
    return out


def held_out(doc_id, folds):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 2


def base_scores(docs, folds=7):
    """{doc_id: (n_tokens, n_known, base)} and the number of training tokens."""
    def tokens(t):
        return (t or "").encode().lower().split() + [b"\n"]

    c = collections.Counter()
    for d, t in docs:
        if not held_out(d, folds):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (len(w), sum(x in c for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in ((d, tokens(t)) for d, t in docs)}, n


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()
