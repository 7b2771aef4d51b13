"""What the operators should give, done plainly, one row after the other."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"


def hash48(*parts):
    return int(hashlib.md5(":".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:12], 16)


def counts(text):
    """Words, their characters, symbols, repeated lines, words in repeated windows."""
    t = text or ""
    w = re.findall(WORD, t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def base_failed(text):
    n, _, _, _, repeats = counts(text)
    return n < 10 or 100 * repeats > 20 * n


def cleaned(rows, least=3, share=0.02, most=1000, min_left=0.3):
    """rows (doc_id, text, host): those that the rules keep, texts without the lines above the limits."""
    normal = lambda x: " ".join(re.findall(WORD, x.lower()))
    texts, having, first = {}, {}, {}
    for i, t, h in rows:
        texts.setdefault(h, set()).add(t)
        for line in {normal(x) for x in (t or "").split("\n")} - {""}:
            having.setdefault((h, line), set()).add(t)
            if i is not None:
                first[h, line] = min(i, first.get((h, line), i))
    gone = {k for k, v in having.items() if len(v) > max(least, min(most, share * len(texts[k[0]])))}
    out = []
    for i, t, h in rows:
        lines = (t or "").split("\n")
        lost = [(h, normal(x)) in gone and i != first.get((h, normal(x))) for x in lines]
        left = sum(len(re.findall(WORD, x)) for x, bad in zip(lines, lost, strict=True) if not bad)
        if not base_failed(t) and not left < counts(t)[0] * min_left:
            out.append((i, "\n".join(x for x, bad in zip(lines, lost, strict=True) if not bad) if any(lost) else t, h))
    return out


def groups(rows, n, percent):
    """doc_id -> (set size, component): every pair compared."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(low))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def water_fill(sizes, weights, cap):
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i] + 1e-9]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
            open_.remove(i)
    return targets


def mixed(rows):
    """rows (doc_id, words, source): doc_id -> copies that the mix takes, whole."""
    names = sorted({s for _, _, s in rows if s is not None}, key=str.encode) + [None] * any(s is None for _, _, s in rows)
    sizes = [sum(n for _, n, s in rows if s == name) for name in names]
    targets = water_fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    out = Counter()
    for name, size, target in zip(names, sizes, targets, strict=True):
        take = math.floor(target + 0.5)
        passes, before = (take // size if size else 0), 0
        for i, n, _ in sorted((r for r in rows if r[2] == name), key=lambda r: (hash48(r[0], "mix"), r[0], r[1])):
            extra = max(0, min(take - passes * size - before, n))
            out[i] += (passes + (2 * extra >= n)) if n else 0
            before += n
    return +out


def terms(text, q):
    """The counts of a text by column, from the definitions in quality_classifier."""
    out = np.zeros(q.COLUMNS)
    for at in range(0, len(text), q.PIECE):
        piece = text[at : at + q.PIECE] + b"\n"
        c = [int(q.CLASS[b]) for b in piece]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            out[q.TERM[(x * 26 + y) * 26 + z]] += 1
        words = [int(q.word_hashes([w])[0][0]) for w in re.findall(rb"[^\x20\x09-\x0D]+", piece)]
        for i, w in enumerate(words):
            for k in range(1, q.REPEATS + 1):
                out[q.HASHED + k - 1] += i >= k and words[i - k] == w
            out[q.HASHED + q.REPEATS + w % q.WORDS] += 1
            if i:
                pair = int(q.mixed(np.array([(words[i - 1] * 3 + w) % 2**64], dtype=np.uint64))[0])
                out[q.HASHED + q.REPEATS + q.WORDS + pair % q.PAIRS] += 1
    return out


def vote(text, model, q):
    """The score of a text by all cosines, sorted."""
    x = np.log1p(terms(text, q)) * model.idf
    style = q.HASHED + q.REPEATS
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    v = unit(np.concatenate((unit(x[:style]), q.LEXICAL * unit(x[style:]))) @ model.axes)
    near = sorted(((-round(float(v @ w), 6), i) for i, w in enumerate(model.vectors)))[: q.NEIGHBOURS]
    weights = [max(-c, 0) ** q.SHARPNESS for c, _ in near]
    return sum(w * model.labels[i] for w, (_, i) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-9 else model.mean
