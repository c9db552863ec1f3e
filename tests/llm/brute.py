"""Slow, plain versions of the corpus operators."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def order(doc_id):
    return 2**63 - 1 if doc_id is None else doc_id


def removed(docs, window):
    """docs: (doc_id, sequence). Positions of each row covered by windows that start in an earlier document too."""
    first = {}
    for i, seq in docs:
        for k in range(len(seq) - window + 1):
            w = tuple(seq[k : k + window])
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, seq in docs:
        gone = set()
        for k in range(len(seq) - window + 1):
            if first[tuple(seq[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        out.append(gone)
    return out


def substring_digest(docs):
    seqs = [(i, WORD.findall(t or "")) for i, t in docs]
    return [(i, len(s), len(g), hashlib.sha256(" ".join(w for k, w in enumerate(s) if k not in g).encode()).hexdigest()) for (i, s), g in zip(seqs, removed(seqs, 13))]


def suffix_digest(docs):
    seqs = [(i, (t or "").encode()) for i, t in docs]
    return [(i, len(s), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(bytes(b for k, b in enumerate(s) if k not in g)).hexdigest()) for (i, s), g in zip(seqs, removed(seqs, 50))]


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def components(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(lambda: order(None))
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least[find(k)], order(i))
    return [(i, len(sets[k]), i if not sets[k] else None if least[find(k)] == order(None) else least[find(k)]) for k, (i, _) in enumerate(docs)]


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall(lower(t))
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    names |= own
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def quality_base(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        again = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    return out
