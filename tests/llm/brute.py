"""Plain Python versions of the operators' results."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) pairs with ids of their own."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                k = len(x & y)
                if 100 * k >= 75 * (len(x) + len(y) - k):
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def suffix_dedup(docs, window=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}; number rows that share an id first"""
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + window] for _, b in raw for k in range(len(b) - window + 1))
    out = {}
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = 1
        runs = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[gone[:-1] == 0])))
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    mark = [False] * len(w)
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            mark[i : i + 5] = [True] * 5
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    n, rep = len(w), sum(mark)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(c - 1 for c in lines.values()), rep, n < 10 or 100 * rep > 20 * n)


def conversations(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)} of (conv_id, turn, role, text)"""
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    out = {}
    for c, turns in by.items():
        turns = sorted((t, r or "", x or "") for t, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def unigram(docs, held_out):
    """{doc_id: (n_tokens, n_known, N, base_score)}"""
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in docs}
    c = Counter(w for i, _ in docs if not held_out(i) for w in tokens[i])
    n, v = c.total(), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
