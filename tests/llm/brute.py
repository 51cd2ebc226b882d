"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SPACE = b" \t\n\x0b\x0c\r"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def removed_windows(docs, window=13):
    """docs: [(doc_id, text)]; {row: (n_words, n_removed, sha)}"""
    words = [(t or "").encode().split() for _, t in docs]
    key = [2**63 - 1 if d is None else d for d, _ in docs]
    least = {}
    for k, w in zip(key, words):
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            least[s] = min(least.get(s, k), k)
    out = []
    for k, w in zip(key, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), sha(kept)))
    return out


def removed_bytes(docs, length=200, keep_first=False):
    texts = [(t or "").encode() for _, t in docs]
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    out = []
    rank = sorted(range(len(docs)), key=lambda i: (2**63 - 1 if docs[i][0] is None else docs[i][0], texts[i], i))
    place = {i: k for k, i in enumerate(rank)}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            who = seen[t[p : p + length]]
            if len(who) > 1 and not (keep_first and min(who, key=lambda x: (place[x[0]], x[1])) == (i, p)):
                gone[p : p + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), spans, sha(kept)))
    return out


def simhash(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(docs, words=3, radius=2):
    f = [simhash(t, words) for _, t in docs]
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(f, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius).tolist():
            parent[find(i)] = find(i + 1 + j)
    key = [2**63 - 1 if d is None else d for d, _ in docs]
    least = {}
    for i, k in enumerate(key):
        least[find(i)] = min(least.get(find(i), k), k)
    return [(f"{x:016x}", None if least[find(i)] == 2**63 - 1 else least[find(i)]) for i, x in enumerate(f)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def golden_mix(docs, most=3, seed=42):
    """docs: [(doc_id, source, size)]; [(doc_id, size, taken, first slot)]: each slot in turn takes the next words of its source."""
    from ledgerloom.llm import mixing

    total = {}
    for _, s, n in docs:
        total[s] = total.get(s, 0) + n
    target = mixing.shares(list(total.items()))
    order = sorted(range(len(docs)), key=lambda i: hashlib.md5(f"{seed}|{'null' if docs[i][0] is None else docs[i][0]}|{docs[i][2]}".encode()).hexdigest())
    taken, first = [0] * len(docs), [None] * len(docs)
    for tier in mixing.tiers(target):
        edges = np.cumsum(tier.shares)[:-1].tolist()
        queue = {s: [i for _ in range(most) for i in order if docs[i][1] == s for _ in range(docs[i][2])] for s in tier.names}
        at = dict.fromkeys(tier.names, 0)
        for slot in range(tier.slots):
            point = (slot * 0x9E3779B97F4A7C15 % 2**64 >> 11) / 2**53
            s = tier.names[sum(e <= point for e in edges)]
            for i in queue[s][at[s] : at[s] + tier.block]:
                taken[i] += 1
                first[i] = slot if first[i] is None else first[i]
            at[s] += tier.block
    return [(d, n, t, f) for (d, _, n), t, f in zip(docs, taken, first)]
