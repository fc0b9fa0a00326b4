"""Plain versions of the operators, for small inputs: no Spark, no clever shortcuts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def substrings(docs: list[tuple], window: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) by counting every window."""
    cut = [(doc_id, words(text)) for doc_id, text in docs]
    seen = Counter(tuple(w[i : i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text: str | None, k: int = 3) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[tuple], max_bits: int = 3) -> dict:
    """doc_id -> smallest doc_id reachable, from (doc_id, fingerprint) and all pairs."""
    nodes = sorted({f for _, f in prints})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if bin(a ^ b).count("1") <= max_bits:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for doc_id, f in prints:
        low[find(f)].append(doc_id)
    return {d: min((x for x in low[find(f)] if x is not None), default=None) for d, f in prints}


def edit_distance_inside(item: str, text: str) -> int:
    """The least edits that turn the whole item into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        after = [i]
        for j, b in enumerate(text, 1):
            after.append(min(row[j - 1] + (a != b), row[j] + 1, after[-1] + 1))
        row = after
    return min(row)
