"""Plain versions of the operators' rules over lists of (doc_id, text)."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NULL_ID = -(1 << 63)


def words(text):
    return WORD.findall(text or "")


def rank(doc_id):
    return NULL_ID if doc_id is None else doc_id


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def rows(found):
    return sorted((tuple(r) for r in found), key=repr)


def word_repeats(docs, width=35):
    count = collections.Counter()
    for _, text in docs:
        w = words(text)
        count.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = []
    for doc_id, text in docs:
        w, covered = words(text), set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                covered.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in covered)
        out.append((doc_id, len(w), len(covered), sha(kept)))
    return rows(out)


def byte_repeats(docs, width=50):
    first = {}
    for doc_id, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            s = b[i:i + width]
            first[s] = min(first.get(s, rank(doc_id)), rank(doc_id))
    out = []
    for doc_id, text in docs:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i:i + width]] < rank(doc_id):
                covered[i:i + width] = b"\1" * width
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((doc_id, len(b), sum(covered), spans,
                    sha(bytes(x for x, c in zip(b, covered) if not c))))
    return rows(out)


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words(lower)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def near_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = collections.Counter()
    for held in holders.values():
        shared.update((a, b) for k, a in enumerate(held) for b in held[k + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    low = {}
    for i, (doc_id, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), rank(doc_id)), rank(doc_id))
    out = []
    for i, (doc_id, _) in enumerate(docs):
        comp = low[find(i)]
        out.append((doc_id, len(sets[i]), None if comp == NULL_ID else comp, comp == rank(doc_id)))
    return rows(out)


def distance_within(pattern, text):
    """Least edit distance of the pattern to any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)
