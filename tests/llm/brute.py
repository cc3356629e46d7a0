"""Plain versions of the contracts, one document or pair at a time."""

import hashlib
import re
from collections import defaultdict

import xxhash

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def fingerprint(text, width=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, radius=4):
    """doc_id -> smallest reachable id, over (doc_id, fingerprint)."""
    up = {i: i for i in range(len(prints))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        least[root(i)].append(d)
    return {d: min(least[root(i)]) for i, (d, _) in enumerate(prints)}


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def contamination(text, items, n=10):
    """(n_words, n_hit, sorted item ids)"""
    ws, hit, found = words(text), set(), set()
    for item, body in items:
        ts = words(body)
        size = min(n, len(ts))
        grams = {tuple(ts[i : i + size]) for i in range(len(ts) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if size and tuple(ws[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(item)
    return len(ws), len(hit), sorted(map(str, found))


def capacity(sizes, shards):
    """Smallest capacity of a contiguous partition, by dynamic programming."""
    best = [0] + [10**18] * len(sizes)
    for _ in range(shards):
        new = best[:]
        for j in range(1, len(sizes) + 1):
            total = 0
            for i in range(j, 0, -1):
                total += sizes[i - 1]
                new[j] = min(new[j], max(best[i - 1], total))
        best = new
    return best[-1]


def lines_cut(docs, least=8):
    """doc -> lines in a run of ``least`` words or more that any earlier document holds in a row; every pair of documents."""
    parts = {}
    for d, t in docs:
        body = [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n"))]
        parts[d] = [(i, x, len(x.split())) for i, x in body if x]
    seen = {d: {x for _, x, _ in lines} for d, lines in parts.items()}
    out = {}
    for d, mine in parts.items():
        out[d] = set()
        for s in (s for s in parts if s < d and not seen[s].isdisjoint(seen[d])):
            theirs = [x for _, x, _ in parts[s]]
            places = defaultdict(list)
            for at, x in enumerate(theirs):
                places[x].append(at)
            for a, (i, x, _) in enumerate(mine):
                for at in places[x]:
                    n, words = 0, 0
                    while a + n < len(mine) and at + n < len(theirs) and mine[a + n][1] == theirs[at + n]:
                        words += mine[a + n][2]
                        n += 1
                    if words >= least:
                        out[d] |= set(range(i, mine[a + n - 1][0] + 1))
    return out


def lines_left(docs, least=8):
    cut = lines_cut(docs, least)
    return {d: t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut[d]) for d, t in docs}
