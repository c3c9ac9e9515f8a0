"""Plain-Python versions of the operators, by their definitions."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text, shingle=3):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i: i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """Group number of each of n things, by the pairs that ``linked`` accepts."""
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def repeated_bytes(data, window=50):
    """Per (id, bytes) the bytes that stay."""
    rank = lambda i: math.inf if i is None else i
    first = {}
    for i, b in data:
        for a in range(len(b) - window + 1):
            w = b[a: a + window]
            first[w] = min(first.get(w, math.inf), rank(i))
    out = []
    for i, b in data:
        gone = set()
        for a in range(len(b) - window + 1):
            if first[b[a: a + window]] < rank(i):
                gone.update(range(a, a + window))
        out.append(bytes(x for p, x in enumerate(b) if p not in gone))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """Target per source by sharing the excess again until none is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            out.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def mix(docs, most=3):
    """Copies taken of each (id, source, text, tag), in order."""
    size = [len(WORD.findall(t or "")) for _, _, t, _ in docs]
    total = defaultdict(int)
    for (_, s, _, _), n in zip(docs, size):
        total[s] += n
    goal = targets(dict(total), most=most)
    rank = {s: k for k, s in enumerate(sorted(goal, key=lambda s: (s is None, (s or "").encode())))}
    key = lambda i: int(hashlib.md5(("mix:" + ("null" if i is None else str(i))).encode()).hexdigest()[:15], 16)
    queue = sorted(range(len(docs)), key=lambda k: (key(docs[k][0]), docs[k][0] if docs[k][0] is not None else -math.inf, size[k], docs[k][3]))
    cum, copies = defaultdict(int), []
    for turn in range(most):
        for k in queue:
            s = docs[k][1]
            if size[k] and goal[s] > 0:
                cum[s] += size[k]
                copies.append((cum[s] / goal[s], rank[s], cum[s], k))
    taken, used, budget = [0] * len(docs), 0, sum(size)
    for _, _, _, k in sorted(copies):
        used += size[k]
        if used > budget:
            break
        taken[k] += 1
    return size, dict(total), goal, taken
