"""Plain Python versions of operators, for tests."""

import re
import struct
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(rows, n, percent):
    """[(key, text)] -> least key of each text's near-duplicate component, by all pairs."""
    sets = {}
    for key, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = WORD.findall(low)
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def targets(size):
    """Words by source -> target by source: weights 1, 2, 3 in code point order, null last; never above 3 times the size."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        left, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            return target
        full |= over


def xxhash64(doc_id, seed):
    first = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    out = xxhash.xxh64(struct.pack("<i", seed), seed=first).intdigest()
    return out - (1 << 64) if out >= 1 << 63 else out


def mix(rows, seed=17, fills=3):
    """[(doc_id, source, size)], ids distinct -> copies by doc_id: Pareto order sampling with certain whole copies."""
    size, spread = defaultdict(int), defaultdict(float)
    for _, s, n in rows:
        size[s] += n
        spread[s] += n**1.5
    goal, copies = targets(dict(size)), {}
    for s in size:
        whole = int(goal[s] // size[s]) if size[s] else 0
        missing = goal[s] - whole * size[s]
        ranked = []
        for doc_id, own, n in rows:
            if own == s:
                copies[doc_id] = whole if n else 0
                if n and missing > 0:
                    draw = ((xxhash64(doc_id, seed) % (1 << 50)) + 0.5) / (1 << 50)
                    chance = missing * n**0.5 / spread[s]
                    ranked.append((0.0 if chance >= 1 else draw / (1 - draw) * (1 - chance) / chance, doc_id, n))
        taken, more, so_far = 0, set(), 0
        for _, doc_id, n in sorted(ranked):
            so_far += n
            if so_far > missing:
                break
            more.add(doc_id)
            taken += n
        for _ in range(fills):
            gap = missing - taken
            spare = [(abs(n - gap), r, d, n) for r, d, n in ranked if d not in more and abs(n - gap) < gap]
            if spare:
                _, _, d, n = min(spare)
                more.add(d)
                taken += n
        for d in more:
            copies[d] += 1
    return copies
