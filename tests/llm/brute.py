"""Brute-force versions that several tests share."""

from collections import Counter


def runs(text, width=5):
    w = text.encode().split()
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def brute_classes(rows):
    bags, root = [runs(t or "") for _, t in rows], list(range(len(rows)))
    by_run = {}
    for i, b in enumerate(bags):
        for r in b:
            by_run.setdefault(r, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = {(i, j) for ids in by_run.values() for i in ids for j in ids if i < j}
    seen |= {(i, j) for i, (_, t) in enumerate(rows) for j, (_, u) in enumerate(rows) if i < j and not bags[i] and not bags[j] and (t or "") == (u or "")}
    for i, j in seen:
        if jaccard(bags[i], bags[j]) >= 0.8:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
