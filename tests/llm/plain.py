"""Plain versions of the operators, without Spark and without any index."""

import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def kmers(text, k=5):
    w, seen, out = words(text), Counter(), []
    for i in range(len(w) - k + 1):
        g = tuple(w[i:i + k])
        seen[g] += 1
        out.append((g, seen[g]))
    return out


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        diagonal = 0
        for j, b in enumerate(y, 1):
            diagonal, row[j] = row[j], diagonal + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def classes_of(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near_classes(texts, t=0.8):
    """{id: class} by aligning every pair that shares enough labelled k-mers at all."""
    grams = {i: kmers(x) for i, x in texts.items()}
    links, ids = [], sorted(texts)
    sets = {i: set(g) for i, g in grams.items()}
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if words(texts[a]) and words(texts[a]) == words(texts[b]):
                links.append((a, b))
                continue
            x, y = grams[a], grams[b]
            both = len(sets[a] & sets[b])
            if both and both >= t * (len(x) + len(y) - both) - 1e-9:
                both = lcs(x, y)
                if both >= t * (len(x) + len(y) - both) - 1e-9:
                    links.append((a, b))
    return classes_of(ids, links)


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def dedup_lines(texts, least=24):
    """[(id, text)] in order -> {id: (lines, removed, text)}; texts have different ids."""
    first, out = {}, {}
    for i, text in texts:
        for n, raw in enumerate((text or "").split("\n")):
            first.setdefault(raw.strip(" "), (i, n))
    first.pop("", None)
    near = {x for x in first if any(first[y] < first[x] and max(len(x), len(y)) >= least and within_one_edit(x, y)
                                    for y in first if y != x and abs(len(x) - len(y)) < 2)}
    for i, text in texts:
        if text is None:
            out[i] = (0, 0, None)
            continue
        lines = text.split("\n")
        kept = [raw for n, raw in enumerate(lines) if not raw.strip(" ") or (raw.strip(" ") not in near and first[raw.strip(" ")] == (i, n))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contamination(texts, items, width=10):
    """{id: (words, hit, item ids)}."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i:i + width])].add(item)
    out = {}
    for i, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if own := windows.get(tuple(w[at:at + n])):
                    hit |= set(range(at, at + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out
