"""Plain versions of the corpus operators, row by row, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def split_words(text: str | None, lower: bool = True) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or "") if lower else text or "")


def shingle_set(text: str | None, size: int) -> frozenset:
    w = split_words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def near_duplicates(rows: list[tuple], size: int = 2, percent: int = 80) -> list[tuple]:
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = Counter()
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return [(i, len(s), root(i), root(i) == i) for i, s in sets.items()]


def windows(items: list, size: int) -> Counter:
    return Counter(tuple(items[i : i + size]) for i in range(len(items) - size + 1))


def shingle_list(text: str | None, size: int) -> list[tuple]:
    w = split_words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def base_rules(text: str | None) -> tuple:
    text = text or ""
    w = split_words(text, lower=False)
    lines = [x for x in text.split("\n") if split_words(x)]
    again = {k for k, n in windows(w, 5).items() if n > 1}
    covered = {j for i in range(len(w) - 4) if tuple(w[i : i + 5]) in again for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def best_window(text: str | None, item: str | None) -> float:
    """The best weighted similarity of an item with an item-sized window of a text, in shingles of five words."""
    s, it = shingle_list(text, 5), shingle_list(item, 5)
    if not s or not it:
        return 0.0
    c, best = Counter(it), 0.0
    for k in range(max(1, len(s) - len(it) + 1)):
        w = Counter(s[k : k + len(it)])
        both = sum((w & c).values())
        best = max(best, both / (sum(w.values()) + len(it) - both))
    return best


def sharing(rows: list[dict], n_words: int) -> set:
    """Ids of documents that have a passage of so many words in common with a document of another id."""
    by = defaultdict(set)
    for r in rows:
        for k in windows((r["text"] or "").split(), n_words):
            by[k].add(r["doc_id"])
    return {i for ids in by.values() if len(ids) > 1 for i in ids}
