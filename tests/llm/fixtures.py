"""Small document tables with copies, shared passages and every odd case, and brute-force answers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): exact and near copies, shared passages, repeats, odd and empty texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [some(k) for k in (55, 80, 52, 49)]
    texts, bodies = [], []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and bodies:
            words = list(rng.choice(bodies))
        elif kind < 0.35 and bodies:
            words = list(rng.choice(bodies))
            for _ in range(rng.randint(1, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = some(rng.choice([0, 1, 3, 4, 9, 20, 60, 150]))
            if kind > 0.6:
                at = rng.randint(0, len(words))
                words[at:at] = rng.choice(passages)
        bodies.append(words)
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for w in words))
    texts += [None, "", "   \n\t ", "one", "ONE", "one two", "a\x1cb a\x1cb", " ".join(some(6000)), "#*$ " * 80, "\n".join(["same line here"] * 30), "AbC dEf " * 40, "abc def " * 40]
    return [(i, t, "en", "s", None) for i, t in enumerate(texts)]


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def kept_after_dedup(rows, window=50):
    first = {}
    for i, t in sorted((r[0], r[1]) for r in rows if r[0] is not None):
        w = words(t)
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p:p + window]), i)
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def shingle_set(text, n=4):
    w = words(fold(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def similar(rows, percent=85, words=4):
    sets = {r[0]: shingle_set(r[1], words) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def leaks(rows, items, window=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = {}
    for item, t in items:
        w = split(t)
        if item is not None:
            for p in range(max(1, len(w) - window + 1) if w else 0):
                windows.setdefault(tuple(w[p:p + window]), set()).add(str(item))
    out = {}
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for win, owners in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= owners
        out[i] = (len(w), len(hit), sorted(found))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]
