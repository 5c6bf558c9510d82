import random

WORDS = [a + b for a in ("ba", "de", "lo", "mi", "nu", "ra", "so", "ti") for b in ("n", "r", "st", "l", "nd", "m")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


#: Nulls, empty and blank texts, unusual white space, repeated rows, a long text, code points beyond 16 bits, control characters.
ODD = [
    (1, "", "en", "a"), (2, None, "en", "a"), (3, "  \t\n ", None, None), (4, "one", "en", None), (5, "one", "en", "a"), (5, "one", "en", "a"),
    (6, "tab\tfeed\x0cvert\x0bend hard em", "fr", "b"), (7, "\U0001f600 été \x00 \x01 \\ $1 ''", "fr", "b"), (8, prose(30_000, 1), "en", "c"), (9, prose(12, 2), "en", "c"), (10, prose(12, 2), "de", "b"), (None, "no id here", "en", "a"),
]


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return set(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else ({tuple(w)} if w else set())


def jaccard_components(docs, n, percent):
    """doc_id -> least reachable doc_id, by comparing all pairs."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}
