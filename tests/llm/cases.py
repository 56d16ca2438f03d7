"""Hard rows, and plain versions of what the operators compute."""

import re

EDGES = [
    # doc_id, text, lang, source, n_chars
    (1, None, "en", None, None),
    (2, "", None, "s", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "s", 7),
    (4, "one", "en", "s", 3),
    (5, "One", "en", "s", 3),
    (6, "one two", None, "s", 7),
    (None, "one two", "en", "s", 7),
    (None, None, "en", "s", None),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z. " * 3, "en", "s", 159),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z. " * 3, "en", "s", 159),
    (9, "Zürich liegt schön — ça va? 日本語 🎉 x\r\ny", "de", "s", 40),
    (10, "long " * 30_000 + "a" * 3000, "en", "s", 153_000),
]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, width):
    words = words_of(text)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute_components(rows, width, percent):
    """doc_id -> (set size, smallest linked doc_id), all pairs compared."""
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}
