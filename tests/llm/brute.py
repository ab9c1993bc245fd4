"""Plain Python versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def shingles(text, width=5):
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))}


def near_components(docs, percent=75):
    """docs: {id: text}. Returns {id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


def repeated_windows(texts, width=35):
    """Per text (words, words that stay)."""
    words = [WORD.findall(t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i:i + width]), []).append((d, i))
    out = [[True] * len(w) for w in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                out[d][i:i + width] = [False] * width
    return [(w, [x for x, k in zip(w, keep) if k]) for w, keep in zip(words, out)]


def base_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)
