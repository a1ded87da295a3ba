"""Small tables with odd rows, and brute-force versions."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those that the operators make.
CLASH = ", component_id string, kept string, score string, size string, hash string, key string, part string, item_id string, start string, __size string, __extra string, __dropped string, ___row string, __own string"


def docs_frame(spark, rows, extra=False):
    full = [(i, t, None, s, None) for i, t, s in rows]
    if extra:
        full = [(*r, "c", "k", "s", "z", "h", "y", "p", "i", "t", "1", "2", "3", "4", "5") for r in full]
    return spark.createDataFrame(full, DOCS + (CLASH if extra else ""))


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def changed(text, every, seed=0):
    """The text with one word in ``every`` replaced."""
    rng = random.Random(seed)
    return " ".join(f"zz{rng.randint(0, 9999)}" if k % every == every // 2 else w for k, w in enumerate(text.split(" ")))
