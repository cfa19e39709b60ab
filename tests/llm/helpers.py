"""Small document tables, and plain versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(spark, texts, sources=None):
    data = [(i, t, "en", (sources[i] if sources else "s0"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def vocabulary(n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(words, n, r):
    return " ".join(r.choice(words) for _ in range(n))


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 75 * (len(a) + len(b) - both)


def component_ids(ids, sets):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if linked(sets[i], sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
