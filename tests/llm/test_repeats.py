import hashlib
import random

import numpy as np
from helpers import prose, rows, vocabulary

from tesserae.llm import repeats
from tesserae.llm._text import PIECE
from tesserae.llm.repeats import Options, anchors, remove_repeats, repeated
from tesserae.llm.suffix_sort import sort


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = {}
    for d, (b, g) in enumerate(zip(raw, gone)):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out[d] = (len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
    return out


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_deep_shallow_sort():
    r = random.Random(1)
    for _ in range(400):
        base = bytes(r.choice(b"ab") for _ in range(r.randint(0, 150)))
        s = []
        for _ in range(r.randint(1, 25)):
            x = bytearray(base[: r.randint(0, len(base))])
            for _ in range(r.randint(0, 2)):
                if x:
                    x[r.randrange(len(x))] = r.choice(b"abc")
            s.append(bytes(x))
        order, lcps = sort(s, 0, r.choice([0, 8, 32]))
        assert [s[i] for i in order] == sorted(s)
        assert lcps[0] == 0 and all(lcps[k] == common(s[order[k - 1]], s[order[k]]) for k in range(1, len(s)))


def test_sort_of_bad_orders():
    n = 6000
    pipe = [i for i in range(n) if i % 2 == 0] + [i for i in reversed(range(n)) if i % 2]
    for numbers in (range(n), reversed(range(n)), pipe, [0] * n):
        s = [f"{i:06d}".encode() * 10 for i in numbers]
        assert [s[i] for i in sort(s)[0]] == sorted(s)


def test_two_sided_matches():
    r = random.Random(2)
    for _ in range(200):
        m, length = r.randint(2, 12), 8
        left = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 6))) for _ in range(m)]
        right = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 8))) for _ in range(m)]
        want = [set() for _ in range(m)]
        for i in range(m):
            for j in range(m):
                if i != j:
                    l, q = common(left[i], left[j]), common(right[i], right[j])
                    if l + q >= length:
                        want[i] |= set(range(-l, q))
        got = [set() for _ in range(m)]
        for i, l, q in repeated(left, right, length):
            got[i] |= set(range(-l, q))
        assert got == want


def test_anchor_in_every_window():
    o = Options(length=40, gram=8)
    b = np.frombuffer(("the same thing again and again " * 30 + "and now for something else entirely, at length").encode(), np.uint8)
    pos, _, _ = anchors(b, o)
    assert all(((pos >= i) & (pos <= i + o.length - o.gram)).any() for i in range(len(b) - o.length + 1))


def corpus(r):
    words = vocabulary()
    passages = [prose(words, r.choice([8, 30, 90]), r) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [prose(words, r.randint(0, 40), r)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(20, 500)], prose(words, r.randint(0, 20), r)]
        texts.append("é ".join(parts))
    return texts + [texts[0], texts[0], texts[1] + "!", "ab" * 300, "x" * 500, "", None, "short"]


def check(spark, texts, o):
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(rows(spark, texts), o).collect()}
    assert got == brute(texts, o.length)


def test_against_all_windows(spark):
    check(spark, corpus(random.Random(4)), Options(length=60, gram=16))


def test_large_groups_are_halved(spark):
    check(spark, corpus(random.Random(6)), Options(length=60, gram=16, limit=2))


def test_bad_rows(spark):
    df = spark.createDataFrame([(None, "a" * 900), (None, None), (1, "b" * 20)], "doc_id bigint, text string")
    got = sorted((x.n_bytes, x.n_removed) for x in remove_repeats(df).collect())
    assert got == [(0, 0), (20, 0), (900, 900)]
    assert remove_repeats(df.limit(0)).count() == 0


def test_segments_do_not_change_anchors(monkeypatch):
    r, o = random.Random(8), Options(length=60, gram=16)
    b = np.frombuffer((prose(vocabulary(), 3000, r) + "ab" * 700 + prose(vocabulary(), 300, r)).encode(), np.uint8)
    whole = anchors(b, o)
    for segment in (100, 997, 4096, len(b) - o.length):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        assert all((x == y).all() for x, y in zip(anchors(b, o), whole, strict=True))


def test_long_texts(spark):
    r, o, words = random.Random(9), Options(), vocabulary()
    passage = [prose(words, 400, r)[:n] for n in (450, 700, 1500)]
    long = bytearray(prose(words, 3 * repeats.SEGMENT // 5, r).encode()[: 3 * repeats.SEGMENT + 5000])
    for k, p in enumerate(passage):
        # across the end of a segment
        at = (k + 1) * repeats.SEGMENT - len(p) // 2
        long[at : at + len(p)] = p.encode()
    assert len(long) > 3 * repeats.SEGMENT
    middle = prose(words, 50_000, r)[: PIECE + 500]
    texts = [long.decode(), middle + passage[0] + passage[1], prose(words, 90, r) + passage[2], "é" * 10]
    assert all(len(t.encode()) > PIECE + 1 for t in texts[:2])
    check(spark, texts, o)
