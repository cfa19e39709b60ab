import random

import numpy as np
import pyarrow as pa
from helpers import prose, rows, vocabulary

from tesserae.llm import decontamination as d


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def brute(text, item, o):
    """Least edits of the item against any window."""
    a, b = item.split(" "), text.split(" ")
    most = d.allowed(len(a), o)
    return min((min(distance(a, b[p : p + len(a) + most])) for p in range(len(b))), default=99), most


def edit(words, k, r, vocabulary):
    w = list(words)
    for _ in range(k):
        p = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[p] = r.choice(vocabulary)
        elif kind == 1:
            del w[p]
        else:
            w.insert(p, r.choice(vocabulary))
    return w


def test_align():
    r = random.Random(3)
    for n in [*range(1, 10)] * 30 + [70, 130]:
        a, b = [r.randrange(4) for _ in range(n)], [r.randrange(4) for _ in range(r.randint(0, n + 4))]
        row, mask = distance(a, b), {}
        for place, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << place
        best = min(row)
        assert d.align(mask, n, b, 999) == (best, min((abs(j - n), j) for j, v in enumerate(row) if v == best)[1])
        assert d.align(mask, n, b, best) and (best == 0 or d.align(mask, n, b, best - 1) is None)


def test_recall_of_short_items(spark):
    """Items of 1 to 9 words against a comparison of every window with every item."""
    r, words, o = random.Random(17), vocabulary(500), d.Options()
    items = [prose(words, n, r) for n in range(1, 10) for _ in range(8)] + ["alpha beta gamma delta omega"]
    texts = ["we read alpha beta gamma delta epsilon today", "alpha beta gamma delta", "alpha gamma delta omega", "omega alpha beta gamma so delta omega"]
    for i in range(360):
        w = items[i % 72].split(" ")
        k = min(len(w) - 1, i % 3)
        texts.append(" ".join(prose(words, r.randint(0, 40), r).split() + edit(w, k, r, words) + prose(words, r.randint(0, 40), r).split()))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in d.leaking(rows(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            best, most = brute(t, item, o)
            if best <= most:
                want[i, j] = best
    assert all(want.get(k) == v for k, v in got.items())
    assert all(k in got for k, v in want.items() if v == 0)
    by = {n: [k in got for k in want if len(items[k[1]].split(" ")) == n] for n in range(1, 10)}
    assert all(len(v) >= 15 and sum(v) >= 0.98 * len(v) for v in by.values())
    assert {(i, 72) for i in range(4)} <= set(got)


def test_recall_against_all_windows(spark):
    r, words, o = random.Random(7), vocabulary(300), d.Options()
    items = [prose(words, r.randint(10, 60), r) for _ in range(40)]
    texts = []
    for i in range(200):
        w = items[i % 40].split(" ")
        most = d.allowed(len(w), o)
        k = [0, 1, most // 2, most, most + 4][i % 5]
        texts.append(" ".join(prose(words, r.randint(0, 90), r).split() + edit(w, k, r, words) + prose(words, r.randint(0, 90), r).split()))
    texts += [prose(words, 200, r) for _ in range(50)] + ["", None, "x", items[0].upper().replace(" ", ",  ")]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in d.leaking(rows(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts[:250]):
        for j, item in enumerate(items):
            # the planted item, and a few others
            if j == i % 40 or (i + j) % 13 == 0:
                best, most = brute(t, item, o)
                if best <= most:
                    want[i, j] = best
    want[len(texts) - 1, 0] = 0
    found = {k: v for k, v in got.items() if k in want}
    assert len(found) >= 0.98 * len(want) and len(want) > 150
    assert all(v == want[k] for k, v in found.items())
    assert all(v <= d.allowed(len(items[j].split()), o) for (_, j), v in got.items())
    assert all(got.get((i, i % 40)) == 0 for i in range(0, 200, 5))


def test_bad_rows(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item, "x"), (2, item, "y"), (None, item, "z"), (3, "one", "u")], "item_id bigint, text string, doc_id string")
    docs = spark.createDataFrame([(None, f"say: {item}.", 1), (5, item, 2), (5, item, 2), (6, None, 3)], "doc_id bigint, text string, start int")
    got = sorted((str(x.doc_id), x.item_id, x.n_places) for x in d.leaking(docs, bench).collect())
    assert got == [("5", 1, 2), ("5", 2, 2), ("5", 3, 2), ("None", 1, 1), ("None", 2, 1), ("None", 3, 1)]
    assert d.leaking(docs, bench.limit(0)).count() == 0 and d.leaking(docs.limit(0), bench).count() == 0


def test_recall_of_long_items():
    r, words, o = random.Random(11), vocabulary(3000), d.Options()
    for n, count in ((200, 20), (400, 20)):
        items = [prose(words, n, r) for _ in range(count)]
        texts = [prose(words, 20, r) + " " + " ".join(edit(i.split(" "), d.allowed(n, o), r, words)) + " " + prose(words, 20, r) for i in items]
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        got = {(x[0], x[1]) for x in d._search(batch, d.Items(list(range(count)), items, o))}
        assert sum((i, i) in got for i in range(count)) >= 0.98 * count, n
