"""Secrets, licenses, chat, quality, toxicity and nearest neighbours against plain versions."""

import hashlib
import random
import re

import numpy as np
from helpers import prose, rows, vocabulary
from pyspark.sql import functions as F

from tesserae.llm import ann, chat, licenses, quality, queries, secrets, toxicity

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_secrets(spark):
    r = random.Random(1)
    key = lambda n, a="abcdef0123456789": "".join(r.choice(a) for _ in range(n))
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [
        f'é {"x" * 50} PassWord = "{key(9)}" and token:{key(7)} token:{key(40)}', f"AKIA{key(12, big[:26])} AKIA{key(11, big[:26])} {key(31)} {key(33)}",
        f"paſſword={key(20)} toKen={key(20)} api_key='{key(12, big)}' apikey:=abc", "password=password=12345678 secret: a.b-c_d/e+f", None, "", "token = token = " + key(64),
        f"Authorization: Bearer {key(32, big)}\nclient credentials are stored in application/json", "the access path /usr/local/bin/authorization is public",
        "x" * 200_000 + f" secret={key(10)}", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    ]
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.secret_spans] for x in secrets.scan(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "novel"] == base_spans(t)
    assert [s[0] for s in got[7]] == ["novel"] and not got[8]
    red = {x.doc_id: x for x in secrets.redacted(rows(spark, texts)).collect()}
    assert red[8].text == texts[8] and red[4].text is None and not base_spans(red[0].text) and red[0].n_chars == len(red[0].text)
    assert secrets.scan(rows(spark, texts).limit(0)).count() == 0


def test_every_candidate_is_measured():
    def novel(t):
        return [t[s:e] for s, e, k, _ in secrets.find(t, secrets.Novelty()) if secrets.KINDS[k] == "novel"]

    assert novel("private key: qWzXvKpLmTgRbHyNcJdF") == ["qWzXvKpLmTgRbHyNcJdF"]
    assert "Zk3vQ9xT1mB7wLp4Rj8s" in novel("token authentication-service-name = Zk3vQ9xT1mB7wLp4Rj8s")
    assert novel("client session key: Zk3vQ9xT1mB7wLp4Rj8s") == ["Zk3vQ9xT1mB7wLp4Rj8s"]
    assert novel("client application/json session /usr/local/bin/authorization") == []


def test_novel_spans_against_plain_version(spark, tiny):
    """The reported strings of whole documents, from a compressor made anew for every measurement."""
    import zstandard

    def size(b):
        primed = zstandard.ZstdCompressionDict(secrets.IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False).compress(b))

    r = random.Random(12)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    bits = ["session key ", "auth = ", "private: ", "client secret ", "Bearer ", "the path /usr/local/bin ", "refresh_token_type ", "access ", "password=", "é ", "\n", "token "]
    texts = ["".join(r.choice([r.choice(bits), key(r.randint(4, 40)) + " ", prose(vocabulary(), 3, r) + " "]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    texts += [x.text for x in spark.read.parquet(f"{tiny}/documents.parquet").limit(60).collect()]
    got = {x.doc_id: [(s.start, s.end) for s in x.secret_spans if s.kind == "novel"] for x in secrets.scan(rows(spark, texts)).collect()}
    some = 0
    for i, t in enumerate(texts):
        t, base, want, at = t or "", base_spans(t), [], 0
        while m := secrets.SENSITIVE.search(t, at):
            s, e = m.span(2)
            at = m.end(1)
            if want and s < want[-1][1] or any(bs < e and s < be for _, bs, be in base):
                continue
            around = (t[max(0, s - 160) : s] + "\n" + t[e : e + 160] + "\n").encode()
            if size(around + t[s:e].encode()) - size(around) >= 0.6 * (e - s):
                want.append((s, e))
        assert got[i] == want
        some += len(want)
    assert some > 50


def test_secret_query(spark, tiny):
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    for x in queries.op1_secret_scan(spark, tiny).collect():
        want = base_spans(text[x.doc_id])
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(x.spans.split(",")) | {""}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_licenses(spark):
    r, v = random.Random(2), vocabulary()
    notices = [t.text for t in licenses.NOTICES] + ["MIT  License", "the Apache\nLicense!", "GNU General-Public License", "general public", "MIT licensed İ"]
    texts = [None, "", "mit", "mit license", "mit license mit license apache license"]
    for _ in range(80):
        parts = [prose(v, r.randint(0, 20), r)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(notices), prose(v, r.randint(0, 6), r)]
        texts.append(" ".join(parts))
    df = rows(spark, texts)
    got = {x.doc_id: x for x in licenses.summarize(df).collect()}
    for i, t in enumerate(texts):
        w, x = words(t), got[i]
        at = [(p, b.label) for b in licenses.BASE for p in range(len(w)) if w[p : p + b.text.count(" ") + 1] == b.text.split(" ")]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(at), min((p for p, _ in at), default=None), max((p for p, _ in at), default=None))
        assert x.base_labels == ",".join(sorted({k for _, k in at})) and {k for _, k in at} <= set(x.labels.split(","))
        assert 0 <= x.score <= 1
    # an inserted and a lost word move the diagonal; the span is still one
    text = "licensed under the very apache license version 2 0 only"
    spans = licenses.scan(rows(spark, [text])).where("label = 'apache-2.0-notice'").collect()
    assert len(spans) == 1 and spans[0].coverage >= 0.75
    twice = spark.createDataFrame([(1, "mit license", 1), (1, "mit license", 2), (None, "mit license", 3)], "doc_id bigint, text string, label int")
    assert [x.n_base for x in licenses.summarize(twice).collect()] == [1, 1, 1]


def test_chat_round_trip(spark):
    r = random.Random(3)
    bits = ["\\", "#", "### ", "</turn>", " </turn>\n", "</", "<", "/", "\n", ": ", "### assistant: ", "é", "猫", " ", "a"]
    talk = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
    data = [(c, t, r.choice(["user", "assistant", "system", "a: b", "#", None]), r.choice([talk(), talk(), None])) for c in range(40) for t in range(r.randint(1, 9))]
    df = spark.createDataFrame(data + [(None, 0, "user", "x"), (None, 1, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    ex = chat.prefix_examples(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("target", chat.read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_len"))).collect()
    for c in [*range(40), None]:
        turns = [((role or ""), (text or "")) for conv, _, role, text in data if conv == c] or [("user", "x"), ("assistant", "y")]
        mine = sorted((x for x in ex if x.conv_id == c), key=lambda x: x.example_no)
        assert [x.example_no for x in mine] == [i + 1 for i, t in enumerate(turns) if t[0] == "assistant" or i == len(turns) - 1]
        for x in mine:
            assert [tuple(t) for t in x.turns] == turns[: x.example_no]
            role, text = turns[x.example_no - 1]
            assert x.target == (text if role == "assistant" else "")
    assert chat.prefix_examples(df.limit(0)).count() == 0


def enumerated(count, e, t):
    """Marginals, expected label pairs and log partition functions by listing all labellings."""
    at, marginal, pairs, log_z = 0, [], [], []
    for n in count:
        z, m, part = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in range(2**n):
            lab = [(y >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[at + k] * lab[k] for k in range(n)) + sum(t[a, b] for a, b in zip(lab, lab[1:])))
            z += w
            m += w * np.array(lab)
            for a, b in zip(lab, lab[1:]):
                part[a, b] += w
        marginal += (m / z).tolist()
        pairs.append(part / z)
        log_z.append(np.log(z))
        at += n
    return np.array(marginal), np.array(pairs), np.array(log_z)


def test_crf_marginals_by_enumeration():
    r = np.random.default_rng(0)
    count = np.array([3, 0, 1, 4])
    e, t, w = r.normal(size=8), r.normal(size=(2, 2)), r.random(4)
    p, pairs, log_z = quality.Chains(count).marginals(e, t, edges=w)
    want, expected, z = enumerated(count, e, t)
    some = count > 0
    assert np.allclose(p, want) and np.allclose(pairs, (w[some, None, None] * expected[some]).sum(0)) and np.allclose(log_z[some], z[some])


def test_crf_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(1)
    count, y = np.array([3, 0, 1, 4, 2]), np.array([1, 0, 0, 0, 1])
    x = r.normal(size=(10, len(quality.FEATURES))).astype(np.float32)
    crf = quality.Crf(quality.Options(bins=3))
    crf.cuts = [quality._cuts(x[:, f], 3) for f in range(x.shape[1])]
    crf.table, crf.pairs = r.normal(size=crf.table.shape) * 0.2, r.normal(size=(2, 2))
    bins, chains = crf.binned(x, count), quality.Chains(count)
    value, g, tg = crf.ascent(bins, chains, y, count)
    # the value itself, by enumeration
    e = crf.emissions(bins)
    _, _, z = enumerated(count, e, crf.pairs)
    own = np.repeat(np.arange(5), count)
    each = [(e[own == d].sum() * y[d] + max(0, count[d] - 1) * crf.pairs[y[d], y[d]] - (z[d] if count[d] else 0)) / max(1, count[d]) / (2 if y[d] else 3) for d in range(5)]
    assert np.isclose(value, sum(each) - crf.o.l2 / 2 * ((crf.table**2).sum() / len(quality.FEATURES) + (crf.pairs**2).sum()))

    def slope(param, at, h=1e-6):
        keep, out = param[at], []
        for step in (h, -h):
            param[at] = keep + step
            out.append(crf.ascent(bins, chains, y, count)[0])
        param[at] = keep
        return (out[0] - out[1]) / (2 * h)

    for at in [(int(f), int(bins[k, f])) for f, k in zip(r.integers(0, bins.shape[1], 25), r.integers(0, 10, 25))]:
        assert np.isclose(slope(crf.table, at), g[at], atol=1e-7)
    assert all(np.isclose(slope(crf.pairs, (i, j)), tg[i, j], atol=1e-7) for i in (0, 1) for j in (0, 1))


def plain_lines(text):
    """Features and weights of the non-blank lines, word by word."""
    fold = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    lines = [(raw, re.findall(rb"[^\x20\x09-\x0D]+", raw)) for raw in (text or "").encode().split(b"\n")]
    lines = [(raw, ws) for raw, ws in lines if ws]
    upper, digit, symbol = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~=+_<>{}[]\\/|"
    seen, out = set(), []
    keys = [tuple(map(fold, ws)) for _, ws in lines]
    for (raw, ws), key in zip(lines, keys):
        n, chars = len(ws), sum(map(len, ws))
        share = lambda cls: sum(c in cls for c in raw) / chars  # noqa: B023, E731
        again = 0
        for w in key:
            again += w in seen
            seen.add(w)
        out.append(([
            np.log1p(n), chars / n, share(upper), share(digit), share(symbol), share(b"|"), share(b"!"), share(b".;:?"), share(b","),
            sum(a == b for a, b in zip(key[1:], key)) / n, sum(a == b for a, b in zip(key[2:], key)) / n, len(set(key)) / n,
            sum(len(w) > 1 and w[0] in upper and w[1] in upper for w in ws) / n, sum(w[-1] in symbol for w in ws) / n, float(keys.count(key) > 1),
            sum(c >= 128 for c in raw) / chars, max(map(len, ws)), float(ws[0][0] not in upper), np.log1p(len(lines)), again / n,
        ], chars))
    return out


def test_quality_against_plain_version(spark, tiny):
    """Every score of the query, from features taken word by word and a forward-backward pass line by line."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    got = {x.doc_id: x.score for x in queries.op2_quality(spark, tiny).collect()}
    for doc_id, text in docs.collect():
        lines = plain_lines(text)
        if not lines:
            assert got[doc_id] == model.prior
            continue
        x = np.array([f for f, _ in lines], np.float32)
        bins = [[1 + int(np.searchsorted(c, row[k], "left")) for k, c in enumerate(model.cuts)] for row in x]
        none = [0] * len(quality.FEATURES)
        e = [sum(model.table[f, b] for f, b in enumerate(bins[i] + (bins[i - 1] if i else none) + (bins[i + 1] if i + 1 < len(bins) else none))) for i in range(len(bins))]
        e = np.clip(e, -30, 30)
        fwd, bwd = [np.array([0.0, e[0]])], [np.zeros(2)]
        for v in e[1:]:
            fwd.append(np.array([np.logaddexp(*(fwd[-1] + model.pairs[:, b])) + b * v for b in (0, 1)]))
        for v in e[:0:-1]:
            bwd.append(np.array([np.logaddexp(*(bwd[-1] + model.pairs[a] + np.array([0, v]))) for a in (0, 1)]))
        both = np.array(fwd) + np.array(bwd[::-1])
        p = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
        mean = np.clip(np.average(p, weights=[w for _, w in lines]), 1e-4, 1 - 1e-4)
        want = 1 / (1 + np.exp(-(model.curve[0] * np.log(mean / (1 - mean)) + model.curve[1])))
        assert abs(got[doc_id] - want) < 1e-6, doc_id


def test_quality_held_out(spark, tiny):
    big = tiny.replace("sf0.001", "sf0.01")
    y = {x.doc_id: x.quality for x in spark.read.parquet(f"{big}/labels.parquet").collect()}
    got = [x for x in queries.op2_quality(spark, big).collect() if x.held_out and x.doc_id in y]
    assert np.mean([x.predicted == y[x.doc_id] for x in got]) >= 0.93 and len(got) > 50
    model = quality.fit(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet"))
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, " \n\n", 3.0), (2, "a\n" * 5000, 4.0)], "doc_id bigint, text string, quality_score double")
    scores = [x.quality_score for x in quality.score(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= s <= 1 for s in scores) and len(set(scores[:3])) == 1
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(odd, quality.fit(odd, labels)).count() == 4


def test_toxicity_search_is_exact_and_held_out(spark, tiny):
    big = tiny.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    index = toxicity.fit(docs, labels)
    y = {x.doc_id: x.toxic for x in labels.collect()}
    sample = docs.where("doc_id % 7 = 0").select("doc_id", "text").collect()
    from tesserae.llm._text import utf8
    import pyarrow as pa

    r, f, v = index.vectors(*toxicity.features(*utf8(pa.array([x.text for x in sample])), index.o), len(sample))
    dense = np.zeros((len(index.y), len(index.vocabulary)))
    dense[:, index.dense_at >= 0] = index.dense.T
    dense[index.post_row, np.arange(len(index.vocabulary)).repeat(index.offsets[:, -1] - index.offsets[:, 0])] = index.post_v
    assert (index.dense_at >= 0).any() and len(index.post_v)
    assert np.allclose(np.linalg.norm(dense, axis=1)[np.linalg.norm(dense, axis=1) > 0], 1)
    for i in range(0, len(sample), 11):
        mine = r == i
        if mine.any():
            cos = dense[:, f[mine]] @ v[mine]
            best = np.lexsort((index.ids, -np.round(cos, 12)))[: index.o.votes[-1]]
            sims, rows_ = index.nearest(f[mine], v[mine])
            assert np.allclose(sims, cos[best][cos[best] > 0][: len(sims)]) and rows_.tolist() == best[cos[best] > 0].tolist()
    got = [x for x in queries.op5_toxicity(spark, big).collect() if x.held_out and x.doc_id in y]
    pred, true = np.array([x.predicted for x in got]), np.array([y[x.doc_id] for x in got])
    assert (pred[true == 0] == 0).mean() >= 0.99 and (pred[true == 1] == 1).mean() >= 0.75
    odd = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b")], "doc_id bigint, text string, evidence string")
    assert len({x.toxicity for x in toxicity.score(odd, index).collect()}) == 1
    assert toxicity.score(odd, toxicity.fit(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))).count() == 3


def nearest_by_hand(ids, x, q, k):
    s = x @ x[q]
    order = [int(i) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [int(ids[i]) for i in order]


def test_nearest_recall(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24)) + r.normal(size=(30, 24))[r.integers(0, 30, 3000)] * 2
    x[100:900] = x[100]  # one very common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0, None] + [0.0] * 22), (5080, [float("inf")] * 24), (5100, [1.0, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(data + bad, "vec_id bigint, embedding array<double>")
    o = ann.Options(shard=800, query_block=20, blocks=3)
    got = {}
    for t in ann.nearest(df, F.col("vec_id") % 20 == 0, o).collect():
        got.setdefault(t.query_id, []).append((t.rank, t.vec_id, t.score))
    ids = np.arange(3000)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [t[0] for t in found] == list(range(1, 21))
        assert all(abs(t[2] - float(x[q] @ x[t[1]])) < 1e-9 for t in found)
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:]))
        want = nearest_by_hand(ids, x, q, 20)
        hit += len(set(want) & {t[1] for t in found})
        total += 20
    assert hit >= 0.95 * total
    few = ann.nearest(df.limit(3), F.col("vec_id") % 2 == 0, o).collect()
    assert sorted((t.query_id, t.vec_id) for t in few) == [(0, 1), (0, 2), (2, 0), (2, 1)]
    assert ann.nearest(df.limit(0), F.lit(True), o).count() == 0
