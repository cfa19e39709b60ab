import random
import re

import corpus_pipeline
from helpers import component_ids, prose, rows, shingles, vocabulary

from tesserae.llm import mixing, quality


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """Water-filling by rounds: clamp what is above its cap, share the rest again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = total * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix_against_plain(spark):
    r, words = random.Random(1), vocabulary()
    sources = [r.choice(["a", "b", "b", "b", "ä", "Z", None]) for _ in range(600)]
    texts = [prose(words, r.randint(0, 120), r) for _ in sources]
    got = mixing.mix(rows(spark, texts, sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = plain_targets(sizes)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert all(abs(x.target - want[s]) < 1e-6 and x.source_size == sizes[s] for x in mine)
        assert abs(sum(x.taken for x in mine) - want[s]) <= 60
        assert all(x.taken in (0, x.size, 2 * x.size) for x in mine)
    again = mixing.mix(rows(spark, texts, sources).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_bad_rows(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, None, "a", 2), (1, "x y", "a", 3), (1, "x y", "a", 3)], "doc_id bigint, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == 4 and {x.source_size for x in got} == {0, 4}
    assert mixing.mix(df.limit(0)).count() == 0


def test_stages(spark, tiny):
    """Every stage against a plain version of its decision, on the stage's own input."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    bench = [x.text for x in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, tiny).collect(), stage(spark, docs.limit(0), tiny).schema)
        after = {x.doc_id: x for x in docs.collect()}
        seen[name] = (before, after)
        if name != "mixing":
            assert docs.columns == columns
    before, after = seen["quality"]
    model = quality.fit(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet"))
    scored = quality.score(spark.read.parquet(f"{tiny}/documents.parquet"), model).collect()
    assert set(after) == {x.doc_id for x in scored if x.quality_score >= 0.7} and after.items() <= before.items()
    before, after = seen["near_duplicates"]
    comp = component_ids(sorted(before), {i: shingles(x.text) for i, x in before.items()})
    assert set(after) == set(comp.values()) and after.items() <= before.items()
    before, after = seen["decontamination"]
    fold = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    exact = {i for i, x in before.items() if any(fold(b).strip() in fold(x.text) for b in bench)}
    assert not exact & set(after) and len(before) - len(after) <= len(exact) + 2
    before, after = seen["secrets"]
    assert set(before) == set(after)
    assert all(after[i].text == x.text for i, x in before.items() if not re.search(r"(?i)password|secret|token|AKIA|[0-9a-f]{32}|key", x.text))
    assert not any(re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}", x.text) for x in after.values())
    before, after = seen["mixing"]
    assert set(after) <= set(before) and all(x.copies in (1, 2) and x.taken == x.copies * x.size for x in after.values())
    sizes = {}
    for x in before.values():
        sizes[x.source] = sizes.get(x.source, 0) + len(x.text.split())
    want = plain_targets(sizes)
    for s in sizes:
        assert abs(sum(x.taken for x in after.values() if x.source == s) - want[s]) <= max(len(x.text.split()) for x in before.values() if x.source == s)


def test_clashing_columns(spark, tiny):
    """Columns named like the operators' own neither crash a stage nor get lost."""
    from pyspark.sql import functions as F

    from tesserae.llm import decontamination, near_dups, secrets, toxicity

    names = ["n", "h", "label", "rep", "class", "kept_id", "gram", "pos", "y", "a.b", "start", "word"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    for n in names:
        docs = docs.withColumn(n, F.lit("x"))
    docs = docs.withColumns({c: F.lit("old") for c in ("size", "copies", "quality_score", "secret_spans", "toxicity", "evidence")})
    labels, bench = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("labels", "benchmark"))
    for out in (
        quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels)), secrets.scan(docs), secrets.redacted(docs),
        decontamination.clean(docs, bench), near_dups.one_of_each(docs), mixing.mixed(docs),
    ):
        rows = out.collect()
        assert rows and set(names) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert all(r["a.b"] == "x" for r in rows)
    from tesserae.llm import licenses, repeats

    assert licenses.summarize(docs).count() == repeats.remove_repeats(docs).count() == mixing.mix(docs).count() == near_dups.near_duplicates(docs).count() == 40
