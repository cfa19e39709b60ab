import random

from helpers import component_ids, prose, rows, shingles, vocabulary

from tesserae.llm.components import components
from tesserae.llm._tables import Workspace
from tesserae.llm.near_dups import Options, near_duplicates


def edited(text, k, r, words):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(words)
    return " ".join(w)


def check(spark, texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = component_ids(list(range(len(texts))), sets)
    got = {x.doc_id: x for x in near_duplicates(rows(spark, texts)).collect()}
    assert {i: x.component_id for i, x in got.items()} == want
    assert all(x.n_shingles == len(sets[i]) and x.kept == (i == want[i]) for i, x in got.items())


def test_groups_of_copies_and_edits(spark):
    r, words = random.Random(3), vocabulary()
    texts = []
    for _ in range(12):
        base = prose(words, r.choice([4, 12, 60, 200]), r)
        texts += [base, base.upper(), base + "\t"]
        texts += [edited(base, r.choice([1, 1, 2, 4]), r, words) for _ in range(12)]
    texts += [prose(words, 50, r) for _ in range(40)]
    texts += ["", None, " \n\t", "one", "One", "a b c d", "a b c d e", "日本 語"]
    r.shuffle(texts)
    check(spark, texts)


def test_chain_of_links_and_bucket_of_two_components(spark):
    """Each text shares most with the next; the ends of the chain share little."""
    r, words = random.Random(5), vocabulary(3000)
    long = [r.choice(words) for _ in range(400)]
    check(spark, [" ".join(long[i : i + 100]) for i in range(0, 300, 6)])


def test_family_in_several_blocks(spark):
    r, words = random.Random(8), vocabulary(60)
    base = prose(words, 120, r)
    texts = [edited(base, r.randrange(0, 14), r, words) for _ in range(90)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = component_ids(list(range(len(texts))), sets)
    got = {x.doc_id: x.component_id for x in near_duplicates(rows(spark, texts), Options(block=16)).collect()}
    assert got == want


def test_bad_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (1, None, 2), (2, "a b c d e f", 3), (2, "a b c d e f", 3)], "doc_id bigint, text string, n bigint")
    got = sorted(near_duplicates(df).collect(), key=str)
    assert [(x.doc_id, x.component_id, x.kept) for x in got if x.doc_id is not None] == [(1, 1, True), (2, 2, True), (2, 2, True)]
    assert [(x.component_id, x.kept) for x in got if x.doc_id is None] == [(None, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    ids = list(range(60))
    random.Random(2).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])) + [(100, 101)], "a bigint, b bigint")
    got = {x.node: x.label for x in components(Workspace(spark, "t"), links).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}
