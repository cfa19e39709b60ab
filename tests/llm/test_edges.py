"""Very long texts, empty tables, null ids and repeated rows through every operator and stage."""

import random
import re

import corpus_pipeline
import pytest
from helpers import SCHEMA, prose, rows, vocabulary
from pyspark.sql import functions as F

from tesserae.llm import chat, decontamination, licenses, mixing, near_dups, quality, queries, repeats, secrets, toxicity

NOTICE = "released under the MIT License "


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "what is the capital of the country that lies north of the river")], "item_id bigint, text string")


def test_very_long_texts(spark, labels, bench):
    r, words = random.Random(5), vocabulary(2000)
    item = bench.first().text
    long = prose(words, 110_000, r)
    assert len(long) > 700_000
    texts = [long + " " + NOTICE + item + " password = abcdefgh1234", "x" * 800_000, prose(words, 90_000, r) + "\n" * 1000, long + " " + NOTICE + item + " password = abcdefgh1234 end"]
    docs = rows(spark, texts, ["a", "b", "a", "b"])
    assert [len(x.secret_spans) for x in secrets.scan(docs).orderBy("doc_id").collect()] == [1, 0, 0, 1]
    found = {x.doc_id: x for x in licenses.summarize(docs).collect()}
    assert [found[i].n_words for i in range(4)] == [len(re.findall("[A-Za-z0-9]+", t)) for t in texts] and found[0].base_labels == found[3].base_labels == "mit" and found[0].first_word == 110_003
    near = {x.doc_id: x.component_id for x in near_dups.near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 3: 0}
    assert sorted((x.doc_id, x.edits) for x in decontamination.leaking(docs, bench).collect()) == [(0, 0), (3, 0)]
    assert [x.size for x in mixing.mix(docs).orderBy("doc_id").collect()] == [len(t.split()) for t in texts]
    for scored, column in ((quality.score(docs, quality.fit(docs, labels)), "quality_score"), (toxicity.score(docs, toxicity.fit(docs, labels)), "toxicity")):
        assert all(0 <= x[column] <= 1 for x in scored.collect())
    talk = spark.createDataFrame([(1, 0, "user", texts[1]), (1, 1, "assistant", texts[0])], "conv_id bigint, turn bigint, role string, text string")
    x = chat.prefix_examples(talk).first()
    assert x.loss_len == len(texts[0]) and texts[1] in x.formatted
    removed = {x.doc_id: x.n_removed for x in repeats.remove_repeats(docs).collect()}
    assert removed[0] == len(texts[0]) and removed[1] == 800_000


def test_empty_tables(spark, labels, bench):
    docs, none = spark.createDataFrame([], SCHEMA), bench.limit(0)
    for out in (
        secrets.scan(docs), secrets.redacted(docs), licenses.scan(docs), licenses.summarize(docs), near_dups.near_duplicates(docs), near_dups.one_of_each(docs), decontamination.leaking(docs, bench),
        decontamination.clean(docs, none), mixing.mix(docs), mixing.mixed(docs), repeats.remove_repeats(docs), quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels.limit(0))),
    ):
        assert out.collect() == []


def test_no_benchmark_keeps_everything(spark, bench):
    docs = rows(spark, ["a b c", None, ""])
    assert decontamination.clean(docs, bench.limit(0)).count() == 3
    assert decontamination.leaking(docs, bench.select("item_id", F.lit(None).cast("string").alias("text"))).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, tiny, name, stage):
    """Null ids, null sources, null and empty texts and repeated rows; and no rows at all."""
    good = spark.read.parquet(f"{tiny}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (None, "a clean line.", "en", None, 13), (-5, None, None, "s", None), (-6, "A clean line.", "en", "s", 13), (-6, "A clean line.", "en", "s", 13)], SCHEMA)
    docs = good.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars")).unionByName(odd)
    out = stage(spark, docs, tiny)
    if name != "mixing":
        assert out.columns == docs.columns
    got = out.collect()
    if name in ("secrets", "decontamination"):
        assert sum(x.doc_id is None or x.doc_id < 0 for x in got) == 6
    if name == "near_duplicates":
        assert sum(x.doc_id == -6 for x in got) == 1 and sum(x.doc_id is None for x in got) == 3
    assert stage(spark, docs.limit(0), tiny).collect() == []


def test_queries_give_whole_tables(spark, tiny):
    n = spark.read.parquet(f"{tiny}/documents.parquet").count()
    for name in ("op1_secret_scan", "op2_quality", "op3_license_scan", "op5_toxicity"):
        assert queries.QUERIES[name](spark, tiny).count() == n
