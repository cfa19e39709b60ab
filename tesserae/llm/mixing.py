"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the wanted total in proportion to its weight, but none may be
repeated more than ``max_epochs`` times.  Sources at that cap are clamped and what they leave is
shared among the others by weight until nobody is above its cap.  In closed form: ordered by
``cap / weight``, the clamped sources are a prefix, and one water level holds for the rest.

Each source then takes whole repetitions of everything and one seeded fractional repetition: in
the order of a hash of (seed, doc_id), documents are taken while the midpoint of their words lies
below what is still wanted, so a source misses its target by half of one document at most.  The
running sums are built over hash buckets first, so a source with a third of all rows is spread
over thousands of small windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Workspace, lean
from ._text import Words, pieces, space_words, utf8

BUCKET_DIGITS = 3  # hex digits of the hash: 4,096 buckets per source


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = space_words()
    for whole in batches:
        for b in pieces(whole):
            size = np.diff(Words(*utf8(b.column("text")), table).first)
            keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(size, pa.int64())], names=[*(b.schema.names[i] for i in keep), "size"])


def document_sizes(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source`` and the bigint columns ``carry``, and ``size``: the number of ``[^\\x20\\x09-\\x0D]+`` in every whole text (null: 0)."""
    more = "".join(f"`{c}` bigint, " for c in carry)
    return docs.select("doc_id", "source", *carry, "text").mapInArrow(_sizes, f"doc_id bigint, source string, {more}size bigint")


def water_fill(sizes: DataFrame, weights: Sequence[float], total: float, max_epochs: float) -> DataFrame:
    """``source, source_size, target`` for every source.

    ``sizes`` has ``source, size``.  Sources in code-point order, null last, weigh ``weights``,
    repeating.  Together they want ``total`` times all sizes.  The windows here run over one row
    per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    per = per.withColumn("weight", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(total)) - before) / left)
    per = per.withColumn("full", F.col("ratio") <= F.col("level"))
    # The first source that is not full sets the level of all that are not full.
    per = per.withColumn("water", F.min(F.when(~F.col("full"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1", carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and the bigint columns ``carry`` for every row of ``docs``.

    Edge cases: a null text has size 0 and is taken as often as its neighbours; null sources form
    one source, ordered last; null doc_ids share one place in the order; repeated rows are rows of
    their own; columns besides doc_id, text and source are not read; an empty table gives no rows.
    Ties in the hash are broken by doc_id and size, so reruns agree.
    """
    lean(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "mix")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    sizes = ws.put(document_sizes(docs, carry).withColumn("h", digest), "sizes")
    targets = ws.put(water_fill(sizes, weights, total, max_epochs), "targets")
    sizes = sizes.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    prior = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), prior.alias("prior"))
    inner = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    out = out.join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    out = out.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    wanted = F.col("target") - whole * F.col("source_size")
    # midpoint of the words in hash order <= what the fractional repetition wants
    extra = (2 * (F.col("prior") + F.col("within")) + F.col("size") <= 2 * wanted) & (wanted > 0)
    copies = whole + F.when(extra, 1).otherwise(0)
    return out.select("doc_id", "source", *carry, "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns and ``size, source_size, target, copies, taken``.

    Columns of those names in the input are replaced.  Rows with equal doc_id, source and text share
    their largest number of copies; null doc_ids and sources match themselves; a null or empty text has
    size 0 and stays where its neighbours do; an empty table gives no rows.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    key = F.xxhash64("text")
    plan = mix(docs.select("doc_id", "source", "text", key.alias("mix_key")), carry=["mix_key"], **options)
    plan = plan.groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("mix_key").alias("__mix_key")).agg(*(F.max(c).alias(f"__mix_{c}") for c in new)).where("__mix_copies > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (key == F.col("__mix_key"))
    old = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return docs.join(plan.hint("shuffle_hash"), same).select(*old, *(F.col(f"__mix_{c}").alias(c) for c in new))
