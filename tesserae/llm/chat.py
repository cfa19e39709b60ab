"""Chat formatting by prefix-target expansion (DataFrame functions only).

Every assistant turn becomes an example of its own: all turns before it are context and only that
reply is trainable.  A conversation that does not end with an assistant turn gets one further
example without a trainable part, so that no turn is lost.

Template of a turn: ``### <role>: <text> </turn>`` and a line feed.  Inside texts and roles a
backslash is written twice, ``#`` as ``\\#`` and ``</`` as ``<\\/``; roles also escape blanks.  So
neither control string can occur in a text, and dropping each escaping backslash restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = " </turn>\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def prefix_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """``conv_id, example_no, formatted, loss_start, loss_len`` with one row for each example.

    ``loss_start`` and ``loss_len`` are code points of ``formatted``: the escaped reply, or length 0.
    Turns are ordered by (turn, role, text), null turns first; null texts and roles are empty; a
    repeated row is a turn of its own; null conv_ids form one conversation; other columns are not
    read; no rows give no examples.  An example holds its whole conversation so far, which is what
    one row must hold; nothing larger is gathered.
    """
    esc = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select(
        "conv_id", F.struct("turn", "role", "text", F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(" "), F.lit("\\ ")), F.lit(": ")).alias("head"), escape(F.col("text")).alias("body")).alias("t")
    )
    conv = esc.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    conv = conv.withColumn("parts", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))))
    n = F.size("t")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("t", i)["role"] == target_role) | (i == n))
    one = conv.select("conv_id", "t", "parts", F.explode(wanted).alias("i"))
    last = F.element_at("t", F.col("i"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("i") - 1), "")
    one = one.select("conv_id", F.col("i").alias("example_no"), before.alias("before"), last.alias("last"))
    return one.select(
        "conv_id",
        F.col("example_no").cast("bigint").alias("example_no"),
        F.concat("before", F.col("last.head"), F.col("last.body"), F.lit(CLOSE)).alias("formatted"),
        (F.length("before") + F.length("last.head")).cast("bigint").alias("loss_start"),
        F.when(F.col("last.role") == target_role, F.length("last.body")).otherwise(0).cast("bigint").alias("loss_len"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    raw = F.split(formatted, r" </turn>\n")
    raw = F.slice(raw, F.lit(1), F.size(raw) - 1)
    return F.transform(
        raw,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(5)), ": ", 1)).alias("role"),
            unescape(F.substr(p, F.length(F.substring_index(p, ": ", 1)) + 3)).alias("text"),
        ),
    )


def read_target(formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))
