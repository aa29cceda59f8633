"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all turns before it are its context, and its text
alone is under the loss mask. Turns behind the last assistant turn make a last example without a
target, so the output holds every turn. A turn is rendered as

    <|turn|>role<|says|>text<|end|>

Inside roles and texts a backslash is doubled, and one is put behind the first character of every
control string (those above, and the usual ones of other templates). So no control string of the
template is ever found inside a text, and `unescape` gives the text back.

Defined cases: null texts and roles are empty. Turns are ordered by turn number (null first), then role,
then text, so ties and repeated rows have one order. Rows of a null conv_id make one conversation. An
empty table gives an empty result. Other columns are not read. The rows of one conversation meet in one
task, since its examples hold them all anyway; examples of a conversation of n turns have O(n^2)
characters by definition of the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Where a backslash goes: behind a `<` or `[` that starts a control string.
_CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns in it, has_target, text, and the
    mask as loss_start and loss_length in characters of text."""
    rows = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("row"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    shown = F.transform("rows", lambda x: F.struct(
        (x["role"] == "assistant").alias("target"),
        F.concat(F.lit(TURN), escape(x["role"]), F.lit(SAYS)).alias("head"),
        escape(x["text"]).alias("body"),
    ))
    whole = whole.select("conv_id", shown.alias("turns"))
    ends = F.expr("filter(transform(turns, (x, i) -> CASE WHEN x.target OR i = size(turns) - 1 THEN i END), i -> i IS NOT NULL)")
    each = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "at"))
    last = F.expr("turns[at]")
    context = F.expr(f"array_join(transform(slice(turns, 1, at), x -> concat(x.head, x.body, '{END}')), '')")
    lead = F.concat(context, last["head"])
    each = each.select(
        "conv_id", F.col("example").cast("long").alias("example"), (F.col("at") + 1).cast("long").alias("n_turns"),
        last["target"].alias("has_target"), lead.alias("lead"), last["body"].alias("body"),
    )
    return each.select(
        "conv_id", "example", "n_turns", "has_target",
        F.concat("lead", "body", F.lit(END)).alias("text"),
        F.length("lead").cast("long").alias("loss_start"),
        F.when(F.col("has_target"), F.length("body")).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, taken from the examples alone."""
    masked = unescape(F.expr("substring(text, CAST(loss_start AS INT) + 1, CAST(loss_length AS INT))"))
    found = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("has_target"), F.struct("example", masked.alias("said"))))).alias("targets"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    parts = F.expr(f"slice(split(whole, '{_quoted(END)}'), 1, size(split(whole, '{_quoted(END)}')) - 1)")
    found = found.withColumn("parts", parts).withColumn("said", F.array_join(F.transform("targets", lambda x: x["said"]), ""))

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), SAYS, 1)
        body = F.substring_index(x, SAYS, -1)
        return F.concat(unescape(role), F.lit("\n"), unescape(body), F.lit("\n"))

    return found.select(
        "conv_id",
        F.size("parts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("parts", turn), ""), 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _quoted(text: str) -> str:
    return text.replace("|", "[|]")
