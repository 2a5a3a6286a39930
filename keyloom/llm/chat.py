"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context, and only its reply
is trainable. The examples of a conversation are a chain of prefixes, so a conversation with k
replies would repeat its text k times. ``expand`` stores each turn once instead: an example
carries the turns since the previous reply (``delta``), its ``target``, and ``context_chars``,
the length of all that stands before the target. ``whole_examples`` writes out the full
contexts, and ``digests`` reads them back: every example with all of its context.

Template: ``<s>`` role ``\\n`` text ``</s>``. Inside roles and texts, a control string gets a
backslash after its first character; one that already has backslashes there gets one more.
So no control string survives inside a text, and removing one backslash restores it.

Only built-in expressions are used. Turns of a conversation meet in two steps, first in runs
of ``RUN`` turn numbers, so that one endless conversation is not grouped row by row in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
# The strings that may not stand unescaped in a text.
ESCAPE = r"([<\[])(\\*)(/?s>|/?INST\])"
UNESCAPE = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)<s>([^\n]*)\n(.*?)</s>"
RUN = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def expand(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """(conv_id, example, delta, target, context_chars): one row per reply.

    ``example`` counts from 0. Turns after the last reply form a last row with a null target:
    nothing in it is trainable. Null roles and texts are empty; a line break in a role becomes
    a space. Rows of one turn number follow role and text; repeated rows are repeated turns. A
    null turn number comes first; null conversation ids are one conversation. Empty input gives
    no rows; other columns are not read.
    """
    role = F.translate(F.coalesce(F.col(role_col).cast("string"), F.lit("")), "\n", " ")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(turn_col).cast("long")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.floor(number / RUN).alias("run"),
        F.struct(
            number.alias("turn"),
            role.alias("role"),
            F.concat(F.lit(OPEN), escaped(role), F.lit("\n"), escaped(text), F.lit(CLOSE)).alias("out"),
        ).alias("t"),
    )
    runs = rows.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    whole = runs.groupBy("conv_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ts"))), lambda r: r["ts"])).alias("ts")
    )
    is_target = F.col("t.role") == target_role
    seen = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.select("conv_id", F.posexplode("ts").alias("pos", "t")).select(
        "conv_id",
        "pos",
        F.col("t.out").alias("out"),
        is_target.alias("reply"),
        F.coalesce(F.sum(is_target.cast("long")).over(seen), F.lit(0)).alias("example"),
        F.coalesce(F.sum(F.length("t.out")).over(seen), F.lit(0)).alias("chars_before"),
    )
    parts = F.array_sort(F.collect_list(F.when(~F.col("reply"), F.struct("pos", "out"))))
    return placed.groupBy("conv_id", "example").agg(
        F.array_join(F.transform(parts, lambda p: p["out"]), "").alias("delta"),
        F.max(F.when(F.col("reply"), F.col("out"))).alias("target"),
        F.coalesce(
            F.max(F.when(F.col("reply"), F.col("chars_before"))),
            F.max(F.col("chars_before") + F.length("out")),
        ).alias("context_chars"),
    )


def contexts(examples: DataFrame) -> DataFrame:
    """(conv_id, example, context, target) of every row, with all preceding turns written out."""
    before = Window.partitionBy("conv_id").orderBy("example")
    segment = F.concat("delta", F.coalesce("target", F.lit("")))
    earlier = F.collect_list(segment).over(before.rowsBetween(Window.unboundedPreceding, -1))
    return examples.select(
        "conv_id", "example", F.concat(F.array_join(earlier, ""), F.col("delta")).alias("context"), "target"
    )


def whole_examples(examples: DataFrame) -> DataFrame:
    """(conv_id, example, context, target) with all preceding turns written out.

    The output of a conversation grows with the square of its replies; ``expand`` does not.
    """
    return contexts(examples).filter("target is not null")


def read_turns(formatted: Column) -> Column:
    """Roles and texts of formatted turns, unescaped: array<struct<role, text>>."""
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.transform(
        found,
        lambda t: F.struct(
            unescaped(F.regexp_extract(t, TURN, 1)).alias("role"),
            unescaped(F.regexp_extract(t, TURN, 2)).alias("text"),
        ),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """(conv_id, example, turns, loss, chars): whole examples, read back.

    ``turns`` are those of the context and the target, ``loss`` is the text under the loss mask (that of the target),
    ``chars`` the formatted length. Turns after the last reply have no target and no loss.
    """
    whole = F.concat("context", F.coalesce("target", F.lit("")))
    return contexts(examples).select(
        "conv_id",
        "example",
        read_turns(whole).alias("turns"),
        F.coalesce(read_turns(F.substring(whole, F.length("context") + 1, F.length("target")))[0]["text"], F.lit("")).alias("loss"),
        F.length(whole).alias("chars"),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from whole examples: turns, loss text and sizes, each turn once."""
    before = Window.partitionBy("conv_id").orderBy("example")

    def earlier(size: Column) -> Column:
        return F.coalesce(F.lag(size).over(before), F.lit(0))

    each = read_examples(examples).select(
        "conv_id", "example", "turns", "loss", "chars",
        earlier(F.size("turns")).alias("n_before"), earlier(F.col("chars")).alias("chars_before"),
    ).select(
        "conv_id",
        "example",
        F.slice("turns", F.col("n_before") + 1, F.size("turns") - F.col("n_before")).alias("turns"),
        "loss",
        (F.col("chars") - F.col("chars_before")).alias("chars"),
    ).select(
        "conv_id",
        F.floor(F.col("example") / RUN).alias("run"),
        "chars",
        F.size("turns").alias("n"),
        F.struct(
            "example",
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("said"),
            "loss",
        ).alias("e"),
    )

    def joined(items: str, field: str) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda e: e[field]), "")

    runs = each.groupBy("conv_id", "run").agg(
        F.collect_list("e").alias("es"), F.sum("n").alias("n"), F.sum("chars").alias("chars")
    ).select("conv_id", "n", "chars", F.struct("run", joined("es", "said").alias("said"), joined("es", "loss").alias("loss")).alias("r"))
    whole = runs.groupBy("conv_id").agg(
        F.collect_list("r").alias("rs"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    ).select("conv_id", "n_turns", "formatted_chars", joined("rs", "said").alias("said"), joined("rs", "loss").alias("loss"))
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
