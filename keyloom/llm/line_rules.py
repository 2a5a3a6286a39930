"""Quality rules: per-document base rules and cross-document line frequency.

A line is boilerplate when more than a limit of distinct documents of its host have it. Such
lines are removed, and a document that keeps too little is depleted and rejected. Lines are
compared by the 64-bit hash of their normal form (lower case, runs of white space as one space).

Exact copies must not turn a document's own lines into boilerplate, so documents of a host are
told apart by the hash of their text. Near copies are different documents: their common lines
cannot be told from those of pages that consist mostly of boilerplate.

Only built-in expressions are used. The base rules need no shuffle. Line counts are combined
before each shuffle, so a line that a third of all documents share is no hot key; lines above
the limit are joined back as a written table, whose size Spark knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.shared import materialise

WHITE = " \t\n\x0b\x0c\r"
WHITES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
# A line is boilerplate above both limits: documents of the host, and share of them. Above
# ENOUGH_DOCS documents the share does not matter, so a limit does not grow with its host.
MIN_DOCS = 10
MIN_SHARE = 0.005
ENOUGH_DOCS = 100
# A document is depleted if fewer words than MIN_WORDS or less than this share of them stay.
MIN_KEPT = 0.4


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITES))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more, the first included."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def starts(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            ordered,
            lambda o: F.filter(
                o,
                lambda e, k: F.coalesce(F.get(o, k + 1)["h"] == e["h"], F.lit(False))
                | ((k > 0) & F.coalesce(F.get(o, k - 1)["h"] == e["h"], F.lit(False))),
            ),
        )
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    def count(hashes: Column) -> Column:
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0).cast("long")).otherwise(let(starts(hashes), covered))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows, count))


def base_measures(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as expressions."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    in_words = let(
        words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeat"))
    )
    return {
        "__words": in_words,
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def line_hashes(text: Column) -> Column:
    """array<struct<h, w>>: hash of the normal form and words of each line that has a word."""
    bare = F.transform(F.split(text, "\n"), lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(WHITE)), WHITES, " ")))
    said = F.filter(bare, lambda x: x != "")
    return F.transform(
        said,
        lambda x: F.struct(
            F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")
        ),
    )


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, text_hash, lines): the hashed lines of each row, written once."""
    text = text_of(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.xxhash64(text).alias("text_hash"),
        line_hashes(text).alias("lines"),
    )
    return materialise(lines, "lines")


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h, n_docs): lines above the limits, written once, from ``keyed_lines``.

    Counts cover all distinct texts. A null host is a host of its own.
    """
    hashes = F.transform("lines", lambda x: x["h"])
    per_doc = lines.select("host", "text_hash", F.array_distinct(hashes).alias("hs"))
    # texts per line, each text once: both steps combine before they shuffle
    texts = per_doc.select("host", "text_hash", F.explode("hs").alias("h")).distinct()
    counts = texts.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > min_docs)
    hosts = per_doc.filter(F.size("hs") > 0).select("host", "text_hash").distinct().groupBy("host")
    sizes = hosts.agg(F.count(F.lit(1)).alias("n")).select(F.col("host").alias("of_host"), "n")
    above = counts.join(sizes, F.col("host").eqNullSafe(F.col("of_host"))).filter(
        (F.col("n_docs") > F.col("n") * min_share) | (F.col("n_docs") > ENOUGH_DOCS)
    )
    return materialise(above.select("host", "h", "n_docs"), "frequent")


def line_tables(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE
) -> tuple[DataFrame, DataFrame]:
    keyed = keyed_lines(docs, id_col, text_col, host_col)
    return keyed, frequent_lines(keyed, min_docs, min_share)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    min_share: float = MIN_SHARE,
    min_kept: float = MIN_KEPT,
    tables: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """One row per row of ``docs`` with its measures and verdict.

    (doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
    removed_lines, base_failed, depleted, kept). A null text has no words and fails the base.
    Repeated rows get equal rows, null ids are kept as they are, other columns are not read.
    ``tables``: ``keyed_lines`` and ``frequent_lines`` where the caller has them already.
    """
    keyed, lines = tables or line_tables(docs, id_col, text_col, host_col, min_docs, min_share)
    key = ["doc_id", "host", "text_hash"]
    each = keyed.select(*key, F.posexplode("lines").alias("at", "line"))
    hit = each.select(*key, "at", F.col("line.h").alias("h"), F.col("line.w").alias("w")).join(
        lines.select(F.col("host").alias("of_host"), F.col("h").alias("of_h")),
        (F.col("h") == F.col("of_h")) & F.col("host").eqNullSafe(F.col("of_host")),
        "left_semi",
    )
    # repeated rows bring a line once more: (row, place) names it
    removed = (
        hit.groupBy(*key, "at").agg(F.first("w").alias("w"))
        .groupBy(*[F.col(k).alias(f"r_{k}") for k in key])
        .agg(F.sum("w").cast("long").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"))
    )
    text = text_of(text_col)
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(host_col).cast("string").alias("host"),
        F.xxhash64(text).alias("text_hash"),
        *[c.alias(n) for n, c in base_measures(docs, text_col).items()],
    )
    joined = own.join(
        removed,
        (F.col("text_hash") == F.col("r_text_hash"))
        & F.col("doc_id").eqNullSafe(F.col("r_doc_id"))
        & F.col("host").eqNullSafe(F.col("r_host")),
        "left",
    )
    n, gone = F.col("n_words"), F.col("removed_words")
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * 30)
    left = n - gone
    depleted = (gone > 0) & ((left < MIN_WORDS) | (left < n * min_kept))
    return (
        joined.select(
            "doc_id", "host", "text_hash",
            F.col("__words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
            F.col("__words.repeat").alias("n_repeat_words"),
            F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"),
            F.coalesce("removed_lines", F.lit(0).cast("long")).alias("removed_lines"),
        )
        .withColumns({"base_failed": failed, "depleted": depleted})
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """Rows of ``docs`` that stay, without their boilerplate lines; all columns, in order.

    A row that loses no line keeps its text to the byte. Texts move once, to meet their verdict.
    """
    keyed, lines = line_tables(docs, id_col, text_col, host_col, **limits)
    key = ["doc_id", "host", "text_hash"]
    kept = judge(docs, id_col, text_col, host_col, tables=(keyed, lines)).filter("kept").select(*key).distinct()
    frequent = lines.select(F.col("host").alias("of_host"), F.col("h").alias("of_h"))
    each = keyed.select(*key, F.explode("lines.h").alias("h"))
    same_line = (F.col("h") == F.col("of_h")) & F.col("host").eqNullSafe(F.col("of_host"))
    hits = each.join(frequent, same_line, "left_semi").groupBy(*[F.col(k).alias(f"g_{k}") for k in key])
    gone = hits.agg(F.collect_set("h").alias("gone"))  # at most the lines of one document
    verdict = kept.join(
        gone,
        (F.col("text_hash") == F.col("g_text_hash"))
        & F.col("doc_id").eqNullSafe(F.col("g_doc_id"))
        & F.col("host").eqNullSafe(F.col("g_host")),
        "left",
    ).select(*[F.col(k).alias(f"__{k}") for k in key], F.col("gone").alias("__gone"))
    text = text_of(text_col)
    same = (
        (F.xxhash64(text) == F.col("__text_hash"))
        & F.col(id_col).eqNullSafe(F.col("__doc_id"))
        & F.col(host_col).cast("string").eqNullSafe(F.col("__host"))
    )
    rows = docs.join(materialise(verdict, "verdict"), same)
    hashed = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(x.alias("x"), F.xxhash64(F.lower(F.regexp_replace(F.btrim(x, F.lit(WHITE)), WHITES, " "))).alias("h")),
    )
    rest = F.transform(F.filter(hashed, lambda e: ~F.array_contains("__gone", e["h"])), lambda e: e["x"])
    cut = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    return rows.withColumn(text_col, cut).select(*docs.columns)
