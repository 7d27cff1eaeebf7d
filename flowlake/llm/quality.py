"""Quality rules with cross-document line frequency (native).

A line is normalised (blank runs to one space, digit runs to ``0``, lower case) and hashed. For
each host the distinct documents that hold a line are counted; copies of one text count once, so
a document is not boilerplate merely for having been copied. Lines held by more than ``min_docs``
and by more than ``max_share`` of a host's distinct documents are removed, and a document that
keeps less than ``min_left`` of its words is depleted and rejected. Base rules (length, repetition)
reject on their own.

A text's line hashes are shuffled once, as an array, to keep one row for each distinct text of a
host; frequencies of lines are partial sums before their shuffle, so that neither a hot host nor a
line in every document meets in one task. Line hashes
have 64 bits and are compared within a host only.

Null texts and texts without a word have no words and no lines and fail the base rules. A null
host is a host of its own. Repeated rows get the same verdict and count once. Other columns pass
through; a column named as a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import BLANK, WORD, fingerprint, let, words

MIN_DOCS = 10
MAX_SHARE = 0.10
MIN_LEFT = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def repeated_words(w: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more."""

    def starts(grams: Column) -> Column:
        """The sorted starts of the windows that occur elsewhere too."""
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), F.size(s) - 1),
                        lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"]))
                        | F.coalesce(F.get(s, k + 1)["h"] == F.get(s, k)["h"], F.lit(False)),
                    ),
                    lambda k: F.get(s, k)["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0),
            lambda n, k: n + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3))),
        )

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(starts(grams), covered))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, 0).otherwise(let(grams, count)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    )


def normalised(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), BLANK, " "), "[0-9]+", "0")
    return F.trim(plain)


def line_hashes(text: Column) -> Column:
    """One 64-bit hash for each line, null for lines without a word."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(WORD), F.xxhash64(normalised(x))))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Which lines of which text are frequent on its host: host, print, lines, words."""
    plain = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(
        F.transform(F.split(plain, "\n"), lambda x: F.struct(F.when(x.rlike(WORD), F.xxhash64(normalised(x))).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))),
        lambda s: s["line"].isNotNull(),
    )
    rows = docs.select(F.col(host).alias("host"), fingerprint(F.col(text)).alias("print"), found.alias("lines"))
    texts = rows.groupBy("host", "print").agg(F.first("lines").alias("lines"))  # each distinct text of a host once
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = texts.select("host", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "line")
    counts = counts.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    limits = sizes.withColumnRenamed("host", "of_host")
    often = (
        counts.join(limits, F.col("host").eqNullSafe(F.col("of_host")))
        .where(F.col("n") > F.lit(max_share) * F.col("n_docs"))
        .select(F.col("of_host").alias("at_host"), F.col("line").alias("often"))
    )
    lines = texts.select("host", "print", F.inline("lines"))
    held = lines.join(often, F.col("host").eqNullSafe(F.col("at_host")) & (F.col("line") == F.col("often")))
    return held.groupBy("host", "print").agg(F.collect_set("line").alias("lines"), F.sum("words").cast("long").alias("words"))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
    cleaned: bool = False,
) -> DataFrame:
    """Every row with its base measures, the words its frequent lines hold and the verdict ``kept``.

    With ``cleaned``, the text comes back without its frequent lines.
    """
    result = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words", "base_failed", "kept"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop(*result).withColumns({"__host": F.col(host), "__print": fingerprint(F.col(text))})
    rows = rows.withColumn("__m", let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
    rows = rows.withColumns(
        {
            "n_words": F.col("__m.n"),
            "word_chars": F.length(F.regexp_replace(body, BLANK, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": duplicate_lines(body),
            "n_repeat_words": F.col("__m.r"),
        }
    ).drop("__m")
    found = frequent_lines(docs, text, host, min_docs, max_share).select(
        F.col("host").alias("__h"), F.col("print").alias("__p"), F.col("lines").alias("__lines"), F.col("words").alias("__words")
    )
    rows = rows.join(found, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__print") == F.col("__p")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumns({"n_frequent_words": F.coalesce("__words", F.lit(0).cast("long")), "base_failed": failed})
    left = F.col("n_words") - F.col("n_frequent_words")
    rows = rows.withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words")))
    if cleaned:
        lines = F.filter(
            F.split(text, "\n"),
            lambda x: ~F.coalesce(F.array_contains("__lines", F.xxhash64(normalised(x))), F.lit(False)) | ~x.rlike(WORD),
        )
        rows = rows.withColumn(text, F.when(F.col("__lines").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n")))
    return rows.drop("__host", "__print", "__h", "__p", "__lines", "__words")
