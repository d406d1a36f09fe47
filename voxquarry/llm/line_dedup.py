"""Line dedup by overlapping windows of three lines.

Consecutive lines are hashed three at a time, windows that repeat anywhere in
the corpus are found by one aggregate, and all later occurrences go: their
covered positions are merged per document.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPAN = 3


def solid_lines(docs: DataFrame) -> DataFrame:
    """Append ``_lines`` (all lines) and ``_solid`` (index and text of lines with a word)."""
    df = docs.withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    stripped = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(SPACES)).alias("s")))
    return df.withColumn("_solid", F.filter(stripped, lambda x: x["s"] != ""))


def windows(docs: DataFrame) -> DataFrame:
    """``(_id, _body, p, h1, h2)``: every window of three solid lines under a 128-bit key."""
    starts = F.sequence(F.lit(0), F.size("_solid") - SPAN)
    df = solid_lines(docs).where(F.size("_solid") >= SPAN)
    df = df.select("_id", "_body", "_solid", F.explode(starts).alias("p"))
    three = [F.get("_solid", F.col("p") + k)["s"] for k in range(SPAN)]
    return df.select(
        "_id", "_body", "p", F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit("second key"), *reversed(three)).alias("h2")
    )


def later_windows(found: DataFrame) -> DataFrame:
    """Windows that stand earlier too, by document id, then text, then position."""
    first = (
        found.groupBy("h1", "h2")
        .agg(F.min(F.struct("_id", "_body", "p")).alias("first"), F.max(F.struct("_id", "_body", "p")).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    return found.join(first, ["h1", "h2"]).where(~F.col("first").eqNullSafe(F.struct("_id", "_body", "p")))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows removed from the text.

    All columns stay; ``clean_text``, ``n_lines`` (lines with a word),
    ``n_removed`` (those removed), ``n_spans`` (runs of removed lines),
    ``n_words`` and ``n_left`` (words before and after) are appended, replacing
    columns of these names.  Lines are compared without outer white space;
    lines without a word belong to no window and always stay.  The first
    occurrence is the one with the smallest id, text hash and position, so
    repeats inside one document go as well.

    Null text: null again, zero counts.  Fewer than three lines: unchanged.
    Null ids come first.  Rows that repeat id and text are one document and get
    the same result.  No rows: no rows.
    """
    own = ["clean_text", "n_lines", "n_removed", "n_spans", "n_words", "n_left"]
    extra = [c for c in docs.columns if c not in own]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.xxhash64(text_col).alias("_body"),
    )
    found = windows(rows.select("_id", "_text", "_body"))
    marks = (
        later_windows(found)
        .groupBy("_id", "_body")
        .agg(F.array_sort(F.collect_set("p")).alias("_marks"))
        .select(F.col("_id").alias("_mid"), F.col("_body").alias("_mbody"), "_marks")
    )
    df = solid_lines(rows.join(marks, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_body") == F.col("_mbody")), "left"))
    covered = F.array_distinct(F.flatten(F.transform("_marks", lambda p: F.sequence(p, p + (SPAN - 1)))))
    df = df.withColumn("_covered", covered)
    df = df.withColumn("_gone", F.transform("_covered", lambda p: F.get("_solid", p)["i"]))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    df = df.withColumn("_clean", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    ))
    spans = F.size(F.filter("_marks", lambda p, i: F.coalesce(p - F.get("_marks", i - 1) > SPAN, F.lit(True))))

    def words(c: str):
        bare = F.btrim(F.coalesce(F.col(c), F.lit("")), F.lit(SPACES))
        return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("bigint")

    df = df.withColumn("_nw", words("_text"))
    return df.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in extra],
        F.col("_clean").alias("clean_text"),
        F.size("_solid").cast("bigint").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_removed"),
        F.when(F.col("_gone").isNull(), 0).otherwise(spans).cast("bigint").alias("n_spans"),
        F.col("_nw").alias("n_words"),
        F.when(F.col("_gone").isNull(), F.col("_nw")).otherwise(words("_clean")).alias("n_left"),
    )
