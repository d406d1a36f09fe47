"""Quality rules: per-document counts, then lines that too many documents of a host share.

Cross-document line frequency: lines are normalised and hashed, distinct
document texts are counted per host and line, lines above the limits count as
removed, and documents left with too little are rejected.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def word_array(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, SPACE))


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """Append the per-document counts to ``docs``; needs no shuffle.

    A window is five words; its words count as repeated if the same five words
    stand twice or more in the text.  Windows meet as 64-bit hashes inside one
    document.  Only texts with a repeated window are sorted.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = docs.withColumns({"_words": word_array(F.col(text)), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    grams = F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)]),
    )
    df = df.withColumn("_grams", F.when(F.col("n_words") > WINDOW, grams))
    ordered = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), ordered))

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("_sorted", i)["g"] == x["g"], F.lit(False))

    at = F.array_sort(
        F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])
    )
    df = df.withColumn("_at", at)
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    return df.drop("_words", "_lines", "_hash", "_grams", "_sorted", "_at")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one space, no outer space."""
    return F.regexp_replace(F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), SPACE, " "), "[0-9]", "0")


def line_words(docs: DataFrame, text: str) -> DataFrame:
    """One row per line with a word: ``(doc_id, host, body, line, words)``, hashes for texts and lines."""
    lines = docs.select(
        "doc_id", "host", F.xxhash64(text).alias("body"), F.explode(F.split(F.col(text), "\n", -1)).alias("raw")
    ).withColumn("norm", normal_line(F.col("raw")))
    return lines.where("norm <> ''").select(
        "doc_id", "host", "body",
        F.xxhash64("norm").alias("line"),
        (F.length("norm") - F.length(F.translate("norm", " ", "")) + 1).cast("bigint").alias("words"),
    )


def frequent_lines(lines: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """``(host, line)`` in more than ``min_docs`` documents of the host, and in more than ``max_docs`` or a share ``max_share`` of all.

    The smaller of the last two decides, so the limit doesn't grow with a
    large host.  The first aggregate spreads a hot line over its documents,
    the second is pre-aggregated per task.
    """
    seen = lines.groupBy("host", "line", "doc_id", "body").agg(F.lit(1).alias("one"))
    per_line = seen.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    hosts = lines.groupBy("host", "doc_id", "body").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("total"))
    hosts = hosts.withColumnRenamed("host", "host_")
    return (
        per_line.join(hosts, F.col("host").eqNullSafe(F.col("host_")))
        .where(F.col("docs") > F.least(F.col("total") * max_share, F.lit(float(max_docs))))
        .select("host", "line")
    )


def apply_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_docs: int = 10,
    max_share: float = 0.02,
    max_docs: int = 1000,
    min_left: float = 0.5,
) -> DataFrame:
    """Counts and verdict per row of ``docs``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_lines, removed_words, kept``.  A row is kept unless a
    base rule fails or lines above the limits hold more than ``1 - min_left``
    of its words.

    Null or blank text: all counts 0, ``base_failed``.  Null host: a host of
    its own.  Null or repeated ids: every row gets its own result; rows that
    repeat id, host and text are one document and agree.  Very long texts are
    taken whole.  Other columns are ignored.  No rows: no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text")
    )
    counts = base_counts(rows, "text").withColumn("body", F.xxhash64("text")).drop("text")
    lines = line_words(rows, "text")
    hot = frequent_lines(lines, min_docs, max_share, max_docs).select(
        F.col("host").alias("hot_host"), F.col("line").alias("hot_line"), F.lit(True).alias("hot")
    )
    removed = (
        lines.join(hot, (F.col("line") == F.col("hot_line")) & F.col("host").eqNullSafe(F.col("hot_host")))
        .groupBy("doc_id", "host", "body")
        .agg(F.sum("words").alias("removed"), F.count("*").alias("hot_lines"))
        .select(
            F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("body").alias("r_body"), "removed", "hot_lines"
        )
    )
    # rows repeated whole add their lines once each, so divide by how often the row stands
    times = rows.groupBy("doc_id", "host", F.xxhash64("text").alias("body")).count().where("count > 1")
    removed = removed.join(
        times.select(
            F.col("doc_id").alias("t_id"), F.col("host").alias("t_host"), F.col("body").alias("t_body"), "count"
        ),
        F.col("r_id").eqNullSafe(F.col("t_id"))
        & F.col("r_host").eqNullSafe(F.col("t_host"))
        & (F.col("r_body") == F.col("t_body")),
        "left",
    ).select(
        "r_id", "r_host", "r_body", *[(F.col(c) / F.coalesce("count", F.lit(1))).cast("bigint").alias(c) for c in ("removed", "hot_lines")]
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    gone = F.coalesce("removed", F.lit(0).cast("bigint"))
    return counts.join(
        removed,
        F.col("doc_id").eqNullSafe(F.col("r_id"))
        & F.col("host").eqNullSafe(F.col("r_host"))
        & (F.col("body") == F.col("r_body")),
        "left",
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce("hot_lines", F.lit(0).cast("bigint")).alias("removed_lines"),
        gone.alias("removed_words"),
        (~failed & (gone <= F.col("n_words") * (1 - min_left))).alias("kept"),
    )
