"""TF-IDF index and exact top-k retrieval on inverted lists.

Texts are indexed once per distinct text.  Retrieval never forms all pairs of
documents that share a term: a first pass over the strongest entries of every
list gives each query a score it is sure to reach, and terms whose summed best
contribution stays below that score cannot bring in a new document.  Only the
other ("essential") terms are joined, and a pair is scored in full only if its
partial sum plus the bound of the skipped terms can still reach that score.
Both tests are bounds, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .retrieval import BANK_ORDER, EXTENT, _bank_order, _candidates, _pick, leave_one_out_shortlist
from .voxels import TARGET

TOKEN = r"(?U)\b\w\w+\b"


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def terms_of(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two or more characters without stop words, then their bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words  # long lists become a hash set

    def with_pairs(kept: Column) -> Column:
        pairs = F.when(
            F.size(kept) > 1,
            F.zip_with(
                F.slice(kept, 1, F.size(kept) - 1),
                F.slice(kept, 2, F.size(kept) - 1),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(kept, pairs)

    return F.get(F.transform(F.array(kept), with_pairs), F.lit(0))  # the words are cut once a row


def tfidf_postings(texts: DataFrame, stop_words: list[str], max_features: int = 5000) -> DataFrame:
    """Rows (text_key, term, weight), one document vector per distinct text.

    weight = (1 + ln tf) * (ln((1+n)/(1+df)) + 1), scaled to unit length.  The
    vocabulary keeps the ``max_features`` terms with the highest corpus count.
    """
    distinct = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    tf = (
        distinct.select(text_key(F.col("text")).alias("text_key"), "copies", F.explode(terms_of(F.col("text"), stop_words)).alias("term"))
        .groupBy("text_key", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("copies").alias("copies"))
    )
    n_docs = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    vocabulary = (
        tf.groupBy("term")
        .agg(F.sum(F.col("tf") * F.col("copies")).alias("corpus_tf"), F.sum("copies").alias("df"))
        .orderBy(F.col("corpus_tf").desc(), "term")
        .limit(max_features)
        .select("term", (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1.0).alias("idf"))
    )
    raw = tf.join(vocabulary, "term").select(
        "text_key", "term", ((F.lit(1.0) + F.ln("tf")) * F.col("idf")).alias("w")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("text_key")))
    return raw.select("text_key", "term", (F.col("w") / length).alias("weight"))


def tfidf_index(docs: DataFrame, stop_words: list[str], max_features: int = 5000, doc: str = "doc_id") -> DataFrame:
    """Rows (doc, term, weight) for every document."""
    keyed = docs.select(doc, text_key(F.col("text")).alias("text_key"))
    return keyed.join(tfidf_postings(docs, stop_words, max_features), "text_key").select(doc, "term", "weight")


def _vectors(postings: DataFrame) -> DataFrame:
    """One sparse vector (term -> weight) per text; at most ``max_features`` entries."""
    return postings.groupBy("text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("vec")
    )


# Scores keep this many digits, so that equal scores tie (and fall back to bank
# order) no matter in which order the products were added.
SCORE_DIGITS = 9


def _exact_scores(pairs: DataFrame, query_vec: DataFrame, bank_vec: DataFrame) -> DataFrame:
    """Append the full dot product of the two sparse vectors of every pair."""
    j = spread(pairs, "q_key", "text_key").join(query_vec, "q_key").join(bank_vec, "text_key")
    score = F.aggregate(
        F.map_entries("q_vec"),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("b_vec", e["key"]), F.lit(0.0)),
    )
    return j.select("q_key", "text_key", F.round(score, SCORE_DIGITS).alias("score"))


def tfidf_topk(queries: DataFrame, bank: DataFrame, stop_words: list[str], k: int = 3, max_features: int = 5000) -> DataFrame:
    """Best k non-empty bank rows of other cases by TF-IDF cosine.

    ``bank`` holds every text (empty masks too, they count for the weights).
    Queries that share terms with fewer than k rows are filled in bank order
    with score 0.
    """
    # Vectors and the shortlisted bank are read several times: store them once.
    # Inverted lists are unfolded from the vectors, which needs no shuffle.
    vectors = cut_lineage(_vectors(tfidf_postings(bank, stop_words, max_features)))
    entries = _candidates(bank).select(
        *BANK_ORDER, "mask_id", *EXTENT, text_key(F.col("text")).alias("text_key")
    )
    entries = cut_lineage(leave_one_out_shortlist(entries, ["text_key"], _bank_order(), 2 * k))
    q_rows = queries.select(*TARGET, text_key(F.col("text")).alias("q_key"))
    b_vec = cut_lineage(vectors.join(entries.select("text_key"), "text_key", "left_semi")).withColumnRenamed("vec", "b_vec")
    # Queries are bank rows too, so their vectors are in the index.
    q_vec = vectors.withColumnsRenamed({"text_key": "q_key", "vec": "q_vec"})
    q_vec = cut_lineage(q_vec.join(q_rows, "q_key", "left_semi"))
    b_post = b_vec.select("text_key", F.explode("b_vec").alias("term", "weight"))
    q_post = q_vec.select("q_key", F.explode("q_vec").alias("term", "weight"))

    def shortlist(pairs: DataFrame) -> DataFrame:
        hits = _exact_scores(pairs, q_vec, b_vec).where(F.col("score") > 0).join(entries, "text_key")
        return leave_one_out_shortlist(hits, ["q_key"], [F.col("score").desc(), *_bank_order()], k)

    strongest = Window.partitionBy("term").orderBy(F.col("weight").desc(), "text_key")
    champions = b_post.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= 2 * k)
    seeds = q_post.select("q_key", "term").join(
        champions.select("term", "text_key"), "term"
    ).select("q_key", "text_key").distinct()
    floor = (
        shortlist(seeds)
        .groupBy("q_key")
        .agg(F.when(F.count(F.lit(1)) >= 2 * k, F.min("score")).alias("floor"))
    )
    ceiling = b_post.groupBy("term").agg(F.max("weight").alias("best"))
    weakest_first = Window.partitionBy("q_key").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    slack = 10.0 ** (1 - SCORE_DIGITS)
    bounded = (
        q_post.join(ceiling, "term")
        .withColumn("bound", F.col("weight") * F.col("best"))
        .withColumn("reach", F.sum("bound").over(weakest_first))
        .join(floor, "q_key", "left")
        .withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        .withColumn("essential", F.col("reach") + slack >= F.col("floor"))
    )
    # What the skipped terms can add at most: the reach of the last of them.
    limits = bounded.groupBy("q_key").agg(
        F.max("floor").alias("floor"),
        F.coalesce(F.max(F.when(~F.col("essential"), F.col("reach"))), F.lit(0.0)).alias("rest"),
        F.coalesce(F.sum(F.when(~F.col("essential"), F.col("weight") * F.col("weight"))), F.lit(0.0)).alias("rest_sq"),
    )
    partial = (
        bounded.where("essential")
        .select("q_key", "term", F.col("weight").alias("qw"))
        .join(b_post, "term")
        .groupBy("q_key", "text_key")
        .agg(
            F.sum(F.col("qw") * F.col("weight")).alias("partial"),
            F.sum(F.col("weight") * F.col("weight")).alias("used_sq"),
        )
    )
    # Vectors have length 1, so the skipped terms meet at most what is left of both lengths.
    lengths = F.sqrt(F.col("rest_sq") * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("used_sq")))
    pairs = (
        partial.join(limits, "q_key")
        .where(F.col("partial") + F.least("rest", lengths) + slack >= F.col("floor"))
        .select("q_key", "text_key")
    )
    hits = cut_lineage(
        _pick(q_rows, shortlist(pairs), ["q_key"], k).select(
            *TARGET, "m_case_id", "m_mask_id", "m_pos", "score", *EXTENT
        )
    )

    # Fill-ups: the first bank rows in order; 2k per case and 4k in all always suffice.
    # The shortlist per text was cut for 2k, so the overall head is inside it.
    head = leave_one_out_shortlist(entries.drop("text_key"), [], _bank_order(), 2 * k)
    fillers = head.agg(
        F.collect_list(
            F.struct(
                F.col("case_id").alias("m_case_id"), F.col("mask_id").alias("m_mask_id"),
                F.col("pos").alias("m_pos"), *EXTENT,
            )
        ).alias("f")
    ).scalar()
    found = hits.groupBy(*TARGET).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("m_case_id", "m_pos")).alias("seen")
    )
    short = q_rows.join(found, TARGET, "left").where(F.coalesce("n", F.lit(0)) < k)
    filled = (
        short.withColumn("f", F.explode(fillers))
        .select(*TARGET, "seen", "f.*")
        .where(F.col("m_case_id") != F.col("case_id"))
        .where(~F.coalesce(F.array_contains("seen", F.struct("m_case_id", "m_pos")), F.lit(False)))
        .withColumn("score", F.lit(0.0))
        .drop("seen")
    )
    w = Window.partitionBy(*TARGET).orderBy(F.col("score").desc(), "m_case_id", "m_pos")
    return hits.unionByName(filled).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
