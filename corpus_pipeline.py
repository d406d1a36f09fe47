"""Cleaning a corpus for training: five stages, each writes its documents for the next.

Quality classifier, line dedup, one document of each near-duplicate group,
benchmark decontamination, token ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.llm import bpe, decontaminate, line_dedup, ngram_join, quality_classifier
from voxquarry.llm.queries import table, tokenizer_file
from voxquarry.session import cut_lineage, scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, accepts."""
    _, model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row in one, so that names of a user's columns never meet those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("user")


def row_key() -> Column:
    """128 bits that tell rows of different id or text apart, nulls included."""
    id_, text = F.col("doc_id").cast("string"), F.col("text")
    one = F.xxhash64(id_, text, id_.isNull(), text.isNull())
    return F.concat(F.hex(one), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text, text.isNull(), id_, id_.isNull())))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without three-line windows that stand earlier in the corpus.

    Only covered lines go; a document is dropped if they leave it without a
    word.  Whether what is left nearly copies another document is for the next
    stage to say.
    """
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", whole_row(docs)))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_left") > 0))
    before = F.col("user.n_chars") if "n_chars" in docs.columns else F.lit(None)
    changed = {"text": F.col("clean_text"), "n_chars": F.when(F.col("n_removed") == 0, before).otherwise(F.length("clean_text"))}
    return out.select(*[changed.get(c, F.col(f"user.`{c}`")).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows that repeat an id and its text stand once; different texts under one
    id are judged each by its own links.
    """
    again = cut_lineage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone")))
    if again.isEmpty():
        found = ngram_join.similar_documents(docs)
        return ngram_join.without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")))
    packed = docs.select("doc_id", "text", whole_row(docs))
    repeated = packed.join(ngram_join.light(again), packed["doc_id"] == again["gone"], "left_semi")
    repeated = cut_lineage(repeated.dropDuplicates(["doc_id", "text"]))
    name = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    keyed = ngram_join.without(packed, again).withColumn("_key", F.col("doc_id").cast("bigint")).union(repeated.withColumn("_key", name))
    found = ngram_join.similar_documents(keyed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    ids = keyed.where("doc_id IS NOT NULL").select("_key", "doc_id")
    member = cut_lineage(found.join(ids, "_key"))
    first = member.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("stays")).select(F.col("stays._key").alias("_key"))
    gone = member.join(first, "_key", "left_anti").select(F.col("_key").alias("gone"))
    return ngram_join.without(keyed, gone, "_key").select(*[F.col(f"user.`{c}`").alias(c) for c in docs.columns])


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows are judged by their own text, whatever ids are null or shared."""
    keyed = docs.select(row_key().alias("key"), "text")
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    return ngram_join.without(docs, leaks.select(F.col("key").alias("gone")), row_key())


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document left."""
    return bpe.encode(docs, tokenizer_file(), columns=("n_tokens", "ids"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", own_lines),
    ("n-gram jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("bpe encoding", token_ids),
]

#: Embedding, classifier and tokenizer can't be said in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
