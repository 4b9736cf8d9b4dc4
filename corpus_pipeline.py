"""A corpus pipeline in five stages, each written and read again by the next.

Each stage takes any table with the columns of documents, whatever else it holds: an empty
one gives an empty one, columns that have the name of a result or of an inner column stay as
they are, and texts of any length are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegap.llm import langid, lines, minhash, mixing, pieces
from tidegap.llm.common import columns, fresh
from tidegap.storage import delete, durable, scratch, shared_dir

#: A document whose best language has less than this probability is rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a clear language; learns from the
    labels among ``docs``. The columns of ``docs`` stay as they are. A null or empty text
    goes, as does every document if there is no label to learn from; null or repeated ids
    and sources make no difference, since rows are judged by their texts alone."""
    names = docs.columns
    lang, score = (fresh(n, names) for n in ("lang_pred", "score"))
    out = langid.identify(docs, langid.train(docs), tuple(names), (lang, score))
    return out.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(columns(names))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shortens texts by chunks of lines that stand elsewhere before. Every row stays: a null
    text null, a text without lines left empty; rows without an id keep their texts. Rows
    that share an id and a text keep the same lines, with unlike texts each its own."""
    return lines.dedup_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates (five-word shingles, similarity of
    0.8 or more), that with the smallest id, null ids last. Each row is judged by its own
    text: rows that share a doc_id, or have none, and have unlike texts all stay. Texts that
    are null or without words stay. Of rows alike in doc_id and text one stays; which one
    isn't defined if they differ in other columns."""
    key = fresh("_key", docs.columns)
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("n_shingles > 0")
    found = durable(found.groupBy(F.col("doc_id").alias("key"), "component_id").count(), "found")
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").isNull().alias("none"), "doc_id").distinct()
    stays = found.join(ids, "key").groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "key")).alias("least"))
    judged = durable(found.join(stays, "component_id").select(F.col("key").alias(key), "count", (F.col("key") == F.col("least.key")).alias("stays")), "judged")
    out = rows.join(judged.where("not stays").select(key), key, "left_anti")
    twice = judged.where("stays and count > 1").select(key)
    if twice.head(1):  # rows alike in doc_id and text
        out = out.join(twice, key, "left_anti").unionByName(out.join(twice, key, "left_semi").dropDuplicates([key]))
    return out.select(columns(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those it doesn't take go.
    Wordless documents, null texts among them, belong to every mix and are kept once. A
    null source is a source like others; rows that share an id, or have none, share their
    number of repeats, the largest that one of them has."""
    ident, repeats, copy = (fresh(n, docs.columns) for n in ("_id", "_repeats", "_copy"))
    plan = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias(ident)).agg(F.max("repeats").alias(repeats))
    words = mixing.n_words(F.col("text"))
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(ident)))
    times = F.when(words == 0, F.lit(1)).otherwise(F.col(repeats).cast("int"))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(columns(docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, n_tokens, tokens_crc and round_trip of the final corpus, a row
    for each of ``docs``; null and empty texts have no tokens."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "source"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: SQL can express neither the trained network nor the chunks of lines.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table in the shared folder, where
    a stage's inner tables are deleted at its end and its input once it has been read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home, before = f"{shared_dir(spark)}/tidegap/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        if before:
            delete(spark, before)
        before = f"{home}/{name}"
        docs = spark.read.parquet(before)
    return docs
