"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegap.llm import ann, langid, lines, minhash, mixing, pieces, quality, secrets, tokens, warc
from tidegap.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    return pieces.encode(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"), ids=False)


def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir))


def op3_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_nearest(spark, sf_dir):
    return ann.search_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_token_counts(spark, sf_dir):
    return tokens.count_tokens(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))


def op6_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", *lines.COUNTS, "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), 3, 85)


def op10_secrets(spark, sf_dir):
    return secrets.scan_secrets(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_mix_sources, op3_language, op4_nearest, op5_token_counts,
        op6_line_dedup, op7_warc, op8_quality, op9_minhash, op10_secrets,
    )
}
ORACLE = {"op2_mix_sources": mixing.ORACLE_SQL, "op7_warc": warc.ORACLE_SQL, "op10_secrets": secrets.ORACLE_SQL}
