"""Registered queries of this package: one per operator, over its whole table, and the pipeline."""

from __future__ import annotations

from pricewise.llm.common import table
from pricewise.llm.oracles import ORACLES  # noqa: F401


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_secret_scans(spark, sf_dir):
    from pricewise.llm.secret_scan import span_digests

    return span_digests(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark, sf_dir):
    """All conversations, and one whose texts hold the marks of the template."""
    from pyspark.sql import functions as F

    from pricewise.llm.chat import conversation_digests

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return conversation_digests(c.unionByName(more), _tokenizer("byte_bpe_50k.tiktoken"), _pattern()).drop("n_tokens", "loss_tokens")


def op3_source_mixing(spark, sf_dir):
    from pricewise.llm.mixing import replicate

    return replicate(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    from pricewise.llm.quality import verdicts

    return verdicts(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    from pricewise.llm.jaccard import classes

    return classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_suffix_dedup(spark, sf_dir):
    from pricewise.llm.suffixes import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"), width=400)


def op7_token_counts(spark, sf_dir):
    from pricewise.llm.lengths import encoded_lengths, length_histogram

    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern()))


def op8_sentencepiece(spark, sf_dir):
    from pricewise.llm.pieces import token_digests

    return token_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_exact_topk(spark, sf_dir):
    from pricewise.llm.topk import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_warc_revisits(spark, sf_dir):
    from pricewise.llm.revisits import resolved_pages

    return resolved_pages(table(spark, sf_dir, "pages"))


def op11_simhash_dedup(spark, sf_dir):
    from pricewise.llm.simhash import near_classes

    return near_classes(table(spark, sf_dir, "documents"), words=4, radius=4)


def op12_embedding_whitening(spark, sf_dir):
    from pricewise.llm.whiten import whitened

    return whitened(table(spark, sf_dir, "embeddings"), components=16, scale=64)


def op13_periodic_runs(spark, sf_dir):
    from pricewise.llm.periods import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_chat_formatting, op3_source_mixing, op4_quality_rules, op5_jaccard_join, op6_suffix_dedup,
    op7_token_counts, op8_sentencepiece, op9_exact_topk, op10_warc_revisits, op11_simhash_dedup, op12_embedding_whitening, op13_periodic_runs, pipeline)}
