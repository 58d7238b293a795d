"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, html, oracles, pii, quality
from .common import small_batches, table
from .linededup import LineDedupConfig, dedup_lines
from .mixing import MixConfig, mix
from .neardup import NearDupConfig, near_duplicates
from .negatives import hard_negatives, quantised
from .prefixtrie import encoded, prefix_trie, rebuilt
from .repeats import without_repeats
from .sharding import shard_documents
from .toxicity import classify

#: The rank file of the vocabulary.
RANKS = "byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of what is left) of every document."""
    small_batches(spark)
    out = dedup_lines(table(spark, sf_dir, "documents"), LineDedupConfig(), counts=True)
    left = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", left)


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made from ``embeddings``: their classes, and the alignments of those with an id divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return audio.aligned(audio.melodies(rows, "embedding")).withColumnRenamed("id", "vec_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MixConfig()).select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDupConfig(words=2))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "html")
    return html.extract(rows).select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 24)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(encoded(table(spark, sf_dir, "conversations"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose vec_id is divisible by 100; a seventh of the labels is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), quantised(rows, "embedding").alias("v")))


def op13_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the 400-byte strings that start twice or more."""
    small_batches(spark)
    return without_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup,
            op2_chroma,
            op3_mix_sources,
            op4_minhash_odd_sketch,
            op5_decision_list,
            op6_bpe,
            op7_html_layout,
            op8_jump_shards,
            op9_toxicity,
            op10_pii_bootstrap,
            op11_prefix_trie,
            op12_hard_negatives,
            op13_repeated_strings,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": oracles.LINE_DEDUP, "op3_mix_sources": oracles.MIX, "op4_minhash_odd_sketch": oracles.NEAR_DEDUP, "op11_prefix_trie": oracles.PREFIX_TRIE, "op12_hard_negatives": oracles.HARD_NEGATIVES}
