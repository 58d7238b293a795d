"""A training-data pipeline over ``documents``: toxicity, line dedup, near-dedup, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import bpe, linededup, mixing, neardup, toxicity
from talweg.llm.common import WORD, collect_garbage, materialise, small_batches, table
from talweg.llm.queries import RANKS


def _start(spark: SparkSession) -> None:
    """Bound what a stage's Python workers need, and free what the stage before has left."""
    small_batches(spark)
    collect_garbage(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; the model is learnt from this stage's input and ``labels``."""
    _start(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "_score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are similar to an earlier line of any document. A document that has lost
    all its words goes; n_chars follows the text."""
    _start(spark)
    out = linededup.dedup_lines(docs, counts=True)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(WORD)
    out = out.filter(F.coalesce(left, F.lit(True)))
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of smallest id."""
    _start(spark)
    return neardup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; a document that is taken several times has as many rows."""
    _start(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every row, with whether the ids decode to the text."""
    import public_tokenizers

    _start(spark)
    rows = docs.select("doc_id", "source", "text")
    out = bpe.round_trip(rows, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    whole = F.col("raw") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), whole.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", token_ids),
]
#: Learning, similarity joins and BPE aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
