"""The corpus pipeline: documents pass the stages in order, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalvault.llm.common import free_name, ship
from signalvault.llm.mixing import mixed
from signalvault.llm.ngram_join import first_of_classes
from signalvault.llm.secret_scan import scan_secrets
from signalvault.llm.sentencepiece_bpe import encode_documents
from signalvault.llm.toxicity import fit, score_toxicity
from signalvault.session import cut_lineage

TOXIC = 0.5
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores TOXIC or more go."""
    ship(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "toxicity")
    return score_toxicity(docs, model, name=name).where(F.col(name)["score"] < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 or more on five-word shingles, the one of the least doc_id stays.

    Rows are judged one by one: different texts that share a doc_id all stay, copies go even where they have none.
    Null, empty and wordless texts are nobody's copies. No rows give no rows.
    """
    ship(spark)
    return first_of_classes(docs, width=5, bound=(80, 100))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; ``n_chars`` follows the text."""
    ship(spark)
    masked = scan_secrets(docs, mask=True)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids with begin and end ids."""
    ship(spark)
    return encode_documents(docs.select("doc_id", "text"), PIECES).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL: str | None = None
"""SQL cannot state the classifier, the automaton or the tokenizer; tests hold each stage against a plain version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
