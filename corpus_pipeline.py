"""The corpus pipeline: toxic documents go, copies and repeated passages go, sources are mixed, texts are encoded.

Each stage but the last returns the columns of its input, whatever they are called; columns that
are named as one that an operator adds keep their own values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.llm.bpe import bpe_encode, default_tokenizer
from docsluice.llm.frames import at_exit, dropped, shared_folder, sheltered, table
from docsluice.llm.mixing import mixed
from docsluice.llm.ngram_join import one_of_each
from docsluice.llm.substring_dedup import substring_dedup
from docsluice.llm.toxicity import CUT, learn, measured_texts

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the cut."""
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    inner, own = sheltered(docs, ("doc_id", "text"))
    return measured_texts(inner, lexicon, keep_text=True).where(F.col("score") < CUT).select(own)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies one row, of the smallest doc_id; rows without one come last."""
    inner, own = sheltered(docs, ("doc_id", "text"))
    return one_of_each(inner).select(own)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 or more words that a smaller document holds too."""
    inner, own = sheltered(docs, ("doc_id", "text", "n_chars"))
    cut = substring_dedup(inner)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(own)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once for each time that it is read."""
    inner, own = sheltered(docs, ("doc_id", "text", "source"))
    return mixed(inner).select(own)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of them and of what they decode to."""
    encoded = bpe_encode(docs.select("doc_id", "source", "text"), *default_tokenizer())
    return encoded.select("doc_id", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near copies", near_copies),
    ("repeated passages", passages),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: SQL cannot express the first stage; the tests hold every stage and run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read by the next, and go when it is done.

    What the last stage has written is read by the result, and goes when the program ends; after a failure nothing stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                dropped(spark, f"{folder}/{k - 1}")
    except Exception:
        dropped(spark, folder)
        raise
    at_exit(spark, folder)
    return docs
