"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

The first four stages return the columns of ``documents``; each works on all rows
its predecessor kept, and its decisions take effect:

1. toxicity: rows that score at or above the threshold go;
2. near-dedup: one row of each component stays; SimHash links, and five-word shingles at 0.8 or more;
3. decontamination: rows in which a benchmark item occurs go;
4. pii: personal data is replaced by its kind, ``n_chars`` follows the text;
5. bpe: the last stage returns ids, counts and the digests of an encode-decode trip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontam, pii, simhash, toxicity
from quillspark.llm.common import fresh, table
from quillspark.operators.durable import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh("toxicity", docs)
    return toxicity.toxicity_scores(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = fresh("spans", docs)
    clean = pii.redact(pii.pii_spans(docs, out=spans), spans=spans)
    changed = F.size(spans) > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(docs, bpe.default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Stages train a model and run automata, which SQL cannot express; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to shared scratch and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
