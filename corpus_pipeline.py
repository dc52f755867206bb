"""A corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.llm.common import crc_text, shared_folder, table
from nightledger.session import ship

#: An executor holds several Arrow batches at a time, outside its heap; texts differ much in length, so bytes bound them.
BATCH_BYTES = 1 << 20
#: Documents whose predicted language is less sure than this go, with those that have none.
LEAST_SURE = 0.3


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds the session's Arrow batches (for good: a stage runs after its function has returned)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language, and sets lang to the prediction."""
    from nightledger.llm.language import fit, predict

    prepare(spark)
    model = fit(docs, crc_text(F.col("doc_id")) % 5 != 0)
    found = predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8)."""
    from nightledger.llm.simhash import one_of_each

    prepare(spark)
    return one_of_each(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    from nightledger.llm.decontam import clean_documents

    prepare(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by [kind]."""
    from nightledger.llm.secrets import redacted

    ship(spark)
    return redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of 4096."""
    from nightledger.llm.packing import pack_documents
    from nightledger.llm.queries import vocabulary

    prepare(spark)
    # fewer words than by default, and for a task: workers hold memory of other stages, and other stages run in them later
    return pack_documents(docs, vocabulary(), keep=150_000, forget=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The stages are learned models, sketches and packing: no SQL has their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
