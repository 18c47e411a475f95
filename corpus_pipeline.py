"""The corpus pipeline: what a stage returns is written and read again as the next one's documents.

Stages: documents that the toxicity grammar rejects go; one document of each
SimHash component stays; personal data is replaced; sources are mixed to their
target weights; what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octetloom.llm import mixing, packing, pii, simhash, toxicity
from octetloom.llm.common import ensure_checkpoint_dir
from octetloom.session import spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents scoring below one half, by a model fitted on the labels of these documents.

    A null or empty text has no clauses and stays; ids matter for the labels only,
    so that rows without one, or sharing one, are judged by their own texts; ties
    at one half go; an empty table stays empty; other columns stay as they are.
    """
    docs = spread(docs)
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component.

    Null and wordless texts are one component; of rows alike in id and
    fingerprint any one stays; unlike texts that share an id, or have none, all
    stay; an empty table stays empty; other columns stay as they are.
    """
    return simhash.one_of_each(spread(docs))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans found replaced by their kind and ``n_chars`` in step.

    A null text stays null; ids play no part; repeated rows stay repeated; an
    empty table stays empty; other columns stay as they are.
    """
    docs = spread(docs)
    return pii.redacted(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, by finish time.

    Null and empty texts have no words and are never taken; a null source is one
    of its own; rows without an id, or sharing one, are documents of their own;
    equal finish times go by shuffle key and id; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens.

    A null or empty text is its separator alone; repeated rows are pieces of their
    own, with a null doc_id where they have none; an empty table has no pieces.
    """
    out = packing.packed_documents(spread(docs))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The clause grammar, fingerprints, message passing and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again."""
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
