"""Corpus pipeline over ``documents``: toxicity filter, near-duplicate removal,
credential masking, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next.  All but the last keep the columns of
``documents``.  Null texts, empty texts and repeated rows pass as the
operators define them: an empty text is scored by the bias of the model alone,
is no near-duplicate of anything and packs as a document without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ship_package

#: SQL can't express the learned filter; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents scored 0.7 or more go; all others stay as they are."""
    from vigil.llm import toxicity
    from vigil.llm.common import table
    ship_package(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = "score"
    while name in docs.columns:
        name += "_"
    scored = toxicity.score(docs, model, keep=docs.columns, out=name)
    return scored.where(F.col(name) < toxicity.REJECT).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates the smallest doc_id stays."""
    from vigil.llm import jaccard
    ship_package(spark)
    return jaccard.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the values of owner-specific credentials are masked, copied
    examples stay; n_chars follows the new text."""
    from vigil.llm import secrets
    ship_package(spark)
    done = secrets.mask_live(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                           .otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every piece of every document with its bin."""
    from vigil.llm import packing
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies),
          ("secrets", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    from vigil.llm.common import materialize, table
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", 8)
    return docs
