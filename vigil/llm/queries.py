"""The queries of this subpackage: one ``opN_<name>`` per operator, each over
its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from vigil.llm import (
    ann,
    audit,
    html,
    jaccard,
    neardup,
    negatives,
    packing,
    pii,
    secrets,
    spm,
    suffixes,
    tokens,
    toxicity,
)
from vigil.llm.common import table
from vigil.llm.oracles import ORACLES  # noqa: F401


QUERIES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_main_text(spark, sf_dir):
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@_query
def op2_sentencepiece_nbest(spark, sf_dir):
    """N best segmentations of every document, with the round trip."""
    return spm.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op3_embedding_near_dedup(spark, sf_dir):
    """Every vector with its links and component."""
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query
def op4_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_secret_scan(spark, sf_dir):
    """Secrets of every document with their ownership class."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@_query
def op8_nn_descent_search(spark, sf_dir):
    """The 20 nearest vectors of every twentieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


@_query
def op9_pii_pseudonyms(spark, sf_dir):
    """Every document with its personal data replaced by pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise(docs, out="pseudonymised")
    return done.select("doc_id", F.size("pii").cast("long").alias("n_pii"),
                       F.concat_ws(",", F.transform("pii", lambda s: F.concat_ws(
                           ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))).alias("spans"),
                       "pseudonymised")


@_query
def op6_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its bin."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op7_token_counts(spark, sf_dir):
    """Tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op10_ngram_jaccard_join(spark, sf_dir):
    """Every document with its near-duplicate component."""
    return jaccard.cluster(table(spark, sf_dir, "documents"))


@_query
def op11_suffix_array_dedup(spark, sf_dir):
    """What is left of every document without the passages of earlier ones."""
    def digest(rows):
        lengths = F.zip_with("starts", "ends", lambda a, b: b - a)
        return rows.select("doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_removed"),
                           F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), shape=digest)


@_query
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=moved)


@_query
def op13_filter_audit(spark, sf_dir):
    """The interaction of the five filters in every order, by language."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
