"""Conflict-constrained best-fit packing (operator 6).

Documents are cut into pieces of at most ``capacity`` tokens and packed into
bins.  A bin never holds two pieces of one source or of one duplicate cluster:
bins are kept by residual, each residual and each source and cluster has a
bitmap of bins, and the search for a piece walks the residuals upward from its
size until the tightest bin that is in neither bitmap is found.  Pieces come
largest first; a full-size piece fills a bin of its own.

Rows are dealt to groups of about ``group_docs`` pieces by a hash of the id
and each group is packed by one task, so a hot source spreads over all groups
and no task grows with the input; only ids, sizes, sources and clusters are
shuffled, never texts.

Defined results: null and empty texts have no tokens and return one row with a
null bin; a null source conflicts with nothing; rows of the same text are one
cluster; repeated rows are packed as separate pieces; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_DOCS = 4096


class Bins:
    """Open bins of one group, ordered by residual, with conflict bitmaps."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free = [0] * (capacity + 1)     # residual -> bitmap of the bins that have it
        self.some = 0                        # bitmap of the residuals that have a bin
        self.holds: dict = {}                # source or cluster -> bitmap of the bins that hold it
        self.count = 0

    def place(self, size: int, keys: tuple) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin: (bin, offset)."""
        taken = 0
        for k in keys:
            taken |= self.holds.get(k, 0)
        left = self.some >> size << size
        while left:
            residual = (left & -left).bit_length() - 1
            fits = self.free[residual] & ~taken
            if fits:
                bit = fits & -fits
                self.free[residual] ^= bit
                if not self.free[residual]:
                    self.some ^= 1 << residual
                return self._put(bit, residual, size, keys)
            left &= left - 1
        bit = 1 << self.count
        self.count += 1
        return self._put(bit, self.capacity, size, keys)

    def _put(self, bit: int, residual: int, size: int, keys: tuple) -> tuple[int, int]:
        rest = residual - size
        if rest:
            self.free[rest] |= bit
            self.some |= 1 << rest
        for k in keys:
            self.holds[k] = self.holds.get(k, 0) | bit
        return bit.bit_length() - 1, self.capacity - residual


def pack_group(sizes, sources, clusters, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit over one group, largest first (ties in the given order):
    (bin, offset) of every piece and the number of bins."""
    bins, n = Bins(capacity), len(sizes)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        keys = tuple(k for k in (("s", sources[i]), ("c", clusters[i])) if k[1] is not None)
        where[i], offset[i] = bins.place(int(sizes[i]), keys)
    return where, offset, bins.count


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack rows (id, piece int, n_tokens int > 0 and <= capacity, source
    string, cluster long): adds (bin_id string, offset int, bin_tokens int)."""
    n = pieces.count()
    groups = max(1, -(-n // group_docs))
    kind = pieces.schema["id"].dataType.simpleString()
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"], kind="stable", na_position="first").reset_index(drop=True)
        source = [None if pd.isna(x) else x for x in pdf["source"]]
        cluster = [None if pd.isna(x) else x for x in pdf["cluster"]]
        where, offset, _ = pack_group(pdf["n_tokens"].to_numpy(), source, cluster, capacity)
        filled = np.bincount(where, weights=pdf["n_tokens"], minlength=1).astype(np.int64)
        g = pdf["grp"].iloc[0]
        return pd.DataFrame({"id": pdf["id"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"],
                             "source": source, "cluster": pdf["cluster"],
                             "bin_id": [f"{g}-{b}" for b in where], "offset": offset.astype(np.int32),
                             "bin_tokens": filled[where].astype(np.int32)})

    return dealt.groupBy("grp").applyInPandas(
        run, f"id {kind}, piece int, n_tokens int, source string, cluster long, bin_id string, offset int, bin_tokens int")


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
              capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: (id, piece, n_tokens, source, cluster); one of size
    0 for a text without tokens.  A token is a white-space separated word; a
    cluster is a text up to letter case and white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = docs.select(F.col(id_col).alias("id"), words.cast("int").alias("n"),
                       F.col(source).cast("string").alias("source"),
                       F.xxhash64(F.lower(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))).alias("cluster"))
    cut = rows.select("id", "source", "cluster", "n",
                      F.posexplode(F.expr(f"sequence(0, greatest(n - 1, 0), {capacity})")).alias("piece", "at"))
    return cut.select("id", F.col("piece").cast("int"),
                      F.least(F.lit(capacity), F.col("n") - F.col("at")).cast("int").alias("n_tokens"),
                      "source", "cluster")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                   capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Every piece of every document with its bin: (id, piece, n_tokens,
    source, cluster, bin_id, offset, bin_tokens); documents without tokens have
    a null bin."""
    from vigil.llm.common import materialize
    rows = materialize(pieces_of(docs.select(id_col, text, source), id_col, text, source, capacity), "pieces")
    packed = pack(rows.where("n_tokens > 0"), capacity, group_docs)
    none = rows.where("n_tokens = 0").select(
        "id", "piece", "n_tokens", "source", "cluster", F.lit(None).cast("string").alias("bin_id"),
        F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("bin_tokens"))
    return packed.unionByName(none).withColumnRenamed("id", id_col)
