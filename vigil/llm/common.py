"""Helpers shared by the corpus operators: tables, scratch tables, regex spans,
connected components and the vectorised word / shingle hashing."""

from __future__ import annotations

import gc
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, name: str, batch_mb: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    cuts lineage, is computed once and survives the loss of executors.
    ``batch_mb`` bounds the Arrow batches of whole texts on their way to Python."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(BATCH_BYTES, None)
    try:
        if batch_mb:
            spark.conf.set(BATCH_BYTES, str(batch_mb << 20))
        df.write.parquet(path)
    finally:
        if batch_mb:
            spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now: it acts
    when the driver collects garbage, which a roomy driver seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what Arrow's pool and the allocator keep of finished batches: an
    idle worker holds it beside the workers of the next step otherwise."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)         # glibc only
    if trim:
        trim(0)


def cut(batch, column: int, limit: int = 1_000_000) -> list:
    """Runs of about ``limit`` bytes of a text column of an Arrow batch (whole
    rows; one run where the column holds no text), so that few texts are
    Python strings at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = batch.column(column)
    if not batch.num_rows or not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        return [batch]
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit, prepend=-1))
    return [batch.slice(i, j - i) for i, j in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True)]


def map_texts(docs: DataFrame, keep: list[Column | str], text: str, fn, added: dict[str, str]) -> DataFrame:
    """``keep`` columns of every row, untouched, and the columns ``added``
    (name -> type, one of those below) that ``fn(list of texts or None)``
    returns as a list of arrays; a run of an Arrow batch at a time, no shuffle."""
    import pyarrow as pa
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
             "array<string>": pa.list_(pa.string())}
    src = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields),
                        *(f"`{k}` {v}" for k, v in added.items())])
    names = [*src.columns, *added]

    def run(batches):
        for batch in batches:
            for b in cut(batch, batch.num_columns - 1):
                new = fn(b.column(b.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:-1], *(pa.array(c, kinds[k]) for c, k in zip(new, added.values(), strict=True))], names=names)
        give_back()

    # the text comes last, so a kept column of the same name does no harm
    return docs.select(*keep, F.col(text).alias("_text_")).mapInArrow(run, schema)


# ---------------------------------------------------------------- regex spans

def regex_spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as
    array<struct<start int, end int, hit string>> in code points (end exclusive).

    Built-ins only: ``split`` gives the text between the matches and
    ``regexp_extract_all`` the matches, so every start is a running sum of
    their lengths.  ``guard`` (a cheap test) spares rows without a match.
    """
    schema = "array<struct<start:int,end:int,hit:string>>"
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("pos"), F.expr(f"CAST(array() AS {schema})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("pos"),
                        F.concat(acc["out"], F.array(F.struct(
                            s.alias("start"), e.alias("end"), x["hit"].alias("hit")))).alias("out"))

    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), start, step)["out"]
    test = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(F.coalesce(test, F.lit(False)), spans).otherwise(F.expr(f"CAST(array() AS {schema})"))


# ------------------------------------------------------- connected components

def _local_stars(batches):
    """Union-find over the edges of one partition, in bounded slices: the same
    components with fewer, shorter paths."""
    import pandas as pd
    for pdf in batches:
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = inv[:len(a)], inv[len(a):]
        lab = np.arange(len(ids))
        while True:
            lo = np.minimum(lab[x], lab[y])
            new = lab.copy()
            np.minimum.at(new, x, lo)
            np.minimum.at(new, y, lo)
            np.minimum.at(new, lab[x], lo)
            np.minimum.at(new, lab[y], lo)
            new = new[new]
            if (new == lab).all():
                break
            lab = new
        keep = lab != np.arange(len(ids))
        yield pd.DataFrame({"a": ids[keep], "b": ids[lab[keep]]})


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large
    and small stars: returns (node, component) for every node on an edge,
    component = the smallest node id reachable.

    Each round is two map-side combined ``min`` aggregations joined back, so a
    node with very many edges is never gathered; rounds grow with the
    logarithm of the longest path.  Every round is written to the shared folder.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = e.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = e.mapInPandas(_local_stars, "a long, b long")
    e = materialize(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state or not now["n"]:
            break
        state = (now["n"], now["h"])
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(small.select("a", F.col("m").alias("b")))
                 .where(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        e = materialize(small, name)
    stars = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = e.select(F.col("b").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    return stars.unionAll(roots.select("node", F.col("node").alias("component")))


# ------------------------------------------------ vectorised words / shingles

_U = np.uint64
_MASK = (1 << 64) - 1


def _word_constants():
    rng = np.random.default_rng(20240229)
    byte = rng.integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
    base = int(rng.integers(0, _MASK, dtype=np.uint64)) | 1
    mult = rng.integers(0, _MASK, 8, dtype=np.uint64) | _U(1)
    return byte, base, pow(base, -1, 1 << 64), mult


BYTE, BASE, BASE_INV, MULT = _word_constants()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, b in (("p", BASE), ("i", BASE_INV)):
            p = np.ones(1, np.uint64)
            step = b
            while len(p) < size:
                p = np.concatenate([p, p * _U(step)])
                step = step * step & _MASK
            _POW[key] = p
    return _POW["p"], _POW["i"]


def words_of(texts: list, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of A-Z lower-cased texts, all at once: (word hash, text index,
    start byte, end byte, lower-cased bytes).  Words are the runs of bytes not
    in ``space``, by default ``[^\\x20\\x09-\\x0D]+``.  Equal words have equal
    64-bit hashes wherever they stand."""
    raw = "\n".join(t if t is not None else "" for t in texts).encode("utf-8", "surrogatepass")
    buf = _LOWER[np.frombuffer(raw, np.uint8)]
    sp = space[buf]
    edge = np.diff(np.concatenate([[True], sp, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start) == 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, buf
    h = np.empty(len(start), np.uint64)
    step = 1 << 17                        # words: hashes are made in slices to bound the temporaries
    for i in range(0, len(start), step):
        s, e = start[i:i + step], end[i:i + step]
        part = buf[s[0]:e[-1]]
        p, inv = _powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * p[:len(part)], out=acc[1:])
        s0, e0 = s - s[0], e - s[0]
        h[i:i + step] = mix((acc[e0] - acc[s0]) * inv[s0] + (e0 - s0).astype(np.uint64) * MULT[7])
    lens = np.fromiter((len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lens + 1)])
    return h, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, first))), start, end, buf


def _order(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """An order by ``of`` (below ``n``), then ``h``: by one number that holds the
    upper bits of ``h``, by both where these don't tell."""
    bits = int(n).bit_length()
    order = np.argsort(of.astype(np.uint64) << _U(64 - bits) | h >> _U(bits))
    a, b = h[order], of[order]
    return np.lexsort((h, of)) if ((b[1:] == b[:-1]) & (a[1:] < a[:-1])).any() else order


def shingle_sets(texts: list, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every text (fewer words: the whole sequence
    as one): (text index, hash), sorted by both."""
    h, doc, _, _, _ = words_of(texts)
    if len(h) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    ind = np.arange(len(h)) - first[doc]
    full = ind + k <= n[doc]
    at = np.flatnonzero(full)
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        acc += h[at + j] * MULT[j % 7] * _U(2 * (j // 7) + 1)
    sh, sd = mix(acc), doc[at]
    for d in np.flatnonzero((n > 0) & (n < k)):
        w = h[first[d]:first[d] + n[d]]
        v = np.sum(w * MULT[np.arange(len(w)) % 7] * (2 * (np.arange(len(w)) // 7) + 1).astype(np.uint64))
        sh, sd = np.append(sh, mix(np.array([v + _U(len(w))], np.uint64))), np.append(sd, d)
    order = _order(sd, sh, len(texts))
    sh, sd = sh[order], sd[order]
    keep = np.concatenate([[True], (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])])
    return sd[keep], sh[keep]


def slices(texts: list, limit: int = 1_000_000) -> list[slice]:
    """Cut a batch into runs of about ``limit`` characters (whole texts)."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            out.append(slice(start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")
