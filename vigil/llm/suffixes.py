"""Exact removal of passages that an earlier document holds, by a logarithmic
family of suffix arrays.

A byte goes if a string of 50 bytes around it also starts in a document of
smaller id.  Documents come in batches of ascending id.  Each batch gets a suffix
array: the starts of its strings in byte order.  It is merge-scanned against the
suffix arrays of the existing levels (strings of earlier batches) for common
prefixes of 50 bytes; equal strings inside the batch are neighbours in its own
array.  Then it becomes a level, and levels of equal size merge, so there are
never more than log2(batches) levels and a string is merged as often.

The arrays are dealt out by the minimiser of a string: the least fingerprint of
its 31 runs of 20 bytes.  Equal strings have equal minimisers, and neighbouring
strings mostly share one, so a document is cut into segments (about 17 strings in
66 bytes) and each goes to the bucket of its minimiser.  A string whose
minimiser stands in one document only is repeated nowhere: a first pass, which
moves five bytes a segment, finds the minimisers that stand in several, and only
their segments take part in what follows.  Fingerprints only deal out; strings
are compared by their bytes.

The documents are written once, bucketed by slice (some 4 MB of texts), so the
passes over the texts move no text; the segments and the family are bucketed by
their bucket, so a batch meets the levels where they lie.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import materialize, mix, release
from vigil.session import scratch_path

LENGTH = 50                     # bytes of a repeated string
GRAM = 20                       # bytes of a run whose fingerprint may be the minimiser
SLICE = 4_000_000               # bytes of the texts handled together
BUCKET = 8_000_000              # bytes of all texts for each bucket of the suffix arrays
BATCHES = 4
LONGEST = 64                    # strings of a segment at most
PIECE = 1 << 16                 # bytes whose fingerprints are held at once (they fit the cache; a long text has many pieces)

_U = np.uint64
_BITS = 40                      # of a fingerprint beside its bucket
_BYTE = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_ODD = {1 << i: _U(x) for i, x in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                             0xA0761D6478BD642F))}


# ------------------------------------------------------------ segments of texts

def minimisers(buf: np.ndarray) -> np.ndarray:
    """The minimiser of every LENGTH-byte string of ``buf``."""
    h, n = _BYTE[buf], 1
    while n < GRAM:                                    # two runs of n bytes, s apart, make one of n + s
        s = min(n, GRAM - n)
        h = h[:-s] * _ODD[n] + h[s:]
        n += s
    h, n, width = mix(h), 1, LENGTH - GRAM + 1
    while n < width:                                   # least of n neighbours, by doubling
        s = min(n, width - n)
        h = np.minimum(h[:-s], h[s:])
        n += s
    return h


def segments(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one minimiser: (text, first start, strings, key);
    the key is the bucket of the minimiser and 40 more bits of it."""
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for p in range(0, len(buf) - LENGTH + 1, PIECE):
        m = minimisers(buf[p:p + PIECE + LENGTH - 1])
        a = np.searchsorted(ends, p, "right")
        b = np.searchsorted(ends, p + len(m), "left") + 1
        inside = np.clip(ends[a:b], p, p + len(m)) - np.clip(ends[a:b] - lens[a:b], p, p + len(m))
        doc = np.repeat(np.arange(a, a + len(inside), dtype=np.int32), inside)
        at = np.arange(p, p + len(m))
        first = np.concatenate([[True], (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])])
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(m))
        d = doc[start]
        stop = np.minimum(stop, ends[d] - LENGTH + 1 - p)          # strings end within the text
        keep = stop > start
        start, stop, d = start[keep], stop[keep], d[keep]
        parts = -((start - stop) // LONGEST)
        if len(parts) and parts.max() > 1:
            which = np.repeat(np.arange(len(parts)), parts)
            step = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, stop, d = start[which] + step * LONGEST, stop[which], d[which]
            stop = np.minimum(stop, start + LONGEST)
        out.append((d, at[start] - (ends[d] - lens[d]), stop - start, m[start]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    doc, start, count, m = (np.concatenate(c) for c in zip(*out, strict=True))
    key = (m % _U(buckets)) << _U(_BITS) | (m // _U(buckets)) & _U((1 << _BITS) - 1)
    return doc, start, count, key


def _five(values: np.ndarray) -> bytes:
    """The low five bytes of every value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _by_bucket(key: np.ndarray):
    """(bucket, part) of the runs of sorted keys."""
    at = np.flatnonzero(np.diff(key >> _U(_BITS), prepend=_U((1 << 64) - 1)))
    for a, b in zip(at, np.append(at[1:], len(key))[:len(at)], strict=True):
        yield int(key[a] >> _U(_BITS)), slice(a, b)


# --------------------------------------------------------------- suffix arrays

class Suffixes:
    """A suffix array: a heap of text and the starts of distinct LENGTH-byte
    strings in it, in byte order."""

    def __init__(self, heap: np.ndarray, order: np.ndarray):
        self.heap, self.order = heap, order

    def strings(self) -> np.ndarray:
        return strings(self.heap, self.order)

    def holds(self, wanted: np.ndarray) -> np.ndarray:
        """Which of the sorted strings ``wanted`` it holds: one scan of both."""
        mine = self.strings()
        if not len(mine):
            return np.zeros(len(wanted), bool)
        return mine[np.minimum(np.searchsorted(mine, wanted), len(mine) - 1)] == wanted

    @staticmethod
    def merged(parts: list[Suffixes]) -> Suffixes:
        """One array of the strings of all; a string held twice keeps one place."""
        heap = np.concatenate([p.heap for p in parts])
        shift = np.cumsum([0, *(len(p.heap) for p in parts)])
        order = np.concatenate([p.order + s for p, s in zip(parts, shift, strict=False)])
        s = strings(heap, order)
        by = np.argsort(s, kind="stable")              # a merge sort: the parts are sorted runs
        s = s[by]
        return Suffixes(heap, order[by][np.append(True, s[1:] != s[:-1])[:len(s)]])


def strings(heap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The LENGTH-byte strings at ``starts``; they compare byte by byte."""
    if not len(starts):
        return np.zeros(0, f"S{LENGTH}")
    return np.lib.stride_tricks.sliding_window_view(heap, LENGTH)[starts].view(f"S{LENGTH}").ravel()


def scan(heap: np.ndarray, count: np.ndarray, doc_id: np.ndarray, levels: list[Suffixes]):
    """A batch's segments (``count`` strings each, texts joined in ``heap``)
    against the levels and each other: (segment and offset of every string that
    an earlier batch or a document of smaller id holds, suffix array of the batch)."""
    where = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    seg = np.repeat(np.arange(len(count)), count)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start = where[seg] + off
    s = strings(heap, start)
    order = np.argsort(s, kind="stable")
    s = s[order]
    new = np.append(True, s[1:] != s[:-1])[:len(s)]
    at = np.flatnonzero(new)
    distinct, group = s[at], np.cumsum(new) - 1
    ids = doc_id[seg[order]]
    least = np.minimum.reduceat(ids, at) if len(at) else ids
    known = np.zeros(len(at), bool)
    for level in levels:
        known |= level.holds(distinct)
    hit = order[known[group] | (ids > least[group])]
    fresh = start[order[at[~known]]]
    return seg[hit], off[hit], Suffixes(heap, fresh)


def _trimmed(a: Suffixes, count: np.ndarray) -> Suffixes:
    """Only the segments of the heap that a start of the array lies in."""
    width = count + LENGTH - 1
    where = np.cumsum(width) - width
    seg = np.searchsorted(where, a.order, "right") - 1
    used = np.zeros(len(count), bool)
    used[seg] = True
    moved = np.cumsum(np.where(used, width, 0)) - np.where(used, width, 0)
    return Suffixes(a.heap[np.repeat(used, width)], a.order - where[seg] + moved[seg])


# ------------------------------------------------------------------- the passes

class Tables:
    """Tables in the shared folder, each bucketed by one column, so that what is grouped by it stays where it lies."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names, self.paths = spark, [], {}

    def write(self, df: DataFrame, kind: str, key: str, files: int, parts: tuple[str, ...] = (), name: str | None = None) -> str:
        """Make a table, or append to the table ``name``."""
        if name is None:
            name = f"{kind}_{uuid.uuid4().hex}"
            self.names.append(name)
            self.paths[name] = scratch_path(self.spark, name)
        w = df.write.mode("append").option("path", self.paths[name]).option("compression", "zstd").bucketBy(files, key)
        (w.partitionBy(*parts) if parts else w).saveAsTable(name)
        return name

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _files(spark: SparkSession, groups: int) -> int:
    """Files of a table whose groups are some 4 MB each."""
    return min(groups, max(math.ceil(groups / 4), int(spark.conf.get("spark.sql.shuffle.partitions"))), 50_000)


def sliced(docs: DataFrame, doc_id: str, text: str, slices: int) -> DataFrame:
    """uid, doc_id, has_id, raw, slice of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"),
                       F.col(doc_id).isNotNull().alias("has_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    return rows.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(slices)))


def shared_minimisers(docs: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, vals): the minimisers of a slice that stand in several documents."""
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, _, _, key = segments(list(pdf["raw"]), buckets)
        order = np.lexsort((doc, key))
        doc, key = doc[order], key[order]
        new = np.append(True, key[1:] != key[:-1])[:len(key)]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(key))[:len(at)] - 1
        key, several = key[at], doc[at] != doc[last]
        return pd.DataFrame([(b, pdf["slice"].iloc[0], _five(key[p]), np.packbits(several[p]).tobytes())
                             for b, p in _by_bucket(key)], columns=["bucket", "slice", "vals", "several"])

    def common(pdf: pd.DataFrame) -> pd.DataFrame:
        vals = [_from_five(v) for v in pdf["vals"]]
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(v))
                                  for s, v in zip(pdf["several"], vals, strict=True)]).astype(bool)
        row = np.repeat(np.arange(len(vals)), [len(v) for v in vals])
        vals = np.concatenate(vals)
        order = np.argsort(vals, kind="stable")
        v = vals[order]
        new = np.append(True, v[1:] != v[:-1])[:len(v)]
        at = np.flatnonzero(new)
        more = np.logical_or.reduceat(several[order], at) | (np.diff(np.append(at, len(v))) > 1)
        keep = order[more[np.cumsum(new) - 1]]
        keep.sort()                                    # rows and, within them, values in order again
        cut = np.searchsorted(row[keep], np.arange(len(pdf) + 1))
        return pd.DataFrame([(s, pdf["bucket"].iloc[0], _five(vals[keep[cut[i]:cut[i + 1]]]))
                             for i, s in enumerate(pdf["slice"]) if cut[i] < cut[i + 1]], columns=["slice", "bucket", "vals"])

    found = docs.groupBy("slice").applyInPandas(own, "bucket int, slice long, vals binary, several binary")
    return found.groupBy("bucket").applyInPandas(common, "slice long, bucket int, vals binary")


_SEGMENTS = "batch int, bucket int, slice long, doc binary, doc_id binary, start binary, count binary, heap binary"


def suspects(docs: DataFrame, shared: DataFrame, buckets: int, bounds: list[int]) -> DataFrame:
    """Segments with a shared minimiser, packed by (batch, bucket, slice); a batch
    holds the ids up to its bound, ``doc`` is the place of a document in its slice by uid."""
    def cut(_, pdf: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(mine):
            pdf = pdf.sort_values("uid")
            texts = [raw if known else b"" for raw, known in zip(pdf["raw"], pdf["has_id"], strict=True)]
            doc, start, count, key = segments(texts, buckets)
            wanted = np.sort(np.concatenate([_from_five(v) | _U(b) << _U(_BITS)
                                             for v, b in zip(mine["vals"], mine["bucket"], strict=True)]))
            here = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
            doc, start, count, key = doc[here], start[here], count[here], key[here]
            ids = pdf["doc_id"].to_numpy(np.int64)
            batch = np.searchsorted(np.array(bounds, np.int64), ids, "left")[doc]
            order = np.lexsort((start, doc, key >> _U(_BITS), batch))
            part = (batch.astype(np.uint64) << _U(32) | key >> _U(_BITS))[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
            for a, b in zip(at, np.append(at[1:], len(part))[:len(at)], strict=True):
                o = order[a:b]
                heap = b"".join([texts[d][s:s + c + LENGTH - 1] for d, s, c in
                                 zip(doc[o].tolist(), start[o].tolist(), count[o].tolist(), strict=True)])
                out.append((int(batch[o[0]]), int(key[o[0]] >> _U(_BITS)), pdf["slice"].iloc[0], doc[o].astype(np.uint32).tobytes(),
                            ids[doc[o]].tobytes(), start[o].astype(np.uint32).tobytes(), count[o].astype(np.uint8).tobytes(), heap))
        return pd.DataFrame(out, columns=["batch", "bucket", "slice", "doc", "doc_id", "start", "count", "heap"])

    return docs.groupBy("slice").cogroup(shared.groupBy("slice")).applyInPandas(cut, _SEGMENTS)


class Family:
    """The levels, and the repeated spans found so far, as one table bucketed by bucket.

    Rows are (batch that wrote them, level or not, bucket): a level's row has its heap
    (a) and order (b), a span row, of one slice, the documents (a), starts (b) and ends (c)."""

    _ROWS = "batch int, level boolean, bucket int, slice long, a binary, b binary, c binary"

    def __init__(self, tables: Tables, files: int):
        self.tables, self.files, self.levels = tables, files, []      # levels: (size in batches, batch that wrote it)
        self.name = tables.write(tables.spark.createDataFrame([], self._ROWS), "family", "bucket", files, ("batch", "level"))

    def rows(self) -> DataFrame:
        return self.tables.spark.table(self.name)

    def add(self, number: int, batch: DataFrame, keep: bool = True) -> None:
        """Scan a batch of segments against the levels and itself, write its
        repeated spans and, unless ``keep`` is False, its level: merged with the
        levels of its size as long as there is one."""
        size, merge = 1, []
        while keep and (same := [b for s, b in self.levels if s == size]):
            merge.append(same[0])
            size *= 2

        def step(_, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            arrays = {int(n): Suffixes(np.frombuffer(h, np.uint8), np.frombuffer(o, np.uint32).astype(np.int64))
                      for n, h, o in zip(old["batch"], old["a"], old["b"], strict=True)}
            bucket = int((new if len(new) else old)["bucket"].iloc[0])
            out, own = [], []
            if len(new):
                blobs = lambda c, t: [np.frombuffer(x, t) for x in new[c]]
                counts = blobs("count", np.uint8)
                row = np.repeat(np.arange(len(new)), [len(c) for c in counts])
                count = np.concatenate(counts).astype(np.int64)
                doc, first = (np.concatenate(blobs(c, np.uint32)).astype(np.int64) for c in ("doc", "start"))
                seg, off, fresh = scan(np.frombuffer(b"".join(new["heap"]), np.uint8), count,
                                       np.concatenate(blobs("doc_id", np.int64)), list(arrays.values()))
                at = first[seg] + off
                order = np.lexsort((at, doc[seg], row[seg]))
                seg, at = seg[order], at[order]
                d, r = doc[seg], row[seg]
                begin = np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (at[1:] > at[:-1] + 1))[:len(at)]
                a = np.flatnonzero(begin)
                stop = at[np.append(a[1:], len(at)) - 1] + LENGTH if len(a) else at
                cut = np.searchsorted(r[a], np.arange(len(new) + 1))
                pack = lambda x: x.astype(np.uint32).tobytes()
                out = [(number, False, bucket, s, pack(d[a[i:j]]), pack(at[a[i:j]]), pack(stop[i:j]))
                       for s, i, j in zip(new["slice"], cut[:-1], cut[1:], strict=True) if i < j]
                own = [_trimmed(fresh, count)]
            own += [arrays[n] for n in merge if n in arrays]
            if keep and own:
                whole = Suffixes.merged(own)
                out.append((number, True, bucket, -1, whole.heap.tobytes(), whole.order.astype(np.uint32).tobytes(), b""))
            return pd.DataFrame(out, columns=["batch", "level", "bucket", "slice", "a", "b", "c"])

        old = self.rows().where(F.col("level") & F.col("batch").isin([b for _, b in self.levels]))
        done = batch.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(step, self._ROWS)
        self.tables.write(done, "family", "bucket", self.files, ("batch", "level"), self.name)
        if keep:
            self.levels = [x for x in self.levels if x[1] not in merge] + [(size, number)]

    def spans(self) -> DataFrame:
        """slice, doc, start, stop: packed, overlapping where minimisers change."""
        return self.rows().where(~F.col("level")).select("slice", F.col("a").alias("doc"), F.col("b").alias("start"), F.col("c").alias("stop"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES,
                   shape=lambda rows: rows) -> DataFrame:
    """Every row of ``docs`` with what is left of it: doc_id, n_bytes, starts and
    ends (arrays: the removed runs of bytes, in order), kept (binary: the rest, joined).
    The result is written once; ``shape`` chooses what of it.

    Strings are judged on the input.  A null or short text loses nothing; rows
    that share an id do not count against each other; rows without an id lose
    nothing and are no earlier document.  Bytes are those of UTF-8, so a run may
    begin or end within a character.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    slices, buckets = (max(1, math.ceil(size / s)) for s in (SLICE, BUCKET))
    tables = Tables(spark)
    try:
        files = _files(spark, slices)
        rows = spark.table(tables.write(sliced(docs, doc_id, text, slices).repartition(files, "slice"), "slices", "slice", files))
        release(spark)
        bounds = sorted({int(x) for x in rows.where("has_id").approxQuantile(
            "doc_id", [i / batches for i in range(1, batches)], 0.001)}) if batches > 1 and size else []
        shared = materialize(shared_minimisers(rows, buckets), "shared-minimisers")
        release(spark)
        files = _files(spark, buckets)
        found = spark.table(tables.write(suspects(rows, shared, buckets, bounds).repartition(files, "bucket"), "segments",
                                         "bucket", files, ("batch",)))
        release(spark)
        family = Family(tables, files)
        for b in range(len(bounds) + 1):
            family.add(b, found.where(F.col("batch") == b), keep=b < len(bounds))

        def rest(_, pdf: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
            doc, a, b = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.uint32) for x in gone[c])]).astype(np.int64)
                         for c in ("doc", "start", "stop"))
            order = np.lexsort((a, doc))
            doc, a, b = doc[order], a[order], b[order]
            pdf = pdf.sort_values("uid")
            cut = np.searchsorted(doc, np.arange(len(pdf) + 1))
            out = []
            for n, (i, known, raw) in enumerate(zip(pdf["doc_id"], pdf["has_id"], pdf["raw"], strict=True)):
                s, e = a[cut[n]:cut[n + 1]], np.maximum.accumulate(b[cut[n]:cut[n + 1]])
                new = np.append(True, s[1:] > e[:-1])[:len(s)]
                s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(e)) - 1] if len(e) else e
                kept = raw if not len(s) else b"".join(raw[p:q] for p, q in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                out.append((i, known, len(raw), s, e, kept))
            return pd.DataFrame(out, columns=["doc_id", "has_id", "n_bytes", "starts", "ends", "kept"])

        done = rows.groupBy("slice").cogroup(family.spans().groupBy("slice")).applyInPandas(
            rest, "doc_id long, has_id boolean, n_bytes long, starts array<long>, ends array<long>, kept binary")
        done = done.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", "starts", "ends", "kept")
        return materialize(shape(done), "without-repeats")
    finally:
        tables.close()
