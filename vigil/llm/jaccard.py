"""Exact n-gram Jaccard join by universe partition and pigeonhole (operator 10).

A text is the set of its distinct 5-word shingles; texts link at Jaccard 0.75
or more.  Two linked sets of a and b shingles differ in at most (a + b) / 7.

* Copies of one set are one node (a 64-bit key of the set), so only different
  texts meet in the join.
* Nodes fall into size bands; a zone is one band, or the border of two
  neighbouring bands.  In each zone the shingle universe is hashed into m
  segments and two linked sets must agree on some segments.
* Allocation by cost, per zone: plan A indexes whole segments (threshold 0).
  m is half the largest set (all of it in small bands), and each set emits its H + 1 first
  segments in one global order (those with the most rare shingles first, those
  made of frequent shingles only after them, empty ones last): two sets with
  distance <= H agree on at least m - H segments, so these prefixes meet.  A set
  with few rare segments emits their one-deletion neighbourhoods instead of
  frequent segments, which many unrelated texts share.
  Plan B indexes m = H / 2 + 1 segments with their one-deletion
  neighbourhoods (threshold 1 each): less than one segment could differ by two
  or more everywhere.  Empty signatures are emitted only by sets whose other
  segments can't prove the match.  Zones of many frequent shingles take B.
* Members of equal signatures are starred within sorted runs.  Candidate pairs
  pass a bound from binned set sketches and are verified exactly on the texts;
  verified links form components.
  Where a signature's members are then still in different components, those
  outside the largest meet a few drawn members, and what is still apart all
  members of other components, verified too: no link is lost while a group of
  copies never expands into all its pairs.  Members of signatures of WIDE nodes
  or more meet in blocks inside tasks; only pairs that their sketches leave
  possible become rows.

Defined results: null, empty and blank texts have no shingles, link with
nothing and are their own component; rows without an id have a null
component and link with nothing; repeated rows return one row each; an empty
table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import MULT, components, cut, give_back, materialize, mix, release, shingle_sets, slices

K = 5
EDGES = (1, 4, 8, 16, 32, 64, 512, 4096, 32768, 1 << 18, 1 << 24, 1 << 31)   # lower ends of the size bands
FREQUENT = 0.001      # share of nodes from which a shingle is frequent
LEADS = 8             # members of a mixed signature that those outside its largest component meet first
WIDE = 8              # nodes from which a mixed signature's members meet in blocks, not as rows
BLOCK, BLOCK_MASS = 1024, 1 << 25     # members and shingles of a side of a block, about
PAIRS = 1 << 19       # pairs of a block held at once
CARRIED = 8           # signatures of a node that a member carries
HOT_PENALTY = 20.0    # cost of an index entry made of frequent shingles, in plain entries
SCHEMA = "doc_id long, n long, k1 long, sketch binary, hot array<struct<h:long,c:long>>"
SLICE = 1_000_000     # bytes of text whose shingles are held at once
_BYTES = np.uint64(0x00FF00FF00FF00FF)
SMALL = 1_000_000     # node ids (16 bytes each) that may be broadcast; more are shuffled


def _band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(EDGES), n, side="right") - 1


def set_keys(doc: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, key) of every text's shingle set."""
    n = np.bincount(doc, minlength=n_texts)
    k1 = np.zeros(n_texts, np.uint64)
    if len(doc):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        k1[doc[first]] = mix(np.add.reduceat(mix(h ^ MULT[0]), first) + n[doc[first]].astype(np.uint64))
    return n, k1


def sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> list:
    """Per text, how many shingles fall into each of 2^k bins (at least half as
    many bins as shingles), capped at 255.  Sums of bin-wise minima bound
    intersections from above."""
    out: list = [None] * len(n)
    start = np.concatenate([[0], np.cumsum(n)])
    x = mix(h + MULT[5])
    for i in np.flatnonzero(n):
        bins = 1 << max(4, int(n[i] - 1).bit_length() - 1)
        c = np.bincount((x[start[i]:start[i + 1]] & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        out[i] = np.minimum(c, 255).astype(np.uint8).tobytes()
    return out


def sketch_bound(a: bytes, b: bytes) -> int:
    """An upper bound of the intersection of two sets from their sketches (255
    means any number)."""
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    if (x == 255).any() or (y == 255).any():
        return 1 << 40
    while len(x) > len(y):
        x = x[:len(x) // 2] + x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] + y[len(y) // 2:]
    return int(np.minimum(x, y).sum())


def often(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, count) of the values that stand ``least`` times or more; sorts
    ``values`` in place."""
    values.sort()
    ids = np.unique(values[:max(0, len(values) - least + 1)][values[:max(0, len(values) - least + 1)] == values[least - 1:]])
    return ids, np.searchsorted(values, ids, "right") - np.searchsorted(values, ids, "left")


def sets_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document with its set size and key; the first row of a batch
    also carries the shingles frequent in it (counted over different sets)."""
    def run(batches):
        for b in batches:
            size, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            seen: set = set()
            parts, sketch = [np.zeros(0, np.uint64)], []
            for some in cut(b, 1, SLICE):
                texts = some.column(1).to_pylist()
                doc, h = shingle_sets(texts, K)
                n, k1 = set_keys(doc, h, len(texts))
                sketch.extend(sketches(doc, h, n))
                size.append(n)
                keys.append(k1)
                new = np.array([n[i] > 0 and k not in seen and not seen.add(k) for i, k in enumerate(k1.tolist())], bool)
                parts.append(h[new[doc]] if len(doc) else h)
            every = np.concatenate(parts)
            parts.clear()
            ids, count = often(every, max(4, math.ceil(FREQUENT / 2 * len(seen))))
            hot = pa.ListArray.from_arrays(
                pa.array([0, *[len(ids)] * b.num_rows], pa.int32()),
                pa.StructArray.from_arrays([pa.array(ids.view(np.int64)), pa.array(count)], ["h", "c"]),
                mask=pa.array(np.arange(b.num_rows) > 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(size)), pa.array(np.concatenate(keys).view(np.int64)),
                 pa.array(sketch, pa.binary()), hot],
                names=["doc_id", "n", "k1", "sketch", "hot"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)


def frequent(sets: DataFrame, n_nodes: int) -> np.ndarray:
    """Sorted hashes of the frequent shingles.  At most (mean set size /
    FREQUENT, doubled) shingles can be in half that share of the sets, however
    many sets; batches count them only from a few up, hence the half."""
    hot = (sets.where("hot IS NOT NULL").select(F.explode("hot").alias("x")).groupBy("x.h").agg(F.sum("x.c").alias("c"))
           .where(F.col("c") >= max(8, FREQUENT / 2 * n_nodes)).select("h").toPandas())
    return np.sort(hot["h"].to_numpy(np.int64).view(np.uint64))


class Zones:
    """Segment counts and plans of every zone: 2 * band, or 2 * band + 1 for
    the border of a band and the next."""

    def __init__(self, stats: dict | None = None, force: str | None = None):
        n = 2 * len(EDGES)
        self.m = np.ones(n, np.int64)
        self.deletions = np.zeros(n, bool)
        for z in range(n):
            upper = EDGES[min(z // 2 + 1, len(EDGES) - 1)] - 1
            low = EDGES[z // 2]
            most, least = (upper, low) if z % 2 == 0 else (4 * (upper + 1) // 3, 3 * (upper + 1) // 4)
            h = 2 * most // 7 if z % 2 == 0 else (upper + most) // 7
            m_a, m_b = (max(2, most) if most <= 64 else -(-most // 2)), h // 2 + 1
            count, size, hot = (stats or {}).get(z // 2, (1, (least + most) / 2, 0.0))
            need = 2 * size / 7 + 1
            rare = m_a * (1 - np.exp(-size * (1 - hot) / m_a))
            cost_a = need * (1 + HOT_PENALTY * max(0.0, 1 - rare / need))
            cost_b = (m_b + size) * (1 + HOT_PENALTY * hot ** max(1.0, size / m_b))
            use_b = cost_b < cost_a if force is None else force == "B"
            # a segment must hold a few shingles for its neighbourhoods to tell anything
            self.deletions[z] = use_b and least >= 2 * m_b
            self.m[z] = m_b if self.deletions[z] else m_a


def _emit(doc, h, n, hot, zone, limit, zones):
    """Signatures of the texts of one role: (signature, text index).  ``zone``
    and ``limit`` (the largest distance H) per text, zone -1: takes no part."""
    take = zone[doc] >= 0
    doc, h = doc[take], h[take]
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    z = zone[doc]
    seed = mix(np.arange(len(zones.m), dtype=np.uint64) + MULT[2])
    m = zones.m[z].astype(np.uint64)
    seg = ((mix(h + seed[z]) >> np.uint64(32)) * m >> np.uint64(32)).astype(np.int64)
    order = np.argsort(doc.astype(np.uint64) << np.uint64(32) | seg.astype(np.uint64))
    doc, h, seg, z = doc[order], h[order], seg[order], z[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(seg, prepend=-1))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    val = mix(h ^ MULT[3])
    total = np.add.reduceat(val, first)
    size = np.diff(np.append(first, len(doc)))
    sdoc, sz = doc[first], z[first]
    place = mix(seed[sz] + seg[first].astype(np.uint64) * MULT[4])
    wide = zones.deletions[sz]
    often = hot_of(h, hot) if len(hot) else np.zeros(len(h), bool)
    n_rare = np.add.reduceat((~often).astype(np.int64), first)
    rare = np.minimum(n_rare, 4)
    out_s, out_d = [], []

    # plan A: the first H + 1 segments of the global order.  A set with fewer
    # segments that hold a rare shingle adds their one-deletion neighbourhoods,
    # as far as something rare remains: where neither finds a match, a segment
    # with two rare shingles or more differs by two, one with one by one, so
    # frequent segments are needed only where that sums up to H or less.
    a = np.flatnonzero(~wide)
    if len(a):
        with_rare, with_two = (np.bincount(sdoc[a], weights=n_rare[a] >= k, minlength=len(n)) for k in (1, 2))
        poor = with_rare <= limit
        covered = poor & (with_rare + with_two >= limit + 1)
        e = np.flatnonzero(poor[doc] & ~wide[of] & (n_rare[of] >= np.where(often, 1, 2)))
        out_s.append(mix(total[of[e]] - val[e] + place[of[e]]))
        out_d.append(doc[e])
        sig = mix(total[a] + place[a])
        o = np.lexsort((sig, -rare[a], sdoc[a]))
        sig, d = sig[o], sdoc[a][o]
        start = np.flatnonzero(np.diff(d, prepend=-1))
        have = np.diff(np.append(start, len(d)))
        rank = np.arange(len(d)) - np.repeat(start, have)
        keep = (rank <= limit[d]) & ((rare[a][o] > 0) | ~covered[d])
        out_s.append(sig[keep])
        out_d.append(d[keep])
        for i in np.flatnonzero((have <= limit[d[start]]) & ~covered[d[start]]):     # the order goes on with empty segments
            t = d[start[i]]
            zt = zone[t]
            empty = np.setdiff1d(np.arange(zones.m[zt]), seg[slice(*np.searchsorted(doc, [t, t + 1]))])
            s = np.sort(mix(mix(seed[zt] + empty.astype(np.uint64) * MULT[4])))[:limit[t] + 1 - have[i]]
            out_s.append(s)
            out_d.append(np.full(len(s), t))

    # plan B: every segment and its one-deletion neighbourhood
    b = np.flatnonzero(wide)
    if len(b):
        out_s.append(mix(total[b] + place[b]))
        out_d.append(sdoc[b])
        e = np.flatnonzero(wide[of] & (size[of] > 1))
        out_s.append(mix(total[of[e]] - val[e] + place[of[e]]))
        out_d.append(doc[e])
        wide_docs, at_b = np.unique(sdoc[b], return_index=True)
        for t, mine in zip(wide_docs, np.split(b, at_b[1:]), strict=True):
            zt = zone[t]
            used, one = seg[first[mine]], seg[first[mine[size[mine] == 1]]]
            empty = np.setdiff1d(np.arange(zones.m[zt]), used)
            if 2 * zones.m[zt] - limit[t] - 2 * (len(empty) + len(one)) < 1:
                at = np.concatenate([empty, one])
                out_s.append(mix(mix(seed[zt] + at.astype(np.uint64) * MULT[4])))
                out_d.append(np.full(len(at), t))
    return np.concatenate(out_s), np.concatenate(out_d)


def hot_of(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.searchsorted(hot, h)
    at[at == len(hot)] = 0
    return hot[at] == h


def signatures(texts: list, hot: np.ndarray, zones: Zones, seen: set) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node key) index entries of a run of texts, copies once."""
    doc, h = shingle_sets(texts, K)
    n, k1 = set_keys(doc, h, len(texts))
    fresh = np.array([n[i] > 0 and k not in seen and not seen.add(k) for i, k in enumerate(k1.tolist())], bool)
    if not fresh.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edges = np.array(EDGES)
    band = _band(np.maximum(n, 1))
    low, up = edges[band], edges[np.minimum(band + 1, len(edges) - 1)]
    most = 4 * n // 3
    roles = [(np.where(fresh, 2 * band, -1), (n + np.minimum(up - 1, most)) // 7),
             (np.where(fresh & (most >= up), 2 * band + 1, -1), (n + most) // 7),
             (np.where(fresh & (band > 0) & (-(-3 * n // 4) <= low - 1), 2 * band - 1, -1), (n + low - 1) // 7)]
    sig, of = zip(*[_emit(doc, h, n, hot, zone, limit, zones) for zone, limit in roles], strict=True)
    return np.concatenate(sig), k1[np.concatenate(of)]


def index_entries(docs: DataFrame, text: str, hot: np.ndarray, zones: Zones) -> DataFrame:
    """Rows (sig, node) of all texts."""
    def run(batches):
        for b in batches:
            seen: set = set()
            for some in cut(b, 0, SLICE):
                sig, node = signatures(some.column(0).to_pylist(), hot, zones, seen)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node.view(np.int64))],
                                                 names=["sig", "node"])
        give_back()

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "sig long, node long")


def runs(entries: DataFrame) -> DataFrame:
    """Entries whose signature has two nodes or more: (sig, node, lead), lead
    the first node of the signature's sorted run (null: the node itself).
    Streams over sorted rows, so a run of any length takes no memory."""
    def star(batches):
        last_s = last_x = lead = None
        alone = False                                   # the run carried over has one node so far
        for b in batches:
            s, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(s):
                continue
            keep = np.concatenate([[last_s is None or s[0] != last_s or x[0] != last_x], (s[1:] != s[:-1]) | (x[1:] != x[:-1])])
            s, x = s[keep], x[keep]
            if not len(s):
                continue
            new = np.concatenate([[last_s is None or s[0] != last_s], s[1:] != s[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
            leads = np.where(at >= 0, x[at], 0 if lead is None else lead)
            i = np.flatnonzero(~new)
            j = i[(i > 0) & new[np.maximum(i - 1, 0)]] - 1          # first nodes whose run goes on
            carried = not new[0] and alone
            sig = np.concatenate([s[:1] if carried else s[:0], s[j], s[i]])
            node = np.concatenate([leads[:1] if carried else x[:0], x[j], x[i]])
            own = np.arange(len(sig)) < len(sig) - len(i)
            out = pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(
                np.concatenate([np.zeros(len(sig) - len(i), np.int64), leads[i]]), mask=own)], names=["sig", "node", "lead"])
            last_s, last_x, lead, alone = s[-1], x[-1], leads[-1], bool(new[-1])
            yield out

    return (entries.repartition("sig").sortWithinPartitions("sig", "node")
            .mapInArrow(star, "sig long, node long, lead long"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, compared exactly on their texts."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ta, tb = batch.column(2), batch.column(3)
            link = np.zeros(len(a), bool)
            step, i = 256, 0
            while i < len(a):
                j = min(len(a), i + step)
                ids: dict = {}
                body = []
                for k, col in ((a, ta), (b, tb)):
                    for r in range(i, j):
                        if k[r] not in ids:
                            ids[k[r]] = len(body)
                            body.append(col[r].as_py())
                sets = {}
                for part in slices(body):
                    doc, h = shingle_sets(body[part], K)
                    bounds = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
                    for t in range(part.start, part.stop):
                        sets[t] = h[bounds[t - part.start]:bounds[t - part.start + 1]]
                for r in range(i, j):
                    x, y = sets[ids[a[r]]], sets[ids[b[r]]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    link[r] = both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(a[link]), pa.array(b[link])], names=["a", "b"])
        give_back()

    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""
    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = [7 * sketch_bound(x.as_py(), y.as_py()) >= 3 * int(m)
                  for x, y, m in zip(batch.column(3), batch.column(5), na + nb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = {k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab"}
    both = (pairs.join(side["a"], "a").join(side["b"], "b")
            .where(F.least("na", "nb") * 4 >= F.greatest("na", "nb") * 3))
    return both.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def links_of(left: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of nodes among the possible ones ``left`` that link, by their texts."""
    wanted = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(
        nodes.select("node", "rep"), "node").select("node", F.col("rep").alias("doc_id")), "jaccard-wanted")
    # the ids are broadcast below SMALL, else hashed a partition at a time: texts are never sorted
    few = wanted.count() <= SMALL
    found = rows.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "doc_id")
    texts = materialize(_own_text(found), "jaccard-texts", 8)
    return materialize(verified(left, texts), "jaccard-links", 8)


def mixed(members: DataFrame, comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members (sig, node) of signatures whose nodes are in different
    components: with their component, whether it is not the signature's largest
    (``out``), their set size, and the count, set sizes and ``out`` members of
    the signature."""
    own = nodes.select("node", F.col("n").alias("size")).join(comp, "node", "left").select(
        "node", "size", F.coalesce("component", "node").alias("c"))
    own = F.broadcast(own) if nodes.count() <= SMALL else own
    sig, each = Window.partitionBy("sig"), Window.partitionBy("sig", "c")
    # dealt by signature once, which serves both windows
    tagged = (members.join(own, "node").repartition("sig").withColumn("k", F.count("*").over(each))
              .withColumn("main", F.max(F.struct("k", "c")).over(sig)["c"])
              .withColumn("out", F.col("c") != F.col("main"))
              .withColumn("n", F.count("*").over(sig)).withColumn("mass", F.sum("size").over(sig))
              .withColumn("n_out", F.sum(F.col("out").cast("long")).over(sig)))
    return materialize(tagged.where("n_out > 0").select("sig", "node", "c", "out", "size", "n", "mass", "n_out"), "jaccard-mixed")


def apart(mix: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share a signature of fewer than WIDE nodes but
    no component, one of them outside the signature's largest."""
    each = mix.where(F.col("n") < WIDE).groupBy("sig").agg(F.collect_list(F.struct("node", "c", "out")).alias("m"))
    pairs = F.flatten(F.transform(F.filter("m", lambda x: x["out"]), lambda x: F.transform(
        F.filter("m", lambda y: y["c"] != x["c"]),
        lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))))
    return each.select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.a", "p.b").distinct()


def _numbered(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (of ``n``) in x or y, and the places of x and of y among them."""
    held = np.zeros(n, bool)
    held[x] = held[y] = True
    at = np.cumsum(held) - 1
    return np.flatnonzero(held), at[x], at[y]


def bounded(x: np.ndarray, y: np.ndarray, size: np.ndarray, sketch: list) -> np.ndarray:
    """Which pairs (x, y) of rows their sketches leave possible: ``possible`` for many pairs of few sets."""
    bins = np.array([len(v) for v in sketch])
    width, ok = np.minimum(bins[x], bins[y]), np.zeros(len(x), bool)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        step = max(1, (1 << 22) // int(w))
        for i in range(0, len(at), step):
            part = at[i:i + step]
            used, j, k = _numbered(x[part], y[part], len(sketch))
            raw = [np.frombuffer(sketch[r], np.uint8) for r in used]
            full = np.array([v.max() == 255 for v in raw])                    # counts that may be any number
            m = np.stack([v if len(v) == w else v.reshape(-1, w).sum(0, dtype=np.uint32) for v in raw])
            if m.max() < 256:
                m = m.astype(np.uint8)
            least = np.minimum(m[j], m[k])
            if m.dtype == np.uint8 and w <= 1024:            # four sums of 16 bits side by side in a word
                least = least.view(np.uint64)
                least = ((least & _BYTES) + (least >> np.uint64(8) & _BYTES)).sum(1).view(np.uint16).reshape(-1, 4)
            both = least.sum(1, dtype=np.int64)
            ok[part] = full[j] | full[k] | (7 * both >= 3 * (size[x[part]] + size[y[part]]))
    return ok


def met(mix: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """The possible pairs (a, b) of nodes that share a signature of WIDE nodes
    or more but no component, one of them outside the signature's largest, the
    other any member or (``few``) one of about LEADS drawn by hash.  Members
    meet in blocks inside tasks, so pairs that sketches rule out are never rows;
    a pair of several signatures is told by the first that both carry."""
    wide = mix.where(F.col("n") >= WIDE)
    # each node's first signatures, enough to tell most pairs once
    first = wide.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, CARRIED).alias("sigs"))
    none = F.expr("CAST(array() AS array<long>)")
    many = wide.join(nodes.select("node", "sketch", none.alias("sigs")) if few else
                     nodes.select("node", "sketch").join(first, "node"), "node")

    def blocks(count):
        return F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(F.col("mass") / F.lit(BLOCK_MASS))).cast("int")

    y_n = F.lit(1) if few else blocks(F.col("n"))
    x_n = blocks(F.col("n_out"))
    drawn = F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53) < F.lit(LEADS) / F.col("n") if few else F.lit(True)
    cell = {k: F.pmod(F.xxhash64("node", F.lit(k)), v).cast("int") for k, v in (("i", x_n), ("j", y_n))}
    every = {k: F.explode(F.sequence(F.lit(0), v - 1)) for k, v in (("i", x_n), ("j", y_n))}
    body = ["node", "c", "out", "size", "sketch", "sigs"]
    one = (x_n == 1) & (y_n == 1)                        # the only block: a member stands on both sides at once
    side = F.when(F.col("out") & drawn, 1).when(F.col("out"), 0).otherwise(2)
    zero = F.lit(0)
    alone = many.where(one & (F.col("out") | drawn)).select("sig", zero.alias("i"), zero.alias("j"), side.alias("side"), *body)
    xs = many.where(~one & F.col("out")).select("sig", cell["i"].alias("i"), every["j"].alias("j"), F.lit(0).alias("side"), *body)
    ys = many.where(~one & drawn).select("sig", every["i"].alias("i"), cell["j"].alias("j"), F.lit(2).alias("side"), *body)

    def tell(t: pa.Table):
        """The pairs of a table of whole blocks."""
        sig, i, j, side, node, c, out, size = (t.column(k).to_numpy() for k in range(8))
        start = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        total = np.diff(np.append(start, len(sig)))
        # a block's rows: first those of side x alone, then of both, then of y alone
        nx, alone = (np.add.reduceat((side <= k).astype(np.int64), start) for k in (1, 0))
        ny = total - alone
        pairs = nx * ny
        ends, a = np.cumsum(pairs), 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - pairs[a] + PAIRS, "right")))
            of = np.repeat(np.arange(a, b), pairs[a:b])
            pos = np.arange(len(of)) - np.repeat(ends[a:b] - pairs[a:b] - (ends[a] - pairs[a]), pairs[a:b])
            x = start[of] + pos // ny[of]
            y = start[of] + alone[of] + pos % ny[of]
            ok = (c[x] != c[y]) & (4 * np.minimum(size[x], size[y]) >= 3 * np.maximum(size[x], size[y]))
            if not few:
                ok &= ~out[y] | (node[x] < node[y])              # else met as (y, x)
            x, y, a = x[ok], y[ok], b
            if not len(x):
                continue
            used, p, q = _numbered(x, y, t.num_rows)
            ok = bounded(p, q, size[used], t.column(8).take(pa.array(used)).to_pylist())
            x, y, p, q = x[ok], y[ok], p[ok], q[ok]
            if not few:                                          # drawn members differ by signature
                sigs = [frozenset(v) for v in t.column(9).take(pa.array(used)).to_pylist()]
                new = np.array([min(sigs[i] & sigs[j], default=s) >= s for i, j, s in
                                zip(p.tolist(), q.tolist(), sig[x].tolist(), strict=True)], bool)
                x, y = x[new], y[new]
            x, y = node[x], node[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)])
            last = int(np.flatnonzero((key != key[:, -1:]).any(0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
            if last:
                yield from tell(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield from tell(rest)
        give_back()

    return (alone.unionByName(xs).unionByName(ys).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "side")
            .mapInArrow(run, "a long, b long").distinct())


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links: components of the graph whose
    nodes are the components so far."""
    over = {k: comp.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab"}
    joined = links.join(over["a"], "a", "left").join(over["b"], "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(joined, "jaccard-cc").select(F.col("node").alias("c"), F.col("component").alias("c2"))
    nodes = comp.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                             .join(comp.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return (nodes.withColumnRenamed("component", "c").join(new, "c", "left")
            .select("node", F.coalesce("c2", "c").alias("component")))


def cluster(docs: DataFrame, id_col: str = "doc_id", text: str = "text", force: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(sets_of(rows, "doc_id", "text"), "jaccard-sets", 16)
    nodes = materialize(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(F.col("k1").alias("node"))
                        .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "jaccard-nodes")
    band = sum((F.col("n") >= e).cast("int") for e in EDGES[1:])
    by_band = {r["b"]: (r["c"], r["s"]) for r in nodes.groupBy(band.alias("b")).agg(
        F.count("*").alias("c"), F.avg("n").alias("s")).collect()}
    hot = frequent(sets, sum(c for c, _ in by_band.values()))
    share = sets.where("hot IS NOT NULL").select(F.explode("hot").alias("x")).agg(F.sum("x.c")).first()[0] or 0
    shingles = sum(c * s for c, s in by_band.values())
    hot_share = min(0.95, share / shingles) if len(hot) and shingles else 0.0
    zones = Zones({b: (c, s, hot_share) for b, (c, s) in by_band.items()}, force)

    live = materialize(runs(index_entries(rows.where("doc_id IS NOT NULL"), "text", hot, zones)), "jaccard-runs", 8)
    release(docs.sparkSession)
    starred = live.where("lead IS NOT NULL").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    left = materialize(possible(starred, nodes), "jaccard-possible")
    release(docs.sparkSession)
    comp = materialize(components(links_of(left, nodes, rows), "jaccard-cc"), "jaccard-comp")
    release(docs.sparkSession)

    # signatures whose members are still in different components: in those of
    # few nodes all members of different components meet; in the others those
    # outside the largest component meet a few members drawn by hash first, which
    # joins nearly all that link at all, and then every member still apart
    mix = mixed(live.select("sig", "node"), comp, nodes)
    release(docs.sparkSession)
    near = possible(apart(mix).join(starred, ["a", "b"], "left_anti"), nodes)
    left = materialize(near.unionByName(met(mix, nodes, True)).distinct(), "jaccard-possible", 8)
    release(docs.sparkSession)
    comp = materialize(merged(comp, links_of(left, nodes, rows)), "jaccard-comp")
    mix = mixed(mix.where(F.col("n") >= WIDE).select("sig", "node"), comp, nodes)
    release(docs.sparkSession)
    left = materialize(met(mix, nodes, False).join(left, ["a", "b"], "left_anti"), "jaccard-possible", 8)
    comp = materialize(merged(comp, links_of(left, nodes, rows)), "jaccard-comp")
    release(docs.sparkSession)

    named = nodes.select("node", "rep").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.select("node", "c").join(least, "c").select(F.col("node").alias("k1"), "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"))
    return (out.join(named, "k1", "left")
            .select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def _own_text(found: DataFrame) -> DataFrame:
    """Rows whose text has the node's set (an id may stand on several texts), once."""
    def run(batches):
        for batch in batches:
            for b in cut(batch, 1, SLICE):
                body = b.column(1).to_pylist()
                _, k1 = set_keys(*shingle_sets(body, K), len(body))
                yield b.filter(pa.array(k1.view(np.int64) == b.column(0).to_numpy()))
        give_back()

    return found.select("node", "text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each component the row of its
    smallest id stays; repeated rows of that id stay as they are, and so do
    rows without an id."""
    kept = cluster(docs, id_col, text)
    gone = materialize(kept.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "jaccard-gone")
    gone = F.broadcast(gone) if gone.count() <= SMALL else gone.hint("shuffle_hash")
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
