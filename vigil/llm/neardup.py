"""Embedding near-duplicates by a robust-pruned flat graph (operator 3).

1. Equal vectors become one node with a weight.
2. Spherical k-means centres, fitted on a bounded sample, deal every node to its
   ``overlap`` nearest clusters (overlapping shards); a shard above ``BLOCK``
   nodes is cut into blocks by a hash of the id.
3. Each block builds its part of the graph: near candidates of every node,
   robust-pruned (a candidate goes if a kept one is ``ALPHA`` times nearer to it
   than the node), with reverse edges.  The lists of a node over all its
   shards are united.
4. Every node searches the blocks of its shards: a greedy beam search from the
   block's medoids (and from itself), then range expansion, which follows the
   edges of every node within reach of the threshold until none is new.
5. Every pair found is verified by its cosine in double precision.  A pair is
   counted in the first shard both ends share, so counts add up without
   listing pairs; each block returns a spanning forest of its links.
6. An audit compares the links of hashed nodes with brute force over all rows
   and repeats the search with more overlap while recall is short.

Defined results: vectors that are null, empty, zero or hold null or
non-finite values, and rows without an id, link with nothing (their own
component, kept); only vectors of equal length are compared; equal vectors
link with each other; repeated rows return one row each; an empty table an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import components, materialize

THRESHOLD = 0.95
SAMPLE = 20_000       # vectors the centres are fitted on, at most
CENTRES = 1024        # centres, at most
PER_CENTRE = 600      # nodes a centre
BLOCK = 3000          # nodes of one graph block, about
OVERLAP = (3, 6, 12)  # nearest clusters a node is dealt to; the next when the audit fails
NEAR, DEGREE, ALPHA = 48, 20, 1.2
BEAM, MEDOIDS, REACH = 24, 8, 0.03
AUDIT, RECALL = 256, 0.995


def usable(vec: Column) -> Column:
    """Vectors that may link."""
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0)
                      & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(column) -> np.ndarray:
    """Unit vectors (double) of a column of equally long lists."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    top = np.abs(x).max(1, keepdims=True)      # scaled first: no overflow, no underflow
    x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres_of(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from spread-out rows."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i:i + 4096] @ c.T, 1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        keep = norm > 1e-9
        c[keep] = total[keep] / norm[keep, None]
    return c


def prune(x: np.ndarray) -> np.ndarray:
    """Robust-pruned adjacency of a block: (n, width) local indices, -1 padded."""
    n = len(x)
    c = min(NEAR, n - 1)
    if c <= 0:
        return np.full((n, 1), -1, np.int32)
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    cand = np.argpartition(-s, c - 1, axis=1)[:, :c]
    cand = np.take_along_axis(cand, np.argsort(-np.take_along_axis(s, cand, 1), 1, kind="stable"), 1)
    d = 1 - np.take_along_axis(s, cand, 1)
    alive = np.ones((n, c), bool)
    count = np.zeros(n, np.int64)
    out = np.full((n, DEGREE), -1, np.int32)
    for t in range(c):
        take = alive[:, t] & (count < DEGREE)
        rows = np.flatnonzero(take)
        out[rows, count[rows]] = cand[rows, t]
        count[rows] += 1
        if t + 1 < c and len(rows):
            between = 1 - s[cand[rows, t][:, None], cand[rows, t + 1:]]
            alive[rows[:, None], np.arange(t + 1, c)[None, :]] &= ~(ALPHA * between < d[rows, t + 1:])
    src = np.repeat(np.arange(n), DEGREE)
    dst = out.ravel()
    ok = dst >= 0
    both = np.unique(np.concatenate([np.stack([src[ok], dst[ok]], 1), np.stack([dst[ok], src[ok]], 1)]), axis=0)
    # the nearest first, at most three times the degree; but the edge back from
    # a node's nearest kept neighbours always stays, so every node has a way in
    first = np.zeros((n, n), bool)
    for t in range(min(2, DEGREE)):
        ok = out[:, t] >= 0
        first[out[ok, t], np.flatnonzero(ok)] = True
    o = np.lexsort((-s[both[:, 0], both[:, 1]], ~first[both[:, 0], both[:, 1]], both[:, 0]))
    both = both[o]
    start = np.searchsorted(both[:, 0], np.arange(n))
    rank = np.arange(len(both)) - start[both[:, 0]]
    keep = (rank < 3 * DEGREE) | first[both[:, 0], both[:, 1]]
    width = int(rank[keep].max()) + 1
    adj = np.full((n, width), -1, np.int32)
    adj[both[keep, 0], rank[keep]] = both[keep, 1]
    return adj


def search(q: np.ndarray, x: np.ndarray, adj: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with cosine >= threshold found by greedy search from
    medoids and range expansion.  ``own``: index of the query in x, or -1."""
    n, nq = len(x), len(q)
    sim = np.full((nq, n), np.nan, np.float32)
    med = centres_of(x.copy(), min(MEDOIDS, n), 3)
    entry = np.unique(np.argmax(x @ med.T, 0))

    def visit(rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = nodes >= 0
        rows, nodes = rows[ok], nodes[ok]
        key = np.unique(rows * n + nodes)
        rows, nodes = key // n, key % n
        new = np.isnan(sim[rows, nodes])
        rows, nodes = rows[new], nodes[new]
        for i in range(0, len(rows), 1 << 17):
            r, m = rows[i:i + (1 << 17)], nodes[i:i + (1 << 17)]
            sim[r, m] = np.einsum("ij,ij->i", q[r], x[m])
        return rows, nodes

    r, e = np.meshgrid(np.arange(nq), entry, indexing="ij")
    visit(r.ravel(), e.ravel())
    has = np.flatnonzero(own >= 0)
    visit(has, own[has])
    done = np.zeros((nq, n), bool)
    # greedy: expand the best unexpanded of the beam until the beam is expanded
    active = np.arange(nq)
    for _ in range(2 * BEAM):
        s = np.where(np.isnan(sim[active]), -3, sim[active])
        k = min(BEAM, n)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        val = np.take_along_axis(s, top, 1)
        val = np.where(np.take_along_axis(done[active], top, 1) | (val < -2), -4, val)
        best = top[np.arange(len(active)), val.argmax(1)]
        go = val.max(1) > -4
        active, best = active[go], best[go]
        if not len(active):
            break
        done[active, best] = True
        visit(np.repeat(active, adj.shape[1]), adj[best].ravel())
    # range expansion: follow every node within reach of the threshold
    while True:
        rows, nodes = np.nonzero((sim >= threshold - REACH) & ~done)
        if not len(rows):
            break
        done[rows, nodes] = True
        for i in range(0, len(rows), 1 << 14):
            a = adj[nodes[i:i + (1 << 14)]]
            visit(np.repeat(rows[i:i + (1 << 14)], a.shape[1]), a.ravel())
    rows, nodes = np.nonzero(sim >= threshold - 1e-4)
    hit = rows[own[rows] != nodes], nodes[own[rows] != nodes]
    ok = np.concatenate([np.einsum("ij,ij->i", q[hit[0][i:i + (1 << 16)]], x[hit[1][i:i + (1 << 16)]]) >= threshold
                         for i in range(0, len(hit[0]), 1 << 16)] or [np.zeros(0, bool)])
    return hit[0][ok], hit[1][ok]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links a - b."""
    if not len(a):
        return a, b
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    lab = np.arange(len(ids))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        for at in (x, y, lab[x], lab[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    keep = lab != np.arange(len(ids))
    return ids[keep], ids[lab[keep]]


def deal(nodes: DataFrame, overlap: int) -> DataFrame:
    """(node, w, embedding, homes, shard, block, blocks): every node once for
    each of its ``overlap`` nearest clusters."""
    n = nodes.count()
    k = int(min(CENTRES, max(1, -(-n // PER_CENTRE))))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    centres = centres_of(unit(sample), k) if len(sample) else np.zeros((1, 1))
    take = min(overlap, len(centres))

    def homes(batches):
        for pdf in batches:
            s = unit(pdf["embedding"]) @ centres.T if len(pdf) else np.zeros((0, len(centres)))
            top = np.argsort(-s, 1, kind="stable")[:, :take]
            yield pdf.assign(homes=list(np.sort(top, 1).astype(np.int32)))

    dealt = nodes.mapInPandas(homes, "node long, w long, embedding array<float>, homes array<int>")
    dealt = materialize(dealt, "neardup-homes").withColumn("shard", F.explode("homes"))
    # at most CENTRES rows: a bounded broadcast
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return dealt.join(F.broadcast(sizes), "shard").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def link_once(nodes: DataFrame, threshold: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(links per node, forest edges) found with one setting of ``overlap``."""
    members = materialize(deal(nodes, overlap), "neardup-members")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        adj, ids = prune(unit(pdf["embedding"])), pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[r[r >= 0]] for r in adj]})

    lists = members.groupBy("shard", "block").applyInPandas(build, "node long, near array<long>")
    # a node has at most overlap lists of 3 * DEGREE
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    rows = members.join(united, "node")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = rows.select("shard", each.alias("i"), F.col("block").alias("j"), F.lit(True).alias("is_index"), "node", "w",
                        "embedding", "homes", "near")
    asked = rows.select("shard", F.col("block").alias("i"), each.alias("j"), F.lit(False).alias("is_index"), "node", "w",
                        "embedding", "homes", F.expr("CAST(array() AS array<long>)").alias("near"))

    def find(key, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        pdf = pdf.sort_values("node").reset_index(drop=True)
        ix, qs = pdf[pdf["is_index"]].reset_index(drop=True), pdf[~pdf["is_index"]].reset_index(drop=True)
        none = pd.DataFrame({"node": pd.Series([], dtype="int64"), "other": pd.Series([], dtype="int64"),
                             "links": pd.Series([], dtype="int64")})
        if ix.empty or qs.empty:
            return none
        ids, qid = ix["node"].to_numpy(), qs["node"].to_numpy()
        x, q = unit(ix["embedding"]), unit(qs["embedding"])
        width = max(1, max(len(v) for v in ix["near"]))
        adj = np.full((len(ids), width), -1, np.int32)
        for r, v in enumerate(ix["near"]):
            v = np.asarray(v, np.int64)
            at = np.searchsorted(ids, v)
            at[at == len(ids)] = 0
            at = at[ids[at] == v]                      # edges into other blocks lead nowhere here
            adj[r, :len(at)] = at
        at = np.searchsorted(ids, qid)
        at[at == len(ids)] = 0
        own = np.where(ids[at] == qid, at, -1)
        a, b = search(q, x, adj, own, threshold)
        ha, hb = np.stack(qs["homes"].to_list())[a], np.stack(ix["homes"].to_list())[b]
        common = (ha[:, :, None] == hb[:, None, :]).any(2)
        first = np.where(common, ha, np.iinfo(np.int32).max).min(1)
        mine = first == shard                          # counted in the first shard both share
        links = np.bincount(a[mine], weights=ix["w"].to_numpy(np.float64)[b[mine]], minlength=len(qid)).astype(np.int64)
        got = np.flatnonzero(links)
        fa, fb = forest(qid[a], ids[b])
        return pd.concat([pd.DataFrame({"node": qid[got], "other": -1, "links": links[got]}),
                          pd.DataFrame({"node": fa, "other": fb, "links": -1})], ignore_index=True)

    found = index.unionByName(asked).groupBy("shard", "i", "j").applyInPandas(find, "node long, other long, links long")
    found = materialize(found, "neardup-found")
    return (found.where("links >= 0").groupBy("node").agg(F.sum("links").alias("links")),
            found.where("links < 0").select(F.col("node").alias("a"), F.col("other").alias("b")))


def audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Share of the true links of AUDIT hashed nodes that were found; the nodes
    are compared with every row by brute force, in blocks."""
    asked = nodes.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(AUDIT).toPandas()
    if asked.empty:
        return 1.0
    q, qid = unit(asked["embedding"]), asked["node"].to_numpy()

    def count(batches):
        for pdf in batches:
            if len(pdf):
                s = (unit(pdf["embedding"]) @ q.T >= threshold) & (pdf["node"].to_numpy()[:, None] != qid[None, :])
                yield pd.DataFrame({"node": qid, "true": (s * pdf["w"].to_numpy()[:, None]).sum(0).astype(np.int64)})

    true = nodes.mapInPandas(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    both = true.join(links, "node", "left").agg(
        F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("got"), F.sum("true").alias("true")).first()
    return 1.0 if not both["true"] else both["got"] / both["true"]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("embedding"))
    rows = rows.withColumn("ok", usable(F.col("embedding")) & F.col("id").isNotNull())
    nodes = materialize(rows.where("ok").groupBy("embedding").agg(F.min("id").alias("node"), F.count("*").alias("w"))
                        .select("node", "w", "embedding", F.size("embedding").alias("dim")), "neardup-nodes")
    links = edges = None
    for r in nodes.select("dim").distinct().orderBy("dim").collect():       # one run for each vector length
        part = nodes.where(F.col("dim") == r["dim"]).drop("dim")
        for overlap in OVERLAP:
            found, tree = link_once(part, threshold, overlap)
            if audit(part, found, threshold) >= RECALL:
                break
        links = found if links is None else links.unionByName(found)
        edges = tree if edges is None else edges.unionByName(tree)
    own = nodes.select("node", "w", "embedding")
    if links is None:
        own = own.withColumn("links", F.lit(0).cast("long")).withColumn("component", F.col("node"))
    else:
        own = own.join(links, "node", "left").join(components(edges, "neardup-cc"), "node", "left")
    own = own.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"),
                     F.coalesce("component", "node").alias("c"))
    linked = rows.where("ok").join(own, "embedding").select("id", "n", "c")
    alone = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"),
        F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
