"""Approximate nearest neighbours by NN-descent (operator 8).

The neighbour graph starts from exact neighbours inside overlapping clusters
and is improved by NN-descent: each round joins the graph with itself
(neighbours of neighbours), evaluates the pairs at their common neighbour, whose
row holds the vectors of its own neighbours, lets each pair improve both its
ends, and keeps the ``DEGREE`` best of every node.  So a node's vector is sent a
fixed number of times a round; a node that very many others list is dealt out in
parts.  It ends when few lists change.

Queries run a greedy beam search over the graph, also as joins: every round
expands the ``EXPAND`` best unexpanded nodes of each beam until the beam holds
none.

Equal vectors are one node, named by their smallest id, with the k + 1
smallest ids of the group: no result needs more.  Nodes are dealt to cells by
a hash, so a cluster spreads over all cells; vectors travel as the single
precision values they are and every score is their inner product in double
precision.  All lists are ordered by score descending, then id ascending.

Defined results: vectors that are null, empty, zero or hold null or
non-finite values, and rows without an id, take no part; only vectors of
equal length are compared; a repeated id counts once (its least vector); equal
scores go to the smaller id; with
few rows every row is a start of every search, so all candidates are found; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import materialize
from vigil.llm.neardup import centres_of, deal, unit, usable

DEGREE = 24           # neighbours kept of a node
HOP = 16              # neighbours a node offers to a neighbour in a round
ROUNDS = 6            # rounds of descent, at most
CHANGED = 0.02        # share of new list entries below which descent ends
ROWS = 1 << 15        # (node, common neighbour) rows of a cell, about
LOAD = ROWS // 8      # rows of one common neighbour in a cell, about
BEAM, EXPAND = 256, 48
STARTS = 1024         # start nodes, at most

LIST = "array<struct<d:double,v:bigint>>"     # d = -score, so that ascending order is the best first


def _bytes(x: np.ndarray) -> list:
    return [v.tobytes() for v in x.astype(np.float32)]


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float32) for b in column]).astype(np.float64)


def packed(vectors: DataFrame) -> DataFrame:
    """(node, h binary) of (node, embedding)."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                h = _bytes(np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]]))
                yield pd.DataFrame({"node": pdf["node"], "h": h})

    return vectors.select("node", "embedding").mapInPandas(run, "node long, h binary")


def _top(target: np.ndarray, other: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, list]:
    """The k best different (score, other) of every target: (targets, lists)."""
    if not len(target):
        return target, []
    o = np.lexsort((other, -s, target))
    target, other, s = target[o], other[o], s[o]
    new = np.append(True, (target[1:] != target[:-1]) | (other[1:] != other[:-1]))
    target, other, s = target[new], other[new], s[new]
    first = np.flatnonzero(np.diff(target, prepend=target[0] - 1))
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    keep = rank < k
    target, other, s = target[keep], other[keep], s[keep]
    first = np.flatnonzero(np.diff(target, prepend=target[0] - 1))
    ends = np.append(first[1:], len(target))
    return target[first], [[{"d": 0.0 - float(a), "v": int(b)} for a, b in zip(s[i:j], other[i:j], strict=True)]
                           for i, j in zip(first, ends, strict=True)]


def bar(near, k: int):
    """What an entry must not exceed to enter a list (its k-th, if it is full)."""
    return F.when(F.size(near) >= k, F.element_at(near, k)["d"]).otherwise(F.lit(float("inf")))


def packs_of(graph: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """(w, far, hs, bars): every node's first ``width`` neighbours with their
    vectors and bars, from ``own`` (node, h, bar)."""
    rows = graph.select(F.col("t").alias("w"), F.explode(F.slice("near", 1, width)).alias("e")).select("w", F.col("e.v").alias("node"))
    return (rows.join(own, "node").groupBy("w").agg(F.collect_list(F.struct("node", "h", "bar")).alias("m"))
            .select("w", F.col("m.node").alias("far"), F.col("m.h").alias("hs"), F.col("m.bar").alias("bars")))


def dealt(lists: DataFrame, own: DataFrame, packs: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """The rows (cell, u, h, bar, w), one for every w of ``lists`` (u, via), with
    what ``own`` (u, h, bar) says of u, and the rows of ``packs`` in the cells that
    ask for them.  A w of very many rows is dealt to several cells."""
    cells = max(1, -(-edges // ROWS))

    def cell(part):
        return F.pmod(F.xxhash64("w", part.cast("int")), F.lit(cells)).cast("int").alias("cell")

    parts = (lists.select(F.explode("via").alias("w")).groupBy("w")
             .agg(F.ceil(F.count("*") / F.lit(LOAD)).cast("int").alias("parts")))
    # at most edges / LOAD rows
    hubs = F.broadcast(parts.where("parts > 1"))
    left = (lists.join(own, "u").select("u", "h", "bar", F.explode("via").alias("w")).join(hubs, "w", "left")
            .select(cell(F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1)))), "u", "h", "bar", "w"))
    right = (packs.join(parts, "w").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(cell(F.col("part")), "w", "far", "hs", "bars"))
    return left, right


def evaluate(lists: DataFrame, own: DataFrame, packs: DataFrame, edges: int, k: int, both: bool) -> DataFrame:
    """Scores of the pairs (u, each neighbour of each of its ``via``), computed
    where the common neighbour's pack is: (t, near) lists of the k best per cell,
    without entries that the bar of t rules out.  With ``both`` the pairs count
    for the neighbours, too."""
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"t": pd.Series([], dtype="int64"), "near": pd.Series([], dtype=object)})
        right = right.sort_values("w")
        ids, size = right["w"].to_numpy(), np.array([len(v) for v in right["far"]])
        begin = np.cumsum(size) - size
        far, bars = np.concatenate(right["far"].to_list()), np.concatenate(right["bars"].to_list())
        vec = np.frombuffer(b"".join(h for hs in right["hs"] for h in hs), np.float32).reshape(len(far), -1).astype(np.float64)
        left = left[np.isin(left["w"].to_numpy(), ids)]
        u, limit = left["u"].to_numpy(), left["bar"].to_numpy()
        at = np.searchsorted(ids, left["w"].to_numpy())
        mine, yours = [], []
        for i in range(0, len(u), 4096):
            a, many = at[i:i + 4096], size[at[i:i + 4096]]
            uvec = _vectors(left["h"].iloc[i:i + 4096])
            row = np.repeat(np.arange(len(a)), many)
            col = np.arange(len(row)) + np.repeat(begin[a] - (np.cumsum(many) - many), many)
            x, y = u[i + row], far[col]
            s = np.einsum("ij,ij->i", uvec[row], vec[col])
            for out, to, of, most in ((mine, x, y, limit[i + row]), (yours, y, x, bars[col]))[:1 + both]:
                ok = (x != y) & (-s <= most)
                out.append((to[ok], of[ok], s[ok]))
        t, near = [], []
        for some in (mine, yours)[:1 + both]:
            if some:
                to, found = _top(*(np.concatenate(v) for v in zip(*some, strict=True)), k)
                t.append(to)
                near += found
        return pd.DataFrame({"t": np.concatenate(t) if t else np.zeros(0, np.int64), "near": pd.Series(near, dtype=object)})

    left, right = dealt(lists, own, packs, edges)
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(score, f"t long, near {LIST}")


def best(lists: DataFrame, k: int) -> DataFrame:
    """The k best different entries of every t over all its lists."""
    every = lists.groupBy("t").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    new = F.filter("near", lambda e, i: (i == 0) | (e != F.get("near", i - 1)))
    return every.select("t", F.slice(new, 1, k).alias("near"))


def start_graph(nodes: DataFrame, degree: int) -> DataFrame:
    """(t, near): exact neighbours within two overlapping clusters."""
    members = deal(nodes.withColumn("w", F.lit(1).cast("long")), 2)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        ids = pdf["node"].to_numpy()
        x = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]])
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree, len(ids) - 1)
        if k <= 0:
            return pd.DataFrame({"t": ids, "near": pd.Series([[] for _ in ids], dtype=object)})
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        row = np.repeat(np.arange(len(ids)), k)
        # the same sum as in evaluate(): equal pairs get equal scores
        val = np.einsum("ij,ij->i", x[row], x[top.ravel()])
        t, near = _top(ids[row], ids[top.ravel()], val, k)
        return pd.DataFrame({"t": t, "near": pd.Series(near, dtype=object)})

    return best(members.groupBy("shard", "block").applyInPandas(inside, f"t long, near {LIST}"), degree)


def descend(nodes: DataFrame, store: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """NN-descent: (t, near) of every node."""
    graph = materialize(start_graph(nodes, degree), "ann-graph")
    many = graph.count()
    for _ in range(rounds):
        own = store.join(graph.select(F.col("t").alias("node"), bar(F.col("near"), degree).alias("bar")), "node")
        lists = graph.select(F.col("t").alias("u"), F.transform(F.slice("near", 1, HOP), lambda x: x["v"]).alias("via"))
        found = evaluate(lists, own.withColumnRenamed("node", "u"), packs_of(graph, own, HOP), many * HOP, degree, both=True)
        old = graph.select("t", "near")
        new = materialize(best(old.unionByName(found), degree), "ann-graph")
        changed = (new.join(old.select("t", F.col("near").alias("before")), "t")
                   .agg(F.sum(F.size(F.array_except("near", "before")))).first()[0] or 0)
        graph = new
        if changed <= CHANGED * many * degree:
            break
    return graph


def start_nodes(nodes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most STARTS start nodes, spread by clustering a bounded sample:
    (ids, vectors)."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(20 * STARTS).toPandas()
    x = np.stack([np.asarray(v, np.float64) for v in sample["embedding"]])
    ids = sample["node"].to_numpy()
    if len(ids) <= STARTS:
        o = np.argsort(ids)                    # equal scores go to the smaller id
        return ids[o], x[o]
    u = unit(sample["embedding"])
    c = centres_of(u, STARTS // 4, 6)
    near = np.unique(np.concatenate([np.argmax(u @ c.T, 0), np.argsort(-np.linalg.norm(x, axis=1), kind="stable")[:32]]))
    return ids[near], x[near]


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, store: DataFrame, k: int,
           beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(q, near) with the k best nodes found for every query (node, embedding),
    itself among them."""
    beam = max(beam, k)
    ids, base = start_nodes(nodes, 0)

    def begin(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            q, node = np.stack([np.asarray(v, np.float64) for v in pdf["embedding"]]), pdf["node"].to_numpy()
            top = np.argsort(-(q @ base.T), 1, kind="stable")[:, :beam]
            near = []
            for r in range(len(q)):
                t = top[r][ids[top[r]] != node[r]]
                v = np.einsum("ij,ij->i", np.tile(q[r], (len(t) + 1, 1)), np.concatenate([base[t], q[r:r + 1]]))
                near.append([{"d": 0.0 - float(a), "v": int(b)} for a, b in zip(v, [*ids[t], node[r]], strict=True)])
            yield pd.DataFrame({"q": node, "h": _bytes(q), "near": pd.Series(near, dtype=object)})

    first = queries.mapInPandas(begin, f"q long, h binary, near {LIST}")
    own = first.join(graph.select(F.col("t").alias("q"), F.col("near").alias("mine")), "q", "left")
    no = F.expr(f"CAST(array() AS {LIST})")

    def opened(near):
        return F.slice(F.sort_array(F.transform(F.array_distinct(near), lambda e: F.struct(
            e["d"].alias("d"), e["v"].alias("v"), F.lit(False).alias("done")))), 1, beam)

    # a start that is a neighbour, too, stands once
    mine = F.filter(F.coalesce("mine", no), lambda e: ~F.array_contains(F.transform("near", lambda x: x["v"]), e["v"]))
    state = materialize(own.select("q", "h", opened(F.concat("near", mine)).alias("beam")), "ann-beam")
    edges = state.count() * expand
    packs = materialize(packs_of(graph, store.withColumn("bar", F.lit(0.0)), DEGREE), "ann-packs")
    while True:
        front = F.slice(F.filter("beam", lambda e: ~e["done"]), 1, expand)
        step = (state.withColumn("front", F.transform(front, lambda e: e["v"]))
                .withColumn("seen", F.transform("beam", lambda e: e["v"])))
        lists = step.where(F.size("front") > 0).select(F.col("q").alias("u"), F.col("front").alias("via"))
        own = state.select(F.col("q").alias("u"), "h", bar(F.col("beam"), beam).alias("bar"))
        found = best(evaluate(lists, own, packs, edges, beam, both=False), beam).select(F.col("t").alias("q"), F.col("near").alias("new"))
        marked = F.transform("beam", lambda e: F.struct(
            e["d"].alias("d"), e["v"].alias("v"), (e["done"] | F.array_contains("front", e["v"])).alias("done")))
        unseen = F.filter(F.coalesce("new", no), lambda e: ~F.array_contains("seen", e["v"]))
        fresh = F.transform(unseen, lambda e: F.struct(
            e["d"].alias("d"), e["v"].alias("v"), F.lit(False).alias("done")))
        state = materialize(step.join(found, "q", "left").select(
            "q", "h", F.slice(F.sort_array(F.concat(marked, fresh)), 1, beam).alias("beam")), "ann-beam")
        if not state.where(F.exists("beam", lambda e: ~e["done"])).limit(1).count():
            return state.select("q", F.transform(F.slice("beam", 1, k), lambda e: F.struct(
                e["d"].alias("d"), e["v"].alias("v"))).alias("near"))


def expanded(found: DataFrame, groups: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best ids, but for itself, of every
    query ``asked`` (query_id, q), from the nodes found and the ids of each
    node (node, ids); ties to the smaller id."""
    each = found.select("q", F.explode("near").alias("e")).select("q", "e.d", F.col("e.v").alias("node"))
    # at most k + 1 nodes of k + 1 ids
    near = (each.join(groups.select("node", "ids"), "node").select("q", "d", F.explode("ids").alias("id"))
            .groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near")))
    mine = F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k)
    return (asked.join(near, "q").select("query_id", F.posexplode(mine).alias("at", "e"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"),
                    (F.lit(0.0) - F.col("e.d")).alias("score")))


def grouped(rows: DataFrame, k: int) -> DataFrame:
    """(node, embedding, ids) of the distinct vectors of (id, embedding): the
    smallest id and the k + 1 smallest.  The rank is limited before the shuffle,
    so a vector that very many rows share is not gathered."""
    w = Window.partitionBy("embedding").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("embedding").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest other rows by inner product of every row that ``is_query``
    (a column expression over ``id``) holds for."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("embedding"))
    rows = rows.where(usable(F.col("embedding")) & F.col("id").isNotNull())
    rows = materialize(rows.groupBy("id").agg(F.min("embedding").alias("embedding")), "ann-rows")
    groups = materialize(grouped(rows, k), "ann-nodes")
    out = None
    for r in groups.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():
        here = groups.where(F.size("embedding") == r["d"])             # one run for each vector length
        nodes = here.select("node", "embedding")
        store = materialize(packed(nodes), "ann-store")
        graph = descend(nodes, store)
        asked = materialize(rows.where(is_query(F.col("id"))).join(nodes, "embedding")
                            .select(F.col("id").alias("query_id"), F.col("node").alias("q")), "ann-asked")
        queries = nodes.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi")
        part = expanded(search(queries, nodes, graph, store, k + 1), here, asked, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out
