"""Near-duplicates, search, packing, toxicity and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.edge import edge_docs
from vigil.llm import ann, jaccard, neardup, packing, toxicity
from vigil.llm.common import components, shingle_sets


def _union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)]
    pairs += [(700, i) for i in range(701, 760)] + [(5, 5)]
    want = _union(800, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


# ------------------------------------------------------------ n-gram Jaccard

def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_shingle_sets_count():
    texts = ["a b c d e f", "A  b\tc\nd e F", "x", "", None, "x y", "y x", "É é É é É é", "one two three four"]
    doc, h = shingle_sets(texts)
    groups = [tuple(h[doc == i]) for i in range(len(texts))]
    assert [len(g) for g in groups] == [len(_shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (groups[i] == groups[j]) == (_shingles(a) == _shingles(b)), (a, b)


def _corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 12, 20, 33, 60, 130, 700]))]
        if rng.random() < 0.4:
            base += common
        for _ in range(rng.randint(1, 5)):
            c = list(base)
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                k = rng.randrange(len(c))
                c[k:k + 1] = rng.choice([[], [rng.choice(vocabulary)], [c[k], rng.choice(vocabulary)]])
            out.append(" ".join(c).upper() if rng.random() < 0.1 else " ".join(c))
    return out


@pytest.mark.parametrize("force", [None, "B"])
def test_join_equals_brute_force(spark, force):
    texts = _corpus(11 if force else 12)
    docs = edge_docs(spark, texts)
    rows = [(r["doc_id"], _shingles(r["text"])) for r in docs.collect() if r["doc_id"] is not None]
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    want = _union(max(i for i, _ in rows) + 1, pairs)
    got = jaccard.cluster(docs, force=force).collect()
    assert len(got) == docs.count()
    sizes = dict(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sizes[r["doc_id"]]), want[r["doc_id"]])
    if force is None:
        kept = jaccard.keep_first(docs)
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        assert ids == {None} | {i for i, _ in rows if want[i] == i}


def test_join_of_many_alike_texts_that_do_not_link(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(400):
        c = list(base)
        for j, k in enumerate(rng.sample(range(60), 2)):
            c[k] = f"r{i}_{j}"
        texts += [" ".join(c)] + [" ".join([*c, f"e{i}"])] * (i % 40 == 0)
    docs, asked, links_of = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], jaccard.links_of

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return links_of(pairs, *rest)
    monkeypatch.setattr(jaccard, "links_of", counted)
    sets = [_shingles(t) for t in texts]
    want = _union(len(texts), [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if 100 * len(x & y) >= 75 * len(x | y)])
    for setting in ({}, {"WIDE": 2, "BLOCK": 50}):                        # one block each, then several
        for k, v in setting.items():
            monkeypatch.setattr(jaccard, k, v, raising=False)
        asked.clear()
        assert [r["component_id"] for r in sorted(jaccard.cluster(docs).collect())] == want
        assert sum(asked) < 30 * len(texts)                               # not the square of the group


def test_join_of_empty_tables(spark):
    docs = edge_docs(spark)
    assert jaccard.cluster(docs.limit(0)).count() == 0
    blank = docs.where("doc_id < 3")
    assert sorted(tuple(r) for r in jaccard.cluster(blank).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


# ---------------------------------------------------------------- embeddings

def _vectors(spark, n=900, dim=16):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    for i in range(0, 300):
        x[i] = x[i % 7] + 0.04 * rng.normal(size=dim)            # large groups around the threshold
    x[300:340] = x[341]                                           # equal vectors
    x = np.concatenate([x * rng.uniform(0.5, 2, size=(n, 1))]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [None] + [1.0] * (dim - 1)),
           (n + 4, [float("nan")] * dim), (n + 5, [float("inf")] * dim), (n + 6, [1.0, 2.0]), (None, [1.0] * dim)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, node string, w int")
    return x.astype(np.float64), df


def test_near_duplicates_equal_brute_force(spark):
    x, df = _vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    want = _union(len(x), zip(*np.nonzero(link), strict=True))
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert len(got) == df.count()
    wrong = sum(got[i]["n_links"] != link[i].sum() for i in range(len(x)))
    assert wrong <= 0.01 * len(x)
    assert all(got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(len(x), len(x) + 7))
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    x, df = _vectors(spark)
    out = ann.nearest(df, lambda i: i % 20 == 0, 20).collect()
    s, hit, total = x @ x.T, 0, 0
    for q in range(0, len(x), 20):
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
        assert np.allclose([r["score"] for r in mine], [s[q, r["vec_id"]] for r in mine])
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        s[q, q] = -np.inf
        least = np.sort(s[q])[-20]
        hit += sum(s[q, r["vec_id"]] >= least - 1e-9 for r in mine)
        total += 20
    assert hit >= 0.9 * total
    few = ann.nearest(df.where("vec_id < 5"), lambda i: i % 20 == 0, 20)
    assert few.count() == 4
    assert ann.nearest(df.limit(0), lambda i: i % 20 == 0, 20).count() == 0


def test_vectors_are_sent_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 512)                       # many cells
    monkeypatch.setattr(ann, "LOAD", 64)
    rng = np.random.default_rng(9)
    n, width = 600, 4
    x = rng.normal(size=(n, 8)).astype(np.float32)
    # every list holds node 0, others are drawn
    lists = [(i, [0 if i else 1, *(int(v) for v in rng.choice([j for j in range(2, n) if j != i], width - 1, False))]) for i in range(n)]
    graph = spark.createDataFrame([(i, [(0.0, v) for v in far]) for i, far in lists], f"t long, near {ann.LIST}")
    store = spark.createDataFrame([(i, x[i].tobytes()) for i in range(n)], "node long, h binary")
    own = store.selectExpr("node", "h", "CAST('inf' AS double) AS bar")
    via = spark.createDataFrame(lists, "u long, via array<long>")
    packs = ann.packs_of(graph, own, width)
    args = (via, own.withColumnRenamed("node", "u"), packs, n * width)
    left, right = (v.toPandas() for v in ann.dealt(*args))
    assert len(left) == n * width and sorted(left["u"]) == sorted(list(range(n)) * width)      # however many cells
    assert len(right) <= n + n * width // 64                    # a node that all list stands in a few cells
    assert left[left["w"] == 0].groupby("cell").size().max() < 3 * 64
    got = {r["t"]: [(e["d"], e["v"]) for e in r["near"]] for r in ann.best(ann.evaluate(*args, n, both=False), n).collect()}
    far = dict(lists)
    x = x.astype(np.float64)
    for u in range(n):
        c = {v for w in far[u] for v in far[w]} - {u}
        assert sorted(v for _, v in got.get(u, [])) == sorted(c)
        assert got.get(u, []) == sorted(got.get(u, []))
        assert all(abs(-d - x[u] @ x[v]) < 1e-9 for d, v in got.get(u, []))


def test_search_in_groups_of_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]                                                   # a large group of copies
    x[400:440] = x[400]
    x[440:800] = x[440] + 1e-5 * rng.normal(size=(360, 16))               # near copies, equal in half precision
    x = x[rng.permutation(len(x))].astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, lambda i: i % 5 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    x = x.astype(np.float64)
    alike = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    hit = wrong = 0
    for q in range(0, len(x), 5):
        s = np.einsum("ij,ij->i", x, np.tile(x[q], (len(x), 1)))
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        mine = [got[q][k + 1] for k in range(20)]
        hit += len(set(mine) & set(want.tolist()))
        if (alike == alike[q]).sum() > 20:
            wrong += mine != want.tolist()
    assert len(got) == 280 and wrong == 0
    assert hit >= 0.98 * 20 * 280


# ------------------------------------------------------------------- packing

def _best_fit(sizes, sources, clusters, capacity):
    """The plain method: look at every bin."""
    bins = []
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        ok = [(b["free"], k) for k, b in enumerate(bins) if b["free"] >= sizes[i] and sources[i] not in b["s"] and clusters[i] not in b["c"]]
        if ok:
            b = bins[min(ok)[1]]
        else:
            b = {"free": capacity, "s": set(), "c": set()}
            bins.append(b)
        b["free"] -= sizes[i]
        if sources[i] is not None:
            b["s"].add(sources[i])
        b["c"].add(clusters[i])
    return sorted(b["free"] for b in bins)


def test_best_fit_equals_plain_search():
    rng = random.Random(9)
    for _ in range(20):
        n = rng.randint(1, 120)
        sizes = [rng.randint(1, 50) for _ in range(n)]
        sources = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in range(n)]
        clusters = [rng.randrange(30) for _ in range(n)]
        where, offset, count = packing.pack_group(sizes, sources, clusters, 50)
        free = [50 - sum(s for s, b in zip(sizes, where, strict=True) if b == k) for k in range(count)]
        assert sorted(free) == _best_fit(sizes, sources, clusters, 50)
        for k in range(count):
            mine = sorted((offset[i], sizes[i]) for i in range(n) if where[i] == k)
            assert [o for o, _ in mine] == list(np.cumsum([0] + [s for _, s in mine])[:-1])


def test_packing_rows(spark):
    docs = edge_docs(spark, _corpus(3, 30))
    rows = packing.pack_documents(docs, capacity=64, group_docs=40).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()]
    assert sum(r["n_tokens"] for r in rows) == sum(words)
    assert sum(r["bin_id"] is None for r in rows) == sum(w == 0 for w in words)
    bins = {}
    for r in rows:
        if r["bin_id"]:
            bins.setdefault(r["bin_id"], []).append(r)
    for b in bins.values():
        assert sum(r["n_tokens"] for r in b) == b[0]["bin_tokens"] <= 64
        sources = [r["source"] for r in b if r["source"] is not None]
        assert len(set(sources)) == len(sources) and len({r["cluster"] for r in b}) == len(b)
    assert packing.pack_documents(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ toxicity

def _toxic_corpus(spark, n=900):
    rng = random.Random(21)
    fine = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(fine) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "zzork" + rng.choice(fine), "vrugg" + rng.choice(fine)]))
        docs.append(Row(doc_id=i, text=" ".join(words) + rng.choice(["", "!", "."]), lang="en", source="s"))
        if i % 10 != 3:
            labels.append((i, 1, int(bad)))
    bad = {r[0]: r[2] for r in labels}
    return spark.createDataFrame(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bad


def test_toxicity_on_held_out_rows(spark):
    docs, labels, bad = _toxic_corpus(spark)
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r["held_out"] and r["doc_id"] in bad]
    assert len(held) > 100
    assert sum(r["predicted"] == bad[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)


def test_toxicity_edge_rows(spark):
    docs, labels, _ = _toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    odd = edge_docs(spark)
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(r["score"] < 0.7 for r in out)
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.classify(odd, labels.where("toxic = 1").withColumn(
        "doc_id", F.col("doc_id") % 7)).collect()} == {1.0}


def test_lexicon_does_not_depend_on_slices(spark):
    rows = [(f"zzork vvile plain filler{i}", 1) for i in range(60)]
    rows += [(f"plain seldom{i % 40} filler{i}", 0) for i in range(800)] + [("common zzork", 0)] * 20 + [("common vvile", 0)] * 5
    rows += [("common " + "x" * 4_000_000, 0) for _ in range(3)]          # a slice each
    rows += [("common zebra", 1)] * 3

    def counts(parts):
        df = spark.createDataFrame(rows, "text string, toxic int").repartition(parts)
        assert df.rdd.getNumPartitions() == parts
        return toxicity._lexicon(df, 63, 828).sort_values("f").to_dict("list")

    one, many = counts(1), counts(100)
    assert one == many
    h, doc, _ = toxicity.features_of([t for t, _ in rows])
    pairs = np.unique(np.stack([h, doc.astype(np.uint64)]), axis=1)
    y = np.array([t for _, t in rows])
    f, at = np.unique(pairs[0], return_inverse=True)
    p, n = (np.bincount(at[y[pairs[1].astype(int)] == c], minlength=len(f)) for c in (1, 0))
    want = {}
    for k, a, b in zip(f.view(np.int64).tolist(), p.tolist(), n.tolist(), strict=True):
        cells = [(a, (a + b) * 63 / 891), (b, (a + b) * 828 / 891), (63 - a, (891 - a - b) * 63 / 891), (828 - b, (891 - a - b) * 828 / 891)]
        odds = np.log((a + 0.5) / 64) - np.log((b + 0.5) / 829)
        if a >= 3 and odds > toxicity.LEAST_ODDS and sum(2 * o * np.log(o / e) for o, e in cells if o) > toxicity.LEAST_G2:
            want[k] = odds
    assert want and sorted(want) == one["f"] and np.allclose([want[k] for k in one["f"]], one["odds"])


def test_label_model_finds_the_reliable_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.9, 0.55])
    votes = np.where(rng.random((4000, 4)) < right, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    votes = np.concatenate([votes, votes[:, 3:4], votes[:, 3:4]], 1)               # a poor voter, three times
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    post, theta, weight = toxicity.label_model(pattern, counts.astype(float))
    at = {tuple(p): q for p, q in zip(pattern, post, strict=True)}
    assert np.mean((np.array([at[tuple(v)] for v in votes]) > 0.5) == y) > 0.95
    assert weight[3:].max() < weight[:3].min()


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, tmp_path):
    docs, labels, bad = _toxic_corpus(spark)
    extra = spark.createDataFrame([(10_000 + i, t, "en", "t") for i, t in enumerate(
        ["copy of a text that stands twice in the corpus with ten words", "Copy of a text that stands twice in the corpus with TEN words",
         "the secret='Live-9f8e7d6c5b' is here", None, ""])], "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(extra).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = d
        if k < 3:
            assert d.columns == docs.columns
    left = {r["doc_id"]: r["text"] for r in seen["toxicity"].collect()}
    kept_clean = sum(i in left for i, b in bad.items() if not b)
    assert kept_clean == sum(not b for b in bad.values())
    assert sum(i in left for i, b in bad.items() if b) <= 0.05 * sum(bad.values())
    left = {r["doc_id"]: r["text"] for r in seen["near_copies"].collect()}
    assert 10_000 in left and 10_001 not in left and 10_003 in left and 10_004 in left
    masked = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert masked[10_002]["text"] == "the secret='[credential]' is here" and masked[10_002]["n_chars"] == len(masked[10_002]["text"])
    assert set(masked) == set(left)
    assert {r["doc_id"] for r in seen["packing"].collect()} == set(left)
    assert corpus_pipeline.ORACLE_SQL is None


def test_frequent_values_counted_in_place():
    rng = np.random.default_rng(4)
    for least in (4, 5, 9):
        for n in (0, 1, 3, 4, 500):
            v = rng.integers(0, 60, n).astype(np.uint64)
            ids, count = np.unique(v, return_counts=True)
            got = jaccard.often(v, least)
            assert got[0].tolist() == ids[count >= least].tolist() and got[1].tolist() == count[count >= least].tolist()


def test_bounds_of_many_pairs(monkeypatch):
    rng = np.random.default_rng(12)
    counts = [rng.integers(0, top, w).astype(np.uint8) for w in (16, 64, 256, 1024, 2048) for top in (3, 60, 256)]
    counts += [np.full(1024, 254, np.uint8)] * 2 + [np.full(16, 254, np.uint8)] * 2
    sketch, size = [c.tobytes() for c in counts], np.array([int(c.sum()) for c in counts])
    x, y = (v.ravel() for v in np.meshgrid(np.arange(len(counts)), np.arange(len(counts))))
    for k in (1, 2, 8):                                          # sets of more shingles than the sketches count
        want = [7 * jaccard.sketch_bound(sketch[a], sketch[b]) >= 3 * k * (size[a] + size[b]) for a, b in zip(x, y, strict=True)]
        assert jaccard.bounded(x, y, k * size, sketch).tolist() == want
    # sums of bytes are added as whole words, not one by one
    wide, least = [], np.minimum
    monkeypatch.setattr(jaccard.np, "minimum", lambda a, b: wide.append(a.dtype) or least(a, b))
    same = [np.full(256, 2, np.uint8).tobytes()] * 4
    assert jaccard.bounded(np.array([0, 1]), np.array([2, 3]), np.full(4, 512), same).all()
    assert np.dtype(np.uint8) in wide and np.dtype(np.uint32) not in wide


def test_hashes_that_share_their_upper_bits_are_ordered():
    from vigil.llm.common import _order
    rng = np.random.default_rng(2)
    h = np.concatenate([np.arange(500)[::-1].astype(np.uint64) + np.uint64(7 << 60), rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    of = rng.integers(0, 1000, 1000) // 100
    for v in (h, h[500:]):
        mine = of[:len(v)]
        got, want = _order(mine, v, 1000), np.lexsort((v, mine))
        assert (v[got] == v[want]).all() and (mine[got] == mine[want]).all()
