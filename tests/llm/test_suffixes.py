"""Removal of repeated passages against a dictionary of all strings."""

import random

import numpy as np
import pytest

from tests.llm.edge import LONG, edge_docs
from vigil.llm import suffixes


def _brute(rows):
    """rows: (doc_id, text) -> {row: (n_bytes, spans, kept)} by every 50-byte string."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        if i is not None:
            for p in range(len(raw) - 49):
                s = raw[p:p + 50]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if i is not None and first[raw[p:p + 50]] < i:
                gone[p:p + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), edge[::2].tolist(), edge[1::2].tolist(), kept))
    return out


def _texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢 ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 40))) for _ in range(12)]
    out = []
    for _ in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = p[rng.randint(0, len(p) // 2):]
            at = rng.randint(0, len(t))
            t = t[:at] + cut + t[at:]
        out.append(t)
    out += [out[3], out[5] + "!", "a" * 49, "a" * 50, "a" * 51, "a" * 400, "b" + "a" * 60 + "c", "ab" * 300, "\x00" * 70,
            "\x00" * 49 + "\x01", "x\x00" * 50, passages[0], passages[0][:60], LONG[1000:1100], LONG[:500] + "?" + LONG[500:900]]
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_removal_equals_all_strings(spark, monkeypatch, batches):
    monkeypatch.setattr(suffixes, "SLICE", 20_000)
    monkeypatch.setattr(suffixes, "BUCKET", 40_000)
    monkeypatch.setattr(suffixes, "PIECE", 3_000)
    docs = edge_docs(spark, _texts(batches))
    if batches == 7:                                   # ids out of order, some of them shared, also negative
        docs = docs.selectExpr("(doc_id * 37) % 89 - 20 AS doc_id", "text", "lang", "source", "n_chars", "score", "spans", "node",
                               "_text_", "n", "kind").union(docs.limit(3))
    want = _brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = [(r["doc_id"], r["n_bytes"], r["starts"], r["ends"], bytes(r["kept"]))
           for r in suffixes.remove_repeats(docs, batches=batches).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(len(r[2]) for r in got) > 50


def test_empty_table(spark):
    docs = edge_docs(spark).limit(0)
    assert suffixes.remove_repeats(docs).count() == 0
    short = edge_docs(spark).where("doc_id < 5")
    assert [r["starts"] for r in suffixes.remove_repeats(short).collect()] == [[]] * short.count()


def test_levels_merge_geometrically(spark):
    rows = spark.createDataFrame([(0, 0, 0, np.uint32([7]).tobytes(), np.int64([1]).tobytes(), np.uint32([0]).tobytes(),
                                   np.uint8([3]).tobytes(), bytes(range(52)))], suffixes._SEGMENTS)
    tables = suffixes.Tables(spark)
    family, sizes = suffixes.Family(tables, 2), []
    for b in range(4):
        family.add(b, rows)
        sizes.append(sorted(s for s, _ in family.levels))
    assert sizes == [[1], [2], [1, 2], [4]]
    (row,) = family.rows().where(f"level AND batch = {family.levels[0][1]}").collect()
    assert len(row["b"]) == 3 * 4                      # the same three strings, once
    spans = family.spans().collect()
    assert len(spans) == 3                             # the batches after the first
    assert {(np.frombuffer(s["start"], np.uint32)[0], np.frombuffer(s["stop"], np.uint32)[0]) for s in spans} == {(0, 52)}
    tables.close()
