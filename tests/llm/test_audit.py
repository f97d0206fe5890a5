"""The filter audit against a plain reading of its definition."""

import re
from itertools import permutations

from pyspark.sql import Row

from tests.llm.edge import edge_docs
from vigil.llm import audit


def _brute(docs, labels):
    """docs: (id, text, part); labels: id -> (good, toxic)."""
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j, u, _ in docs if (u or "") == t and j is not None and i is not None and j < i]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                 "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(same)}
        rows.append((part or "", fails, *labels.get(i, (False, False))))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed, shapley = {}, dict.fromkeys("ABCDE", 0)
        for o in map("".join, permutations("ABCDE")):
            for s in range(5):
                removed[o, s] = [r for r in mine if r[1][o[s]] and not any(r[1][f] for f in o[:s])]
                shapley[o[s]] += len(removed[o, s])
        for (o, s), gone in removed.items():
            f = o[s]
            out.add((part, o, s + 1, sum(not any(r[1][g] for g in o[:s + 1]) for r in mine), len(gone),
                     sum(r[1][f] and any(r[1][g] for g in o[:s]) for r in mine),
                     sum(r[1][f] and sum(r[1].values()) == 1 for r in mine),
                     sum(r[2] for r in gone), sum(r[3] for r in gone), shapley[f]))
    return out


def test_audit_equals_brute_force(spark):
    long = " ".join(f"Word{i}" for i in range(250))
    extra = ["A B C #", long, long, long.lower(), long.lower() + " %", " ".join(["the same"] * 150), "x" * 50 + "&", "é" * 40,
             long, "A B C #"]
    docs = edge_docs(spark, extra)
    marks = [(1, 1, 0), (3, 0, 1), (8, 1, 1), (9, 1, None), (9, 0, 1), (11, 1, 0), (12, None, None), (15, 0, 1), (99, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame([Row(doc_id=a, quality=b, toxic=c, lang="zz") for a, b, c in marks],
                                   "doc_id long, quality int, toxic int, lang string")
    known = {}
    for i, q, t in marks:
        if i is not None:
            g = known.get(i, (False, False))
            known[i] = (g[0] or q == 1, g[1] or t == 1)
    want = _brute([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], known)
    got = audit.audit(docs, labels).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert audit.audit(docs.limit(0), labels).count() == 0
    bare = audit.audit(docs, labels.limit(0)).collect()
    assert {tuple(r)[:7] for r in bare} == {r[:7] for r in want} and not any(r["good_lost"] or r["toxic_lost"] for r in bare)


def test_fields_do_not_run_over():
    big = (1 << 62) // 600
    packed = [audit.pack(m) for m in range(32)]
    counts = audit.unpack(sum(big * p for p in packed))
    assert (counts == big * audit.unpack(sum(packed))).all() and len(counts) == 600
    assert all(0 < c <= 16 for c in audit.unpack(sum(packed)))
