import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from strata.llm.audit import MEASURES, audit_tensors, contract, filter_audit, selections

from .helpers import LABELS, doc, frame


def fails(rows):
    """Per row its part and the set of failed filters, by the rules as they stand."""
    out = []
    for i, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {f for f, b in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
                              ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search(r"[#$%&*|]", t)),
                              ("E", i is not None and any(o[0] is not None and o[0] < i and (o[1] or "") == t for o in rows))) if b}
        out.append((i, lang or "", bad))
    return out


def brute(rows, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    out = {}
    marked = fails(rows)
    for part in {p for _, p, _ in marked}:
        own = [(i, bad) for i, p, bad in marked if p == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order):
                gone = [(i, bad) for i, bad in left if f in bad]
                left = [(i, bad) for i, bad in left if f not in bad]
                total[f] += len(gone)
                out[part, order, step + 1] = [len(left), len(gone), sum(f in b for _, b in own) - len(gone),
                                              sum(b == {f} for _, b in own), sum(i in good for i, _ in gone),
                                              sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(df, labels, spark):
    got = filter_audit(df, spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in MEASURES) for r in got}, len(got)


def with_lang(row, lang):
    return (row[0], row[1], lang, *row[3:])


def test_equals_brute_force(spark):
    texts = [" ".join(f"w{j}" for j in range(250)), "ABC def " * 120, "a b c # d", "", None, "x" * 50, "Same " * 300,
             " ".join(f"v{j % 90}" for j in range(400)) + " 100%"]
    rows = [with_lang(doc(i, texts[(i * 7) % 8]), ["en", "de", None, ""][i % 4]) for i in range(60)]
    rows += [with_lang(doc(None, texts[0]), "en"), with_lang(doc(None, texts[0]), "en"), rows[3], rows[3]]
    labels = [(i, [0, 1, None][i % 3], [1, 0, 0, None][i % 4]) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    got, n = run(frame(spark, rows), labels, spark)
    assert n == 3 * 600 and got == brute(rows, labels)


def test_edge_rows_and_empty_tables(spark, edge_docs, edge_rows, no_docs):
    got, n = run(edge_docs, [(0, 1, 0)], spark)
    assert n == 600 and got == brute(edge_rows, [(0, 1, 0)])
    assert run(no_docs, [(1, 1, 1)], spark) == ({}, 0)
    assert run(edge_docs, [], spark)[1] == 600


def test_contraction_equals_loops():
    t = np.random.default_rng(1).integers(0, 50, (2,) * 3)
    rows, picks = selections("XYZ")
    assert len(rows) == 18
    for m, p in picks.items():
        want = [sum(int(t[a, b, c]) * p[r, 0, a] * p[r, 1, b] * p[r, 2, c] for a in (0, 1) for b in (0, 1) for c in (0, 1))
                for r in range(len(rows))]
        assert contract(t, p).tolist() == want, m
    out = audit_tensors({"n": t, "good": t, "toxic": t}, "XYZ")
    # the removals of an order and what it keeps are all documents
    by = {}
    for o, s, r, k in zip(out["filter_order"], out["step"], out["removed"], out["kept"]):
        by.setdefault(o, []).append((s, r, k))
    assert all(sum(r for _, r, _ in v) + max(v)[2] == t.sum() for v in by.values())


@pytest.mark.parametrize("filters", ["A", "DE", "BCA"])
def test_fewer_filters(spark, edge_docs, filters):
    from math import factorial
    from strata.llm.audit import filter_audit as audit
    out = audit(edge_docs, spark.createDataFrame([], LABELS), filters).collect()
    assert len(out) == factorial(len(filters)) * len(filters)
