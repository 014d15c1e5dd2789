import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from strata.llm import lexical
from strata.llm.common import Scratch
from strata.llm.lexical import LexicalIndex, ranked_search

from .helpers import doc, frame

ITEMS = "item_id long, text string, score double, doc_id long"


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=50):
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        ranked = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(ranked)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    return [(i, " ".join(rng.choice(words, int(rng.integers(1, 300)), p=p / p.sum()))) for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"GROUP_DOCS": 40, "MAX_CELLS": 1 << 14}, {"MAX_ROWS": 64}, {"STEP_CELLS": 512}])
def test_equals_brute_force(spark, monkeypatch, limits):
    """Also with many small blocks, saturated signatures and few documents bounded at a time."""
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs = corpus(500)
    items = [(i, docs[i * 11][1][:200] + " rare zz9") for i in range(20)] + [(20, "unknown"), (21, None), (22, "")]
    got = ranked_search(frame(spark, [doc(*d) for d in docs]).repartition(5), spark.createDataFrame(
        [(i, t, 0.0, 7) for i, t in items], ITEMS), k=10)
    assert rows(got) == brute(docs, items, 10)


def test_blocks_of_queries(spark):
    docs = corpus(200, 1)
    items = [(i, docs[i][1]) for i in range(12)]
    got = ranked_search(frame(spark, [doc(*d) for d in docs]), spark.createDataFrame([(i, t, 0.0, 7) for i, t in items], ITEMS),
                        k=5, block_terms=150)
    assert rows(got) == brute(docs, items, 5)


def test_edges_ties_and_repeats(spark, edge_docs, edge_rows, no_docs):
    items = [(1, "Two WORDS one"), (1, "é"), (None, "same w3"), (2, "a b"), (3, " \t")]
    table = spark.createDataFrame([(i, t, 0.0, 7) for i, t in items], ITEMS)
    assert rows(ranked_search(edge_docs, table)) == brute([(r[0], r[1]) for r in edge_rows], items)
    assert ranked_search(no_docs, table).collect() == []
    assert ranked_search(edge_docs, table.limit(0)).collect() == []


def test_many_copies_of_the_best(spark):
    docs = [(i, "alpha beta gamma" if i % 3 else f"alpha x{i}") for i in range(900)]
    items = [(0, "beta alpha"), (1, "x3 alpha")]
    got = ranked_search(frame(spark, [doc(*d) for d in docs]), spark.createDataFrame([(i, t, 0.0, 7) for i, t in items], ITEMS))
    assert rows(got) == brute(docs, items)


def test_bounds_never_fall_below_scores(spark):
    docs = corpus(300, 2)
    index = LexicalIndex(frame(spark, [doc(*d) for d in docs]), Scratch(spark, "lexical-test"))
    df = Counter(t for _, text in docs for t in set(split(text)))
    queries = lexical._Queries([(0, f"w{i}".encode(), df[f"w{i}"]) for i in range(0, 60, 2)], index.n_docs, index.n_terms)
    by_key = {r["row"]: r["text"] for r in index.docs.collect()}
    seen = 0
    for keys, lengths, height, slices in lexical._blocks([index.blocks.select("keys", "lengths", "height", "slices").toArrow()]):
        for at, bound in queries.bounds(height, slices, lengths):
            for key, b in zip(keys[at:], bound[0]):
                exact = queries.scores(by_key[key].encode(), [0])[0]
                assert exact <= b
                seen += 1
    assert seen == 300


def test_long_text_is_split_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 7)
    text = "alpha Beta alpha gamma-delta é9 " * 9
    assert lexical.term_counts(text.encode()) == Counter(w.encode() for w in split(text))


def test_string_ids(spark):
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType())])
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], schema)
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r.doc_id, r["rank"]) for r in ranked_search(docs, items).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
