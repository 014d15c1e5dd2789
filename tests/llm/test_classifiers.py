import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strata.llm import quality as Q
from strata.llm import toxicity as X

from .helpers import LABELS, doc, frame

SF = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    _, first, count = np.unique(np.array(s)[order], return_index=True, return_counts=True)
    rank[order] = np.repeat(first + (count + 1) / 2, count)
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("score, label, folds, held, least", [
    (Q.score_quality, "quality", 3, 1, 0.97), (X.score_toxicity, "toxic", 4, 2, 0.85)])
def test_held_out_accuracy(spark, score, label, folds, held, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r[label] for r in labels.collect()}
    rows = score(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in y]
    assert auc([y[r.doc_id] for r in own], [r.score for r in own]) >= least
    assert np.mean([r.predicted == y[r.doc_id] for r in own]) >= 0.95


@pytest.mark.parametrize("score", [Q.score_quality, X.score_toxicity])
def test_edges(spark, edge_docs, edge_rows, no_docs, score):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], LABELS)
    rows = score(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[0] == by[1] and by[3] == by[4] and by[8] == by[9] and len(by[8]) == 1
    assert score(no_docs, labels).collect() == []
    none = spark.createDataFrame([], LABELS)
    assert len({r.score for r in score(edge_docs, none).collect()}) == 1
    one = spark.createDataFrame([(i, 1, 1) for i in range(12)], LABELS)
    assert all(r.score >= 0.5 for r in score(edge_docs, one).collect())


def test_labels_of_the_held_out_fold_are_not_read(spark, edge_docs):
    fold = lambda i: zlib.crc32(str(i).encode())
    base = [(i, i % 2, i % 2) for i in range(12)]
    for score, folds, held in ((Q.score_quality, 3, 1), (X.score_toxicity, 4, 2)):
        turned = [(i, 1 - q, 1 - t) if fold(i) % folds == held else (i, q, t) for i, q, t in base]
        a, b = (sorted(map(repr, score(edge_docs, spark.createDataFrame(r, LABELS)).collect())) for r in (base, turned))
        assert a == b


def test_forest_traversal_equals_a_walk():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6))
    y = (x[:, 2] + x[:, 4] > 0.3).astype(float)
    f = Q.fit(x, y, trees=15, depth=3)
    walked = []
    for row in x:
        raw = f.base
        for t in range(15):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[f.feature[t, node]] > f.threshold[t, node])
            raw += f.value[t, node]
        walked.append(1 / (1 + math.exp(-raw)))
    assert np.allclose(f.score(x), walked)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.8


def test_statistics_ignore_nothing():
    assert len(Q.statistics("a b")) == len(Q.FEATURES) and Q.statistics("") == [0.0] * len(Q.FEATURES)
    long = Q.statistics("word " * 200_000 + "!" * 1000)
    assert np.isfinite(long).all() and long[Q.FEATURES.index("bang")] > 0


def test_keep_quality_keeps_columns(spark):
    rows = [doc(i, "This is a plain line of words. " * 5 if i % 4 else "BUY!! " * 40) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], LABELS)
    kept = Q.keep_quality(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(400) if i % 4]


def test_block_max_search_is_exact():
    rng = random.Random(3)
    words = [f"t{i}".encode() for i in range(30)]
    idf = {w: 1 + i / 7 for i, w in enumerate(words)}
    bags = [Counter(rng.choices(words, [1 / (i + 1) for i in range(30)], k=rng.randrange(0, 9))) for _ in range(900)]
    index = X.Index(idf, list(range(900)), bags, np.array([rng.randrange(2) for _ in bags]))
    dense = np.zeros((900, 30))
    for e, bag in enumerate(bags):
        t, w = index.vector(bag)
        dense[e, t] = w
    for bag in bags[:120]:
        t, w = index.vector(bag)
        if not len(t):
            continue
        cos = dense[:, t] @ w
        want = np.lexsort((np.arange(900), -np.round(cos, 12)))[:15]
        want = want[cos[want] > 0]
        near, got = index.nearest(t, w, 15)
        assert near.tolist() == want.tolist()
        assert np.allclose(got, cos[want])


def test_search_over_rare_and_frequent_words_is_exact():
    rng = random.Random(8)
    words = [f"w{i}".encode() for i in range(3000)]
    share = [1 / (i + 1) for i in range(3000)]
    bags = [Counter(rng.choices(words, share, k=rng.randrange(0, 60))) for _ in range(1500)]
    index = X.Index({w: 1 + i / 100 for i, w in enumerate(words)}, list(range(1500)), bags, np.arange(1500) % 2)
    assert 0 < index.top.shape[0] < 200 and len(index.example)
    dense = np.zeros((1500, 3000))
    for e, bag in enumerate(bags):
        t, w = index.vector(bag)
        dense[e, t] = w
    vectors = [index.vector(b) for b in bags[:150] if b]
    for (t, w), (near, got) in zip(vectors, index.search(vectors, 15)):
        cos = dense[:, t] @ w
        want = np.lexsort((np.arange(1500), -np.round(cos, 12)))[:15]
        want = want[cos[want] > 0]
        assert near.tolist() == want.tolist() and np.allclose(got, cos[want])


def test_toxic_words_of_every_language_are_found(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.lang: r.recall for r in X.held_out_recall(X.score_toxicity(docs, labels), docs, labels).collect()}
    assert set(got) == {"en", "de", "fr", "es"} and min(got.values()) >= 0.8, got


def test_every_word_of_the_examples_counts(spark):
    rows = [doc(i, f"plain words of no meaning number{i}" + (f" slur{i // 40}" if i % 20 == 0 else "")) for i in range(400)]
    rows += [doc(1000 + i, f"slur{i}") for i in range(10)] + [doc(2000, "number399"), doc(2001, "unheard")]
    labels = spark.createDataFrame([(i, 0, int(i % 20 == 0)) for i in range(400)], LABELS)
    got = {r.doc_id: r for r in X.score_toxicity(frame(spark, rows), labels).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    for i in range(10):
        own = [e for e in (40 * i, 40 * i + 20) if fold(e) != 2]
        assert sorted(got[1000 + i].neighbours) == own  # a word of one or two examples finds them
    assert got[2000].neighbours == ([399] if fold(399) != 2 else []) and got[2001].neighbours == []


def test_examples_are_bounded_by_bytes(spark):
    rows = [doc(i, f"word{i} " * (50 if i % 2 else 5000)) for i in range(40)]
    labels = spark.createDataFrame([(i, 0, i % 4 // 2) for i in range(40)], LABELS)
    index = X.build_index(frame(spark, rows), labels, 100, max_bytes=20_000)
    sizes = {r[0]: len(r[1].encode()) for r in rows}
    assert len(index.ids) > 5 and sum(sizes[i] for i in index.ids) <= 20_000
    assert len(X.build_index(frame(spark, rows), labels, 100).ids) > len(index.ids)
    assert X.score_toxicity(frame(spark, rows), labels, max_bytes=10).count() == 40


@pytest.mark.parametrize("together", [0.0, 2.0])
def test_blocks_together_or_one_by_one(monkeypatch, together):
    monkeypatch.setattr(X, "TOGETHER", together)
    test_search_over_rare_and_frequent_words_is_exact()


@pytest.mark.parametrize("skipped", [0.004, 0.3, 5.0])
def test_words_passed_over_change_no_neighbour(monkeypatch, skipped):
    """Words that add next to nothing are not read; the nearest examples and their cosines stay."""
    monkeypatch.setattr(X, "SKIPPED", skipped)
    rng = random.Random(5)
    words = [b"w%d" % i for i in range(900)]
    idf = {w: rng.choice([1e-4, 1e-3, 0.1, 1.0, 30.0]) for w in words}
    bags = [Counter(rng.choices(words, k=rng.randint(0, 60))) for _ in range(1500)]
    index = X.Index(idf, list(range(1500)), bags, np.array([i % 2 for i in range(1500)]))
    queries = [index.vector(Counter(rng.choices(words, k=n))) for n in (1, 2, 5, 40, 200) for _ in range(30)]
    rare = [t[index.column[t] < 0] for t, _ in queries]
    read = [index._passed_over(r, w[index.column[t] < 0]) for r, (t, w) in zip(rare, queries)]
    assert sum((~own).sum() for own, _ in read) > 100 and all(most <= skipped for _, most in read)
    for (near, cos), (terms, weights) in zip(index.search(queries, 15), queries):
        dense = np.zeros(len(idf))
        dense[terms] = weights
        all_cos = np.bincount(np.repeat(np.arange(1500), np.diff(index.own)), dense[index.terms] * index.weights, 1500)
        order = np.lexsort((np.arange(1500), -np.round(all_cos, 12)))[:15]
        order = order[all_cos[order] > 0]
        assert near.tolist() == order.tolist() and np.allclose(cos, all_cos[order], atol=1e-12)


def test_the_driver_holds_packed_parts_only(spark, monkeypatch):
    """What the driver gathers and broadcasts is a few bytes for each word of an example."""
    monkeypatch.setattr(X, "PACKED", 7)
    rng = random.Random(6)
    rows = [doc(i, " ".join(f"Wort{rng.randrange(500)}é" for _ in range(rng.choice([0, 3, 600])))) for i in range(200)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], LABELS)
    index = X.build_index(frame(spark, rows).repartition(3), labels, 200)
    data = pickle.dumps(index)
    texts = {r[0]: r[1] for r in rows}
    bags = [Counter(X.words_of(texts[i])) for i in index.ids]
    pairs = sum(map(len, bags))
    assert pairs > 15_000 and len(data) < 6 * pairs and not {"words", "terms", "weights"} & set(vars(index))
    labelled = np.array([i % 2 for i in index.ids])
    seen, toxic = Counter(w for b in bags for w in b), Counter(w for b, y in zip(bags, labelled) if y for w in b)
    words = sorted(seen)
    idf = X.weigh(len(bags), int(labelled.sum()), np.array([seen[w] for w in words]), np.array([toxic[w] for w in words]))
    want, got = X.Index(dict(zip(words, idf)), index.ids, bags, labelled), pickle.loads(data)
    assert sorted(got.words.to_pylist()) == words and got.empty_rate == want.empty_rate
    for e in range(len(bags)):
        mine, own = ({i.words[t].as_py(): w for t, w in zip(i.terms[i.own[e]:i.own[e + 1]].tolist(), i.weights[i.own[e]:i.own[e + 1]])}
                     for i in (got, want))
        assert mine == pytest.approx(own)
    assert (np.diff(got.terms)[np.diff(np.repeat(np.arange(len(bags)), np.diff(got.own))) == 0] > 0).all()
