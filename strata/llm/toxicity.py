"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

A bounded sample of labelled documents is the example set. Its vocabulary is every word of the
examples. Vectors are TF-IDF of unit length; each word's weight also carries how far its document
frequencies differ between the two labels (likelihood ratio), so a word that says nothing weighs
little but is never dropped, and a rare word counts where no stronger one stands.

The examples are held in an inverted index cut into blocks of examples. Words of few examples
have postings; the frequent ones are columns of a dense matrix with their largest weight in each
block. The postings give every example its share exactly; a block's bound is its best share plus
the most that the frequent words can add. Blocks are visited from the best bound down, those of a
few documents at a time, until no bound reaches the k-th best cosine; what is within rounding of
it is computed again in double precision, so the neighbours are exact. The postings of a document's
weakest words are passed over: the most that they can add is part of every bound. Their votes, weighted by
closeness, are mapped to probabilities by an isotonic fit over the examples' own leave-one-out
votes.

The examples' words are dealt out by word, weighed part by part, and packed; the driver passes the
packed parts on (a few bytes for each word of an example) and never opens them. The index is broadcast
so (bounded by the sample); the documents are scanned once, whole, with no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import Scratch, fold, labelled_sample
from strata.llm.decontam import words_of

FOLDS, HELD = 4, 2  # held out: crc32(doc_id) mod 4 is 2
BLOCK = 128
K = 15
PRIOR = 1.0       # weight of the base rate among the votes
CACHE = 50_000    # vectors whose answer a task remembers
POWER = 1.5       # a word weighs idf * (1 + likelihood ratio) ** POWER
DENSE = 0.08      # words of more than this share of the examples are columns of the matrix
AT_ONCE = 128     # documents searched together
TOGETHER = 0.3    # share of the pairs of documents and blocks to visit from which one product takes them all
MAX_BYTES = 256 << 20  # of the examples' texts
PARTS = 32        # of the vocabulary, by the words' checksums
PACKED = 1000     # examples packed together
SKIPPED = 0.004   # the most that a document's passed-over words can add to a cosine
ROUNDING = 1e-4   # more than the error of a cosine summed in single precision

VECTORS = ("words", "idf", "terms", "weights", "own", "empty", "empty_rate")
DERIVED = ("term", "blocks", "query", "column", "matrix", "top", "norm", "start", "posted", "example", "most")
POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])
Vector = tuple[np.ndarray, np.ndarray]


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers start[0]..stop[0]-1, start[1]..stop[1]-1, ... in one array."""
    sizes = stop - start
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - sizes), sizes)


def digest(vector: Vector) -> bytes:
    return hashlib.blake2b(vector[0].tobytes() + vector[1].tobytes(), digest_size=16).digest()


def packed(words: pa.Array, **numbers: np.ndarray) -> bytes:
    """Words and numbers in few bytes: the numbers in the least type that holds them, all compressed."""
    def row(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    small = {k: v.astype(np.min_scalar_type(int(v.max(initial=0)))) if v.dtype.kind == "i" else v for k, v in numbers.items()}
    own = pa.record_batch({"words": row(words)} | {k: row(pa.array(v)) for k, v in small.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(own)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> tuple:
    """The words and the arrays of numbers, in the order in which they were :func:`packed`."""
    words, *numbers = [c.flatten() for c in pa.ipc.open_stream(data).read_next_batch().columns]
    return words, *(v.to_numpy() for v in numbers)


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, idf: dict[bytes, float], ids: list, bags: list[dict[bytes, int]], labels: np.ndarray):
        words = sorted(idf)
        code = {w: i for i, w in enumerate(words)}
        own = [sorted((code[w], n) for w, n in bag.items() if w in code) for bag in bags]
        flat = np.array([x for f in own for x in f], np.int32).reshape(-1, 2)
        self._label(ids, labels)
        self._fill(pa.array(words, pa.binary()), np.array([idf[w] for w in words]),
                   np.repeat(np.arange(len(own), dtype=np.int32), [len(f) for f in own]), flat[:, 0], flat[:, 1])

    @classmethod
    def of_parts(cls, parts: list[bytes], ids: list, labels: np.ndarray) -> Index:
        """Like the constructor, from the parts of the vocabulary, each with its words' weights, how many
        of them each example holds, and these words and their counts example by example."""
        index = cls.__new__(cls)
        index._label(ids, labels)
        index.parts = parts
        return index

    def _label(self, ids: list, labels: np.ndarray) -> None:
        self.ids, self.labels = ids, labels.astype(np.float64)
        self.base = float((self.labels.sum() + 0.5) / (len(ids) + 1))
        self.knots = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def _unpack(self) -> None:
        words, idf, example, terms, counts = [pa.array([], pa.binary())], [np.zeros(0)], *([np.zeros(0, np.int32)] for _ in range(3))
        first = 0
        for part in self.__dict__.pop("parts"):
            own, weights, sizes, codes, seen = unpacked(part)
            words.append(own)
            idf.append(weights)
            example.append(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
            terms.append(codes.astype(np.int32) + np.int32(first))
            counts.append(seen)
            first += len(own)
        example = np.concatenate(example)
        order = np.argsort(example, kind="stable")
        self._fill(pa.concat_arrays(words), np.concatenate(idf), example[order], np.concatenate(terms)[order], np.concatenate(counts)[order])

    def _fill(self, words: pa.Array, idf: np.ndarray, example: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """From one row per example and word, in the order of both."""
        self.words, self.idf, self.terms = words, idf, terms
        self.weights = idf[terms]
        self.weights *= 1 + np.log(counts.astype(np.float64))
        length = np.sqrt(np.bincount(example, weights=self.weights ** 2, minlength=len(self.ids)))
        self.weights /= length[example]
        sizes = np.bincount(example, minlength=len(self.ids))
        self.own = np.concatenate([[0], np.cumsum(sizes)])  # where each example's words begin
        self.empty = sizes == 0
        self.empty_rate = float((self.labels[self.empty].sum() + self.base) / (self.empty.sum() + 1))

    def __getattr__(self, name: str):
        """The driver keeps the packed parts only; what follows from them is made where it is used."""
        if name not in VECTORS + DERIVED:
            raise AttributeError(name)
        if "parts" in self.__dict__:
            self._unpack()
        if name in DERIVED:
            self._open()
        return self.__dict__[name]

    def _open(self) -> None:
        """What follows from the examples' vectors: postings, matrix and block maxima."""
        self.term = {w: i for i, w in enumerate(self.words.to_pylist())}
        n, size = len(self.ids), len(self.words)
        self.blocks = -(-n // BLOCK) or 1
        example = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.own))
        seen = np.bincount(self.terms, minlength=size)
        frequent = np.flatnonzero(seen > DENSE * n)
        self.query = np.zeros(size)  # the query at hand, zero between calls
        self.column = np.full(size, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        dense = self.column[self.terms] >= 0
        self.matrix = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
        self.matrix[example[dense], self.column[self.terms[dense]]] = self.weights[dense]
        self.matrix = self.matrix.reshape(self.blocks, BLOCK, -1)
        self.top = self.matrix.max(axis=1).T.copy()
        self.norm = np.sqrt(np.einsum("bet,bet->be", self.matrix, self.matrix)).max(axis=1).astype(np.float64)
        rare = np.flatnonzero(~dense)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.terms[rare], minlength=size))])
        self.posted = np.empty(len(rare), POSTING)
        self.most = np.zeros(size)  # a word's largest weight in its postings
        starts = self.start[:-1][np.diff(self.start) > 0]
        self.most[np.diff(self.start) > 0] = np.maximum.reduceat(self.weights[rare], starts) if len(starts) else 0
        self.posted["example"], self.posted["weight"] = example[rare], self.weights[rare]
        self.example = self.posted["example"]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in DERIVED}

    def vector(self, bag: dict[bytes, int]) -> Vector:
        """Terms (ascending) and unit-length TF-IDF weights of a bag of words."""
        codes = np.fromiter(map(self.term.get, bag, repeat(-1)), np.int32, len(bag))
        order = np.argsort(codes)
        order = order[np.searchsorted(codes[order], 0):]
        terms = codes[order]
        weights = self.idf[terms] * (1 + np.log(np.fromiter(bag.values(), np.int64, len(bag))[order]))
        length = math.sqrt(float(weights @ weights))
        return terms, weights / length if length else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> Vector:
        """The k examples of largest positive cosine (equal ones: the earlier example)."""
        return self.search([(terms, weights)], k)[0]

    def _passed_over(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """(which of the rare words to read, the most that the others add): the words with the least
        to add for the length of their postings are left to :meth:`_exact`."""
        adds = weights * self.most[terms]
        order = np.argsort(adds / (self.start[terms + 1] - self.start[terms]))
        sums = np.cumsum(adds[order])
        n = int(np.searchsorted(sums, SKIPPED, "right"))
        read = np.ones(len(terms), bool)
        read[order[:n]] = False
        return read, float(sums[n - 1]) if n else 0.0

    def search(self, vectors: list[Vector], k: int) -> list[Vector]:
        """:meth:`nearest` of each vector."""
        return [x for at in range(0, len(vectors), AT_ONCE) for x in self._search(vectors[at:at + AT_ONCE], k)]

    def _search(self, vectors: list[Vector], k: int, whole: bool = False) -> list[Vector]:
        score = np.zeros((len(vectors), self.blocks * BLOCK), np.float32)
        query = np.zeros((len(vectors), self.top.shape[0]), np.float32)
        skipped = np.zeros(len(vectors))  # the most that a document's words left out can add
        raw = self.posted.view(np.int64)  # joined as plain numbers, which is quicker
        for i, (terms, weights) in enumerate(vectors):
            at = self.column[terms]
            query[i, at[at >= 0]] = weights[at >= 0]
            terms, weights = terms[at < 0], weights[at < 0]
            if not whole:
                read, skipped[i] = self._passed_over(terms, weights)
                terms, weights = terms[read], weights[read]
            start, stop = self.start[terms], self.start[terms + 1]
            if len(weights):
                own = np.concatenate([raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]).view(POSTING)
                share = own["weight"] * np.repeat(weights.astype(np.float32), stop - start)
                score[i] = np.bincount(own["example"], share, score.shape[1])
        blocked = score.reshape(len(vectors), self.blocks, BLOCK)
        length = np.sqrt((query.astype(np.float64) ** 2).sum(axis=1))
        bounds = blocked.max(axis=2) + np.minimum(query @ self.top, np.outer(length, self.norm)) + skipped[:, None]
        bounds = np.where(bounds > 0, bounds + ROUNDING, 0)
        order = np.argsort(-bounds, axis=1, kind="stable")
        visited = np.zeros(bounds.shape, bool)
        least = np.zeros(len(vectors))  # no more than the k-th best cosine
        best = [np.zeros(0, np.float32)] * len(vectors)  # the k best so far, in no order
        for at, step in ((0, 4), (4, 12), (16, self.blocks)):
            visit = np.zeros(bounds.shape, bool)
            np.put_along_axis(visit, order[:, at:at + step], True, axis=1)
            visit &= (bounds > 0) & (bounds >= least[:, None])
            self._add_frequent(blocked, query, visit)
            visited |= visit
            for i in np.flatnonzero(visit.any(axis=1)):
                # shares are added to a block once, so those of earlier blocks stand
                seen = blocked[i, visit[i]].ravel()
                seen = seen[seen >= least[i]] if least[i] else seen
                seen = np.concatenate([best[i], seen])
                if len(seen) > k:
                    seen = np.partition(seen, -k)[-k:]
                    least[i] = max(0.0, float(seen[0]) - ROUNDING)
                best[i] = seen
        out = []
        for i, v in enumerate(vectors):
            if skipped[i] and least[i] <= skipped[i]:  # an example may share no other word
                out += self._search([v], k, whole=True)
                continue
            near = np.flatnonzero(score[i] >= least[i] - skipped[i] if least[i] else score[i])
            out.append(self._exact(v, near[visited[i, near // BLOCK]], k))
        return out

    def _add_frequent(self, blocked: np.ndarray, query: np.ndarray, visit: np.ndarray) -> None:
        """Adds the shares of the frequent words to the visited (document, block) pairs of ``blocked``."""
        if not query.shape[1]:
            return
        wanted = np.flatnonzero(visit.any(axis=0))
        if visit[:, wanted].mean() > TOGETHER if len(wanted) else False:
            whole = len(wanted) == self.blocks
            part = query @ (self.matrix if whole else self.matrix[wanted]).reshape(-1, query.shape[1]).T
            part = part.reshape(len(query), len(wanted), BLOCK)
            for i, own in enumerate(visit[:, wanted]):
                if own.all() and whole:
                    blocked[i] += part[i]
                else:
                    blocked[i, wanted[own]] += part[i, own]
            return
        for b in wanted:
            rows = np.flatnonzero(visit[:, b])
            blocked[rows, b] += query[rows] @ self.matrix[b].T

    def _exact(self, vector: Vector, near: np.ndarray, k: int) -> Vector:
        """The best k of some examples, in double precision."""
        start, stop = self.own[near], self.own[near + 1]
        own = _ranges(start, stop)
        self.query[vector[0]] = vector[1]
        cos = np.bincount(np.repeat(np.arange(len(near)), stop - start),
                          weights=self.query[self.terms[own]] * self.weights[own], minlength=len(near))
        self.query[vector[0]] = 0
        best = np.lexsort((near, -np.round(cos, 12)))[:k]
        return near[best], cos[best]

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        """Votes weighted by closeness, cos^2 / (1.05 - cos), with the base rate as one vote."""
        w = cos ** 2 / (1.05 - np.minimum(cos, 1.0))
        return float((w @ self.labels[near] + PRIOR * self.base) / (w.sum() + PRIOR))

    def left_out(self, examples: list[int], known: dict) -> list[float]:
        """The votes for examples that have words, each without its own."""
        vectors = [(self.terms[self.own[e]:self.own[e + 1]], self.weights[self.own[e]:self.own[e + 1]]) for e in examples]
        keys = [digest(v) for v in vectors]
        new = {key: v for key, v in zip(keys, vectors) if key not in known}
        known.update(zip(new, self.search(list(new.values()), K + 1)))
        votes = []
        for e, key in zip(examples, keys):
            near, cos = known[key]
            others = near != e
            votes.append(self.vote(near[others][:K], cos[others][:K]))
        return votes

    def calibrate(self, examples: np.ndarray, votes: np.ndarray) -> None:
        """Isotonic fit of label on leave-one-out vote (pool adjacent violators)."""
        if not len(votes):
            return
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # sum of labels, count, sum of votes
        for v, y in zip(votes[order], self.labels[examples][order]):
            pools.append([y, 1.0, v])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                y1, n1, v1 = pools.pop()
                pools[-1] = [pools[-1][0] + y1, pools[-1][1] + n1, pools[-1][2] + v1]
        y, n, v = np.array(pools).T
        self.knots = v / n, np.maximum.accumulate((y + self.base) / (n + 1))

    def scores(self, texts: list[str | None], knots: tuple, cache: dict) -> list[tuple[float, list, list]]:
        """Calibrated scores and their evidence: the nearest examples' ids and cosines."""
        vectors = [self.vector(Counter(words_of(t))) for t in texts]
        keys = [digest(v) if len(v[0]) else None for v in vectors]
        new = {key: v for key, v in zip(keys, vectors) if key and key not in cache}
        answers = {key: cache[key] for key in keys if key in cache}
        for key, (near, cos) in zip(new, self.search(list(new.values()), K)):
            p = float(np.interp(self.vote(near, cos), *knots)) if len(near) else self.empty_rate
            answers[key] = (p, [self.ids[e] for e in near], cos.tolist())
        if len(cache) + len(new) > CACHE:
            cache.clear()
        cache.update((key, answers[key]) for key in new)
        return [answers[key] if key else (self.empty_rate, [], []) for key in keys]


def weigh(n: int, pos: int, d: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Weights of words that stand in ``d`` of ``n`` examples, ``a`` of the ``pos`` toxic ones:
    inverse document frequency by the likelihood ratio of the 2x2 table (word in the document, label)."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0.0)

    g2 = 2 * (part(a, d * pos / n) + part(d - a, d * (n - pos) / n)
              + part(pos - a, (n - d) * pos / n) + part(n - pos - (d - a), (n - d) * (n - pos) / n))
    return np.log(1 + n / d) * (1 + np.maximum(g2, 0)) ** POWER


def bounded_sample(sample: DataFrame, max_bytes: int, scratch: Scratch) -> DataFrame:
    """The rows of ``sample`` (id, text, y) in the order of their ids' hashes, whole, as long as their
    texts together have no more than ``max_bytes``; a row that does not fit is passed over."""
    rows = scratch.save(sample, "sample")
    sizes = rows.select("id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").collect()  # max_rows numbers
    if sum(r["size"] for r in sizes) <= max_bytes:
        return rows
    kept, left = [], max_bytes
    for r in sizes:
        if r["size"] <= left:
            kept.append((r["id"],))
            left -= r["size"]
    ids = rows.sparkSession.createDataFrame(kept, rows.select("id").schema)
    return rows.join(F.broadcast(ids), "id")


def build_index(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int = MAX_BYTES) -> Index:
    """Index of at most ``max_rows`` labelled documents outside the held-out fold, with at most
    ``max_bytes`` of text, not calibrated."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = bounded_sample(labelled_sample(docs, labels, "toxic", FOLDS, HELD, max_rows), max_bytes, scratch)

    rows = sample.select("id", "y").toArrow()  # max_rows ids
    rows = rows.take(pc.sort_indices(rows["id"]))
    ids, y = rows["id"].to_pylist(), rows["y"].to_numpy().astype(np.int64)
    n, pos = len(y), int(y.sum())
    if pos in (0, n):  # nothing tells the labels apart
        scratch.clear()
        return Index.of_parts([], ids, y)

    def bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, PACKED) for whole in batches for i in range(0, whole.num_rows, PACKED)):
            own = [Counter(words_of(t)) for t in b.column(1).to_pylist()]
            example = np.repeat(b.column(0).to_numpy(), [len(c) for c in own])
            counts = np.array([k for c in own for k in c.values()], np.int64)
            words = pa.array([w for c in own for w in c], pa.binary()).dictionary_encode()
            codes, part = words.indices.to_numpy(), np.array([zlib.crc32(w) % PARTS for w in words.dictionary.to_pylist()], np.int64)
            out = []
            for p in range(PARTS):
                mine = part == p
                at = np.flatnonzero(mine[codes])
                code = (np.cumsum(mine) - 1)[codes[at]]
                out.append(packed(words.dictionary.filter(pa.array(mine)), codes=code, examples=example[at], counts=counts[at]))
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(out, pa.binary())], names=["part", "data"])

    def weighed(rows: pa.Table) -> pa.Table:
        words, codes, examples, counts = zip(*map(unpacked, rows["data"].to_pylist()))
        first = np.cumsum([0, *map(len, words)])
        coded = pa.concat_arrays(words).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        place = place[coded.indices.to_numpy()]
        terms = np.concatenate([place[c + np.int64(f)] for c, f in zip(codes, first)])
        example = np.concatenate([e.astype(np.int64) for e in examples])
        d = np.bincount(terms, minlength=len(order))
        a = np.bincount(terms, weights=y[example], minlength=len(order))
        by = np.argsort(example * (len(order) or 1) + terms)
        data = packed(coded.dictionary.take(pa.array(order)), idf=weigh(n, pos, d, a), sizes=np.bincount(example, minlength=n),
                      codes=terms[by], counts=np.concatenate(counts)[by].astype(np.int64))
        return pa.table({"part": rows["part"][:1], "data": pa.array([data], pa.binary())})

    places = docs.sparkSession.createDataFrame(rows.select(["id"]).append_column("e", pa.array(range(n), pa.int64())))
    own = sample.join(F.broadcast(places), "id").select("e", "text").mapInArrow(bags, "part int, data binary")
    parts = own.groupBy("part").applyInArrow(weighed, own.schema).toArrow()
    scratch.clear()
    return Index.of_parts(parts.sort_by("part")["data"].to_pylist(), ids, y)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted`` (score >= 0.3), and
    the evidence: ``neighbours`` (ids of the nearest examples) and ``cosines``. The examples are at
    most ``max_rows`` labelled documents with at most ``max_bytes`` of text in all.

    Defined cases: NULL and empty texts, and texts without a word of any example, get the
    smoothed rate of the examples without one, and no evidence; without labels of both kinds
    the vocabulary is empty; NULL labels are ignored, contradicting ones averaged; a NULL id
    stays NULL and falls in the fold of the empty text; repeated rows get equal scores; an empty
    table gives an empty result; only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    index = build_index(docs, labels, max_rows, max_bytes)
    shared = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for b in batches:
            full = [e for e in b.column(0).to_pylist() if not index.empty[e]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(index.left_out(full, known), pa.float64())],
                                             names=["e", "vote"])

    if index.parts:
        examples = spark.range(len(index.ids)).repartition(max(1, len(index.ids) // 500))
        votes = examples.mapInArrow(left_out, "e long, vote double").toArrow().sort_by("e")
        index.calibrate(votes["e"].to_numpy(), votes["vote"].to_numpy())
    knots = index.knots

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cache = shared.value, {}
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                own = b.slice(at, AT_ONCE)
                out = index.scores(own.column(1).to_pylist(), knots, cache)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array([s for s, _, _ in out], pa.float64()),
                     pa.array([i for _, i, _ in out], pa.list_(b.schema.field(0).type)),
                     pa.array([c for _, _, c in out], pa.list_(pa.float64()))],
                    names=["doc_id", "score", "neighbours", "cosines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, score double, neighbours array<{kind}>, cosines array<double>")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours", "cosines")


def held_out_recall(scores: DataFrame, docs: DataFrame, labels: DataFrame, by: str = "lang") -> DataFrame:
    """Per value of ``by``: held-out documents labelled toxic, those predicted, and the recall."""
    toxic = (labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("is_toxic")).where("is_toxic"))
    own = scores.where("held_out").select("doc_id", "predicted").dropDuplicates(["doc_id"])
    return (own.join(toxic, "doc_id").join(docs.select("doc_id", by).dropDuplicates(["doc_id"]), "doc_id")
            .groupBy(by).agg(F.count(F.lit(1)).alias("toxic"), F.sum("predicted").alias("found"))
            .withColumn("recall", F.col("found") / F.col("toxic")))
