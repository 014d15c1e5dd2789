"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds, for blocks of documents of like length, one bitmap over the documents per signature
row. A term that stands at least ``LEVELS[l]`` times in a document sets that document's bit in
``HASHES`` rows chosen by the term and ``l``. The AND of a term's rows says which documents may hold
it, and how often at most: never too little. Weighted sums of these slices are upper bounds of
the scores, since a score grows with every term frequency.

A search reads the slices twice. First the documents with the highest bounds are scored exactly, and
the k-th best of them is a floor per item. Then every document whose bound reaches the floor is
scored exactly from its text; all others are provably not among the k best. Queries go in blocks
of a bounded number of terms, against all document blocks; nothing is gathered but the query
terms and one floor per item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strata.llm.common import Scratch

# Fixed by the contract: terms are runs of ASCII letters, digits and anything beyond ASCII; A-Z are lower-cased.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

LEVELS = (1, 2, 3, 4, 6, 9, 14, 22, 40)  # term frequencies that have a signature of their own
HASHES = 8           # rows per signature
BITS = 16.0          # rows per signature of the longest document of a block
MAX_ROWS = 1 << 21   # of a block; beyond that signatures get denser, which stays an upper bound
MAX_CELLS = 1 << 25  # rows x documents of a block
GROUP_DOCS = 16_384  # documents, and
GROUP_BYTES = 32 << 20  # bytes, from which the blocks of a task are cut
CHUNK = 4 << 20      # bytes of a long text split at a time
STEP_CELLS = 1 << 22  # terms x documents whose bounds are computed at a time

INDEX = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("df", T.LongType()),
    T.StructField("docs", T.LongType()), T.StructField("terms", T.LongType()),
    T.StructField("keys", T.BinaryType()), T.StructField("lengths", T.BinaryType()),
    T.StructField("height", T.IntegerType()), T.StructField("slices", T.BinaryType())])


def terms(text: bytes | None):
    """Lists of a text's terms, a bounded piece of the text at a time."""
    clean, at = (text or b"").translate(TERM_BYTES), 0
    while at < len(clean):
        end = clean.find(b" ", min(at + CHUNK, len(clean)))
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def term_counts(text: bytes | None) -> Counter:
    out = Counter()
    for piece in terms(text):
        out.update(piece)
    return out


def digest(term: bytes) -> bytes:
    return xxhash.xxh3_128_digest(term)


def signature_rows(digests: np.ndarray, level, height: int) -> np.ndarray:
    """(n, HASHES) row numbers of the signatures of terms (n x 2 words of their digests) at a level."""
    place = (np.asarray(level, dtype=np.uint64) * np.uint64(HASHES))[..., None] + np.arange(HASHES, dtype=np.uint64)
    first, step = digests[:, 0, None], digests[:, 1, None] | np.uint64(1)
    return ((first + place * step) % np.uint64(height)).astype(np.int64)


class _Group:
    """Documents gathered for the next blocks of an index."""

    def __init__(self):
        self.vocabulary = defaultdict(count().__next__)
        self.keys, self.lengths, self.ids, self.counts, self.bytes = [], [], [], [], 0

    def add(self, key: int, text: bytes | None) -> None:
        number, ids, n = self.vocabulary.__getitem__, [], 0
        for piece in terms(text):
            found, times = np.unique(np.fromiter(map(number, piece), np.int64, len(piece)), return_counts=True)
            ids.append((found, times))
            n += len(piece)
        if not n:
            return
        found, times = ids[0]
        if len(ids) > 1:
            found, back = np.unique(np.concatenate([i for i, _ in ids]), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate([t for _, t in ids])).astype(np.int64)
        self.keys.append(key)
        self.lengths.append(n)
        self.ids.append(found.astype(np.int32))
        self.counts.append(times.astype(np.int32))
        self.bytes += len(text)

    def rows(self):
        """The dictionary rows and blocks of the documents gathered."""
        if not self.keys:
            return
        words = np.frombuffer(b"".join(map(digest, self.vocabulary)), dtype=np.uint64).reshape(-1, 2)
        df = np.bincount(np.concatenate(self.ids), minlength=len(words))
        yield {"kind": ["term"] * len(words), "digest": [w.tobytes() for w in words], "df": df.tolist()}
        sizes = np.array([sum(int((c >= level).sum()) for level in LEVELS) for c in self.counts])
        order = np.argsort(sizes, kind="stable")
        blocks, at = [], 0
        while at < len(order):
            # as many documents as have at most twice the signatures of the smallest, within MAX_CELLS
            end = int(np.searchsorted(sizes[order], 2 * sizes[order[at]], "right"))
            while end > at + 1 and self.height(sizes[order[end - 1]]) * (end - at) > MAX_CELLS:
                end = at + max(1, (end - at) // 2)
            blocks.append(order[at:end])
            at = end
        for members in blocks:
            yield self.block(members, self.height(sizes[members].max()), words)

    @staticmethod
    def height(signatures: int) -> int:
        return int(min(MAX_ROWS, max(64, math.ceil(BITS * signatures))))

    def block(self, members: np.ndarray, height: int, words: np.ndarray) -> dict:
        bits = np.zeros((height, (len(members) + 7) // 8 * 8), dtype=np.uint8)
        for column, d in enumerate(members):
            for level, least in enumerate(LEVELS):
                held = self.ids[d][self.counts[d] >= least]
                if not len(held):
                    break
                bits[signature_rows(words[held], level, height).ravel(), column] = 1
        lengths = np.array([self.lengths[d] for d in members], dtype=np.int64)
        keys = np.array([self.keys[d] for d in members], dtype=np.int64)
        return {"kind": ["block"], "docs": [len(members)], "terms": [int(lengths.sum())], "keys": [keys.tobytes()],
                "lengths": [lengths.tobytes()], "height": [height], "slices": [np.packbits(bits, axis=1).tobytes()]}


def _arrow(rows: dict) -> pa.RecordBatch:
    n = len(rows["kind"])
    types = {"kind": pa.string(), "df": pa.int64(), "docs": pa.int64(), "terms": pa.int64(), "height": pa.int32()}
    return pa.RecordBatch.from_pydict({f.name: pa.array(rows.get(f.name, [None] * n), types.get(f.name, pa.binary()))
                                       for f in INDEX.fields})


def index_batches(batches):
    group = _Group()
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for key, text in zip(keys, texts):
            group.add(key.as_py(), text.as_py())
            if len(group.keys) >= GROUP_DOCS or group.bytes >= GROUP_BYTES:
                yield from map(_arrow, group.rows())
                group = _Group()
    yield from map(_arrow, group.rows())


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, row): ``row`` finds a document again. Two that share one are both scored exactly."""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("row"))


class LexicalIndex:
    """A written index of a table of documents: signature blocks, document frequencies and totals."""

    def __init__(self, docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text"):
        self.docs, self.scratch, self.key = _keyed(docs, key, text), scratch, key
        built = scratch.save(self.docs.select("row", "text").mapInArrow(index_batches, INDEX), "index")
        self.blocks = built.where("kind = 'block'")
        self.frequencies = (built.where("kind = 'term'").groupBy("digest").agg(F.sum("df").alias("df")))
        total = self.blocks.agg(F.sum("docs"), F.sum("terms")).first()
        self.n_docs, self.n_terms = total[0] or 0, total[1] or 0


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term, digest): the distinct terms of every item. Rows with one id are one item."""
    def split(batches):
        for batch in batches:
            ids, found, places = batch.column(0), [], []
            for i, t in enumerate(batch.column(1).cast(pa.binary())):
                own = list(term_counts(t.as_py()))
                found += own
                places += [i] * len(own)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(places, pa.int64())), pa.array(found, pa.binary()),
                 pa.array([digest(w) for w in found], pa.binary())], names=["item_id", "term", "digest"])

    own = items.select(F.col(key).alias("item_id"), F.col(text).alias("text"))
    schema = T.StructType([own.schema["item_id"], T.StructField("term", T.BinaryType()), T.StructField("digest", T.BinaryType())])
    return own.mapInArrow(split, schema).distinct()


class _Queries:
    """A block of items: their terms with weights, as arrays that tasks work with."""

    def __init__(self, rows, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.item_ids, number, uses = [], {}, defaultdict(list)
        known, frequency = {}, []
        for item, term, df in rows:
            if item not in number:
                number[item] = len(number)
                self.item_ids.append(item)
            if term not in known:
                known[term] = len(known)
                frequency.append(df)
            uses[number[item]].append(known[term])
        self.terms = list(known)
        self.uses = [np.array(sorted(uses[i])) for i in range(len(number))]
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency], dtype=np.int64)
        self.words = np.frombuffer(b"".join(map(digest, known)), dtype=np.uint64).reshape(-1, 2)

    def lengths_to_m(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * lengths * self.n_docs) // self.n_terms

    def scores(self, text: bytes | None, items) -> list[int]:
        """Exact scores of a text for some items, in whole numbers of any size."""
        held = term_counts(text)
        n = sum(held.values())
        m = 100 - 50 + (50 * n * self.n_docs) // self.n_terms
        parts = {}
        for i in items:
            for t in self.uses[i]:
                if t not in parts:
                    tf = held.get(self.terms[t], 0)
                    parts[t] = int(self.weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        return [sum(parts[t] for t in self.uses[i]) for i in items]

    def bounds(self, height: int, slices: bytes, lengths: np.ndarray):
        """Pieces (first document, bounds items x documents) of a block's upper bounds."""
        bits = np.frombuffer(slices, dtype=np.uint8).reshape(height, -1)
        # most that a term of each level adds per unit of weight, in each document; level 0 adds nothing
        m = self.lengths_to_m(lengths)
        most = [np.zeros_like(m)] + [(1_000_000_000 * (nxt - 1)) // (1000 * (nxt - 1) + 20 * m) for nxt in LEVELS[1:]]
        most = np.array(most + [np.full_like(m, 1_000_000)])
        step = max(8, STEP_CELLS // max(1, len(self.terms)) // 8 * 8)
        for at in range(0, len(lengths), step):
            piece = bits[:, at // 8:(at + step) // 8]
            width = min(step, len(lengths) - at)
            level = np.zeros((len(self.terms), width), dtype=np.uint8)
            alive, seen = np.arange(len(self.terms)), None
            for j in range(len(LEVELS)):
                held = np.bitwise_and.reduce(piece[signature_rows(self.words[alive], j, height)], axis=1)
                held = held if seen is None else held & seen
                some = held.any(axis=1)
                alive, seen = alive[some], held[some]
                if not len(alive):
                    break
                level[alive] += np.unpackbits(seen, axis=1, count=width)
            gain = np.take_along_axis(most[:, at:at + width], level.astype(np.intp), axis=0) * self.weights[:, None]
            yield at, np.array([gain[u].sum(axis=0) for u in self.uses])


def _blocks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield (np.frombuffer(row["keys"], dtype=np.int64), np.frombuffer(row["lengths"], dtype=np.int64),
                   row["height"], row["slices"])


def seed_batches(queries: _Queries, k: int):
    """Per task and item the ``k`` documents with the highest bounds: (item, row, bound)."""
    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.uses]
        for keys, lengths, height, slices in _blocks(batches):
            for at, bound in queries.bounds(height, slices, lengths):
                own = keys[at:at + bound.shape[1]]
                for i, b in enumerate(bound):
                    top = np.argpartition(-b, k)[:k] if len(b) > k else np.arange(len(b))
                    top = top[b[top] > 0]
                    rows, values = np.concatenate([best[i][0], own[top]]), np.concatenate([best[i][1], b[top]])
                    keep = np.argsort(-values, kind="stable")[:k]
                    best[i] = rows[keep], values[keep]
        for i, (rows, values) in enumerate(best):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), pa.array(rows), pa.array(values)],
                                                 names=["item", "row", "bound"])
    return run


def candidate_batches(queries: _Queries, floors: np.ndarray):
    """Every document whose bound reaches an item's floor, with those items: (row, items)."""
    def run(batches):
        for keys, lengths, height, slices in _blocks(batches):
            for at, bound in queries.bounds(height, slices, lengths):
                items, docs = np.nonzero(bound >= floors[:, None])
                order = np.argsort(docs, kind="stable")
                who, starts = np.unique(docs[order], return_index=True)
                offsets = np.append(starts, len(docs)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(items[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at + who]), lists], names=["row", "items"])
    return run


def score_batches(queries: _Queries, id_type: pa.DataType):
    """Exact scores above 0 of candidate texts: (item, id, score)."""
    def run(batches):
        for batch in batches:
            ids, found, places, scores = batch.column(0), [], [], []
            for i, (text, items) in enumerate(zip(batch.column(1).cast(pa.binary()), batch.column(2))):
                wanted = sorted(set(items.as_py()))
                for item, score in zip(wanted, queries.scores(text.as_py(), wanted)):
                    if score > 0:
                        found.append(item)
                        places.append(i)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), ids.take(pa.array(places, pa.int64())),
                                              pa.array(scores, pa.int64())], names=["item", "id", "score"])
    return run


def _exact(index: LexicalIndex, candidates: DataFrame, queries: _Queries) -> DataFrame:
    """``candidates`` (row, items) joined to their texts and scored. The candidates are a written
    table, so the planner broadcasts them if they are small and shuffles both sides if not."""
    rows = index.docs.join(candidates, "row").select("id", "text", "items")
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", index.docs.schema["id"].dataType),
                           T.StructField("score", T.LongType())])
    return rows.mapInArrow(score_batches(queries, None), schema)


def _merged(rows: DataFrame) -> DataFrame:
    """One row per document: the items of all its candidate rows."""
    return rows.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def search_block(index: LexicalIndex, queries: _Queries, k: int, name: str) -> DataFrame:
    """(item, id, score, rank) of the ``k`` best documents of each item of one block of queries."""
    scratch, blocks = index.scratch, index.blocks.select("keys", "lengths", "height", "slices")
    seeds = blocks.mapInArrow(seed_batches(queries, k), "item int, row long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
    seeds = seeds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    seeds = scratch.save(_merged(seeds.select("row", F.array("item").alias("items"))), f"{name}_seeds")
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    floors = np.ones(len(queries.uses), dtype=np.int64)
    kth = _exact(index, seeds, queries).withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
    for row in kth.select("item", "score").collect():  # at most one row per item of the block
        floors[row["item"]] = row["score"]
    found = blocks.mapInArrow(candidate_batches(queries, floors), "row long, items array<int>")
    found = scratch.save(_merged(found), f"{name}_candidates")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scratch.save(_exact(index, found, queries).withColumn("rank", F.row_number().over(ranked))
                        .where(F.col("rank") <= k), f"{name}_ranked")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", block_terms: int = 50_000) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``; equal
    scores by ascending id. Whole texts, all documents, exact scores.

    ``block_terms``: about so many term uses of items are searched at a time (the driver and each task
    hold one block of queries, whatever the number of items; an item is not divided).

    Defined cases: NULL, empty and blank texts hold no term and are in no count; items without a term
    that stands in a document give no rows; rows with one item id (NULL too) are one item with the
    terms of all; rows with one document id are documents of their own, equal ones tie; NULL
    document ids stand last among equal scores; empty tables give an empty result; other columns are
    not read."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical")
    index = LexicalIndex(docs, scratch, key, text)
    wanted = query_terms(items, item_key, item_text)
    wanted = scratch.save(wanted.join(index.frequencies, "digest").select("item_id", "term", "df"), "queries")
    n_blocks = max(1, math.ceil(wanted.count() / block_terms))
    place = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    item = T.StructField(item_key, wanted.schema["item_id"].dataType)
    schema = T.StructType([item, T.StructField("rank", T.IntegerType()),
                           T.StructField(key, index.docs.schema["id"].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for b in range(n_blocks):
        rows = wanted.where(place == b).collect()  # about block_terms rows
        if not rows:
            continue
        queries = _Queries(sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"], r["term"])), index.n_docs, index.n_terms)
        names = spark.createDataFrame(list(enumerate(queries.item_ids)), T.StructType([T.StructField("item", T.IntegerType()), item]))
        ranked = search_block(index, queries, k, f"block{b}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select(
            item_key, "rank", F.col("id").alias(key), "score"))
    scratch.drop("index")
    return out
