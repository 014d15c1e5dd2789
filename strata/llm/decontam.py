"""Benchmark decontamination with one FM-index per training shard.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one window).
Each task gathers its documents into shards of bounded size. A shard keeps only the word
chains that can hold a window (every neighbouring pair occurs in some window; all others can
hold no occurrence), sorts their suffixes, and stores the Burrows-Wheeler transform in a
wavelet matrix with packed bits and block ranks. All windows are searched backwards at once;
the occurrences of those that remain are located by walking to sampled suffix positions, and
their spans are merged.

Documents are only scanned: no shuffle. The benchmark is cut into blocks of at most about
``block_bytes`` of text, whose windows travel as files; one scan searches a shard for the blocks one after
the other, a task holding one block at a time, and unites their spans and items.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import Scratch

# Fixed by the contract: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z were lower-cased,
# so digits, a-z and every byte of a non-ASCII character.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
SAMPLE = 8            # every 8th text position keeps its place
SHARD_BYTES = 6 << 20  # of text in a shard, about a million words
PAIR_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(_TABLE).split()


class Windows:
    """The windows of a block of benchmark items, as integer codes (0 is any other word)."""

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int):
        self.vocab: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            codes = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(codes) - width + 1) if codes else 0):
                rows.setdefault(tuple(codes[i:i + width]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(r) for r in rows}):
            own = sorted(r for r in rows if len(r) == n)
            self.by_length[n] = (np.array(own, np.int64), [sorted(rows[r]) for r in own])
        size = len(self.vocab) + 1
        long = [m for n, (m, _) in self.by_length.items() if n > 1]
        pairs = [m[:, i] * size + m[:, i + 1] for m in long for i in range(m.shape[1] - 1)]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.pair_hint = np.zeros(1 << PAIR_BITS, bool)
        self.pair_hint[self._slot(self.pairs)] = True
        self.single = np.zeros(size, bool)
        if 1 in self.by_length:
            self.single[self.by_length[1][0][:, 0]] = True
        self.shortest_chain = min((n for n in self.by_length if n > 1), default=0)

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))

    def keep(self, codes: np.ndarray) -> np.ndarray:
        """Mask of the words that some occurrence may cover (``codes`` has a 0 after each document)."""
        mask = self.single[codes]
        if self.shortest_chain and len(codes) > 1:
            pair = codes[:-1] * (len(self.vocab) + 1) + codes[1:]
            good = np.flatnonzero(self.pair_hint[self._slot(pair)])
            at = np.minimum(np.searchsorted(self.pairs, pair[good]), len(self.pairs) - 1)
            good = good[self.pairs[at] == pair[good]]
            linked = np.zeros(len(codes) + 1, np.int8)
            linked[good + 1] = 1
            edge = np.flatnonzero(np.diff(linked))
            starts, ends = edge[0::2], edge[1::2]  # linked pairs start at word ``starts``, end at word ``ends``
            wide = ends - starts + 1 >= self.shortest_chain
            cover = np.zeros(len(codes) + 1, np.int64)
            np.add.at(cover, starts[wide], 1)
            np.add.at(cover, ends[wide] + 1, -1)
            mask = mask | (np.cumsum(cover)[:-1] > 0)
        return mask


class Bits:
    """A bit vector with constant-time rank: packed words and counts before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.total = int(bits.sum())

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; suffixes that run past the end sort first."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(text[order]) != 0)])
    step = 1
    while step < n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        step *= 2
    return order


class FMIndex:
    """FM-index of an integer text: wavelet matrix over the transform, sampled positions."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.concatenate([text + 1, [0]])  # a unique smallest end mark
        order = suffix_order(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.levels: list[tuple[Bits, int]] = []
        self.bit_count = max(1, int(size).bit_length())
        column = bwt
        for level in range(self.bit_count):
            bit = (column >> (self.bit_count - 1 - level)) & 1
            self.levels.append((Bits(bit.astype(np.uint8)), int(len(bit) - bit.sum())))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        sampled = order % SAMPLE == 0
        self.sampled, self.places, self.n = Bits(sampled.astype(np.uint8)), order[sampled], len(text)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i of the transform."""
        start = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bit_count - 1 - level)) & 1).astype(bool)
            a, b = bits.rank(i), bits.rank(start)
            i, start = np.where(one, zeros + a, i - a), np.where(one, zeros + b, start - b)
        return i - start

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bits, zeros in self.levels:
            one, a = bits.get(i), bits.rank(i)
            out = out * 2 + one
            i = np.where(one, zeros + a, i - a)
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: (pattern, low, high) of those that occur."""
        alive = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j] + 1
            low, high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            on = low < high
            alive, low, high = alive[on], low[on], high[on]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows: walk back to a sampled one."""
        out, at, walked = np.zeros(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled.get(at)
            out[todo[done]] = self.places[self.sampled.rank(at[done])] + walked
            todo, at = todo[~done], at[~done]
            c = self.symbol(at)
            at = self.first[c] + self.rank(c, at)
            walked += 1
        return out


def shard_hits(docs: list[np.ndarray], windows: Windows) -> list[tuple[np.ndarray, set[str]]]:
    """Per document (given as word codes): word mask of the hits and the items found."""
    sizes = np.array([len(t) for t in docs], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.zeros(begin[-1], np.int64)
    for b, t in zip(begin, docs):
        codes[b:b + len(t)] = t
    hit = np.zeros(begin[-1] + 1, np.int64)
    found: list[set[str]] = [set() for _ in docs]
    kept = np.flatnonzero(windows.keep(codes)) if len(codes) and windows.by_length else np.zeros(0, np.int64)
    if len(kept):
        gap = np.concatenate([[0], np.cumsum(np.diff(kept) > 1)])  # one 0 between chains
        text = np.zeros(len(kept) + gap[-1], np.int64)
        place = np.arange(len(kept)) + gap
        text[place] = codes[kept]
        word = np.zeros(len(text), np.int64)
        word[place] = kept
        index = FMIndex(text, len(windows.vocab) + 1)
        for n, (patterns, items) in windows.by_length.items():
            which, low, high = index.search(patterns)
            count = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            start = word[index.locate(rows)]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + n, -1)
            pairs = np.unique(np.stack([np.searchsorted(begin, start, "right") - 1, np.repeat(which, count)]), axis=1)
            for d, w in pairs.T:
                found[d].update(items[w])
    mask = np.cumsum(hit)[:-1] > 0
    return [(mask[b:b + n], f) for b, n, f in zip(begin, sizes, found)]


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def _shards(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``SHARD_BYTES`` of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + SHARD_BYTES, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _block_loader(names: list[str]) -> Callable[[int], Windows]:
    """Reads the windows of a block; the one at hand is kept."""
    held: dict[int, Windows] = {}

    def load(b: int) -> Windows:
        if b not in held:
            held.clear()
            with open(SparkFiles.get(names[b]), "rb") as f:
                held[b] = pickle.load(f)
        return held[b]
    return load


def _search(shard: pa.RecordBatch, column: str, blocks: int, load: Callable[[int], Windows]):
    """Per text of a shard the mask of its hit words and the items found, over all blocks."""
    texts = shard.column(shard.schema.get_field_index(column))
    masks: list[np.ndarray] = []
    items: list[set[str]] = []
    for b in range(blocks):
        windows = load(b)
        hits = shard_hits([windows.codes(words_of(t.as_py())) for t in texts], windows)
        if b == 0:
            masks, items = [mask.copy() for mask, _ in hits], [set(found) for _, found in hits]
            continue
        for mask, own, (more, found) in zip(masks, items, hits):
            mask |= more
            own |= found
    return masks, items


def benchmark_blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Windows]:
    """Windows of the benchmark, block by block; only one block is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield Windows([(r["item"], r["text"]) for r in own.collect()], width)


def benchmark_files(benchmark: DataFrame, width: int, block_bytes: int) -> list[str]:
    """Writes the windows of every block as a file that reaches each executor; returns their names."""
    spark = benchmark.sparkSession
    scratch, names = Scratch(spark, "windows"), []
    for windows in benchmark_blocks(benchmark, width, block_bytes):
        names.append(f"windows-{uuid.uuid4().hex}.bin")  # a file name can be registered with one path only
        spark.sparkContext.addFile(scratch.write_bytes(cloudpickle.dumps(windows), names[-1]))
    return names


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20,
                       key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``spans`` (merged runs of hit words, end
    exclusive) and ``items`` (ids of the items found, as strings, sorted).

    Defined cases: NULL and empty texts have no words; an item without words has no window; a
    NULL ``item_id`` counts as the empty id; items with one id are one item; a NULL key stays
    NULL; repeated documents give repeated rows; empty documents give an empty result and an
    empty benchmark hits nothing; other columns are not read.
    """
    names = benchmark_files(benchmark, width, block_bytes)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _block_loader(names)
        spans_type, items_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
        for shard in _shards(batches, "text"):
            masks, items = _search(shard, "text", len(names), load)
            spans = [[{"start": a, "end": b} for a, b in _spans(mask)] for mask in masks]
            yield pa.RecordBatch.from_arrays(
                [shard.column(0), pa.array([len(m) for m in masks], pa.int64()), pa.array(spans, spans_type),
                 pa.array([sorted(i) for i in items], items_type)], names=["key", "n_words", "spans", "items"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        scan, f"key {kind}, n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    return found.withColumnRenamed("key", key)


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """:func:`find_contamination` with counts and a digest instead of lists."""
    found = find_contamination(docs, benchmark, width)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20,
                      text: str = "text") -> DataFrame:
    """The documents without any hit, with all their columns. NULL and empty texts stay, repeated rows
    share their fate; empty documents give an empty result and an empty benchmark keeps all."""
    names = benchmark_files(benchmark, width, block_bytes)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = _block_loader(names)
        for shard in _shards(batches, text):
            masks, _ = _search(shard, text, len(names), load)
            yield shard.filter(pa.array([not mask.any() for mask in masks], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], width: int) -> list[tuple[int, int, str]]:
    """The same by definition, for tests: (n_words, n_hit, items joined) per text."""
    out = []
    for t in texts:
        words = words_of(t)
        mask, found = [False] * len(words), set()
        for item, text in items:
            own = words_of(text)
            n = min(width, len(own))
            wins = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1):
                if wins and tuple(words[i:i + n]) in wins:
                    mask[i:i + n] = [True] * n
                    found.add(item)
        out.append((len(words), sum(mask), ",".join(sorted(found))))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
