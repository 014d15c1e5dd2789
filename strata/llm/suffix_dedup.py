"""Removal of repeated byte strings by minimizer anchors and grouping on hashes.

Two suffixes matter to each other only through their first ``WIDTH`` bytes. They are not
sorted (a radix sort would shuffle every byte position) but grouped, in passes over longer and longer
stretches of bytes, and a suffix that is alone in its group after a pass leaves:

1. digit 1 is the ``HEAD`` bytes at an *anchor*. Every window of ``WIDTH`` bytes picks its anchor
   by its own content (the position of the smallest hashed 8-gram among its first ``REACH``
   positions, the last one on ties), so equal windows have equal anchors at equal offsets, and
   only about 2 in ``REACH`` positions are anchors. An anchor alone in its group has no equal
   window anywhere.
2. digit 2 is the *stretch* of an anchor: all bytes of the windows that pick it. Anchors of a
   group that all have one stretch are repeated with all their windows. Where a group holds
   several stretches, one representative of each goes on.
3. the last digit is the whole window, for the windows of those representatives only. Equal
   groups are exactly the repeated windows; a window alone in its group is unique.

Anchors are counted by head and stretch in every batch before they leave the task, so a stretch
shared by a third of all documents is a row per batch in any shuffle. What comes back to the texts are the
*unique* anchors and windows; everything else is repeated. Digits travel as 64-bit hashes (in
pass 1), 128 bits (a stretch with its head) and 96 bits (the last pass).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import Scratch

WIDTH = 200           # bytes of a repeated string
HEAD = 50             # bytes of the first digit
REACH = WIDTH - HEAD  # a window picks its anchor among this many first positions
SEGMENT = 1 << 18     # windows handled at once: longer texts are cut into overlapping segments


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, anchor) of every run of windows that pick one anchor."""
    parts: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        raw = b"".join(r for _, _, r in group)
        n = len(raw)
        grams = np.array(np.ndarray((n - 7,), "<u8", raw, strides=(1,)))
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        low = np.uint64(0xFFFFFFFF)
        best = (grams & ~low) | (low - np.arange(n - 7, dtype=np.uint64))
        width = 1
        while width * 2 <= REACH:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < REACH:
            best = np.minimum(best[:width - REACH], best[REACH - width:])
        pick = (low - (best & low)).astype(np.int64)[:n - WIDTH + 1]
        begin = np.cumsum([0] + [len(r) for _, _, r in group])[:-1]
        # windows that start in the last WIDTH - 1 bytes of a piece would cross into the next one
        valid = np.zeros(len(pick) + 2, np.int8)
        for b, (_, _, r) in zip(begin, group):
            valid[b + 1:b + 2 + len(r) - WIDTH] = 1
        fresh = np.concatenate([[True], pick[1:] != pick[:-1]])
        inside = valid[1:-1].astype(bool)
        first = np.flatnonzero(inside & (fresh | ~valid[:-2].astype(bool)))
        closes = np.concatenate([fresh[1:], [True]]) | ~valid[2:].astype(bool)
        last = np.flatnonzero(inside & closes)
        piece = np.searchsorted(begin, first, "right") - 1
        shift = np.array([o for _, o, _ in group])[piece] - begin[piece]
        parts.append((np.array([t for t, _, _ in group])[piece], first + shift, last + shift, pick[first] + shift))
        group.clear()

    for t, raw in enumerate(raws):
        for o in range(0, max(len(raw) - WIDTH + 1, 0), SEGMENT):
            group.append((t, o, raw[o:o + SEGMENT + WIDTH - 1]))
            size += len(group[-1][2])
            if size >= SEGMENT:
                flush()
                size = 0
    flush()
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts))


def _identity(raw: bytes) -> tuple[int, int]:
    """A text's identity: 64 and 32 bits of its 128-bit hash."""
    h = xxhash.xxh3_128_intdigest(raw)
    return h & 0xFFFFFFFFFFFFFFFF, (h >> 64) & 0xFFFFFFFF


def _raw(text) -> bytes:
    return b"" if text is None else text.encode()


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, stretch, c, t1, loc): the anchors of a batch, counted by head and stretch, with one
    place each; loc holds 32 bits of the identity and the run's first window."""
    for batch in batches:
        raws = [r for r in map(_raw, batch.column(0).to_pylist()) if len(r) >= WIDTH]
        if not raws:
            continue
        ids = np.array([_identity(r) for r in raws], np.uint64).reshape(-1, 2)
        text, first, last, pick = anchors(raws)
        digest = xxhash.xxh3_64_intdigest
        head = np.fromiter((digest(raws[t][p:p + HEAD]) for t, p in zip(text.tolist(), pick.tolist())), np.uint64, len(text))
        stretch = np.fromiter((digest(raws[t][a:b + WIDTH]) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist())),
                              np.uint64, len(text))
        loc = (ids[text, 1] << np.uint64(32)) | first.astype(np.uint64)
        order = np.lexsort((loc, ids[text, 0], stretch, head))
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(head[order]) != 0) | (np.diff(stretch[order]) != 0)])[:len(order)])
        one = order[fresh]
        count = np.diff(np.append(fresh, len(order)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(_signed(head[one])), pa.array(_signed(stretch[one])), pa.array(count, pa.int64()),
             pa.array(_signed(ids[text[one], 0])), pa.array(_signed(loc[one]))], names=["head", "stretch", "c", "t1", "loc"])


def _packed_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t1, t2, z): identity and compressed bytes of every row's text."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raws = list(map(_raw, batch.column(1).to_pylist()))
        ids = np.array([_identity(r) for r in raws], np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(_signed(ids[:, 0])), pa.array(_signed(ids[:, 1])),
             pa.array([pack.compress(r) for r in raws], pa.binary())], names=["key", "t1", "t2", "z"])


def _groups(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Rows (compressed text, ...) in groups of about SEGMENT bytes, column by column, with their texts' bytes."""
    unpack, own, size = zstandard.ZstdDecompressor(), [], 0
    for row in rows:
        own.append((unpack.decompress(row[0]), *row[1:]))
        size += len(own[-1][0])
        if size >= SEGMENT:
            yield tuple(zip(*own))
            own, size = [], 0
    if own:
        yield tuple(zip(*own))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The numbers first[0]..last[0], first[1]..last[1], ... in one array."""
    sizes = last - first + 1
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _window_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, rid, lo, m) of the windows of the representatives' stretches: 96 bits of hash, the
    text's number and the window, and m = 2 where the stretch itself is repeated."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for raws, rids, reps in _groups(zip(*(batch.column(i).to_pylist() for i in (1, 0, 2)))):
            text, first, last, _ = anchors(raws)
            wanted = {(t, r["lo"]): r["m"] for t, own in enumerate(reps) for r in own}
            m = np.fromiter((wanted.get(x, 0) for x in zip(text.tolist(), first.tolist())), np.int32, len(text))
            hit = np.flatnonzero(m)
            text, first, last, m = text[hit], first[hit], last[hit], m[hit]
            starts, sizes = _ranges(first, last), last - first + 1
            w = np.frombuffer(b"".join([digest(raws[t][s:s + WIDTH]) for t, a, b in zip(text.tolist(), first.tolist(), last.tolist())
                                        for s in range(a, b + 1)]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[:, 0]), pa.array(w[:, 1].astype(np.int32)), pa.array(np.repeat(np.array(rids, np.int64)[text], sizes)),
                 pa.array(starts.astype(np.int32)), pa.array(np.repeat(m, sizes))], names=["w1", "w2", "rid", "lo", "m"])


def repeated_spans(raws: list[bytes], unique_runs: list, unique_windows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal byte runs covered by repeated windows, text by text."""
    n = np.array([max(len(r) - WIDTH + 1, 0) for r in raws], np.int64)
    base = np.cumsum(n + 1) - n - 1  # all windows in a row, one cell behind those of each text
    at = [np.repeat(base, [len(x or ()) for x in own]) + np.fromiter((v for x in own for v in x or ()), np.int64)
          for own in (unique_runs, unique_windows)]
    text, first, last, _ = anchors(raws)
    known = np.zeros(int((n + 1).sum()), bool)
    known[at[0]] = True
    known = known[base[text] + first]
    edge = np.zeros(int((n + 1).sum()) + 1, np.int8)
    edge[(base[text] + first)[known]] = 1
    edge[(base[text] + last)[known] + 1] -= 1
    unique = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    unique[at[1]] = True
    unique[base + n] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[1], unique.astype(np.int8)])))
    start, end = edge[0::2], edge[1::2] + WIDTH - 1
    text = np.searchsorted(base, start, "right") - 1
    # runs of one text that touch or overlap are one
    opens = np.concatenate([[True], (np.diff(text) != 0) | (start[1:] > end[:-1])])[:len(start)]
    closes = np.append(opens[1:], True)[:len(start)]
    return text[opens], (start - base[text])[opens], (end - base[text])[closes]


def _finish(batches: Iterable[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for raws, runs, windows in _groups(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
            text, start, end = repeated_spans(raws, runs, windows)
            offsets = np.searchsorted(text, np.arange(len(raws) + 1))
            kept = []
            for raw, i, j in zip(raws, offsets[:-1].tolist(), offsets[1:].tolist()):
                if i < j:
                    raw = b"".join(raw[a:b] for a, b in zip([0, *end[i:j].tolist()], [*start[i:j].tolist(), len(raw)]))
                kept.append(raw)
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(done, len(raws)), pa.array([len(r) for r in raws], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                 pa.array(kept if with_bytes else [None] * len(kept), pa.binary())],
                names=["key", "n_bytes", "spans", "kept_sha256", "kept"])
            done += len(raws)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``spans`` (removed byte runs, end exclusive),
    ``kept_sha256`` and, if asked for, ``kept`` (the remaining bytes).

    A byte is removed if a ``WIDTH``-byte string that covers it also starts anywhere else, in the
    same document or another one; strings are judged on the input.

    Defined cases: NULL and empty texts have no bytes; texts under ``WIDTH`` bytes lose nothing;
    equal rows are copies of each other and lose everything; NULL and repeated keys are
    returned as they are; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    all_anchors = docs.select(F.col(text).alias("text")).mapInArrow(
        _anchor_rows, "head long, stretch long, c long, t1 long, loc long")
    lo = F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("lo")
    t2 = F.shiftrightunsigned("loc", 32).alias("t2")
    # pass 1: heads. In a group of one the minima are its only row.
    heads = all_anchors.groupBy("head").agg(F.sum("c").alias("c"), F.min("t1").alias("t1"), F.min("loc").alias("loc"))
    one = F.col("c") == 1
    heads = scratch.save(heads.select(F.when(~one, F.col("head")).alias("h"), F.when(one, F.col("t1")).alias("t1"),
                                      F.when(one, F.col("loc")).alias("loc")), "heads")
    alone = (heads.where("h is null").select("t1", t2, lo).groupBy(F.col("t1").alias("r1"), F.col("t2").alias("r2"))
             .agg(F.collect_list("lo").alias("runs")))
    alone = scratch.save(alone, "alone")
    shared = scratch.save(heads.where("h is not null").select("h"), "shared")
    scratch.drop("heads")
    # pass 2: stretches of shared heads
    stretches = scratch.save(all_anchors.join(shared, F.col("head") == F.col("h")).groupBy("head", "stretch").agg(
        F.sum("c").alias("c"), F.min(F.struct("t1", "loc")).alias("rep")), "stretches")
    several = stretches.groupBy(F.col("head").alias("h")).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    reps = (stretches.join(several, F.col("head") == F.col("h"))
            .select("rep.t1", "rep.loc", F.least("c", F.lit(2)).cast("int").alias("m"))
            .groupBy("t1", t2).agg(F.collect_list(F.struct(lo, F.col("m"))).alias("reps")))
    # a short number per text instead of its identity: it stays fixed once the table is written
    reps = reps.select(F.monotonically_increasing_id().alias("rid"), F.col("t1").alias("r1"), F.col("t2").alias("r2"), "reps")
    reps = scratch.save(reps, "reps")
    kind = docs.schema[key].dataType.simpleString()
    packed = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _packed_rows, f"key {kind}, t1 long, t2 long, z binary")
    # last pass: whole windows
    windows = (packed.join(reps, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")))
               .select("rid", "z", "reps").mapInArrow(_window_rows, "w1 long, w2 int, rid long, lo int, m int"))
    once = windows.groupBy("w1", "w2").agg(F.sum("m").alias("c"), F.min("rid").alias("rid"), F.min("lo").alias("lo")).where("c = 1")
    once = once.groupBy("rid").agg(F.collect_list("lo").alias("windows")).join(reps.select("rid", "r1", "r2"), "rid").drop("rid")
    once = scratch.save(once, "once")
    scratch.drop("stretches", "reps")
    unique = alone.join(once, ["r1", "r2"], "full")
    both = packed.join(unique, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")), "left")
    out = both.select("key", "z", "runs", "windows").mapInArrow(
        lambda it: _finish(it, with_bytes),
        f"key {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("key", key)
    return out if with_bytes else out.drop("kept")


def repeats_report(docs: DataFrame) -> DataFrame:
    """:func:`remove_repeats` with counts instead of the spans."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", n_removed.alias("n_removed"),
                                       F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute_force(raws: list[bytes]) -> list[list[tuple[int, int]]]:
    """The same by definition, for tests: removed byte runs per text."""
    count: dict[bytes, int] = {}
    for r in raws:
        for s in range(len(r) - WIDTH + 1):
            count[r[s:s + WIDTH]] = count.get(r[s:s + WIDTH], 0) + 1
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, np.int64)
        for s in range(len(r) - WIDTH + 1):
            if count[r[s:s + WIDTH]] > 1:
                hit[s] += 1
                hit[s + WIDTH if s + WIDTH < len(hit) else -1] -= 1
        cover = (np.cumsum(hit)[:-1] if len(r) else np.zeros(0)) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
        out.append(list(zip(edge[0::2].tolist(), edge[1::2].tolist())))
    return out
