"""N-gram Jaccard join with set-relation skipping.

Documents are sets of hashed word shingles; equal sets form one class and are joined once.

*Index lists.* Shingles have one global order: those that are frequent (seen several times in
one task's chunk; a bounded table of the most frequent ones, written once) come last, by count;
all others come first, by hash. A set's prefix is its first ``n - ceil(t n) + 1`` shingles; sets that
link share a shingle of their prefixes. The order decides the cost only, never the result.

*Answers of the leader.* Each list has a leader: its member that stands in the most lists. Every list member is compared
with its leaders: first by parity bitmaps (bits that differ bound the sets' difference from
below, so the overlap from above), then, where that bound allows a link, by the exact overlap of
the full sets. What these links connect needs no further look: a group of near copies costs about
one comparison per member, not one per pair.

*Skipping blocks by position.* Lists whose members are not all connected are looked at again, in
blocks by set size. A shingle at position ``i`` of a set of ``n``, if it is the first one that two sets
share, leaves at most ``n - i`` to share, so it rules out partners above a size ``(n - i)(1 + t) / t - n``.
A member meets only blocks of sizes from its own up to that; late positions, where the frequent
shingles stand, meet none. Both sides' limits are then checked pair by pair.

*Deriving.* Each member has one leader x, the one it shares most with, and that overlap is kept once.
The answers of x give a bound for every member y: ``|y and z| <= |x and z| + |y - x|``, from either
side. Only pairs that this allows are compared, like members with their leaders.

The links are closed to components by written rounds. Nothing but counts and the bounded table of
frequent shingles reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import Scratch
from strata.llm.components import components

CHUNK = 2_000_000      # shingles counted at once by a task
SEEN = 2               # frequent: seen so often in one chunk
FREQUENT = 1 << 18     # shingles in the table of the most frequent ones
HINT_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased (both are the ASCII rules of bytes)."""
    return [] if text is None else text.encode().lower().split()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    words = words_of(text)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[j:j + n]
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


class Frequent:
    """Counts of the frequent shingles, with a bit table in front."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]
        self.hint = np.zeros(1 << HINT_BITS, bool)
        self.hint[(self.shingles >> np.uint64(64 - HINT_BITS)).astype(np.int64)] = True

    def prefix(self, own: np.ndarray, size: int) -> np.ndarray:
        """The first ``size`` shingles of a sorted set in the global order."""
        maybe = np.flatnonzero(self.hint[(own >> np.uint64(64 - HINT_BITS)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingles, own[maybe]), len(self.shingles) - 1)
            hit = self.shingles[at] == own[maybe]
            late, at = maybe[hit], at[hit]
            rare = np.delete(own, late)
            if len(rare) < size:
                order = np.lexsort((own[late], self.counts[at]))
                return np.concatenate([rare, own[late[order]]])[:size]
            return rare[:size]
        return own[:size]


def bitmap(own: np.ndarray) -> bytes:
    """Parity bitmap: bit b is the parity of the shingles that fall on it; at least 2n bits."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 64
    parity = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """Largest overlap that two sets with these bitmaps can have."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]  # fold: parities of fewer, wider bits
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    differ = int(np.bitwise_count(x ^ y).sum())
    return min(na, nb, (na + nb - differ) // 2)


def _frequent_rows(k: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            own, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= SEEN
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(own[often].view(np.int64)), pa.array(n[often].astype(np.int64))],
                                              names=["sh", "c"])

        size = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), k))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()
    return count


def _set_rows(k: int, percent: int, frequent):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        for batch in batches:
            n, s1, s2, prefix, maps = [], [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), k)
                sig = xxhash.xxh3_128_intdigest(own.tobytes())
                n.append(len(own))
                s1.append(sig & 0xFFFFFFFFFFFFFFFF)
                s2.append(sig >> 64)
                size = len(own) + 1 + (-percent * len(own)) // 100 if len(own) else 0  # n - ceil(t n) + 1
                prefix.append(table.prefix(own, size).view(np.int64))
                maps.append(bitmap(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(s1, np.uint64).view(np.int64)),
                 pa.array(np.array(s2, np.uint64).view(np.int64)), pa.array(prefix, pa.list_(pa.int64())),
                 pa.array(maps, pa.binary())],
                names=["id", "n", "s1", "s2", "prefix", "bitmap"])
    return rows


def _full_rows(k: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingle_set(t.as_py(), k).tobytes() for t in batch.column(1)], pa.binary())],
                names=["id", "full"])
    return rows


def _bound_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, ma, mb = (batch.column(i).to_pylist() for i in range(6))
        hi = [overlap_bound(*x) for x in zip(ma, mb, na, nb)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hi, pa.int64())], names=["a", "b", "na", "nb", "hi"])


def _overlap_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        both = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = x.as_py(), y.as_py()
            if known[0] != x:
                known = (x, np.frombuffer(x, np.uint64))
            both.append(len(np.intersect1d(known[1], np.frombuffer(y, np.uint64), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64())], names=["a", "b", "both"])


def _compare(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """(a, b, na, nb, lo, hi) of the pairs (a, b): overlaps, exact (lo = hi) wherever a link is possible."""
    side = lambda p, i: reps.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("bitmap").alias(f"m{i}"))
    wide = pairs.join(side(reps, "a"), "a").join(side(reps, "b"), "b").select("a", "b", "na", "nb", "ma", "mb")
    bound = scratch.save(wide.mapInArrow(_bound_rows, "a long, b long, na long, nb long, hi long"), f"{name}_bound")
    open_ = bound.where(F.col("hi") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    ids = scratch.save(open_.select(F.col("a").alias("i")).union(open_.select(F.col("b").alias("i"))).distinct(), f"{name}_ids")
    full = scratch.save(_full_sets(ids, docs, k), f"{name}_full")
    both = (open_.select("a", "b").join(full.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b")
            .join(full.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
            .select("a", "b", "fa", "fb").mapInArrow(_overlap_rows, "a long, b long, both long")
            .groupBy("a", "b").agg(F.max("both").alias("both")))
    out = bound.join(both, ["a", "b"], "left").select(
        "a", "b", "na", "nb", F.coalesce("both", F.lit(0)).alias("lo"), F.coalesce("both", "hi").alias("hi"))
    out = scratch.save(out, f"{name}_out")
    scratch.drop(f"{name}_full", f"{name}_bound")
    return out


def _full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, full) of the documents in ``ids`` (i)."""
    return (docs.join(ids, F.col("id") == F.col("i")).select("id", "text")
            .mapInArrow(_full_rows(k), "id long, full binary"))


def _skipped_pairs(shared: DataFrame, known: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of lists whose members are not all connected, not connected themselves, that sizes
    and positions allow. ``a`` is the smaller set."""
    block = lambda size: F.floor(F.log(size.cast("double")) / math.log(100 / percent))
    # the largest partner that a first shared shingle at this position allows
    most = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent).cast("long") - F.col("n")
    rows = (shared.join(known, "id", "left")
            .select("sh", "id", "n", F.coalesce("component", "id").alias("comp"), most.alias("most")))
    rows = scratch.save(rows, "placed")
    mixed = rows.groupBy("sh").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("sh")
    rows = scratch.save(rows.join(mixed, "sh"), "mixed")
    scratch.drop("placed")
    small = rows.where("most >= n").select(
        "sh", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "comp", "most")],
        # one block more at the end: the logarithm may fall on either side of a block's border
        F.explode(F.sequence(block(F.col("n")), block(F.col("most")) + 1)).alias("block"))
    large = rows.select("sh", *[F.col(c).alias(f"z_{c}") for c in ("id", "n", "comp", "most")], block(F.col("n")).alias("block"))
    ordered = (F.col("y_n") < F.col("z_n")) | ((F.col("y_n") == F.col("z_n")) & (F.col("y_id") < F.col("z_id")))
    fits = (F.col("z_n") <= F.col("y_most")) & (F.col("y_n") <= F.col("z_most"))
    return (small.join(large, ["sh", "block"]).where(ordered & fits & (F.col("y_comp") != F.col("z_comp")))
            .select(F.col("y_id").alias("a"), F.col("z_id").alias("b"), F.col("y_n").alias("na"), F.col("z_n").alias("nb")).distinct())


def _derived_pairs(pairs: DataFrame, answers: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that the answers of the members' leaders neither settle nor rule out."""
    # one leader per member: the one it shares most with
    best = (answers.where("lo > 0").groupBy("b").agg(F.max(F.struct("lo", (-F.col("a")).alias("less"))).alias("top"))
            .select(F.col("b").alias("member"), (-F.col("top.less")).alias("lead"), F.col("top.lo").alias("own")))
    best = scratch.save(best, "best")
    given = answers.select(F.col("a").alias("lead"), F.col("b").alias("other"), "hi")
    for side, partner in (("a", "b"), ("b", "a")):
        one = pairs.join(best.withColumnRenamed("member", side), side, "left")
        # the leader itself as partner: their overlap is what the member keeps
        one = one.join(given.withColumnRenamed("other", partner), ["lead", partner], "left")
        derived = F.when(F.col("lead") == F.col(partner), F.col("own")).otherwise(F.col("hi") + F.col(f"n{side}") - F.col("own"))
        allowed = derived.isNull() | (derived * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
        pairs = scratch.save(one.where(allowed).select("a", "b", "na", "nb"), f"derived_{side}")
    seen = answers.select("a", "b").union(answers.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return scratch.save(pairs.select("a", "b").join(seen, ["a", "b"], "left_anti"), "rest")


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(F.col("lo") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def jaccard_components(documents: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``: the smallest id reachable
    over links of ``100 * intersection >= percent * union``.

    Defined cases: a text with fewer than ``k`` words is one shingle; NULL and empty texts have no
    shingles and link with nothing; rows with one id are one document with the links of each of
    them; rows with a NULL id link with nothing and have a NULL component; equal texts link; an
    empty table gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    top = (docs.select("text").mapInArrow(_frequent_rows(k), "sh long, c long").groupBy("sh").agg(F.sum("c").alias("c"))
           .orderBy(F.desc("c"), "sh").limit(FREQUENT))
    rows = scratch.save(top, "frequent").toPandas()  # at most FREQUENT rows
    frequent = spark.sparkContext.broadcast(Frequent(rows["sh"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)))
    kind = "id long, n long, s1 long, s2 long, prefix array<long>, bitmap binary"
    sets = scratch.save(docs.mapInArrow(_set_rows(k, percent, frequent), kind), "sets")
    members = scratch.save(sets.select("id", "n", "s1", "s2"), "rows")
    # classes of equal sets; the smallest id stands for the class
    classes = scratch.save(members.where("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("id").alias("rep")), "classes")
    full = (sets.join(classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep"),
                      (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("id") == F.col("rep")))
            .groupBy("id", "s1", "s2").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "bitmap")]))
    full = scratch.save(full.drop("s1", "s2"), "classes_full")
    scratch.drop("sets")
    # index lists of two and more; each is led by its member that stands in the most lists (in a
    # group of near copies: the one with the fewest edits), the smallest id on ties
    postings = full.select("id", "n", F.posexplode("prefix").alias("pos", "sh"))
    lists = postings.groupBy("sh").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sh")
    shared = scratch.save(postings.join(lists, "sh"), "shared")
    reps = scratch.save(full.select("id", "n", "bitmap"), "reps")
    scratch.drop("classes_full")
    placed = shared.join(shared.groupBy("id").agg(F.count(F.lit(1)).alias("rank")), "id")
    leads = placed.groupBy("sh").agg(F.max(F.struct("rank", (-F.col("id")).alias("less"))).alias("top"))
    pairs = (shared.join(leads.select("sh", (-F.col("top.less")).alias("lead")), "sh").where("id <> lead")
             .select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    answers = _compare(scratch.save(pairs, "pairs"), reps, docs, k, percent, scratch, "lead")
    scratch.drop("pairs")
    links = _links(answers, percent)
    known = components(links, scratch, "first")
    pairs = scratch.save(_skipped_pairs(shared, known, percent, scratch), "open")
    scratch.drop("shared", "mixed")
    rest = _derived_pairs(pairs, answers, percent, scratch)
    scratch.drop("open", "derived_a", "derived_b", "best")
    found = _compare(rest, reps, docs, k, percent, scratch, "rest")
    # rows with one id and several sets are one document: their classes are one component
    several = (members.where("id is not null").groupBy("id")
               .agg(F.min(F.struct("n", "s1", "s2")).alias("low"), F.max(F.struct("n", "s1", "s2")).alias("high"))
               .where("low <> high").select(F.col("id").alias("same")))
    owned = scratch.save(members.where("n > 0").join(several, F.col("id") == F.col("same")).join(classes, ["s1", "s2"])
                         .select("id", "rep").distinct(), "owned")
    home = scratch.save(owned.groupBy("id").agg(F.min("rep").alias("home")), "home")
    ties = owned.join(home, "id").where("rep <> home").select(F.col("home").alias("a"), F.col("rep").alias("b"))
    comp = components(links.union(_links(found, percent)).union(ties), scratch, "all")
    out = (members.join(classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep"),
                        (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
           .join(home.withColumnRenamed("id", "same"), F.col("id") == F.col("same"), "left")
           .withColumn("rep", F.coalesce("rep", "home"))
           .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                     F.coalesce("component", "rep", "id").alias("component_id"))
    done = Scratch(spark, "jaccard-result").save(out, "components")
    scratch.clear()
    return done


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """One row of each component stays, with all its columns: the one with the smallest id.

    Defined cases: rows with one id are one document, of which the smallest row stays; a row with a
    NULL id takes part under a key of its own contents, above all usual ids, so it goes if it
    is a copy of a row with an id or of an equal row; texts without words stay, once per id; an empty
    table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "near-copies")
    own = [F.col(f"`{c}`") for c in docs.columns]
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(*own), F.lit(1 << 61))
    keyed = docs.select(F.struct(*own).alias("row"), F.coalesce(F.col(f"`{key}`").cast("long"), stand_in).alias("id"),
                        F.col("`text`").alias("text"))
    found = jaccard_components(keyed.select("id", "text"), k, percent, "id")
    fate = scratch.save(found.groupBy("id").agg(F.min("component_id").alias("home"), F.count(F.lit(1)).alias("rows")), "fate")
    gone = scratch.save(fate.where("id <> home").select("id"), "gone")
    several = scratch.save(fate.where("id = home and rows > 1").select("id"), "several")
    kept = keyed.join(gone, "id", "left_anti").select("id", "row")
    if several.isEmpty():
        return kept.select("row.*")
    one = (kept.join(several, "id").groupBy("id").agg(F.min("row").alias("row")).select("row.*"))
    return kept.join(several, "id", "left_anti").select("row.*").unionByName(one)


def brute_force(texts: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """The same by definition, for tests: id -> (n_shingles, component_id)."""
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in texts}

    def root(i: int) -> int:
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and min(len(sets[x]), len(sets[y])) * 100 >= percent * max(len(sets[x]), len(sets[y])):
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((root(x), root(y)))
                    comp[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}
