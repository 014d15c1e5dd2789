"""Mixing sources to target weights, natively.

Each document gets a hash-random key. Within a source, documents are taken in the order of
their keys until the source's budget is used up, after whole epochs if the budget is more
than the source holds. The order is never materialised as one sort per source: the key's
first hex digits are a range, sizes are pre-aggregated per (source, range), a prefix sum over
the ranges finds the one range that holds the cut, and only that range's documents are
summed one by one. A document then compares its key with its source's cut, so a source with
a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strata.llm.common import Scratch, word_count

RANGE_DIGITS = (2, 4)  # nested key ranges: 256 per source, then 256 in each of those


def mix_key(doc: Column, seed: int) -> Column:
    """Hash-random order key: 32 hex digits."""
    return F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: the sources in code point order (NULL
    last) weigh ``weights`` in turn and share ``share`` of all sizes. A source's target stops
    at ``cap`` times its size; the excess goes to the others by weight.

    Water filling in closed form: in ascending order of cap/weight, a source is capped while
    its cap is below its part of what the ones before it left. The table has one row per
    source, so its single-partition windows stay small."""
    order = W.orderBy(F.col("source").isNull(), "source")
    k = len(weights)
    t = (sizes.withColumn("rn", F.row_number().over(order))
         .withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                                            ((F.col("rn") - 1) % k + 1).cast("int")))
         .withColumn("cap", F.lit(float(cap)) * F.col("source_size")))
    ranked = W.orderBy(F.col("cap") / F.col("weight"), "rn")
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    after = ranked.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = (t.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
         .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.sum("weight").over(after))
         .withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
         .withColumn("place", F.row_number().over(ranked)))
    first_open = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(every)
    return (t.withColumn("final_level", first_open["level"])
            .select("source", "source_size",
                    F.when(F.col("capped"), F.col("cap"))
                    .otherwise(F.col("final_level") * F.col("weight")).alias("target")))


def _cut_range(table: DataFrame, at: DataFrame, digits: int) -> DataFrame:
    """``at`` (s, inside, left): per source the key range that holds the cut and the words left to
    take in it. Returns the range of ``digits`` digits inside it that holds the cut, with its size
    ``n``. A source's prefix sum runs over the ranges inside one range only."""
    known = F.length("inside")
    own = (table.join(at.select("s", "inside", "left"), F.col("source").eqNullSafe(F.col("s"))
                      & (F.col("key").substr(F.lit(1), known) == F.col("inside")))
           .groupBy("s", "left", F.substring("key", 1, digits).alias("inside"))
           .agg(F.sum("size").alias("n"), F.sum("rows").alias("rows")))
    upto = F.sum("n").over(W.partitionBy("s").orderBy("inside"))
    return (own.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
            .where((F.col("upto") >= F.col("left")) & (F.col("below") < F.col("left")))
            .select("s", "inside", (F.col("left") - F.col("below")).alias("left"), "n", "rows"))


def mix_plan(narrow: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """One row per source: size, target, whole epochs and the cut of the last one.

    ``narrow`` has ``source``, ``key``, ``size``. The cut is the key whose document is taken
    in part (``cut_left`` of its ``cut_size`` words); documents with smaller keys are taken
    whole, later ones not at all."""
    ranges = scratch.save(narrow.groupBy("source", F.substring("key", 1, RANGE_DIGITS[-1]).alias("key"))
                          .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "ranges")
    sizes = ranges.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = (targets.withColumn("epochs", epochs.cast("long"))
               .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    targets = scratch.save(targets, "targets")
    # down the nested ranges: at each level only the range that holds the cut is looked into
    at = targets.select(F.col("source").alias("s"), F.lit("").alias("inside"), F.col("rest").alias("left"))
    for digits in (*RANGE_DIGITS, 32):
        table = narrow.withColumn("rows", F.lit(1).cast("long")) if digits == 32 else ranges
        at = scratch.save(_cut_range(table, at, digits), f"cut_{digits}")  # one row per source
    cut = at.select("s", F.col("inside").alias("cut_key"), F.col("n").alias("cut_size"), F.col("left").alias("cut_left"),
                    F.col("rows").alias("cut_rows"))
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return scratch.save(plan, "plan")


def taken_words(size: Column, key: Column, prefix: str = "") -> Column:
    """Words the mix takes of a document, repeats counted, from its source's plan row. The document at
    the cut, if it is the only one there, gives what is left."""
    cut_key = F.col(f"{prefix}cut_key")
    part = F.when(key < cut_key, size).when(key == cut_key, F.col(f"{prefix}cut_left")).otherwise(F.lit(0))
    return (F.col(f"{prefix}epochs") * size + F.coalesce(part, F.lit(0))).cast("long")


def shared_cut(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (``s``, ``size``, ``order``, ``payload``, and the plan's ``epochs``, ``cut_left``, ``cut_size``)
    that share their source's cut key, with ``taken``.

    With running sums S of the sizes, a row gets floor(left S / n) less the same of the row before: the
    parts add up to ``left`` exactly and none exceeds its row. The running sums come from one range
    sort of all such rows, added up per task and over the tasks, so one key with a third of all
    rows is spread. Equal rows are interchangeable."""
    sorted_ = (rows.withColumn("_salt", F.monotonically_increasing_id()).orderBy("s", "size", "order", "_salt").drop("_salt")
               .withColumn("_at", F.monotonically_increasing_id()))
    sorted_ = scratch.save(sorted_, "cut_rows").withColumn("_task", F.shiftright("_at", 33))
    parts = sorted_.groupBy("s", "_task").agg(F.sum("size").alias("_n"))
    earlier = W.partitionBy("s").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("s").alias("_s"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    parts = scratch.save(parts, "cut_parts")
    within = W.partitionBy("s", "_task").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = (sorted_.join(parts, F.col("s").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
           .withColumn("_upto", F.col("_before") + F.sum("size").over(within)))
    share = lambda upto: F.expr(f"cast(cut_left as decimal(19)) * cast({upto} as decimal(19)) div cut_size")
    return out.withColumn("taken", (F.col("epochs") * F.col("size") + share("_upto") - share("(_upto - size)")).cast("long")
                          ).drop("_at", "_task", "_s", "_t", "_before", "_upto")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``taken``. Reruns agree, whatever the partitioning.

    Defined cases: a NULL or empty text has size 0 and is taken 0 times; a NULL source is a
    source of its own, last in order; rows with the same key share one place in the order,
    and at the cut they share its words in proportion to their sizes, without a word lost to
    rounding; NULL keys count as one such key; an empty table gives an empty result; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = scratch.save(docs.select(F.col(key).alias("id"), F.col(source).alias("source"),
                                      word_count(F.col(text)).alias("size"),
                                      mix_key(F.col(key), seed).alias("key")), "narrow")
    plan = mix_plan(narrow, scratch, weights, share, cap).withColumnRenamed("source", "s")
    rows = narrow.join(plan, F.col("source").eqNullSafe(F.col("s")))
    columns = [F.col("id").alias(key), F.col("source").alias(source), "size", F.col("source_size"), "target", "taken"]
    if plan.where("cut_rows > 1").isEmpty():
        return rows.withColumn("taken", taken_words(F.col("size"), F.col("key"))).select(*columns)
    crowded = F.coalesce((F.col("cut_rows") > 1) & (F.col("key") == F.col("cut_key")), F.lit(False))
    alone = rows.where(~crowded).withColumn("taken", taken_words(F.col("size"), F.col("key"))).select(*columns)
    tied = rows.where(crowded).withColumn("order", F.xxhash64("id"))
    return alone.unionByName(shared_cut(tied, scratch).select(*columns))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                    seed: int = 0) -> DataFrame:
    """The documents the mix takes anything of, with all their columns and ``mix_size``,
    ``mix_target``, ``mix_taken``. The plan (one row per source) is joined to the scan; only rows
    that share their source's cut key are sorted.

    Defined cases as in :func:`mix_sources`; columns named like the new ones are replaced; documents of
    which nothing is taken (empty ones among them) go; an empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "mix")
    size, key = word_count(F.col("text")), mix_key(F.col("doc_id"), seed)
    narrow = scratch.save(docs.select(F.col("source").alias("source"), size.alias("size"), key.alias("key")), "narrow")
    plan = mix_plan(narrow, scratch, weights, share, cap)
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    new = ("mix_size", "mix_target", "mix_taken")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    # the row travels as one struct, so its columns cannot clash with the working ones
    rows = (docs.select(F.struct(*own).alias("_mix_row"), F.col("source").alias("_mix_own"), size.alias("mix_size"),
                        key.alias("_mix_key"))
            .join(plan, F.col("_mix_own").eqNullSafe(F.col("_mix_source")))
            .withColumn("mix_target", F.col("_mix_target")))
    take = taken_words(F.col("mix_size"), F.col("_mix_key"), "_mix_")
    if plan.where("_mix_cut_rows > 1").isEmpty():
        return rows.withColumn("mix_taken", take).where("mix_taken > 0").select("_mix_row.*", *new)
    crowded = F.coalesce((F.col("_mix_cut_rows") > 1) & (F.col("_mix_key") == F.col("_mix_cut_key")), F.lit(False))
    alone = rows.where(~crowded).withColumn("mix_taken", take)
    tied = rows.where(crowded).select(
        F.col("_mix_own").alias("s"), F.col("mix_size").alias("size"), F.xxhash64("_mix_row").alias("order"), "_mix_row", "mix_size",
        "mix_target", *[F.col(f"_mix_{c}").alias(c) for c in ("epochs", "cut_left", "cut_size")])
    both = alone.select("_mix_row", *new).unionByName(
        shared_cut(tied, scratch).withColumnRenamed("taken", "mix_taken").select("_mix_row", *new))
    return both.where("mix_taken > 0").select("_mix_row.*", *new)
