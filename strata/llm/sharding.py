"""Sharding by rendezvous hashing, natively.

Every record draws one number per shard from the hash of its key and the shard's number, and goes
to the shard with the smallest ``-ln(u) / weight``. A shard wins in proportion to its weight,
and the draws of the other shards do not change when one is added: records move into the new shard
only, and no more of them than its share. Nothing but the record's own key is looked at, so
assignment is a projection without shuffle.

Slots (a record's place in its shard) come from one range sort of narrow rows over all shards: a
record's place among its task's rows, plus its shard's rows in the tasks before. The sort's last
key tells equal rows apart, so a shard, or one key with a third of all rows, is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.llm.common import Scratch
from strata.operators.joins import join_small

HEX_DIGITS = 13  # of the hash in a draw: 52 bits fit a double


def key_text(key: Column) -> Column:
    """The key as text; NULL is the empty text."""
    return F.coalesce(key.cast("string"), F.lit(""))


def draws(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Array of (draw, shard), one per shard: exponential draws with the weights as rates."""
    text, rates = key_text(key), F.array(*[F.lit(float(w)) for w in weights])

    def draw(shard: Column) -> Column:
        digest = F.md5(F.concat_ws(":", text, F.lit(str(seed)), shard.cast("string")).cast("binary"))
        u = (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** HEX_DIGITS)
        return F.struct((-F.log(u) / F.element_at(rates, shard + 1)).alias("draw"), shard.alias("shard"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), draw)


def _rates(shards: int | Sequence[float]) -> list[float]:
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    return weights


def assign_shards(docs: DataFrame, shards: int | Sequence[float], key: str = "doc_id", seed: int = 0,
                  name: str = "shard") -> DataFrame:
    """``docs`` with an int column ``name``: the record's shard, from 0.

    ``shards`` is their number (equal weights) or their weights, all above 0. Appending a weight
    moves records only into the new shard; raising one moves records only into that shard.

    Defined cases: records with one key share a shard; NULL keys are one key; an existing column
    ``name`` is replaced; an empty table gives an empty result; texts are not read."""
    won = F.array_min(draws(F.col(key), _rates(shards), seed))["shard"].cast("int")
    return docs.withColumn(name, won)


def write_shards(docs: DataFrame, path: str, shards: int | Sequence[float], key: str = "doc_id", seed: int = 0) -> None:
    """Writes every record with all its columns under ``path/shard=N`` as Parquet.

    Adaptive rebalancing splits a shard that is larger than the advisory partition size over several
    files and tasks and joins small ones, so neither a heavy shard nor a hot key is one task."""
    out = assign_shards(docs, shards, key, seed)
    out.hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(path)


def number_slots(rows: DataFrame, scratch: Scratch, order: Sequence[str], shard: str = "shard",
                 name: str = "slot") -> DataFrame:
    """``rows`` with ``name``: the record's place in its shard in the given order, without gaps from 0.

    Rows equal in all of ``order`` get neighbouring places in any order among themselves; let it
    hold every column and reruns agree."""
    narrow = scratch.save(rows, "narrow")
    placed = (narrow.withColumn("_salt", F.monotonically_increasing_id()).orderBy(shard, *order, "_salt")
              .drop("_salt").withColumn("_place", F.monotonically_increasing_id()))
    placed = scratch.save(placed, "placed").withColumn("_task", F.shiftright("_place", 33))
    scratch.drop("narrow")
    # a task's rows of one shard stand together, so there are at most tasks + shards runs
    runs = placed.groupBy(shard, "_task").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (join_small(placed, runs, [shard, "_task"])
            .withColumn(name, F.col("_before") + F.col("_place") - F.col("_first"))
            .drop("_place", "_task", "_first", "_before"))


def shard_report(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per record: the key, ``size`` (UTF-8 bytes of the text and 16), ``text_crc32``, ``law``
    (``key``), ``shard``, ``slot``, and ``grown_shard``, its shard with one shard more.

    Slots follow the hash of the key, then size and checksum. Defined cases: a NULL text has no
    bytes (size 16, checksum 0); NULL keys are one key and share a shard; repeated rows get a
    slot each; an empty table gives an empty result; other columns are not read."""
    scratch = Scratch(docs.sparkSession, "shards")
    every = draws(F.col(key), _rates(shards + 1), seed)
    own = F.coalesce(F.col(text), F.lit(""))
    rows = (docs.select(F.col(key).alias("id"), (F.octet_length(own) + 16).cast("long").alias("size"),
                        F.crc32(own.cast("binary")).alias("text_crc32"), every.alias("_draws"))
            .select("id", "size", "text_crc32",
                    F.array_min(F.slice("_draws", 1, shards))["shard"].cast("int").alias("shard"),
                    F.array_min("_draws")["shard"].cast("int").alias("grown_shard"),
                    F.md5(key_text(F.col("id")).cast("binary")).alias("_hash")))
    numbered = number_slots(rows, scratch, ["_hash", "size", "text_crc32"])
    return numbered.select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                           "grown_shard")
