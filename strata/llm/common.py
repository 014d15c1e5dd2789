"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.sources.sinks import shared_scratch

# Fixed by the contract: white space that separates words.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written once under the session's shared checkpoint folder and read back.

    Like a reliable checkpoint this cuts the lineage: a lost executor re-reads files
    instead of recomputing. :meth:`clear` removes what was written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_scratch(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def hadoop_path(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def write_bytes(self, data: bytes, name: str) -> str:
        """One small file under the shared folder; returns its full path."""
        fs, p = self.hadoop_path(f"{self.base}/{name}")
        out = fs.create(p)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return p.toString() if ":" in p.toString() else fs.makeQualified(p).toString()

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self.hadoop_path(f"{self.base}/{name}")
            fs.delete(p, True)

    def clear(self) -> None:
        fs, p = self.hadoop_path(self.base)
        fs.delete(p, True)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, in every locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; NULL keys fall in the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int) -> DataFrame:
    """(id, text, y) of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hashes of their ids, so the sample is the same on
    every run. Its ids are broadcast (bounded by ``max_rows``). Contradicting labels of one id
    are averaged; NULL labels and ids are left out; of several texts with one id the smallest
    is taken."""
    ids = (labels.select(F.col("doc_id").alias("i"), F.col(label).alias("l"))
           .where(F.col("l").isNotNull() & F.col("i").isNotNull() & (fold(F.col("i"), folds) != held))
           .groupBy("i").agg((F.avg("l") >= 0.5).cast("int").alias("y"))
           .orderBy(F.xxhash64("i"), "i").limit(max_rows))
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return (own.join(F.broadcast(ids), F.col("id") == F.col("i"))
            .groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))
