"""Filter interaction audit by contingency tensors.

Filters that run one after the other hide each other's work: what one removes, a later one no
longer sees. Whether a document fails each of ``k`` filters is one cell of a 2 x ... x 2 table;
Spark counts the cells per part, and everything that any order of the filters would show is a
contraction of that table: along each axis a step selects pass, fail or all.

The texts are read once. Equal texts meet by a digest: the smallest id per digest comes from a
pre-aggregated grouping, and rows find out whether they are it by a join on digest and id together,
so a group of copies with a third of all rows is spread by its ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm.common import Scratch

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)  # what a step selects along an axis
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text (NULL is empty), as boolean columns."""
    own = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size("_words"), F.size(F.array_distinct("_words"))
    return {"_words": words, "A": n < 200, "B": distinct * 100 < n * 50,
            "C": F.regexp_count(own, F.lit("[A-Z]")).cast("long") * 100 > F.length(own).cast("long") * 3,
            "D": own.rlike(r"[#$%&*|]")}


def document_failures(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text",
                      part: str = "lang") -> DataFrame:
    """(id, part, digest, A, B, C, D, E, n): which filters the documents with one id, part and text
    fail, and how many rows these are.

    E fails where a smaller id anywhere has the same text. A NULL id is neither smaller nor larger than
    another; rows with one id are not copies of each other; a NULL text is empty, a NULL part the
    empty part."""
    marks = text_failures(F.col("_text"))
    words = marks.pop("_words")
    rows = (docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
                        F.coalesce(F.col(text), F.lit("")).alias("_text"))
            .withColumn("_words", words)
            .select("id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"),
                    *[c.alias(f) for f, c in marks.items()]))
    rows = scratch.save(rows.groupBy("id", "part", "digest", *marks).agg(F.count(F.lit(1)).alias("n")), "rows")
    first = (rows.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"))
             .withColumn("first", F.lit(True)))
    return (rows.join(first, ["digest", "id"], "left")
            .withColumn("E", F.col("id").isNotNull() & F.col("first").isNull())
            .select("id", "part", "digest", *marks, "E", "n"))


def failure_cells(failures: DataFrame, labels: DataFrame, filters: Sequence[str], scratch: Scratch,
                  key: str = "doc_id") -> DataFrame:
    """(part, cell, n, good, toxic): documents per part and cell; bit i of ``cell`` is filter i failing.

    A document is good (toxic) if any of its label rows says 1. NULL labels and ids say nothing."""
    marks = (labels.select(F.col(key).alias("id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
             .where(F.col("id").isNotNull() & (F.col("g") | F.col("t")))
             .groupBy("id").agg(F.max("g").alias("g"), F.max("t").alias("t")))
    cell = sum((F.col(f).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    counted = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    # rows without an id have no labels: a salt in the join key spreads them
    salted = failures.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(0))
    cells = (salted.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").groupBy("part", cell.alias("cell"))
             .agg(F.sum("n").alias("n"), counted("g").alias("good"), counted("t").alias("toxic")))
    return scratch.save(cells, "cells")


def selections(filters: Sequence[str]) -> tuple[list[tuple[str, int, int]], dict[str, np.ndarray]]:
    """Every (order, step, axis of its filter), and per measure an array (rows, axes, 2) of what each
    of these selects along each axis."""
    k, rows = len(filters), []
    picks: dict[str, list] = {"kept": [], "removed": [], "failing": [], "unique_fails": []}
    for order in permutations(range(k)):
        for step, own in enumerate(order):
            rows.append(("".join(filters[i] for i in order), step + 1, own))
            earlier, others = set(order[:step]), set(range(k)) - {own}
            picks["kept"].append([PASS if i in earlier or i == own else ALL for i in range(k)])
            picks["removed"].append([FAIL if i == own else PASS if i in earlier else ALL for i in range(k)])
            picks["failing"].append([ALL if i in others else FAIL for i in range(k)])
            picks["unique_fails"].append([PASS if i in others else FAIL for i in range(k)])
    return rows, {m: np.array(p, dtype=np.int64) for m, p in picks.items()}


def contract(tensor: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """One count per row of ``picks``: the tensor contracted with that row's vector on every axis."""
    k = tensor.ndim
    args = [tensor, list(range(1, k + 1))]
    for axis in range(k):
        args += [picks[:, axis, :], [0, axis + 1]]
    return np.einsum(*args, [0], optimize="greedy")


def audit_tensors(tensors: dict[str, np.ndarray], filters: Sequence[str]) -> dict[str, list]:
    """All measures of all orders and steps, from the tensors ``n``, ``good`` and ``toxic``."""
    rows, picks = selections(filters)
    own = np.array([axis for _, _, axis in rows])
    removed = contract(tensors["n"], picks["removed"])
    total = np.bincount(own, weights=removed, minlength=len(filters)).astype(np.int64)
    out = {"filter_order": [o for o, _, _ in rows], "step": [s for _, s, _ in rows],
           "kept": contract(tensors["n"], picks["kept"]), "removed": removed,
           "redundant": contract(tensors["n"], picks["failing"]) - removed,
           "unique_fails": contract(tensors["n"], picks["unique_fails"]),
           "good_lost": contract(tensors["good"], picks["removed"]),
           "toxic_lost": contract(tensors["toxic"], picks["removed"]), "shapley": total[own]}
    return out


def audit_cells(cells: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step. A part's group holds at most 2^k rows."""
    names, k = list(filters), len(filters)

    def per_part(group):
        import pandas as pd
        tensors = {}
        for m in ("n", "good", "toxic"):
            flat = np.zeros(2 ** k, dtype=np.int64)
            flat[group["cell"].to_numpy()] = group[m].to_numpy()
            # bit i of the cell number is axis i
            tensors[m] = flat.reshape((2,) * k).transpose(*range(k - 1, -1, -1))
        return pd.DataFrame({"part": group["part"].iloc[0], **audit_tensors(tensors, names)})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return cells.groupBy("part").applyInPandas(per_part, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Sequence[str] = ("A", "B", "C", "D", "E")) -> DataFrame:
    """The audit of ``filters`` (any of A to E) over whole texts, per language: one row per part, order
    and step, zeros included, with ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley`` (the filter's removals summed over all orders).

    Defined cases: NULL texts are empty (they fail A only, and E beside other empty texts); NULL
    languages are the part with the empty name, with texts of an empty language; rows with one id count
    each and are not copies of each other; NULL ids never fail E and have no labels; repeated or
    contradicting labels count as 1 if any says so; an empty table gives no rows; other columns
    are not read."""
    scratch = Scratch(docs.sparkSession, "audit")
    cells = failure_cells(document_failures(docs, scratch), labels, filters, scratch)
    scratch.drop("rows")
    return audit_cells(cells, filters)
