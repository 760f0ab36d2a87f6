"""How the filters of a pipeline act on each other, for every order in which they could run.

Whether a document fails a filter does not depend on the order, so each document falls into one cell of
a tensor with one axis per filter, of length two (passes, fails). Spark counts the cells of every part of
the corpus; that table has at most 32 cells for five filters and a few counts, whatever the corpus holds. All
questions about an order are contractions of this tensor: each axis is summed with a vector that selects
"passes", "fails" or "all", by :func:`numpy.einsum`.

Defined cases: a missing text is an empty one. A missing part (``lang``) is the part ``""``. A row without
id is never later than another, and no row is later than it, so it is no copy and has none. Repeated rows are
rows of their own; those with the smallest id of a text are all first. Several labels of an id count as one
that has what any of them has. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, text_of, words

#: What is counted in every cell: documents, those labelled good, those labelled toxic.
MEASURES = ("n", "good", "toxic")

PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def content_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails the four rules that look at the text alone."""
    found = words(text)
    n_words, n_distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct.cast("bigint") < 50 * n_words.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic`` and a flag per filter ``A`` to ``E`` (true: fails) of every document.

    Texts are read once and never shuffled: a digest of 32 bytes stands for each. Copies are found by joining
    the first id of every digest back on digest and id together, so that no group of copies, however large,
    meets in one task.
    """
    text = text_of(documents)
    flags = content_flags(F.col("t"))
    slim = documents.select(
        documents["doc_id"].alias("id"), F.coalesce(documents["lang"].cast("string"), F.lit("")).alias("part"), text.alias("t")
    ).select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), *[c.alias(f) for f, c in flags.items()])
    slim = materialise(slim, "judged")
    first = slim.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))]
    )
    return (
        slim.join(first, ["digest", "id"], "left")
        .join(marks, "id", "left")
        .select(
            "part", *flags, (F.col("first").isNull() & F.col("id").isNotNull()).alias("E"),
            *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in MEASURES[1:]],
        )
    )


def cells(rows: DataFrame, filters: str) -> DataFrame:
    """``part, cell`` and the measures; bit ``i`` of the cell is set if the ``i``-th filter fails."""
    cell = F.lit(0)
    for i, f in enumerate(filters):
        cell = cell + F.when(F.col(f), 1 << i).otherwise(0)
    return rows.groupBy("part", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(m)).alias(m) for m in MEASURES[1:]]
    )


class Tensor:
    """Counts of one part with an axis per filter and a last one for the measures."""

    def __init__(self, filters: str, cell: np.ndarray, measures: np.ndarray):
        self.filters = filters
        flat = np.zeros((1 << len(filters), measures.shape[1]), dtype=np.int64)
        np.add.at(flat, cell, measures)
        # The first filter is the lowest bit of a cell and so the last axis of the plain reshape.
        shaped = flat.reshape([2] * len(filters) + [measures.shape[1]])
        self.counts = shaped.transpose([*range(len(filters))[::-1], len(filters)])

    def contracted(self, **chosen: np.ndarray) -> np.ndarray:
        """The measures, each filter's axis summed with its vector (all, if none is given)."""
        axes = range(len(self.filters))
        operands: list = [self.counts, [*axes, len(self.filters)]]
        for axis, f in enumerate(self.filters):
            operands += [chosen.get(f, ALL), [axis]]
        return np.einsum(*operands, [len(self.filters)])

    def steps(self, order: str) -> Iterator[dict[str, int]]:
        """What happens at each step when the filters run in ``order``."""
        for k, f in enumerate(order):
            earlier = {e: PASS for e in order[:k]}
            here = self.contracted(**earlier, **{f: FAIL})
            yield {
                "kept": int(self.contracted(**earlier, **{f: PASS})[0]),
                "removed": int(here[0]),
                "redundant": int(self.contracted(**{f: FAIL})[0] - here[0]),
                "unique_fails": int(self.contracted(**{e: FAIL if e == f else PASS for e in order})[0]),
                "good_lost": int(here[1]),
                "toxic_lost": int(here[2]),
            }


def audit(counted: DataFrame, filters: str) -> DataFrame:
    """One row per part, order and step of :func:`cells`; a part is at most ``2 ** len(filters)`` rows of it."""
    orders = ["".join(p) for p in permutations(filters)]
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def of_part(found: pd.DataFrame) -> pd.DataFrame:
        tensor = Tensor(filters, found["cell"].to_numpy(), found[list(MEASURES)].to_numpy(np.int64))
        rows = [
            {"filter_order": order, "step": k, **step}
            for order in orders for k, step in enumerate(tensor.steps(order), start=1)
        ]
        result = pd.DataFrame(rows)
        by = [order[k - 1] for order, k in zip(result["filter_order"], result["step"], strict=True)]
        result["shapley"] = result.groupby(np.array(by))["removed"].transform("sum")
        result["part"] = found["part"].iloc[0]
        return result[["part", "filter_order", "step", *counts]]

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts)
    return counted.groupBy("part").applyInPandas(of_part, schema)


def filter_audit(documents: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """The audit of all orders of the five filters over whole texts."""
    return audit(cells(judged(documents, labels), filters), filters)
