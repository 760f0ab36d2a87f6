"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source that should give ``t`` words gives each of its documents
``floor(t / size of the source)`` times, and the documents with a hash below a threshold once more.
The threshold comes from histograms: words are summed by source and leading hash bits, the bucket in
which the budget ends is found by a running total, and only that bucket is summed again by the next
bits, until it holds a single hash. No documents are sorted or gathered; the tables have one row per
source, or per source and bucket. Thresholds are nested: a smaller budget takes a subset.

Defined cases: a missing text has size 0. A missing source is a source of its own, after all others.
Rows with the same ``doc_id`` share a hash and are taken together. A threshold falls between two
hashes, on the side nearer to the target. An empty table gives no rows. A source without words has
target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import WORD, materialise, null_last, text_of, whole_row

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
HASH_BITS = 60
BITS = 12


def document_hash(doc_id: Column, seed: str = "") -> Column:
    """The first 60 bits of the MD5 of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sizes(documents: DataFrame, seed: str = "") -> DataFrame:
    """``doc_id, source_key, place, size`` of each document."""
    return documents.select(
        "doc_id",
        null_last(documents["source"]).alias("source_key"),
        document_hash(documents["doc_id"], seed).alias("place"),
        F.regexp_count(text_of(documents), F.lit(WORD)).cast("bigint").alias("size"),
    )


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source_key, source_size, target``, one row per source.

    Weights repeat over the sources in order. A source stops at ``most`` times its size; what it
    leaves goes to the others by weight. Sorted by size per weight, the sources that stop come first,
    so the common level of the rest is the largest one that any prefix leaves.
    """
    # Windows over all rows of a table with one row per source.
    by_name, by_ratio = Window.orderBy("source_key"), Window.orderBy("ratio", "source_key")
    everything = Window.partitionBy()
    per_source = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = per_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ).withColumns({
        "cap": F.col("source_size") * F.lit(float(most)),
        "budget": F.sum("source_size").over(everything) * F.lit(share),
    })
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = weighted.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn(
        "level",
        (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    level = F.max("level").over(everything)
    return levels.select(
        "source_key", "source_size", F.least(F.col("cap"), F.col("weight") * level).alias("target")
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``rounds`` (whole copies of the source) and ``below`` (hashes taken once more)."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    planned = goals.withColumn("rounds", rounds.cast("bigint")).withColumn(
        "rest", F.col("target") - F.col("rounds") * F.col("source_size")
    )
    open_cells = planned.select("source_key", "rest", F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("base"))
    found = None
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        inside = sized.join(open_cells, "source_key").where(
            F.shiftright("place", shift + BITS) == F.col("cell")
        )
        cells = inside.groupBy("source_key", F.shiftright("place", shift).alias("next")).agg(
            F.sum("size").alias("here"),
            F.min("place").alias("first"),
            F.max("place").alias("last"),
            F.first("rest").alias("rest"),
            F.first("base").alias("base"),
        )
        upto = F.col("base") + F.sum("here").over(Window.partitionBy("source_key").orderBy("next"))
        ends = cells.withColumn("upto", upto).where(
            (F.col("upto") - F.col("here") <= F.col("rest")) & (F.col("rest") < F.col("upto"))
        )
        ends = materialise(ends.select(
            "source_key", "rest", F.col("next").alias("cell"), (F.col("upto") - F.col("here")).alias("base"),
            "upto", "first", "last",
        ), "cells")
        single = F.col("first") == F.col("last")
        nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("base")
        settled = ends.where(single).select(
            "source_key", (F.col("first") + F.when(nearer, 1).otherwise(0)).alias("below")
        )
        found = settled if found is None else found.unionByName(settled)
        open_cells = ends.where(~single).select("source_key", "rest", "cell", "base")
        if open_cells.isEmpty():
            break
    return planned.join(found, "source_key", "left").select(
        *goals.columns, "rounds", F.coalesce("below", F.lit(0)).alias("below")
    )


def copies_of(place: Column, rounds: Column, below: Column) -> Column:
    return rounds + F.when(place < below, 1).otherwise(0)


def mixture(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sized`` with ``source_size``, ``target`` and ``copies``; ``sized`` is read several times."""
    plan = materialise(thresholds(sized, materialise(targets(sized, weights, share, most), "targets")), "mixture")
    return sized.join(plan, "source_key").select(
        "doc_id", "source_key", "place", "size", "source_size", "target",
        copies_of(F.col("place"), F.col("rounds"), F.col("below")).alias("copies"),
    )


def mix(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = ""
) -> DataFrame:
    """The rows of ``documents``, each as often as the mixture takes it, with all columns."""
    sized = materialise(sizes(documents, seed), "sizes")
    plan = materialise(thresholds(sized, materialise(targets(sized, weights, share, most), "targets")), "mixture")
    keyed = documents.select(
        whole_row(documents).alias("row"),
        null_last(documents["source"]).alias("source_key"),
        document_hash(documents["doc_id"], seed).alias("place"),
    )
    copies = copies_of(F.col("place"), F.col("rounds"), F.col("below")).cast("int")
    return (
        keyed.join(plan, "source_key")
        .select("row", copies.alias("copies"))
        .where(F.col("copies") > 0)
        .select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row"))
        .select("row.*")
    )
