"""Association of column pairs: Pearson, Spearman and Cramér's V.

All pairs share their passes: the number of scans and shuffles depends neither on columns nor on pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.columns import (
    field_of,
    is_complex,
    is_numeric,
    known,
    numeric_field,
    select_fields,
    text_key,
)
from plumbline.operators.batches import first_row, no_rows
from plumbline.operators.comoments import SIDE, Block, Gathered, co_moments, pair_correlations, square_blocks
from plumbline.operators.ordered import bucket_count, bucketed, split_points

#: Numbers of the rank table of a slice of rows that a task turns into blocks at once.
RANKS_AT_ONCE = 1 << 22


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, correlation)`` per pair, over the rows where both are known.

    NULL if one of them does not vary there, NaN if one of them is infinite there. One scan serves all pairs.
    """
    fields = [f for f in select_fields(df, columns, is_numeric) if is_numeric(f.dataType)]
    if len(fields) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    names = [f"v{i}" for i in range(len(fields))]
    doubles = df.select(*[known(f).cast("double").alias(v) for f, v in zip(fields, names)])
    blocks = square_blocks(names)
    shown = {v: (i, f.name) for i, (f, v) in enumerate(zip(fields, names))}
    return pair_correlations(co_moments(doubles, blocks), blocks, shown)


def _gap_classes(rows: DataFrame, names: list[str]) -> tuple[list[list[str]], dict[str, int]]:
    """The columns by the rows in which they are missing, and about how many different values each has.

    Two columns with equally many gaps are of a class if the hashes of the row numbers of their gaps have one
    sum without carry; that other gaps give the same is as likely as a collision of 64 bits.
    """
    aggregates = []
    for v in names:
        gap = F.col(v).isNull()
        aggregates.append(F.count_if(gap).alias(f"n_{v}"))
        aggregates.append(F.bit_xor(F.when(gap, F.xxhash64("rid"))).alias(f"x_{v}"))
        aggregates.append(F.approx_count_distinct(v).alias(f"d_{v}"))
    seen = first_row(rows, aggregates, 2)
    classes: dict[tuple, list[str]] = {}
    for v in names:
        classes.setdefault((seen[f"n_{v}"], seen[f"x_{v}"]), []).append(v)
    return list(classes.values()), {v: seen[f"d_{v}"] for v in names}


def _ranks(rows: DataFrame, names: list[str], classes: list[list[str]], distinct: dict[str, int]) -> DataFrame:
    """``(i, v, ranks)``: for the value ``v`` of column ``i`` its average rank, less the mean, among the rows of each class.

    One table of value counts for all columns, with a count per class, is cut into buckets by value.
    """
    splits = split_points(rows, names, bucket_count(rows), distinct)
    flags = [F.col(c[0]).isNotNull().cast("int").alias(f"k{j}") for j, c in enumerate(classes)]
    entries = [F.struct(F.lit(i).alias("i"), F.col(v).alias("v"), F.col(f"b_{v}").alias("bucket")) for i, v in enumerate(names)]
    melted = bucketed(rows, names, splits).select(F.explode(F.array(*entries)).alias("e"), *flags).select("e.*", *[f"k{j}" for j in range(len(classes))])
    sums = [F.sum(f"k{j}").alias(f"n{j}") for j in range(len(classes))]
    counts = melted.where(F.col("v").isNotNull()).groupBy("i", "bucket", "v").agg(*sums)
    whole, order = Window.partitionBy("i"), Window.partitionBy("i").orderBy("bucket")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per column and bucket.
    starts = counts.groupBy("i", "bucket").agg(*[F.sum(f"n{j}").alias(f"h{j}") for j in range(len(classes))]).select(
        F.col("i").alias("of"), F.col("bucket").alias("at"),
        *[F.coalesce(F.sum(f"h{j}").over(earlier), F.lit(0)).alias(f"s{j}") for j in range(len(classes))],
        *[F.sum(f"h{j}").over(whole).alias(f"t{j}") for j in range(len(classes))],
    )
    inside = Window.partitionBy("i", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.select("i", "bucket", "v", *[f"n{j}" for j in range(len(classes))], *[F.sum(f"n{j}").over(inside).alias(f"u{j}") for j in range(len(classes))])

    def centred(j: int) -> Column:
        n = F.col(f"n{j}")
        rank = F.col(f"s{j}") + F.col(f"u{j}") - (n - 1) / 2.0 - (F.col(f"t{j}") + 1) / 2.0
        return F.when(n > 0, rank)

    joined = running.join(starts, (F.col("i") == F.col("of")) & (F.col("bucket") == F.col("at")))
    return joined.select("i", "v", F.array(*[centred(j) for j in range(len(classes))]).alias("ranks"))


def _class_blocks(names: list[str], classes: list[list[str]]) -> list[Block]:
    """Blocks of ``<column>|<class>``: a column is ranked among the rows of the other side's class."""
    blocks = []
    for a, b in combinations_with_replacement(range(len(classes)), 2):
        left = [f"{names.index(v)}|{b}" for v in classes[a]]
        if a == b:
            sides = [left[at : at + SIDE] for at in range(0, len(left), SIDE)]
            blocks += combinations_with_replacement(sides, 2)
        else:
            right = [f"{names.index(v)}|{a}" for v in classes[b]]
            blocks += [
                (left[x : x + SIDE], right[y : y + SIDE]) for x in range(0, len(left), SIDE) for y in range(0, len(right), SIDE)
            ]
    return blocks


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, correlation)`` of average ranks, over the rows where both are known.

    Rows are melted to ``(row, column, value)`` and meet their ranks in one join for all columns; sorted by row
    again, they are rows of ranks, whose co-moments are taken like those of plain columns. Columns missing in
    the same rows form a class, and a column is ranked once per class. NULL if one of a pair does not vary.
    """
    fields = [numeric_field(df, f.name) for f in select_fields(df, columns, is_numeric)]
    if len(fields) < 2:
        return no_rows(df, spearman, "double", 2)
    names = [f"v{i}" for i in range(len(fields))]
    rows = df.select(*[known(f).cast("double").alias(v) for f, v in zip(fields, names)]).withColumn("rid", F.monotonically_increasing_id())
    classes, distinct = _gap_classes(rows, names)
    width, blocks = len(classes), _class_blocks(names, classes)
    entries = [F.struct(F.lit(i).alias("i"), F.col(v).alias("v")) for i, v in enumerate(names)]
    melted = rows.select("rid", F.explode(F.array(*entries)).alias("e")).select("rid", "e.*").where(F.col("v").isNotNull())
    # Never a broadcast: the optimizer knows the size of the columns, not that of the melted rows.
    table = _ranks(rows.drop("rid"), names, classes, distinct).hint("merge")
    ranked = melted.join(table, ["i", "v"]).select("rid", "i", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Gathered(blocks)
        at_once = max(1, RANKS_AT_ONCE // (len(names) * width))

        def add(rid: np.ndarray, i: np.ndarray, ranks: np.ndarray) -> None:
            row = np.cumsum(np.concatenate([[0], rid[1:] != rid[:-1]]))
            for low in range(0, int(row[-1]) + 1, at_once):
                part = slice(*np.searchsorted(row, [low, low + at_once]))
                table = np.full((min(at_once, int(row[-1]) + 1 - low), len(names), width), np.nan)
                table[row[part] - low, i[part]] = ranks[part]
                seen.add({f"{n}|{c}": table[:, n, c] for n in range(len(names)) for c in range(width)})

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = batch["ranks"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            now = [batch["rid"].to_numpy(), batch["i"].to_numpy(), ranks]
            now = [np.concatenate(p) for p in zip(held, now, strict=True)] if held else now
            # The last row may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut:
                add(*[p[:cut] for p in now])
            held = [p[cut:] for p in now]
        if held:
            add(*held)
        yield seen.rows()

    in_rows = ranked.repartition("rid").sortWithinPartitions("rid")
    shown = {f"{i}|{c}": (i, f.name) for i, f in enumerate(fields) for c in range(width)}
    return pair_correlations(in_rows.mapInArrow(run, "block int, task_group int, stats binary"), blocks, shown)


def _cells(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """``(pair, a, b, o)``: how often the values of every pair of columns stand in one row, from one scan.

    A batch of rows is coded by column, counted by pair, and only then joined with the batches of others.
    """
    names = [f"k{i}" for i in range(len(fields))]
    pairs = list(combinations(range(len(fields)), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [pc.dictionary_encode(batch[n]) for n in names]
            codes = [pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
            for p, (x, y) in enumerate(pairs):
                both = (codes[x] >= 0) & (codes[y] >= 0)
                cell, o = np.unique(codes[x][both] * len(coded[y].dictionary) + codes[y][both], return_counts=True)
                if len(cell):
                    a, b = np.divmod(cell, len(coded[y].dictionary))
                    columns = [pa.array(np.full(len(cell), p, np.int32)), coded[x].dictionary.take(pa.array(a)), coded[y].dictionary.take(pa.array(b)), pa.array(o)]
                    yield pa.RecordBatch.from_arrays(columns, ["pair", "a", "b", "o"])

    keys = df.select(*[text_key(f).alias(n) for f, n in zip(fields, names)])
    counted = keys.mapInArrow(run, "pair int, a string, b string, o bigint")
    # Said before the grouping, so that all uses of the cells have one plan and share their shuffle.
    some = counted.where("pair IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    return some.groupBy("pair", "a", "b").agg(F.sum("o").alias("o"))


def cramers_v(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_a, column_b, n, chi_square, cramers_v, cramers_v_corrected)`` per pair.

    Chi-square only needs the value pairs that occur: ``n * (sum(o^2 / (row * column)) - 1)``.
    The corrected form removes the bias of small tables (Bergsma 2013).
    """
    fields = [field_of(df, f.name) for f in select_fields(df, columns) if not is_complex(f.dataType)]
    if len(fields) < 2:
        return no_rows(df, cramers_v, "string", 2)
    pairs = [(i, a.name, b.name) for i, (a, b) in enumerate(combinations(fields, 2))]
    cells = _cells(df, fields)
    of_a = cells.groupBy("pair", "a").agg(F.sum("o").alias("of_a"))
    of_b = cells.groupBy("pair", "b").agg(F.sum("o").alias("of_b"))
    # The shares of a value's cells add up to one, so their total is the number of values.
    whole = (
        cells.join(of_a, ["pair", "a"])
        .join(of_b, ["pair", "b"])
        .groupBy("pair")
        .agg(
            F.sum("o").alias("n"),
            (F.sum(F.col("o").cast("double") / F.col("of_a") * F.col("o") / F.col("of_b")) - 1).alias("phi2"),
            F.round(F.sum(F.col("o") / F.col("of_a"))).alias("r"),
            F.round(F.sum(F.col("o") / F.col("of_b"))).alias("c"),
        )
    )
    n, r, c, phi2 = F.col("n"), F.col("r"), F.col("c"), F.greatest(F.col("phi2"), F.lit(0.0))
    phi2_c = F.greatest(phi2 - F.try_divide((r - 1) * (c - 1), n - 1), F.lit(0.0))
    r_c = r - F.try_divide((r - 1) ** 2, n - 1)
    c_c = c - F.try_divide((c - 1) ** 2, n - 1)
    listed = df.sparkSession.createDataFrame(pairs, "pair int, column_a string, column_b string")
    return listed.join(whole, "pair", "left").select(
        "column_a",
        "column_b",
        "n",
        F.when(n.isNotNull(), phi2 * n).alias("chi_square"),
        F.when(n.isNotNull(), F.sqrt(F.try_divide(phi2, F.least(r, c) - 1))).alias("cramers_v"),
        F.when(n.isNotNull(), F.sqrt(F.try_divide(phi2_c, F.least(r_c, c_c) - 1))).alias("cramers_v_corrected"),
    )
