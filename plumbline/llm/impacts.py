"""Exact nearest vectors by inner product, from an impact-ordered index read score at a time.

Components are whole numbers. The rows of a task are cut into blocks; each block has, per level, one segment
of postings ``(dimension, place, impact)``, where the level of an impact is the number of its bits. Segments
of a block are read from the highest level down, for all asking vectors of a group at once: each adds what its
postings contribute to the scores. After a segment, what the unread postings of a vector could still add is
bounded by the product of two lengths (Cauchy and Schwarz): that of the asking vector and that of the vector's
unread components. A vector whose score and bound together stay below the ``k``-th best score known for the
question is ruled out. Reading stops when few possible members are left or the segments are used up; these are
scored again with exact whole numbers. Nothing is ruled out without that proof, so the result is exact.

The first threshold of a question is its ``k``-th best exact score in its own block. Questions meet blocks
in groups of bounded size, by equality joins on group and block, so every table spreads over the cluster and no
task holds more than a block and a group.

Defined cases: vectors that are missing or hold a missing or non-finite component, and rows without id, take
no part. Shorter vectors count as padded with zeros; an empty one scores zero with all. Repeated rows are
rows of their own: each asks and answers, and only a row itself is left out of its answers. Ties go to the
smaller id. An empty table gives no rows. Sums wrap around beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialise

#: Vectors of a block, asking vectors compared with it at once, and asking vectors of a group, about.
BLOCK = 8192
SLICE = 256
GROUP = 16_384

#: Reading goes on while more than this share of the pairs of a slice is possible.
FEW = 0.01

#: The level of the row that holds a block's asking vectors.
ASKS = -1

_INDEX = "block bigint, level int, n int, width int, ids binary, dims binary, places binary, impacts binary, floor binary"
_LOWEST = np.iinfo(np.int64).min


def whole_components(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component; null if one of them is missing or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def exact_products(asking: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows; through doubles where these hold every sum exactly."""
    largest = [float(np.abs(a.astype(np.float64)).max(initial=0)) for a in (asking, vectors)]
    if largest[0] * largest[1] * max(1, vectors.shape[1]) < 2**52:
        return (asking.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    return asking @ vectors.T


def _dense(lists: pa.ListArray) -> np.ndarray:
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    matrix = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix[row, place] = lists.flatten().to_numpy(zero_copy_only=False)
    return matrix


def _block_rows(block: int, ids: np.ndarray, asks: np.ndarray, vectors: np.ndarray, k: int) -> list[dict]:
    n, width = vectors.shape
    levels = np.frexp(np.abs(vectors.astype(np.float64)))[1]
    rows = []
    for level in np.unique(levels)[::-1].tolist() or [0]:
        place, dim = np.nonzero((levels == level) & (vectors != 0))
        rows.append({
            "block": block, "level": max(level, 0), "n": n, "width": width, "ids": ids.tobytes(),
            "dims": dim.astype(np.int32).tobytes(), "places": place.astype(np.int32).tobytes(),
            "impacts": vectors[place, dim].tobytes(), "floor": b"",
        })
    # Ids are needed once.
    for row in rows[1:]:
        row["ids"] = b""
    own = np.flatnonzero(asks)
    if len(own):
        floor = np.full(len(own), _LOWEST)
        if n > k:
            scores = exact_products(vectors[own], vectors)
            scores[np.arange(len(own)), own] = _LOWEST
            floor = np.partition(scores, n - k, axis=1)[:, n - k]
        rows.append({
            "block": block, "level": ASKS, "n": len(own), "width": width, "ids": ids[own].tobytes(), "dims": b"",
            "places": own.astype(np.int32).tobytes(), "impacts": vectors[own].tobytes(), "floor": floor.tobytes(),
        })
    return rows


def index(vectors: DataFrame, asks: Column, k: int, identity: str, vector: str, scale: int) -> DataFrame:
    """The segments of every block, and a row with its asking vectors where it has any."""
    used = vectors.select(
        vectors[identity].cast("bigint").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"),
        whole_components(vectors[vector], scale).alias("v"),
    ).where("id IS NOT NULL AND v IS NOT NULL")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([
            ("block", pa.int64()), ("level", pa.int32()), ("n", pa.int32()), ("width", pa.int32()),
            *[(c, pa.binary()) for c in ("ids", "dims", "places", "impacts", "floor")],
        ])
        held: list[pa.RecordBatch] = []

        def flushed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            arrays = [rows[c].combine_chunks() for c in ("id", "asks", "v")]
            made = _block_rows(
                number, arrays[0].to_numpy(), arrays[1].to_numpy(zero_copy_only=False), _dense(arrays[2]), k
            )
            number += 1
            return pa.RecordBatch.from_pylist(made, schema=schema)

        for batch in batches:
            held.append(batch)
            while sum(len(b) for b in held) >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield flushed(rows.slice(0, BLOCK))
                held = rows.slice(BLOCK).to_batches()
        if sum(len(b) for b in held):
            yield flushed(pa.Table.from_batches(held))

    return used.mapInArrow(build, _INDEX)


class Block:
    """The segments of a block, highest level first."""

    def __init__(self, segments: list[dict]):
        self.n, self.width = segments[0]["n"], segments[0]["width"]
        self.vectors = np.zeros((self.n, self.width), dtype=np.int64)
        self.segments = []
        for s in sorted(segments, key=lambda s: -s["level"]):
            if s["ids"]:
                self.ids = np.frombuffer(s["ids"], dtype=np.int64)
            places, dims = (np.frombuffer(s[c], dtype=np.int32) for c in ("places", "dims"))
            impacts = np.frombuffer(s["impacts"], dtype=np.int64)
            self.vectors[places, dims] = impacts
            self.segments.append((places, dims, impacts))

    def bands(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The postings of the next segments as a matrix, and the lengths of what is left after them.

        Consecutive segments are joined until they hold a quarter of all postings: reading a few postings costs
        as much as reading many.
        """
        left = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        least, held = self.n * self.width // 4, 0
        band = np.zeros((self.n, self.width), dtype=np.float32)
        for i, (places, dims, impacts) in enumerate(self.segments):
            band[places, dims] = impacts
            np.subtract.at(left, places, impacts.astype(np.float64) ** 2)
            held += len(places)
            if held >= least or i + 1 == len(self.segments):
                # A hundredth of a millionth more than rounding can have taken away.
                yield band, np.sqrt(np.maximum(left, 0) + 1e-8 * (self.vectors.astype(np.float64) ** 2).sum(axis=1))
                band, held = np.zeros_like(band), 0

    def possible(self, asking: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of question and place that are not proven to score below the question's floor."""
        rows = np.arange(len(asking))
        questions = asking.astype(np.float32)
        reach = np.sqrt((asking.astype(np.float64) ** 2).sum(axis=1))
        lengths = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        # What sums of 32-bit floats can be off by, as a share of the product of both lengths.
        off = (self.width + 16) * 2.0**-22
        scores = np.zeros((len(asking), self.n), dtype=np.float32)
        found = np.ones(scores.shape, dtype=bool)
        for band, left in self.bands():
            scores += questions @ band.T
            bound = (left + off * lengths).astype(np.float32)
            # Rounded down.
            short = np.nextafter(floor[rows].astype(np.float32), np.float32(-np.inf))
            # Written as "not below", so that a sum beyond floats rules nothing out.
            with np.errstate(all="ignore"):
                found = ~(scores + reach[rows, None].astype(np.float32) * bound * np.float32(1.0001) < short[:, None])
            alive = found.any(axis=1)
            if not alive.all():
                rows, questions, scores, found = rows[alive], questions[alive], scores[alive], found[alive]
            if np.count_nonzero(found) <= FEW * found.size:
                break
        question, place = np.nonzero(found)
        return rows[question], place

    def best(self, asking: np.ndarray, floor: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """``(question, place, score)`` of the ``k`` best of every question that reach its floor; ``own`` is its place here or -1."""
        width = max(self.width, asking.shape[1])
        if asking.shape[1] < self.width:
            asking = np.pad(asking, ((0, 0), (0, width - asking.shape[1])))
        question, place = self.possible(asking[:, : self.width], floor)
        kept = place != own[question]
        question, place = question[kept], place[kept]
        score = np.empty(len(question), dtype=np.int64)
        for at in range(0, len(question), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] = (asking[question[part], : self.width] * self.vectors[place[part]]).sum(axis=1)
        kept = score >= floor[question]
        question, place, score = question[kept], place[kept], score[kept]
        order = np.lexsort((self.ids[place], -score, question))
        question, place, score = question[order], place[order], score[order]
        rank = np.arange(len(question)) - np.searchsorted(question, question)
        return question[rank < k], place[rank < k], score[rank < k]


def nearest(
    vectors: DataFrame, asks: Column, k: int = 10, identity: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every row for which ``asks`` holds."""
    table = materialise(index(vectors, asks, k, identity, vector, scale), "impacts")
    # New names: both sides of the comparison come from one table.
    renamed = {"block": "home", "n": "asking", "width": "across", "ids": "query_ids", "places": "own", "impacts": "components", "floor": "least"}
    asked = table.where(F.col("level") == ASKS).select(*[F.col(c).alias(new) for c, new in renamed.items()])
    groups = max(1, -(-(asked.agg(F.sum("asking")).first()[0] or 0) // GROUP))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    segments = table.where(F.col("level") != ASKS).select(group, "block", "level", "n", "width", "ids", "dims", "places", "impacts")
    targets = table.where("level != -1").select("block").distinct().select(F.col("block").alias("target"), group)
    questions = asked.withColumn("grp", F.pmod(F.xxhash64("home"), F.lit(groups)).cast("int")).join(targets, "grp")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        if len(left) and len(right):
            block, number = Block(left.to_pylist()), left["block"][0].as_py()
            for row in right.to_pylist():
                asking = np.frombuffer(row["components"], dtype=np.int64).reshape(row["asking"], row["across"])
                floor, ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("least", "query_ids"))
                places = np.frombuffer(row["own"], dtype=np.int32)
                for at in range(0, row["asking"], SLICE):
                    part = slice(at, at + SLICE)
                    own = places[part] if row["home"] == number else np.full(len(places[part]), -1)
                    question, place, score = block.best(asking[part], floor[part], own, k)
                    home = np.full(len(question), row["home"])
                    for c, values in zip(columns, (home, places[part][question], ids[part][question], block.ids[place], score), strict=True):
                        c.append(values)
        arrays = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(a, type=t) for a, t in zip(arrays, kinds, strict=True)], ["home", "place", "query_id", "vec_id", "score"])

    found = (
        segments.groupBy("block", "grp")
        .cogroup(questions.groupBy("target", "grp"))
        .applyInArrow(compare, "home bigint, place int, query_id bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
