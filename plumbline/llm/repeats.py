"""Windows of a fixed length that occur more than once in a corpus of symbol sequences.

Both repeat operators use it, one on bytes and one on words. All windows of ``length`` symbols count, but
neither windows nor symbols are shuffled; what is shuffled are phrases:

1. A rolling hash triggers at the ``gram`` of each window whose hash is smallest. Equal windows trigger at
   the same place, neighbouring windows mostly at the same gram. The windows of a document that share a
   trigger are one phrase, known by its trigger's hash and the hash of its whole extent.
2. Triggers that occur once in the corpus are counted out: none of their windows is repeated.
3. Phrases are united by content. In a content that occurs several times every window is repeated: a
   path without branches, compacted to one entry of the dictionary.
4. Only where one trigger has several contents, paths branch. There the windows of one occurrence of
   each content are compared one by one, at their coordinates in the source texts: the windows of a phrase travel
   as one row to the partition of their trigger and are compared there. Triggers with more than
   ``CROWDED`` contents are compared by window instead, with counts made before the shuffle.

What is found are places of phrases, each with a mask of the windows in it that are repeated. Texts move to their
places by a shuffle on their ids, at every size: places grow with the texts, so they are never broadcast.

Hashes of any part of a text come from sums of powers modulo 2^64 over random symbol values. A phrase
is matched by two of them, a window by two as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import materialise, small, text_of
from plumbline.llm.hashing import mix

SLICE_SYMBOLS = 1_000_000
#: A trigger with so many contents has about a million windows, some 60 MB in a task; beyond it they are shuffled.
CROWDED = 20_000
#: The mask of a phrase all of whose windows are repeated.
ALL = -1
#: An odd base and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWEST = -(1 << 63)
#: A place is the rank of a row among those with its id, a start and a number of windows in one number.
_RANK, _START = 40, 8


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hashes:
    """Hashes of all parts of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        self.unscale = _powers(_INVERSE, n)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(mix(symbols) * _powers(_BASE, n)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.unscale[start])

    def grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.unscale[: len(self.sums) - size])


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of every ``width`` neighbouring values."""
    places = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        a, b = places[:-step], places[step:]
        places = np.where(values[a] <= values[b], a, b)
        done += step
    return places


@dataclass(frozen=True)
class Shape:
    """Length of a window and of the grams that trigger, in symbols; a mask holds the windows of a phrase."""

    length: int
    gram: int

    def __post_init__(self):
        if not 0 <= self.length - self.gram < 62:
            raise ValueError("a gram may be up to 61 symbols shorter than a window")


def phrases(symbols: np.ndarray, ends: np.ndarray, shape: Shape):
    """``owner, start, windows, key, content`` of all phrases of concatenated sequences that end at ``ends``."""
    starts = np.concatenate([[0], ends[:-1]])
    none = np.empty(0, dtype=np.int64)
    if len(symbols) < shape.length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(symbols)
    grams = hashes.grams(shape.gram)
    trigger = smallest_places(grams, shape.length - shape.gram + 1)
    at = np.arange(len(trigger))
    owner = np.searchsorted(ends, at, side="right")
    inside = at + shape.length <= ends[np.minimum(owner, len(ends) - 1)]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    last = np.flatnonzero(stop)
    content = hashes.of(first, last + shape.length) ^ mix((last - first).astype(np.uint64))
    return owner[first], first - starts[owner[first]], last - first + 1, grams[trigger[first]], content


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + SLICE_SYMBOLS, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a batch, one after the other, and where each row begins and ends."""
    if pa.types.is_list(column.type):
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[: len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)


def _parts(batch: pa.RecordBatch, shape: Shape):
    """Phrases of a batch, slice by slice, with the rows they belong to."""
    offsets, symbols = _symbols(batch.column("symbols"))
    for start, end in _slices(offsets):
        own = symbols[offsets[start]: offsets[end]].astype(np.uint64)
        owner, first, windows, key, content = phrases(own, (offsets[start + 1: end + 1] - offsets[start]).astype(np.int64), shape)
        yield owner + start, first, windows, key.view(np.int64), content.view(np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch]):
    """``keys, ids, places, lengths, windows`` of rows sorted by key, in parts that hold all rows of their keys."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        lists = batch.column("windows")
        part = [batch.column(c).to_numpy() for c in ("key", "id", "place")]
        part += [lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)]
        if kept is not None:
            part = [np.concatenate(pair) for pair in zip(kept, part, strict=True)]
        keys = part[0]
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        ends = int(part[3][:cut].sum())
        if cut:
            yield [*(a[:cut] for a in part[:4]), part[4][:ends]]
        kept = [*(a[cut:] for a in part[:4]), part[4][ends:]]
    if kept is not None and len(kept[0]):
        yield kept


def compare_windows(
    keys: np.ndarray, ids: np.ndarray, places: np.ndarray, lengths: np.ndarray, windows: np.ndarray, keep_first: bool
) -> np.ndarray:
    """For each phrase a mask of the windows that its key has several times; the first ones are left out if kept."""
    owner = np.repeat(np.arange(len(keys)), lengths)
    nth = np.arange(len(windows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    spot = places[owner] + (nth << _START)
    order = np.lexsort((spot, ids[owner], windows, keys[owner]))
    key, window = keys[owner][order], windows[order]
    like_before = np.zeros(len(order), dtype=bool)
    like_before[1:] = (key[1:] == key[:-1]) & (window[1:] == window[:-1])
    told = like_before.copy()
    if not keep_first:
        told[:-1] |= like_before[1:]
    masks = np.zeros(len(keys), dtype=np.int64)
    chosen = order[told]
    np.bitwise_or.at(masks, owner[chosen], np.int64(1) << nth[chosen])
    return masks


class Repeats:
    """Finds the repeated windows of ``documents``.

    ``symbols`` makes a binary column or an array of 64-bit numbers from the text. Rows are known by id and, only if ids
    repeat, by their rank among the rows of that id in the order of their texts. With ``keep_first`` the
    first occurrence of a window, by id, rank and start, is not listed.
    """

    def __init__(self, documents: DataFrame, symbols: Callable[[Column], Column], shape: Shape, keep_first: bool):
        self.shape, self.keep_first, self.symbols = shape, keep_first, symbols
        ids = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rank = F.lit(0).cast("bigint")
        self.keys = ["id"]
        if not ids.isEmpty():
            rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(text_of(documents))).cast("bigint")
            self.keys = ["id", "rank"]
        self.rows = documents.select(
            "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LOWEST)).alias("id"), rank.alias("rank"),
            text_of(documents).alias("text"),
        )

    def _all_phrases(self) -> DataFrame:
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, ranks = (batch.column(c).to_numpy() for c in ("id", "rank"))
                for owner, first, windows, key, content in _parts(batch, shape):
                    place = (ranks[owner] << _RANK) | (first << _START) | windows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a) for a in (key, content, ids[owner], place)], ["key", "content", "id", "place"]
                    )

        rows = self.rows.select("id", "rank", self.symbols(F.col("text")).alias("symbols"))
        return rows.mapInArrow(run, "key bigint, content bigint, id bigint, place bigint")

    def _all_keys(self) -> DataFrame:
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, _, key, _ in _parts(batch, shape):
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

        return self.rows.select(self.symbols(F.col("text")).alias("symbols")).mapInArrow(run, "key bigint")

    def _windows(self, chosen: DataFrame) -> DataFrame:
        """``key, contents, id, place, windows`` of the phrases ``chosen``: the hashes of their windows in order."""
        shape = self.shape
        found = chosen.withColumn("rank", F.shiftright("place", _RANK)).groupBy(*self.keys).agg(
            F.collect_list(F.struct("place", "key", "contents")).alias("phrases")
        )
        rows = self.rows.select("id", "rank", "text").join(found, self.keys).select(
            "id", self.symbols(F.col("text")).alias("symbols"), "phrases"
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, symbols = _symbols(batch.column("symbols"))
                lists = batch.column("phrases")
                inner = lists.flatten()
                places, keys, contents = (inner.field(c).to_numpy() for c in ("place", "key", "contents"))
                n = lists.value_lengths().to_numpy()
                bounds = np.concatenate([[0], np.cumsum(n)])
                hashed, lengths = [], places & ((1 << _START) - 1)
                for i in range(batch.num_rows):
                    hashes = Hashes(symbols[offsets[i]: offsets[i + 1]].astype(np.uint64))
                    place, windows = (a[bounds[i]: bounds[i + 1]] for a in (places, lengths))
                    first = (place >> _START) & ((1 << (_RANK - _START)) - 1)
                    step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                    start = np.repeat(first, windows) + step
                    hashed.append(hashes.of(start, start + shape.length).view(np.int64))
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), type=pa.int32())
                ids = np.repeat(batch.column("id").to_numpy(), n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), pa.array(contents), pa.array(ids), pa.array(places),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashed))),
                ], ["key", "contents", "id", "place", "windows"])

        return rows.mapInArrow(run, "key bigint, contents bigint, id bigint, place bigint, windows array<bigint>")

    def _masks(self, windows: DataFrame) -> DataFrame:
        """``id, place, mask`` of phrases with windows that other phrases of their trigger have, too."""
        keep_first = self.keep_first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, ids, places, lengths, hashed in _whole_groups(batches):
                masks = compare_windows(keys, ids, places, lengths, hashed, keep_first)
                told = masks != 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[told]) for a in (ids, places, masks)], ["id", "place", "mask"]
                )

        few = windows.where(F.col("contents") <= CROWDED).select("key", "id", "place", "windows")
        return few.repartition("key").sortWithinPartitions("key").mapInArrow(run, "id bigint, place bigint, mask bigint")

    def _crowded_masks(self, windows: DataFrame) -> DataFrame:
        """The same for triggers with more than ``CROWDED`` contents: one row for each window, counted before the shuffle."""
        rows = windows.where(F.col("contents") > CROWDED).select(
            "key", "id", "place", F.posexplode("windows").alias("nth", "window")
        )
        spot = F.struct("id", F.col("place") + F.shiftleft(F.col("nth").cast("bigint"), _START))
        groups = rows.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("head"))
        seen = rows.join(groups.where("n > 1"), ["key", "window"])
        if self.keep_first:
            seen = seen.where(F.col("head") != spot)
        bit = F.expr("shiftleft(1L, nth)")
        return seen.groupBy("key", "id", "place").agg(F.bit_or(bit).alias("mask")).select("id", "place", "mask")

    def places(self) -> DataFrame:
        """``id, place, mask`` of the phrases with repeated windows."""
        head = F.min(F.struct("id", "place")).alias("head")
        several = materialise(self._all_keys().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
        found = materialise(self._all_phrases().join(small(several, 24), "key"), "phrases")
        contents = materialise(found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), head), "contents")
        branching = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
        whole = found.join(contents.where("n > 1").select("key", "content", "head"), ["key", "content"])
        if self.keep_first:
            whole = whole.where((F.col("id") != F.col("head.id")) | (F.col("place") != F.col("head.place")))
        whole = whole.select("id", "place", F.lit(ALL).cast("bigint").alias("mask"))
        chosen = contents.join(branching, "key")
        chosen = materialise(chosen.select("key", "contents", "head.id", "head.place"), "branching")
        if chosen.isEmpty():
            return whole
        windows = materialise(self._windows(chosen), "windows")
        return whole.unionByName(self._masks(windows)).unionByName(self._crowded_masks(windows))

    def removed(self) -> DataFrame:
        """The rows with ``places``, the phrases that have repeated windows and their masks, or null."""
        found = self.places().withColumn("rank", F.shiftright("place", _RANK)).groupBy(*self.keys).agg(
            F.collect_set(F.struct("place", "mask")).alias("places")
        )
        return self.rows.join(found, self.keys, "left")


def covered(places: pa.Array, n: int, length: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a repeated window of the phrases ``places`` (place and mask)."""
    place, mask = (places.field(c).to_numpy() for c in ("place", "mask"))
    start = (place >> _START) & ((1 << (_RANK - _START)) - 1)
    windows = place & ((1 << _START) - 1)
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    repeated = (np.repeat(mask, windows) >> np.minimum(nth, 62)) & 1 == 1
    at = (np.repeat(start, windows) + nth)[repeated]
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    change = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)
