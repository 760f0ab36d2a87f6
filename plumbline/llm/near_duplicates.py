"""Near duplicates by BagMinHash.

A document is the multiset of its five-word shingles. Its signature is unbiased for the weighted Jaccard
similarity: every shingle starts Poisson processes over the discretised range of its weight, cut into
the intervals (0, 1], (1, 2], (2, 4], (4, 8] and so on; the points of a process have a time, a register
and a weight level, all fixed by the shingle, and a document sees those at or below its weight. A register
keeps its earliest time. Points come in order of time, so a process ends as soon as its next point is
later than every register, and heavy shingles cost the logarithm of their weight.

Signatures are cut into bands. Texts are reduced to one node for each different word sequence first.
Every group of a band has a centre, the node that shares most bands with others, so that the text which
others were made from is likely to be it. Pairs are compared by the overlap of their multisets, in rounds,
and only while they are not in one component yet: each node with the most central of its centres, then
with its other centres, then the members outside of a group's largest component with those of other
components. The last round takes groups of up to ``FEW`` members pair by pair, where the triangle inequality of
the Jaccard distance leaves out pairs whose distances to the centre differ by more than the limit. Larger groups
are cut into blocks of about ``BLOCK`` members: a block of those outside the largest component meets a block of
all members in one task, which counts the overlaps of both sides at once and puts out only links that join
components, never pairs. Both ways are exact. Members of a large group of copies are not compared with each other.

Defined cases: a text of fewer than five words is one shingle; texts without words are copies of each
other. Missing texts are empty. White space does not matter. Rows may repeat, also with the same
``doc_id``; a missing id is an id of its own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import (
    give_back, let, materialise, null_safe, one_by_one, short_batches, small, text_of, whole_row, words,
)
from plumbline.llm.components import components
from plumbline.llm.hashing import GOLDEN, mix, unit

SHINGLE = 5
SIMILAR = 0.8
#: Pairs at a similarity of 0.8 share one of 25 bands of 5 registers with a probability of 0.99995.
BANDS, ROWS = 25, 5
#: Documents of about so many shingles get their signatures together: some 20 MB.
SLICE_SHINGLES = 100_000
#: Groups of more members are compared by blocks instead of pairs; the result is the same.
FEW = 64
#: About so many members, and shingles of them, are on each side of a block: some 50 MB in a task.
BLOCK, BLOCK_SHINGLES = 500, 100_000
_DENSE, _ENTRIES = 1024, 250_000


def shingles(tokens: Column, size: int = SHINGLE) -> Column:
    """Sorted 64-bit hashes of all shingles of an array of words."""
    rest = lambda ws: F.transform(
        ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, size)])
    )
    return F.sort_array(F.slice(rest(tokens), F.lit(1), F.greatest(F.size(tokens) - (size - 1), F.lit(1))))


def content(tokens: Column) -> Column:
    """A digest of the word sequence."""
    return F.md5(F.array_join(tokens, " "))


def signatures(sets: np.ndarray, owner: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of ``n`` multisets, given by their elements, sorted, and the set that each belongs to."""
    first = np.ones(len(sets), dtype=bool)
    first[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    weight = np.diff(np.append(starts, len(sets)))
    seed, of = sets[starts], owner[starts]
    level = np.zeros(len(starts), dtype=np.int64)
    # One more process for each doubling of the weight.
    more = [np.flatnonzero(weight > (1 << k) // 2) for k in range(1, int(weight.max(initial=1)).bit_length() + 1)]
    rows = np.concatenate([np.arange(len(starts)), *more])
    level = np.concatenate([level, *[np.full(len(m), k + 1) for k, m in enumerate(more)]])
    seed, of, weight = seed[rows], of[rows], weight[rows]
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    state = mix(seed ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    time = np.zeros(len(state))
    table = np.full(n * registers, np.inf)
    step = 0
    while len(state):
        step += 1
        drawn = mix(state + np.uint64(step * int(GOLDEN) % (1 << 64)))
        time = time - np.log(unit(drawn)) / width
        latest = table.reshape(n, registers).max(axis=1)
        live = time < latest[of]
        state, time, of, weight, low, width = (a[live] for a in (state, time, of, weight, low, width))
        drawn = mix(drawn[live])
        at = of * registers + ((drawn >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        reached = low + 1 + np.floor((unit(mix(drawn)) - 2.0**-53) * width).astype(np.int64) <= weight
        np.minimum.at(table, at[reached], time[reached])
    return table.reshape(n, registers)


def band_keys(table: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(table).view(np.uint64).reshape(len(table), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bits.shape[:2])
    for row in range(ROWS):
        keys = mix(keys ^ bits[:, :, row]) + GOLDEN
    return keys.view(np.int64)


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``shingles`` by ``n`` and ``keys``."""

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("shingles")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        start = 0
        while start < len(lists):
            end = int(np.searchsorted(offsets, offsets[start] + SLICE_SHINGLES, side="right")) - 1
            end = min(max(end, start + 1), len(lists))
            sizes = np.diff(offsets[start: end + 1])
            owner = np.repeat(np.arange(end - start), sizes)
            table = signatures(values[offsets[start]: offsets[end]], owner, end - start)
            keys = band_keys(table)[sizes > 0].reshape(-1)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id")[start:end], batch.column("content")[start:end],
                pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(keys)),
            ], ["doc_id", "content", "n", "keys"])
            start = end

    yield from one_by_one(batches, keyed)


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the sorted multisets ``a`` and ``b`` of every pair."""

    def compared(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column("a"), batch.column("b"))]
        found = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            (x, n), (y, m) = [np.unique(v[o[i]: o[i + 1]], return_counts=True) for o, v in lists]
            _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = int(np.minimum(n[p], m[q]).sum())
            found[i] = both / (int(n.sum()) + int(m.sum()) - both)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found)], ["u", "v", "similarity"])

    yield from one_by_one(batches, compared)


def overlaps(element: np.ndarray, row: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """How many elements each row on the left shares with each on the right; no row has an element twice.

    ``element`` and ``row`` are the entries of both sides, ``right`` tells the side. Elements that many rows have are
    counted by matrix products, the others entry by entry.
    """
    _, element = np.unique(element, return_inverse=True)
    n = int(element.max(initial=-1)) + 1
    on_left, on_right = np.bincount(element[~right], minlength=n), np.bincount(element[right], minlength=n)
    counted = np.zeros(n_left * n_right, dtype=np.int64)
    dense = on_left * on_right > n_left * n_right // 16
    chosen = np.flatnonzero(dense)
    place = np.full(n, -1)
    for start in range(0, len(chosen), _DENSE):
        part = chosen[start: start + _DENSE]
        place[:] = -1
        place[part] = np.arange(len(part))
        sides = []
        for of_side, rows in ((~right, n_left), (right, n_right)):
            taken = of_side & (place[element] >= 0)
            side = np.zeros((rows, len(part)), dtype=np.float32)
            side[row[taken], place[element[taken]]] = 1
            sides.append(side)
        counted += (sides[0] @ sides[1].T).astype(np.int64).reshape(-1)
    left_at = np.flatnonzero(~right & ~dense[element] & (on_right[element] > 0))
    right_at = np.flatnonzero(right & ~dense[element])
    right_at = right_at[np.argsort(element[right_at], kind="stable")]
    first = np.searchsorted(element[right_at], element[left_at])
    times = on_right[element[left_at]]
    upto = np.concatenate([[0], np.cumsum(times)])
    start = 0
    while start < len(left_at):
        end = max(int(np.searchsorted(upto, upto[start] + _ENTRIES, side="right")) - 1, start + 1)
        many = times[start:end]
        step = np.arange(upto[end] - upto[start]) - np.repeat(upto[start:end] - upto[start], many)
        partner = row[right_at[np.repeat(first[start:end], many) + step]]
        counted += np.bincount(np.repeat(row[left_at[start:end]], many) * n_right + partner, minlength=len(counted))
        start = end
    return counted.reshape(n_left, n_right)


def joining(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Numbers of the edges ``left, right`` that join what the edges before leave apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    found = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append(i)
    return found


def _links_of_block(rows: pa.Table) -> pa.RecordBatch:
    """``u, v``: similar rows of the two sides that join different components."""
    node, part = (rows.column(c).to_numpy() for c in ("node", "part"))
    right = rows.column("side").to_numpy() == 1
    lists = rows.column("shingles").combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(len(node)), sizes)
    # The sets are sorted: a shingle that a row has several times counts as so many elements.
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(values))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
    element = np.where(nth > 0, mix(values ^ mix(nth.astype(np.uint64))), values)
    place = np.where(right, np.cumsum(right), np.cumsum(~right)) - 1
    n_right = int(right.sum())
    both = overlaps(element, place[owner], right[owner], len(node) - n_right, n_right)
    whole = sizes[~right][:, None] + sizes[right][None, :] - both
    p, q = part[~right], part[right]
    x, y = np.nonzero((both / whole >= SIMILAR) & (p[:, None] != q[None, :]))
    _, once = np.unique(np.stack([p[x], q[y]]), axis=1, return_index=True)
    x, y = x[once], y[once]
    told = joining(p[x], q[y])
    u, v = node[~right][x[told]], node[right][y[told]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all blocks, whose rows follow each other."""
    kept: list[pa.RecordBatch] = []
    last = batch = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "l", "r")])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(keys[:, start].tolist())
            if kept and key != last:
                yield _links_of_block(pa.Table.from_batches(kept))
                kept = []
            kept.append(batch.slice(start, end - start))
            last = key
    if kept:
        yield _links_of_block(pa.Table.from_batches(kept))
    del batch, kept
    give_back()


class _Corpus:
    """The documents' nodes, the members of all band groups, and the comparison of pairs."""

    def __init__(self, documents: DataFrame):
        self.documents = documents
        short_batches(documents.sparkSession)
        kind = documents.schema["doc_id"].dataType.simpleString()
        tokens = documents.select("doc_id", words(text_of(documents)).alias("ws")).select(
            "doc_id", content(F.col("ws")).alias("content"),
            F.when(F.size("ws") > 0, shingles(F.col("ws"))).otherwise(F.array().cast("array<bigint>")).alias("shingles"),
        )
        self.slim = materialise(
            tokens.mapInArrow(_with_keys, f"doc_id {kind}, content string, n bigint, keys array<bigint>"), "signatures"
        )
        # One node for each word sequence, named by its smallest id; by a hash if that id has several.
        same_id = Window.partitionBy("rep").orderBy("content")
        named = F.when((F.row_number().over(same_id) == 1) & (F.col("rep") >= 0), F.col("rep")).otherwise(
            -1 - F.xxhash64("content").bitwiseAND(F.lit((1 << 62) - 1))
        )
        self.nodes = materialise(
            self.slim.groupBy("content").agg(
                F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys"),
            ).withColumn("node", named), "nodes",
        )
        banded = self.nodes.select("node", "n", F.posexplode("keys").alias("band", "key")).select(
            F.xxhash64("band", "key").alias("bucket"), "band", "node", "n"
        )
        shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        members = materialise(banded.join(shared, "bucket"), "members")
        weight = members.groupBy("node").agg(F.sum("m").alias("weight"))
        weighed = members.join(weight, "node")
        centres = weighed.groupBy("bucket").agg(
            F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("n").alias("n_centre"))).alias("c")
        ).select("bucket", (-F.col("c.minus")).alias("centre"), "c.n_centre", F.col("c.weight").alias("rank"))
        self.members = materialise(members.join(centres, "bucket").select(
            "bucket", "band", "node", "n", "centre", "n_centre", "rank"
        ), "centred")
        self.sets = None

    def _all_sets(self) -> DataFrame:
        """``node, shingles`` of the nodes that share a band with another."""
        named = self.nodes.select("node", F.col("rep").alias("doc_id"), "content").join(
            self.members.select("node").distinct(), "node", "left_semi"
        )
        named = small(materialise(named, "wanted"), 96)
        hashed = self.documents.select("doc_id", words(text_of(self.documents)).alias("ws")).select(
            "doc_id", content(F.col("ws")).alias("content"), "ws"
        )
        sets = hashed.join(named, null_safe(hashed, named, "doc_id", "content")).select(
            "node", shingles(F.col("ws")).alias("shingles")
        )
        return materialise(sets, "sets")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """``u, v, similarity`` of written pairs; both sides must share a band with another node."""
        if self.sets is None:
            self.sets = self._all_sets()
            # Rows that repeat an id and a text have a set each, which only then are reduced to one.
            if self.sets.count() > self.sets.select("node").distinct().count():
                self.sets = materialise(self.sets.dropDuplicates(["node"]), "sets")
        right = self.sets.join(small(materialise(pairs.select(F.col("v").alias("node")).distinct(), "right"), 32), "node", "left_semi")
        right = materialise(right.toDF("v", "b"), "right-sets")
        left = self.sets.toDF("u", "a").join(small(pairs.select("u", "v"), 48), "u")
        joined = left.join(small(right, 64 + 8 * F.size("b")), "v").select("u", "v", "a", "b")
        return materialise(joined.mapInArrow(_similarities, "u bigint, v bigint, similarity double"), "similarities")

    def _rounds(self) -> Iterator[DataFrame]:
        """The pairs of each round, given the components so far, which ``self.found`` holds."""
        stars = self.members.where("node != centre").where(
            F.least("n", "n_centre") >= F.lit(SIMILAR) * F.greatest("n", "n_centre")
        ).select(F.col("node").alias("u"), F.col("centre").alias("v"), "rank").distinct()
        first = stars.groupBy("u").agg(F.max(F.struct("rank", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
        yield first
        yield self._apart(stars.select("u", "v")).join(self.tried.select("u", "v"), ["u", "v"], "left_anti")
        yield self._across().join(self.tried.select("u", "v"), ["u", "v"], "left_anti")

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are not in one component."""
        root = self.found.select("node", "root")
        of_u, of_v = root.toDF("u", "root_u"), root.toDF("v", "root_v")
        joined = pairs.join(of_u, "u", "left").join(of_v, "v", "left")
        return joined.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")

    def _across(self) -> DataFrame:
        """Pairs of a group's members in different components, one of them outside its largest.

        Groups of more than ``FEW`` members are left in ``crowded`` for :meth:`_between_blocks`. A member's distance to the centre is known, or at least what their sizes leave. Pairs whose distances to
        it differ by more than the limit cannot be similar. No estimate leaves a pair out.
        """
        to_centre = self.tried.select(F.col("u").alias("node"), F.col("v").alias("centre"), (1 - F.col("similarity")).alias("known"))
        least = 1 - F.least("n", "n_centre") / F.greatest("n", "n_centre")
        labelled = (
            self.members.join(self.found, "node", "left").join(to_centre, ["node", "centre"], "left")
            .select(
                "bucket", "band", "node", "n", F.coalesce("root", "node").alias("part"),
                F.when(F.col("node") == F.col("centre"), 0.0).otherwise(F.coalesce("known", least)).alias("far"),
                ((F.col("node") == F.col("centre")) | F.col("known").isNotNull()).alias("exact"),
            )
        )
        sizes = labelled.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"))
        blocks = lambda m, size: F.ceil(F.greatest(m / BLOCK, size / BLOCK_SHINGLES, F.lit(1)))
        largest = sizes.groupBy("bucket").agg(
            F.max(F.struct("m", "part", "size")).alias("top"), F.count(F.lit(1)).alias("parts"),
            F.sum("m").alias("m"), F.sum("size").alias("size"),
        ).where("parts > 1").select(
            "bucket", F.col("top.part").alias("main"), "m",
            blocks(F.col("m") - F.col("top.m"), F.col("size") - F.col("top.size")).alias("ls"),
            blocks(F.col("m"), F.col("size")).alias("rs"),
        )
        split = materialise(labelled.join(largest, "bucket"), "split")
        self.crowded = split.where(F.col("m") > FEW)
        signed = self.nodes.select("node", "keys")
        mixed = materialise(split.where(F.col("m") <= FEW).join(signed, "node").select(
            "bucket", "band", "node", "n", "part", "far", "exact", "keys", "main"
        ), "mixed")
        left = mixed.where("part != main").drop("main").toDF("bucket", "band", "x", "n_x", "p", "far_x", "exact_x", "keys_x")
        right = mixed.drop("main", "band").toDF("bucket", "y", "n_y", "q", "far_y", "exact_y", "keys_y")
        limit = F.lit(1 - SIMILAR + 1e-9)
        near = (
            ~(F.col("exact_y") & (F.col("far_x") - F.col("far_y") > limit))
            & ~(F.col("exact_x") & (F.col("far_y") - F.col("far_x") > limit))
        )
        sizes_fit = F.least("n_x", "n_y") >= F.lit(SIMILAR) * F.greatest("n_x", "n_y")
        # A pair is told by the first band that it shares.
        shared = F.array_position(F.zip_with("keys_x", "keys_y", lambda a, b: a == b), True)
        pairs = left.join(right, "bucket").where(
            (F.col("p") != F.col("q")) & near & sizes_fit & (shared == F.col("band") + 1)
        )
        return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()

    def _between_blocks(self) -> DataFrame:
        """Links between components within the groups in ``crowded``, block by block."""
        own = lambda blocks: F.pmod(F.xxhash64("node", F.lit(1)), F.col(blocks))
        every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))
        outside = self.crowded.where("part != main").select(
            "bucket", own("ls").alias("l"), every("rs").alias("r"), F.lit(0).alias("side"), "node", "part"
        )
        members = self.crowded.select(
            "bucket", every("ls").alias("l"), own("rs").alias("r"), F.lit(1).alias("side"), "node", "part"
        )
        placed = materialise(outside.unionByName(members), "blocks")
        rows = self.sets.join(small(placed, 64), "node").select("bucket", "l", "r", "side", "node", "part", "shingles")
        dealt = rows.repartition("bucket", "l", "r").sortWithinPartitions("bucket", "l", "r")
        return materialise(dealt.mapInArrow(_block_links, "u bigint, v bigint").distinct(), "block-links")

    def classes(self) -> DataFrame:
        """``node, root`` of the nodes that are similar to another."""
        self.tried, self.found, links, self.crowded = None, None, None, None
        for pairs in self._rounds():
            pairs = materialise(pairs, "pairs")
            if self.found is not None and pairs.isEmpty():
                continue
            compared = self.compare(pairs)
            self.tried = compared if self.tried is None else self.tried.unionByName(compared)
            similar = compared.where(F.col("similarity") >= SIMILAR).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            links = similar if links is None else links.unionByName(similar)
            self.found = components(links)
        if self.crowded is not None and not self.crowded.isEmpty():
            self.found = components(links.unionByName(self._between_blocks()))
        return self.found


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, content, class_id, rep, first``: the class of each row, named by its smallest id.

    ``rep`` is the smallest id with the row's word sequence, and ``first`` marks the word sequence that
    represents the class.
    """
    corpus = _Corpus(documents)
    rooted = corpus.nodes.select("node", "content", "rep").join(corpus.classes(), "node", "left").select(
        "node", "content", "rep", F.coalesce("root", "node").alias("root")
    )
    rooted = materialise(rooted, "rooted")
    heads = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    labelled = rooted.join(heads, "root").select("content", "class_id", "rep", (F.col("node") == F.col("root")).alias("first"))
    return corpus.slim.select("doc_id", "content").join(labelled, "content")


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of ``documents`` for each class, with all columns."""
    labelled = near_duplicates(documents)
    kept = labelled.where(F.col("first") & F.col("doc_id").eqNullSafe(F.col("rep"))).select(
        F.col("doc_id").alias("id"), F.col("content").alias("of")
    )
    kept = small(materialise(kept.groupBy("id", "of").agg(F.count(F.lit(1)).alias("rows")), "kept"), 96)
    tokens = let(words(text_of(documents)), content)
    rows = documents.select(whole_row(documents).alias("row"), documents["doc_id"].alias("id"), tokens.alias("of"))
    chosen = rows.join(kept, null_safe(rows, kept, "id", "of")).select(rows["id"], rows["of"], "row", "rows")
    once = chosen.where("rows = 1").select("row")
    # Only rows that repeat an id and a text are grouped.
    many = chosen.where("rows > 1").dropDuplicates(["id", "of"]).select("row")
    return once.unionByName(many).select("row.*") if not kept.where("rows > 1").isEmpty() else once.select("row.*")
