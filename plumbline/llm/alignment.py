"""Alignment of two tokenizers over the same bytes, and how common each linked pair of ids is in the corpus.

Tokenizer A cuts ``" " + text`` into byte-level tokens, tokenizer B cuts the text itself and adds the space.
Both give intervals of the same bytes. Where an interval of each ends, a group ends; an A and a B token are linked
if their intervals overlap. The union of both sets of ends cuts the bytes into as many pieces as there are
links, and each piece lies in exactly one token of either side, so links are found by counting ends.

Passes:

1. Documents are dealt to chunks of about ``CHUNK_BYTES`` and written. Every chunk is aligned, and gives its
   distinct pairs with the number of its documents that hold each, cut into ``SLICES`` by a hash of the pair.
2. The distinct pairs of a slice get numbers by a minimal perfect hash. Counts are dense vectors indexed by
   that number, one per part of a slice, summed as a tree of bounded fan-in. The pairs by number are kept, and each
   lookup is compared with them. Ids take 16 bits each, and there are no more pairs than the product of the
   vocabularies: some 6 million in a slice for 50,000 and 32,000 ids, whatever the corpus.
3. Chunks ask the slices for the counts of their pairs, the documents are aligned a second time, and look up.

Words repeat, and both tokenizers cut before a space that follows a character that is none, so the stretches
between such places are encoded independently. Every different stretch of a chunk is encoded and
aligned once, many of them in one call; where bytes or ends of such a call do not agree, each by itself.

Defined cases: texts that are missing, empty, or which a tokenizer does not give back byte by byte (such
as those with U+2581) have no tokens, links or groups. Repeated rows are documents of their own. A missing
id stays missing. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, text_of
from plumbline.llm.perfect_hash import PerfectHash, mixed

#: Bytes of text in a chunk, of text encoded in one call, and of keys of a slice in one part; fan-in of the tree.
CHUNK_BYTES = 16 * 1024**2
CALL_BYTES = 1 << 18
PART_BYTES = 32 * 1024**2
FAN_IN = 16
#: Slices of all pairs, a power of two.
SLICES = 256

# How the byte-level tokenizer cuts a text before it merges, and what stands for a space in B.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOW_LINE = "▁"

_CUT = re.compile(r" (?<=\S )")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_character() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Byte-level BPE from its vocabulary file; ids and the bytes of each."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        to_byte, ids = _byte_of_character(), model["vocab"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [ids[t] for t in merged]
        if order != sorted(order):
            raise ValueError(f"{path}: ids do not follow the order of merges, so they are not ranks")
        ranks = {bytes(to_byte[c] for c in t): ids[t] for t in [*to_byte, *merged]}
        self.encoding = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (1 + max(ranks.values()))
        for b, i in ranks.items():
            self.bytes[i] = b

    def __call__(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(" " + text)


class Pieces:
    """Sentence pieces from a model file; ids and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace(LOW_LINE, " ").encode())
        spaced = [p for p in map(self.processor.id_to_piece, range(len(self.bytes))) if LOW_LINE in p.lstrip(LOW_LINE)]
        #: Whether no piece reaches over the start of a word, so that words may be encoded apart.
        self.by_word = not spaced

    def __call__(self, text: str) -> list[int]:
        return self.processor.encode(text, num_threads=1)


class _Codes(dict):
    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


class Aligner:
    """Both tokenizers and tables of their tokens' lengths and digits."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.lengths = [np.array([len(t) for t in side.bytes], dtype=np.int64) for side in (self.a, self.b)]
        top = max(len(self.a.bytes), len(self.b.bytes))
        if top > 1 << 16:
            raise ValueError("a pair of ids is kept in 32 bits, so a vocabulary can have 65,536 ids at most")
        text = np.array([str(i).rjust(5) + "," for i in range(top)], dtype="S6").view(np.uint8).reshape(top, 6)
        self.digits, self.shown = text, text != ord(" ")

    def stretches(self, text: str) -> list[str]:
        """The text cut where both tokenizers cut; each stretch stands for itself with a space before it."""
        if not self.b.by_word:
            return [text]
        parts = _CUT.split(text)
        if len(parts) > 1 and (not parts[-1] or parts[-1][-1].isspace()):
            parts[-2:] = [parts[-2] + " " + parts[-1]]
        return parts

    def whole(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both sides' bytes are those of the text."""
        data = b" " + text.encode()
        return all(
            lengths[ids].sum() == len(data) and b"".join(map(side.bytes.__getitem__, ids.tolist())) == data
            for side, lengths, ids in ((self.a, self.lengths[0], a), (self.b, self.lengths[1], b))
        )


class Aligned:
    """The alignment of many different stretches: per stretch its counts, links and groups as text."""

    def __init__(self, aligner: Aligner, stretches: list[str]):
        self.aligner = aligner
        n = len(stretches)
        self.valid = np.zeros(n, dtype=bool)
        self.n_a, self.n_b, self.n_groups = (np.zeros(n, dtype=np.int64) for _ in range(3))
        self.groups = [b""] * n
        self._links: list[np.ndarray] = []
        self._owner: list[np.ndarray] = []
        call: list[int] = []
        size = 0
        for i, s in enumerate(stretches):
            if not s or LOW_LINE in s:
                continue
            if s[-1].isspace() or not aligner.b.by_word:
                self._align(stretches, [i])
                continue
            call.append(i)
            size += len(s)
            if size > CALL_BYTES:
                self._align(stretches, call)
                call, size = [], 0
        if call:
            self._align(stretches, call)
        owner = np.concatenate(self._owner) if self._owner else np.empty(0, np.int64)
        links = np.concatenate(self._links) if self._links else np.empty(0, np.uint32)
        order = np.argsort(owner, kind="stable")
        self.links = links[order]
        self.n_links = np.bincount(owner, minlength=n).astype(np.int64)
        self.starts = np.cumsum(self.n_links) - self.n_links

    def _align(self, stretches: list[str], call: list[int]) -> None:
        text = " ".join([stretches[i] for i in call])
        a, b = (np.array(side(text), dtype=np.int64) for side in (self.aligner.a, self.aligner.b))
        ends = np.cumsum([1 + len(stretches[i].encode()) for i in call])
        if self.aligner.whole(text, a, b):
            at_a, at_b = np.cumsum(self.aligner.lengths[0][a]), np.cumsum(self.aligner.lengths[1][b])
            is_a, is_b = np.zeros(ends[-1] + 1, dtype=bool), np.zeros(ends[-1] + 1, dtype=bool)
            is_a[at_a], is_b[at_b] = True, True
            if (is_a & is_b)[ends].all():
                self._record(call, ends, a, b, at_a, at_b, is_a, is_b)
                return
        if len(call) > 1:
            for i in call:
                self._align(stretches, [i])

    def _record(self, call, ends, a, b, at_a, at_b, is_a, is_b) -> None:
        codes = np.array(call)
        self.valid[codes] = True
        # Every place where a token ends closes one link; the tokens are those whose end is not yet passed.
        places = np.flatnonzero(is_a | is_b)
        in_a = np.cumsum(is_a[places]) - is_a[places]
        in_b = np.cumsum(is_b[places]) - is_b[places]
        self._links.append((a[in_a] << 16 | b[in_b]).astype(np.uint32))
        self._owner.append(codes[np.searchsorted(ends, places)])
        common = np.flatnonzero(is_a & is_b)
        group_a, group_b = np.searchsorted(common, at_a), np.searchsorted(common, at_b)
        for counts, at in ((self.n_a, at_a), (self.n_b, at_b), (self.n_groups, common)):
            counts[codes] = np.bincount(np.searchsorted(ends, at), minlength=len(codes))
        # Tokens in the order of the text of groups: those of A, then those of B of every group.
        per_a, per_b = (np.bincount(g, minlength=len(common)) for g in (group_a, group_b))
        before_b, upto_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
        spot_a, spot_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + upto_a[group_b]
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        ids[spot_a], ids[spot_b] = a, b
        digits = self.aligner.digits[ids]
        digits[upto_a + before_b - 1, 5] = ord("|")
        digits[upto_a + np.cumsum(per_b) - 1, 5] = ord(";")
        shown = self.aligner.shown[ids]
        text = digits[shown].tobytes()
        written = np.cumsum(shown.sum(axis=1))
        last = np.searchsorted(common, ends)
        stops = written[(upto_a + np.cumsum(per_b) - 1)[last]].tolist()
        start = 0
        for code, stop in zip(call, stops, strict=True):
            self.groups[code] = text[start : stop - 1]
            start = stop


class Documents:
    """The documents of a chunk as codes of their stretches."""

    def __init__(self, aligner: Aligner, texts: list[str]):
        codes = _Codes()
        counted, flat = [], []
        for text in texts:
            own = np.fromiter(map(codes.__getitem__, aligner.stretches(text)), dtype=np.int64)
            counted.append(len(own))
            flat.append(own)
        self.n = np.array(counted, dtype=np.int64)
        self.codes = np.concatenate(flat) if flat else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.n)
        self.aligned = Aligned(aligner, list(codes))
        self.valid = np.bincount(self.owner, weights=~self.aligned.valid[self.codes], minlength=len(texts)) == 0

    def total(self, per_stretch: np.ndarray) -> np.ndarray:
        """The sum of a measure over the stretches of every document; 0 without tokens."""
        upto = np.concatenate([[0], np.cumsum(per_stretch[self.codes])])
        ends = np.cumsum(self.n)
        return np.where(self.valid, upto[ends] - upto[ends - self.n], 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of all documents, and the number of documents that hold each."""
        used = self.valid[self.owner]
        once = np.unique(self.owner[used] * len(self.aligned.valid) + self.codes[used])
        found = []
        for at in range(0, len(once), 1 << 18):
            owner, code = np.divmod(once[at : at + (1 << 18)], len(self.aligned.valid))
            n = self.aligned.n_links[code]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.aligned.starts[code], n)
            found.append(np.unique(np.repeat(owner, n) << 32 | self.aligned.links[place].astype(np.int64)))
        # A document can lie in two of the slices above.
        return np.unique(np.unique(np.concatenate(found or [np.empty(0, np.int64)])) & 0xFFFFFFFF, return_counts=True)


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _in_chunks(documents: DataFrame) -> DataFrame:
    """``chunk, doc_id, text``: consecutive rows of a task, by bytes."""
    inputs = documents.select(documents["doc_id"].alias("doc_id"), text_of(documents).alias("text"))
    kind = inputs.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = seen + np.cumsum(size)
            chunk = pa.array(first + (upto - size) // CHUNK_BYTES)
            seen = int(upto[-1]) if len(upto) else seen
            yield pa.RecordBatch.from_arrays([chunk, batch["doc_id"], batch["text"]], ["chunk", "doc_id", "text"])

    return inputs.mapInArrow(deal, f"chunk bigint, doc_id {kind}, text string")


_PAIRS = pa.schema([("chunk", pa.int64()), ("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _slice_rows(chunk: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    place = (mixed(keys) >> np.uint64(56)).astype(np.int64) * SLICES >> 8
    order = np.argsort(place, kind="stable")
    keys, counts = keys[order].astype(np.uint32), counts[order].astype(np.int64)
    ends = np.cumsum(np.bincount(place, minlength=SLICES))
    rows = [
        {"chunk": chunk, "slice": s, "keys": keys[start:end].tobytes(), "counts": counts[start:end].tobytes()}
        for s, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if end > start
    ]
    return pa.RecordBatch.from_pylist(rows, schema=_PAIRS)


def _pairs(chunks: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``chunk, slice, keys, counts`` of every chunk; a chunk that two tasks read gives its rows twice, with a share each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if texts:
                yield _slice_rows(chunk, *Documents(_aligner(paths), texts).pairs())

        for batch in batches:
            number = batch["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end > start:
                    if number[start] != chunk:
                        yield from done()
                        chunk, texts = int(number[start]), []
                    texts += batch["text"][start:end].to_pylist()
        yield from done()

    return chunks.select("chunk", "text").mapInArrow(run, "chunk bigint, slice int, keys binary, counts binary")


def _numbers(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=kind) for v in column.to_pylist()]


def _tree(table: DataFrame, parts: int, merge: Callable[[pa.Table], dict[str, bytes]], columns: list[str]) -> DataFrame:
    """Rows ``slice, part, ...`` merged to one per slice, at most ``FAN_IN`` rows of a slice in a task."""
    schema = "slice int, part int, " + ", ".join(f"{c} binary" for c in columns)

    def merged(group: pa.Table) -> pa.Table:
        found = merge(group)
        head = [group["slice"].slice(0, 1).combine_chunks(), group["part"].slice(0, 1).combine_chunks()]
        return pa.table([*head, *[pa.array([found[c]], type=pa.binary()) for c in columns]], ["slice", "part", *columns])

    while True:
        table = table.groupBy("slice", "part").applyInArrow(merged, schema)
        if parts == 1:
            return table
        parts = -(-parts // FAN_IN)
        table = table.withColumn("part", (F.col("part") / FAN_IN).cast("int"))


def _distinct(group: pa.Table) -> dict[str, bytes]:
    return {"keys": np.unique(np.concatenate(_numbers(group["keys"], np.uint32))).tobytes()}


def _sum(group: pa.Table) -> dict[str, bytes]:
    vectors = _numbers(group["counts"], np.int64)
    total = vectors[0].copy()
    for v in vectors[1:]:
        total += v
    return {"counts": total.tobytes()}


def _hashed(keys: DataFrame) -> DataFrame:
    """``slice, sizes, bits, keys``: the hash of every slice's keys, and the keys by their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, own in zip(batch["slice"].to_pylist(), _numbers(batch["keys"], np.uint32), strict=True):
                function = PerfectHash.of(own)
                ordered = np.empty_like(own)
                ordered[function.numbers(own)] = own
                sizes, bits = function.to_bytes()
                yield pa.RecordBatch.from_pylist([{"slice": s, "sizes": sizes, "bits": bits, "keys": ordered.tobytes()}], schema=schema)

    schema = pa.schema([("slice", pa.int32()), ("sizes", pa.binary()), ("bits", pa.binary()), ("keys", pa.binary())])
    return keys.select("slice", "keys").mapInArrow(run, "slice int, sizes binary, bits binary, keys binary")


def _found(slice_row: dict, keys: np.ndarray) -> np.ndarray:
    """The numbers of keys, each checked against the key that has the number."""
    numbers = PerfectHash.from_bytes(slice_row["sizes"], slice_row["bits"]).numbers(keys)
    stored = np.frombuffer(slice_row["keys"], dtype=np.uint32)
    if len(keys) and (numbers.min() < 0 or not np.array_equal(stored[numbers], keys)):
        raise LookupError("a pair is not in the index of its slice")
    return numbers


def pair_counts(pairs: DataFrame, parts: int) -> DataFrame:
    """``slice, sizes, bits, keys, counts``: in how many documents each pair stands, by perfect hash."""
    split = pairs.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int"))
    hashes = materialise(_hashed(_tree(split.select("slice", "part", "keys"), parts, _distinct, ["keys"])), "hashes")
    spread = hashes.select(
        F.col("slice").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"),
        *[F.col(c).alias(f"hash_{c}") for c in ("sizes", "bits", "keys")],
    )

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["slice", "part", "counts"]
        if not len(left):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names)
        row = {c: right[f"hash_{c}"][0].as_py() for c in ("sizes", "bits", "keys")}
        keys = np.concatenate(_numbers(left["keys"], np.uint32))
        vector = np.zeros(len(row["keys"]) // 4, dtype=np.int64)
        np.add.at(vector, _found(row, keys), np.concatenate(_numbers(left["counts"], np.int64)))
        head = [left["slice"].slice(0, 1).combine_chunks(), left["part"].slice(0, 1).combine_chunks()]
        return pa.table([*head, pa.array([vector.tobytes()], type=pa.binary())], names)

    vectors = split.groupBy("slice", "part").cogroup(spread.groupBy("of", "at")).applyInArrow(dense, "slice int, part int, counts binary")
    summed = _tree(vectors, parts, _sum, ["counts"]).select(F.col("slice").alias("of"), "counts")
    return materialise(hashes.join(summed, F.col("slice") == F.col("of")).drop("of"), "pair-counts")


def best_counts(index: DataFrame) -> DataFrame:
    """``a, best``: the highest count of every A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(_numbers(batch["keys"], np.uint32), _numbers(batch["counts"], np.int64), strict=True):
                ids, at = np.unique(keys >> 16, return_inverse=True)
                best = np.zeros(len(ids), dtype=np.int64)
                np.maximum.at(best, at, counts)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(best)], ["a", "best"])

    return index.select("keys", "counts").mapInArrow(run, "a int, best bigint").groupBy("a").agg(F.max("best").alias("best"))


def _answers(pairs: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """``asked, keys, counts``: for every chunk the counts of its pairs."""
    split = pairs.select("chunk", "slice", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "keys")
    spread = index.select(
        F.col("slice").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"),
        *[F.col(c).alias(f"hash_{c}") for c in ("sizes", "bits", "keys", "counts")],
    )

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = _numbers(left["keys"], np.uint32)
        counts: list[bytes] = []
        if keys:
            row = {c: right[f"hash_{c}"][0].as_py() for c in ("sizes", "bits", "keys", "counts")}
            found = np.frombuffer(row["counts"], dtype=np.int64)[_found(row, np.concatenate(keys))]
            counts = [c.tobytes() for c in np.split(found, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table([left["chunk"], left["keys"], pa.array(counts, type=pa.binary())], ["asked", "keys", "counts"])

    return split.groupBy("slice", "part").cogroup(spread.groupBy("of", "at")).applyInArrow(
        answer, "asked bigint, keys binary, counts binary"
    )


_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned(documents: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``groups`` is the text of the groups. ``vocabularies`` are the paths of a byte-level vocabulary and of a piece model
    that every executor can read.
    """
    paths = tuple(vocabularies or default_vocabularies())
    chunks = materialise(_in_chunks(documents), "chunks")
    pairs = materialise(_pairs(chunks, paths), "pairs")
    size = pairs.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = max(1, -(-size // (SLICES * PART_BYTES)))
    index = pair_counts(pairs, parts)
    # One number per id of A: bounded by its vocabulary.
    rows = best_counts(index).collect()
    best = np.zeros(1 + max((r["a"] for r in rows), default=0), dtype=np.int64)
    for r in rows:
        best[r["a"]] = r["best"]
    answers = _answers(pairs, index, parts)
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Documents(_aligner(paths), left["text"].to_pylist())
        links, of = found.aligned.links, found.aligned
        counts = np.zeros(len(links), dtype=np.int64)
        if len(right):
            keys = np.concatenate(_numbers(right["keys"], np.uint32))
            order = np.argsort(keys)
            at = np.searchsorted(keys[order], links)
            at = np.minimum(at, len(keys) - 1)
            # Links of texts without tokens are no pairs of the corpus and have no count.
            counts = np.where(keys[order][at] == links, np.concatenate(_numbers(right["counts"], np.int64))[order][at], 0)
        top = (counts == best[np.minimum(links >> 16, len(best) - 1)]).astype(np.int64)
        upto = [np.concatenate([[0], np.cumsum(v)]) for v in (top, counts)]
        n_best, count_sum = (u[of.starts + of.n_links] - u[of.starts] for u in upto)
        measures = [found.total(v) for v in (of.n_a, of.n_b, of.n_groups, of.n_links, n_best, count_sum)]
        groups, at = [], 0
        for n, valid in zip(found.n.tolist(), found.valid.tolist(), strict=True):
            groups.append(b";".join(map(of.groups.__getitem__, found.codes[at : at + n].tolist())).decode() if valid else "")
            at += n
        return pa.table(
            [left["doc_id"], *[pa.array(m) for m in measures], pa.array(groups, type=pa.string())], ["doc_id", *_COUNTS, "groups"]
        )

    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, groups string"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("asked")).applyInArrow(look_up, schema)
