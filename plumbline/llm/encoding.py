"""BPE encoding that encodes every shared chunk of text once, and decoding.

Texts are cut behind words where a rolling hash of the last eight bytes hits a trigger, so that equal
passages of different documents give equal chunks wherever they stand. A task keeps the ids of the chunks
and words it has met and asks the tokenizer only for words it does not know, all missing words of a slice of
documents at once and many as one text, parted by a separator whose id no word in it gives. A word of
ASCII letters is asked for in lower case and without the mark behind it, where the tokenizer lowers and cuts
there anyway. The caches live as long as the task, as its Python worker stays beside those of later stages, and are
bounded: full ones become the old generation, of which only what is met again is kept. That costs time but never
changes a result.

Decoded text is joined from the tokens of all ids of a slice at once if the tokenizer has no decoder of its own.

Joins are repaired. Cuts lie at white space, which the tokenizer drops, so the parts on both sides are
independent unless the text after the cut begins with a combining mark that could merge with what
stands before it. Those joins are tried: the words on both sides are encoded together, and where that
differs from the two parts the chunks are encoded as one, until all joins agree.

Defined cases: a missing text is an empty one and gives no ids. Rows are encoded one by one, so
repeated rows and ids give repeated results. A text without white space is one chunk, whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.common import one_by_one, short_batches, text_of

#: One cut in so many word ends, entries per generation of a cache and bytes of text in the chunks of one, words in a text
#: that is asked for, texts asked for at once, and bytes of text handled together.
CUT_EVERY = 32
KEPT_CHUNKS = 10_000
KEPT_WORDS = 150_000
KEPT_BYTES = 6_000_000
TOGETHER = 100
ASKED = 50
SLICE_BYTES = 2_000_000

#: Stands between words that are asked for as one text; words that hold it are asked for alone.
SEPARATOR = b"\x01"
_MARKS = frozenset(b".,;:!?")

_TAIL = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 9, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Places of white space behind a word whose last eight bytes hash to a trigger."""
    if len(data) < 9:
        return np.empty(0, dtype=np.int64)
    space = _IS_SPACE[data]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    ends = ends[ends >= 8]
    hashed = np.zeros(len(ends), dtype=np.uint64)
    for k in range(8):
        hashed += data[ends - 1 - k].astype(np.uint64) * _TAIL[k]
    return ends[(hashed >> np.uint64(40)) % np.uint64(CUT_EVERY) == 0]


class Cache:
    """What was met, in two generations: a full one becomes the old one, and what is met again moves to the new one."""

    def __init__(self, entries: int, size: int):
        self.entries, self.size = entries, size
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bytes = 0

    def missing(self, keys: set[bytes]) -> set[bytes]:
        """Those that have to be added; all others are in ``new`` afterwards."""
        if len(self.new) > self.entries or self.bytes > self.size:
            self.old, self.new, self.bytes = self.new, {}, 0
        absent = keys.difference(self.new)
        again = absent.intersection(self.old)
        self.add((k, self.old[k]) for k in again)
        return absent - again

    def add(self, found: Iterable[tuple[bytes, bytes]]) -> None:
        for key, ids in found:
            self.new[key] = ids
            self.bytes += len(key)


def head(word: bytes) -> bytes:
    """What a word is asked for as: a mark behind an ASCII letter is parted, a word of ASCII letters lowered."""
    if len(word) > 1 and word[-1] in _MARKS and word[-2:-1].isalpha():
        word = word[:-1]
    return word.lower() if word.isalpha() else word


class Encoder:
    """A tokenizer with caches of words and chunks, whose values are the ids as bytes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()
        parted = self._ids([SEPARATOR.decode()])[0]
        self.separator = int(parted[0]) if len(parted) == 1 else None
        self.parts_marks = self.ask([b"Word."]) == [b"".join(self.ask([b"word", b"."]))]
        self.tokens = None
        if self.tokenizer.decoder is None:
            ids = range(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
            self.tokens = pa.array([self.tokenizer.id_to_token(i) or "" for i in ids], type=pa.string())

    def forget(self) -> None:
        """Empties the caches."""
        self.words = Cache(KEPT_WORDS, KEPT_BYTES)
        self.chunks = Cache(KEPT_CHUNKS, KEPT_BYTES)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, texts: list[bytes]) -> list[bytes]:
        """The tokenizer's answers one by one; it keeps much beside the ids of each text, so few are asked for at once."""
        n = ASKED * TOGETHER
        return [i.tobytes() for at in range(0, len(texts), n) for i in self._ids([t.decode() for t in texts[at : at + n]])]

    def ask_together(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The same of words, many as one text, with the word before each answer."""
        alone = [w for w in words if SEPARATOR in w] if self.separator is not None else words
        yield from zip(alone, self.ask(alone), strict=True)
        words = [w for w in words if SEPARATOR not in w] if alone else words
        if self.separator is None:
            return
        between = b" " + SEPARATOR + b" "
        for at in range(0, len(words), ASKED * TOGETHER):
            groups = [words[i : i + TOGETHER] for i in range(at, min(at + ASKED * TOGETHER, len(words)), TOGETHER)]
            for group, ids in zip(groups, self._ids([between.join(g).decode() for g in groups]), strict=True):
                ends = np.flatnonzero(ids == self.separator)
                if len(ends) != len(group) - 1:
                    yield from zip(group, self.ask(group), strict=True)
                    continue
                found, places = ids.tobytes(), (4 * ends).tolist()
                starts = [0, *[p + 4 for p in places]]
                yield from zip(group, [found[a:b] for a, b in zip(starts, [*places, len(found)], strict=True)], strict=True)

    def learn(self, chunks: set[bytes]) -> None:
        """Fills the caches with all words and chunks that are not there yet."""
        new = {c: c.split() for c in self.chunks.missing(chunks)}
        missing = self.words.missing(set().union(*new.values()))
        if self.parts_marks:
            asked = {w: head(w) for w in missing}
            parts = set(asked.values()) | {w[-1:] for w, h in asked.items() if len(h) < len(w)}
            known = dict(self.ask_together([p for p in parts if p not in self.words.new]))
            known |= {p: self.words.new[p] for p in parts if p not in known}
            self.words.add((w, known[h] if len(h) == len(w) else known[h] + known[w[-1:]]) for w, h in asked.items())
        else:
            self.words.add(self.ask_together(list(missing)))
        ids = self.words.new
        self.chunks.add((chunk, b"".join([ids[w] for w in ws])) for chunk, ws in new.items())

    def agree(self, left: bytes, right: bytes) -> bool:
        """Whether the chunks encode alone as they do together."""
        start = right.lstrip()[:4].decode(errors="ignore")[:1]
        if not start or ord(start) < 0x300 or not unicodedata.combining(start):
            return True
        a, b = (left.split() or [b""])[-1], right.split()[0]
        return b"".join(self.ask([a, b])) == self.ask([a + b" " + b])[0]

    def text(self, chunks: list[bytes]) -> bytes:
        if not chunks:
            return b""
        known = self.chunks.new
        repaired, last = [known[chunks[0]]], chunks[0]
        for chunk in chunks[1:]:
            if self.agree(last, chunk):
                repaired.append(known[chunk])
                last = chunk
            else:
                last += chunk
                repaired[-1] = self.ask([last])[0]
        return b"".join(repaired)

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        if self.tokens is None:
            return pa.array(self.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False), type=pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values)), " ")


_encoders: dict[str, Encoder] = {}


def _slices(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES``."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset: texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end
        start = end


def encode_texts(texts: list[bytes], encoder: Encoder) -> list[bytes]:
    """Ids (32-bit, as bytes) of each UTF-8 text."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    cuts = cut_points(data)
    split = np.searchsorted(cuts, ends - 1)
    first, parts, at = 0, [], 0
    for text, last, end in zip(texts, split.tolist(), ends.tolist(), strict=True):
        places = [0, *[c - at for c in cuts[first:last].tolist() if c > at], len(text)]
        parts.append([text[a:b] for a, b in zip(places, places[1:], strict=False) if b > a])
        first, at = last, end
    encoder.learn({chunk for chunks in parts for chunk in chunks})
    return [encoder.text(chunks) for chunks in parts]


def encoded_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, ids, decoded`` of a task's rows; the tokenizer stays for the worker's next task, the caches go."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder = _encoders[path]

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text")
        for start, end in _slices(texts):
            rows = encode_texts([t.as_buffer().to_pybytes() for t in texts[start:end]], encoder)
            lengths = [0, *[len(ids) // 4 for ids in rows]]
            values = pa.array(np.frombuffer(b"".join(rows), dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), type=pa.int32()), values)
            decoded = encoder.decoded(ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[start:end], ids, decoded], ["doc_id", "ids", "decoded"])

    yield from one_by_one(batches, rows_of, encoder.forget)


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of each row.

    ``vocabulary`` is the path of a tokenizer file that every executor can read.
    """
    path = vocabulary or default_vocabulary()
    short_batches(documents.sparkSession)
    inputs = documents.select("doc_id", text_of(documents).alias("text"))
    kind = inputs.schema["doc_id"].dataType.simpleString()
    return inputs.mapInArrow(lambda batches: encoded_rows(batches, path), f"doc_id {kind}, ids array<int>, decoded string")
