"""Token alignment and the perfect hash behind it, against plain Python."""

import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import alignment
from plumbline.llm.perfect_hash import PerfectHash

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from tokenizers import Tokenizer  # noqa: E402

TEXTS = [
    None, "", " ", "  ", "\n", "a", " lead", "trail ", "trail\n", "two  spaces", "tab\there \n new", "x▁y stays out", "\x00nul",
    "<|endoftext|> and </s> are plain", "café naïve \U0001F600　wide  gap", "don't we'll it's 'tis 12345 67 #!?",
    "word " * 400, "same words here", "same words here", "z" * 3000, "中文 عربي \x1c\x85 end\r\n",
]


def plain(rows):
    """What the contract of the query says, one token at a time, with the other library for the byte-level side."""
    a_path, b_path = alignment.default_vocabularies()
    a_side, b_side = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_side.encode_special_tokens = True
    to_byte = alignment._byte_of_character()

    def a_bytes(i):
        return bytes(to_byte[c] for c in a_side.id_to_token(i))

    def b_bytes(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    found, holds = [], Counter()
    for key, text in rows:
        a, b = a_side.encode(" " + (text or ""), add_special_tokens=False).ids, b_side.encode(text or "")
        data = b" " + (text or "").encode()
        if not text or any(b"".join(map(f, ids)) != data for f, ids in ((a_bytes, a), (b_bytes, b))):
            found.append((key, None))
            continue
        of_byte = [[i for i, t in enumerate(ids) for _ in f(t)] for f, ids in ((a_bytes, a), (b_bytes, b))]
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*of_byte, strict=True)))]
        groups, start = [], (0, 0)
        for at in range(len(data)):
            here, after = [o[at] for o in of_byte], [o[at + 1] if at + 1 < len(data) else -1 for o in of_byte]
            if all(x != y for x, y in zip(here, after, strict=True)):
                groups.append("|".join(",".join(map(str, ids[s : e + 1])) for ids, s, e in zip((a, b), start, here, strict=True)))
                start = (here[0] + 1, here[1] + 1)
        holds.update(set(links))
        found.append((key, (len(a), len(b), groups, links)))
    best = defaultdict(int)
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    for key, f in found:
        if f is None:
            yield key, 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, groups, links = f
            tops = sum(holds[x] == best[x[0]] for x in links)
            yield key, n_a, n_b, len(groups), len(links), tops, sum(holds[x] for x in links), ";".join(groups)


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(TEXTS)] + [(3, "  "), (16, "word " * 400)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_alignment_of_odd_texts(documents):
    found = alignment.aligned(documents.select("*", *[F.lit(1).alias(c) for c in ("chunk", "slice", "part", "keys", "of", "at")]))
    assert sorted_rows(found.collect()) == sorted_rows(plain([tuple(r) for r in documents.collect()]))


def test_parts_and_slices_do_not_change_counts(spark, documents, monkeypatch):
    """Many parts of a slice, a tree of several levels, and chunks of a few documents."""
    whole = sorted_rows(alignment.aligned(documents).collect())
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 64)
    monkeypatch.setattr(alignment, "PART_BYTES", 4)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "SLICES", 4)
    assert sorted_rows(alignment.aligned(documents).collect()) == whole


def test_alignment_of_an_empty_table(documents):
    assert alignment.aligned(documents.limit(0)).collect() == []


def test_alignment_of_whole_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = alignment.aligned(documents).collect()
    assert sorted_rows(found) == sorted_rows(plain([tuple(r) for r in documents.collect()]))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_numbers_all_keys(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**32, n).astype(np.uint32))
    function = PerfectHash.from_bytes(*PerfectHash.of(keys).to_bytes())
    assert sorted(function.numbers(keys).tolist()) == list(range(len(keys)))


def test_a_key_outside_the_set_is_noticed():
    keys = np.arange(1, 2000, 2, dtype=np.uint32)
    function = PerfectHash.of(keys)
    ordered = np.empty_like(keys)
    ordered[function.numbers(keys)] = keys
    sizes, bits = function.to_bytes()
    row = {"sizes": sizes, "bits": bits, "keys": ordered.tobytes()}
    assert (ordered[alignment._found(row, keys)] == keys).all()
    with pytest.raises(LookupError):
        alignment._found(row, np.array([1, 4], dtype=np.uint32))
