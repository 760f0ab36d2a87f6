"""Removing word sequences that occur more than once, by the phrases of ``repeats``.

Windows of 35 words that share a trigger and follow each other in a text form a phrase; phrases of equal
content are counted together, and their windows then all have several occurrences. Only at triggers with
several contents windows are compared singly, by hashes. No De Bruijn graph is built. All occurrences go,
the first one included.

Defined cases: a missing text has no words. Texts under 35 words lose nothing. Repeated rows are
occurrences of their own, also with the same id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import words
from plumbline.llm.repeats import Repeats, Shape, covered, runs

LENGTH = 35
GRAM = 8


def without_repeated_passages(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, spans, kept``: removed runs of words (end exclusive) and the words that are left."""
    hashed = lambda text: F.transform(words(text), lambda w: F.xxhash64(w))
    repeats = Repeats(documents, hashed, Shape(length, GRAM), keep_first=False)
    rows = repeats.removed().select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                ws = text.as_buffer().to_pybytes().split()
                n.append(len(ws))
                spans.append([])
                if places.is_valid:
                    gone = covered(places.values, len(ws), length)
                    spans[-1] = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True)]
                    ws = [ws[i] for i in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(ws).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, type=pa.int64()),
                pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, type=pa.string()),
            ], ["doc_id", "n_words", "spans", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept string")
