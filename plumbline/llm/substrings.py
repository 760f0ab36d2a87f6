"""Removing byte strings that occur before, by the phrases of a prefix-free parse without suffix arrays.

Every text is parsed into phrases by a rolling hash that triggers on the smallest gram of every
100-byte window. Distinct phrases form the dictionary, their occurrences the parse. The order of
phrases in the corpus decides which occurrence is the first. Suffixes of phrases are looked at only where the
dictionary has several phrases for one trigger, and only up to 100 bytes: grouping those prefixes by
hash takes the place of sorting whole suffixes, since a removal needs no longer match.

Defined cases: a missing text is empty. Texts under 100 bytes lose nothing. Rows with the same id
follow each other in the order of their texts; a missing id comes first. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.repeats import Repeats, Shape, covered, runs

LENGTH = 100
GRAM = 48


def without_repeated_bytes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed runs (byte offsets, end exclusive) and the bytes that are left."""
    repeats = Repeats(documents, lambda text: F.encode(text, "UTF-8"), Shape(length, GRAM), keep_first=True)
    rows = repeats.removed().select("doc_id", F.encode("text", "UTF-8").alias("data"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept = [], [], []
            for data, places in zip(batch.column("data"), batch.column("places"), strict=True):
                raw = data.as_py()
                n.append(len(raw))
                if places.is_valid:
                    gone = covered(places.values, len(raw), length)
                    spans.append([{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in runs(gone)), strict=True)])
                    kept.append(np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes())
                else:
                    spans.append([])
                    kept.append(raw)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, type=pa.int64()),
                pa.array(spans, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, type=pa.binary()),
            ], ["doc_id", "n_bytes", "spans", "kept"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
