"""Delimited records whose quoted fields may hold line breaks, read in parallel.

Whether a line break ends a record depends on the quotes before it, back to the start of the file. Every split
of a file is therefore read as a function of the state it starts in (outside or inside quotes): one pass finds
to which state each split leads from both, these functions are composed along every file, and a second pass
reads each split from its true state. A quote only opens a quoted field at the start of a field; elsewhere it is
a character like others. Records that reach over the end of a split leave a piece in each of the splits,
at most two per split, which are joined by file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of rows: a whole record, and pieces of one in the order in which they stand in a split.
RECORD, END_OF_ONE, START_OF_ONE = 0, 1, 2

_SCHEMA = "file string, start bigint, kind int, header boolean, fields array<string>"


@dataclass(frozen=True)
class Dialect:
    """How fields are written. ``escape`` is the quote itself where quotes are doubled."""

    sep: str = ","
    quote: str = '"'
    escape: str = '"'
    comment: str | None = None
    skip_space: bool = False
    line_end: str = "\n"
    encoding: str = "UTF-8"

    def closing(self) -> re.Pattern:
        """Matches from inside quotes up to the quote that ends them."""
        q, e = re.escape(self.quote), re.escape(self.escape)
        skipped = rf"[^{q}]++|{q}{q}" if self.escape == self.quote else rf"[^{q}{e}]++|{e}.|{q}{q}"
        return re.compile(rf"(?:{skipped})*+{q}", re.S)

    def state_after(self) -> Callable[[str, bool], bool]:
        """Whether a line ends inside quotes, by the line and whether it starts inside."""
        closing, sep, quote, skip = self.closing(), self.sep, self.quote, self.skip_space

        def after(line: str, inside: bool) -> bool:
            if quote not in line:
                return inside
            at = 0
            while True:
                if inside:
                    found = closing.match(line, at)
                    if found is None:
                        return True
                    at, inside = found.end(), False
                else:
                    if skip:
                        at += len(line) - at - len(line[at:].lstrip(" "))
                    if line.startswith(quote, at):
                        at, inside = at + len(quote), True
                        continue
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)

        return after

    def parsed(self, records: Iterable[str]) -> Iterator[list[str | None]]:
        """The fields of every record; an empty field without quotes is None."""
        csv.field_size_limit(2**31 - 1)
        doubled = self.escape == self.quote
        return csv.reader(
            records, delimiter=self.sep, quotechar=self.quote, doublequote=True, escapechar=None if doubled else self.escape,
            skipinitialspace=self.skip_space, quoting=getattr(csv, "QUOTE_NOTNULL", csv.QUOTE_MINIMAL),
        )


def _lines(spark: SparkSession, path: str | list[str], dialect: Dialect) -> DataFrame:
    text = spark.read.text(path, lineSep=dialect.line_end)
    value = F.col("value") if dialect.encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), dialect.encoding)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), value.alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of every split; a task reads one split after the other."""
    def each() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            files, starts = batch["file"].dictionary_encode(), batch["start"].to_numpy()
            number = files.indices.to_numpy()
            changed = np.flatnonzero((number[1:] != number[:-1]) | (starts[1:] != starts[:-1])) + 1
            lines = batch["line"].to_pylist()
            for a, b in zip([0, *changed.tolist()], [*changed.tolist(), len(lines)], strict=True):
                if a < b:
                    key = (files.dictionary[int(number[a])].as_py(), int(starts[a]))
                    yield from zip(repeat(key), lines[a:b])

    rows = each()
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def own() -> Iterator[str]:
            nonlocal held
            while held is not None and held[0] == key:
                yield held[1]
                held = next(rows, None)

        lines = own()
        yield key, lines
        for _ in lines:
            pass


def splits_inside(lines: DataFrame, dialect: Dialect) -> set[tuple[str, int]]:
    """The splits that start inside quotes; an open quote at the end of a file raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = dialect.state_after()
        for (file, start), own in _by_split(batches):
            ends = [False, True]
            for line in own:
                if dialect.quote in line:
                    ends = [after(line, s) for s in ends]
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "outside": ends[0], "inside": ends[1]}])

    def along(group: pd.DataFrame) -> pd.DataFrame:
        state, rows = False, []
        for r in group.sort_values("start").itertuples():
            rows.append((r.file, r.start, state, False))
            state = bool(r.inside if state else r.outside)
        rows.append((group["file"].iloc[0], -1, state, state))
        return pd.DataFrame(rows, columns=["file", "start", "state", "open"])

    found = (
        lines.mapInArrow(run, "file string, start bigint, outside boolean, inside boolean")
        .groupBy("file").applyInPandas(along, "file string, start bigint, state boolean, open boolean").where("state").collect()
    )
    unclosed = sorted(r["file"] for r in found if r["open"])
    if unclosed:
        raise ValueError(f"a quoted text is open at the end of {', '.join(unclosed)}")
    return {(r["file"], r["start"]) for r in found}


def read_records(spark: SparkSession, path: str | list[str], dialect: Dialect) -> DataFrame:
    """``file, header, fields`` of every record; ``header`` marks the first of each file."""
    lines = _lines(spark, path, dialect)
    inside = splits_inside(lines, dialect)

    def pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        after, schema = dialect.state_after(), pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("header", pa.bool_()), ("fields", pa.list_(pa.string()))]
        )

        def batch_of(key: tuple[str, int], kind: int, fields: list[list], first: bool) -> pa.RecordBatch:
            n = len(fields)
            header = np.zeros(n, dtype=bool)
            header[:1] = first
            values = [pa.repeat(v, n) for v in (pa.scalar(key[0]), pa.scalar(key[1], pa.int64()), pa.scalar(kind, pa.int32()))]
            return pa.RecordBatch.from_arrays([*values, pa.array(header), pa.array(fields, pa.list_(pa.string()))], schema=schema)

        for key, own in _by_split(batches):
            if key in inside:
                state, end = True, []
                for line in own:
                    end.append(line)
                    state = after(line, state)
                    if not state:
                        break
                if not whole:
                    yield batch_of(key, END_OF_ONE, [["\n".join(end)]], False)
            records: list[str] = []
            open_: list[str] = []
            first = key[1] == 0
            for line in own:
                if not open_ and (not line.strip("\r") or (dialect.comment and line.startswith(dialect.comment))):
                    continue
                open_.append(line)
                if after(line, len(open_) > 1):
                    continue
                if whole:
                    records.append("\n".join(open_).removesuffix("\r"))
                open_ = []
                if len(records) == 2000:
                    yield batch_of(key, RECORD, list(dialect.parsed(records)), first)
                    records, first = [], False
            if records:
                yield batch_of(key, RECORD, list(dialect.parsed(records)), first)
            if open_ and not whole:
                yield batch_of(key, START_OF_ONE, [["\n".join(open_)]], first and not records)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        rows, open_ = [], []
        for r in group.sort_values(["start", "kind"]).itertuples():
            if r.kind == START_OF_ONE and open_:
                rows.append("\n".join(open_))
                open_ = []
            open_.append(r.fields[0])
        rows.append("\n".join(open_))
        fields = list(dialect.parsed([r.removesuffix("\r") for r in rows]))
        return pd.DataFrame({"file": group["file"].iloc[0], "start": 0, "kind": RECORD, "header": False, "fields": fields})

    found = lines.mapInArrow(lambda batches: pieces(batches, True), _SCHEMA)
    if inside:
        parts = lines.mapInArrow(lambda batches: pieces(batches, False), _SCHEMA)
        found = found.unionAll(parts.groupBy("file").applyInPandas(joined, _SCHEMA))
    return found.select("file", "header", "fields")
