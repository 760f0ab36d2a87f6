"""Headed CSV files: delimiter detection, missing tokens and column types."""

from __future__ import annotations

import codecs
import re
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import col
from plumbline.functions.parsing import MISSING_TOKENS, looks_numeric, looks_whole
from plumbline.operators.batches import first_row
from plumbline.sources.records import Dialect, read_records
from plumbline.sources.staging import stage

DELIMITERS = (",", ";", "\t", "|")
CORRUPT = "__corrupt_line"

# Reader options by the names a rule file uses (fixed values).
READER_OPTIONS = {
    "sep": "sep",
    "delimiter": "sep",
    "encoding": "encoding",
    "quotechar": "quote",
    "escapechar": "escape",
    "comment": "comment",
    "lineterminator": "lineSep",
    "skipinitialspace": "ignoreLeadingWhiteSpace",
    "multiline": "multiLine",
}
# Options handled after reading.
OWN_OPTIONS = ("on_bad_lines", "usecols", "nrows", "na_values", "keep_default_na", "dtype", "names", "header", "engine")

_NUMPY_TYPES = {
    "int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double",
    "float32": "float", "str": "string", "object": "string", "string": "string", "bool": "boolean",
}


def _best(candidates: dict[str, tuple[int, int, int]]) -> str:
    """The candidate that occurs in every line, equally often if possible, and most often.

    By candidate: how often the first line has it, lines with as many, and all lines.
    """
    best, best_rank = ",", (0, 0, 0)
    for candidate, (first, agreeing, lines) in candidates.items():
        rank = (int(agreeing == lines), agreeing, first)
        if first and rank > best_rank:
            best, best_rank = candidate, rank
    return best


def detect_delimiter(lines: list[str]) -> str:
    unquoted = [re.sub(r'"[^"]*"', "", line) for line in lines if line.strip()]
    if not unquoted:
        return ","
    found = {}
    for candidate in DELIMITERS:
        counts = [line.count(candidate) for line in unquoted]
        found[candidate] = (counts[0], sum(c == counts[0] for c in counts), len(counts))
    return _best(found)


class Lines(NamedTuple):
    """What all lines of a source say about its format."""

    delimiter: str
    open_quotes: int


def inspect_lines(
    spark: SparkSession, path: str | list[str], quote: str = '"', escape: str = '"', comment: str | None = None
) -> Lines:
    """Delimiter and number of lines that end inside quotes, in one aggregate over all lines.

    Quotes count where a field can start: at the start of a line and behind a candidate for the delimiter. Lines are
    looked at one by one, so behind an open quote the rest of the quoted text may count as well.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comment:
        lines = lines.where(~F.startswith("value", F.lit(comment)))
    text = F.col("value") if escape == quote else F.replace(F.col("value"), F.lit(escape + quote), F.lit(""))
    q, start = re.escape(quote), f"(^|[{re.escape(''.join(DELIMITERS))}])"
    bare = F.regexp_replace(text, f"{start}{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}", "$1")
    counted = lines.select(
        F.regexp_like(bare, F.lit(f"{start}{q}")).cast("int").alias("open"),
        *[F.regexp_count(bare, F.lit(re.escape(d))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)],
    )
    first = counted.first()
    if first is None:
        return Lines(",", 0)
    found = counted.agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("open").alias("open"),
        *[F.count_if(F.col(f"d{i}") == first[f"d{i}"]).alias(f"d{i}") for i in range(len(DELIMITERS))],
    ).first()
    ranked = {d: (first[f"d{i}"], found[f"d{i}"], found["lines"]) for i, d in enumerate(DELIMITERS)}
    return Lines(_best(ranked), found["open"])


def sniff_delimiter(spark: SparkSession, path: str | list[str]) -> str:
    """The delimiter that all lines speak for."""
    return inspect_lines(spark, path).delimiter


def blank_out(df: DataFrame, tokens: list[str]) -> DataFrame:
    """Text that stands for a missing value becomes NULL."""
    text = {
        f.name: col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != CORRUPT
    }
    return df.withColumns({c: F.when(~v.isin(tokens), v) for c, v in text.items()}) if text else df


def typed(df: DataFrame, wanted: dict[str, str] | None = None, refused: Column | None = None) -> DataFrame:
    """Casts text columns whose every known value is a whole number, a number or a boolean.

    Whole numbers become bigint, those that do not fit decimal(38,0).

    One fused pass over the columns that have no type in ``wanted``; a column that is only NULL
    stays text. Rows for which ``refused`` holds are counted in the same pass and raise an error.
    """
    wanted = wanted or {}
    open_columns = [c for c in df.columns if c not in wanted and c != CORRUPT]
    evidence: list[Column] = []
    for i, c in enumerate(open_columns):
        evidence += [
            F.count(col(c)).alias(f"n_{i}"),
            F.count_if(looks_whole(col(c))).alias(f"whole_{i}"),
            F.count_if(looks_whole(col(c)) & F.trim(col(c)).try_cast("bigint").isNotNull()).alias(f"long_{i}"),
            F.count_if(looks_whole(col(c)) & F.trim(col(c)).try_cast("decimal(38,0)").isNotNull()).alias(f"wide_{i}"),
            F.count_if(looks_numeric(col(c))).alias(f"num_{i}"),
            F.count_if(F.lower(col(c)).isin("true", "false")).alias(f"bool_{i}"),
        ]
    if refused is not None:
        evidence.append(F.count_if(refused).alias("refused"))
    seen = first_row(df, evidence) if evidence else {}
    if seen.get("refused"):
        raise ValueError(
            f"{seen['refused']} lines have more fields than the header; on_bad_lines='skip' leaves them out"
        )
    target = dict(wanted)
    for i, c in enumerate(open_columns):
        n = seen[f"n_{i}"]
        if n and seen[f"whole_{i}"] == n and seen[f"wide_{i}"] < n:
            continue  # whole numbers beyond 38 digits stay text, as no number type holds them
        for kind, dtype in (("long", "bigint"), ("wide", "decimal(38,0)"), ("num", "double"), ("bool", "boolean")):
            if n and seen[f"{kind}_{i}"] == n:
                target[c] = dtype
                break

    def cast(c: str) -> Column:
        dtype = target.get(c, "string")
        return col(c) if dtype == "string" else F.trim(col(c)).cast(dtype).alias(c)

    return df.select(*[cast(c) for c in df.columns if c != CORRUPT])


def _charset(encoding: str) -> str:
    """The reader's name of an encoding that Python knows by several names."""
    name = codecs.lookup(encoding).name.removesuffix("-sig")
    return "ISO-8859-1" if name == "iso8859-1" else name


def _by_line(
    spark: SparkSession, path: str | list[str], given: dict[str, Any], names: list[str] | None, headed: bool
) -> tuple[DataFrame, Column]:
    """Text columns of a source in which every line is a record, and which rows have too many fields."""
    quote = given["quote"]
    names = names or spark.read.options(**given).csv(path, header=headed, inferSchema=False).schema.names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    # All columns are parsed, or extra fields would go unseen.
    raw = spark.read.options(**given, columnNameOfCorruptRecord=CORRUPT, columnPruning="false").schema(schema).csv(
        path, header=headed, mode="PERMISSIVE"
    )
    q, sep = re.escape(quote), re.escape(given["sep"])
    bare = F.regexp_replace(col(CORRUPT), f"(^|{sep}){q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}", "$1")
    return raw, F.coalesce(F.regexp_count(bare, F.lit(sep)) + 1 > len(names), F.lit(False))


def _across_lines(
    spark: SparkSession, path: str | list[str], given: dict[str, Any], names: list[str] | None, headed: bool
) -> tuple[DataFrame, Column]:
    """The same of a source whose quoted fields may hold line breaks."""
    dialect = Dialect(
        sep=given["sep"], quote=given["quote"], escape=given["escape"], comment=given.get("comment"),
        skip_space=str(given.get("ignoreLeadingWhiteSpace", "")).lower() == "true",
        line_end=given.get("lineSep", "\n"), encoding=given.get("encoding", "UTF-8"),
    )
    # Parsed once: the header, the types and the rows are read from there.
    records, _ = stage(read_records(spark, path, dialect))
    if names is None:
        first = records.where("header").orderBy("file").first()
        width = len(first["fields"]) if first else 0
        names = [n or f"_c{i}" for i, n in enumerate(first["fields"])] if headed and first else [f"_c{i}" for i in range(width)]
    rows = records.where("NOT header") if headed else records
    extra = F.size("fields") > len(names)
    raw = rows.select(
        *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)],
        F.when(extra, F.array_join("fields", given["sep"], "")).alias(CORRUPT),
    )
    return raw, F.coalesce(col(CORRUPT).isNotNull(), F.lit(False))


def read_csv(spark: SparkSession, path: str | list[str], **options: Any) -> DataFrame:
    """Reads headed CSV with the option names of :data:`READER_OPTIONS`; others are refused by name.

    ``dtype`` (column to type) saves the typing pass for the columns it names. A line with more fields than the
    header raises an error, which ``on_bad_lines="skip"`` leaves out; shorter lines are filled with NULL. A quote opens a
    quoted field at the start of a field only. Sources with line breaks in quoted fields are noticed (``multiline``
    saves the pass that looks for them) and read in parallel all the same, see :mod:`plumbline.sources.records`. Their
    records are kept as Parquet in the folder of ``spark.checkpoint.dir``, if there is one, for whoever owns it to remove.
    """
    unknown = sorted(set(options) - set(READER_OPTIONS) - set(OWN_OPTIONS))
    if unknown:
        raise ValueError(f"unsupported CSV options: {', '.join(unknown)}")
    given = {READER_OPTIONS[k]: v for k, v in options.items() if k in READER_OPTIONS and v is not None}
    if "encoding" in given:
        given["encoding"] = _charset(given["encoding"])
    # A quote inside a quoted text is written twice.
    quote = given.setdefault("quote", '"')
    given.setdefault("escape", quote)
    across = bool(given.pop("multiLine", False))
    if "sep" not in given or not across:
        lines = inspect_lines(spark, path, quote, given["escape"], given.get("comment"))
        given.setdefault("sep", lines.delimiter)
        across = across or lines.open_quotes > 0
    headed = options.get("header", "infer") is not None and options.get("names") is None
    if options.get("names") is not None and options.get("header") == 0:
        headed = True
    read = _across_lines if across else _by_line
    raw, refused = read(spark, path, given, options.get("names"), headed)
    if options.get("on_bad_lines", "error") == "skip":
        raw, refused = raw.where(~refused), None
    if options.get("usecols") is not None:
        raw = raw.select(*[col(c) for c in (*options["usecols"], CORRUPT)])
    if options.get("nrows") is not None:
        raw = raw.limit(options["nrows"])
    extra = options.get("na_values") or []
    tokens = [extra] if isinstance(extra, str) else [str(t) for t in extra]
    if options.get("keep_default_na", True):
        tokens = [*MISSING_TOKENS, *tokens]
    dtype = options.get("dtype") or {}
    given_types = dict.fromkeys(raw.columns, dtype) if isinstance(dtype, str) else dtype
    wanted = {c: _NUMPY_TYPES.get(t, t) for c, t in given_types.items()}
    return typed(blank_out(raw, tokens) if tokens else raw, wanted, refused)
