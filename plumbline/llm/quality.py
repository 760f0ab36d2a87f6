"""Quality rules with thresholds that adapt to each language and source.

Each document is measured once. Every measure of every (language, source) is summarised by a
mergeable sketch: counts of logarithmic buckets, so that a quantile is known to a fixed relative
error, parts are merged by adding counts, and the sketch of a language is the sum of its sources.
Thresholds are fences around the quartiles of the group, and each document is joined with the fences
of its own group.

A measure fails if it lies more than ``REACH`` spreads outside the quartiles, where the spread is the
distance of the quartiles, or the measure's smallest spread if that is larger. Groups of fewer than
``LEAST_GROUP`` documents use the fences of their language; languages of fewer have none.

Defined cases: a missing text has no words and fails the base rules. Missing languages and sources
form groups of their own. Repeated rows are measured and judged alike. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import let, materialise, null_last, small, text_of, whole_row, words

LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS_OR_CAPITALS = r"[^#*$%&|<>\p{Lu}]+"

GAMMA = 1.02
ZERO_BUCKET = -100_000
REACH = 3.0
LEAST_GROUP = 30
#: Measure, whether low values fail too, and the smallest spread.
MEASURES = (
    ("word_length", True, 0.5),
    ("symbol_share", False, 0.01),
    ("capital_share", False, 0.03),
    ("repeated_lines", False, 0.2),
    ("repeated_words", False, 0.1),
)


def _repeated_words(tokens: Column) -> Column:
    """Number of words inside three-word windows that occur at least twice.

    A window is known by a 64-bit hash of its words; the last two entries are shorter windows, which
    equal no others. Most texts repeat none, which counting different hashes shows without a sort.
    """

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda w, i: (w["key"] == F.get(ordered, i - 1)["key"]) | (w["key"] == F.get(ordered, i + 1)["key"]),
        )
        places = F.flatten(F.transform(twice, lambda w: F.array(w["at"], w["at"] + 1, w["at"] + 2)))
        return F.size(F.array_distinct(places))

    def counted(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), let(placed, covered)).otherwise(F.lit(0))

    keys = F.transform(tokens, lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return let(keys, counted).cast("bigint")


def measures(text: Column) -> Column:
    """Struct of the base counts of a text and of the measures that the fences apply to."""

    def counted(t: Column, ws: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        marks = F.regexp_replace(t, SYMBOLS_OR_CAPITALS, "")
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            let(marks, lambda m: let(F.length(F.regexp_replace(m, r"\p{Lu}+", "")), lambda n: F.struct(
                n.cast("bigint").alias("n_symbols"), (F.length(m) - n).cast("bigint").alias("n_capitals"),
            ))).alias("marks"),
            let(lines, lambda x: F.struct(
                F.size(x).cast("bigint").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            )).alias("lines"),
            _repeated_words(ws).alias("n_repeat_words"),
        )

    return let(text, lambda t: let(words(t), lambda ws: counted(t, ws)))


def measured(documents: DataFrame) -> DataFrame:
    """One row per document: all its columns in ``row``, group keys, counts, shares and ``base_failed``."""
    counts = documents.select(
        whole_row(documents).alias("row"),
        null_last(documents["lang"]).alias("lang_key"),
        null_last(documents["source"]).alias("source_key"),
        measures(text_of(documents)).alias("m"),
    ).select(
        "row", "lang_key", "source_key",
        *[F.col(f"m.{c}").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")],
        F.col("m.marks.n_symbols").alias("n_symbols"), F.col("m.marks.n_capitals").alias("n_capitals"),
        F.col("m.lines.n_lines").alias("n_lines"), F.col("m.lines.n_dup_lines").alias("n_dup_lines"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counts.withColumns({
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "base_failed": (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    })


def sketch(rows: DataFrame) -> DataFrame:
    """``lang_key, source_key, measure, bucket, n``; sketches merge by adding ``n``."""
    def bucket(name: str) -> Column:
        value = F.col(name)
        return F.when(value > 0, F.ceil(F.log(value) / F.lit(math.log(GAMMA))).cast("int")).otherwise(ZERO_BUCKET)

    entries = F.array(*[
        F.struct(F.lit(name).alias("measure"), bucket(name).alias("bucket")) for name, _, _ in MEASURES
    ])
    return (
        rows.select("lang_key", "source_key", F.explode(entries).alias("entry"))
        .groupBy("lang_key", "source_key", "entry.measure", "entry.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group with ``<measure>_low`` and ``<measure>_high``; small groups are left out."""
    merged = sketched.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # At most one row per bucket in a window, whatever the number of documents.
    group = Window.partitionBy(*keys, "measure")
    summed = merged.select(
        *keys, "measure", "bucket",
        F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"),
    ).where(F.col("total") >= LEAST_GROUP)

    def quantile(share: float) -> Column:
        place = F.min(F.when(F.col("upto") >= F.lit(share) * F.col("total"), F.col("bucket")))
        value = F.lit(2 / (1 + GAMMA)) * F.pow(F.lit(GAMMA), place)
        return F.when(place > ZERO_BUCKET, value).otherwise(F.lit(0.0))

    quartiles = summed.groupBy(*keys, "measure").agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    bounds = []
    for name, both, least in MEASURES:
        of = lambda value, name=name: F.max(F.when(F.col("measure") == name, value))
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * REACH
        low = F.col("q1") - spread if both else F.lit(0.0)
        bounds += [of(low).alias(f"{name}_low"), of(F.col("q3") + spread).alias(f"{name}_high")]
    return quartiles.groupBy(*keys).agg(*bounds)


def adaptive_fences(rows: DataFrame) -> DataFrame:
    """The fences of every (language, source): its own, or those of its language."""
    sketched = materialise(sketch(rows), "sketch")
    own, wider = fences(sketched, ["lang_key", "source_key"]), fences(sketched, ["lang_key"])
    names = [f"{name}_{side}" for name, _, _ in MEASURES for side in ("low", "high")]
    wider = wider.select("lang_key", *[F.col(c).alias(f"wide_{c}") for c in names])
    groups = sketched.select("lang_key", "source_key").distinct()
    return (
        groups.join(own, ["lang_key", "source_key"], "left").join(wider, "lang_key", "left")
        .select("lang_key", "source_key", *[F.coalesce(c, f"wide_{c}").alias(c) for c in names])
    )


def judge(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured`, read twice, with ``failed`` (names of measures) and ``kept``."""
    # Written first: one row per language and source, so that rows with whole texts need not be shuffled to it.
    bounds = small(materialise(adaptive_fences(rows.where(~F.col("base_failed"))), "fences"), 256)
    failed = F.array_compact(F.array(*[
        F.when((F.col(name) < F.col(f"{name}_low")) | (F.col(name) > F.col(f"{name}_high")), F.lit(name))
        for name, _, _ in MEASURES
    ]))
    judged = rows.join(bounds, ["lang_key", "source_key"], "left").withColumn("failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(*[
        c for c in bounds.columns if c not in ("lang_key", "source_key")
    ])


def quality_filter(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that pass, with all columns."""
    return judge(materialise(measured(documents), "measured")).where("kept").select("row.*")
