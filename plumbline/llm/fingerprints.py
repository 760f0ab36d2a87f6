"""SimHash fingerprints of documents, and the search for fingerprints that differ in few bits.

The terms of a text are its words and its pairs of neighbouring words. Each occurrence votes with the
weight of its term, one plus the binary logarithm of its length in characters, on the 64 bits of the
term's hash: for a bit that is set, against one that is not. A fingerprint has the bits with a
positive sum. The votes are counted two bits to a number: 32 sums of a plain aggregation, for which
each word is one row and which stays inside the partition that holds the document.

Fingerprints within ``radius`` bits are found with permuted block tables: the 64 bits are cut into
``radius + 3`` blocks, and of two fingerprints that differ in at most ``radius`` bits at least three
whole blocks agree. So there is one table for each choice of three blocks, keyed by their bits.

Defined cases: a missing text is an empty one; without words all bits are 0. Documents are ordered by
``doc_id`` (nulls first), rows of the same id by text; equal rows are interchangeable. A table with one
document has that document as its own next one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import let, materialise, text_of, words

BITS = 64
_LANES = (1 << 32) + 1


def with_next(documents: DataFrame) -> DataFrame:
    """``part, doc_id, text, next_text, guest``: each document with the text that follows it.

    The ids are cut into two ranges for each shuffle partition, and each range is ordered by itself. The first
    document of a range also goes, as a guest, to the end of the range before; the very first one to
    the end of the last.
    """
    known = documents.select("doc_id", text_of(documents).alias("text"))
    parts = 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    splits = sorted(set(known.approxQuantile("doc_id", shares, 0.2 / parts)))
    bounds = F.array(*[F.lit(int(s)) for s in splits]) if splits else F.array(F.lit(0))
    # The place of an id among the split points, by halving.
    part = F.coalesce(_place(F.col("doc_id"), bounds, max(1, len(splits))), F.lit(0))
    placed = known.withColumn("part", part)
    lowest = F.lit(-(1 << 63))
    # One row per range.
    order = Window.orderBy("part")
    everything = Window.partitionBy()
    firsts = placed.groupBy("part").agg(F.min(F.coalesce("doc_id", lowest)).alias("first_id"))
    firsts = firsts.select(
        "part", "first_id", F.coalesce(F.lag("part").over(order), F.max("part").over(everything)).alias("goes_to"),
        F.lag("part").over(order).isNull().alias("wraps"),
    )
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("last"), F.lit(False).alias("guest"))
    away = F.struct(F.col("goes_to").alias("part"), F.col("wraps").cast("int").alias("last"), F.lit(True).alias("guest"))
    is_first = F.coalesce("doc_id", lowest) == F.col("first_id")
    # One row per range, and there is one range for each split point.
    sent = placed.join(F.broadcast(firsts), "part").select(
        "doc_id", "text", F.explode(F.when(is_first, F.array(own, away)).otherwise(F.array(own))).alias("to")
    ).select("doc_id", "text", "to.part", "to.last", "to.guest")
    inside = Window.partitionBy("part").orderBy("last", F.col("doc_id").asc_nulls_first(), "guest", "text")
    return sent.select(
        "part", "doc_id", "text", "guest",
        F.row_number().over(inside).alias("at"), F.lead("text").over(inside).alias("next_text"),
    )


def _place(value: Column, bounds: Column, n: int) -> Column:
    """Number of sorted ``bounds`` that are at most ``value``."""
    def further(found: Column, step: int) -> Column:
        return let(found, lambda f: F.when(
            (f + step <= n) & (value >= F.get(bounds, f + (step - 1))), f + step
        ).otherwise(f))

    found = F.lit(0)
    for k in reversed(range(n.bit_length())):
        found = further(found, 1 << k)
    return found


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _weight(term: Column) -> Column:
    return F.length(F.bin(F.length(term))).cast("bigint")


def fingerprint_sums(terms: DataFrame, keys: list[str], word: str, previous: str) -> DataFrame:
    """``keys`` and ``fingerprint`` (64 bits as a number) from one row per word with the word before it."""
    hashed = terms.select(
        *keys,
        F.xxhash64(word).alias("one"),
        F.when(F.col(word).isNotNull(), _weight(F.col(word))).otherwise(0).alias("w1"),
        F.xxhash64(previous, word).alias("two"),
        F.when(F.col(previous).isNotNull(), _weight(F.col(previous)) + _weight(F.col(word))).otherwise(0).alias("w2"),
    )

    def votes(bit: int) -> Column:
        # Bits ``bit`` and ``bit + 32`` share a number; both sums stay below 2^32 for texts of up to 10^8 words.
        def of(key: str, weight: str) -> Column:
            return F.shiftrightunsigned(key, bit).bitwiseAND(F.lit(_LANES)) * F.col(weight)

        return F.sum(of("one", "w1") + of("two", "w2")).alias(f"v{bit}")

    counted = hashed.groupBy(*keys).agg(F.sum(F.col("w1") + F.col("w2")).alias("all"), *[votes(b) for b in range(32)])
    bits = []
    for bit in range(32):
        low, high = F.col(f"v{bit}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{bit}", 32)
        for place, sum_ in ((bit, low), (bit + 32, high)):
            bits.append(F.when(sum_ * 2 > F.col("all"), F.shiftleft(F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint")))
    value = bits[0]
    for bit in bits[1:]:
        value = value.bitwiseOR(bit)
    return counted.select(*keys, value.alias("fingerprint"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` of each row; ``keys`` identify the rows."""
    spread = texts.select(*keys, let(words(F.col(text)), lambda ws: F.arrays_zip(
        ws, F.slice(F.concat(F.array(F.lit(None).cast("string")), ws), 1, F.size(ws))
    )).alias("pairs"))
    terms = spread.select(*keys, F.explode_outer("pairs").alias("pair")).select(*keys, "pair.*")
    return fingerprint_sums(terms.toDF(*keys, "word", "previous"), keys, "word", "previous")


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def compared_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likenesses.

    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next``. All texts are
    shuffled once, to their range of ids; counting votes and finding the next document happen there.
    """
    keys = ["part", "at", "doc_id", "guest", "n_chars", "edited_sha256"]
    pairs = with_next(documents).withColumn(
        "edited", edited_text(F.col("text"), F.coalesce("next_text", F.lit("")))
    )
    both = pairs.select(
        "part", "at", "doc_id", "guest", F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")),
        )).alias("version"),
    ).select(*keys, "version.kind", "version.text")
    marked = fingerprints(both, [*keys, "kind"])
    rows = marked.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited"),
    )
    following = F.lead("own").over(Window.partitionBy("part").orderBy("at"))
    return rows.withColumn("next", following).where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def near_fingerprints(found: DataFrame, radius: int = 3, fingerprint: str = "fingerprint") -> DataFrame:
    """``a, b, distance``: all pairs ``a < b`` of different fingerprints within ``radius`` bits.

    Equal fingerprints count once, so copies give no pairs.
    """
    blocks = radius + 3
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    distinct = materialise(found.select(F.col(fingerprint).alias("f")).where("f IS NOT NULL").distinct(), "fingerprints")
    masks = [sum(1 << bit for i in chosen for bit in range(edges[i], edges[i + 1])) for chosen in combinations(range(blocks), 3)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    keyed = distinct.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("block", "bits"))
    a, b = keyed.select(F.col("f").alias("a"), "block", "bits"), keyed.select(F.col("f").alias("b"), "block", "bits")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = a.join(b, ["block", "bits"]).where((F.col("a") < F.col("b")) & (distance <= radius))
    return pairs.select("a", "b", distance.alias("distance")).distinct()
