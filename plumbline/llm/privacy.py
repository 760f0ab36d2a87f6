"""Finding personal data and secrets, and terms that give them away.

Base spans are the matches of four patterns; keys and tokens (long runs of letters mixed with digits) are
spans of kind ``secret``. Their positions come from the lengths of matches and of the text between them, so
that everything stays in built-in functions.

The terms of a text are the words of what these spans leave. They are judged by what they tell about
protected entities (information-theoretic sanitisation). Entities are the values, what they generalise to
(the mail domain, the first three parts of an address, a card's issuer, a phone number without its last
seven digits), and the kind itself. Over the different texts of the corpus, ``I(e) = log2(N / n(e))`` is
the information of the entity ``e``, and ``PMI(e, t) = log2(n(e, t) N / (n(e) n(t)))`` what a term ``t``
tells about it, where ``n(e, t)`` counts texts with ``t`` and ``e`` anywhere in them. A term that tells at
least ``DISCLOSURE`` of the information becomes a span of kind ``term`` wherever it stands, in texts
without the entity too, if the corpus shows it: the ``n(e, t) PMI(e, t)`` bits of evidence must pay for
naming one pair among all entities and all terms beside them. So a word that stands in one text tells
nothing about the value beside it, at any size of the corpus. An entity of less than ``LEAST_INFORMATION``
bits is known anyway.

Defined cases: a missing text is an empty one, without spans. Copies of a text count once in the
statistics and get equal spans. Spans of different kinds may overlap, those of terms overlap no others.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, let, materialise, small, text_of, whole_row, words

# Kinds in order, and their patterns. Possessive repeats and the condition that a match
# starts where its run of characters starts, or where the last match ended, change no match; they
# keep the time linear and the stack flat on long runs.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+"
MIXED = r"(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})"
IP_PARTS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)){3}$"

DISCLOSURE = 0.8
LEAST_INFORMATION = 1.0
SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def running_sums(values: Column) -> Column:
    """Sums up to each element, in blocks of the square root of their number."""

    def blocked(v: Column, size: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")),
            lambda k: _sum(F.slice(v, k * size + 1, size)),
        )

        def placed(sums: Column) -> Column:
            before = F.transform(sums, lambda _, k: _sum(F.slice(sums, F.lit(1), k)))
            return let(before, lambda b: F.transform(v, lambda _, i: let(
                F.floor(i / size).cast("int"),
                lambda k: F.get(b, k) + _sum(F.slice(v, k * size + 1, i - k * size + 1)),
            )))

        return let(blocks, placed)

    size = lambda v: F.ceil(F.sqrt(F.size(v))).cast("int")
    return let(values, lambda v: F.when(
        F.size(v) > 0, let(size(v), lambda s: blocked(v, s))
    ).otherwise(F.array().cast("array<int>")))


def places(text: Column, pattern: str, rank: int) -> Column:
    """Matches of a pattern as spans, leftmost first and without overlap."""

    def positioned(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        # The end of each match: what lies before it, gap by gap and match by match.
        steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))
        return F.zip_with(found, running_sums(steps), lambda m, end: F.struct(
            (end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), m.alias("value")
        ))

    none = F.array().cast(f"array<{SPAN}>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, positioned(found)
    ).otherwise(none))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check; leading zeros do not count."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        digit = F.substring(padded, 20 - i, 1).cast("int")
        total = total + (digit if i % 2 == 0 else F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2))
    return total % 10 == 0


def spans_of(text: Column) -> Column:
    """All spans of a text that need no corpus, base spans and secrets, by start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")

    def kind(rank: int, hint: Column, pattern: str, valid) -> Column:
        found = F.filter(places(text, pattern, rank), lambda s: valid(s["value"]))
        return F.when(hint, found).otherwise(none)

    def valid_card(value: Column) -> Column:
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), passes_luhn(d)).otherwise(False))

    digit = text.rlike("[0-9]")
    found = [
        kind(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        kind(1, digit, IP, lambda v: v.rlike(IP_PARTS)),
        kind(2, digit, CARD, valid_card),
        kind(3, F.contains(text, F.lit("+")), PHONE, lambda v: F.length(_digits(v)).between(9, 15)),
        kind(4, digit, SECRET, lambda v: v.rlike("^" + MIXED)),
    ]
    return F.sort_array(F.concat(*found))


def base_spans(spans: Column) -> Column:
    """The spans of the four patterns."""
    return F.filter(spans, lambda s: s["rank"] < KINDS.index("secret"))


def term(word: Column) -> Column:
    """A word in lower case without punctuation around it."""
    return F.btrim(F.lower(word), F.lit(".,;:!?\"'()[]{}<>|*#$%&_-+=/\\"))


def terms_of(text: Column) -> Column:
    """The different terms of a text without its spans."""
    different = F.array_distinct(words(text))
    return F.filter(F.array_distinct(F.transform(different, term)), lambda t: F.length(t) > 1)


def replaced(text: Column, spans: Column, first, more) -> Column:
    """The text with ``first(span)`` for each span, or ``more(span, pos)`` for what it adds to those before it."""
    nothing = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def add(done: Column, span: Column) -> Column:
        apart = span["start"] >= done["pos"]
        piece = F.when(apart, F.concat(
            F.substring(text, done["pos"] + 1, span["start"] - done["pos"]), first(span)
        )).otherwise(more(span, done["pos"]))
        return F.struct(F.greatest(done["pos"], span["end"]).alias("pos"), F.concat(done["out"], F.array(piece)).alias("out"))

    return F.aggregate(spans, nothing, add, lambda done: F.array_join(F.concat(
        done["out"], F.array(F.substring(text, done["pos"] + 1, F.length(text)))
    ), ""))


def blanked(text: Column, spans: Column) -> Column:
    """The text with as many spaces as characters for its spans, so that all other places stay."""
    return F.when(F.size(spans) > 0, replaced(
        text, spans, lambda s: F.repeat(F.lit(" "), s["end"] - s["start"]),
        lambda s, pos: F.repeat(F.lit(" "), F.greatest(s["end"] - pos, F.lit(0))),
    )).otherwise(text)


def without_spans(text: Column) -> Column:
    return let(text, lambda t: let(spans_of(t), lambda s: blanked(t, s)))


def text_key(text: Column) -> Column:
    """The 32 bytes of SHA-256, which tell texts apart at any number of them."""
    return F.unhex(F.sha2(text, 256))


def entities(span: Column) -> Column:
    """What a span's value protects: itself, what it generalises to, and its kind; null where there is none."""
    value, rank = F.lower(span["value"]), span["rank"]
    digits = _digits(value)
    wider = (
        F.when(rank == 0, F.substring_index(value, "@", -1))
        .when(rank == 1, F.substring_index(value, ".", 3))
        .when(rank == 2, F.substring(digits, 1, 6))
        .when(rank == 3, F.substring(digits, F.lit(1), F.length(digits) - 7))
    )
    named = lambda mark, of: F.concat(rank.cast("string"), F.lit(mark), of)
    return F.array(named("=", value), named("~", wider), named("*", F.lit("")))


def findings(documents: DataFrame) -> DataFrame:
    """``row`` (all columns), ``text_id`` and ``spans`` of each document, and ``terms`` of those with spans."""
    text = text_of(documents)
    found = documents.select(whole_row(documents).alias("row"), text.alias("text"), let(text, lambda t: let(
        spans_of(t), lambda s: F.struct(s.alias("spans"), F.when(
            F.size(s) > 0, terms_of(blanked(t, s))
        ).otherwise(F.array().cast("array<string>")).alias("terms"))
    )).alias("found"))
    return found.select("row", text_key(F.col("text")).alias("text_id"), "found.spans", "found.terms")


def disclosing(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``term`` of all terms that disclose a protected entity. ``found`` is read once."""
    per_text = materialise(found.where(F.size("spans") > 0).select(
        "text_id", F.array_distinct(F.array_compact(F.flatten(F.transform("spans", entities)))).alias("entities"), "terms"
    ).dropDuplicates(["text_id"]), "protected")
    held = per_text.select("text_id", F.explode("entities").alias("entity"))
    per_entity = materialise(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entities")
    n_entities = per_entity.count()
    if n_entities == 0:
        return per_entity.select(F.col("entity").alias("term"))
    n_terms = per_text.select(F.explode("terms").alias("term")).distinct().count()
    text = text_of(documents)
    copies = materialise(
        documents.select(text_key(text).alias("text_id")).groupBy("text_id").agg(F.count(F.lit(1)).alias("copies")), "copies"
    )
    n_texts = float(copies.count())
    cost = F.log2(F.lit(float(n_entities) * max(n_terms, 1)))
    information = F.log2(F.lit(n_texts) / F.col("n_entity"))
    # A term tells no more than the information, in no more texts than the entity's: others cannot pay the cost.
    able = materialise(
        per_entity.where((information >= LEAST_INFORMATION) & (F.col("n_entity") * information >= cost)), "able"
    )
    held = held.join(small(able.select("entity"), 48 + F.length("entity")), "entity", "left_semi")
    pairs = held.join(per_text.select("text_id", "terms"), "text_id").select("entity", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    candidates = materialise(
        together.join(able, "entity").where(F.col("n_both") * information >= cost), "candidates"
    )
    # Written before, so the optimizer knows the size of the candidates and broadcasts only a small table.
    wanted = materialise(candidates.select("term").distinct(), "terms")
    if wanted.isEmpty():
        return wanted
    # Each of k copies counts 1 / k, which rounding makes whole again: no text has to meet its copies.
    repeated = small(copies.where("copies > 1"), 96)
    spoken = documents.select(text_key(text).alias("text_id"), terms_of(without_spans(text)).alias("terms")).join(
        repeated, "text_id", "left"
    ).select(F.explode("terms").alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    per_term = spoken.join(small(wanted, 48 + F.length("term")), "term", "left_semi").groupBy("term").agg(
        F.round(F.sum("share")).alias("n_term")
    )
    told = F.log2(F.col("n_both") * F.lit(n_texts) / (F.col("n_entity") * F.col("n_term")))
    return candidates.join(per_term, "term").where(
        (told >= F.lit(DISCLOSURE) * information) & (F.col("n_both") * told >= cost)
    ).select("term").distinct()


def term_spans(documents: DataFrame, disclosed: DataFrame) -> DataFrame:
    """``text_id, terms``: the spans of all places of disclosing terms, for each text that holds some."""
    disclosed = materialise(disclosed, "disclosed")
    empty = disclosed.select(F.lit(b"").alias("text_id"), F.array().cast(f"array<{SPAN}>").alias("terms"))
    if disclosed.isEmpty():
        return empty
    text = text_of(documents)
    spoken = documents.select(text_key(text).alias("text_id"), F.explode(terms_of(without_spans(text))).alias("term"))
    held = materialise(
        spoken.join(small(disclosed, 48 + F.length("term")), "term", "left_semi").groupBy("text_id").agg(
            F.collect_set("term").alias("held")
        ), "holders",
    )
    # Only texts that hold a disclosing term are searched for its places.
    both = documents.select(text_key(text).alias("text_id"), text.alias("text")).join(
        small(held, 96 + 48 * F.size("held")), "text_id"
    )
    told = F.filter(
        let(without_spans(F.col("text")), lambda t: places(t, WORD, KINDS.index("term"))),
        lambda w: F.array_contains("held", term(w["value"])),
    )
    return both.select("text_id", F.transform(told, lambda w: w.withField("value", term(w["value"]))).alias("terms")).dropDuplicates(["text_id"])


def all_spans(spans: Column, terms: Column) -> Column:
    return F.sort_array(F.concat(spans, F.coalesce(terms, F.array().cast(f"array<{SPAN}>"))))


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, base, spans``: spans of the four patterns, and all spans, of each document."""
    slim = materialise(findings(documents).select("row.doc_id", "text_id", "spans", "terms"), "findings")
    extra = materialise(term_spans(documents, disclosing(documents, slim)), "term-spans")
    extra = small(extra, 96 + 48 * F.size("terms"))
    return slim.select("doc_id", "text_id", "spans").join(extra, "text_id", "left").select(
        "doc_id", base_spans(F.col("spans")).alias("base"), all_spans(F.col("spans"), F.col("terms")).alias("spans")
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("bigint")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or chain of overlapping spans, replaced by the name of its first kind."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return replaced(text, spans, lambda s: F.get(marks, s["rank"]), lambda s, pos: F.lit(""))


def sanitise(documents: DataFrame) -> DataFrame:
    """``documents`` with all spans masked in ``text`` and ``n_chars``, if there, counted anew."""
    slim = materialise(
        findings(documents).select("text_id", "spans", "terms").where(F.size("spans") > 0), "findings"
    )
    terms = term_spans(documents, disclosing(documents, slim))
    spans = slim.select("text_id", "spans").dropDuplicates(["text_id"])
    none = F.array().cast(f"array<{SPAN}>")
    masks = materialise(
        spans.join(terms, "text_id", "full").select(
            F.col("text_id").alias("of"), all_spans(F.coalesce("spans", none), F.col("terms")).alias("spans")
        ), "masks",
    )
    rows = documents.select(whole_row(documents).alias("row"), text_key(text_of(documents)).alias("of"))
    both = rows.join(small(masks, 96 + 48 * F.size("spans")), "of", "left")
    clean = F.when(F.col("spans").isNotNull(), masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    changed = both.select("row", clean.alias("clean"))
    columns = []
    for c in documents.columns:
        if c == "text":
            columns.append(F.col("clean").alias("text"))
        elif c == "n_chars":
            kind = documents.schema["n_chars"].dataType
            columns.append(F.coalesce(F.length("clean").cast(kind), F.col("row.n_chars")).alias("n_chars"))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return changed.select(*columns)
