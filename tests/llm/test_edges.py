"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import (
    classifier, encoding, fingerprints, language_model, mixing, near_duplicates, passages, privacy, quality, substrings,
)

# Names that operators use for columns of their own.
CLASHING = (
    "row", "place", "size", "copies", "source_key", "lang_key", "kept", "failed", "part", "at", "guest", "spans", "near",
    "text_id", "id", "of", "rows", "content", "node", "root", "rep", "symbols", "rank", "places", "tokens", "held_out", "x", "m",
    "n_words", "clean", "kind", "word", "c", "f",
)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
WORDS = "the quick brown fox jumps over the lazy dog and runs far away from here again "


def messy(spark):
    texts = [
        None, "", "  \n\t ", "one", "a b", WORDS * 5, WORDS * 5, LONG, LONG, "x" * 5000, "mail bob@x.example now " * 3,
        "\U0001F600 café " * 30, "a b c ́d", "1" * 3000, "#$%& " * 60, WORDS + "12 +1 (555) 123-4567",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (None, WORDS * 3, None, None, None), (None, None, None, None, None), (5, "another text", "en", "s1", 12)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.select("*", *[F.lit(7).alias(c) for c in CLASHING])


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(16)] + [(None, 1), (3, None)], "doc_id bigint, quality int")


def learned(documents, spark):
    found = classifier.features(documents)
    return classifier.scored(found, classifier.train(found, labels(spark), F.lit(True)))


OPERATORS = {
    "near": lambda d, s: near_duplicates.near_duplicates(d),
    "one_of_each": lambda d, s: near_duplicates.one_of_each(d),
    "simhash": lambda d, s: fingerprints.compared_with_next(d),
    "personal": lambda d, s: privacy.personal_data(d),
    "sanitise": lambda d, s: privacy.sanitise(d),
    "quality": lambda d, s: quality.judge(quality.measured(d)),
    "quality_filter": lambda d, s: quality.quality_filter(d),
    "mixture": lambda d, s: mixing.mixture(mixing.sizes(d)),
    "mix": lambda d, s: mixing.mix(d),
    "substrings": lambda d, s: substrings.without_repeated_bytes(d),
    "passages": lambda d, s: passages.without_repeated_passages(d),
    "model": lambda d, s: language_model.LanguageModel(d, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0).scores(),
    "classifier": learned,
    "encoding": lambda d, s: encoding.encode(d),
}
WHOLE = {"near", "simhash", "personal", "quality", "mixture", "substrings", "passages", "model", "classifier", "encoding"}
FILTERS = {"one_of_each", "sanitise", "quality_filter", "mix"}


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy"))
    messy(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows(spark, documents, name):
    result = OPERATORS[name](documents, spark)
    rows = result.collect()
    if name in WHOLE:
        assert len(rows) == documents.count()
    if name in FILTERS:
        assert result.columns == documents.columns
        assert all(r["kind"] == 7 for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, documents, name):
    assert OPERATORS[name](documents.limit(0), spark).collect() == []


def test_copies_share_a_class_and_one_stays(spark, documents):
    found = near_duplicates.near_duplicates(documents).select("doc_id", "class_id").collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add(r.class_id)
    assert by_id[6] == {5} and by_id[8] == {7} and by_id[1] == by_id[2] == {0}
    left = near_duplicates.one_of_each(documents).collect()
    assert sum(r.text == WORDS * 5 for r in left) == 1
    assert sum(r.text == LONG for r in left) == 1


def test_no_signature_keeps_a_pair_from_comparison(spark):
    """Two nodes that share a band and else agree in nothing are compared, whatever was kept of their registers."""
    corpus = object.__new__(near_duplicates._Corpus)
    corpus.members = spark.createDataFrame(
        [(7, 0, k, 100, 1, 100, 9) for k in (1, 2, 3)],
        "bucket bigint, band int, node bigint, n bigint, centre bigint, n_centre bigint, rank bigint",
    )
    corpus.found = spark.createDataFrame([(1, 1), (4, 1)], "node bigint, root bigint")
    corpus.tried = spark.createDataFrame([(2, 1, 0.7), (3, 1, 0.7)], "u bigint, v bigint, similarity double")
    corpus.nodes = spark.createDataFrame(
        [(k, [5] + [100 * k + i for i in range(24)], [0x1111111111111111 * k] * 8) for k in (1, 2, 3)],
        "node bigint, keys array<bigint>, sketch array<bigint>",
    )
    assert (3, 2) in {tuple(r) for r in corpus._across().collect()}


def test_equal_texts_have_equal_fingerprints(spark, documents):
    prints = {}
    joined = fingerprints.compared_with_next(documents).collect()
    for r in joined:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert prints[(5, len(WORDS * 5))] == prints[(6, len(WORDS * 5))]


def test_sanitise_counts_characters_anew(spark, documents):
    rows = {r.doc_id: r for r in privacy.sanitise(documents).where("doc_id IN (10, 15)").collect()}
    assert "bob@x.example" not in rows[10].text and "[EMAIL]" in rows[10].text
    assert "[PHONE]" in rows[15].text and rows[15].n_chars == len(rows[15].text)


def test_pipeline_keeps_columns(spark, documents):
    plain = documents.select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == plain.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), "").collect() == []
