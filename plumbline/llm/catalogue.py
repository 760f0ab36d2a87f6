"""Registered queries of the text operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    alignment, classifier, encoding, fingerprints, impacts, interactions, language_model, mixing, near_duplicates, passages,
    privacy, quality, substrings,
)
from plumbline.llm.common import materialise

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, named by its smallest id."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, compared with each other and the next document."""
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts by kind, and spans with those of secrets and disclosing terms."""
    found = privacy.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [privacy.count_of("base", kind).alias(f"n_{kind}") for kind in privacy.KINDS[:4]]
    base, spans = privacy.written(F.col("base")), privacy.written(F.col("spans"))
    more = [privacy.count_of("spans", kind).alias(f"n_{kind}") for kind in privacy.KINDS[4:]]
    return found.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), *more,
        F.size("spans").cast("bigint").alias("n_spans"),
    )


_SPACE = r"[\x20\x09-\x0D]+"

_FENCED = "\n".join(
    f""", max(CASE WHEN measure = '{name}' THEN {f"q1 - 3 * greatest(q3 - q1, {least}::DOUBLE)" if both else '0'} END) AS {name}_low
  , max(CASE WHEN measure = '{name}' THEN q3 + 3 * greatest(q3 - q1, {least}::DOUBLE) END) AS {name}_high"""
    for name, both, least in quality.MEASURES
)


def _fences_sql(keys: str) -> str:
    return f"""
  SELECT {keys} {_FENCED} FROM (
    SELECT {keys}, measure,
      CASE WHEN b1 > -100000 THEN 2 / 2.02::DOUBLE * pow(1.02::DOUBLE, b1) ELSE 0 END AS q1,
      CASE WHEN b3 > -100000 THEN 2 / 2.02::DOUBLE * pow(1.02::DOUBLE, b3) ELSE 0 END AS q3
    FROM (
      SELECT {keys}, measure, min(CASE WHEN upto >= 0.25 * total THEN bucket END) AS b1,
        min(CASE WHEN upto >= 0.75 * total THEN bucket END) AS b3
      FROM (
        SELECT {keys}, measure, bucket, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY bucket) AS upto,
          sum(n) OVER (PARTITION BY {keys}, measure) AS total
        FROM (SELECT {keys}, measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)
      ) WHERE total >= 30 GROUP BY ALL
    )
  ) GROUP BY ALL"""


_BUCKETS = "\nUNION ALL ".join(
    f"""SELECT lang_key, source_key, '{name}' AS measure,
    CASE WHEN {name} > 0 THEN ceil(ln({name}) / ln(1.02::DOUBLE))::INT ELSE -100000 END AS bucket
  FROM shares WHERE NOT base_failed"""
    for name, _, _ in quality.MEASURES
)
_OUTSIDE = " OR ".join(
    f"coalesce({name} < coalesce(o.{name}_low, w.{name}_low) OR {name} > coalesce(o.{name}_high, w.{name}_high), false)"
    for name, _, _ in quality.MEASURES
)

_QUALITY_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t,
    coalesce('s' || lang, 'z') AS lang_key, coalesce('s' || source, 'z') AS source_key
  FROM documents
), ws AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM ws)
), twice AS (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM windows),
covered AS (
  SELECT id, count(DISTINCT spot) AS n_repeat_words
  FROM (SELECT id, unnest([i, i + 1, i + 2]) AS spot FROM twice WHERE n > 1) GROUP BY id
), counts AS (
  SELECT doc_id, lang_key, source_key, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '\\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM ws LEFT JOIN covered USING (id)
), shares AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length,
    coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share,
    coalesce(n_capitals / nullif(word_chars, 0), 0) AS capital_share,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS repeated_lines,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeated_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counts
), sketch AS (SELECT lang_key, source_key, measure, bucket, count(*) AS n FROM ({_BUCKETS}) GROUP BY ALL),
own AS ({_fences_sql("lang_key, source_key")}),
wide AS ({_fences_sql("lang_key")})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_OUTSIDE}) AS kept
FROM shares LEFT JOIN own o USING (lang_key, source_key) LEFT JOIN wide w USING (lang_key)"""


@query(_QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of adaptive fences."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = quality.measured(documents)
    slim = materialise(rows.select("row.doc_id", *[c for c in rows.columns if c != "row"]), "measured")
    return quality.judge(slim).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS source_key,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source_key, sum(size)::DOUBLE AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source_key)) - 1) % 3 + 1] AS weight,
    1.5::DOUBLE * (sum(sum(size)) OVER ())::DOUBLE AS budget
  FROM sized GROUP BY source_key
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), goals AS (
  SELECT source_key, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS rounds FROM goals
), hashes AS (
  SELECT source_key, place, sum(size) AS here,
    sum(sum(size)) OVER (PARTITION BY source_key ORDER BY place) AS upto
  FROM sized GROUP BY source_key, place
), cut AS (
  SELECT source_key, place + CASE WHEN upto - rest < rest - (upto - here) THEN 1 ELSE 0 END AS below
  FROM hashes JOIN (SELECT *, target - rounds * source_size AS rest FROM planned) USING (source_key)
  WHERE upto - here <= rest AND rest < upto
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (rounds + CASE WHEN place < coalesce(below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN planned USING (source_key) LEFT JOIN cut USING (source_key)"""


@query(_MIXING_SQL)
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mixture of all sources takes."""
    sized = materialise(mixing.sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mixture(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def _removed(result: DataFrame, n: str) -> list:
    length = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return ["doc_id", n, length.alias("n_removed")]


@query()
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when byte strings that occur earlier are removed."""
    result = substrings.without_repeated_bytes(table(spark, sf_dir, "documents"))
    return result.select(
        *_removed(result, "n_bytes"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when repeated passages are removed."""
    result = passages.without_repeated_passages(table(spark, sf_dir, "documents"))
    return result.select(*_removed(result, "n_words"), F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under word counts and under the recurrent model."""
    held_out = classifier.remainder(F.col("doc_id"), 10) == 0
    return language_model.LanguageModel(table(spark, sf_dir, "documents"), held_out).scores()


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled documents that are not held out."""
    featured = materialise(
        classifier.features(table(spark, sf_dir, "documents")).withColumn(
            "held_out", classifier.remainder(F.col("doc_id"), 4) == 2
        ), "features",
    )
    model = classifier.train(featured, table(spark, sf_dir, "labels"), ~F.col("held_out"))
    result = classifier.scored(featured, model)
    return result.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= classifier.CUT, 1).otherwise(0).alias("predicted")
    )


@query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    encoded = encoding.encode(table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)]::INT[] AS f
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)
), cell AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, substr('ABCDE', a.i, 1) || substr('ABCDE', b.i, 1) || substr('ABCDE', c.i, 1)
    || substr('ABCDE', d.i, 1) || substr('ABCDE', e.i, 1) AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
found AS (
  SELECT *, f[o[step]] AS fails, coalesce(list_sum(list_transform(o[1:step - 1], lambda x: f[x])), 0) AS before,
    list_sum(f) AS all_fails
  FROM cell, steps
), counted AS (
  SELECT part, filter_order, step, o[step] AS own,
    sum(CASE WHEN before = 0 AND fails = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN before = 0 AND fails = 1 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN before > 0 AND fails = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN all_fails = 1 AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN before = 0 AND fails = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN before = 0 AND fails = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM found GROUP BY part, filter_order, step, o[step]
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted"""


@query(_AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return interactions.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10"""


@query(_NEAREST_SQL)
def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    return impacts.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies align in every document, and how common their links are."""
    found = alignment.aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )
