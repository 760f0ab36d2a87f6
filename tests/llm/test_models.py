"""What the learned models and the adaptive rules are worth on documents they have not seen."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import catalogue, language_model, mixing, quality
from plumbline.llm.classifier import AdditiveModel

SF_DIR = "/root/testdata/sf0.01"


def test_language_model_beats_counts(spark):
    rows = catalogue.QUERIES["op8_language_model"](spark, SF_DIR).where("held_out")
    total = rows.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert total.score > total.base


def test_every_training_document_is_learned_once(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(
        language_model.LanguageModel, "_learn",
        lambda self, part, turn: learned.extend(r.doc_id for r in part.select("doc_id").collect()),
    )
    rows = [(i, f"word{i % 7} and word{i % 5}") for i in range(200)] + [(None, "a row without id")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    language_model.LanguageModel(documents, F.coalesce(F.col("doc_id"), F.lit(1)) % 10 == 0)
    assert sorted(learned, key=str) == sorted((k for k, _ in rows if k is None or k % 10), key=str)


def test_probabilities_add_up():
    rng = np.random.default_rng(3)
    hashes, counts = rng.integers(-(2**62), 2**62, 6000), np.sort(rng.zipf(1.3, 6000).clip(1, 10**5))[::-1].copy()
    voc = language_model.Vocabulary.of(hashes[:5000], counts[:5000], int(counts.sum()), 6000)
    net = language_model.Network(voc)
    for name in ("wc", "ww"):
        setattr(net, name, rng.normal(0, 0.5, getattr(net, name).shape).astype(np.float32))
    state = np.repeat(rng.normal(0, 1, (1, language_model.HIDDEN)).astype(np.float32), 5000, axis=0)
    place, group = net.v.encode(hashes[:5000])
    at, _ = voc.look_up(hashes[:5000])
    known = np.exp(net.log_probability(state, place, group)[0]) * 10 ** voc.within[at]
    rest, last = net.log_probability(state[:1], *[a for a in net.v.encode(np.array([1]))])[0], counts[5000:]
    tail = np.exp(rest[0]) * ((last + 0.1).sum() + 0.1) / voc.tail_total
    assert abs(known.sum() + tail - 1) < 1e-3


def test_slopes_of_the_network():
    """Backpropagation through a window against differences."""
    rng = np.random.default_rng(5)
    hashes, counts = np.arange(50) * 7919, np.arange(100, 50, -1)
    voc = language_model.Vocabulary.of(hashes, counts, int(counts.sum()), 50)
    inputs, at = rng.integers(0, 50, (4, 3)), rng.integers(0, 50, (4, 3))
    place, group = (a.reshape(4, 3) for a in voc.encode(hashes[at.reshape(-1)]))

    def loss(net):
        state, total = np.zeros((3, language_model.HIDDEN), dtype=np.float32), 0.0
        for t in range(4):
            state, _ = net.step(inputs[t], state)
            total += net.log_probability(state, place[t], group[t])[0].sum()
        return float(total)

    net = language_model.Network(voc)
    net.wc = rng.normal(0, 0.3, net.wc.shape).astype(np.float32)
    net.ww = rng.normal(0, 0.3, net.ww.shape).astype(np.float32)
    before = net.flat().astype(np.float64)
    start = loss(net)
    net.learn(inputs, place, group, np.ones((4, 3), dtype=bool), np.zeros((3, language_model.HIDDEN), dtype=np.float32), 1e-3)
    step = net.flat() - before
    squares = np.concatenate([net.squares[n].reshape(-1) for n in net.NAMES])
    slope = step * np.sqrt(squares) / 1e-3
    assert abs((loss(net) - start) - float(slope @ step)) < 0.1 * abs(float(slope @ step))


def test_classifier_on_held_out_rows(spark):
    scored = catalogue.QUERIES["op9_quality_classifier"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_quality_rules_keep_clean_documents(spark):
    kept = catalogue.QUERIES["op4_quality_rules"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = kept.join(labels, "doc_id").where("n_words >= 50").collect()
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_sketches_merge(spark):
    """The sketch of a language is the sum of its sources' sketches, and quantiles keep their relative error."""
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = quality.measured(documents)
    fences = {r.lang_key: r for r in quality.fences(quality.sketch(rows), ["lang_key"]).collect()}
    lengths = [r.word_length for r in rows.where("lang_key = 'sen'").select("word_length").collect()]
    q1, q3 = np.quantile(lengths, 0.25, method="inverted_cdf"), np.quantile(lengths, 0.75, method="inverted_cdf")
    spread = 3 * max(q3 - q1, 0.5)
    assert abs(fences["sen"].word_length_high - (q3 + spread)) < 0.01 * q3 * 8


def test_mixture_meets_its_targets(spark):
    rows = catalogue.QUERIES["op5_mixing"](spark, SF_DIR)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source")
    per_source = rows.join(documents, "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")
    )
    for r in per_source.collect():
        assert abs(r.taken - r.target) <= r.largest


def test_smaller_budgets_are_nested(spark):
    sized = mixing.sizes(spark.read.parquet(f"{SF_DIR}/documents.parquet")).cache()
    few = {r.doc_id: r.copies for r in mixing.mixture(sized, share=0.5).collect()}
    many = {r.doc_id: r.copies for r in mixing.mixture(sized, share=0.9).collect()}
    assert all(n <= many[k] for k, n in few.items())
