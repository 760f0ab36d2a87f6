"""What tasks ask for and hold at once."""

from __future__ import annotations

import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, encoding, language_model, near_duplicates


def encoder(asked: list[str]) -> encoding.Encoder:
    found = encoding.Encoder(encoding.default_vocabulary())
    ids = found._ids

    def counted(texts):
        asked.extend(texts)
        return ids(texts)

    found._ids = counted
    return found


def test_words_are_asked_for_together_and_without_marks():
    asked: list[str] = []
    found = encoder(asked)
    words = [f"{a}{b}{c}" for a in ("sea", "Sea", "SEA") for b in ("", "ling", "son") for c in ("", ".", ",")]
    found.learn({" ".join(words).encode()})
    assert len(asked) == 1 and sum("sea" in w for w in asked[0].split()) == 3
    assert found.words.new[b"Sealing."] == found.ask([b"Sealing."])[0]


def test_full_caches_keep_what_is_met_again(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_WORDS", 50)
    asked: list[str] = []
    found = encoder(asked)
    rng = random.Random(1)
    for turn in range(30):
        new = [f"w{turn}{rng.random()}" for _ in range(20)]
        text = " ".join(["often", *new]).encode()
        ids = found.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert encoding.encode_texts([text], found) == [np.array(ids, dtype=np.int32).tobytes()]
        assert len(found.words.new) + len(found.words.old) < 200
    assert sum("often" in t.split() for t in asked) == 1


def test_language_model_takes_documents_of_a_batch_in_slices(monkeypatch):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, n).tolist() for n in (0, 5, 700, 1, 40, 90, 0, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([[1], *docs], pa.list_(pa.int64()))], ["tokens"]).slice(1)
    hashes, counts = np.unique(np.concatenate(docs).astype(np.int64), return_counts=True)
    order = np.argsort(-counts, kind="stable")
    net = language_model.Network(language_model.Vocabulary.of(hashes[order], counts[order], int(counts.sum()), len(hashes)))

    def scores():
        return [language_model.score_batch(net, o, h) for _, o, h in language_model._slices(batch)]

    whole = scores()
    monkeypatch.setattr(language_model, "TOKENS_AT_ONCE", 100)
    sliced = scores()
    assert len(whole) == 1 and len(sliced) > 3
    assert np.concatenate(sliced) == pytest.approx(whole[0], rel=1e-5)
    sizes = [len(h) for _, _, h in language_model._slices(batch)]
    assert (sum(sizes), max(sizes)) == (sum(map(len, docs)), 700)


def test_a_worker_keeps_no_words_of_a_task_that_is_over():
    path = encoding.default_vocabulary()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", "some more"])], ["doc_id", "text"])
    rows = [r for b in encoding.encoded_rows(iter([batch, batch]), path) for r in b.to_pylist()]
    assert [(r["doc_id"], r["decoded"]) for r in rows] == [(1, "some</w> words</w>"), (2, "some</w> more</w>")] * 2
    left = encoding._encoders[path]
    assert not any([left.words.new, left.words.old, left.chunks.new, left.chunks.old])


def test_no_batch_is_held_while_the_next_is_read(monkeypatch):
    held, alive = [], []
    monkeypatch.setattr(near_duplicates, "SLICE_SHINGLES", 100)

    def batches():
        for _ in range(3):
            held.append(sum(w() is not None for w in alive))
            n = np.arange(0, 1001, 50, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(n), pa.array(np.arange(1000)))
            batch = pa.RecordBatch.from_arrays([pa.array(n[1:]), pa.array(["c"] * 20), lists], ["doc_id", "content", "shingles"])
            alive.append(weakref.ref(batch))
            yield batch
            del batch

    assert sum(b.num_rows for b in near_duplicates._with_keys(batches())) == 60
    assert held == [0, 0, 0]


def test_texts_come_in_short_batches(spark):
    name, long = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    before = spark.conf.get(name)
    spark.conf.set(name, long)
    try:
        encoding.encode(spark.createDataFrame([(1, "a text")], "doc_id bigint, text string"))
        assert int(spark.conf.get(name)) == common.BATCH_ROWS
    finally:
        spark.conf.set(name, before)


def test_words_are_hashed_where_they_stand():
    texts = ["", "One  two\x0bONE", "\t", "\x00 a\x00 a", "éÉ exactly8 exactly8x " + "long" * 9, "x" * 17 + " " + "X" * 16 + "y", " one"]
    array = pa.array(["skipped", *texts]).slice(1)
    offsets, hashed = language_model.tokens(array)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for t in texts for w in [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None]]
    assert np.diff(offsets).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for t in texts]
    assert len(set(zip(words, hashed.tolist(), strict=True))) == len(set(words)) == len(set(hashed.tolist()))


def test_a_document_is_cut_into_words_twice_however_many_rounds_learn_from_it(spark, monkeypatch):
    cut = []
    rows = spark.createDataFrame([(i, f"a few words {i % 3}") for i in range(40)], "doc_id bigint, text string")
    monkeypatch.setattr(language_model.LanguageModel, "_learn", lambda self, part, turn: cut.append(part.columns))
    model = language_model.LanguageModel(rows, F.col("doc_id") % 10 == 0)
    assert len(cut) == language_model.ROUNDS and not any("text" in c or "tokens" in c for c in cut)
    assert model.rows.select(F.sum(F.length("places"))).first()[0] == 2 * 40 * 5


def test_probabilities_of_large_weights_are_finite():
    counts = np.arange(300, 100, -1)
    net = language_model.Network(language_model.Vocabulary.of(np.arange(200) * 7919, counts, int(counts.sum()), 200))
    net.wc += 200 * np.random.default_rng(1).normal(0, 1, net.wc.shape).astype(np.float32)
    net.ww += 200 * np.random.default_rng(2).normal(0, 1, net.ww.shape).astype(np.float32)
    place, group = net.v.encode(np.arange(200) * 7919)
    state = np.random.default_rng(3).uniform(-1, 1, (200, language_model.HIDDEN)).astype(np.float32)
    grads = {}
    found, slope = net.log_probability(state, place, group, grads)
    assert np.isfinite(found).all() and np.isfinite(slope).all() and all(np.isfinite(g).all() for g in grads.values())
    assert found.min() < -100


def test_windows_stay_wide_while_pieces_of_any_length_are_learned_from(monkeypatch):
    counts = np.arange(300, 100, -1)
    net = language_model.Network(language_model.Vocabulary.of(np.arange(200) * 7919, counts, int(counts.sum()), 200))
    offsets = np.concatenate([[0], np.cumsum([16, 256] * 512)])
    place = np.random.default_rng(1).integers(0, 200, offsets[-1]).astype(np.uint16)
    learned, windows = [], []

    def learn(inputs, place, group, live, state, rate):
        windows.append(live.size)
        learned.append(np.stack([inputs[live], place[live]]))
        assert len(state) == inputs.shape[1] and not state[inputs[0] == net.begin].any()
        return np.ones_like(state)

    monkeypatch.setattr(net, "learn", learn)
    language_model.train_batch(net, offsets, place, 0.1)
    before = np.concatenate([[net.begin], place[:-1]])
    before[offsets[:-1]] = net.begin
    pairs = [np.sort(1000 * a.astype(np.int64) + b) for a, b in (np.concatenate(learned, axis=1), (before, place))]
    assert np.array_equal(*pairs)
    assert sum(windows) == len(place) and len(windows) <= 50  # 34 full ones and those that run out; 64 by groups of 256


def test_encoded_documents_of_several_batches_are_scored_together(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 200, n).astype(np.uint16) for n in (1, 900, 30, 2, 700, 5, 800, 1, 60)]
    counts = np.arange(300, 100, -1)
    net = language_model.Network(language_model.Vocabulary.of(np.arange(200) * 7919, counts, int(counts.sum()), 200))
    for name in ("wc", "ww"):
        setattr(net, name, rng.normal(0, 0.5, getattr(net, name).shape).astype(np.float32))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(range(i, i + 3)), pa.array([d.tobytes() for d in docs[i: i + 3]])], ["row", "places"])
        for i in (0, 3, 6)
    ]
    alone = [language_model.score_places(net, np.array([0, len(d)]), d)[0] for d in docs]
    steps, step = [], net.step
    monkeypatch.setattr(net, "step", lambda *a: steps.append(1) or step(*a))
    monkeypatch.setattr(language_model, "ROWS_AT_ONCE", 500)
    for at_once, parts, most in ((10**6, 1, 900), (1000, 2, 1700)):
        steps.clear()
        together = list(language_model._gathered(iter(batches), at_once))
        scores = [language_model.score_places(net, offsets, place) for _, offsets, place in together]
        assert len(together) == parts and len(steps) == most
        assert np.concatenate([row for row, _, _ in together]).tolist() == list(range(9))
        assert np.concatenate(scores) == pytest.approx(alone, rel=1e-5)


@pytest.mark.parametrize("near", [1 << 17, 300])
def test_probabilities_do_not_depend_on_how_rows_are_cut(monkeypatch, near):
    monkeypatch.setattr(language_model, "NEAR", near)
    rng = np.random.default_rng(6)
    counts = np.sort(rng.zipf(1.3, 6000).clip(1, 10**5))[::-1].copy()
    net = language_model.Network(language_model.Vocabulary.of(np.arange(6000) * 7919, counts, int(counts.sum()), 6000))
    for name in ("wc", "bc", "ww", "bw"):
        own = getattr(net, name)
        setattr(net, name, own + rng.normal(0, 0.5, own.shape).astype(np.float32))
    place, group = net.v.encode(rng.choice(6000, 3000, p=counts / counts.sum()) * 7919)
    state, grads = rng.uniform(-1, 1, (3000, language_model.HIDDEN)).astype(np.float32), {}
    found, slope = net.log_probability(state, place, group, grads)
    logits, words = state @ net.wc.astype(float) + net.bc, state @ net.ww.T.astype(float) + net.bw
    share = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    plain, of_class = np.log(share[np.arange(3000), group]), np.eye(net.v.classes)[group] - share
    by_state, of_word = of_class @ net.wc.T, np.zeros_like(words)
    for i in np.flatnonzero(place < net.v.modelled):
        own = slice(net.v.bounds[group[i]], net.v.bounds[group[i] + 1])
        share = np.exp(words[i, own]) / np.exp(words[i, own]).sum()
        plain[i] += np.log(share[place[i] - own.start])
        of_word[i, own] = -share
        of_word[i, place[i]] += 1
    assert found == pytest.approx(plain, rel=1e-4, abs=1e-4)
    assert slope == pytest.approx(by_state + of_word @ net.ww, rel=1e-3, abs=1e-4)
    for name, exact in (("wc", state.T @ of_class), ("bc", of_class.sum(0)), ("ww", of_word.T @ state), ("bw", of_word.sum(0))):
        assert grads[name] == pytest.approx(exact, rel=1e-2, abs=1e-2)
