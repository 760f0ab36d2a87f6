"""Quality classifier: a generalised additive model with pairwise interactions.

A score is the logistic function of an intercept, one table entry for each feature and one for each of
a few pairs of features. The tables are learned by cyclic boosting: round after round, every feature
in turn adds a shallow tree over its bins, fitted to what the model still gets wrong; after that the
pairs whose trees would gain most do the same over coarser bins. Scoring looks up bins and adds.

Features come from the text alone. The model learns from a sample of at most about ``TRAINING_ROWS``
labelled rows, chosen by a hash of the id, on the driver: that bound times the number of features is
all that is collected. Every row of every size is scored.

Defined cases: a missing text is an empty one and is scored. Without labels of both kinds every score
is the share of label 1, or 0.5. Ids or labels that are missing are not learned from; repeated labels of an
id count each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, materialise, text_of, words
from plumbline.llm.quality import measures

TRAINING_ROWS = 100_000
FEATURES = (
    "log_words", "word_length", "symbol_share", "capital_share", "digit_share", "mark_share", "repeated_lines",
    "repeated_words", "different_words", "line_words", "longest_word",
)
CUT = 0.7


def features(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the features in the order of ``FEATURES``."""
    text = text_of(documents)
    counted = documents.select("doc_id", let(text, lambda t: F.struct(
        measures(t).alias("m"),
        F.length(F.regexp_replace(t, "[^0-9]+", "")).alias("n_digits"),
        F.length(F.regexp_replace(t, "[^!?;:=\"]+", "")).alias("n_marks"),
        let(words(t), lambda ws: F.struct(
            F.size(F.array_distinct(ws)).alias("n_different"),
            F.coalesce(F.array_max(F.transform(ws, lambda w: F.length(w))), F.lit(0)).alias("longest"),
        )).alias("w"),
    )).alias("c")).select("doc_id", "c.*")
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return counted.select("doc_id", F.array(
        F.log1p("m.n_words"),
        share("m.word_chars", "m.n_words"),
        share("m.marks.n_symbols", "m.word_chars"),
        share("m.marks.n_capitals", "m.word_chars"),
        share("n_digits", "m.word_chars"),
        share("n_marks", "m.word_chars"),
        share("m.lines.n_dup_lines", "m.lines.n_lines"),
        share("m.n_repeat_words", "m.n_words"),
        share("w.n_different", "m.n_words"),
        F.log1p(share("m.n_words", "m.lines.n_lines")),
        F.log1p("w.longest"),
    ).alias("x"))


def _best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
    gain[(left_h < 1.0) | (right_h < 1.0)] = 0.0
    if not len(gain):
        return 0.0, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf values of a tree over bins of one or two features, from sums of gradients and curvatures."""
    values = np.full(g.shape, g.sum() / (h.sum() + ridge))
    if depth == 0:
        return values
    others = lambda axis: tuple(a for a in range(g.ndim) if a != axis)
    splits = [(*_best_split(g.sum(axis=others(a)), h.sum(axis=others(a)), ridge), a) for a in range(g.ndim)]
    gain, at, axis = max(splits, key=lambda s: s[0])
    if gain <= 1e-9:
        return values
    for part in (slice(0, at), slice(at, None)):
        place = tuple(part if a == axis else slice(None) for a in range(g.ndim))
        values[place] = shallow_tree(g[place], h[place], depth - 1, ridge)
    return values


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for bins, table in zip(self._bins(x, self.edges), self.tables, strict=True):
            total += table[bins]
        coarse = self._bins(x, self.pair_edges)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))

    @classmethod
    def fit(
        cls, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64,
        pair_bins: int = 8, n_pairs: int = 6, depth: int = 2,
    ) -> AdditiveModel:
        model = cls()
        if not len(y) or y.min() == y.max():
            model.intercept = 0.0 if not len(y) else (20.0 if y[0] else -20.0)
            return model

        def cuts(n: int) -> list[np.ndarray]:
            shares = np.arange(1, n) / n
            return [np.unique(np.quantile(np.unique(c) if len(np.unique(c)) <= n else c, shares)) for c in x.T]

        model.intercept = float(np.log(y.mean() / (1 - y.mean())))
        model.edges, model.pair_edges = cuts(bins), cuts(pair_bins)
        fine, coarse = cls._bins(x, model.edges), cls._bins(x, model.pair_edges)
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        total = np.full(len(y), model.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return y - p, np.maximum(p * (1 - p), 1e-9)

        def binned(at: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
            size = int(np.prod(shape))
            return tuple(np.bincount(at, weights=s, minlength=size).reshape(shape) for s in slopes())

        for _ in range(rounds):
            for at, table in zip(fine, model.tables, strict=True):
                step = rate * shallow_tree(*binned(at, table.shape), depth)
                table += step
                total += step[at]
        shapes = [len(e) + 1 for e in model.pair_edges]
        crossed = {(i, j): coarse[i] * shapes[j] + coarse[j] for i, j in combinations(range(len(shapes)), 2)}

        def gain(pair: tuple[int, int]) -> float:
            g, h = binned(crossed[pair], (shapes[pair[0]], shapes[pair[1]]))
            step = shallow_tree(g, h, depth)
            return float((g * step - h * step**2 / 2).sum())

        model.pairs = sorted(sorted(crossed, key=gain, reverse=True)[:n_pairs])
        model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
        for _ in range(rounds // 3):
            for pair, table in zip(model.pairs, model.pair_tables, strict=True):
                step = rate * shallow_tree(*binned(crossed[pair], table.shape), depth)
                table += step
                total += step.reshape(-1)[crossed[pair]]
        return model


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def train(featured: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAINING_ROWS) -> AdditiveModel:
    """A model of ``quality`` from the labelled rows for which ``usable`` holds, at most about ``rows``."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("y IS NOT NULL")
    known = featured.where(usable).join(marked, "doc_id").select("doc_id", "x", "y")
    n = known.count()
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1))
    part = known.where(place < F.lit(int(min(1.0, rows / max(n, 1)) * (1 << 62))))
    sample = part.select("y", "x").orderBy("doc_id", "y", "x").toArrow()
    x = np.array(sample.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel.fit(x, sample.column("y").to_numpy().astype(np.float64))


def scored(featured: DataFrame, model: AdditiveModel) -> DataFrame:
    """``featured`` without ``x``, with ``score``."""
    kept = [c for c in featured.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(x))], [*kept, "score"])

    schema = ", ".join([f"`{c}` {featured.schema[c].dataType.simpleString()}" for c in kept] + ["score double"])
    return featured.mapInArrow(run, schema)
