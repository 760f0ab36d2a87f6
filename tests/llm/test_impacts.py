"""Exact nearest vectors against all products, and what the proof may rule out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import impacts

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k, divisor=100):
    """The answers of every asking row, in exact Python numbers."""
    used = [
        (i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    found = []
    for n, (q, a) in enumerate(used):
        if q % divisor == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(used) if m != n)
            found += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], start=1)]
    return sorted(found)


def answers(df, k=10, divisor=100):
    return sorted(map(tuple, impacts.nearest(df, F.col("vec_id") % divisor == 0, k).collect()))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + d * 11) % 17 - 8) / 16 for d in range(6)]) for i in range(40)]
    rows += [(100, None), (200, [nan, 1.0]), (300, [inf]), (400, [None, 1.0]), (500, []), (600, [0.5, -0.5]), (None, [1.0] * 6)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (7, [30.0] * 6), (700, [0.0] * 6), (800, [-1000.0, 1000.0] * 3), (-100, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(4)
    clashing = df.select("*", *[F.lit(2).alias(c) for c in ("block", "level", "grp", "home", "rank", "score")])
    assert answers(clashing) == plain(rows, 10)
    assert answers(df, 3, 1) == plain(rows, 3, 1)


def test_empty_and_single(spark):
    assert answers(spark.createDataFrame([], SCHEMA)) == []
    assert answers(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []


@pytest.mark.parametrize("seed", range(3))
def test_blocks_groups_and_ties(spark, monkeypatch, seed):
    """Clusters, copies and whole components, over many small blocks and groups."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, 12))
    vectors = centres[rng.integers(0, 5, 900)] + rng.normal(0, [0.01, 0.3, 1.0][seed], (900, 12))
    vectors[::7] = vectors[3]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    for name, size in (("BLOCK", 64), ("SLICE", 2), ("GROUP", 4)):
        monkeypatch.setattr(impacts, name, size)
    assert answers(df, 10, 50) == plain(rows, 10, 50)


def test_only_proven_pairs_are_ruled_out_and_most_are():
    rng = np.random.default_rng(9)
    vectors = np.floor(1024 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    rows = impacts._block_rows(0, np.arange(4000), np.arange(4000) % 100 == 0, vectors, 10)
    asks = [r for r in rows if r["level"] == impacts.ASKS][0]
    block = impacts.Block([r for r in rows if r["level"] != impacts.ASKS])
    assert (block.vectors == vectors).all()
    asking = np.frombuffer(asks["impacts"], dtype=np.int64).reshape(40, 64)
    floor = np.frombuffer(asks["floor"], dtype=np.int64)
    question, place = block.possible(asking, floor)
    exact = asking @ vectors.T
    assert set(zip(*np.nonzero(exact >= floor[:, None]), strict=True)) <= set(zip(question.tolist(), place.tolist(), strict=True))
    assert len(question) < 0.05 * exact.size


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**18 + i * j) for j in range(4)]) for i in range(0, 300, 50)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert answers(df) == plain(rows, 10)
