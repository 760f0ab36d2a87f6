"""The audit of filter orders against running the filters in every order."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import interactions

SCHEMA = "doc_id bigint, text string, lang string"


def plain(rows, labels):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, lang in rows:
        t = text or ""
        w = words.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        judged.append((i, lang or "", fails))
    found = []
    for part in sorted({p for _, p, _ in judged}):
        own, removed_by = [(i, f) for i, p, f in judged if p == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, start=1):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                removed_by[f] += len(gone)
                steps.append((f, [
                    part, "".join(order), k, len(left), len(gone), sum(x[f] for _, x in own) - len(gone),
                    sum(x[f] and sum(x.values()) == 1 for _, x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]))
        found += [(*row, removed_by[f]) for f, row in steps]
    return sorted(found)


def test_audit_of_odd_documents(spark):
    many = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, None, None), (2, "", "en"), (3, "", None), (4, many, "en"), (5, many, "en"), (5, many, "en"), (4, many, "de"), (6, many + " #", "en"),
        (7, "AB " * 250, "en"), (8, many.upper(), ""), (9, "x\x0by z", "fr"), (None, many, "en"), (None, None, "en"),
        (10, "same " * 250, "en"), (11, many.upper(), "en"), (12, many.upper() + "|", "fr"),
    ]
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, None), (8, None, 1), (99, 1, 1), (None, 1, 1)]
    documents = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(3).alias(c) for c in ("part", "cell", "id", "digest", "good", "A", "n")])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("id", F.lit(1))
    result = interactions.filter_audit(documents, marks)
    assert sorted(map(tuple, result.collect())) == plain(rows, labels)


def test_audit_of_empty_tables(spark):
    documents, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interactions.filter_audit(documents, marks).collect() == []
    one = spark.createDataFrame([(1, "a", "en")], SCHEMA)
    rows = interactions.filter_audit(one, marks).collect()
    assert len(rows) == 600 and {r.good_lost for r in rows} == {0}


def test_contractions_select_along_each_axis():
    cell, counts = np.arange(8), np.arange(8).reshape(8, 1) + 1
    tensor = interactions.Tensor("XYZ", cell, counts)
    assert tensor.contracted()[0] == 36
    assert tensor.contracted(X=interactions.FAIL)[0] == 2 + 4 + 6 + 8
    assert tensor.contracted(X=interactions.PASS, Z=interactions.FAIL)[0] == 5 + 7
