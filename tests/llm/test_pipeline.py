"""``corpus_pipeline.run`` row by row against a plain chain of its stages: SQL, all pairs, patterns, the tokenizer."""

from collections import Counter

import duckdb
import pandas as pd
from test_exact import SF_DIR, classes_of, disclosed_in, spans_in, terms_in

import corpus_pipeline
from plumbline.llm import catalogue, encoding

KINDS = ("email", "ip", "card", "phone", "secret", "term")


def by_sql(query, docs):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    return db.execute(f"SELECT * FROM ({catalogue.ORACLES[query]})").df().set_index("doc_id")


def passing(docs):
    kept = by_sql("op4_quality_rules", docs)["kept"]
    return [d for d in docs if kept[d[0]]]


def one_of_each(docs):
    classes = classes_of({d[0]: d[1] for d in docs})
    return [d for d in docs if classes[d[0]] == d[0]]


def clean(text, told):
    spans = [(a, KINDS.index(kind), b) for a, b, kind, _ in spans_in(text)]
    spans += [(a, KINDS.index("term"), b) for a, b, w in terms_in(text) if w in told]
    out, pos = "", 0
    for a, rank, b in sorted(spans):
        if a >= pos:
            out += text[pos:a] + f"[{KINDS[rank].upper()}]"
        pos = max(pos, b)
    return out + text[pos:]


def sanitised(docs):
    told = disclosed_in([d[1] for d in docs])
    texts = [clean(d[1], told) for d in docs]
    return [(d[0], t, d[2], d[3], len(t)) for d, t in zip(docs, texts, strict=True)]


def mixed(docs):
    plan = by_sql("op5_mixing", docs)
    return [d for d in docs for _ in range(plan["taken"][d[0]] // plan["size"][d[0]])]


def test_run_equals_a_plain_chain(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    docs = sorted((tuple(r) for r in rows), key=lambda d: d[0])
    sizes = [len(docs)]
    for stage in (passing, one_of_each, sanitised, mixed):
        docs = stage(docs)
        sizes.append(len(docs))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0 and len({d[0] for d in docs}) < len(docs)
    assert any("[EMAIL]" in d[1] for d in docs)
    tokenizer = Tokenizer.from_file(encoding.default_vocabulary())
    tokenizer.no_truncation(), tokenizer.no_padding()
    expected = Counter()
    for d in docs:
        ids = tokenizer.encode(d[1], add_special_tokens=False).ids
        expected[d[0], len(ids), tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in found) == expected
