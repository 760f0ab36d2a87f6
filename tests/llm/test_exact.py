"""Operators against brute force on the smallest documents and on texts made to be hard."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import catalogue, encoding, fingerprints, near_duplicates, passages, privacy, substrings
from plumbline.llm.components import components

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in sorted(rows)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Near duplicates


def multiset(text):
    ws = WORD.findall(text)
    return Counter(tuple(ws[i: i + 5]) for i in range(max(1, len(ws) - 4)))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def classes_of(texts):
    sets = {k: multiset(t) for k, t in texts.items()}
    holders = {}
    for k, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(k)
    pairs = {p for ks in holders.values() for p in combinations(sorted(ks), 2)}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_classes(spark, texts):
    found = {r.doc_id: r.class_id for r in catalogue.QUERIES["op1_near_duplicates"](spark, SF_DIR).collect()}
    assert found == classes_of(texts)


def test_chain_of_edits_is_one_class(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        words = list(words)
        words[(i * 7) % 300] = f"e{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert found == classes_of(dict(rows)) and set(found.values()) == {0}


@pytest.mark.parametrize("few, block", [(64, 1000), (3, 1000), (3, 7)])
def test_hot_group_of_near_copies(spark, monkeypatch, few, block):
    """Versions of one text, most of them less similar to it than 0.8 and some similar to each other, in blocks of any size."""
    monkeypatch.setattr(near_duplicates, "FEW", few)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{i % 90}" for i in range(140)]
    rows = [(0, " ".join(words))]
    for i in range(1, 120):
        new = list(words if rng.random() < 0.7 else rows[rng.randrange(len(rows))][1].split())
        for _ in range(rng.choice([1, 2, 4, 5, 6, 7])):
            new[rng.randrange(len(new))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(new)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(frame).collect()}
    assert found == classes_of(dict(rows)) and len(set(found.values())) > 5


@pytest.mark.parametrize("held", [2, 30])
def test_overlaps(held):
    rng = np.random.default_rng(held)
    left, right = (rng.random((n, 900)) < held / 60 for n in (23, 41))
    (a, x), (b, y) = np.nonzero(left), np.nonzero(right)
    side = np.repeat([False, True], [len(a), len(b)])
    order = rng.permutation(len(side))
    element, row = np.concatenate([x, y]).astype(np.uint64)[order], np.concatenate([a, b])[order]
    found = near_duplicates.overlaps(element, row, side[order], 23, 41)
    assert (found == left.astype(int) @ right.T.astype(int)).all()


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(20):
        a = Counter({int(x): int(c) for x, c in zip(rng.integers(0, 2**62, 60), rng.integers(1, 9, 60), strict=True)})
        b = Counter(a)
        for k in list(a)[: int(rng.integers(0, 40))]:
            b[k] = int(rng.integers(0, 12))
        b = +b
        exact = sum((a & b).values()) / sum((a | b).values())
        sets = [np.sort(np.array(list(x.elements()), dtype=np.uint64)) for x in (a, b)]
        table = near_duplicates.signatures(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), 2, 2000)
        errors.append((table[0] == table[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.008 and max(map(abs, errors)) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i not in (20, 41)] + [(100, 200), (200, 150)]
    frame = spark.createDataFrame([(max(e), min(e)) for e in edges], "u bigint, v bigint")
    found = {r.node: r.root for r in components(frame).collect()}
    expected = {i: 0 if i <= 20 else 21 if i <= 41 else 42 for i in range(61)} | {200: 100, 150: 100}
    assert found == {k: v for k, v in expected.items() if k != v}


# Fingerprints


def simhash(text):
    votes, total, before = [0] * 64, 0, None
    weight = lambda w: len(f"{len(w):b}")
    for w in WORD.findall(text):
        terms = [(xxhash.xxh64_intdigest(w.encode(), 42), weight(w))]
        if before is not None:
            seed = xxhash.xxh64_intdigest(before.encode(), 42)
            terms.append((xxhash.xxh64_intdigest(w.encode(), seed), weight(w) + weight(before)))
        for h, n in terms:
            total += n
            for b in range(64):
                votes[b] += n * (h >> b & 1)
        before = w
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_fingerprints(spark, texts):
    found = {r.doc_id: r for r in catalogue.QUERIES["op2_simhash"](spark, SF_DIR).collect()}
    ids = list(texts)
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for i, k in enumerate(ids):
        text, following = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = simhash(text), simhash(edited), simhash(following)
        assert tuple(found[k])[1:] == (len(text), sha(edited), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c))


def test_near_fingerprints(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(200)]
    for v in values[:100]:
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            v ^= 1 << bit
        values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    found = {(r.a, r.b): r.distance for r in fingerprints.near_fingerprints(frame).collect()}
    mask = (1 << 64) - 1
    expected = {(a, b): ((a ^ b) & mask).bit_count() for a, b in combinations(sorted(set(signed)), 2) if ((a ^ b) & mask).bit_count() <= 3}
    assert found == expected


# Personal data

KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), r, m.end(), k) for r, (k, p) in enumerate(KINDS) for m in p.finditer(text) if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_personal_data(spark, texts):
    found = {r.doc_id: r for r in catalogue.QUERIES["op3_personal_data"](spark, SF_DIR).collect()}
    for k, text in texts.items():
        expected = base(text)
        assert found[k].base_sha256 == sha(expected)
        assert found[k].n_email == expected.count("email:")
        assert set(filter(None, expected.split(","))) <= set(found[k].spans.split(","))


def test_personal_data_in_random_texts(spark):
    rng = random.Random(1)
    made = ["".join(rng.choice("a1.@+ -()59\n€\U0001F600é%") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    made += [
        "+1 (555) 123-4567 1.2.3.4.5.6.7.8 0001.002.255.0000000 256.1.1.1 a@b.c_d@e.f 4532 0151 1283 0366 4532-0151-1283-0366-1",
        "\U0001F600 a@b.co \U0001F600+123456789 " * 200, "x" * 30000, "1" * 30000, "a@" + "b." * 10000 + "c", "1." * 10000,
    ]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    found = {r.doc_id: r.base for r in privacy.personal_data(frame).select("doc_id", privacy.written(F.col("base")).alias("base")).collect()}
    assert found == {i: base(t) for i, t in enumerate(made)}


def test_disclosing_terms(spark):
    rows = [(i, f"call zorblax {i} bob@x.example the {'office' if i % 2 else 'desk'}") for i in range(5)]
    rows += [(100 + i, f"the quick office desk call {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = {r.doc_id: r.text for r in privacy.sanitise(frame).collect()}
    assert all("zorblax" not in clean[i] and "bob@" not in clean[i] and " the " in clean[i] for i in range(5))
    assert all(clean[k] == t for k, t in rows if k >= 100)


def test_terms_disclose_wherever_they_stand(spark):
    far = "one two three four five six seven " * 5
    rows = [(i, f"bob@x.example writes {far} from Zorblax, {far} and zorblax again {'ab'[i % 2]}") for i in range(5)]
    rows += [(10, f"the {far} of zorblax"), (11, None), (None, rows[0][1]), (10, f"the {far} of zorblax")]
    rows += [(100 + i, f"the {far} writes from and again {i}") for i in range(60)]
    # Copies count once, so each of the first rows gets a mark of its own.
    rows = [(k, t if t is None or k is None or k >= 10 else f"{t}{k}9") for k, t in rows]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {(r.doc_id, r.spans) for r in privacy.personal_data(frame).select("doc_id", privacy.written(F.col("spans")).alias("spans")).collect()}
    told = {(k, ",".join(
        ([f"email:0:{len('bob@x.example')}"] if "bob" in (t or "") else [])
        + [f"term:{m.start()}:{m.end()}" for m in re.finditer("[Zz]orblax,?", t or "")]
    )) for k, t in rows}
    assert spans == told
    assert not any("zorblax" in (r.text or "").lower() for r in privacy.sanitise(frame).collect())


def spans_in(text):
    """(start, end, kind, value) of base spans and secrets."""
    found = [(m.start(), m.end(), k, m.group()) for k, p in KINDS for m in p.finditer(text) if valid(k, m.group())]
    found += [
        (m.start(), m.end(), "secret", m.group()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}", text)
        if min(len(re.findall("[0-9]", m.group())), len(re.findall("[A-Za-z]", m.group()))) >= 4
    ]
    return found


def terms_in(text):
    """(start, end, term) of the words that the spans leave."""
    left = list(text)
    for start, end, _, _ in spans_in(text):
        left[start:end] = " " * (end - start)
    found = [(m.start(), m.end(), m.group().lower().strip(".,;:!?\"'()[]{}<>|*#$%&_-+=/\\"))
             for m in re.finditer(r"[^\x20\x09-\x0D]+", "".join(left))]
    return [f for f in found if len(f[2]) > 1]


def protected_in(text):
    found = set()
    for _, _, kind, value in spans_in(text):
        digits = re.sub("[^0-9]", "", value)
        wider = {"email": value.lower().split("@")[-1], "ip": ".".join(value.split(".")[:3]),
                 "card": digits[:6], "phone": digits[:-7]}.get(kind)
        found |= {(kind, "value", value.lower()), (kind, "kind", "")} | ({(kind, "wider", wider)} if wider is not None else set())
    return found


def disclosed_in(texts):
    """Terms whose mutual information with an entity passes the threshold and pays for the pair, pair by pair."""
    texts = set(texts)
    terms = {t: {w for _, _, w in terms_in(t)} for t in texts}
    held = {t: protected_in(t) for t in texts}
    n_entity = Counter(e for es in held.values() for e in es)
    n_term = Counter(w for ws in terms.values() for w in ws)
    both = Counter((e, w) for t in texts for e in held[t] for w in terms[t])
    beside = {w for t in texts if held[t] for w in terms[t]}
    cost = math.log2(max(len(n_entity), 1) * max(len(beside), 1))
    told = set()
    for (e, w), n in both.items():
        information = math.log2(len(texts) / n_entity[e])
        pmi = math.log2(n * len(texts) / (n_entity[e] * n_term[w]))
        if information >= 1 and pmi >= 0.8 * information and n * pmi >= cost:
            told.add(w)
    return told


def assert_spans_as_by_brute_force(spark, rows):
    told = disclosed_in([t or "" for _, t in rows])
    order = [k for k, _ in KINDS] + ["secret", "term"]
    expected = Counter()
    for k, t in rows:
        found = [(a, order.index(kind), b) for a, b, kind, _ in spans_in(t or "")]
        found += [(a, order.index("term"), b) for a, b, w in terms_in(t or "") if w in told]
        expected[k, ",".join(f"{order[r]}:{a}:{b}" for a, r, b in sorted(found))] += 1
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = privacy.personal_data(frame).select("doc_id", privacy.written(F.col("spans")).alias("spans")).collect()
    assert Counter((r.doc_id, r.spans) for r in result) == expected
    return told


def test_disclosing_terms_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    told = assert_spans_as_by_brute_force(spark, [tuple(r) for r in rows])
    assert told  # the method finds terms in the given table


def test_terms_tell_what_values_generalise_to(spark):
    """No value recurs, but their mail domain, network, issuer and prefix do, beside words with digits too."""
    rng = random.Random(3)
    filler = [f"word{'abcdefghij'[i % 10]}{i}" for i in range(40)]
    some = lambda: " ".join(rng.sample(filler, 12))
    rows = [(i, f"{some()} acme2024, p{i}@acme.example {some()}") for i in range(12)]
    rows += [(20 + i, f"(Hostel) 10.20.30.{i} {some()}") for i in range(12)]
    rows += [(40 + i, f"{some()} dial: +44 20 {1000000 + 7919 * i} Reception") for i in range(12)]
    rows += [(60 + i, f"{some()} q{i}@mail{i}.example and 172.{i}.9.9") for i in range(20)]
    rows += [(80, f"only once beside z@lone.example {some()}"), (81, rows[0][1]), (82, None), (None, ""), (0, "acme2024")]
    rows += [(83, 'key = "0123456789abcdef0123456789abcdef",x'), (84, "a" * 40), (85, "1" * 40)]
    rows += [(100 + i, some()) for i in range(120)]
    told = assert_spans_as_by_brute_force(spark, rows)
    assert {"acme2024", "hostel", "reception"} <= told and not told & {"once", "only", *filler}


def test_a_term_of_one_text_tells_nothing_at_any_size(spark):
    for size in (50, 800):
        rows = [(i, f"plain words here {i % 7}") for i in range(size)]
        rows += [(size + i, f"plain words unique{i} u{i}@host{i}.example") for i in range(size // 10)]
        assert not {t for t in assert_spans_as_by_brute_force(spark, rows) if "unique" in t}


# Repeats


def runs(mask):
    return sum(1 for a, b in zip([0, *mask], mask, strict=False) if b and not a)


def bytes_left(texts):
    seen, result = set(), {}
    for k, text in texts.items():
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i: i + 100] in seen:
                gone[i: i + 100] = b"\1" * 100
            else:
                seen.add(data[i: i + 100])
        result[k] = (len(data), sum(gone), runs(gone), sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return result


def words_left(texts):
    tokens = {k: WORD.findall(t) for k, t in texts.items()}
    counts = Counter(tuple(ws[i: i + 35]) for ws in tokens.values() for i in range(len(ws) - 34))
    result = {}
    for k, ws in tokens.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - 34):
            if counts[tuple(ws[i: i + 35])] > 1:
                gone[i: i + 35] = [True] * 35
        result[k] = (len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return result


def hard_repeats():
    rng = random.Random(9)
    make = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(n))
    passage, other = make(60), make(36)
    texts = [f"{make(rng.randint(0, 40))} {passage} {make(rng.randint(0, 40))}" for _ in range(30)]
    texts += [passage, passage, f"{other} {other}", other, "z " * 400, "z " * 90, "zz" * 300, "é" * 200, "é" * 199]
    texts += [make(300) + passage[: rng.randrange(len(passage))] for _ in range(10)]
    return dict(enumerate(texts))


@pytest.mark.parametrize("made", ["documents", "hard"])
def test_repeated_bytes(spark, texts, made):
    texts = texts if made == "documents" else hard_repeats()
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = substrings.without_repeated_bytes(frame).select(
        "doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"), F.size("spans"), F.sha2("kept", 256)
    )
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == bytes_left(texts)


@pytest.mark.parametrize("made", ["documents", "hard"])
def test_repeated_passages(spark, texts, made):
    texts = texts if made == "documents" else hard_repeats()
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = passages.without_repeated_passages(frame).select(
        "doc_id", "n_words", F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)"), F.sha2("kept", 256)
    )
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == words_left(texts)


def test_repeats_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(1, text), (1, text), (1, "other"), (None, text)], "doc_id bigint, text string")
    found = passages.without_repeated_passages(frame).collect()
    assert sorted((len(r.spans), r.n_words) for r in found) == [(0, 1), (1, 50), (1, 50), (1, 50)]
    left = sorted((len(r.kept), r.doc_id) for r in substrings.without_repeated_bytes(frame).collect() if r.n_bytes > 5)
    assert left == [(0, 1), (0, 1), (len(text), None)]


# Scores


def test_base_score(spark, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*WORD.findall(t.translate(low)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in catalogue.QUERIES["op8_language_model"](spark, SF_DIR).collect():
        ws = tokens[r.doc_id]
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(counts[w] > 0 for w in ws)
        assert r.base_score == pytest.approx(score, rel=1e-9)


# Encoding


def test_encoding(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.default_vocabulary())
    hard = ["á ́b", "e ́x  ̧y", "x<|endoftext|>y <|startoftext|>", " a\u0085b", "it's o'clock 123", "\x1c\x00a", "ΑΣ ﬁ", " "]
    rng = random.Random(2)
    hard += ["".join(rng.choice("aB ̧́é\n\t1'<|>.ẛ̣") for _ in range(300)) for _ in range(200)]
    made = {**texts, **{10**6 + i: t for i, t in enumerate(hard)}}
    frame = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    for r in encoding.encode(frame).collect():
        ids = tokenizer.encode(made[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
