"""Operators 4, 5, 7, 8 and the pipeline: brute force, round trips and held-out accuracy."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import decontaminate, nnpu, packing, quality, toxicity
from millrace.session import durable

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered_words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination_brute(spark, odd_docs, no_docs):
    rng = random.Random(1)
    item = lambda n: " ".join(rng.choices("abcde", k=n))
    items = [(i, item(n)) for i, n in enumerate([0, 1, 2, 3, 5, 9, 10, 11, 14, 30, 30])] + [(50, None), (51, item(10)), (51, item(10)), (None, item(12))]
    docs = [(100 + i, item(rng.randint(0, 60)).replace(" ", rng.choice([" ", ", ", "\n"]))) for i in range(60)]
    docs += [(200 + i, f"{items[9][1].upper()} tail {items[10][1]}") for i in range(3)]
    d = odd_docs.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id bigint, text string"))
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for window, block in ((10, 1 << 20), (4, 1 << 20), (10, 40)):
        want = []
        for r in d.collect():
            w, hit, ids = lowered_words(r["text"]), set(), set()
            for i, t in items:
                x = lowered_words(t)
                m = min(window, len(x))
                grams = {tuple(x[a : a + m]) for a in range(len(x) - m + 1)} if m else set()
                for a in range(len(w) - m + 1):
                    if tuple(w[a : a + m]) in grams:
                        hit |= set(range(a, a + m))
                        ids.add(i)
            want.append((r["doc_id"], len(w), sorted(hit), sorted(x for x in ids if x is not None)))
        out = decontaminate.contamination(d, b, window=window, max_item_bytes=block).collect()
        mine = [(r["doc_id"], r["n_words"], [i for s in r["spans"] for i in range(s["start"], s["end"])], sorted(set(r["items"]))) for r in out]
        assert sorted(mine, key=repr) == sorted(want, key=repr)
    assert decontaminate.contamination(no_docs, b).count() == 0
    # one item far beyond the bound, and rows that repeat: cut, and found all the same
    big = " ".join(f"w{i}" for i in range(3000))
    many = spark.createDataFrame([(1, big)] * 50 + [(2, "some other item of eleven words to be found here now")], "item_id bigint, text string")
    one = spark.createDataFrame([(9, "x " + " ".join(f"w{i}" for i in range(1000, 1300)) + " y")], "doc_id bigint, text string")
    row = decontaminate.contamination(one, many, max_item_bytes=2000).first()
    assert [tuple(s) for s in row["spans"]] == [(1, 301)] and row["items"] == [1]
    assert {len(r["items"]) for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}


def test_ids_equal_the_tokenizers():
    path = packing.tokenizer_file()
    mine, theirs = packing.encoder(path), Tokenizer.from_file(path)
    theirs.encode_special_tokens = True
    rng = random.Random(0)
    marks = [chr(c) for c in range(1, 0x3100)] + ["\U0001f600", "<|endoftext|>", "'s", "  ", "\n\n", " "]
    texts = [f"a{c}b {c}1{c}\n {c}  {c}'{c}" for c in marks]
    texts += ["".join(rng.choice(marks if rng.random() < 0.3 else list(" ab1',.\n")) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, repr(text)


def check_packed(rows, size=1024):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return by_seq, by_doc


def test_packing_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(5), packing.tokenizer_file(), n_open=8).collect()
    by_seq, by_doc = check_packed(rows)
    tokens = Tokenizer.from_file(packing.tokenizer_file())
    tokens.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + r["ids"]
    assert set(whole) == set(texts)
    for d, raw in whole.items():
        assert np.frombuffer(raw, "<u4").tolist() == tokens.encode(texts[d] or "", add_special_tokens=False).ids + [0]
    used = sum(length for spans in by_seq.values() for _, length in spans)
    assert used / (1024 * len(by_seq)) > 0.9
    for r in packing.op7_packing(spark, sf_dir).collect():
        assert r["ids_crc32"] == zlib.crc32(whole[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])])


def test_packing_leftovers_by_level(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = spark.range(0, 300, 1, 9).selectExpr("id as doc_id", "repeat('word ', cast(id % 37 as int)) as text")
    rows = packing.pack(docs, packing.tokenizer_file(), size=128, n_open=4).collect()
    by_seq, by_doc = check_packed(rows, 128)
    assert len(by_doc) == 300 and len(by_seq) < 1.25 * sum(r["length"] for r in rows) / 128 + 1
    rows = packing.pack(odd_docs, packing.tokenizer_file()).collect()
    check_packed(rows)
    assert sum(r["start"] + r["length"] == r["doc_tokens"] for r in rows) == odd_docs.count()
    assert packing.pack(no_docs, packing.tokenizer_file()).count() == 0


def test_sequence_numbers_never_meet(spark):
    """Ranges of numbers of any two packers are apart, and all are positive longs."""
    tasks = [0, 1, 2, 1 << 18, (1 << 18) + 1, (1 << 28) - 1]
    starts = sorted(packing.first_number(level, task) for level in range(8) for task in tasks)
    assert len(set(starts)) == 8 * len(tasks) and 0 <= starts[0] and starts[-1] + (1 << packing.TASK_BITS) <= 1 << 63
    assert all(b - a >= 1 << packing.TASK_BITS for a, b in zip(starts, starts[1:]))
    rows = packing.pack(spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string"), packing.tokenizer_file()).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in rows) == [("a", 3), ("b", 1)]


def test_nnpu_finds_the_negatives():
    rng = np.random.default_rng(0)
    make = lambda n, p: (y := rng.random(n) < p, np.column_stack([np.where(y, 1, -1) + rng.normal(size=n), rng.normal(size=n)]).astype(np.float32))
    y, x = make(8000, 0.3)
    pos = make(20000, 0.3)
    pos = pos[1][pos[0]]
    model = nnpu.fit(pos, x, 0.3)
    test_y, test_x = make(4000, 0.3)
    assert ((model.score(test_x) >= 0.5) == test_y).mean() > 0.82
    assert abs(model.score(test_x).mean() - 0.3) < 0.05
    none = nnpu.fit(pos[:0], x, 0.3)
    assert np.allclose(none.score(test_x), 0.3)


def test_risk_by_brute_force():
    rng = np.random.default_rng(4)
    xp, xu, t = rng.normal(size=(30, 3)), rng.normal(size=(50, 3)), rng.normal(size=3)
    loss = lambda z: math.log(1 + math.exp(-z))
    f = lambda x: sum(float(a) * float(b) for a, b in zip(x, t))
    for prior in (0.1, 0.5, 0.95):
        positive = prior * sum(loss(f(x)) for x in xp) / 30
        negative = sum(loss(-f(x)) for x in xu) / 50 - prior * sum(loss(-f(x)) for x in xp) / 30
        got = nnpu.risk_of(t, xp, xu, prior)
        assert np.allclose(got, (positive + max(0, negative), negative))


def test_correction_keeps_the_negative_part_from_falling():
    rng = np.random.default_rng(5)  # few rows and many inputs: easy to overfit
    y = rng.random(300) < 0.3
    unl = (np.where(y, 0.5, -0.5)[:, None] + rng.normal(size=(300, 60))).astype(np.float32)
    pos = (0.5 + rng.normal(size=(40, 60))).astype(np.float32)
    model = nnpu.fit(pos, unl, 0.3, l2=1e-6)
    theta = np.append(model.weights, model.bias)
    pad = lambda x: np.column_stack([x, np.ones(len(x))])
    risk, negative = nnpu.risk_of(theta, pad(pos), pad(unl), 0.3)
    assert negative >= -1e-6
    start = np.append(np.zeros(60), math.log(0.3 / 0.7))
    assert risk < nnpu.risk_of(start, pad(pos), pad(unl), 0.3)[0]


@pytest.mark.parametrize("prior", [0.1, 0.5, 0.85])
def test_prior_of_a_mixture(prior):
    rng = np.random.default_rng(6)
    x = lambda y: (np.where(y, 1.5, -1.5)[:, None] + rng.normal(size=(len(y), 4))).astype(np.float32)
    found = nnpu.learn(x(np.ones(3000, bool)), x(rng.random(9000) < prior))[1]
    assert abs(found - prior) < 0.05


def test_samples_stay_in_their_bounds(spark):
    docs = spark.range(30_000).selectExpr("if(id < 20000, 1, if(id < 25000, null, id)) as doc_id", "concat('text ', if(id < 10000, 0, id)) as text")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (29_000, 1, 1), (28_000, 0, 0)], "doc_id bigint, quality int, toxic int")
    sample = nnpu.samples(docs, labels, "quality", ~nnpu.held_out("doc_id", 3, 5), max_pos=50, max_unl=400)
    assert sample.count() < 700
    assert 20 <= nnpu.capped(sample, "p_draw", 50).count() <= 50
    assert 300 <= nnpu.capped(sample, "u_draw", 400).count() <= 400


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op5_quality_classifier, "quality", 0.94), (toxicity.op8_toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    out = query(spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    folds, fold = (3, 1) if label == "quality" else (5, 0)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) for r in out)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > least
    if label == "toxic":
        caught = sum(p and t for p, t in held)
        assert caught >= 0.9 * sum(t for _, t in held)
        assert caught >= 0.98 * sum(p for p, _ in held)


def test_sparse_rows_fit_like_dense_ones():
    rng = np.random.default_rng(5)
    dense = ((rng.random((900, 40)) < 0.08) * rng.random((900, 40))).astype(np.float32)
    toxic = dense[:, :4].sum(axis=1) > 0.4
    pos, unl = dense[toxic][::2], dense

    def sparse(x):
        row, col = np.nonzero(x)
        return nnpu.Sparse(row, col, x[row, col].astype(float), x.shape)

    for prior in (0.05, 0.2, 0.5):
        a, b = nnpu.fit(pos, unl, prior, l2=1e-3), nnpu.fit(sparse(pos), sparse(unl), prior, l2=1e-3)
        assert np.abs(a.score(unl) - b.score(sparse(unl))).max() < 0.05
    assert np.abs(nnpu.separator(pos, unl, 1e-3).score(unl) - nnpu.separator(sparse(pos), sparse(unl), 1e-3).score(sparse(unl))).max() < 0.01


def test_draws_do_not_depend_on_the_split(spark):
    docs = spark.range(3_000).selectExpr("id as doc_id", "concat('text ', id % 700) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    drawn = [
        sorted(map(tuple, nnpu.samples(d, labels, "toxic", ~nnpu.held_out("doc_id", 5, 0), max_pos=200, max_unl=500).collect()), key=str)
        for d in (docs, docs.repartition(7), docs.union(docs).repartition(3))
    ]
    assert drawn[0] == drawn[1] == drawn[2] and 300 < len(drawn[0]) < 800


def test_classifiers_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (odd_docs, no_docs):
        for known in (labels, labels.limit(0)):
            score = quality.quality_scorer(docs, known)
            rows = docs.select(score("text").alias("s")).collect() + toxicity.score_toxicity(docs, known).selectExpr("score as s").collect()
            assert len(rows) == 2 * docs.count()
            assert all(0 <= r["s"] <= 1 for r in rows)


def test_pipeline(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = durable(stage(spark, before, sf_dir))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert 0 < docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0, name
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
    odd = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        odd = durable(stage(spark, odd, sf_dir))
    none = no_docs
    for _, stage in corpus_pipeline.STAGES:
        none = durable(stage(spark, none, sf_dir))
    assert none.count() == 0
