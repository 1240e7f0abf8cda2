"""Operators 2, 6 and 9 against brute force, with edge cases."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chaining, exact_dedup, graph, simhash
from millrace.llm.skew import join_by_key
from millrace.llm.text import as_buffers, words_of


def test_polynomials_compose():
    rng = random.Random(3)
    texts = ["", None, "é" * 3000, "x" * 20_000] + ["".join(rng.choices("abcé\n", k=rng.randint(0, 9000))) for _ in range(20)]
    high, low, sizes = exact_dedup.fingerprints(pa.array(texts))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for got, prime, base in ((high, exact_dedup.PRIMES[0], exact_dedup.BASES[0]), (low, exact_dedup.PRIMES[1], exact_dedup.BASES[1])):
            whole = (0, 0)
            for a in range(0, len(raw), 1000):  # any cutting combines to the same hash
                part = raw[a : a + 1000]
                h = sum((b + 1) * pow(base, k, prime) for k, b in enumerate(part)) % prime
                whole = exact_dedup.combine(whole, (h, len(part)), prime, base)
            assert (int(got[i]), int(sizes[i])) == whole


def test_exact_dedup_with_colliding_fingerprints(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    for primes in (exact_dedup.PRIMES, (2, 3)):
        out = exact_dedup.dedup(odd_docs, primes=primes).collect()
        assert len(out) == len(rows)
        groups = {}
        for r in rows:
            groups.setdefault(r["text"] or "", []).append(r["doc_id"])
        by_sha = {}
        for o in out:
            by_sha.setdefault(o["text_sha256"], []).append(o)
        assert len(by_sha) == len(groups)
        for found in by_sha.values():
            assert sum(o["kept"] for o in found) == 1
            ids = [o["doc_id"] for o in found if o["doc_id"] is not None]
            assert {o["group_size"] for o in found} == {len(found)}
            assert {o["keep_id"] for o in found} == {max(ids) if ids else None}
    assert exact_dedup.dedup(no_docs).count() == 0


def test_huge_texts_are_hashed_in_parallel(spark, odd_docs):
    rng = random.Random(8)
    texts = ["".join(rng.choices("abc é\n", k=n)) for n in (0, 99, 100, 101, 400, 1000, 5003)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").union(odd_docs.select("doc_id", F.coalesce("text", F.lit(""))))
    prints = [{(r["doc_id"], r["n_bytes"], r["fp"], r["text_sha256"]) for r in exact_dedup.fingerprinted(docs, huge_bytes=n).collect()} for n in (100, 1 << 24)]
    assert prints[0] == prints[1]
    out = [sorted(map(tuple, exact_dedup.dedup(docs, huge_bytes=n).collect()), key=repr) for n in (100, 1 << 24)]
    assert out[0] == out[1]


def test_join_by_key_with_hot_keys(spark):
    rows = spark.range(10_000).selectExpr("if(id % 3 = 0, null, if(id % 2 = 0, 7, id)) as k", "id as v")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    got = join_by_key(rows, per_key, ["k"], 10_000)
    want = rows.join(per_key.drop("n"), "k")
    assert got.columns == ["k", "v", "m"] and got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_keep_decided(spark, odd_docs):
    kept = exact_dedup.keep_decided(odd_docs, exact_dedup.dedup(odd_docs))
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({r["text"] or "" for r in odd_docs.collect()})


def brute_components(ids, fps):
    f, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_brute(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    out = simhash.near_groups(odd_docs).collect()
    prints = {(r["doc_id"], r["fp"] % 2**64) for r in out}
    assert prints == {(d["doc_id"], brute_fingerprint(d["text"])) for d in docs}
    want = brute_components([r["doc_id"] for r in out], [r["fp"] % 2**64 for r in out])
    assert [r["component_id"] for r in out] == want
    assert simhash.near_groups(no_docs).count() == 0


def test_dense_posting_lists(spark, monkeypatch):
    rng = random.Random(5)
    base, prints = rng.getrandbits(64), {0, 1, 2**64 - 1}
    for _ in range(500):
        x = base
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = lambda x: int(np.uint64(x).view(np.int64))
    want = brute_components(list(range(len(prints))), prints)
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp bigint")
    for long, lookup in ((4096, 8192), (20, 10)):
        monkeypatch.setattr(simhash, "LONG", long)
        monkeypatch.setattr(simhash, "LOOKUP", lookup)
        edges = simhash.links(nodes)
        roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
        got = [roots.get(signed(x), signed(x)) for x in prints]
        assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id as u", "id + 1 as v").union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "u bigint, v bigint"))
    roots = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert graph.components(edges.limit(0)).count() == 0


def test_passages(spark, odd_docs, no_docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = [word() for _ in range(60)]
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    del fuzzy[40]
    text = lambda inner: " ".join([word() for _ in range(90)] + inner + [word() for _ in range(80)])
    rows = [(10, text(passage)), (11, text(fuzzy)), (12, text(passage[:30])), (13, text([])), (14, text(passage).upper())]
    rows += [(15, rows[0][1])]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = chaining.passages(docs).collect()
    found = {r["doc_id"]: r for r in out}
    assert set(found) == {6, 11, 14, 15}
    assert found[6]["anchor"] == 5 and found[6]["end"] >= 30_000
    assert found[11]["anchor"] == 10 and abs(found[11]["start"] - 90) <= 1 and 0.9 < found[11]["identity"] < 1
    assert (found[14]["start"], found[14]["end"], found[14]["identity"]) == (90, 150, 1.0)
    assert (found[15]["anchor"], found[15]["identity"], found[15]["end"]) == (10, 1.0, 230)
    assert chaining.passages(no_docs).count() == 0


def test_passages_near_other_shared_runs(spark):
    rng = random.Random(17)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    passage, stray = words(110), words(22)
    parted = words(80) + passage[:55] + words(40) + passage[55:] + words(80)
    strayed = words(80) + passage[:55] + words(45) + stray + words(80)
    rows = [(1, words(80) + passage + words(80)), (2, parted), (3, words(50) + passage[:55] + words(20) + stray + words(80)), (4, strayed)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    out = {(r["doc_id"], r["anchor"], r["start"], r["end"], r["identity"]) for r in chaining.passages(docs).collect()}
    assert {(2, 1, 80, 135, 1.0), (2, 1, 175, 230, 1.0), (4, 1, 80, 135, 1.0)} <= out


def test_passages_whose_parts_stand_elsewhere(spark):
    rng = random.Random(29)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    rows, want = [], []
    for n, parts in [(90, 2)] * 12 + [(120, 3)] * 6 + [(400, 10)] * 3:
        passage, size, first = words(n), n // parts, 100 * len(want)
        rows += [(first + i, words(60) + passage[i * size : (i + 1) * size] + words(60)) for i in range(parts)]
        rows += [(first + 50, words(70) + passage + words(60)), (first + 51, words(80) + passage + words(60))]
        want.append((first + 51, 80, 80 + n, first + 50, 70, 70 + n, 1.0))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    assert {tuple(r) for r in chaining.passages(docs).collect()} == set(want)


def test_seed_runs_move_with_the_text():
    rng = np.random.default_rng(3)
    hashes, anchors = rng.integers(-(2**63), 2**63, 40), rng.integers(0, 3, 40)
    places = np.cumsum(rng.integers(1, chaining.WINDOW + 1, 40))
    columns = (np.repeat([4, 9], 40), np.concatenate((places, places + 1000)), np.tile(hashes, 2), np.tile(anchors, 2), np.tile(places + 7, 2))
    found, ids, at, spans, first = chaining.seed_runs(*columns)
    mine, theirs = ({(h, p - o, s) for h, i, p, s in zip(found.tolist(), ids.tolist(), at.tolist(), spans.tolist()) if i == d} for d, o in ((4, 0), (9, 1000)))
    assert mine == theirs and len(mine) > 40 and min(spans) >= min(chaining.RUNS) and first.all()
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 7]) for c in columns], list("abcde")) for a in range(0, 80, 7)]
    cut = [x for b in chaining._run_rows(iter(batches)) for x in b.column(0).to_pylist()]
    assert sorted(cut) == sorted(found.tolist())
    same = chaining.seed_runs(*columns[:3], np.zeros(80, int), columns[1] - 5)
    assert not len(same[0])  # one anchor at one distance: no run needed


def test_seeds_of_any_exact_run():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 2**63, 400).astype(np.uint64)
    sizes = np.array([0, 150, 19, 31, 200])
    owner = np.repeat(np.arange(5), sizes)
    rank = np.arange(400) - (np.cumsum(sizes) - sizes)[owner]
    grams = chaining.kmers(words, chaining.K)
    own = owner[: len(grams)]
    whole = rank[: len(grams)] + chaining.K <= sizes[own]
    at = chaining.seed_places(grams, own, whole, chaining.WINDOW)
    assert whole[at].all()
    for i in range(len(grams) - chaining.WINDOW + 1):
        if whole[i + chaining.WINDOW - 1] and own[i] == own[i + chaining.WINDOW - 1]:
            assert ((at >= i) & (at < i + chaining.WINDOW)).any()
    assert len(at) < 0.25 * len(grams)


def edited(rng, passage, rate, make):
    """A passage with substitutions, insertions and deletions at random places."""
    out = []
    for w in passage:
        kind = rng.random()
        if kind >= rate:
            out.append(w)
        elif kind < rate / 2:
            out += make(1)
        elif kind < 3 * rate / 4:
            out += [w, *make(1)]
    return out


def test_recall_of_edited_passages(spark):
    """Shared passages with random edits, each of 60 to 120 words: found, or not."""
    rng = random.Random(41)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    rows, rates = [], {}
    for i in range(300):
        rate, passage = (0.03, 0.06, 0.1)[i % 3], words(rng.randint(60, 120))
        rates[2 * i + 1] = rate
        rows += [(2 * i, words(70) + passage + words(70)), (2 * i + 1, words(50) + edited(rng, passage, rate, words) + words(50))]
    found = {r["doc_id"] for r in chaining.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()}
    assert found <= set(rates)
    for rate, least in ((0.03, 0.98), (0.06, 0.95), (0.1, 0.9)):
        of = [d for d, r in rates.items() if r == rate]
        print("recall at", rate, len(found & set(of)) / len(of))
        assert len(found & set(of)) / len(of) >= least


def test_a_passage_after_a_longer_one(spark):
    rng = random.Random(47)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    long, short = words(500), words(56)
    rows = [(1, long + words(1000) + short), (2, long + words(1100) + short[:30] + words(1) + short[30:])]
    out = chaining.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")).collect()
    assert sorted((r["start"], r["end"]) for r in out) == [(0, 500), (1600, 1657)]


def test_ids_that_repeat_and_other_types(spark):
    rng = random.Random(53)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    first, second = words(200), words(200)
    rows = [(5, first), (5, second), (5, second), (6, words(30) + first), (7, second)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string")
    want = [(5, 7), (6, 5)]
    pairs = lambda out: sorted(tuple(sorted((str(r["doc_id"]), str(r["anchor"])))) for r in out)
    out = chaining.passages(docs).collect()
    assert pairs(out) == [("5", "6"), ("5", "7")] and all(r["end"] - r["start"] == 200 for r in out), (out, want)
    named = chaining.passages(docs.selectExpr("concat('n', doc_id) as doc_id", "text"))
    assert dict(named.dtypes)["doc_id"] == "string"
    assert pairs(named.collect()) == [("n5", "n6"), ("n5", "n7")]


def test_stretches_of_a_chain_by_brute_force():
    rng, k = random.Random(23), chaining.K
    for _ in range(200):
        mine, theirs, seeds = [], [], []
        for _ in range(rng.randint(2, 6)):
            run = [rng.getrandbits(31) for _ in range(rng.randint(k, 40))]
            seeds.append((len(mine), len(theirs)))
            seeds.append((len(mine) + len(run) - k, len(theirs) + len(run) - k))
            mine, theirs = mine + run, theirs + run
            mine, theirs = mine + [rng.getrandbits(31) for _ in range(rng.randint(1, 30))], theirs + [rng.getrandbits(31) for _ in range(rng.randint(1, 30))]
        firsts, lasts, good = seeds[::2], [(p + k, q + k) for p, q in seeds[1::2]], []
        for i, (p, q) in enumerate(firsts):
            for j in range(i, len(lasts)):
                held = sum(lasts[h][0] - firsts[h][0] for h in range(i, j + 1))
                n = max(lasts[j][0] - p, lasts[j][1] - q)
                if lasts[j][0] - p >= 50 and held / n >= 0.8:
                    good.append((i, j, (p, lasts[j][0], q, lasts[j][1], held / n)))
        want = [g for i, j, g in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b, _ in good)]
        assert chaining.aligned(np.array(mine, "<u4"), 0, np.array(theirs, "<u4"), 0, seeds) == want


def test_near_predecessor_of_a_far_chain():
    far = np.arange(40) * 7
    near = 600 + np.array([0, 9, 20, 30, 41])
    pos, other = np.concatenate((far, near)), np.concatenate((far, near + np.array([5, 5, 6, 6, 7])))
    assert {tuple(c) for c in chaining.chains(pos, other)} == {tuple(range(40)), tuple(range(40, 45))}


def test_chain_value_by_brute_force():
    rng = random.Random(2)
    k, gap = chaining.K, chaining.GAP_COST
    for _ in range(40):
        n = rng.randint(2, 9)
        pos, other = np.array([rng.randint(0, 60) for _ in range(n)]), np.array([rng.randint(0, 60) for _ in range(n)])

        def value(c, pos=pos, other=other):
            steps = [(pos[b] - pos[a], other[b] - other[a]) for a, b in zip(c, c[1:])]
            return k * len(c) - gap * sum(x + y for x, y in steps) if all(x > 0 and y > 0 for x, y in steps) else -1

        best = 0
        for mask in range(1, 1 << n):
            c = sorted((i for i in range(n) if mask >> i & 1), key=lambda i: pos[i])
            best = max(best, value(c))
        if len(set((other - pos).tolist())) > 1:
            assert abs(max(value(list(c)) for c in chaining.chains(pos, other)) - best) < 1e-9


def test_words_cross_no_row_or_stretch():
    texts = ["ab", "cd ef", None, "", "x" * 5000 + " y"]
    data, offsets = as_buffers(pa.array(texts))
    for limit in (16, 1 << 20):
        starts, ends, hashed, rows = words_of(data, offsets, limit)
        assert np.diff(rows).tolist() == [1, 2, 0, 0, 2]
        assert (ends - starts).tolist() == [2, 2, 2, 5000, 1]
