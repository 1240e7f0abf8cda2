"""Operators 11 to 13: brute force over whole fixtures."""

import random
import re
from collections import Counter

from millrace.llm import alignment, collocation, packing, pivots


def phrases_by_hand(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer, out = Counter(), {}
    for (lang, w), a in cand.items():
        for inner in (w[:2], w[1:]):
            longer[lang, inner] = max(longer[lang, inner], a) if len(w) == 3 else longer[lang, inner]
    for (lang, w), a in cand.items():
        if len(w) == 2 and 100 * longer[lang, w] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top]))


def test_collocations_brute(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    words = ["a", "A", "b", "été", "d", "x" * 300, " ", "\U0001f600"]
    docs = [(rng.choice(["en", "en", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", ";", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    docs += [("fr", "same words here " * 40)] * 3 + [("fr", None), ("fr", "one two three")] + [("de", "alpha beta gamma.")] * 12 + [("de", "alpha beta")] * 6
    table = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    want = phrases_by_hand(docs, 10, 25)
    for shard, bits in ((1 << 20, 1 << 26), (20, 1 << 26), (20, 64)):  # small shards; filters that hold nothing back
        monkeypatch.setattr(collocation, "SHARD_WORDS", shard)
        monkeypatch.setattr(collocation, "FILTER_BITS", bits)
        got = sorted(tuple(r) for r in collocation.collocations(table, top=25).drop("size", "k").collect())
        assert got == want
    odd = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    got = sorted(tuple(r) for r in collocation.collocations(odd_docs, least=2, top=5).drop("size", "k").collect())
    assert got == phrases_by_hand(odd, 2, 5)
    assert collocation.collocations(no_docs).count() == 0


def test_automaton_counts_and_links():
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 500)
    before = np.minimum(np.arange(500) % 50, 9)
    made = collocation.SuffixAutomaton(words, before, 4)
    want = Counter()
    for s in range(0, 500, 50):
        w = words[s : s + 50].tolist()
        want.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(50 - k + 1))
    got = [(tuple(words[e - size + 1 : e + 1].tolist()), c) for size, ends, counts in made.phrases() for e, c in zip(ends.tolist(), counts.tolist())]
    assert len(got) == len(want) and dict(got) == dict(want)
    inner = np.flatnonzero(made.link >= 0)
    assert (made.size[made.link[inner]] == made.size[inner] - 1).all() and (made.count[made.link[inner]] >= made.count[inner]).all()


def vectors_by_hand(rows, least=0.9):
    import numpy as np

    dim = max((len(v) for _, v in rows if v), default=1)
    x = np.zeros((len(rows), dim))
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            y = np.array(v, float) / np.abs(v).max()
            x[i, : len(v)] = y / np.linalg.norm(y)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while True:
        least_root = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1, initial=len(rows)))
        if (least_root == root).all():
            return near.sum(axis=1), root
        root = least_root


def test_near_vectors_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    unit = lambda n: (y := rng.normal(size=(n, 24))) / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [x.tolist() for x in unit(500)]
    for centre in unit(30):  # groups of every tightness, so that balls link wholly, partly or not
        wide = rng.uniform(0.1, 0.55)
        rows += [(centre + wide * x).tolist() for x in unit(int(rng.integers(2, 60)))]
    rows += [rows[0]] * 300 + [[3 * c for c in rows[1]]] * 5 + [[1e200 * c for c in rows[2]], [1e-200 * c for c in rows[2]], rows[3][:23] + [0.0], rows[3][:23]]
    odd = [None, [], [0.0] * 24, [None] + rows[5][1:], [float("nan")] + rows[5][1:], [float("inf")] + rows[5][1:]]
    data = list(enumerate(rows + odd))
    df = spark.createDataFrame([(i, v, i, "x", 1) for i, v in data], "vec_id bigint, embedding array<double>, rid bigint, u string, ball int").repartition(7, "vec_id")
    got = {r["id"]: r for r in pivots.near_vectors(df).collect()}
    n, root = vectors_by_hand(data)
    mine = np.array([got[i]["n_links"] for i, _ in data])
    assert len(got) == len(data) and (mine <= n).all()
    assert mine.sum() >= 0.97 * n.sum()
    assert np.mean([got[i]["component_id"] == root[i] for i, _ in data]) > 0.97
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got.values())
    tied = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.1]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (None, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    rows = sorted(map(tuple, pivots.near_vectors(tied).collect()), key=repr)
    assert rows == sorted([(None, 1, None, True)] * 2 + [(4, 1, 4, True)] * 2 + [(None, 0, None, True)], key=repr)
    assert pivots.near_vectors(tied.limit(0)).count() == 0
    assert pivots.near_vectors(spark.createDataFrame([(1, None)], tied.schema)).count() == 1


def test_hot_lists_are_dealt_by_two_pivots(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 16))
    data = list(enumerate(np.vstack([base, base + 0.15 * rng.normal(size=base.shape)]).tolist()))
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    want = sorted(map(tuple, pivots.near_vectors(df).collect()))
    monkeypatch.setattr(pivots, "LONG", 3)
    assert sorted(map(tuple, pivots.near_vectors(df).collect())) == want
    assert sum(r[1] for r in want) >= 0.95 * vectors_by_hand(data)[0].sum() > 0


def aligned_by_hand(docs):
    import hashlib

    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(packing.tokenizer_file())
    one.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    two = sentencepiece.SentencePieceProcessor(model_file=packing.tokenizer_file("piece_bpe_32k.model"))
    made, count = [], Counter()
    for doc, text in docs:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        name_a = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a]
        name_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
        if not text or b"".join(name_a) != b" " + text.encode() or b"".join(name_b) != b" " + text.encode():
            a, b = [], []
        groups, i, j = [], 0, 0
        while i < len(a):
            own, other, x, y = [], [], 0, 0
            while not own or x != y:
                if x <= y:
                    own.append(a[i])
                    x += len(name_a[i])
                    i += 1
                else:
                    other.append(b[j])
                    y += len(name_b[j])
                    j += 1
            groups.append((own, other))
        links = Counter((p, q) for own, other in groups for p in own for q in other)
        count.update(links.keys())
        made.append((doc, len(a), len(b), groups, links))
    best = {}
    for (p, _), n in count.items():
        best[p] = max(best.get(p, 0), n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    rows = [(d, na, nb, len(g), sum(links.values()), sum(n for (p, q), n in links.items() if count[p, q] == best[p]), sum(n * count[p, q] for (p, q), n in links.items()), hashlib.sha256(text(g).encode()).hexdigest() if na else "") for d, na, nb, g, links in made]
    return rows, {(p, q, n, n == best[p]) for (p, q), n in count.items()}


def test_alignment_by_brute_force(spark, odd_docs, no_docs, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    paths = packing.tokenizer_file(), packing.tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(8)
    marks = ["<|endoftext|>", "</s>", "<0x41>", "▁", "\U0001f600", "漢字", "é", "\x00", "\r\n", "  ", "ab", "cde ", ".", "the ", "fi", " ", "İ"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(150)] + ["漢" * 3000, "😀" * 700, " ", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).union(odd_docs.select("doc_id", "text"))
    docs = docs.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60))
    want, pairs = aligned_by_hand([tuple(r) for r in docs.collect()])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha"]
    for part_bytes, long_group in ((64 << 20, 256), (2000, 4)):  # parts of stripes, and long groups
        monkeypatch.setattr(alignment, "PART_BYTES", part_bytes)
        monkeypatch.setattr(alignment, "LONG_GROUP", long_group)
        found = alignment.align(docs, *paths, derive={"sha": digest})
        assert sorted(map(tuple, found.documents.select(columns).collect()), key=repr) == sorted(want, key=repr)
        assert {tuple(r) for r in found.pairs.collect()} == pairs
    assert any(r[1] == 0 for r in want) and any(r[1] > 0 for r in want)
    assert alignment.align(no_docs, *paths).documents.count() == 0
    whole = alignment.op11_cross_tokenizer_alignment(spark, sf_dir)
    assert whole.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_long_groups_count_the_same():
    import numpy as np

    rng = np.random.default_rng(2)
    n_a, n_b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    g = alignment.Groups(rng.integers(0, 9, n_a.sum()), rng.integers(0, 9, n_b.sum()), np.repeat(np.arange(60), n_a), np.repeat(np.arange(60), n_b), n_a, n_b)
    doc = np.arange(60) // 7
    want = Counter()
    for i in range(60):
        want.update((((int(a) << 4) + int(b)) << alignment.DOC_BITS) + i // 7 for a in g.a[g.of_a == i] for b in g.b[g.of_b == i])
    codes, times = alignment.links_of(g, doc, 4)
    assert codes.tolist() == sorted(want) and times.tolist() == [want[c] for c in sorted(want)]
