"""Operators 1, 3 and 10: SQL twins, round trips and edge cases."""

import functools
import hashlib
import math
import re
import zlib

import pytest
import xxhash

from millrace.llm import chat, licenses, sharding
from millrace.llm.catalog import ORACLES, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_chat_round_trip(spark):
    texts = ["", None, "<|im_sep|>", "a\\<|b", "\\\\|", "<", "|x", "\n", "<|im_end|>\n<|im_start|>user\n"]
    rows = [(c, t, r, x) for c in (1, 2) for t, (r, x) in enumerate([(r, x) for r in ("user", "assistant", "a\n<|b", None) for x in texts])]
    rows += [(3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (None, None, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    want = [(r or "", x or "") for _, _, r, x in rows[: len(rows) // 2]][: len(texts) * 4]
    for c in (1, 2):
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert list(back[c]["loss_texts"]) == [x for r, x in want if r == "assistant"]
    assert [t["text"] for t in back[3]["turns"]] == ["x", "x"]
    assert back[None]["turns"][0]["text"] == "n"
    assert back[1]["formatted"].count("<|im_start|>") == 4  # adjacent turns of a role are merged
    assert chat.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 1001])
def test_feistel_is_a_permutation(spark, n):
    rows = spark.range(n).selectExpr("id as doc_id", "cast(id as string) as text", "1 as size")
    out = sharding.shard(rows, 8, buckets=5).collect()
    assert sorted(r["position"] for r in out) == list(range(n))
    again = sharding.shard(rows.repartition(3), 8, buckets=5).collect()
    assert {r["doc_id"]: r["position"] for r in out} == {r["doc_id"]: r["position"] for r in again}


def test_shards_of_odd_rows(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(sharding, "SPREAD", 2)
    hot = odd_docs.select("doc_id", "text").union(spark.range(9).selectExpr("7L", "'same'"))
    out = sharding.shard(hot, 3).collect()
    assert len(out) == hot.count()
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    null = [r for r in out if r["doc_id"] == 1][0]
    assert (null["size"], null["text_crc32"]) == (1, 0)
    long = [r for r in out if r["doc_id"] == 8][0]
    assert (long["size"], long["text_crc32"]) == (200_001, zlib.crc32(b"x" * 200_000))


def license_brute(text, templates, threshold):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    w = words(text)
    places = [(label, i) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = {}
    for label, t, *others in templates:
        needs, against = [set(x) for x in others] or (set(), set())
        size, t = math.ceil(len(t.split()) / threshold - 1e-9), set(t.split())
        for i in range(len(w)):
            own = set(w[i : i + size])
            held = len(t & own) / len(t)
            if w[i] in t and held >= threshold - 1e-12 and needs <= own and not against & own:
                found[label] = max(found.get(label, 0), held)
    return len(w), sorted(places), found


def test_license_brute(spark, odd_docs, no_docs):
    filler = " ".join(f"f{i}" for i in range(70))
    extra = [
        (20, f"{filler} licensed under the apache license version 2 0 {filler}"),
        (21, "CC-BY, cc\nby; ALL RIGHTS reserved all rights reserved"),
        (22, "general public\nlicense under the gnu work this is licensed version"),
        (23, "released under the mit"),
        (24, "ccby cc by-nc 4.0 licensed under"),
        (25, f"{filler} this work is licensed under a creative {filler} commons attribution 4 0 international license"),
        (26, "The MIT license: released under a, released under the mit"),
    ]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    for threshold in (0.8, 0.5):
        out = licenses.scan(docs, threshold=threshold).collect()
        assert len(out) == docs.count()
        want = sorted(repr((d["doc_id"], *license_brute(d["text"], licenses.TEMPLATES, threshold))) for d in docs.collect())
        mine = [(r["doc_id"], r["n_words"], sorted((p["label"], p["at"]) for p in r["places"]), {f["label"]: f["held"] for f in r["found"]}) for r in out]
        assert sorted(repr((a, b, c, dict(sorted(d.items())))) for a, b, c, d in mine) == sorted(repr((a, b, c, dict(sorted(d.items())))) for a, b, c, d in [eval(x) for x in want])
        assert all(0 <= r["score"] <= 1 for r in out)
    assert licenses.scan(no_docs).count() == 0


def test_license_notices_wrapped_over_lines(spark, tmp_path):
    filler = [f"f{i}" for i in range(61)]
    rows, want = [], {}
    for label, notice, *_ in licenses.TEMPLATES:
        for width in (3, 7):
            words = filler + notice.split() + filler
            lines = [" ".join(words[a : a + width]) for a in range(0, len(words), width)]
            want[len(rows)] = label
            rows.append((len(rows), "\n".join(lines)))
    rows.append((len(rows), "\n".join(filler)))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in QUERIES["op10_license_scan"](spark, str(tmp_path)).collect()}
    assert all(label in out[i]["labels"].split(",") and out[i]["score"] == 1 for i, label in want.items())
    assert (out[len(want)]["labels"], out[len(want)]["score"]) == ("", 0)


def test_labels_that_the_text_contradicts(spark):
    texts = {
        "licensed under CC BY-SA 4.0": {"cc-by-sa-4.0"},
        "licensed under CC BY-NC 4.0": {"cc-by-nc-4.0"},
        "licensed under CC BY-NC-SA 4.0": set(),
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": set(),
        "This work is licensed under a Creative Commons Attribution 4.0 International License": {"cc-by-4.0"},
        "licensed under the gnu license version 2 0": set(),
        "licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "released today under the terms of a license": set(),
        "released under the MIT license": {"mit"},
        "all rights given; the seats were reserved. copyright": set(),
        "Copyright 2020. All rights reserved": {"reserved-notice"},
        "this work is licensed under the GNU Lesser General Public License version 3": set(),
        "this work is licensed under the GNU General Public License version 2": set(),
        "this source code form is subject to the terms of the Mozilla Public License, v. 1.1": set(),
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: {f["label"] for f in r["found"]} for r in licenses.scan(rows).collect()}
    assert found == dict(enumerate(texts.values()))


def test_groups_of_templates_find_the_same(spark, monkeypatch):
    texts = [" ".join(["x"] * i + t.text.split() + ["y"] * 9) for i, t in enumerate(licenses.TEMPLATES)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(map(repr, licenses.scan(rows).collect()))
    monkeypatch.setattr(licenses, "MAX_GROUP_WORDS", 60)
    assert len(licenses.groups_of(licenses.TEMPLATES, 60)) > 3
    assert sorted(map(repr, licenses.scan(rows).collect())) == want


def test_long_template_at_any_place(spark):
    long = " ".join(f"t{i}" for i in range(90))
    rows = [(n, " ".join([f"f{i}" for i in range(n)] + long.split() + ["end"] * 40)) for n in range(0, 200, 13)]
    rows.append((999, " ".join(long.split()[:60])))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=(("long", long), ("short", "a b c d e"))).collect()
    assert {r["doc_id"]: [f["held"] for f in r["found"]] for r in found} == {i: [1.0] if i != 999 else [] for i, _ in rows}


def test_shards_by_an_independent_permutation(spark, odd_docs):
    """Row numbers, permutation, shard and slot worked out again in plain Python."""
    mix = lambda *xs: functools.reduce(lambda seed, x: seed if x is None else xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed), xs, 42)
    signed = lambda h: h - 2**64 if h >= 2**63 else h

    def rounds(x, a, b, seed):
        left, right = divmod(x, b)
        for i in range(4):
            if i % 2 == 0:
                left = (left + signed(mix(seed * 1000 + i, right)) % a) % a
            else:
                right = (right + signed(mix(seed * 1000 + i, left)) % b) % b
        return left * b + right

    docs = odd_docs.select("doc_id", "text").union(spark.range(300).selectExpr("id % 250", "repeat('x', cast(id % 7 as int))"))
    rows = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        rows.append((r["doc_id"], len(raw) + 1, zlib.crc32(raw) if r["text"] is not None else 0))
    order = lambda r: (signed(mix(*r)) % 64, r[0] is not None, r[0] or 0, r[1], r[2])
    n = len(rows)
    a = math.ceil(math.sqrt(n))
    b = -(-n // a)
    want = []
    for number, row in enumerate(sorted(rows, key=order)):
        p = rounds(number, a, b, 7)
        while p >= n:
            p = rounds(p, a, b, 7)
        want.append((*row, p, p % 5, p // 5))
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["position"], r["shard"], r["slot"]) for r in sharding.shard(docs, 5, buckets=64).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_conversations(spark):
    turns = spark.range(6000).selectExpr("1 as conv_id", "id as turn", "if(id % 7 < 3, 'assistant', 'user') as role", "concat('t', id) as text")
    turns = turns.union(spark.range(900).selectExpr("2", "id", "'assistant'", "repeat('x', cast(id % 5 as int))"))
    for r in chat.read_back(chat.format_chats(turns)).collect():
        want = [t.text for t in turns.where(f"conv_id = {r['conv_id']} and role = 'assistant'").orderBy("turn").collect()]
        assert r["loss_texts"] == want and len(r["turns"]) == (6000 if r["conv_id"] == 1 else 900)


def test_chat_digests(spark, sf_dir):
    out = {r["conv_id"]: r for r in QUERIES["op1_chat_formatting"](spark, sf_dir).collect()}
    said = "".join(f"{r}\n{chat.CONTROL}\n" for r in ("user", "assistant"))
    assert out[-1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[-1]["loss_sha256"] == hashlib.sha256(chat.CONTROL.encode()).hexdigest()
