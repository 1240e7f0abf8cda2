"""Matches of incoming postings by aggregates, against all pairs."""

import random

from millrace.operators import workflow as W

COLUMNS = "id bigint, company string, identity string, title_key string, is_shell boolean"


def _same(n, o):
    if n[1] is None or n[1] != o[1]:
        return False
    titled = bool(n[3]) and n[3] == o[3]
    if n[2] and o[2]:
        return n[2] == o[2] and (titled or bool(n[4]) or bool(o[4]))
    return n[2] is not None and o[2] is not None and titled


def test_matches_are_those_of_all_pairs(spark):
    dice = random.Random(7)
    row = lambda i: (i, dice.choice(["a", "b", None]), dice.choice(["", "u", "v"]), dice.choice(["", "t", "s", "r"]), dice.choice([True, False, False, None]))
    old, new = [row(i) for i in range(0, 60, 2)], [row(i) for i in range(1, 121, 2)]
    want = {n[0]: min(o[0] for o in old if _same(n, o)) for n in new if any(_same(n, o) for o in old)}
    got = {r["new_id"]: r["old_id"] for r in W.match_for_upsert(spark.createDataFrame(old, COLUMNS), spark.createDataFrame(new, COLUMNS)).collect()}
    assert got == want and want


def test_one_key_for_all_rows_makes_no_pairs(spark):
    rows = spark.range(60000).selectExpr("id", "'c' as company", "'u' as identity", "'t' as title_key", "false as is_shell")
    got = W.match_for_upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    assert got.where("old_id = 0").count() == 30000
