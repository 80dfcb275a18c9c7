import random

import pytest

from kotoflow.llm import decontaminate as d


def run(spark, docs, items, **kw):
    a = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    rows = d.contamination(a, b, **kw).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("pass_words", [2_000_000, 12])
def test_against_brute_force(spark, pass_words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "cé", "d9", "e-f"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 14])) if k else "qq", 1) for k in range(6)] + [(7, None, 1), (8, "...", 1)]
    docs = [(k, text(rng.randrange(0, 80)), "x") for k in range(30)] + [(99, None, "x"), (100, "!", "x"), (5, "zz zz", "x"), (5, "zz zz", "x")]
    docs += [(200, "x " + items[3][1].upper() + " y", None)]
    want = []
    for name, t, _ in docs:
        n, h, k, digest = d.brute_force(t, [(i, x) for i, x, _ in items])
        want.append((name, n, h, k, digest, h > 0))
    want.sort(key=lambda r: (r[0], r[1]))
    assert run(spark, docs, items, pass_words=pass_words) == want


def test_empty(spark):
    assert run(spark, [], [(1, "a", 1)]) == []
    assert [r[1:4] for r in run(spark, [(1, "a b", "")], [])] == [(2, 0, 0)]


def test_jumps():
    words = [b"w%d" % k for k in range(10)]
    m = d.WuManber(10, {tuple(words): [1]})
    assert m.jump == 9
    assert list(m.search([b"x"] * 50 + words + [b"x"] * 7)) == [(50, [1])]
