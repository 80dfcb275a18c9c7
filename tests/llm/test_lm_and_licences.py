import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kotoflow.llm import licences, lm_scoring


@pytest.mark.parametrize("small", [False, True])
def test_lm_against_definition(spark, tmp_path, monkeypatch, small):
    from kotoflow.llm.queries import op5_lm_scoring
    from kotoflow.llm.tokens import encoder

    if small:  # several blocks and shards in each task, sums in several steps
        monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 30)
        monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 20)
        monkeypatch.setattr(lm_scoring, "COMPACT", 10)
        monkeypatch.setattr(lm_scoring, "SCORE_TOKENS", 12)
        monkeypatch.setattr("kotoflow.llm.tokens.SLICE_BYTES", 60)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "é", "x1", f"own{i}"]) for _ in range(rng.randrange(0, 30)))) for i in range(30)] + [(50, None), (51, ""), (None, "ab, cd"), (7, "ab cd"), (7, "ab cd"), (60, "日本")]
    good = {1, 4, 7, 50, 20}
    spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "doc_id long, text string, block int, score double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in good] + [(2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    vocabulary = encoder().vocab_size
    seqs = [(i, np.frombuffer(encoder().encode(t), "<u4").tolist()) for i, t in rows]

    def loss(k, chosen):
        """By definition: counts of all chosen rows but row k."""
        every, one, two = set(), Counter(), {}
        for j, (i, s) in enumerate(seqs):
            if chosen(i):
                every |= set(s)
                if j != k:
                    one.update(s)
                    for h, w in zip([None, *s], s):
                        two.setdefault(h, Counter())[w] += 1

        def p(h, w):
            low = (one[w] + len(every) / vocabulary) / (one.total() + len(every)) if every else 1 / vocabulary
            f = two.get(h)
            return (f[w] + len(f) * low) / (f.total() + len(f)) if f else low

        s = seqs[k][1]
        return sum(-math.log(p(h, w)) for h, w in zip([None, *s], s)) / len(s) if s else None

    want = [(i, len(s), loss(k, lambda i: i in good), loss(k, lambda i: True)) for k, (i, s) in enumerate(seqs)]
    got = [tuple(r) for r in op5_lm_scoring(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        if w[2] is None:
            assert g[2:] == (None, None, None)
        else:
            assert g[2:] == pytest.approx((w[2], w[3], w[2] - w[3]), abs=1e-9)
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_lm_knows_text_that_occurs_twice(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[:6]]
    got = {r["doc_id"]: r["loss_background"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    twice = [got[i] for i in range(6)] + [got[100 + i] for i in range(6)]
    assert max(twice) < 0.7 * min(got[i] for i in range(6, 60))


def test_lm_ranks_target_like_text(spark):
    rows = [(i, "the cat sat on the mat " * 3, True) for i in range(20)] + [(100 + i, "zq xv wk jj qq zz " * 3, False) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean")
    got = lm_scoring.score(df, F.col("good")).collect()
    assert max(r["score"] for r in got if r["doc_id"] < 100) < min(r["score"] for r in got if r["doc_id"] >= 100)


ROWS = [
    (1, "Some text here.\nReleased under the MIT License.", "a/b/x.py"),
    (2, "nothing", "a/b/c/d/y.py"),
    (3, "Licensed under the Apache License, Version 2.0.", "a/LICENSE"),
    (4, "Licensed under CC BY-NC 4.0.\n" + "word " * 50, "z/q.txt"),
    (5, "plain words only", "z/r.txt"),
    (6, None, None),
    (7, "", "a//k"),
    (8, "This work is licensed under the GNU General Public License, version 3.", "a/b/c/COPYING"),
    (9, "license to think about the mit of things, released", "q/w"),
    (2, "nothing", "a/b/c/d/y.py"),
    (10, "nothing " * 30000, "a/b/z"),
]


def test_scan(spark):
    df = spark.createDataFrame([r + ("k",) for r in ROWS], "doc_id long, text string, path string, licence string")
    got = sorted((r["doc_id"], r["licence"], r["found_by"], r["licence_dir"]) for r in licences.scan(df, F.col("path")).collect())
    assert got == [
        (1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b/c"), (2, "GPL-3.0", "inherited", "a/b/c"), (3, "Apache-2.0", "own", None), (4, "CC-BY-NC-4.0", "own", None),
        (5, None, None, None), (6, None, None, None), (7, "Apache-2.0", "inherited", "a"), (8, "GPL-3.0", "own", None), (9, None, None, None), (10, "Apache-2.0", "inherited", "a"),
    ]
    assert licences.scan(df.limit(0), F.col("path")).count() == 0


def test_gate_loses_nothing():
    """Brute force: every line against every template without the gate."""
    rng = random.Random(0)
    m = licences.matcher(licences.THRESHOLD)
    vocab = sorted({t for _, x in licences.TEMPLATES for t in licences.terms(x)}) + ["foo", "bar", "the"]
    vectors = []
    for _, x in licences.TEMPLATES:
        w = {t: c * m.idf[t] for t, c in licences.terms(x).items()}
        n = math.sqrt(sum(v * v for v in w.values()))
        vectors.append({t: v / n for t, v in w.items()})
    for k in range(1500):
        words = licences.TEMPLATES[k % len(licences.TEMPLATES)][1].split() if k % 2 else []
        rng.shuffle(words)
        line = " ".join(words[: rng.randrange(0, 12)] + [rng.choice(vocab) for _ in range(rng.randrange(0, 5))])
        bag = {t: c * m.idf.get(t, m.unseen) for t, c in licences.terms(line).items()}
        norm = math.sqrt(sum(v * v for v in bag.values())) or 1
        best = max(sum(v * u.get(t, 0) for t, v in bag.items()) / norm for u in vectors)
        got = m.match(line)
        if abs(best - licences.THRESHOLD) > 1e-9:
            assert (got is not None) == (best >= licences.THRESHOLD), line
            assert got is None or got[0] == pytest.approx(best)


def wrapped(text, width, mark):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_wrapped_headers_and_whole_files(spark):
    whole = {n: t for n, t in licences.TEMPLATES if len(t) > 600}
    header = next(t for n, t in licences.TEMPLATES if n == "GPL-2.0-or-later")
    rows = [(1, "int x;\n\n" + wrapped(header + ".", 60, " * ") + "\n *\n * You should have received a copy.\n\n" + "call me later\n" * 40, "src/a.c")]
    rows += [(10 + i, f"Copyright (c) 2020 Some Body\n\n{wrapped(t, 76, '')}\n", f"lib{i}/terms.txt") for i, t in enumerate(whole.values())]
    rows += [(30 + i, "no notice", f"lib{i}/deep/er/x.py") for i in range(len(whole))]
    got = {r["doc_id"]: (r["licence"], r["found_by"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, path string"), F.col("path")).collect()}
    assert got[1] == ("GPL-2.0-or-later", "own")
    for i, name in enumerate(whole):
        assert got[10 + i] == (name, "own") and got[30 + i] == (name, "inherited")
