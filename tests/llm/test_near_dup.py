import random

import numpy as np
import pytest

from kotoflow.llm import near_dup as nd


def brute(docs, k, num, den):
    sets = [nd.shingle_set(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both)
            if linked or docs[i][0] == docs[j][0]:
                up[find(i)] = find(j)
    low = {}
    for i, (name, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), name), name)
    return sorted((name, len(sets[i]), low[find(i)], low[find(i)] == name) for i, (name, _) in enumerate(docs))


def run(spark, docs, **kw):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, rep int, node string")
    return sorted(tuple(r) for r in nd.components(df, **kw).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(n):
        if i > 10 and rng.random() < 0.5:
            w = docs[rng.randrange(len(docs))][1].split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([2, 30, 80, 200]))]
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("small_leaf", [False, True])
def test_against_brute_force(spark, small_leaf, monkeypatch):
    if small_leaf:  # nodes branch down to parts
        monkeypatch.setattr(nd, "LEAF", 8)
        monkeypatch.setattr(nd, "MAX_DEPTH", 3)
    docs = corpus(3, 150) + [(500, None), (501, ""), (502, " \n "), (503, "One two"), (504, "one TWO"), (7, "w1 w2 w3 w4"), (505, "É x y " * 3000)]
    assert run(spark, docs, shingle=3, num=85, den=100) == brute(docs, 3, 85, 100)


def alike(n, seed=5):
    """Texts that share most shingles, about 0.67 alike, and every fourth a copy at 0.8 or more of the one before."""
    rng, docs = random.Random(seed), []
    shared = ["s%d" % i for i in range(400)]
    for i in range(n):
        own = ["d%d_%d" % (i, k) for k in range(100)]
        if i % 4 == 3:
            own = docs[-1][1].split()[400:]
            own[:55] = ["e%d_%d" % (i, k) for k in range(55)]
        docs.append((i, " ".join(shared + own)))
    rng.shuffle(docs)
    return docs


def test_links_of_large_nodes_are_kept(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF", 8)
    docs = alike(200)
    want = brute(docs, 1, 4, 5)
    assert sum(not r[3] for r in want) == 50
    assert run(spark, docs, shingle=1, num=4, den=5) == want


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAF", 8)
    rows = [(1, i, 0 if i < 30 else i, 0, 30, 53) for i in range(53)]
    got = {}
    for r in nd._blocks(spark.createDataFrame(rows, "node long, rep long, comp long, main long, m long, n long")).collect():
        got.setdefault(r["node"], []).append((r["rep"], r["side"]))
    met = {tuple(sorted((a, b))) for x in got.values() for a, s in x for b, t in x if a != b and (s == t == -1 or s + t == 1)}
    assert met == {(a, b) for a in range(53) for b in range(max(a + 1, 30), 53)}


def test_recall_of_whole_trees():
    assert nd.tree_miss(0.8) ** (nd.TREES - nd.FIRST_TREES) < 1e-4
    assert nd.tree_miss(0.85) ** (nd.TREES - nd.FIRST_TREES) < 1e-5


def test_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 100)
    size = np.array([60, 60, 10, 300, 20, 5])
    met = set()
    for some, side in nd.block_pairs(size):
        met |= {tuple(sorted((a, b))) for a, s in zip(some.tolist(), side) for b, t in zip(some.tolist(), side) if a != b and (s == t == -1 or s + t == 1)}
    assert met == {(a, b) for a in range(6) for b in range(a + 1, 6)}
    docs = corpus(4, 80)
    assert run(spark, docs, shingle=3, num=85, den=100) == brute(docs, 3, 85, 100)


def test_rows_that_share_an_id_and_clashing_names(spark):
    base = [" ".join(f"{c}{k}" for k in range(30)) for c in "ab"]
    rows = [(5, base[0]), (5, base[1]), (9, base[0] + " x"), (3, base[1] + " y")]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, gone int, twice int, nth int")
    assert {(r["doc_id"], r["component_id"]) for r in nd.components(df).collect()} == {(5, 3), (9, 3), (3, 3)}
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(3, base[1] + " y", 1, 2, 3)]


def test_null_id_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "a b c")], "doc_id long, text string")
    rows = {tuple(r) for r in nd.components(df).collect()}
    assert rows == {(None, 1, None, True), (4, 1, 2, False), (2, 1, 2, True)}
    assert nd.components(df.limit(0)).count() == 0


def test_minwise_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 1000, dtype=np.int64).astype(np.uint64))
    other = np.concatenate((base[:850], np.unique(rng.integers(0, 2**63, 150, dtype=np.int64).astype(np.uint64))))
    a, b = nd.signatures([base, np.unique(other)])
    assert abs((a == b).mean() - 850 / 1150) < 0.15
    assert nd.agreement_cut(0.85) < 128 * 0.8
