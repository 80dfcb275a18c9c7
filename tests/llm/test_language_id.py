import random

import numpy as np

from kotoflow.llm import language_id as li

SYL = {"en": "the ing and tion er th", "de": "der sch ein ung ich keit", "fr": "le que eau oir é tion", "es": "el ción que os ar ñ", "xx": "qz wx kk vv zz yy"}


def docs(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYL))
        s = SYL[lang].split()
        out.append((i, " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = docs(600) + [(9000, None, "en"), (9001, "12 !", "fr"), (9002, "", None), (None, "the and the", None), (9003, "the ing " * 20000, None)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, lang string, score string")
    model = li.fit(df, per_language=60)
    assert set(model.families) == {"germanic", "romance", "xx"}
    got = li.identify(df.withColumn("held", li.held_out("doc_id")), model).collect()
    test = [r for r in got if r["held"] and r["lang"] and r["doc_id"] < 9000]
    assert len(test) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in test]) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] is None or r["doc_id"] >= 9000}
    assert odd[9000] == odd[9001] == odd[9002] == ("und", 0.0)
    assert odd[9003][0] == "en" and odd[None][0] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    # labels of held-out rows and other columns teach nothing
    import pyspark.sql.functions as F

    other = li.fit(df.withColumn("lang", F.when(li.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang"))), per_language=60)
    assert other.families == model.families and np.array_equal(other.family_w, model.family_w)


def test_texts_in_no_learned_language_go(spark):
    rows = [r for r in docs(900) if r[2] != "xx"]
    odd = ["日本語の文章です。これは学習した言語ではない。", "Это предложение написано на русском языке", "to jest zdanie po polsku", "bpmz jplsg jydtz wrzt vkjj zzqj " * 9]
    df = spark.createDataFrame(rows + [(9000 + k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string")
    model = li.fit(df)
    kept = {r["doc_id"] for r in li.keep_known(df, model, 0.2).collect()}
    assert not any(9000 + k in kept for k in range(len(odd)))
    assert len(kept) > 0.98 * len(rows)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[3:] for r in li.identify(df, li.fit(df)).collect()] == [("und", 0.0)]
    assert li.identify(df.limit(0), li.fit(df.limit(0))).count() == 0


def test_dirty_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 2)
    rows = [(i, "the cat sat on the mat" if i % 2 else "le chat est sur la table", "en" if i % 2 else "fr") for i in range(60)] + [(100 + i, "x y z", f"dirt{i}") for i in range(30)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(x for own in model.languages.values() for x in own) == ["en", "fr"]
