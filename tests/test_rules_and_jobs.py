import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kotoflow.functions import formats, kana
from kotoflow.operators import evaluation as ev
from kotoflow.operators import postprocess, token_rules as tr
from kotoflow.operators.lattice import candidates, segment
from kotoflow.operators.njd import Token
from kotoflow.sources import corpora, lexicon as lex

KATA = "アウキャーンッシ’"


def random_tokens(seed, n=150):
    rng = random.Random(seed)
    docs = []
    for d in range(n):
        docs.append(
            [
                Token("".join(rng.choice("あ何風") for _ in range(rng.randrange(1, 3))), rng.choice(["フィラー", "名詞", "動詞", "記号"]), ctype=rng.choice(["*", "特殊・マス", "特殊・ナイ"]), cform=rng.choice(["*", "未然形"]), orig=rng.choice(["れる", "風", "する"]), read="アヅ",
                      pron="".join(rng.choice(KATA) for _ in range(rng.randrange(0, 4))), acc=rng.randrange(-1, 5), mora_size=rng.randrange(0, 4), chain_flag=rng.choice([-1, 0, 1, 1]))
                for _ in range(rng.randrange(1, 9))
            ]
        )
    return docs


def table(spark, docs):
    rows = [(d, p, t.string, t.pos, t.ctype, t.cform, t.orig, t.read, t.pron, t.acc, t.mora_size, t.chain_flag) for d, ts in enumerate(docs) for p, t in enumerate(ts)]
    return spark.createDataFrame(rows, "doc_id int, pos int, string string, pos1 string, ctype string, cform string, orig string, read string, pron string, acc int, mora_size int, chain_flag int")


@pytest.mark.parametrize("form,fold", [(tr.accent_retreat_table, postprocess.retreat_accent), (tr.accent_chain_table, postprocess.accent_after_chaining), (tr.filler_accent_table, postprocess.filler_accent)])
def test_window_form_equals_fold(spark, form, fold):
    docs = random_tokens(7)
    got = {(r["doc_id"], r["pos"]): (r["acc"], r["chain_flag"]) for r in form(table(spark, docs)).collect()}
    for ts in docs:
        fold(ts)
    assert got == {(d, p): (t.acc, t.chain_flag) for d, ts in enumerate(docs) for p, t in enumerate(ts)}


def test_nested_forms_equal_folds(spark):
    docs = random_tokens(8, 60)
    t = table(spark, docs)
    nested = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), F.struct("string", F.col("pos1").alias("pos"), "orig", "read", "pron", "acc", "mora_size", "chain_flag").alias("t")))).alias("x")).select("doc_id", F.transform("x", lambda x: x["t"]).alias("t"))
    got = {r["doc_id"]: r for r in nested.select("doc_id", tr.filler_accent_nested(F.col("t")).alias("f"), tr.revert_pron_nested(F.col("t"), long_vowels=True).alias("r"), tr.kana(F.col("t")).alias("k")).collect()}
    for d, ts in enumerate(docs):
        assert got[d]["k"] == "".join(t.string if t.pos == "記号" else t.pron.replace("’", "") for t in ts)
        postprocess.filler_accent(ts)
        assert [(x["acc"], x["chain_flag"]) for x in got[d]["f"]] == [(t.acc, t.chain_flag) for t in ts]
        postprocess.revert_pron(ts, False, True, False)
        assert [x["pron"] for x in got[d]["r"]] == [t.pron for t in ts]


def test_accent_after_chaining_golden():
    a, b = Token("参り", "動詞", acc=1, mora_size=3, chain_flag=-1), Token("ます", "助動詞", ctype="特殊・マス", cform="基本形", acc=1, mora_size=2, chain_flag=1)
    postprocess.accent_after_chaining([a, b])
    assert a.acc == 4


def test_scalars(spark):
    cases = [("あいうえお", "アイウエオ"), ("ちゃちゅちょ", "チャチュチョ"), ("ゖ", "ヶ"), ("ゔゐゑ", "ヴヰヱ"), ("あ漢123!ー A", "ア漢123!ー A"), ("ゝゞ", "ヽヾ")]
    df = spark.createDataFrame(cases, "h string, k string")
    for r in df.select("h", "k", kana.hira_to_kata(F.col("h")).alias("a"), kana.kata_to_hira(F.col("k")).alias("b"), kana.split_mora(F.col("k")).alias("m")).collect():
        assert r["a"] == r["k"] == kana.py_hira_to_kata(r["h"]) and r["b"] == kana.py_kata_to_hira(r["k"]) and r["m"] == kana.py_split_mora(r["k"])
    nfc = spark.createDataFrame([("が",), ("é",), (None,)], "t string").select(kana.normalize_unicode(F.col("t"), "NFC").alias("t")).collect()
    assert [r["t"] for r in nfc] == ["が", "é", None]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="あアゝャキーン漢a", max_size=12))
def test_kana_round_trip(s):
    assert kana.py_kata_to_hira(kana.py_hira_to_kata(s)) == kana.py_kata_to_hira(s)
    assert "".join(kana.py_split_mora(s)) == s


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abN", max_size=9), st.text(alphabet="abN", max_size=9))
def test_edit_ops(a, b):
    s, d, i, ops = ev.edit_ops(a, b)
    s2, d2, i2, _ = ev.edit_ops(b, a)
    assert s + d + i == s2 + d2 + i2 and d - i == len(a) - len(b)
    assert abs(len(a) - len(b)) <= s + d + i <= max(len(a), len(b))
    assert [op for op, x, y in ops if op == "equal" and a[x] != b[y]] == []


def test_evaluation_job(spark):
    gold = spark.createDataFrame([(1, ["k", "o", "N"]), (2, ["a"]), (3, [])], "id int, e array<string>")
    got = spark.createDataFrame([(1, ["k", "O", "pau", "N", "x"]), (2, ["a"]), (3, []), (4, ["z"])], "id int, a array<string>")
    both, missing = ev.with_gold(got, gold)
    assert [r["id"] for r in missing.collect()] == [4]
    x = both.withColumn("o", ev.edit_ops_udf("e", ev.normalized_phonemes(F.col("a")))).select(F.col("o.s").alias("s"), F.col("o.d").alias("d"), F.col("o.i").alias("i"), F.size("e").alias("n"), "o.ops", F.array(F.lit(2), F.lit(2)).alias("w"))
    t = ev.corpus_totals(x).head()
    assert (t["sentences"], t["insertions"], t["tokens"], t["with_errors"]) == (3, 1, 4, 1) and t["error_rate"] == 25.0
    assert [r["f"] for r in x.select(ev.failing_words("ops", "w").alias("f")).collect() if r["f"]] == [[1]]
    assert ev.corpus_totals(x.limit(0)).head()["exact_rate"] == 0.0
    assert spark.createDataFrame([(["a", "b"], ["a", "c"])], "e array<string>, a array<string>").select(ev.token_diff("e", "a").alias("d")).head()["d"] == "a [-b] [+c]"


def test_lattice_is_cheapest():
    lexicon = lex.Lexicon()
    for s, c in [("あ", 3), ("あい", 4), ("い", 3), ("いう", 2), ("う", 3), ("あいう", 9)]:
        lexicon.add([s, "0", "0", str(c * 1000), *["名詞"] * 11])
    kinds = [("HIRAGANA",)] * 6

    def cheapest(text, at=0):
        if at == len(text):
            return 0
        return min(m.cost + cheapest(text, at + len(m.surface)) for m in candidates(text, at, kinds, lexicon))

    for text in ("あいう", "いうあい", "あいうえ", "うえあ"):
        kinds = [("HIRAGANA",)] * len(text)
        assert sum(m.cost for m in segment(text, lexicon)) == cheapest(text)


def test_formats(spark):
    x = spark.sql("select array(named_struct('word','あ','phonemes',array('a','i'),'is_unknown',false,'is_ignored',false), named_struct('word','b','phonemes',array('unk'),'is_unknown',true,'is_ignored',true)) m")
    r = x.select(formats.mapping(F.col("m")).alias("m"), formats.pairs(F.col("m")).alias("p"), formats.per_word(F.transform("m", lambda y: y["phonemes"])).alias("w"), formats.json_record(F.col("m.word")).alias("j")).head()
    assert r["m"] == "[OK]  あ\ta i\n[UNK] b\tunk" and r["p"] == "あ\ta i\nb\tunk" and r["w"] == "[a, i] [unk]" and r["j"] == '["あ","b"]'


def test_sources(spark, tmp_path):
    (tmp_path / "r.txt").write_text("A_1:これ(ruby)は,コレワ\nA_2:x(open,y\nbad line\n", encoding="utf-8")
    assert [tuple(r) for r in corpora.rohan(spark, str(tmp_path / "r.txt")).collect()] == [("A_1", "これは", "コレワ"), ("A_2", "x", "y")]
    (tmp_path / "j.yaml").write_text("B1:\n  text_level2: 水\n  kana_level2: ミズ\n  phone_level3: m-i-z-u\nB2:\n  text_level2: あ\n  phone_level3: a\n", encoding="utf-8")
    rows = corpora.jsut(spark, str(tmp_path / "j.yaml")).collect()
    assert [(r["id"], r["text"], r["phonemes"]) for r in rows] == [("B1", "水", ["m", "i", "z", "u"]), ("B2", "あ", ["a"])]
    t = lex.compile_lexicon(spark, str(tmp_path / "lex"), lex.DEFAULT_LEXICON)
    assert t.where("surface = '東京'").head()["pron"] == "トーキョー"
    with pytest.raises(ValueError, match="15"):
        (tmp_path / "bad.csv").write_text("a,b\n")
        list(lex.read_rows(str(tmp_path / "bad.csv")))


def test_streaming(spark, tmp_path):
    from kotoflow.plans.g2p import G2P
    from kotoflow.streaming import texts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("こんにちは\n\n東京\n", encoding="utf-8")
    s = texts.read_lines(spark, str(tmp_path / "in"))
    texts.write_results(s, G2P().phonemes("text"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["text"]: r["result"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["こんにちは"] == "k o N n i ch i w a".split() and got[""] == [] and len(got) == 3


def test_cli(spark, capsys):
    from kotoflow import cli

    assert cli.main(["g2p", "こんにちは"]) == 0
    assert capsys.readouterr().out.strip().endswith("k o N n i ch i w a")
    cli.main(["kana", "今日", "--json"])
    assert '"キョー"' in capsys.readouterr().out
    cli.main(["mapping", "「あ"])
    assert "[IGN] 「\t" in capsys.readouterr().out


def test_command_line_reads_input_in_chunks(spark, monkeypatch, capsys, tmp_path):
    from kotoflow import cli

    monkeypatch.setattr(cli, "CHUNK_LINES", 2)
    assert list(cli.chunks(["a\n", "b", "c\n"])) == [["a", "b"], ["c"]]
    monkeypatch.setattr("sys.stdin", iter(["こんにちは\n", "復帰\n", "今日も\n"]))
    assert cli.main(["g2p"]) == 0
    assert capsys.readouterr().out.splitlines()[:2] == ["k o N n i ch i w a", "f u cl k i"]
    monkeypatch.setattr("sys.stdin", iter(["こんにちは\n", "復帰\n", "今日も\n"]))
    cli.main(["kana", "--output", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() == 3
