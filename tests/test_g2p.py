from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kotoflow.plans.g2p import AnalysisError, G2P, Engine
from kotoflow.plans.options import Options
from kotoflow.sources import lexicon as lex


def make(**kw):
    return Engine(Options(**kw), (lex.DEFAULT_LEXICON,), "", None)


E = make()


def kana(text, e=E):
    return "".join(t["string"] if t["pos"] == "記号" else t["pron"].replace("’", "") for t in e.njd(text))


@pytest.mark.parametrize("text,want", [("こんにちは", "k o N n i ch i w a"), ("ななみんです", "n a n a m i N d e s U"), ("復帰", "f u cl k i"), ("10000", "i ch i m a N"), ("100000000", "i ch i o k u"), ("行こう", "i k o o"), ("ハローユーチューブ", "h a r o o y u u ch u u b u")])
def test_phonemes(text, want):
    assert " ".join(E.phonemes(text)) == want


@pytest.mark.parametrize("text,want", [("今日もこんにちは", "キョーモコンニチワ"), ("さゝみ", "ササミ"), ("カヽ", "カカ"), ("がゝ", "ガカ"), ("かゞ", "カガ"), ("じょゝ", "ジョジョ"), ("これは何ですか？何の情報？", "コレワナンデスカ？ナンノジョーホー？"), ("何を言っても何の問題もありません。", "ナニヲイッテモナンノモンダイモアリマセン。"), ("学生々活", "ガクセーセーカツ")])
def test_kana(text, want):
    assert kana(text) == want


def mapped(text, **kw):
    return [(x["word"], x["phonemes"]) for x in make(**kw).mapping(text)]


def test_mappings():
    assert mapped("𰻞𰻞麺") == [("𰻞𰻞", ["unk"]), ("麺", ["m", "e", "N"])]
    assert mapped("「あ」") == [("「", []), ("あ", ["a"]), ("」", [])]
    assert mapped("「あ", non_pause_symbols=frozenset()) == [("「", ["pau"]), ("あ", ["a"])]
    assert mapped("なる　長老ー　ー　に") == [("なる", ["n", "a", "r", "u"]), ("　", ["sp"]), ("長老ーー", "ch o o r o o o o".split()), ("　", ["sp"]), ("　", ["sp"]), ("に", ["n", "i"])]
    assert mapped("あー　ー　ー") == [("あーーー", ["a"] * 4), ("　", ["sp"]), ("　", ["sp"])]
    assert mapped("𰻞　ー") == [("𰻞", ["unk"]), ("　", ["sp"]), ("ー", ["unk"])]
    assert mapped("　あーー　") == [("　", ["sp"]), ("あーー", ["a"] * 3), ("　", ["sp"])]
    got = make().mapping("7xyz")
    assert got[0]["word"] == "七" and got[-1] == {"word": "ｘｙｚ", "phonemes": ["unk"], "is_unknown": True, "is_ignored": False}
    assert mapped("叙々々") == [("叙", ["j", "o"]), ("々々", ["j", "o", "j", "o"])]
    assert mapped("様々々") == [("様々", "s a m a z a m a".split()), ("々", "z a m a".split())]


def test_detailed():
    d = make().mapping_detailed("ｘｙｚ大阪")
    assert d[0]["is_unknown"] and len(d[0]["features"]) == 8 and d[1]["phonemes"] == "o o s a k a".split()


def test_chain_flags():
    flags = {t["string"]: t["chain_flag"] for t in E.njd("東京都知事が記者会見を行った。")}
    assert flags["東京"] in (-1, 0) and flags["都知事"] == 1 and flags["が"] == 1 and flags["記者"] == 0


def test_reverted_readings_by_result():
    """Reverting comes before the rewrites in every result but the flat mapping."""
    e = make(revert_long_vowels=True)
    assert kana("学生々活", e) == "ガクセイセーカツ"
    assert "".join(p for x in e.mapping("学生々活")[1:] for p in x["phonemes"]) == "seikatsu"


@pytest.mark.parametrize("text", ["東京、大阪", "何を言っても何の問題もありません。", "ななみんです", "助けられた。はい"])
def test_labels_agree_with_mapping(text):
    labels = E.fullcontext(text)
    from_labels = [x.split("-")[1].split("+")[0] for x in labels[1:-1]]
    flat = [p for x in E.mapping(text) for p in x["phonemes"] if p not in ("pau", "sp", "unk")]
    assert [p for p in from_labels if p != "pau"] == flat
    assert [p for p in E.phonemes(text) if p != "pau"] == flat and labels[0].split("-")[1].startswith("sil")


def test_errors():
    with pytest.raises(AnalysisError, match="byte 6"):
        E.phonemes("こん\0にちは")
    with pytest.raises(AnalysisError):
        E.phonemes("あ" * 10000)
    assert E.phonemes("") == [] and E.fullcontext("") == []
    assert len(make(split_sentences=True).phonemes("あ。" * 10000)) > 1000


def test_user_lexicon(tmp_path):
    p = tmp_path / "user.csv"
    p.write_text("ＧＮＵ,,,1,名詞,一般,*,*,*,*,ＧＮＵ,グヌー,グヌー,2/3,*\n", encoding="utf-8")
    e = Engine(Options(), (lex.DEFAULT_LEXICON, str(p)), lex.version((lex.DEFAULT_LEXICON, str(p))), None)
    assert " ".join(e.phonemes("GNU")) == "g u n u u" != " ".join(E.phonemes("GNU"))


def test_columns(spark):
    df = spark.createDataFrame([(1, "こんにちは"), (2, None), (3, ""), (4, "a\0b"), (5, "東京　大阪")], "id int, text string")
    g = G2P()
    got = {r["id"]: r for r in df.select("id", g.phonemes("text").alias("p"), g.kana("text").alias("k"), g.mapping("text").alias("m"), g.phonemes_detailed("text").alias("d"), g.mecab("text").alias("f")).collect()}
    assert got[1]["p"] == "k o N n i ch i w a".split() and got[1]["k"] == "コンニチワ"
    assert got[2]["p"] is None and got[3]["p"] == [] and got[4]["p"] is None
    assert "sp" in got[5]["d"] and [x["is_ignored"] for x in got[5]["f"]] == [False, True, False]
    with pytest.raises(Exception, match="NUL"):
        df.select(G2P(Options(mode="FAILFAST")).phonemes("text")).collect()
    g.register(spark)
    df.createOrReplaceTempView("texts")
    assert spark.sql("select g2p(text) p from texts where id = 1").head()["p"] == got[1]["p"]


STRESS = "つまみ出されようとしたが、「「八十五歳」」にもなる 長老ー ー に助けられた。わーいです。そこで、𰻞𰻞麺とお冷を飲み食いしたです。ーっ、 𰻞ー𰻞。あ、はい。あーーーーーーーーあ叙々々々々々々苑々々様々々"
STRESS_WANT = """つまみ出さ ts u m a m i d a s a|れよう r e y o o|と t o|し sh I|た t a|が g a|、 pau|「|「|八 h a ch i|十 j u u|五 g o|歳 s a i|」|」|に n i|も m o|なる n a r u|SP sp|長老ーー ch o o r o o o o|SP sp|SP sp|に n i|
助け t a s U k e|られ r a r e|た t a|。 pau|わーい w a a i|です d e s U|。 pau|そこで s o k o d e|、 pau|𰻞𰻞 unk|麺 m e N|と t o|お冷 o h i y a|を o|飲み n o m i|食い g u i|し sh I|た t a|です d e s U|。 pau|ー unk|っ cl|、 pau|SP sp|
𰻞 unk|ー unk|𰻞 unk|。 pau|あ a|、 pau|はい h a i|。 pau|あーーーーーーーー a a a a a a a a a|あ a|叙 j o|々々々々々々 j o j o j o j o j o j o|苑 e N|々々 e N e N|様々 s a m a z a m a|々 z a m a"""


def test_stress_text():
    words = str(Path(__file__).parent / "data" / "stress_words.csv")
    e = Engine(Options(), (lex.DEFAULT_LEXICON, words), "", None)
    want = [(x.split()[0].replace("SP", "　"), x.split()[1:]) for x in STRESS_WANT.replace("\n", "").split("|")]
    assert [(x["word"], x["phonemes"]) for x in e.mapping(STRESS)] == want
    for text in (STRESS, "学生々活7xyz大阪", "abc123def。10000", "　あ　々"):
        for x in e.mapping(text):
            assert not x["is_unknown"] or x["phonemes"] == ["unk"] or x["phonemes"] not in ([], ["pau"])


@pytest.mark.parametrize("detailed", [False, True])
def test_mapping_after_iteration_marks_and_numbers(detailed):
    got = {x["word"]: x for x in getattr(E, "mapping_detailed" if detailed else "mapping")("学生々活7xyz大阪")}
    assert got["ｘｙｚ"]["is_unknown"] and not got["大阪"]["is_unknown"] and not got["生活"]["is_unknown"]
    assert got["大阪"]["phonemes"] == "o o s a k a".split() and got["生活"]["phonemes"] == "s e e k a ts u".split()
    if detailed:
        assert len(got["ｘｙｚ"]["features"]) == 8
    words = [x["word"] for x in E.mapping("2024ｘｙｚ10000大阪")]
    assert words[-1] == "大阪" and "ｘｙｚ" in words


def test_phonemes_per_word_are_those_of_pairs(spark):
    df = spark.createDataFrame([("𰻞　ー",), ("今日も、",)], "text string")
    got = [r[0] for r in df.select(G2P().phonemes_per_word("text")).collect()]
    assert got == [[x["phonemes"] for x in E.pairs(t)] for t in ("𰻞　ー", "今日も、")]
    assert got[0] == [["pau"], []]


def dictionary(d):
    """A dictionary directory whose connection costs decide between two paths of equal word costs."""
    d.mkdir()
    (d / "words.csv").write_text("東,1,1,100,名詞,一般,*,*,*,*,東,ヒガシ,ヒガシ,0/3,C1\n京都,1,1,100,名詞,一般,*,*,*,*,京都,キョウト,キョート,1/3,C1\n東京,2,2,100,名詞,固有名詞,*,*,*,*,東京,トウキョウ,トーキョー,0/4,C1\n都,,,100,名詞,接尾,*,*,*,*,都,ト,ト,1/1,C1\n", encoding="utf-8")
    (d / "char.def").write_text("# categories\nDEFAULT 0 1 0\nSPACE 0 1 0\nKANJI 0 0 2\nNUM 1 1 0\n0x3000 SPACE\n0x4E00..0x9FA5 KANJI\n0x4E00 NUM KANJI # one\n0x4E8C NUM KANJI\n", encoding="utf-8")
    (d / "unk.def").write_text("DEFAULT,0,0,9000,記号,一般,*,*,*,*,*\nSPACE,0,0,100,記号,空白,*,*,*,*,*\nKANJI,1,1,9000,名詞,一般,*,*,*,*,*\nKANJI,2,2,9000,名詞,固有名詞,*,*,*,*,*\nNUM,1,1,500,名詞,数,*,*,*,*,*\n", encoding="utf-8")
    (d / "matrix.def").write_text("4 4\n" + "".join(f"{a} {b} {c}\n" for a, b, c in [(1, 1, 500), (2, 3, -50), (0, 1, 0), (0, 2, 0), (2, 2, 300)]), encoding="utf-8")
    (d / "pos-id.def").write_text("名詞,固有名詞,*,* 41\n名詞,*,*,* 38\n", encoding="utf-8")
    for side in ("left", "right"):
        (d / f"{side}-id.def").write_text("0 BOS/EOS,*,*,*,*,*,BOS/EOS\n1 名詞,*,*,*,*,*,*\n3 名詞,接尾,*,*,*,*,*\n", encoding="utf-8")
    return str(d)


def test_dictionary_directory(tmp_path):
    d = dictionary(tmp_path / "mini")
    e = Engine(Options(), (d,), lex.version((d,)), None)
    got = e.mecab("東京都")
    assert [(m["surface"], m["left_id"], m["pos_id"]) for m in got] == [("東京", 2, 41), ("都", 3, 38)]
    matrix = (tmp_path / "mini" / "matrix.def").read_text().replace("1 1 500", "1 1 -500")
    (tmp_path / "mini" / "matrix.def").write_text(matrix)
    e = Engine(Options(), (d,), lex.version((d,)), None)
    assert [m["surface"] for m in e.mecab("東京都")] == ["東", "京都"]
    got = e.mecab("一二")
    assert [(m["surface"], m["is_unknown"], m["pos_id"]) for m in got] == [("一二", True, 38)]
    assert [(m["surface"], m["is_unknown"]) for m in e.mecab("東☆☆")] == [("東", False), ("☆☆", True)]
    with pytest.raises(ValueError):
        lex.load((d,), "another version")
    (tmp_path / "mini" / "unk.def").write_text("KANJI,1,1,9000,名詞,一般,*,*,*,*,*\n", encoding="utf-8")
    with pytest.raises(ValueError):
        Engine(Options(), (d,), lex.version((d,)), None)


def test_compiled_lexicon_and_sent_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ＧＮＵ,,,1,名詞,一般,*,*,*,*,ＧＮＵ,グヌー,グヌー,2/3,*\n", encoding="utf-8")
    to = str(tmp_path / "compiled")
    lex.compile_lexicon(spark, to, str(tmp_path / "a.csv"))
    e = Engine(Options(), (lex.DEFAULT_LEXICON, to), "", None)
    assert " ".join(e.phonemes("GNU")) == "g u n u u"
    lex.ship(spark, str(tmp_path / "a.csv"))
    assert lex.local_path("/nowhere/a.csv") != "/nowhere/a.csv"
    with pytest.raises(FileNotFoundError):
        lex.local_path("/nowhere/b.csv")


def test_default_categories():
    got = {c: lex.category(c) for c in "、。…―→①㌔“一万歳〇あア１Ａ　"}
    assert got == {"、": "SYMBOL", "。": "SYMBOL", "…": "SYMBOL", "―": "SYMBOL", "→": "SYMBOL", "①": "SYMBOL", "㌔": "SYMBOL", "“": "SYMBOL", "一": "KANJINUMERIC", "万": "KANJINUMERIC", "歳": "KANJI", "〇": "SYMBOL", "あ": "HIRAGANA", "ア": "KATAKANA", "１": "NUMERIC", "Ａ": "ALPHA", "　": "SPACE"}


def test_results_together(spark):
    df = spark.createDataFrame([(1, "学生々活7xyz大阪"), (2, None), (3, "a\0b"), (4, "")], "id int, text string")
    g = G2P()
    one = df.select("id", g.together("text", "phonemes", "mapping", "njd").alias("r")).select("id", "r.*").orderBy("id").collect()
    apart = df.select("id", g.phonemes("text").alias("phonemes"), g.mapping("text").alias("mapping"), g.njd("text").alias("njd")).orderBy("id").collect()
    assert one == apart and one[0]["phonemes"] and one[1]["njd"] is None


def test_symbol_callback(spark):
    assert mapped("あ、い。", is_non_pause=lambda s: True) == [("あ", ["a"]), ("、", []), ("い", ["i"]), ("。", [])]
    assert mapped("「あ」", is_non_pause=lambda s: s != "「") == [("「", ["pau"]), ("あ", ["a"]), ("」", [])]
    df = spark.createDataFrame([("あ、い",)], "text string")
    got = df.select(G2P(Options(is_non_pause=lambda s: True)).mapping("text").alias("m")).head()["m"]
    assert [list(x["phonemes"]) for x in got] == [["a"], [], ["i"]]
