"""More queries with their SQL: character classes, evaluation, output modes, pair rules and golden texts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from kotoflow.functions import formats, kana, unidic
from kotoflow.operators import evaluation as ev
from kotoflow.operators import njd
from kotoflow.operators.njd import Token
from kotoflow.session import spread

LATIN = "abcdefghijklmnopqrstuvwxyz"
#: Letters as kanji, iteration marks, brackets and kana, so that every character class occurs.
AS_MIXED = "風々「観ゝヽ漢」アゞヾ（カ）上ッ々ン何ー【君】ャゝ手"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"))


def _mixed(c):
    return F.translate(F.lower(c), LATIN, AS_MIXED)


def symbol_classes(spark, d):
    """Every character with its classes: pause-free symbol, kanji, iteration marks."""
    c = _docs(spark, d).select(F.explode(F.split(_mixed("text"), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    x = F.col("c")
    return c.select("c", "n", kana.is_non_pause_symbol(x).alias("non_pause"), kana.is_kanji(x).alias("kanji"), kana.has_odoriji(x).alias("iteration"), kana.is_repeat_kanji(x).alias("repeats_kanji"), kana.is_repeat_kana(x).alias("repeats_kana"))


def iteration_mark_words(spark, d):
    """Words of each document that hold kanji, hold iteration marks, or are nothing but marks, and all marks."""
    w = F.split(_mixed("text"), " ", -1)
    count = lambda test: F.size(F.filter(w, test)).cast("long")
    return _docs(spark, d).where("text IS NOT NULL").select(
        "doc_id", count(kana.has_kanji).alias("with_kanji"), count(kana.has_odoriji).alias("with_marks"), count(kana.is_repeat_kanji).alias("only_kanji_marks"), count(kana.is_repeat_kana).alias("only_kana_marks"), kana.count_repeat_kanji(_mixed("text")).cast("long").alias("kanji_marks")
    )


def kanji_features(spark, d):
    """Tokens that are words with kanji, and single kanji, by part of speech."""
    w = _docs(spark, d).select(F.explode(F.split(_mixed("text"), " ", -1)).alias("w"))
    t = w.select("w", F.when(F.length("w") % 3 == 0, "記号").otherwise("名詞").alias("pos"))
    word = (F.col("pos") != "記号") & kana.has_kanji(F.col("w"))
    return t.groupBy("pos").agg(F.count("*").alias("n"), F.count_if(word).alias("kanji_words"), F.count_if(word & (F.length("w") == 1)).alias("single_kanji"))


def unidic_fields(spark, d):
    """Named fields of a feature string (each document's words as one)."""
    f = F.replace("text", F.lit(" "), F.lit(","))
    return _docs(spark, d).select("doc_id", *(unidic.field(f, n).alias(n) for n in ("pos1", "cForm", "lemma", "pron", "kana", "aType", "lemma_id")))


def normalized_phonemes(spark, d):
    """Evaluation form of phoneme lists: no pauses, lower case save N."""
    p = F.transform(F.split("text", " ", -1), lambda w: F.when(F.length(w) % 7 == 0, "pau").when(F.length(w) % 5 == 0, "N").otherwise(F.translate(F.left(w, F.lit(2)), LATIN, LATIN.upper())))
    n = ev.normalized_phonemes(p)
    return _docs(spark, d).select("doc_id", F.size(n).cast("long").alias("n"), F.md5(F.array_join(n, " ").cast("binary")).alias("md5"))


def gold_join(spark, d):
    """Results with and without gold: documents against labels."""
    results = _docs(spark, d).select("doc_id", "lang")
    both, none = ev.with_gold(results, spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id")
    return both.select("doc_id", "lang", F.col("quality").cast("long").alias("gold")).unionByName(none.select("doc_id", "lang", F.lit(None).cast("long").alias("gold")))


def _spoilt(spark, d):
    """Customers' segment and name as two words, and the same with words spoilt by a star in front."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array("c_mktsegment", "c_name").alias("e"))
    star = lambda i, k: F.when(F.col("c_custkey") % k == 0, F.concat(F.lit("*"), F.substring(F.col("e")[i], 2, 1000))).otherwise(F.col("e")[i])
    return c.withColumn("a", F.array(star(0, 2), star(1, 3)))


def error_attribution(spark, d):
    """Which words the edit operations of a sentence fall on."""
    x = _spoilt(spark, d).select("c_custkey", ev.char_error_ops(F.array_join("e", ""), F.array_join("a", "")).alias("o"), F.transform("e", F.length).alias("n"))
    return x.select("c_custkey", (F.col("o.s") + F.col("o.d") + F.col("o.i")).cast("long").alias("errors"), F.array_join(F.transform(ev.failing_words("o.ops", "n"), lambda w: w.cast("string")), ",").alias("words"))


def token_diffs(spark, d):
    """Differences of token lists as [-x] [+y]."""
    return _spoilt(spark, d).select("c_custkey", ev.token_diff("e", "a").alias("diff"))


def cli_modes(spark, d):
    """The other output modes over each document's words: phonemes, labels, readings by word, detailed lines, JSON."""
    w = F.split("text", " ", -1)
    detail = F.transform(
        w,
        lambda x: F.struct(
            x.alias("word"), F.lit("名詞").alias("pos"), F.lit("一般").alias("pos_group1"), F.translate(x, LATIN, LATIN.upper()).alias("pron"), F.translate(x, LATIN.upper(), LATIN).alias("read"), F.length(x).alias("accent_nucleus"), (F.length(x) + 1).alias("mora_count"),
            F.lit(-1).alias("chain_flag"), F.lit("C1").alias("chain_rule"), (F.length(x) > 12).alias("is_unknown"), (x == "").alias("is_ignored"),
        ),
    )
    md5 = lambda c, name: F.md5(c.cast("binary")).alias(name)
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", md5(formats.words(w), "words_md5"), md5(formats.lines(w), "lines_md5"), md5(formats.mapping_detailed(detail), "detailed_md5"), F.length(formats.json_record(F.transform(w, F.length))).cast("long").alias("json_chars"))


# --- the seven rules on neighbouring tokens -----------------------------------

_RULED = ArrayType(StructType().add("pron", StringType()).add("acc", IntegerType()).add("chain_rule", StringType()).add("chain_flag", IntegerType()))


@F.pandas_udf(_RULED)
def _pair_rules(tokens: pd.Series) -> pd.Series:
    out = []
    for row in tokens:
        made = [Token(**x) for x in row] if row is not None else []
        njd.plus_rules(made)
        out.append([{"pron": t.pron, "acc": t.acc, "chain_rule": t.chain_rule, "chain_flag": t.chain_flag} for t in made])
    return pd.Series(out)


def pair_rules(spark, d):
    """All seven rules over every document's words dressed up as tokens."""
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (n % len(x) + 1).cast("int"))

    def token(w, i):
        n = F.length(w)
        prefix = (i % 2 == 0) & (n % 5 == 4)
        return F.struct(
            F.when(prefix, "お").when(n % 11 == 3, "た").otherwise(w).alias("string"), F.when(prefix, "接頭詞").otherwise(pick(n + i, "名詞", "動詞", "形容詞", "副詞")).alias("pos"), pick(n, "一般", "サ変接続", "格助詞", "自立").alias("pos_group1"),
            pick(n + i, "*", "サ変・スル", "一段").alias("ctype"), pick(n, "基本形", "連用形", "連用タ接続").alias("cform"), pick(n + 2 * i, "なる", "れる", "する", "ちゃう", "見る").alias("orig"),
            pick(n, "ウ", "ア").alias("read"), pick(n + i, "ー", "カ", "ケ’", "コ").alias("pron"), (n % 4).cast("int").alias("acc"), ((n + i) % 4).cast("int").alias("mora_size"),
            F.when(prefix, "P1").otherwise("C3").alias("chain_rule"), F.lit(-1).alias("chain_flag"),
        )

    t = _docs(spark, d).where("text IS NOT NULL").select("doc_id", _pair_rules(F.transform(F.split("text", " ", -1), token)).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat_ws(",", x["pron"], x["acc"].cast("string"), x["chain_rule"], x["chain_flag"].cast("string"))), " ")
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.md5(text.cast("binary")).alias("md5"))


# --- golden texts ------------------------------------------------------------------

# Published results of the analysis.
GOLDEN_PHONEMES = {
    "こんにちは": "k o N n i ch i w a", "ななみんです": "n a n a m i N d e s U", "復帰": "f u cl k i", "10000": "i ch i m a N", "100000000": "i ch i o k u", "行こう": "i k o o", "ハローユーチューブ": "h a r o o y u u ch u u b u",
    "": "", "いやあん": "i y a a N",
}
GOLDEN_KANA = {
    "今日もこんにちは": "キョーモコンニチワ", "さゝみ": "ササミ", "カヽ": "カカ", "がゝ": "ガカ", "かゞ": "カガ", "じょゝ": "ジョジョ", "これは何ですか？何の情報？": "コレワナンデスカ？ナンノジョーホー？",
    "何を言っても何の問題もありません。": "ナニヲイッテモナンノモンダイモアリマセン。", "学生々活": "ガクセーセーカツ",
}
GOLDEN_MAPPING = {
    "𰻞𰻞麺": "𰻞𰻞:unk 麺:m e N", "「あ」": "「: あ:a 」:", "なる　長老ー　ー　に": "なる:n a r u 　:sp 長老ーー:ch o o r o o o o 　:sp 　:sp に:n i", "あー　ー　ー": "あーーー:a a a a 　:sp 　:sp",
    "𰻞　ー": "𰻞:unk 　:sp ー:unk", "　あーー　": "　:sp あーー:a a a 　:sp", "7xyz": "七:n a n a ｘｙｚ:unk", "叙々々": "叙:j o 々々:j o j o", "様々々": "様々:s a m a z a m a 々:z a m a",
    "学生々活7xyz大阪": "学生:g a k U s e e 生活:s e e k a ts u 七:n a n a ｘｙｚ:unk 大阪:o o s a k a",
}


def _golden(spark, texts) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def _g2p():
    from kotoflow.plans.g2p import G2P

    return G2P()


def golden_phonemes(spark, d):
    return _golden(spark, GOLDEN_PHONEMES).select("text", F.array_join(_g2p().phonemes("text"), " ").alias("phonemes"))


def golden_kana(spark, d):
    return _golden(spark, GOLDEN_KANA).select("text", _g2p().kana("text").alias("kana"))


def golden_mapping(spark, d):
    mark = lambda x: F.concat(x["word"], F.lit(":"), F.array_join(x["phonemes"], " "))
    return _golden(spark, GOLDEN_MAPPING).select("text", F.array_join(F.transform(_g2p().mapping("text"), mark), " ").alias("mapping"))


def golden_labels(spark, d):
    """Phonemes read off full-context labels are those of the flat result, between two silences."""
    labels = F.transform(_g2p().fullcontext("text"), lambda x: F.regexp_extract(x, r"-([^-+]+)\+", 1))
    return _golden(spark, [t for t in GOLDEN_PHONEMES if t]).select("text", F.array_join(labels, " ").alias("labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (symbol_classes, iteration_mark_words, kanji_features, unidic_fields, normalized_phonemes, gold_join, error_attribution, token_diffs, cli_modes, pair_rules, golden_phonemes, golden_kana, golden_mapping, golden_labels)
}

_MIXED = f"translate(lower(text), '{LATIN}', '{AS_MIXED}')"
_CHARS = f"SELECT unnest(regexp_extract_all({_MIXED}, '(?s).')) AS c FROM documents"
_WORDS = "SELECT doc_id, k - 1 AS i, w[k] AS w, length(w[k]) AS n FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(generate_series(1, len(string_split(text, ' ')))) AS k FROM documents WHERE text IS NOT NULL)"
_KANJI = "regexp_matches({x}, '[\\x{{4E00}}-\\x{{9FFF}}]')"
_QUOTED = ", ".join("'" + c.replace("'", "''") + "'" for c in sorted(kana.NON_PAUSE_SYMBOLS))


def _values(rows: dict[str, str], name: str) -> str:
    quoted = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in rows.items())
    return f"SELECT * FROM (VALUES {quoted}) AS v(text, {name})"


ORACLE_SQL: dict[str, str] = {
    "symbol_classes": f"""
SELECT c, count(*) AS n, c IN ({_QUOTED}) AS non_pause, unicode(c) BETWEEN 19968 AND 40959 AS kanji, c IN ('々', 'ゝ', 'ゞ', 'ヽ', 'ヾ') AS iteration,
  c = '々' AS repeats_kanji, c IN ('ゝ', 'ゞ', 'ヽ', 'ヾ') AS repeats_kana FROM ({_CHARS}) GROUP BY c""",
    "iteration_mark_words": f"""
WITH x AS (SELECT doc_id, {_MIXED} AS m FROM documents WHERE text IS NOT NULL), y AS (SELECT *, string_split(m, ' ') AS w FROM x)
SELECT doc_id, len([v FOR v IN w IF {_KANJI.format(x='v')}]) AS with_kanji, len([v FOR v IN w IF regexp_matches(v, '[々ゝゞヽヾ]')]) AS with_marks,
  len([v FOR v IN w IF regexp_full_match(v, '々+')]) AS only_kanji_marks, len([v FOR v IN w IF regexp_full_match(v, '[ゝゞヽヾ]+')]) AS only_kana_marks, CAST(length(m) - length(replace(m, '々', '')) AS BIGINT) AS kanji_marks FROM y""",
    "kanji_features": f"""
WITH w AS (SELECT unnest(string_split({_MIXED}, ' ')) AS w FROM documents), t AS (SELECT w, CASE WHEN length(w) % 3 = 0 THEN '記号' ELSE '名詞' END AS pos FROM w)
SELECT pos, count(*) AS n, count(*) FILTER (WHERE pos <> '記号' AND {_KANJI.format(x='w')}) AS kanji_words, count(*) FILTER (WHERE pos <> '記号' AND {_KANJI.format(x='w')} AND length(w) = 1) AS single_kanji FROM t GROUP BY pos""",
    "unidic_fields": "SELECT doc_id, "
    + ", ".join(f'f[{unidic.FIELDS.index(n) + 1}] AS "{n}"' for n in ("pos1", "cForm", "lemma", "pron", "kana", "aType", "lemma_id"))
    + " FROM (SELECT doc_id, string_split(replace(text, ' ', ','), ',') AS f FROM documents)",
    "normalized_phonemes": f"""
WITH p AS (SELECT doc_id, [CASE WHEN length(w) % 7 = 0 THEN 'pau' WHEN length(w) % 5 = 0 THEN 'N' ELSE translate(left(w, 2), '{LATIN}', '{LATIN.upper()}') END FOR w IN string_split(text, ' ')] AS p FROM documents),
q AS (SELECT doc_id, [CASE WHEN x = 'N' THEN x ELSE translate(x, '{LATIN.upper()}', '{LATIN}') END FOR x IN p IF x <> 'pau'] AS q FROM p)
SELECT doc_id, len(q) AS n, md5(array_to_string(q, ' ')) AS md5 FROM q""",
    "gold_join": "SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS gold FROM documents d LEFT JOIN labels l USING (doc_id)",
    "error_attribution": """
SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS errors,
  CASE WHEN c_custkey % 6 = 0 THEN '0,1' WHEN c_custkey % 2 = 0 THEN '0' WHEN c_custkey % 3 = 0 THEN '1' ELSE '' END AS words FROM customer""",
    "token_diffs": """
WITH x AS (SELECT c_custkey, c_mktsegment AS a, c_name AS b, '[+*' || c_mktsegment[2:] || ']' AS p, '[+*' || c_name[2:] || ']' AS q FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '[-' || a || '] [-' || b || '] ' || p || ' ' || q WHEN c_custkey % 2 = 0 THEN '[-' || a || '] ' || p || ' ' || b
  WHEN c_custkey % 3 = 0 THEN a || ' [-' || b || '] ' || q ELSE a || ' ' || b END AS diff FROM x""",
    "cli_modes": f"""
WITH w AS ({_WORDS}),
l AS (SELECT *, CASE WHEN n > 12 THEN '[UNK]' WHEN w = '' THEN '[IGN]' ELSE '[OK] ' END || ' ' || w || chr(9) || 'POS: 名詞' || chr(9) || 'POS_GROUP1: 一般' || chr(9) || 'PRON: ' || translate(w, '{LATIN}', '{LATIN.upper()}') || chr(9) || 'READ: ' || translate(w, '{LATIN.upper()}', '{LATIN}')
  || chr(9) || 'ACC: ' || n || '/' || (n + 1) || chr(9) || 'CHAIN_FLAG: -1' || chr(9) || 'CHAIN_RULE: C1' AS line FROM w)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5, md5(string_agg(w, chr(10) ORDER BY i)) AS lines_md5, md5(string_agg(line, chr(10) ORDER BY i)) AS detailed_md5,
  CAST(sum(length(CAST(n AS VARCHAR)) + 1) + 1 AS BIGINT) AS json_chars FROM l GROUP BY doc_id""",
    "pair_rules": f"""
WITH w AS ({_WORDS}), p AS (SELECT *, i % 2 = 0 AND n % 5 = 4 AS prefix, ['名詞', '動詞', '形容詞', '副詞'][(n + i) % 4 + 1] AS own_pos FROM w),
t AS (
  SELECT doc_id, i, CASE WHEN prefix THEN 'お' WHEN n % 11 = 3 THEN 'た' ELSE w END AS string, CASE WHEN prefix THEN '接頭詞' ELSE own_pos END AS pos, ['一般', 'サ変接続', '格助詞', '自立'][n % 4 + 1] AS g1,
    ['*', 'サ変・スル', '一段'][(n + i) % 3 + 1] AS ctype, ['基本形', '連用形', '連用タ接続'][n % 3 + 1] AS cform, ['なる', 'れる', 'する', 'ちゃう', '見る'][(n + 2 * i) % 5 + 1] AS orig,
    ['ウ', 'ア'][n % 2 + 1] AS read, ['ー', 'カ', 'ケ’', 'コ'][(n + i) % 4 + 1] AS pron, n % 4 AS acc, (n + i) % 4 AS mora, prefix FROM p),
b AS (SELECT *, lag(pron) OVER o AS b_pron, lag(pos) OVER o AS b_pos, lag(g1) OVER o AS b_g1, lag(orig) OVER o AS b_orig, coalesce(lag(prefix) OVER o, false) AS b_prefix, lead(i) OVER o AS more FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
-- a reading that a step before made ウ has a vowel row that lengthens nothing, as ー has none
r AS (
  SELECT *, CASE WHEN pron = 'ー' AND read = 'ウ' AND b_pron IN ('カ', 'ケ’') THEN 'ウ' ELSE pron END AS pron1,
    CASE WHEN b_prefix AND acc IN (0, mora) THEN 0 ELSE acc END AS acc1,
    CASE WHEN b_orig IN ('れる', 'られる', 'せる', 'させる', 'ちゃう') AND string = 'た' THEN 'F2@1' WHEN b_pos = '動詞' AND pos = '動詞' THEN CASE WHEN acc <> 0 THEN 'C1' ELSE 'C4' END
      WHEN b_prefix THEN CASE WHEN acc IN (0, mora) THEN 'C4' ELSE 'C1' END WHEN prefix THEN 'P1' ELSE 'C3' END AS rule1,
    CASE WHEN (b_g1 IN ('サ変接続', '格助詞', '接続助詞') OR b_pos = '名詞' AND b_g1 = '一般' OR b_pos = '副詞') AND ctype = 'サ変・スル' THEN 1 WHEN b_pos = '形容詞' AND orig IN ('なる', 'する') THEN 1 ELSE -1 END AS flag1 FROM b),
f AS (SELECT *, CASE WHEN more IS NOT NULL AND cform IN ('連用形', '連用タ接続') AND acc1 = mora AND mora > 1 THEN acc1 - 1 ELSE acc1 END AS acc2 FROM r)
SELECT doc_id, count(*) AS tokens, md5(string_agg(pron1 || ',' || acc2 || ',' || rule1 || ',' || flag1, ' ' ORDER BY i)) AS md5 FROM f GROUP BY doc_id""",
    "golden_phonemes": _values(GOLDEN_PHONEMES, "phonemes"),
    "golden_kana": _values(GOLDEN_KANA, "kana"),
    "golden_mapping": _values(GOLDEN_MAPPING, "mapping"),
    "golden_labels": _values({k: f"sil {v} sil" for k, v in GOLDEN_PHONEMES.items() if v}, "labels"),
}
