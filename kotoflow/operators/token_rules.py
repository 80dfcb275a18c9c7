"""Rewrites of token tables.

``*_nested`` forms work on ``array<struct>`` columns with higher-order functions
(streaming-safe, no shuffle); ``*_table`` forms work on one row per token with
windows over (doc, pos).  Sequential rewrites used inside text analysis have a
Python form in :mod:`kotoflow.operators.postprocess`; tests hold them equal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
CHAINING_VERBS = ("れる", "られる", "すぎる", "せる", "させる")
MULTI_READING_KANJI = tuple("風観方出時上下君手嫌表対色人前後角金頭筆水間棚奴降中入緒通")


def reverted_pron(t: Column | DataFrame, use_read: bool = False, long_vowels: bool = False, yotsugana: bool = False) -> Column:
    """pron, or read where an option asks for it; ``t`` is a struct or a table."""
    pron, read, orig = t["pron"], t["read"], t["orig"]
    cond = F.lit(use_read)
    if long_vowels:
        cond = cond | (pron.contains("ー") & ~orig.contains("ー"))
    if yotsugana:
        cond = cond | read.contains("ヅ") | read.contains("ヂ")
    return F.when(cond, read).otherwise(pron)


def revert_pron_nested(tokens: Column, **options: bool) -> Column:
    if not any(options.values()):
        return tokens
    return F.transform(tokens, lambda x: x.withField("pron", reverted_pron(x, **options)))


def filler_accent_nested(tokens: Column) -> Column:
    """A filler's accent may not exceed its morae; the noun after a filler starts a phrase."""

    def fix(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(tokens, i - 1)["pos"])
        acc = F.when((x["pos"] == "フィラー") & (x["acc"] > x["mora_size"]), F.lit(0)).otherwise(x["acc"])
        flag = F.when((before == "フィラー") & (x["pos"] == "名詞"), F.lit(0)).otherwise(x["chain_flag"])
        return x.withField("acc", acc).withField("chain_flag", flag)

    return F.transform(tokens, fix)


def _by(doc: Sequence[str], pos: str) -> Window:
    return Window.partitionBy(*doc).orderBy(pos)


def filler_accent_table(t: DataFrame, doc: Sequence[str] = ("doc_id",), pos: str = "pos") -> DataFrame:
    before = F.lag("pos1").over(_by(doc, pos))
    return t.withColumns(
        {
            "acc": F.when((F.col("pos1") == "フィラー") & (F.col("acc") > F.col("mora_size")), F.lit(0)).otherwise(F.col("acc")),
            "chain_flag": F.when((before == "フィラー") & (F.col("pos1") == "名詞"), F.lit(0)).otherwise(F.col("chain_flag")),
        }
    )


def _phrases(t: DataFrame, doc: Sequence[str], pos: str) -> DataFrame:
    """Adds phrase number (0 before the first head), morae before the token in its phrase, the head's accent and the nucleus flag."""
    head = F.col("chain_flag").isin(0, -1)
    t = t.withColumn("__phrase", F.sum(F.when(head, 1).otherwise(0)).over(_by(doc, pos).rowsBetween(Window.unboundedPreceding, 0)))
    inside = _by((*doc, "__phrase"), pos)
    t = t.withColumns(
        {
            "__before": F.coalesce(F.sum("mora_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__nth": F.row_number().over(inside),
            "__head": F.first("acc").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    return t


def accent_retreat_table(t: DataFrame, doc: Sequence[str] = ("doc_id",), pos: str = "pos") -> DataFrame:
    """A nucleus on ー, ッ or ン moves one mora forward (once per phrase)."""
    cols = t.columns
    p = _phrases(t, doc, pos)
    at = F.col("__head") - F.col("__before")
    bare = F.regexp_replace("pron", "[ャュョァィゥェォ]", "")
    # one character counts as one mora; out of range means the first
    ch = F.when((at >= 1) & (at <= F.length(bare)), F.substring(bare, at.cast("int"), F.lit(1))).otherwise(F.substring(bare, 1, 1))
    fires = (F.col("__phrase") > 0) & (F.col("__before") < F.col("__head")) & (F.col("__head") <= F.col("__before") + F.col("mora_size")) & ch.isin("ー", "ッ", "ン")
    p = p.withColumn("__fires", F.max(F.when(fires, 1).otherwise(0)).over(Window.partitionBy(*doc, "__phrase")))
    return p.withColumn("acc", F.when((F.col("__nth") == 1) & (F.col("__fires") == 1), F.col("acc") - 1).otherwise(F.col("acc"))).select(*cols)


def accent_chain_table(t: DataFrame, doc: Sequence[str] = ("doc_id",), pos: str = "pos") -> DataFrame:
    """Auxiliaries right after the nucleus token move the phrase's nucleus; the last of an unbroken run counts."""
    cols = t.columns
    p = _phrases(t, doc, pos)
    inside = _by((*doc, "__phrase"), pos)
    head, before = F.col("__head"), F.col("__before")
    nucleus = (F.col("__phrase") > 0) & (head != 0) & F.when(head < 0, F.col("__nth") == 1).otherwise((before < head) & (head <= before + F.col("mora_size")))
    p = p.withColumn("__nucleus", F.max(F.when(nucleus, F.col("__nth"))).over(Window.partitionBy(*doc, "__phrase")))
    moved = (
        F.when(F.col("ctype") == "特殊・マス", before + F.when(F.col("cform") == "未然形", 2).otherwise(1))
        .when(F.col("ctype") == "特殊・ナイ", before)
        .when(F.col("orig").isin(*CHAINING_VERBS), before + F.col("acc"))
    )
    p = p.withColumn("__moved", moved)
    broken = F.min(F.when((F.col("__nth") > F.col("__nucleus")) & F.col("__moved").isNull(), F.col("__nth"))).over(Window.partitionBy(*doc, "__phrase"))
    p = p.withColumn("__until", broken)
    run = (F.col("__nth") > F.col("__nucleus")) & (F.col("__until").isNull() | (F.col("__nth") < F.col("__until")))
    last = F.last(F.when(run, F.col("__moved")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return p.withColumn("__last", last).withColumn("acc", F.when((F.col("__nth") == 1) & F.col("__last").isNotNull(), F.col("__last").cast("int")).otherwise(F.col("acc"))).select(*cols)


def kanji_override_table(tokens: DataFrame, second: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Readings of multi-reading kanji from a second analysis (doc, char_start, surface, kana), matched by place and surface."""
    cols = tokens.columns
    start = F.coalesce(F.sum(F.length("string")).over(_by((doc,), pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = tokens.withColumn("__start", start)
    s = second.select(F.col(doc).alias("__doc"), F.col("char_start").alias("__s"), F.col("surface").alias("__surface"), F.col("kana").alias("__kana"))
    hit = (t[doc] == s["__doc"]) & (t["__start"] == s["__s"]) & (t["orig"] == s["__surface"]) & t["orig"].isin(*MULTI_READING_KANJI)
    j = t.join(s, hit, "left")
    return j.withColumns({k: F.coalesce("__kana", k) for k in ("read", "pron")}).select(*cols)


def kana_words(tokens: Column) -> Column:
    """Reading of each token: symbols as written, others as pronounced without ’."""
    return F.transform(tokens, lambda x: F.when(x["pos"] == "記号", x["string"]).otherwise(F.replace(x["pron"], F.lit("’"), F.lit(""))))


def kana(tokens: Column) -> Column:
    return F.array_join(kana_words(tokens), "")


def long_vowel_merge_table(t: DataFrame, doc: Sequence[str] = ("doc_id",), pos: str = "pos") -> DataFrame:
    """Tokens without phonemes whose pron is all ー join the last kept word, unless that has none or only a pause.

    ``t``: doc, pos, word, pron, phonemes (joined by spaces).  Gives doc, pos (of the owner), word.
    """
    w = _by(doc, pos)
    first = F.row_number().over(w) == 1
    cand = (F.col("phonemes") == "") & F.col("pron").rlike("^ー+$") & ~first
    t = t.withColumn("__cand", cand)
    owner = F.last(F.when(~F.col("__cand"), F.col("phonemes")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("__merged", F.col("__cand") & ~owner.isin("", "pau"))
    t = t.withColumn("__group", F.last(F.when(~F.col("__merged"), F.col(pos)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "word"))), lambda x: x["word"]), "")
    return t.groupBy(*doc, F.col("__group").alias(pos)).agg(words.alias("word"))
