"""The analysis by kinds of morphemes gives what the passes give; results leave workers in bounded batches."""

import random

import pytest
from pyspark.sql import functions as F

from kotoflow.operators import typed
from kotoflow.plans import g2p
from kotoflow.plans.g2p import G2P, Engine
from kotoflow.plans.options import Options
from kotoflow.sources import lexicon as lex

RESULTS = ("phonemes", "kana", "kana_per_word", "njd", "pairs", "mapping", "mapping_detailed", "mecab", "fullcontext")


def _texts(n: int) -> list[str]:
    draw = random.Random(7)
    parts = [*lex.load((lex.DEFAULT_LEXICON,)).words, *"ーゝ々？！、。　 1２０十百ウうおご御漢〇ナキシスあ\n「」・abéｘ、。", "きし", "ちゃすき"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(n)]


def _plain(x):
    if isinstance(x, str):
        return x
    return list(x)


@pytest.mark.parametrize("options", [Options(split_sentences=True), Options(), Options(filler_accent=False, retreat_accent=False), Options(odoriji=False, accent_chaining=False)])
def test_kinds_give_what_the_passes_give(options):
    paths = (lex.DEFAULT_LEXICON,)
    fast, slow = (Engine(options, paths, lex.version(paths), None) for _ in range(2))
    assert fast.typed is not None
    slow.typed = None
    for text in _texts(300):
        for name in RESULTS:
            assert _plain(getattr(fast, name)(text)) == _plain(getattr(slow, name)(text)), (name, text)


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(typed, "PIECES", 10)
    paths = (lex.DEFAULT_LEXICON,)
    fast, slow = (Engine(Options(split_sentences=True), paths, lex.version(paths), None) for _ in range(2))
    slow.typed = None
    for text in _texts(60):
        assert fast.phonemes(text) == slow.phonemes(text)
    assert len(fast.typed._new) <= 10 >= len(fast.typed._old)


def test_connection_costs_and_reverted_readings_keep_the_passes():
    paths = (lex.DEFAULT_LEXICON,)
    assert Engine(Options(revert_long_vowels=True), paths, lex.version(paths), None).typed is None
    assert not typed.applies(Options(), lex.Lexicon(matrix=[[0]]), None)


@pytest.mark.parametrize("name", ["phonemes", "fullcontext", "mapping", "kana", "njd"])
def test_results_in_small_batches(spark, monkeypatch, name):
    texts = [*_texts(40), None, "", "今日\0", *_texts(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    whole = [r.x for r in df.select("i", getattr(G2P(), name)("t").alias("x")).orderBy("i").collect()]
    monkeypatch.setattr(g2p, "BATCH_ITEMS", 7)
    monkeypatch.setattr(g2p, "BATCH_LABELS", 7)
    parts = [r.x for r in df.select("i", getattr(G2P(), name)("t").alias("x")).orderBy("i").collect()]
    assert parts == whole and parts[40] is None and parts[42] is None and not parts[41]


def test_kana_is_that_of_the_native_form(spark):
    from kotoflow.operators.token_rules import kana as native

    df = spark.createDataFrame([(t,) for t in _texts(50)], "t string")
    assert df.select((G2P().kana("t") == native(G2P().njd("t"))).alias("same")).where(~F.col("same")).count() == 0
