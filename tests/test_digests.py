"""Labels hashed where they are made: nothing of them leaves the worker, and the digest is that of the labels."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_typed import _texts

from kotoflow.operators import labels
from kotoflow.plans import queries
from kotoflow.plans.g2p import G2P, Engine
from kotoflow.plans.options import Options
from kotoflow.sources import lexicon as lex


def _engine(by_kind: bool) -> Engine:
    paths = (lex.DEFAULT_LEXICON,)
    e = Engine(Options(split_sentences=True), paths, lex.version(paths), None)
    if not by_kind:
        e.typed = None
    return e


@pytest.mark.parametrize("by_kind", [True, False])
def test_digest_is_that_of_the_labels(by_kind, monkeypatch):
    monkeypatch.setattr(labels, "HASHED", 1000)
    e = _engine(by_kind)
    for text in ["", "、", "　", *_texts(200)]:
        made = e.fullcontext(text)
        assert e.fullcontext_digest(text) == {"labels": len(made), "md5": hashlib.md5("\n".join(made).encode()).hexdigest()}, text


def test_pieces_of_whole_texts_are_those_of_their_sentences():
    e = _engine(True)
    for text in ["「あ」！」い", "！！、。\n\n　\n", "あ！？い。", *_texts(300)]:
        wide = e.guard(text)
        cut = [p for s in e.sentences(wide) if s for p in ([s] if e.typed._mixed(s) else e.typed._cut_up(s))]
        assert e.typed.pieces(wide, e.sentences) == cut, text


def test_long_texts_are_widened_as_short_ones():
    text = "".join(map(chr, range(0x20, 0x7F))) + "あ\ud800\U00020000\t\n"
    assert "".join(_engine(True).guard(c) for c in text) == _engine(True).guard(text)


def test_fullcontext_query_sends_no_labels(spark, tmp_path):
    spark.createDataFrame([(1, "to be, or not"), (2, None), (3, ""), (4, "a\0b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.fullcontext(spark, str(tmp_path))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "fullcontext" in plan or "run(" in plan
    assert "array_join" not in plan
    made = queries._analyzed(spark, str(tmp_path)).select("doc_id", G2P(Options(split_sentences=True)).fullcontext("text").alias("l"))
    want = made.select("doc_id", F.size("l").alias("labels"), F.md5(F.array_join("l", "\n").cast("binary")).alias("md5"))
    assert sorted(df.collect()) == sorted(want.collect()) and df.dtypes == want.dtypes
