"""Words by part of speech are those of the detailed mapping, and the mapping takes time in proportion to the text."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_typed import _texts

from kotoflow.operators import alignment
from kotoflow.operators.alignment import Entry
from kotoflow.operators.lattice import Morph
from kotoflow.plans import queries
from kotoflow.plans.g2p import G2P, Engine
from kotoflow.plans.options import Options
from kotoflow.sources import lexicon as lex


@pytest.mark.parametrize("by_kind", [True, False])
def test_tallies_are_those_of_the_detailed_mapping(by_kind):
    paths = (lex.DEFAULT_LEXICON,)
    e = Engine(Options(split_sentences=True), paths, lex.version(paths), None)
    if not by_kind:
        e.typed = None
    for text in ["", "　", *_texts(300)]:
        words, morae = Counter(), Counter()
        for r in e.mapping_detailed(text):
            words[r["pos"], r["pos_group1"]] += 1
            morae[r["pos"], r["pos_group1"]] += r["mora_count"]
        got = {(r["pos"], r["pos_group1"]): (r["words"], r["morae"]) for r in e.parts_of_speech(text)}
        assert got == {k: (n, morae[k]) for k, n in words.items()}, text


def test_mapping_asks_each_morpheme_a_few_times():
    asked = 0

    class Asked(Morph):
        @property
        def is_ignored(self) -> bool:
            nonlocal asked
            asked += 1
            return False

    n = 400
    entries = [Entry("十", ["j", "u"]) for _ in range(n)]
    out = alignment.mapping(entries, [Asked("１", "名詞,数") for _ in range(n)], True)
    assert len(out) == n and asked < 20 * n


def test_detailed_query_gives_what_the_rows_give(spark, tmp_path):
    spark.createDataFrame([(1, "to be, or 10 not zz to"), (2, None), (3, ""), (4, "a\0b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.g2p_mapping_detailed(spark, str(tmp_path))
    rows = queries._analyzed(spark, str(tmp_path)).select(F.explode(G2P(Options(split_sentences=True)).mapping_detailed("text")).alias("m"))
    want = rows.groupBy("m.pos", "m.pos_group1").agg(F.count("*").alias("words"), F.sum("m.mora_count").alias("morae"))
    assert sorted(df.collect()) == sorted(want.collect()) and df.dtypes == want.dtypes
