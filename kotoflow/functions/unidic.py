"""Fields of a UniDic feature string, by name; missing ones are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published column order of UniDic features.
FIELDS = "pos1 pos2 pos3 pos4 cType cForm lForm lemma orth pron orthBase pronBase goshu iType iForm fType fForm iConType fConType type kana kanaBase form formBase aType aConType aModType lid lemma_id".split()


def field(feature: Column, name: str) -> Column:
    return F.get(F.split(feature, ","), F.lit(FIELDS.index(name)))


def fields(feature: Column) -> Column:
    parts = F.split(feature, ",")
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])
