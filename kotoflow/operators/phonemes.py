"""Kana to phonemes: a table made from consonants and vowels, as a column and in Python."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kotoflow.functions.kana import SMALL_KANA, split

# Phoneme symbols of the Japanese front ends (consonant of each kana row, small-kana combinations).
_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "g": "ガギグゲゴ", "s": "サ-スセソ", "z": "ザ-ズゼゾ", "t": "タ--テト", "d": "ダ--デド",
    "n": "ナニヌネノ", "h": "ハヒ-ヘホ", "b": "バビブベボ", "p": "パピプペポ", "m": "マミムメモ", "y": "ヤ-ユ-ヨ", "r": "ラリルレロ", "w": "ワ----",
}
_SINGLE = {
    "シ": "sh i", "ジ": "j i", "チ": "ch i", "ヂ": "j i", "ツ": "ts u", "ヅ": "z u", "フ": "f u", "ヲ": "o", "ヰ": "i", "ヱ": "e", "ン": "N", "ッ": "cl", "ヴ": "v u", "ヵ": "k a", "ヶ": "k e",
    "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o", "ャ": "y a", "ュ": "y u", "ョ": "y o", "ヮ": "w a",
}
_GLIDES = {"キ": "ky", "ギ": "gy", "シ": "sh", "ジ": "j", "チ": "ch", "ヂ": "j", "ニ": "ny", "ヒ": "hy", "ビ": "by", "ピ": "py", "ミ": "my", "リ": "ry", "テ": "ty", "デ": "dy"}
_FOREIGN = {"フ": "f", "ヴ": "v", "ツ": "ts", "ク": "kw", "グ": "gw", "ウ": "w", "ス": "s", "ズ": "z", "ト": "t", "ド": "d"}
VOWELS = dict(zip("アイウエオ", "aiueo", strict=True))


def _table() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for consonant, row in _ROWS.items():
        for c, v in zip(row, "aiueo", strict=True):
            if c != "-":
                out[c] = [consonant, v] if consonant else [v]
    out |= {k: v.split() for k, v in _SINGLE.items()}
    for c, g in _GLIDES.items():
        out |= {c + s: [g, v] for s, v in zip("ャュョェ", "auoe", strict=True)}
    for c, g in _FOREIGN.items():
        out |= {c + s: [g, v] for s, v in zip("ァィェォ", "aieo", strict=True)}
    out |= {"フュ": ["hy", "u"], "トゥ": ["t", "u"], "ドゥ": ["d", "u"], "ティ": ["t", "i"], "ディ": ["d", "i"], "ティ": ["t", "i"], "イェ": ["y", "e"], "シィ": ["sh", "i"], "スィ": ["s", "i"], "ズィ": ["z", "i"]}
    return out


MORA_PHONEMES = _table()


def mora_phonemes(mora: Column) -> Column:
    """Phonemes of one mora; null where the table has none (symbols, ー)."""
    table = F.create_map(*[x for m, p in sorted(MORA_PHONEMES.items()) for x in (F.lit(m), F.array(*map(F.lit, p)))])
    return F.element_at(table, mora)


def py_phonemes(pron: str) -> list[str]:
    """Phonemes of a pronunciation: ー lengthens the vowel before it, ’ devoices the vowel before it, unknown characters are silent."""
    return list(_phonemes(pron))


@lru_cache(maxsize=1 << 16)
def _phonemes(pron: str) -> tuple[str, ...]:
    return phonemes_of(pron)


def phonemes_of(pron: str) -> tuple[str, ...]:
    """:func:`py_phonemes` as a tuple that is not kept."""
    out: list[str] = []
    for m in split(pron):
        known = MORA_PHONEMES.get(m)
        if known is not None:
            out += known
        elif m == "ー":
            if out and out[-1].lower() in "aiueo":
                out.append(out[-1].lower())
        elif m == "’":
            if out and out[-1] in "aiueo":
                out[-1] = out[-1].upper()
        elif m[0] in MORA_PHONEMES and m[1:] in SMALL_KANA:
            out += MORA_PHONEMES[m[0]] + MORA_PHONEMES.get(m[1:], [])
    return tuple(out)
