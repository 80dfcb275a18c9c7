"""Kana scalars: native column functions, each with a Python twin for use inside folds."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code-point ranges and character classes of Japanese script.
HIRAGANA = "".join(map(chr, [*range(0x3041, 0x3097), 0x309D, 0x309E]))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)
SMALL_KANA = "ャュョァィゥェォ"
ROWS = {
    "ア": "アカガサザタダナハバパマヤラワァヵヮ",
    "イ": "イキギシジチヂニヒビピミリヰィ",
    "ウ": "ウクグスズツヅヌフブプムユルヴゥ",
    "エ": "エケゲセゼテデネヘベペメレヱェヶ",
    "オ": "オコゴソゾトドノホボポモヨロヲォ",
}
_PLAIN = "カキクケコサシスセソタチツテトハヒフヘホ"
VOICED = {c: chr(ord(c) + 1) for c in _PLAIN} | {chr(ord(c) - 0x60): chr(ord(c) + 1 - 0x60) for c in _PLAIN}
UNVOICED = {v: k for k, v in VOICED.items()}
ODORIJI = "々ゝゞヽヾ"
NON_PAUSE_SYMBOLS = frozenset("「」『』（）()【】［］[]〈〉《》〔〕｛｝{}\"'”“’‘")
ASCII_WIDE = {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)} | {" ": "　"}

_TO_KATA, _TO_HIRA = str.maketrans(HIRAGANA, KATAKANA), str.maketrans(KATAKANA, HIRAGANA)
_WIDE = str.maketrans(ASCII_WIDE)
MORA = r"(?s)(.[" + SMALL_KANA + "]?)"


def hira_to_kata(c: Column) -> Column:
    return F.translate(c, HIRAGANA, KATAKANA)


def kata_to_hira(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def py_hira_to_kata(s: str) -> str:
    return s.translate(_TO_KATA)


def py_kata_to_hira(s: str) -> str:
    return s.translate(_TO_HIRA)


def widen_ascii(c: Column) -> Column:
    """Printable ASCII and the space to their full-width forms."""
    return F.translate(c, "".join(ASCII_WIDE), "".join(ASCII_WIDE.values()))


def py_widen_ascii(s: str) -> str:
    if len(s) < 64:
        return s.translate(_WIDE)
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    wide = np.where((c > 0x20) & (c < 0x7F), c + 0xFEE0, np.where(c == 0x20, 0x3000, c))
    return wide.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def is_voiced(c: Column) -> Column:
    return c.isin(*UNVOICED, "ヴ")


def py_is_voiced(c: str) -> bool:
    return c in UNVOICED or c == "ヴ"


def is_non_pause_symbol(c: Column, symbols: frozenset[str] = NON_PAUSE_SYMBOLS) -> Column:
    return c.isin(*sorted(symbols))


def vowel_row(c: Column) -> Column:
    """Row (ア イ ウ エ オ) of a full-size katakana; null for ー, ン, ッ, small kana and others."""
    out = F.lit(None).cast("string")
    for vowel, members in ROWS.items():
        out = F.when(c.isin(*[m for m in members if m not in "ァィゥェォヵヶヮ"]), vowel).otherwise(out)
    return out


def py_vowel_row(c: str) -> str | None:
    return next((v for v, m in ROWS.items() if c and c in m and c not in "ァィゥェォヵヶヮ"), None)


def split_mora(c: Column) -> Column:
    """Morae: a character with the small katakana that follows it."""
    return F.regexp_extract_all(c, F.lit(MORA), F.lit(1))


#: Morae of a string: each character with the small katakana after it.
split = re.compile(MORA).findall


def py_split_mora(s: str) -> list[str]:
    return list(py_moras(s))


@lru_cache(maxsize=1 << 16)
def py_moras(s: str) -> tuple[str, ...]:
    """Morae of a string, kept for strings seen before."""
    return tuple(split(s))


def to_voiced(c: Column) -> Column:
    """Voiced form of a mora (first kana); anything else stays."""
    return F.concat(F.translate(F.substring(c, 1, 1), "".join(VOICED), "".join(VOICED.values())), F.substring(c, 2, 1 << 30))


def to_unvoiced(c: Column) -> Column:
    return F.concat(F.translate(F.substring(c, 1, 1), "".join(UNVOICED), "".join(UNVOICED.values())), F.substring(c, 2, 1 << 30))


def py_to_voiced(m: str) -> str:
    return VOICED.get(m[:1], m[:1]) + m[1:]


def py_to_unvoiced(m: str) -> str:
    return UNVOICED.get(m[:1], m[:1]) + m[1:]


def is_kanji(c: Column) -> Column:
    return c.rlike(r"^[\x{4E00}-\x{9FFF}]$")


def py_is_kanji(c: str) -> bool:
    return "一" <= c <= "鿿"


def has_kanji(c: Column) -> Column:
    return c.rlike(r"[\x{4E00}-\x{9FFF}]")


def has_odoriji(c: Column) -> Column:
    return c.rlike(f"[{ODORIJI}]")


def is_repeat_kanji(c: Column) -> Column:
    """Only 々."""
    return c.rlike("^々+$")


def is_repeat_kana(c: Column) -> Column:
    return c.rlike("^[ゝゞヽヾ]+$")


def count_repeat_kanji(c: Column) -> Column:
    return F.regexp_count(c, F.lit("々"))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize_unicode(c: Column, form: str | None) -> Column:
    """None plans nothing.  Pure ASCII is normalized already and skips Python."""
    if form is None:
        return c
    return {"NFC": _nfc, "NFKC": _nfkc}[form](c)


def lower_but_n(c: Column) -> Column:
    """Evaluation form of a phoneme: lower case, save the moraic N."""
    return F.when(c == "N", c).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: Character class runs of an input text (the grouping half of unknown-word search).
CLASS_RUNS = r"[a-zA-ZÀ-ÖØ-öø-ɏ]+|[0-9]+|[\x{3041}-\x{309F}]+|[\x{30A1}-\x{30FF}]+|[\x{3400}-\x{4DB5}\x{4E00}-\x{9FA5}々]+|[ \t\r\n\x0B]+|[^a-zA-ZÀ-ÖØ-öø-ɏ0-9\x{3041}-\x{309F}\x{30A1}-\x{30FF}\x{3400}-\x{4DB5}\x{4E00}-\x{9FA5}々 \t\r\n\x0B]+"


def class_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CLASS_RUNS), F.lit(0))
