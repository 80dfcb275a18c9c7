"""Analysis options: hashable, part of every cache key, never a column."""

from __future__ import annotations

from collections.abc import Callable, Container
from dataclasses import dataclass

from kotoflow.functions.kana import NON_PAUSE_SYMBOLS


@dataclass(frozen=True)
class Options:
    normalize: str | None = None  # None, "NFC" or "NFKC"
    use_read_as_pron: bool = False
    revert_long_vowels: bool = False
    revert_yotsugana: bool = False
    filler_accent: bool = True
    predict_nani: bool = True
    second_readings: bool = False
    retreat_accent: bool = True
    accent_chaining: bool = True
    odoriji: bool = True
    non_pause_symbols: frozenset[str] = NON_PAUSE_SYMBOLS
    #: Asked for every symbol in place of the set, if given (a function that can be pickled).
    is_non_pause: Callable[[str], bool] | None = None
    max_bytes: int = 16384
    split_sentences: bool = False
    #: FAILFAST raises at the first bad text; PERMISSIVE gives a null result.
    mode: str = "PERMISSIVE"

    @property
    def silent(self) -> Container[str]:
        """Symbols that make no pause."""
        return self.non_pause_symbols if self.is_non_pause is None else _Asked(self.is_non_pause)


@dataclass(frozen=True)
class _Asked:
    test: Callable[[str], bool]

    def __contains__(self, symbol: str) -> bool:
        return bool(self.test(symbol))
