"""Phonemes of tokens, and their alignment with the morphemes of the text."""

from __future__ import annotations

from collections.abc import Container, Iterable, Sequence
from dataclasses import dataclass, field, replace
from itertools import accumulate

from kotoflow.functions import kana
from kotoflow.operators.lattice import Morph
from kotoflow.operators.njd import PAUSES, Token
from kotoflow.operators.phonemes import py_phonemes


@dataclass
class Entry:
    """A word with its phonemes; ``token`` is set for detailed results."""

    word: str
    phonemes: list[str] = field(default_factory=list)
    is_unknown: bool = False
    is_ignored: bool = False
    token: Token | None = None


def flat_phonemes(tokens: list[Token]) -> list[str]:
    """Phonemes of the label tree: words in order, one pause between stretches of speech."""
    return joined((own, t.pron in PAUSES) for own, t in zip(spoken(tokens), tokens, strict=True))


def joined(words: Iterable[tuple[Sequence[str], bool]]) -> list[str]:
    """Phonemes of words given as (own phonemes, is it a pause?)."""
    out: list[str] = []
    for own, pause in words:
        if own:
            out += own
        elif pause and out and out[-1] != "pau":
            out.append("pau")
    return out[:-1] if out and out[-1] == "pau" else out


def spoken(tokens: list[Token]) -> list[list[str]]:
    """Phonemes owned by each token; a leading ー lengthens, and belongs to, the word before it."""
    out: list[list[str]] = []
    owner: int | None = None
    for t in tokens:
        out.append([])
        if t.pron in PAUSES:
            owner = None
            continue
        body = t.pron.lstrip("ー")
        if owner is not None and out[owner]:
            vowel = out[owner][-1].lower()
            if vowel in ("a", "i", "u", "e", "o"):
                out[owner] += [vowel] * (len(t.pron) - len(body))
        out[-1] = py_phonemes(body)
        if out[-1]:
            owner = len(out) - 1
    return out


def pairs(tokens: list[Token], non_pause: Container[str] = kana.NON_PAUSE_SYMBOLS) -> list[Entry]:
    """Tokens with phonemes or pauses, long-vowel tokens merged into the word before."""
    out: list[Entry] = []
    for k, (t, own) in enumerate(zip(tokens, spoken(tokens), strict=True)):
        if t.pron in PAUSES and t.string not in non_pause:
            own = ["pau"]
        e = Entry(t.string, list(own), token=t)
        if k and not own and t.pron and set(t.pron) == {"ー"} and out and out[-1].phonemes and out[-1].phonemes != ["pau"]:
            out[-1] = _merged(out[-1], e)
        else:
            out.append(e)
    return out


def _merged(a: Entry, b: Entry) -> Entry:
    x, y = a.token, b.token
    orig = x.orig + y.orig if y.orig and set(y.orig) == {"ー"} else x.orig
    return Entry(a.word + b.word, a.phonemes, token=replace(x, string=x.string + y.string, orig=orig, read=x.read + y.read, pron=x.pron + y.pron, mora_size=x.mora_size + y.mora_size))


def _consumed(word: str, morphs: list[Morph], k: int, spare: int) -> int:
    """How many of the morphemes from ``k`` on (that one is kept) an entry that differs from its text stands for.

    A reading resolved from an iteration mark stands for the mark, and for the next
    word too where the entry ends with it (``々`` and ``活`` in 生活).  Any other
    entry was made from digits: if there are no more morphemes than the ``more``
    entries after this one need, it was inserted and stands for none; else for one,
    and for the digits after that as long as enough is left (``spare``: kept morphemes from ``k`` on beyond those).
    """
    if any(c in kana.ODORIJI for c in morphs[k].surface):
        ahead = morphs[k + 1] if len(morphs) > k + 1 else None
        return 2 if ahead is not None and not ahead.is_ignored and word.endswith(ahead.surface) else 1
    if spare <= 0:
        return 0
    n = 1
    while n < min(spare, len(morphs) - k) and len(morphs[k + n].surface) == 1 and "０" <= morphs[k + n].surface <= "９":
        n += 1
    return n


def ignored(m: Morph) -> Entry:
    """The entry of a blank."""
    return Entry(m.surface, ["sp"], m.is_unknown, True, Token(m.surface, "記号", "空白"))


def finished(e: Entry, unknown: bool, detailed: bool) -> Entry:
    """An entry as the mapping has it."""
    empty = not e.phonemes
    phonemes = ["unk"] if unknown and (empty or e.phonemes == ["pau"]) else e.phonemes
    return Entry(e.word, phonemes, unknown, not phonemes if detailed else empty, e.token)


def mapping(entries: list[Entry], morphs: list[Morph], detailed: bool = False) -> list[Entry]:
    """Ordered merge of entries with all morphemes of the text: blanks become ``sp``, unknown words ``unk``."""
    out: list[Entry] = []
    k = 0
    # kept morphemes before each place
    kept = [0, *accumulate(not m.is_ignored for m in morphs)]

    def finish(e: Entry, unknown: bool) -> None:
        out.append(finished(e, unknown, detailed))

    for n, e in enumerate(entries):
        while k < len(morphs) and morphs[k].is_ignored:
            out.append(ignored(morphs[k]))
            k += 1
        if k >= len(morphs):
            finish(e, False)
            continue
        m = morphs[k]
        if e.word == m.surface:
            k += 1
            finish(e, m.is_unknown)
        elif e.word.startswith(m.surface):
            rest, unknown, inner = e.word, False, []
            while k < len(morphs) and rest:
                if morphs[k].is_ignored:
                    inner.append(ignored(morphs[k]))
                elif rest.startswith(morphs[k].surface):
                    rest = rest[len(morphs[k].surface) :]
                    unknown |= morphs[k].is_unknown
                else:
                    break
                k += 1
            finish(e, unknown)
            out += inner
        else:
            finish(e, False)
            k += _consumed(e.word, morphs, k, kept[-1] - kept[k] - (len(entries) - n - 1))
    out += [ignored(m) for m in morphs[k:] if m.is_ignored]
    return out


