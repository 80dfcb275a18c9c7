"""Full-context labels of a token list, in the published HTS format for Japanese."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

from kotoflow.functions.kana import split
from kotoflow.operators.alignment import spoken
from kotoflow.operators.njd import PAUSES, Token
from kotoflow.operators.phonemes import phonemes_of


class Spoken:
    """A word as labels see it; ``at`` has the mora of each phoneme, counted from 0."""

    __slots__ = ("phonemes", "at", "size", "acc", "joins", "before", "here", "after")

    def __init__(self, phonemes: tuple[str, ...], at: tuple[int, ...], size: int, token: Token):
        self.phonemes, self.at, self.size, self.acc, self.joins = phonemes, at, size, token.acc, token.chain_flag == 1
        self.before, self.here, self.after = _features(token.pos, token.ctype, token.cform)


class Phrase:
    __slots__ = ("words", "asks", "size", "accent")

    def __init__(self, word: Spoken):
        self.words, self.asks, self.size, self.accent = [word], False, 0, 0


# Part-of-speech and inflection numbers of the label format.
_POS = {"その他": "xx", "感動詞": "09", "記号": "xx", "形状詞": "19", "助詞": "23", "助動詞": "10", "接続詞": "08", "接頭詞": "16", "動詞": "20", "副詞": "06", "名詞": "02", "連体詞": "07", "形容詞": "01", "フィラー": "18"}
_CFORM = {"未然": "0", "連用": "1", "基本": "2", "体言": "3", "仮定": "4", "命令": "5"}
_CTYPE = {"五段": "1", "一段": "3", "カ変": "5", "サ変": "4", "特殊": "6", "形容": "7"}


@lru_cache(maxsize=1 << 12)
def _of(name: str, value: str) -> str:
    return _number({"pos": _POS, "ctype": _CTYPE, "cform": _CFORM}[name], value)


def _number(table: dict[str, str], value: str) -> str:
    return next((n for k, n in table.items() if value.startswith(k)), "xx")


@lru_cache(maxsize=1 << 12)
def _features(*of: str) -> tuple[str, str, str]:
    """A word as the word before, the word itself and the word after."""
    b = [_of(name, value) for name, value in zip(("pos", "ctype", "cform"), of, strict=True)]
    return "/B:{}-{}_{}".format(*b), "/C:{}_{}+{}".format(*b), "/D:{}+{}_{}".format(*b)


_mora = lru_cache(maxsize=1 << 12)(phonemes_of)


def _moras(pron: str, own: tuple[str, ...]) -> list[list[str]]:
    """Phonemes of a word by morae; what it owns beyond its pronunciation lengthens it."""
    out: list[list[str]] = []
    for m in split(pron.lstrip("ー")):
        if m == "’":
            if out and out[-1][-1] in "aiueo":
                out[-1][-1] = out[-1][-1].upper()
        elif m == "ー":
            if out:
                out.append([out[-1][-1].lower()])
        else:
            p = _mora(m)
            if p:
                out.append(list(p))
    have = sum(map(len, out))
    return out + [[p] for p in own[have:]]


#: Items between words: a pause, and one that asks.
PAUSE, ASKS = object(), object()


def spoken_word(t: Token, own) -> Spoken | object | None:
    """A token as an item of labels; None if nothing of it is spoken."""
    if t.pron in PAUSES:
        return ASKS if t.pron == "？" else PAUSE
    moras = _moras(t.pron, tuple(own)) if own else None
    if not moras:
        return None
    flat = tuple(chain.from_iterable(moras))
    return Spoken(own if own == flat else flat, tuple(i for i, m in enumerate(moras) for _ in m), len(moras), t)


def _tree(items: Iterable[Spoken | object | None]) -> list[list[Phrase]]:
    """Breath groups of accent phrases of words."""
    groups: list[list[Phrase]] = []
    new_group = True
    for w in items:
        if w is None:
            continue
        if w is PAUSE or w is ASKS:
            if w is ASKS and groups and not new_group:
                groups[-1][-1].asks = True
            new_group = True
            continue
        if new_group:
            groups.append([Phrase(w)])
            new_group = False
        elif w.joins:
            groups[-1][-1].words.append(w)
        else:
            groups[-1].append(Phrase(w))
    for group in groups:
        for p in group:
            p.size = sum([w.size for w in p.words])
            p.accent = p.words[0].acc or p.size
    return groups


_NO_WORD = "/B:xx-xx_xx", "/C:xx_xx+xx", "/D:xx+xx_xx"


@lru_cache(maxsize=1 << 12)
def _places(n: int, accent: int) -> list[str]:
    """Of the morae of a phrase."""
    return [f"/A:{max(-49, min(49, at - accent))}+{at}+{n - at + 1}" for at in range(1, n + 1)]


#: Five neighbouring phonemes whose text is kept, in all.
FIVES = 1 << 16


class _Fives(dict):
    def __missing__(self, five: tuple[str, ...]) -> str:
        if len(self) >= FIVES:
            self.clear()
        found = self[five] = "{}^{}-{}+{}={}".format(*five)
        return found


_fives = _Fives()


def _blocks(groups: list[list[Phrase]]) -> Iterator[tuple[list[str], str]]:
    """Labels as lists of beginnings with the end that they share: all that follows a label's five phonemes is the same
    for the phonemes of a mora, and most of it for those of a word or phrase."""
    flat = [p for group in groups for p in group]
    words = [w for p in flat for w in p.words]
    names = ["xx", "xx", "sil"]
    for g, group in enumerate(groups):
        if g:
            names.append("pau")
        for p in group:
            for w in p.words:
                names += w.phonemes
    names += ["sil", "xx", "xx"]
    fives = list(map(_fives.__getitem__, zip(names, names[1:], names[2:], names[3:], names[4:], strict=False)))
    moras = [sum([p.size for p in x]) for x in groups]
    total = sum(moras)
    totals = f"/K:{len(groups)}+{len(flat)}-{total}"
    shape = [(len(x), n) for x, n in zip(groups, moras, strict=True)]
    before = [_NO_WORD[0], *[w.before for w in words]]
    after = [*[w.after for w in words], _NO_WORD[2]]

    def silence(g: int, i: int, j: int) -> str:
        """The end of a label before group ``g``, phrase ``i`` and word ``j`` (counted through the text)."""
        text = "/A:xx+xx+xx" + before[j] + _NO_WORD[1] + after[j] + _e(flat[i - 1] if i else None, None)
        text += "/F:xx_xx#xx_xx@xx_xx|xx_xx" + _g(flat[i] if i < len(flat) else None, None)
        return text + _h(shape[g - 1] if g else None) + "/I:xx-xx@xx+xx&xx-xx|xx+xx" + _j(shape[g] if g < len(groups) else None) + totals

    i = j = k = done = 0
    after.append(_NO_WORD[2])
    yield [fives[0]], silence(0, 0, 0)
    k = 1
    for g, group in enumerate(groups):
        if g:
            yield [fives[k]], silence(g, i, j)
            k += 1
        here = f"/I:{len(group)}-{moras[g]}@{g + 1}+{len(groups) - g}&{i + 1}-{len(flat) - i}|{done + 1}+{total - done}"
        here = _h(shape[g - 1] if g else None) + here + _j(shape[g + 1] if g + 1 < len(groups) else None) + totals
        inside = 0
        for a, phrase in enumerate(group):
            n, acc = phrase.size, phrase.accent
            rest = _e(flat[i - 1] if i else None, int(a > 0)) + f"/F:{n}_{acc}#{int(phrase.asks)}_xx@{a + 1}_{len(group) - a}|{inside + 1}_{moras[g] - inside}"
            rest += _g(flat[i + 1] if i + 1 < len(flat) else None, int(a + 1 < len(group))) + here
            places = _places(n, acc)
            at = 0
            for word in phrase.words:
                end = k + len(word.phonemes)
                mine = places[at : at + word.size] if at else places
                yield [five + mine[m] for five, m in zip(fives[k:end], word.at, strict=True)], f"{before[j]}{word.here}{after[j + 1]}{rest}"
                at += word.size
                k = end
                j += 1
            inside += n
            i += 1
        done += moras[g]
    yield [fives[k]], silence(len(groups), i, j)


def items(tokens: list[Token], owned: list[list[str]] | None = None) -> list[Spoken | object | None]:
    """Tokens as items of labels.  ``owned``: as :func:`alignment.spoken` gives it."""
    return [spoken_word(t, own) for t, own in zip(tokens, spoken(tokens) if owned is None else owned, strict=True)]


def labels_of(of: Iterable[Spoken | object | None]) -> list[str]:
    groups = _tree(of)
    return [head + rest for heads, rest in _blocks(groups) for head in heads] if groups else []


def make_labels(tokens: list[Token], owned: list[list[str]] | None = None) -> list[str]:
    """One label per phoneme, with silence at both ends; no tokens give no labels."""
    return labels_of(items(tokens, owned))


#: Characters of labels that are put together before they are hashed, about.
HASHED = 1 << 18


def digest(of: Iterable[Spoken | object | None]) -> tuple[int, str]:
    """The number of labels, and the MD5 of all of them with a line feed between each two."""
    groups = _tree(of)
    md5, n, size = hashlib.md5(usedforsecurity=False), 0, 0
    parts: list[str] = []
    line = ""
    for heads, rest in _blocks(groups) if groups else ():
        parts.append(line)
        line = rest + "\n"
        text = line.join(heads)
        parts.append(text)
        n += len(heads)
        size += len(text)
        if size >= HASHED:
            md5.update("".join(parts).encode())
            parts, size = [], 0
    parts.append(line[:-1])
    md5.update("".join(parts).encode())
    return n, md5.hexdigest()


def _e(p: Phrase | None, joined: int | None) -> str:
    # the format writes 1 where no pause stands between the phrases
    return "/E:xx_xx!xx_xx-xx" if p is None else f"/E:{p.size}_{p.accent}!{int(p.asks)}_xx-{'xx' if joined is None else joined}"


def _g(p: Phrase | None, joined: int | None) -> str:
    return "/G:xx_xx%xx_xx_xx" if p is None else f"/G:{p.size}_{p.accent}%{int(p.asks)}_xx_{'xx' if joined is None else joined}"


def _h(group: tuple[int, int] | None) -> str:
    return "/H:xx_xx" if group is None else f"/H:{group[0]}_{group[1]}"


def _j(group: tuple[int, int] | None) -> str:
    return "/J:xx_xx" if group is None else f"/J:{group[0]}_{group[1]}"
