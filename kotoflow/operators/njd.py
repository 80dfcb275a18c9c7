"""From morphemes to pronounced tokens: readings, numbers, accent phrases, accents, devoicing.

The passes follow the published behaviour of Japanese text-to-speech front ends
(Sagisaka's accent combination rules); they are checked against golden readings
only, as the original front end's source was not at hand.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

from kotoflow.functions import kana
from kotoflow.operators.lattice import Morph

PAUSES = ("、", "？", "！")


@dataclass(slots=True)
class Token:
    string: str
    pos: str = "*"
    pos_group1: str = "*"
    pos_group2: str = "*"
    pos_group3: str = "*"
    ctype: str = "*"
    cform: str = "*"
    orig: str = "*"
    read: str = "*"
    pron: str = "*"
    acc: int = 0
    mora_size: int = 0
    chain_rule: str = "*"
    chain_flag: int = -1
    #: place of the morpheme it came from; -1 for inserted ones
    morph: int = -1

    def set_noun(self) -> None:
        self.pos, self.pos_group1, self.pos_group2, self.pos_group3, self.ctype, self.cform = "名詞", "一般", "*", "*", "*", "*"


def moras(pron: str) -> int:
    return len(kana.py_moras(pron.replace("’", "")))


@lru_cache(maxsize=1 << 16)
def _fields(feature: str) -> tuple:
    f = feature.split(",")
    f += ["*"] * (11 - len(f))
    acc, _, size = f[9].partition("/")
    number = lambda x: int(x) if re.fullmatch(r"-?[0-9]+", x) else 0
    return f[:6], f[6] if f[6] != "*" else None, (f[7], f[8], number(acc), number(size), f[10] or "*", -1)


def token_of(m: Morph, at: int) -> Token:
    first, orig, last = _fields(m.feature)
    return Token(m.surface, *first, m.surface if orig is None else orig, *last, at)


_KATA = re.compile("[ァ-ヺー]+").fullmatch


@lru_cache(maxsize=1 << 16)
def _kata(string: str) -> tuple[str, bool]:
    """A string as katakana, and whether that can be read."""
    k = kana.py_hira_to_kata(string)
    return k, bool(_KATA(k))


def set_pronunciation(tokens: list[Token]) -> None:
    """Readings for tokens without one; what cannot be read becomes a pause."""
    for i, t in enumerate(tokens):
        if t.mora_size == 0 or t.pron == "*":
            k, readable = _kata(t.string)
            symbol = t.pos == "記号" and (t.pron in ("*", t.string) and not k.strip("ァ-ヺー") == "")
            if t.pron in ("*", "") or symbol:
                if readable:
                    t.read = t.pron = k
                    t.mora_size = moras(k)
                    if t.pos == "*" or t.pos_group1 == "*":
                        t.pos = "フィラー"
                elif t.string in ("？", "！"):
                    t.read = t.pron = t.string
                else:
                    t.read = t.pron = "、"
                    t.mora_size = 0
                    t.pos = "記号"
        before = tokens[i - 1] if i else None
        if t.pron == "ウ" and before and before.pos in ("動詞", "助動詞") and before.mora_size:
            t.pron = "ー"
        if t.pos == "助動詞" and t.string in ("です", "ます") and t.pron in ("デス", "マス"):
            if not (i + 1 < len(tokens) and tokens[i + 1].string == "？"):
                t.pron += "’"


# --- pair rules ------------------------------------------------------------

_LENGTHENED = "アイエ"


def plus_rules(tokens: list[Token]) -> None:
    """Seven rules on neighbours, from left to right; a rule sees what earlier steps wrote."""
    for cur, nxt in zip(tokens, tokens[1:], strict=False):
        if nxt.pron == "ー" and nxt.read == "ウ" and kana.py_vowel_row(cur.pron.rstrip("’")[-1:]) in tuple(_LENGTHENED):
            nxt.pron = "ウ"
        takes_suru = cur.pos_group1 in ("サ変接続", "格助詞", "接続助詞") or (cur.pos == "名詞" and cur.pos_group1 == "一般") or cur.pos == "副詞"
        if takes_suru and nxt.ctype == "サ変・スル":
            nxt.chain_flag = 1
        if cur.string in ("お", "御", "ご") and cur.chain_rule == "P1":
            if nxt.acc in (0, nxt.mora_size):
                nxt.chain_rule, nxt.acc = "C4", 0
            else:
                nxt.chain_rule = "C1"
        if cur.pos == nxt.pos == "動詞":
            nxt.chain_rule = "C1" if nxt.acc else "C4"
        if cur.cform in ("連用形", "連用タ接続", "連用ゴザイ接続", "連用テ接続") and cur.acc == cur.mora_size > 1:
            cur.acc -= 1
        if cur.orig in ("れる", "られる", "せる", "させる", "ちゃう") and nxt.string == "た":
            nxt.chain_rule = "F2@1"
        if cur.pos == "形容詞" and nxt.orig in ("なる", "する"):
            nxt.chain_flag = 1


# --- numbers ---------------------------------------------------------------

_DIGITS = dict(zip("〇一二三四五六七八九", ("ゼロ", "イチ", "ニ", "サン", "ヨン", "ゴ", "ロク", "ナナ", "ハチ", "キュー"), strict=True))
_PLACES = [("", ""), ("十", "ジュー"), ("百", "ヒャク"), ("千", "セン")]
_GROUPS = [("", ""), ("万", "マン"), ("億", "オク"), ("兆", "チョー"), ("京", "ケー")]
_SOUND = {("三", "百"): ("サン", "ビャク"), ("六", "百"): ("ロッ", "ピャク"), ("八", "百"): ("ハッ", "ピャク"), ("三", "千"): ("サン", "ゼン"), ("八", "千"): ("ハッ", "セン"), ("一", "兆"): ("イッ", "チョー"), ("八", "兆"): ("ハッ", "チョー")}


def _digit(t: Token) -> str | None:
    """The digit that a one-character number token stands for."""
    if t.pos_group1 != "数" or len(t.string) != 1:
        return None
    if "０" <= t.string <= "９":
        return str(ord(t.string) - ord("０"))
    return None


def number_words(digits: str) -> list[tuple[str, str]]:
    """(kanji, reading) of a number; with a leading zero or beyond 20 digits, digit by digit."""
    if (digits[0] == "0" and len(digits) > 1) or len(digits) > 4 * len(_GROUPS):
        return [("〇一二三四五六七八九"[int(d)], list(_DIGITS.values())[int(d)]) for d in digits]
    if digits == "0":
        return [("〇", "ゼロ")]
    out: list[tuple[str, str]] = []
    groups = [digits[max(0, k - 4) : k] for k in range(len(digits), 0, -4)]
    for g in range(len(groups) - 1, -1, -1):
        some = False
        for k, d in enumerate(groups[g]):
            place, read = _PLACES[len(groups[g]) - 1 - k]
            if d == "0":
                continue
            some = True
            one = "〇一二三四五六七八九"[int(d)]
            if d != "1" or not place or (place == "千" and g):
                sound = _SOUND.get((one, place), (("イッ" if d == "1" and place == "千" else _DIGITS[one]), read))
                out.append((one, sound[0]))
                read = sound[1]
            if place:
                out.append((place, read))
        if some and g:
            one = out[-1][0]
            sound = _SOUND.get((one, _GROUPS[g][0]))
            if sound:
                out[-1] = (one, sound[0])
            out.append((_GROUPS[g][0], sound[1] if sound else _GROUPS[g][1]))
    return out


def set_digit(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and _digit(tokens[j]) is not None:
            j += 1
        if j == i:
            out.append(tokens[i])
            i += 1
            continue
        words = number_words("".join(_digit(t) for t in tokens[i:j]))
        for k, (w, r) in enumerate(words):
            out.append(replace(tokens[i], string=w, orig=w, read=r, pron=r, acc=1 if k == 0 else 0, mora_size=moras(r), chain_rule="C3", chain_flag=-1 if k == 0 else 1, morph=tokens[min(i + k, j - 1)].morph))
        i = j
    return out


# --- accents ---------------------------------------------------------------


def _joins(b: Token, t: Token) -> int:
    """Does a token join the phrase of the one before it (1) or start one (0)?  Later statements overrule earlier ones."""
    flag, noun, function = 1, b.pos == "名詞", ("助詞", "助動詞")
    if t.pos == "名詞" and (b.pos == "形容詞" or b.pos_group1 == "形容動詞語幹" and noun):
        flag = 0
    if b.pos == "動詞" and t.pos in ("形容詞", "名詞"):
        flag = 0
    if {"副詞", "接続詞", "連体詞"} & {b.pos, t.pos} or "副詞可能" in (b.pos_group1, t.pos_group1):
        flag = 0
    if t.pos in function:
        flag = 1
    if b.pos in function and t.pos not in function:
        flag = 0
    if b.pos_group1 == "接尾" and t.pos == "名詞":
        flag = 0
    if t.pos == "形容詞" and t.pos_group1 == "非自立" and (b.pos in ("動詞", "形容詞") and b.cform.startswith("連用") or b.pos_group1 == "接続助詞" and b.string == "て"):
        flag = 1
    if t.pos == "動詞" and t.pos_group1 == "非自立" and (b.pos == "動詞" and b.cform.startswith("連用") or noun and b.pos_group1 == "サ変接続"):
        flag = 1
    if noun and (t.pos in ("動詞", "形容詞") or t.pos_group1 == "形容動詞語幹"):
        flag = 0
    if "記号" in (b.pos, t.pos) or t.pos == "接頭詞":
        flag = 0
    if b.pos_group3 == "姓" and t.pos == "名詞" or noun and t.pos_group3 == "名":
        flag = 0
    if t.pos_group1 == "接尾":
        flag = 1
    return flag


def set_accent_phrase(tokens: list[Token]) -> None:
    for b, t in zip(tokens, tokens[1:], strict=False):
        if t.chain_flag < 0:
            t.chain_flag = _joins(b, t)


def _rule(rules: str, pos: str) -> str:
    """The part of a chain rule that holds after a part of speech."""
    for part in rules.split("/"):
        name, sep, rule = part.partition("%")
        if not sep:
            return part
        if name == pos or name in pos:
            return rule
    return "*"


def combined_accent(rule: str, head: int, before: int, own: int) -> int:
    """Accent of a phrase (head accent, morae before) after a token with the rule joins it."""
    kind, _, shift = rule.partition("@")
    at = before + (int(shift) if re.fullmatch(r"-?[0-9]+", shift) else 0)
    return {
        "F2": at if head == 0 else head,
        "F3": at if head != 0 else head,
        "F4": at,
        "F5": 0,
        "C1": before + own,
        "C2": before + 1,
        "C3": before,
        "C4": 0,
        "P1": before + own if own else 0,
        "P2": before + own if own else before + 1,
        "P6": 0,
        "P14": before + own if own else head,
    }.get(kind, head)


def set_accent_type(tokens: list[Token]) -> None:
    head: Token | None = None
    before = 0
    for i, t in enumerate(tokens):
        if i == 0 or t.chain_flag != 1:
            head, before = t, 0
        else:
            head.acc = combined_accent(_rule(t.chain_rule, tokens[i - 1].pos), head.acc, before, t.acc)
        before += t.mora_size


# --- devoicing -------------------------------------------------------------

_HIGH = frozenset("キ ク シ ス チ ツ ヒ フ ピ プ シュ チュ キュ ヒュ ピュ".split())
_VOICELESS = frozenset("カキクケコサシスセソタチツテトハヒフヘホパピプペポ")


def set_unvoiced_vowel(tokens: list[Token]) -> None:
    """i and u between voiceless consonants lose their voice: not twice in a row, not on the accent nucleus, not in fillers."""
    flat, split = [], [kana.py_moras(t.pron) for t in tokens]
    phrase_at, head = 0, 0
    for i, t in enumerate(tokens):
        if i == 0 or t.chain_flag != 1:
            phrase_at, head = 0, t.acc
        for k, m in enumerate(split[i]):
            if m != "’":
                phrase_at += 1
                flat.append((i, k, m, phrase_at == head))
    marked: dict[int, set[int]] = {}
    last = -2
    for n, (i, k, m, nucleus) in enumerate(flat):
        if m not in _HIGH:
            parts = split[i]
            if k + 1 < len(parts) and parts[k + 1] == "’":
                last = n
            continue
        t, parts = tokens[i], split[i]
        if k + 1 < len(parts) and parts[k + 1] == "’":
            last = n
            continue
        after = flat[n + 1][2] if n + 1 < len(flat) else ""
        following = tokens[flat[n + 1][0]].pron if after else ""
        if last == n - 1 or t.pos == "フィラー" or m not in _HIGH or after[:1] not in _VOICELESS or not after or following in PAUSES:
            continue
        if nucleus and not (m == "シ" and t.pos in ("動詞", "助動詞", "助詞")):
            continue
        marked.setdefault(i, set()).add(k)
        last = n
    for i, places in marked.items():
        tokens[i].pron = "".join(m + ("’" if k in places else "") for k, m in enumerate(split[i]))


def analyze(morphs: Sequence[Morph], places: Sequence[int] | None = None) -> list[Token]:
    """All passes in order; no morphemes give no tokens."""
    tokens = [token_of(m, places[i] if places is not None else i) for i, m in enumerate(morphs)]
    if not tokens:
        return []
    set_pronunciation(tokens)
    plus_rules(tokens)
    tokens = set_digit(tokens)
    set_accent_phrase(tokens)
    set_accent_type(tokens)
    set_unvoiced_vowel(tokens)
    return tokens
