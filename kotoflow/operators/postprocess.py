"""Rewrites after the analysis, in their fixed order; each is optional."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from kotoflow.functions import kana
from kotoflow.operators.njd import Token
from kotoflow.operators.token_rules import CHAINING_VERBS, MULTI_READING_KANJI

MAX_KANJI_RUN = 8


def revert_pron(tokens: list[Token], use_read: bool, long_vowels: bool, yotsugana: bool) -> None:
    for t in tokens:
        if use_read or long_vowels and "ー" in t.pron and "ー" not in t.orig or yotsugana and re.search("[ヅヂ]", t.read):
            t.pron = t.read


def filler_accent(tokens: list[Token]) -> None:
    for i, t in enumerate(tokens):
        if t.pos == "フィラー" and t.acc > t.mora_size:
            t.acc = 0
        if i and tokens[i - 1].pos == "フィラー" and t.pos == "名詞":
            t.chain_flag = 0


def nani_reading(tokens: list[Token], is_nan: Callable[[Token | None], bool]) -> None:
    for i, t in enumerate(tokens):
        if t.orig == "何":
            t.read = t.pron = "ナン" if is_nan(tokens[i + 1] if i + 1 < len(tokens) else None) else "ナニ"


def second_readings(tokens: list[Token], second: list[tuple[int, str, str]]) -> None:
    """Readings of multi-reading kanji from another analysis: (char start, surface, kana)."""
    by, at = {(s, w): k for s, w, k in second}, 0
    for t in tokens:
        found = by.get((at, t.orig)) if t.orig in MULTI_READING_KANJI else None
        if found:
            t.read = t.pron = found
        at += len(t.string)


def _phrases(tokens: list[Token]):
    """Token lists of the phrases that have a head."""
    own: list[Token] | None = None
    for t in tokens:
        if t.chain_flag in (0, -1):
            if own:
                yield own
            own = [t]
        elif own is not None:
            own.append(t)
    if own:
        yield own


def retreat_accent(tokens: list[Token]) -> None:
    for phrase in _phrases(tokens):
        head, before = phrase[0], 0
        for t in phrase:
            if before < head.acc <= before + t.mora_size:
                bare = [c for c in t.pron if c not in kana.SMALL_KANA]
                at = head.acc - before - 1
                c = bare[at] if at < len(bare) else (bare[0] if bare else "")
                if c in ("ー", "ッ", "ン"):
                    head.acc -= 1
                break
            before += t.mora_size


def accent_after_chaining(tokens: list[Token]) -> None:
    for phrase in _phrases(tokens):
        head, before, nucleus, moved = phrase[0], 0, None, None
        if head.acc == 0:
            continue
        for k, t in enumerate(phrase):
            if nucleus is not None:
                if t.ctype == "特殊・マス":
                    moved = before + (2 if t.cform == "未然形" else 1)
                elif t.ctype == "特殊・ナイ":
                    moved = before
                elif t.orig in CHAINING_VERBS:
                    moved = before + t.acc
                else:
                    break
            elif head.acc < 0 and k == 0 or before < head.acc <= before + t.mora_size:
                nucleus = k
            before += t.mora_size
        if moved is not None:
            head.acc = moved


# --- iteration marks -------------------------------------------------------


def repeated_unit(read: str) -> str | None:
    """Shortest unit that ends the reading twice, compared unvoiced; given as the reading has it last."""
    m = kana.py_split_mora(read)
    plain = [kana.py_to_unvoiced(x) for x in m]
    for k in range(1, len(m) // 2 + 1):
        if plain[-k:] == plain[-2 * k : -k]:
            return "".join(m[-k:])
    return None


def _has_kanji(t: Token) -> bool:
    return t.pos != "記号" and any(map(kana.py_is_kanji, t.orig))


def _repeat(t: Token, read: str, pron: str, size: int, acc: int) -> None:
    t.read, t.pron, t.mora_size, t.acc, t.chain_flag = read, pron, size, acc, 1
    t.set_noun()


def _only(t: Token, marks: str) -> bool:
    return bool(t.string) and all(c in marks for c in t.string)


def iteration_marks(tokens: list[Token], analyze: Callable[[str], list[Token]]) -> list[Token]:
    """Readings for 々 and ゝゞヽヾ.  ``analyze`` is the plain analysis, for compounds such as 学生々活."""
    out, i = list(tokens), 0
    while i < len(out):
        t = out[i]
        if _only(t, "々"):
            i = _repeat_kanji(out, i, analyze)
        elif _only(t, "ゝゞヽヾ"):
            _repeat_kana(out, i)
            i += 1
        else:
            i += 1
    return out


def _repeat_kanji(out: list[Token], i: int, analyze) -> int:
    t, before = out[i], out[i - 1] if i else None
    if before is not None and t.string == "々" and _has_kanji(before) and len(before.orig) > 1 and kana.py_is_kanji(before.orig[-1]):
        nxt = out[i + 1] if i + 1 < len(out) else None
        takes = nxt is not None and _has_kanji(nxt) and len(nxt.orig) == 1
        new = analyze(before.orig[-1] + (nxt.orig if takes else ""))
        if new:
            new = [replace(x, morph=t.morph) for x in new]
            new[0].chain_flag = 1
            if not takes:
                new[0].string = t.string
                for x in new:
                    x.set_noun()
            out[i : i + (2 if takes else 1)] = new
            return i + (len(new) if takes else 1)
    end = i
    while end < len(out) and _only(out[end], "々"):
        end += 1
    if before is not None and before.string.endswith("々"):
        unit = repeated_unit(before.read)
        if unit:
            n = len(t.string)
            _repeat(t, unit * n, unit * n, len(kana.py_split_mora(unit)) * n, before.acc)
            return i + 1
    total = sum(len(x.string) for x in out[i:end])
    base: list[Token] = []
    chars = 0
    for k in range(i - 1, -1, -1):
        x = out[k]
        if x.pos in ("記号", "フィラー", "感動詞") or not all(map(kana.py_is_kanji, x.orig)) or chars >= min(total, MAX_KANJI_RUN):
            break
        base.insert(0, x)
        chars += len(x.orig)
    if not base:
        return end
    read, pron, size = "".join(x.read for x in base), "".join(x.pron for x in base), sum(x.mora_size for x in base)
    for x in out[i:end]:
        n = len(x.string) if chars == 1 else 1
        _repeat(x, read * n, pron * n, size * n, base[0].acc)
    return end


def _repeat_kana(out: list[Token], i: int) -> None:
    if not i or out[i - 1].pos == "記号":
        return
    source = next((x for x in reversed(out[:i]) if x.pos != "記号" and x.mora_size > 0), None)
    if source is None:
        return
    t, m, last = out[i], kana.py_split_mora(source.pron.replace("’", "")), ""
    last = m[-1]
    made = []
    for c in t.string:
        if c in "ゞヾ":
            last = kana.py_to_voiced(last)
        elif not (len(last) > 1):
            last = kana.py_to_unvoiced(last)
        made.append(last)
    t.read = t.pron = "".join(made)
    t.mora_size = max(0, source.mora_size // len(m)) * len(made)
    t.chain_flag = 1
    if t.pos == "記号":
        t.set_noun()
