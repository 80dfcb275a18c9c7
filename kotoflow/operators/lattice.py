"""Minimum-cost segmentation of a text with a lexicon and unknown words."""

from __future__ import annotations

from dataclasses import dataclass

from kotoflow.sources.lexicon import Lexicon


@dataclass(slots=True)
class Morph:
    surface: str
    feature: str
    left_id: int = 0
    right_id: int = 0
    cost: int = 0
    is_unknown: bool = False
    pos_id: int = 0

    @property
    def is_ignored(self) -> bool:
        return "記号,空白" in self.feature


#: Longest run of characters that is grouped into one unknown word.
LONGEST_RUN = 24


def run_ends(kinds: list[tuple[str, ...]]) -> list[int]:
    """For each character the end of its run: characters that share a category with the one before them."""
    out = list(range(1, len(kinds) + 1))
    for at in range(len(kinds) - 2, -1, -1):
        a, b = kinds[at], kinds[at + 1]
        if a is b or not set(a).isdisjoint(b):
            out[at] = out[at + 1]
    return out


#: (end, left id, right id, cost, feature, part-of-speech id, unknown?)
Word = tuple[int, int, int, int, str, int, bool]


def words_at(text: str, at: int, kinds: list[tuple[str, ...]], runs: list[int], lexicon: Lexicon) -> list[Word]:
    """Words that may start here: those of the lexicon, and unknown ones as the category says."""
    out: list[Word] = []
    known, prefixes = lexicon.words, lexicon.prefixes
    for end in range(at + 1, min(len(text), at + lexicon.longest) + 1):
        piece = text[at:end]
        found = known.get(piece)
        if found is not None:
            out += [(end, *entry, False) for entry in found]
        if piece not in prefixes:
            break
    rules = lexicon.rules
    kind = kinds[at][0]
    invoke, group, length = rules.categories[kind]
    if invoke or not out:
        run = runs[at]
        ends = {min(at + k, run) for k in range(1, length + 1)}
        if group and (run - at <= LONGEST_RUN or lexicon.matrix is None):
            ends.add(run)
        out += [(end, *entry, True) for end in sorted(ends or {at + 1}) for entry in rules.templates[kind]]
    return out


def _morph(text: str, at: int, word: Word) -> Morph:
    end, left, right, cost, feature, pos, unknown = word
    return Morph(text[at:end], feature, left, right, cost, unknown, pos)


def candidates(text: str, at: int, kinds: list[tuple[str, ...]], lexicon: Lexicon) -> list[Morph]:
    """:func:`words_at` as morphemes."""
    return [_morph(text, at, w) for w in words_at(text, at, kinds, run_ends(kinds), lexicon)]


def _segment_without_connections(text: str, kinds: list[tuple[str, ...]], lexicon: Lexicon) -> list[Morph]:
    """One state per place is enough when words do not see each other."""
    n, runs = len(text), run_ends(kinds)
    cost: list[int | None] = [0] + [None] * n
    back: list[tuple[int, Word] | None] = [None] * (n + 1)
    for at in range(n):
        here = cost[at]
        if here is None:
            continue
        for word in words_at(text, at, kinds, runs, lexicon):
            end, total = word[0], here + word[3]
            held = cost[end]
            if held is None or total < held:
                cost[end], back[end] = total, (at, word)
    out: list[Morph] = []
    while n:
        at, word = back[n]
        out.append(_morph(text, at, word))
        n = at
    return out[::-1]


def segment(text: str, lexicon: Lexicon) -> list[Morph]:
    """The cheapest path; ties go to the word found first."""
    kinds = [lexicon.rules.kinds(c) for c in text]
    n = len(text)
    if lexicon.matrix is None:
        return _segment_without_connections(text, kinds, lexicon)
    # at each place: best (cost, word, state before, place before) per right id of the word that ends there
    best: list[dict[int, tuple[int, Word | None, int, int]]] = [{} for _ in range(n + 1)]
    best[0][0] = (0, None, 0, -1)
    runs, joins = run_ends(kinds), lexicon.connection
    for at in range(n):
        here = best[at]
        if not here:
            continue
        for word in words_at(text, at, kinds, runs, lexicon):
            end, left, right, own, *_ = word
            cost, before = min((held[0] + joins(r, left), r) for r, held in here.items())
            cost += own
            held = best[end].get(right)
            if held is None or cost < held[0]:
                best[end][right] = (cost, word, before, at)
    out: list[Morph] = []
    at = n
    if n:
        state = min(best[n], key=lambda r: (best[n][r][0] + joins(r, 0), r))
        while at:
            _, word, state, start = best[at][state]
            out.append(_morph(text, start, word))
            at = start
    return out[::-1]
