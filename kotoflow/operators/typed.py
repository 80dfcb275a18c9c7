"""Text analysis by kinds of morphemes: the passes of :mod:`njd` and :mod:`postprocess` for many words at once.

Words repeat, and most of what the passes decide about a word depends on the word and on little
of its neighbours.  A piece of text that nothing in the lattice crosses is segmented once and
kept; pairs of neighbours are judged once for each two classes of tokens, by the passes
themselves; a token's final form is kept for what can change it: does it join, was the vowel
before it devoiced, does a voiceless consonant follow.  Only phrases with an accent, and stretches
between pauses in which a pass does more than that (digits, iteration marks, 何, rules that
rewrite a neighbour), go through the passes as they are.  Results are those of the passes.

It holds for dictionaries without connection costs and for options that neither revert readings
nor take those of a second dictionary (:func:`applies`); elsewhere the passes run alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import chain, islice, repeat
from operator import attrgetter, itemgetter
from sys import intern

from kotoflow.functions import kana
from kotoflow.functions.kana import split as split_mora
from kotoflow.operators import alignment, labels, lattice, njd, postprocess
from kotoflow.operators.lattice import Morph
from kotoflow.operators.njd import PAUSES, Token
from kotoflow.operators.phonemes import phonemes_of
from kotoflow.sources.lexicon import Lexicon

#: Pieces of text whose morphemes are kept, twice (those used since the last change, and those before it).
PIECES = 1 << 16
#: Accented phrases that are kept.
PHRASES = 1 << 13
#: Pairs of classes, and classes, that are kept.
PAIRS = 1 << 18

SENTENCE_ENDS = "。！？\n"

#: Strings that the passes ask for; other strings of one class are alike to them.
_ASKED = frozenset("お 御 ご た て です ます ？ ！ れる られる せる させる ちゃう なる する すぎる ウ ー デス マス 何".split())
#: Of a kind: as a head it has an accent that lies beyond it; a pass is made for it; it is an iteration mark.
_ACCENTED, _OWN, _MARK = 1, 2, 3
#: Of a token after another: starts a phrase; joins it; is the text's first; joins it for accents, but starts one after the rewrites (a noun
#: after a filler); joins it and may move its accent; anything else.
_NEW, _JOINS, _FIRST, _SPLITS, _MOVES, _CHANGES = 0, 4, 8, 12, 16, 32


def applies(options, lexicon: Lexicon, second: Lexicon | None) -> bool:
    reverts = options.use_read_as_pron or options.revert_long_vowels or options.revert_yotsugana
    return lexicon.matrix is None and not reverts and (second is None or not options.second_readings)


class Form:
    """A token as it ends, with its own phonemes; rows of results are made once and shared."""

    __slots__ = ("token", "phonemes", "devoiced", "pause", "rows", "_spoken")

    def __init__(self, token: Token, phonemes, devoiced: bool = False):
        self.token, self.phonemes, self.devoiced = token, phonemes, devoiced
        self.pause = token.pron in PAUSES
        #: by result
        self.rows: dict[object, object] = {}
        self._spoken = False

    def spoken(self) -> labels.Spoken | None:
        """What labels need to know."""
        if self._spoken is False:
            self._spoken = labels.spoken_word(self.token, self.phonemes)
        return self._spoken


class Kind:
    """A morpheme with what holds for it wherever it stands."""

    __slots__ = ("morph", "ignored", "token", "cls", "cut", "hard", "spoken", "moras", "count", "voiceless", "flat", "rows", "tag")

    def __init__(self, m: Morph):
        self.morph, self.ignored, self.rows = m, m.is_ignored, {}


class Text:
    """Kinds of all morphemes, and the forms of the tokens; ``aligned``: each morpheme that is not ignored has one token of its string."""

    __slots__ = ("kinds", "forms", "aligned")

    def __init__(self, kinds: list[Kind], forms: list[Form], aligned: bool):
        self.kinds, self.forms, self.aligned = kinds, forms, aligned

    def tokens(self) -> list[Token]:
        """Shared tokens: to be read only."""
        return [f.token for f in self.forms]

    def spoken(self) -> list[labels.Spoken | object | None]:
        """Forms as items of labels."""
        return [f.spoken() if (found := f._spoken) is False else found for f in self.forms]


def tag(t: Token) -> tuple[str, str, int]:
    """What tallies of words ask for."""
    return t.pos, t.pos_group1, t.mora_size


_cls, _hard, _voiceless, _tag_of = map(attrgetter, ("cls", "hard", "voiceless", "tag"))
_HERE = re.compile("[ァ-ヺー]+").fullmatch


class _Numbers(dict):
    """Numbers of the categories of characters."""

    def __init__(self, kinds):
        self.kinds, self.numbers = kinds, {}

    def __missing__(self, c: str) -> int:
        n = self[c] = self.numbers.setdefault(id(self.kinds(c)), len(self.numbers))
        return n


def _copy(t: Token, flag: int = -1) -> Token:
    return Token(t.string, t.pos, t.pos_group1, t.pos_group2, t.pos_group3, t.ctype, t.cform, t.orig, t.read, t.pron, t.acc, t.mora_size, t.chain_rule, flag)


class Typed:
    def __init__(self, lexicon: Lexicon, options, rewrite: Callable[[list[Token]], list[Token]]):
        """``rewrite``: all passes after the analysis, for a list of tokens."""
        self.lexicon, self.options, self.rewrite = lexicon, options, rewrite
        self._new: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}
        self._known: dict[tuple, Kind] = {}
        self._classes: dict[tuple, int] = {}
        self._like: list[Token] = []
        self._pairs: dict[tuple[int, int], int] = {}
        self._phrases: dict[tuple, tuple[list[Form], bool]] = {}
        self._cut_up, self._mixed, self._cut_all = self._splitters()
        self._number = _Numbers(lexicon.rules.kinds)
        self._alike: dict[tuple, int] = {}
        self._tags: dict[tuple, tuple] = {}
        self._positive = all(e[2] > 0 for rows in lexicon.words.values() for e in rows) and all(e[2] > 0 for rows in lexicon.rules.templates.values() for e in rows)

    # segmentation ------------------------------------------------------------

    def _splitters(self):
        """A pattern of pieces that no word crosses the borders of, one of characters that forbid cutting, and the pattern of pieces of whole texts, which end with sentences."""
        rules, inside = self.lexicon.rules, {c for w in self.lexicon.words if len(w) > 1 for c in w}
        alone: dict[str, list[str]] = {"SPACE": [], "SYMBOL": []}
        mixed: list[str] = []
        for lo, hi, names in rules.ranges:
            if {"SPACE", "SYMBOL"} & set(names) and hi - lo < 1 << 14:
                for c in map(chr, range(lo, hi + 1)):
                    kinds = rules.kinds(c)
                    if len(kinds) == 1 and kinds[0] in alone and c not in inside:
                        alone[kinds[0]].append(c)
                    elif {"SPACE", "SYMBOL"} & set(kinds):
                        mixed.append(c)
            elif {"SPACE", "SYMBOL"} & set(names):
                return None, None, None
        if any({"SPACE", "SYMBOL"} & set(kinds) for kinds in (rules.kinds("\0"), rules.kinds("\U0010ffff"))):
            return None, None, None
        some = {k: "".join(map(re.escape, sorted(set(v)))) for k, v in alone.items() if v}
        if not some:
            return None, None, None
        every = "".join(some.values())
        ends = [c for c in SENTENCE_ENDS if not any(c in v for v in alone.values())]
        parts = [(sorted(set(v) - set(SENTENCE_ENDS)), [c for c in SENTENCE_ENDS if c in v]) for v in alone.values() if v]
        whole = ["|".join(x for x in (f"{r}*[{re.escape(''.join(e))}]" if e else "", f"{r}+" if v else "") if x) for v, e in parts for r in (f"[{re.escape(''.join(v))}]" if v else "",)]
        # with no other characters, the first form is that of sentence ends alone
        whole = [x.removeprefix("*") for x in whole]
        rest = f"[^{every}{re.escape(''.join(ends))}]"
        whole.append(f"{rest}*[{re.escape(''.join(ends))}]|{rest}+" if ends else f"{rest}+")
        return re.compile("|".join([*(f"[{v}]+" for v in some.values()), f"[^{every}]+"])).findall, re.compile(f"[{''.join(map(re.escape, sorted(set(mixed))))}]").search if mixed else None, re.compile("|".join(whole)).findall

    def _segment(self, piece: str) -> list[Morph]:
        kinds = self.lexicon.rules.kinds
        first = kinds(piece[0])
        invoke, group, _ = self.lexicon.rules.categories[first[0]]
        if invoke or not group or not self._positive or len(set(map(self._number.__getitem__, piece))) > 1:
            return lattice.segment(piece, self.lexicon)
        # One run of a category whose unknown words are grouped: where no word of the lexicon starts, the rest as one
        # word costs less than any shorter unknown word and what has to follow it.
        n, words, prefixes, longest = len(piece), self.lexicon.words, self.lexicon.prefixes, self.lexicon.longest
        templates = self.lexicon.rules.templates[first[0]]
        best: dict[int, tuple] = {0: (0, None, None, False)}
        for at in range(n):
            if at not in best:
                continue
            here, some = best[at][0], False
            for end in range(at + 1, min(n, at + longest) + 1):
                part = piece[at:end]
                for e in words.get(part, ()):
                    some = True
                    if end not in best or here + e[2] < best[end][0]:
                        best[end] = here + e[2], at, e, False
                if part not in prefixes:
                    break
            if not some:
                for e in templates:
                    if n not in best or here + e[2] < best[n][0]:
                        best[n] = here + e[2], at, e, True
                if at == 0:
                    break
        out, end = [], n
        while end:
            _, at, (left, right, cost, feature, pos), unknown = best[end]
            out.append(Morph(piece[at:end], feature, left, right, cost, unknown, pos))
            end = at
        return out[::-1]

    def _kinds(self, piece: str) -> tuple[tuple[Kind, ...], tuple[Kind, ...]]:
        """Of a piece: its morphemes, and those that become tokens."""
        found = self._old.get(piece)
        if found is None:
            made = [self._kind(m) for m in self._segment(piece)]
            found = tuple(made), tuple(k for k in made if not k.ignored)
        if len(self._new) >= PIECES:
            self._old, self._new = self._new, {}
        self._new[piece] = found
        return found

    def _kind(self, m: Morph) -> Kind:
        if m.is_unknown:
            return self._unknown(m)
        key = m.surface, m.feature, m.left_id, m.right_id, m.cost, m.pos_id
        found = self._known.get(key)
        if found is None:
            if len(self._known) >= PIECES:
                self._known.clear()
            found = self._known[key] = self._described(m)
        return found

    def _described(self, m: Morph) -> Kind:
        k = Kind(m)
        if k.ignored:
            return k
        k.token = t = njd.token_of(m, -1)
        njd.set_pronunciation([t])
        k.moras = split_mora(t.pron)
        k.count = sum(x != "’" for x in k.moras)
        k.voiceless = 2 if t.pron[:1] in njd._VOICELESS and t.pron not in PAUSES else 0
        mark = any(c in t.string for c in kana.ODORIJI)
        own = njd._digit(t) is not None or t.orig == "何" or t.pron[:1] in ("", "ー", "’") or t.pos == "フィラー" and t.acc > t.mora_size
        k.hard = _MARK if mark else _OWN if own else _ACCENTED if t.acc and not 0 < t.acc <= min(k.count, t.mora_size) else 0
        k.cut = not k.hard and t.pos == "記号" and t.pron in PAUSES
        k.spoken = not mark and t.pos != "記号" and t.mora_size > 0
        k.cls = self._class(t)
        k.flat = [None] * 16
        k.tag = self._tagged(t)
        return k

    def _tagged(self, t: Token) -> tuple[str, str, int]:
        found = tag(t)
        return self._tags.setdefault(found, found) if len(self._tags) < PIECES else found

    def _unknown(self, m: Morph) -> Kind:
        """:func:`_described` for unknown words; what is read as it is written needs few of its questions."""
        first, orig, (_, pron, acc, size, rule, _) = njd._fields(m.feature)
        string = m.surface
        read = kana.py_hira_to_kata(string)
        if pron != "*" or first[0] in ("助動詞", "記号") or first[1] == "数" or not _HERE(read) or read[0] == "ー" or string in _ASKED or read in _ASKED or orig in _ASKED:
            return self._described(m)
        k = Kind(m)
        if k.ignored:
            return k
        k.moras = [intern(x) for x in split_mora(read)]
        k.count = size = len(k.moras)
        k.token = t = Token(string, *first, string if orig is None else orig, read, read, acc, size, rule, -1)
        if t.pos == "*" or t.pos_group1 == "*":
            t.pos = "フィラー"
        if t.pos == "フィラー" and acc > size:
            return self._described(m)
        k.voiceless = 2 if read[0] in njd._VOICELESS else 0
        k.hard = _ACCENTED if acc and not 0 < acc <= size else 0
        k.cut, k.spoken = False, True
        key = m.feature, t.pos, min(size, 2), acc == size, acc > size
        k.cls = self._alike.get(key, -1)
        if k.cls < 0:
            k.cls = self._alike[key] = self._class(t)
        k.flat = [None] * 16
        k.tag = self._tagged(t)
        return k

    def _class(self, t: Token) -> int:
        asked = tuple(x if x in _ASKED else None for x in (t.string, t.orig, t.read, t.pron))
        key = (t.pos, t.pos_group1, t.pos_group2, t.pos_group3, t.ctype, t.cform, t.acc, min(t.mora_size, 2), t.acc == t.mora_size, t.acc > t.mora_size, t.chain_rule, asked)
        found = self._classes.get(key)
        if found is None:
            found = self._classes[key] = len(self._like)
            self._like.append(replace(t))
        return found

    def _pair(self, pair: tuple[int, int]) -> int:
        """What the passes make of two neighbours."""
        b, t = (replace(self._like[i]) for i in pair)
        raw = [replace(b), replace(t)]
        for x in raw:
            if x.string in ("です", "ます"):
                x.pron = x.pron.removesuffix("’")  # comes again below, or not, as the neighbour says
        njd.set_pronunciation(raw)
        njd.plus_rules(raw)
        flag = raw[1].chain_flag if raw[1].chain_flag >= 0 else njd._joins(*raw)
        before = [replace(x, chain_flag=c) for x, c in ((b, 0), (t, flag))]
        raw[0].chain_flag, raw[1].chain_flag = 0, flag
        if self.options.filler_accent:
            postprocess.filler_accent(raw)
        splits = flag == 1 and raw[1].chain_flag == 0
        if splits:
            raw[1].chain_flag = 1
        if raw != before:
            out = _CHANGES
        elif flag != 1:
            out = _NEW
        else:
            # a chain rule that leaves every head as it is; what moves a nucleus in the word before
            rule = njd._rule(t.chain_rule, b.pos)
            moves = any(njd.combined_accent(rule, head, n, t.acc) != head for head in (0, 1, 3, -1) for n in (1, 2, 5))
            moves |= t.ctype in ("特殊・マス", "特殊・ナイ") or t.orig in postprocess.CHAINING_VERBS or bool(splits and t.acc)
            out = _MOVES if moves else _SPLITS if splits else _JOINS
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[pair] = out
        return out

    # forms -------------------------------------------------------------------

    def _pronounced(self, k: Kind, devoiced: int, voiceless: int, nucleus: int = 0) -> tuple[str, bool]:
        """The pronunciation with devoiced vowels, and whether the last one is; as :func:`njd.set_unvoiced_vowel`."""
        parts, t = k.moras, k.token
        n, at, out, last = len(parts), 0, [], bool(devoiced)
        for i, m in enumerate(parts):
            out.append(m)
            if m == "’":
                continue
            at += 1
            if i + 1 < n and parts[i + 1] == "’":
                last = True
            elif m not in njd._HIGH:
                last = False
            else:
                follows = parts[i + 1][:1] in njd._VOICELESS if i + 1 < n else voiceless
                last = bool(follows) and not last and t.pos != "フィラー" and (at != nucleus or m == "シ" and t.pos in ("動詞", "助動詞", "助詞"))
                if last:
                    out.append("’")
        return "".join(out), last

    def _form(self, k: Kind, code: int) -> Form:
        if k.token.acc and not code & 4:
            # a head with its nucleus: nothing that joins it moves that
            (out,), out.devoiced = self._phrase((k,), code & 12, code & 1, code & 2)
        else:
            pron, last = self._pronounced(k, code & 1, code & 2)
            t = _copy(k.token)
            t.pron, t.chain_flag = pron, (0, 1, -1, 0)[code >> 2]
            out = Form(t, phonemes_of(pron), last)
        k.flat[code] = out
        return out

    def _phrase(self, kinds: tuple[Kind, ...], first: int, devoiced: int, voiceless: int) -> tuple[list[Form], bool]:
        """Forms of a phrase that has an accent."""
        key = kinds, first, devoiced, voiceless
        found = self._phrases.get(key)
        if found is None:
            tokens = [_copy(k.token, int(i > 0)) for i, k in enumerate(kinds)]
            njd.set_accent_type(tokens)
            head, before, last = tokens[0].acc, 0, devoiced
            for i, (k, t) in enumerate(zip(kinds, tokens, strict=True)):
                nucleus = head - before if 0 < head - before <= k.count else 0
                t.pron, last = self._pronounced(k, last, kinds[i + 1].voiceless if i + 1 < len(kinds) else voiceless, nucleus)
                before += k.count
            o = self.options
            if o.filler_accent:
                postprocess.filler_accent(tokens)
            if o.retreat_accent:
                postprocess.retreat_accent(tokens)
            if o.accent_chaining:
                postprocess.accent_after_chaining(tokens)
            if first == _FIRST:
                tokens[0].chain_flag = -1
            found = [Form(t, phonemes_of(t.pron)) for t in tokens], bool(last)
            if len(self._phrases) >= PHRASES:
                self._phrases.clear()
            self._phrases[key] = found
        return found

    def _passed(self, kinds: list[Kind], first: bool) -> list[Token]:
        """Tokens of a stretch by the passes themselves."""
        tokens = njd.analyze([k.morph for k in kinds])
        if not first and tokens and tokens[0].chain_flag < 0:
            tokens[0].chain_flag = 0
        return self.rewrite(tokens)

    def _stretch(self, kinds: list[Kind], first: bool) -> tuple[list[Form], bool]:
        """Forms of a stretch by the passes themselves, and whether they are aligned with its morphemes."""
        tokens = self._passed(kinds, first)
        forms = [Form(t, own) for t, own in zip(tokens, alignment.spoken(tokens), strict=True)]
        entries = alignment.pairs(tokens, self.options.silent)
        aligned = [e.word for e in entries] == [k.morph.surface for k in kinds]
        if aligned:
            for f, e in zip(forms, entries, strict=True):
                f.rows["entry"] = e
        return forms, aligned

    def pieces(self, text: str, split: Callable[[str], list[str]]) -> list[str]:
        """A text in pieces that are segmented alone; ``split``: its sentences."""
        if self._cut_up is None or self._mixed and self._mixed(text):
            return [p for s in split(text) for p in (self._cut_up(s) if self._cut_up and not (self._mixed and self._mixed(s)) else [s] if s else ())]
        sentences = split(text) if self._cut_all is None or not self.options.split_sentences else None
        return self._cut_all(text) if sentences is None else [p for s in sentences for p in self._cut_up(s)]

    def tags(self, pieces: list[str]) -> Iterator[tuple[str, str, int]]:
        """Tags of all entries of a mapping: it has each pair and each ignored morpheme once, and no pair crosses the
        stretches.  Where no pass is made for a stretch, its entries are its words, with tags that no neighbour changes."""
        kinds, t, codes, bounds, hard = self._bounded(pieces)
        blanks = len(kinds) - len(t)
        if blanks:
            blank = tag(alignment.ignored(next(k for k in kinds if k.ignored).morph).token)
            yield from repeat(blank, blanks)
        at = 0
        for lo, hi in bounds:
            if max(hard[lo:hi]) >= _OWN or max(codes[lo + 1 : hi], default=0) >= _CHANGES:
                yield from map(_tag_of, t[at:lo])
                yield from [tag(e.token) for e in alignment.pairs(self._passed(t[lo:hi], lo == 0), self.options.silent)]
                at = hi
        yield from map(_tag_of, t[at:])

    def _bounded(self, pieces: list[str]):
        """All kinds, those of tokens with codes, the bounds of stretches, and what is hard of each token."""
        found = list(map(self._new.get, pieces))
        if None in found:
            found = [self._new.get(p) or self._kinds(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
        kinds: list[Kind] = list(chain.from_iterable(map(itemgetter(0), found)))
        t: list[Kind] = list(chain.from_iterable(map(itemgetter(1), found)))
        n = len(t)
        if not n:
            return kinds, t, [], [], []
        classes = list(map(_cls, t))
        get, pairs = self._pairs.get, list(zip(classes, islice(classes, 1, None), strict=False))
        codes = [_FIRST, *map(get, pairs)]
        if None in codes:
            codes = [_FIRST, *(self._pair(p) if (c := get(p)) is None else c for p in pairs)]
        hard = list(map(_hard, t))
        # stretches end with pauses; iteration marks look back until something is spoken
        ends = [i for i, (k, c) in enumerate(zip(t, islice(codes, 1, None), strict=False), 1) if k.cut and c == _NEW]
        ends.append(n)
        bounds: list[tuple[int, int]] = []
        start = 0
        if _MARK in hard:
            for end in ends:
                while bounds and _MARK in hard[start:end] and not t[start].spoken:
                    start = bounds.pop()[0]
                bounds.append((start, end))
                start = end
        else:
            bounds = list(zip([0, *ends], ends, strict=False))
        return kinds, t, codes, bounds, hard

    def analyze(self, pieces: list[str]) -> Text:
        kinds, t, codes, bounds, hard = self._bounded(pieces)
        forms: list[Form] = []
        aligned = True
        follows = list(map(_voiceless, islice(t, 1, None)))
        follows.append(0)
        for lo, hi in bounds:
            own = max(hard[lo:hi])
            moves = max(codes[lo + 1 : hi], default=0)
            if own >= _OWN or moves >= _CHANGES:
                some, ok = self._stretch(t[lo:hi], lo == 0)
                forms += some
                aligned &= ok
                continue
            last = 0
            if own < _ACCENTED and moves < _MOVES:
                for k, code, after in zip(t[lo:hi], codes[lo:hi], follows[lo:hi], strict=True):
                    code += after + last
                    f = k.flat[code] or self._form(k, code)
                    last = f.devoiced
                    forms.append(f)
                continue
            at = lo
            while at < hi:
                end = at + 1
                while end < hi and codes[end] != _NEW:
                    end += 1
                inner = codes[at + 1 : end]
                if hard[at] or _MOVES in inner or _SPLITS in inner and any(hard[at:end]):
                    some, last = self._phrase(tuple(t[at:end]), codes[at], int(last), follows[end - 1])
                    forms += some
                else:
                    for i in range(at, end):
                        k, code = t[i], codes[i] + follows[i] + last
                        f = k.flat[code] or self._form(k, code)
                        last = f.devoiced
                        forms.append(f)
                at = end
        return Text(kinds, forms, aligned)
