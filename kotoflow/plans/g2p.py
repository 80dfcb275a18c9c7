"""Text analysis as column functions: one Arrow UDF per requested family, nothing shuffled.

    from kotoflow.plans.g2p import G2P
    df.select(G2P().phonemes("text"), G2P(Options(predict_nani=False)).mapping("text"))

A text is null-safe: null gives null, empty gives an empty result.  A text with a
NUL character or longer than the limit is null (or raises, with mode FAILFAST).
"""

from __future__ import annotations

import gc
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from kotoflow.functions import kana
from kotoflow.operators import alignment, labels, lattice, nani, njd, postprocess, typed
from kotoflow.operators.njd import Token
from kotoflow.plans.options import Options
from kotoflow.sources import lexicon as lex

_S, _I, _B = StringType(), IntegerType(), BooleanType()


def _struct(**fields) -> StructType:
    out = StructType()
    for k, v in fields.items():
        out.add(k, v)
    return out


TOKEN = _struct(string=_S, pos=_S, pos_group1=_S, pos_group2=_S, pos_group3=_S, ctype=_S, cform=_S, orig=_S, read=_S, pron=_S, acc=_I, mora_size=_I, chain_rule=_S, chain_flag=_I)
MORPH = _struct(surface=_S, feature=_S, left_id=_I, right_id=_I, pos_id=_I, word_cost=_I, is_unknown=_B, is_ignored=_B)
PAIR = _struct(word=_S, phonemes=ArrayType(_S))
MAP = _struct(word=_S, phonemes=ArrayType(_S), is_unknown=_B, is_ignored=_B)
DETAIL = _struct(
    word=_S, phonemes=ArrayType(_S), features=ArrayType(_S), pos=_S, pos_group1=_S, pos_group2=_S, pos_group3=_S, ctype=_S, cform=_S, orig=_S, read=_S, pron=_S,
    accent_nucleus=_I, mora_count=_I, chain_rule=_S, chain_flag=_I, is_unknown=_B, is_ignored=_B,
)

DIGEST = _struct(labels=_I, md5=_S)
SPEECH = _struct(pos=_S, pos_group1=_S, words=LongType(), morae=LongType())


RESULTS = {"mecab": ArrayType(MORPH), "njd": ArrayType(TOKEN), "phonemes": ArrayType(_S), "fullcontext": ArrayType(_S), "pairs": ArrayType(PAIR), "mapping": ArrayType(MAP), "mapping_detailed": ArrayType(DETAIL)}


class AnalysisError(ValueError):
    """A text that cannot be analyzed."""


class Engine:
    """Analysis of single texts; immutable, one per worker, options and lexicon version."""

    def __init__(self, options: Options, paths: tuple[str, ...], key: str, second: tuple[str, ...] | None, nani_model: tuple[str, str] | None = None):
        self.is_nan = nani.model(nani_model)
        self.options, self.lexicon = options, lex.load(paths, key)
        self.second = lex.load(second, key) if second else None
        #: the text analyzed last, its morphemes, and its tokens by order of the rewrites
        self._last: tuple[str | None, list, dict[bool, list[Token]]] = None, [], {}
        #: the same by kinds of morphemes, where that applies
        self.typed = typed.Typed(self.lexicon, options, self.rewrite) if typed.applies(options, self.lexicon, self.second) else None
        self._last_typed: tuple[str | None, typed.Text | None] = None, None

    def guard(self, text: str) -> str:
        if "\0" in text:
            raise AnalysisError(f"interior NUL at byte {len(text[: text.index(chr(0))].encode())}")
        if self.options.normalize:
            text = unicodedata.normalize(self.options.normalize, text)
        wide = kana.py_widen_ascii(text)
        if not self.options.split_sentences and len(wide.encode("utf-8", "surrogatepass")) >= self.options.max_bytes:
            raise AnalysisError(f"text too long: {len(wide.encode('utf-8', 'surrogatepass'))} bytes")
        return wide

    def sentences(self, wide: str) -> list[str]:
        return re.findall(r"[^。！？\n]*[。！？\n]?", wide)[:-1] if self.options.split_sentences else [wide]

    def morphs(self, text: str) -> list[lattice.Morph]:
        return [m for s in self.sentences(self.guard(text)) if s for m in lattice.segment(s, self.lexicon)]

    def plain(self, text: str) -> list[Token]:
        """The base analysis, without rewrites."""
        return njd.analyze([m for m in lattice.segment(text, self.lexicon) if not m.is_ignored])

    def tokens(self, morphs: list[lattice.Morph], revert_last: bool = False) -> list[Token]:
        """Tokens after all rewrites that the options ask for."""
        kept = [k for k, m in enumerate(morphs) if not m.is_ignored]
        return self.rewrite(njd.analyze([morphs[k] for k in kept], kept), morphs, revert_last)

    def rewrite(self, t: list[Token], morphs: list[lattice.Morph] = (), revert_last: bool = False) -> list[Token]:
        """The rewrites alone; ``morphs`` are what second readings are looked up for."""
        o = self.options
        revert = (o.use_read_as_pron, o.revert_long_vowels, o.revert_yotsugana)
        if any(revert) and not revert_last:
            postprocess.revert_pron(t, *revert)
        if o.filler_accent:
            postprocess.filler_accent(t)
        if o.predict_nani:
            postprocess.nani_reading(t, self.is_nan)
        if o.second_readings and self.second is not None:
            postprocess.second_readings(t, self._second("".join(m.surface for m in morphs)))
        if o.retreat_accent:
            postprocess.retreat_accent(t)
        if o.accent_chaining:
            postprocess.accent_after_chaining(t)
        if o.odoriji:
            t = postprocess.iteration_marks(t, self.plain)
        if any(revert) and revert_last:
            postprocess.revert_pron(t, *revert)
        return t

    def _second(self, text: str) -> list[tuple[int, str, str]]:
        out, at = [], 0
        for m in lattice.segment(text, self.second):
            f = m.feature.split(",")
            if not m.is_unknown and len(f) > 7:
                out.append((at, m.surface, f[7]))
            at += len(m.surface)
        return out

    def analyzed(self, text: str, revert_last: bool = False) -> tuple[list[lattice.Morph], list[Token]]:
        """Morphemes and tokens; several results of one text are made from one analysis."""
        if self._last[0] != text:
            self._last = text, self.morphs(text), {}
        _, morphs, tokens = self._last
        if revert_last not in tokens:
            tokens[revert_last] = self.tokens(morphs, revert_last)
        return morphs, tokens[revert_last]

    def by_kind(self, text: str) -> typed.Text | None:
        """The analysis by kinds of morphemes; None where that does not apply."""
        if self.typed is None:
            return None
        if self._last_typed[0] != text:
            self._last_typed = text, self.typed.analyze(self.typed.pieces(self.guard(text), self.sentences))
        return self._last_typed[1]

    # results: rows are shared, and so to be read only ---------------------------

    def njd(self, text):
        x = self.by_kind(text)
        if x is None:
            return [_row(TOKEN, t) for t in self.analyzed(text)[1]]
        return [f.rows.get("njd") or f.rows.setdefault("njd", _row(TOKEN, f.token)) for f in x.forms]

    def mecab(self, text):
        x = self.by_kind(text)
        if x is None:
            return [_morph_row(m) for m in self.analyzed(text)[0]]
        return [k.rows.get("mecab") or k.rows.setdefault("mecab", _morph_row(k.morph)) for k in x.kinds]

    def phonemes(self, text):
        x = self.by_kind(text)
        if x is None:
            return alignment.flat_phonemes(self.analyzed(text)[1])
        return alignment.joined((f.phonemes, f.pause) for f in x.forms)

    def fullcontext(self, text):
        x = self.by_kind(text)
        if x is None:
            return labels.make_labels(self.analyzed(text)[1])
        return labels.labels_of(x.spoken())

    def fullcontext_digest(self, text):
        """Number and MD5 of the labels, which are made and let go word by word."""
        x = self.by_kind(text)
        return dict(zip(DIGEST.names, labels.digest(labels.items(self.analyzed(text)[1]) if x is None else x.spoken()), strict=True))

    def kana_per_word(self, text):
        x = self.by_kind(text)
        if x is None:
            return [_kana(t) for t in self.analyzed(text)[1]]
        return [k if (k := f.rows.get("kana")) is not None else f.rows.setdefault("kana", _kana(f.token)) for f in x.forms]

    def kana(self, text):
        return "".join(self.kana_per_word(text))

    def pairs(self, text):
        x = self.by_kind(text)
        if x is not None and x.aligned:
            return [f.rows.get("pairs") or f.rows.setdefault("pairs", _pair_row(self._entry(f))) for f in x.forms]
        return [_pair_row(e) for e in alignment.pairs(self.analyzed(text)[1] if x is None else x.tokens(), self.options.silent)]

    def _entry(self, f: typed.Form) -> alignment.Entry:
        """The entry of a token that stands for one morpheme."""
        e = f.rows.get("entry")
        if e is None:
            own = ["pau"] if f.pause and f.token.string not in self.options.silent else list(f.phonemes)
            e = f.rows["entry"] = alignment.Entry(f.token.string, own, token=f.token)
        return e

    def _entries(self, text, detailed, row):
        # the flat mapping reverts readings after the rewrites, every other result before them
        x = self.by_kind(text)
        if x is None or not x.aligned:
            m, t = self.analyzed(text, revert_last=not detailed) if x is None else ([k.morph for k in x.kinds], x.tokens())
            return [row(e) for e in alignment.mapping(alignment.pairs(t, self.options.silent), m, detailed)]
        out, at = [], 0
        for k in x.kinds:
            if k.ignored:
                found = k.rows.get(detailed)
                if found is None:
                    found = k.rows[detailed] = row(alignment.ignored(k.morph))
            else:
                key, rows = (detailed, k.morph.is_unknown), x.forms[at].rows
                found = rows.get(key)
                if found is None:
                    found = rows[key] = row(alignment.finished(self._entry(x.forms[at]), k.morph.is_unknown, detailed))
                at += 1
            out.append(found)
        return out

    def mapping(self, text):
        return self._entries(text, False, _map_row)

    def mapping_detailed(self, text):
        return self._entries(text, True, _detail_row)

    def parts_of_speech(self, text):
        """Words and morae of the detailed mapping, by part of speech."""
        counts: Counter[tuple[str, str, int]] = Counter()
        if self.typed is None:
            counts.update(self._entries(text, True, _speech))
        else:
            counts.update(self.typed.tags(self.typed.pieces(self.guard(text), self.sentences)))
        out: dict[tuple[str, str], list[int]] = {}
        for (pos, group, morae), n in counts.items():
            have = out.setdefault((pos, group), [0, 0])
            have[0] += n
            have[1] += n * morae
        return [dict(zip(SPEECH.names, (*key, *have), strict=True)) for key, have in out.items()]

    def together(self, text, names: tuple[str, ...]):
        return {name: getattr(self, name)(text) for name in names}


def _row(schema: StructType, t: Token) -> dict:
    return {k: getattr(t, k) for k in schema.names}


def _morph_row(m: lattice.Morph) -> dict:
    return {"surface": m.surface, "feature": f"{m.surface},{m.feature}", "left_id": m.left_id, "right_id": m.right_id, "pos_id": m.pos_id, "word_cost": m.cost, "is_unknown": m.is_unknown, "is_ignored": m.is_ignored}


def _kana(t: Token) -> str:
    """As ``token_rules.kana_words``: symbols as written, others as pronounced."""
    return t.string if t.pos == "記号" else t.pron.replace("’", "")


def _pair_row(e: alignment.Entry) -> dict:
    return {"word": e.word, "phonemes": e.phonemes or []}


def _map_row(e: alignment.Entry) -> dict:
    return {"word": e.word, "phonemes": e.phonemes, "is_unknown": e.is_unknown, "is_ignored": e.is_ignored}


def _detail_row(e: alignment.Entry) -> dict:
    t = e.token or Token(e.word)
    row = _row(TOKEN, t)
    kept = {k: row[k] for k in ("pos", "pos_group1", "pos_group2", "pos_group3", "ctype", "cform", "orig", "read", "pron", "chain_rule", "chain_flag")}
    known = [e.word, t.pos, t.pos_group1, t.pos_group2, t.pos_group3, t.ctype, t.cform, t.orig]
    features = known if e.is_unknown else [*known, t.read, t.pron, f"{t.acc}/{t.mora_size}", t.chain_rule]
    return {"word": e.word, "phonemes": e.phonemes, "features": features, "accent_nucleus": t.acc, "mora_count": t.mora_size, "is_unknown": e.is_unknown, "is_ignored": e.is_ignored} | kept


def _speech(e: alignment.Entry) -> tuple[str, str, int]:
    return typed.tag(e.token or Token(e.word))


#: Items (phonemes, rows, labels) of the results that one Arrow batch holds, about; labels are long.
BATCH_ITEMS, BATCH_LABELS = 50_000, 40_000
#: Items of results that are kept for texts that come again.
KEPT_ITEMS = 50_000


def _arrow(values: list, kind) -> pa.Array:
    """Results as an Arrow array; rows that several results share are converted once."""
    if isinstance(kind, StructType):
        given = [v if v is not None else dict.fromkeys(kind.names) for v in values]
        return pa.StructArray.from_arrays([_arrow([v[f.name] for v in given], f.dataType) for f in kind.fields], names=kind.names)
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)):
        return pa.array(values, to_arrow_type(kind))
    places: dict[int, int] = {}
    at = [places.setdefault(id(r), len(places)) for v in values if v for r in v]
    rows = {id(r): r for v in values if v for r in v}
    once = pa.array([rows[i] for i in places], to_arrow_type(kind.elementType))
    ends = np.concatenate(([0], np.cumsum([len(v) if v else 0 for v in values]))).astype(np.int32)
    mask = pa.array([v is None for v in values], pa.bool_()) if any(v is None for v in values) else None
    return pa.ListArray.from_arrays(pa.array(ends), once.take(pa.array(at, pa.int32())), mask=mask)


def _items(value) -> int:
    return 1 if value is None or isinstance(value, (str, int)) else sum(map(_items, value.values())) if isinstance(value, dict) else 1 + len(value)


@lru_cache(maxsize=8)
def engine(options: Options, paths: tuple[str, ...], key: str, second: tuple[str, ...] | None, nani_model: tuple[str, str] | None = None) -> Engine:
    return Engine(options, paths, key, second, nani_model)


class G2P:
    """Column functions for one set of options and lexicons (a user lexicon is one more path)."""

    def __init__(self, options: Options = Options(), lexicons: tuple[str, ...] = (lex.DEFAULT_LEXICON,), second: tuple[str, ...] | None = None, nani_model: tuple[str, str] | None = None):  # noqa: B008
        self.options, self.lexicons, self.second, self.nani_model = options, tuple(lexicons), second, nani_model
        self.key = lex.version(self.lexicons + tuple(second or ()))

    def _apply(self, c: Column | str, method: str, kind, *more) -> Column:
        args = (self.options, self.lexicons, self.key, self.second, self.nani_model)
        options = self.options

        most = BATCH_LABELS if "fullcontext" in (method, *(more[0] if more else ())) else BATCH_ITEMS

        def run(batches):
            e = engine(*args)
            seen: dict[str, object] = {}
            kept = 0
            # nothing here makes reference cycles, and looking for them among all kept words takes longer than the analysis
            gc.disable()
            for s in batches:
                out, items = [], 0
                for text in s:
                    text = text.as_py()
                    if text is None:
                        out.append(None)
                        continue
                    if text in seen:
                        found = seen[text]
                    else:
                        try:
                            found = getattr(e, method)(text, *more)
                        except AnalysisError:
                            if options.mode == "FAILFAST":
                                raise
                            found = None
                        n = _items(found)
                        if kept + n > KEPT_ITEMS:
                            seen.clear()
                            kept = 0
                        if n <= KEPT_ITEMS // 8:
                            seen[text] = found
                            kept += n
                    out.append(found)
                    items += _items(found)
                    if items >= most:
                        yield _arrow(out, kind)
                        out, items = [], 0
                if out:
                    yield _arrow(out, kind)
            gc.enable()

        run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, kind)(F.col(c) if isinstance(c, str) else c)

    def mecab(self, c) -> Column:
        return self._apply(c, "mecab", ArrayType(MORPH))

    def njd(self, c) -> Column:
        return self._apply(c, "njd", ArrayType(TOKEN))

    def phonemes(self, c) -> Column:
        return self._apply(c, "phonemes", ArrayType(_S))

    def fullcontext(self, c) -> Column:
        return self._apply(c, "fullcontext", ArrayType(_S))

    def fullcontext_digest(self, c) -> Column:
        """``labels`` and ``md5``: the size of ``fullcontext``, and the MD5 of its labels joined by line feeds; both null where that is null."""
        return self._apply(c, "fullcontext_digest", DIGEST)

    def parts_of_speech(self, c) -> Column:
        """``words`` and ``morae`` of ``mapping_detailed`` by ``pos`` and ``pos_group1``."""
        return self._apply(c, "parts_of_speech", ArrayType(SPEECH))

    def pairs(self, c) -> Column:
        return self._apply(c, "pairs", ArrayType(PAIR))

    def mapping(self, c) -> Column:
        return self._apply(c, "mapping", ArrayType(MAP))

    def mapping_detailed(self, c) -> Column:
        return self._apply(c, "mapping_detailed", ArrayType(DETAIL))

    def together(self, c, *results: str) -> Column:
        """A struct of several results (``mecab``, ``njd``, ``phonemes``, ``fullcontext``, ``pairs``, ``mapping``,
        ``mapping_detailed``) from one analysis of each text; all fields are null where a text has no result."""
        return self._apply(c, "together", StructType([StructField(name, RESULTS[name]) for name in results]), tuple(results))

    def kana(self, c) -> Column:
        return self._apply(c, "kana", _S)

    def kana_per_word(self, c) -> Column:
        return self._apply(c, "kana_per_word", ArrayType(_S))

    # native over the results above

    def phonemes_per_word(self, c) -> Column:
        return F.transform(self.pairs(c), lambda x: x["phonemes"])

    def phonemes_detailed(self, c) -> Column:
        return F.flatten(F.transform(self.mapping(c), lambda x: x["phonemes"]))

    def register(self, spark, prefix: str = "g2p") -> None:
        """SQL names: g2p, g2p_mapping, g2p_mapping_detailed, g2p_pairs, g2p_njd, g2p_fullcontext."""
        for name, method, kind in (("", "phonemes", ArrayType(_S)), ("_mapping", "mapping", ArrayType(MAP)), ("_mapping_detailed", "mapping_detailed", ArrayType(DETAIL)), ("_pairs", "pairs", ArrayType(PAIR)), ("_njd", "njd", ArrayType(TOKEN)), ("_fullcontext", "fullcontext", ArrayType(_S))):
            args, options = (self.options, self.lexicons, self.key, self.second, self.nani_model), self.options

            def one(s: pd.Series, method=method, args=args, options=options) -> pd.Series:
                e = engine(*args)

                def result(text):
                    try:
                        return getattr(e, method)(text)
                    except AnalysisError:
                        if options.mode == "FAILFAST":
                            raise
                        return None

                return pd.Series([None if t is None else result(t) for t in s], dtype=object)

            one.__annotations__ = {"s": pd.Series, "return": pd.Series}
            spark.udf.register(prefix + name, F.pandas_udf(lambda s, f=one: f(s), kind, F.PandasUDFType.SCALAR))
