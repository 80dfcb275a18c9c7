"""Whole texts to token ids with the ``tokenizers`` library, at corpus speed.

A byte-level BPE splits a text into pieces before it merges, so a text's ids
are the ids of its pieces joined, and cutting at single spaces gives the
library's own piece borders except inside runs of white space and at added
tokens, which the library matches in the text before it splits.  Words repeat far
more often than texts, so ``Encoder`` works on columns: it cuts a batch of texts
into words, numbers the different ones, asks the library for those it does not
keep (it keeps what occurred twice at a time), and gathers the ids of all words.  Texts that may not be cut (and other
kinds of tokenizer) go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker; when full, the table starts again.
CACHE_ENTRIES = 300_000
#: Bytes of text that are cut at a time, and words that are given to the library at a time.
SLICE_BYTES = 8 << 20
WORDS_AT_ONCE = 200
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path(name: str) -> str:
    """An absolute path stays; a bare name is looked up among the public tokenizers."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: Stands before a text's first word, which has no space before it.
_FIRST = "\x01"
#: White space, a space and white space or the end: cutting there would move a piece border.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AWKWARD = rf"{_WHITE} (?:{_WHITE}|\z)"


class Encoder:
    """Ids of whole texts; ``encode_many`` for columns, ``encode`` for one text."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.uncut = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + [_FIRST]
        self.vocab_size = self.tokenizer.get_vocab_size()
        # bytes that each id stands for: one character of the byte alphabet each
        self.n_bytes = np.zeros(self.vocab_size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)
        kind = repr(self.tokenizer.pre_tokenizer)
        self.cuts = kind.startswith("ByteLevel") and "add_prefix_space=False" in kind and "use_regex=True" in kind and self.tokenizer.normalizer is None
        self.kept: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _library(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each with the space before it, one after another, and how many each has.

        Words that neither are empty nor end in white space are given to the library as running text.
        """
        apart = pc.or_(pc.or_(pc.starts_with(words, _FIRST), pc.equal(words, "")), pc.match_substring_regex(words, _WHITE + r"\z")).to_numpy(zero_copy_only=False)
        shown = pc.replace_substring(pc.binary_join_element_wise(" ", words, ""), " " + _FIRST, "")
        joined = shown.filter(pa.array(~apart)).to_pylist()
        runs = ["".join(joined[k : k + WORDS_AT_ONCE]) for k in range(0, len(joined), WORDS_AT_ONCE)]
        ids = [np.asarray(x.ids, dtype="<u4") for k in range(0, len(runs), 64) for x in self.tokenizer.encode_batch_fast(runs[k : k + 64], add_special_tokens=False)]
        ids = np.concatenate([*ids, np.zeros(0, dtype="<u4")])
        # a word's ids end where its bytes end
        ends = np.cumsum(pc.binary_length(shown.filter(pa.array(~apart))).to_numpy().astype(np.int64))
        stop = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
        size = np.zeros(len(words), dtype=np.int64)
        size[~apart] = np.diff(stop, prepend=0)
        if not apart.any():
            return ids, size
        parts, done = [], 0
        before = np.cumsum(size) - size
        for i in np.flatnonzero(apart).tolist():
            own = self._whole(shown[i].as_py())
            parts += [ids[done : before[i]], own]
            size[i], done = len(own), before[i]
        return np.concatenate([*parts, ids[done:]]), size

    def _words(self, words: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, size): the ids of each different word; ``count``: how often it occurs."""
        names = words.to_pylist()
        found = list(map(self.kept.get, names))
        known = np.array([x is not None for x in found], dtype=bool)
        held = [x for x in found if x is not None]
        size = np.empty(len(names), dtype=np.int64)
        size[known] = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // 4
        ids, size[~known] = self._library(words.filter(pa.array(~known)))
        flat = np.concatenate([np.frombuffer(b"".join(held), dtype="<u4"), ids])
        start = np.empty_like(size)
        start[known] = np.cumsum(size[known]) - size[known]
        start[~known] = np.cumsum(size[~known]) - size[~known] + size[known].sum()
        again = np.flatnonzero(~known & (count > 1))
        if len(self.kept) + len(again) > CACHE_ENTRIES:
            self.kept.clear()
        for i, a, n in zip(again.tolist(), start[again].tolist(), size[again].tolist(), strict=True):
            self.kept[names[i]] = flat[a : a + n].tobytes()
        return flat, start, size

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.binary_join_element_wise(_FIRST, texts, ""), " ")
        words = lists.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        flat, start, size = self._words(words.dictionary, np.bincount(at, minlength=len(words.dictionary)))
        count = size[at]
        border = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(border[-1], dtype="<u4")
        for lo in range(0, len(at), 1 << 18):  # places of a run of words at a time
            hi = min(len(at), lo + (1 << 18))
            base, n = border[lo], count[lo:hi]
            out[base : border[hi]] = flat[np.repeat(start[at[lo:hi]] - (border[lo:hi] - base), n) + np.arange(border[hi] - base)]
        first = lists.offsets.to_numpy()
        return out, border[first - first[0]]

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and the borders between them; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.cuts:
            whole = pa.array(np.ones(len(texts), dtype=bool))
        else:
            whole = pc.match_substring_regex(texts, _AWKWARD)
            for x in self.uncut:
                whole = pc.or_(whole, pc.match_substring(texts, x))
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        ids, border = self._cut(pc.if_else(whole, "", texts) if len(alone) else texts) if len(texts) else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        if not len(alone):
            return ids, border
        size, parts, done = np.diff(border), [], 0
        for j in alone.tolist():
            own = self._whole(texts[j].as_py())
            parts += [ids[done : border[j]], own]
            size[j], done = len(own), border[j]
        return np.concatenate([*parts, ids[done:]]), np.concatenate(([0], np.cumsum(size)))

    def encode(self, text: str | None) -> bytes:
        """The ids of one whole text as little-endian uint32 bytes."""
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()


def ended(ids: np.ndarray, border: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after every text."""
    border = border + np.arange(len(border))
    out = np.empty(border[-1], dtype="<u4")
    last = np.zeros(len(out), dtype=bool)
    last[border[1:] - 1] = True
    out[last], out[~last] = end_id, ids
    return out, border


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE_BYTES of text in ``column``."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    run = (np.cumsum(size) - size) // SLICE_BYTES
    cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(size)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = DEFAULT_TOKENIZER) -> Encoder:
    """One encoder per Python worker and tokenizer."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
