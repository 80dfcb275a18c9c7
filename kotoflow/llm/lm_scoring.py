"""Language-model scoring by cross-entropy difference.

Two matched n-gram models - same vocabulary, order and smoothing - are counted
over whole texts: *target* over the chosen documents, *background* over all.  The
vocabulary is that of a public tokenizer, so no text has unknown tokens; n-grams are
bigrams, a text's first token following a start mark.  Bigrams and unigrams are
interpolated (Witten-Bell) with the uniform distribution below.  A document's score
is its mean loss per token under the target model less that under the background
model; lower is closer to the target.

Every document is scored with its own counts taken out of both models, so that
neither model has seen the text it judges: a text that occurs twice in the corpus
is still known to the background, one that occurs once is not.

The models grow with the corpus and are never collected.  Texts are encoded once
into *blocks*; each block sends its different bigrams, with their counts, to
*shards* of the model (by the bigram's first token), which add them up and send
back the totals of exactly the block's bigrams.  So what travels is one entry for
each different bigram of a block, not one for each token; a common bigram is one
entry a block.  The driver sees per-token totals only (as many as the vocabulary).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotoflow.llm.common import Tables
from kotoflow.llm.near_dup import mix
from kotoflow.llm.tokens import DEFAULT_TOKENIZER, encoder, sliced

#: Tokens of one block, about (a longer text is a block by itself), and of the corpus for each shard of the model.
BLOCK_TOKENS = 4_000_000
SHARD_TOKENS = 8_000_000
#: Tokens that are scored at a time, about (a longer text is scored by itself).
SCORE_TOKENS = 500_000
#: Entries that a shard gathers before it adds equal bigrams up.
COMPACT = 4_000_000


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _blocks(docs: DataFrame, is_target: Column, id_col: str, text_col: str, tokenizer: str) -> DataFrame:
    """``block, names, chosen, border, ids``: encoded texts, many to a row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        enc, block = encoder(tokenizer), TaskContext.get().partitionId() << 32
        width = "<u2" if enc.vocab_size <= 65536 else "<u4"
        names, chosen, sizes, ids, held = [], [], [], [], 0

        def close():
            nonlocal names, chosen, sizes, ids, held, block
            name = pa.concat_arrays(names)
            border = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            out = _batch(
                block=pa.array([block], pa.int64()),
                names=pa.ListArray.from_arrays(pa.array([0, len(name)], pa.int32()), name),
                chosen=pa.array([np.concatenate(chosen).tobytes()], pa.binary()),
                border=pa.array([border.astype("<i8").tobytes()], pa.binary()),
                ids=pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                n_tokens=pa.array([held], pa.int64()),
            )
            names, chosen, sizes, ids, held, block = [], [], [], [], 0, block + 1
            return out

        for batch in batches:
            for part in sliced(batch, 1):
                flat, border = enc.encode_many(part.column(1))
                names.append(part.column(0))
                chosen.append(part.column(2).to_numpy(zero_copy_only=False).astype(np.uint8))
                sizes.append(np.diff(border))
                ids.append(flat.astype(width))
                held += len(flat)
                if held >= BLOCK_TOKENS:
                    yield close()
        if names:
            yield close()

    texts = docs.select(F.col(id_col).alias("name"), F.col(text_col).cast("string").alias("text"), F.coalesce(is_target, F.lit(False)).alias("chosen"))
    return texts.mapInArrow(rows, f"block long, names array<{kind}>, chosen binary, border binary, ids binary, n_tokens long")


def _bigrams(ids: np.ndarray, border: np.ndarray, vocab: int) -> np.ndarray:
    """Code of the bigram that ends at each token: history * (vocab + 1) + token; the start mark is token ``vocab``."""
    code = np.empty(len(ids), dtype=np.uint32 if (vocab + 1) ** 2 <= 2**32 else np.uint64)
    code[1:] = ids[:-1]
    code[border[:-1][np.diff(border) > 0]] = vocab
    return code * code.dtype.type(vocab + 1) + ids.astype(code.dtype)


def _read(ids, border, chosen, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    border = np.frombuffer(border.as_py(), dtype="<i8")
    ids = np.frombuffer(ids.as_py(), dtype="<u2" if vocab <= 65536 else "<u4")
    return ids, border, np.frombuffer(chosen.as_py(), dtype=np.uint8).astype(bool)


def _shards(codes: np.ndarray, vocab: int, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of ascending codes, by history."""
    own = (mix((codes // codes.dtype.type(vocab + 1)).astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
        yield int(own[order[a]]), order[a:b]


def _requests(blocks: DataFrame, vocab: int, shards: int) -> DataFrame:
    """``shard, block, codes, b, t``: a block's different bigrams with their counts in all and in chosen texts."""

    def rows(batches):
        for batch in batches:
            for block, ids, border, chosen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                ids, border, chosen = _read(ids, border, chosen, vocab)
                code = _bigrams(ids, border, vocab)
                codes, b = np.unique(code, return_counts=True)
                own, n = np.unique(code[np.repeat(chosen, np.diff(border))], return_counts=True)
                t = np.zeros(len(codes), dtype=np.int64)
                t[np.searchsorted(codes, own)] = n
                for shard, at in _shards(codes, vocab, shards):
                    yield _batch(
                        shard=pa.array([shard], pa.int32()), block=pa.array([block], pa.int64()), codes=pa.array([codes[at].tobytes()], pa.binary()), b=pa.array([b[at].astype("<u4").tobytes()], pa.binary()), t=pa.array([t[at].astype("<u4").tobytes()], pa.binary())
                    )

    return blocks.select("block", "ids", "border", "chosen").mapInArrow(rows, "shard int, block long, codes binary, b binary, t binary")


def _added(codes: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, b, t
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(b[order], first), np.add.reduceat(t[order], first)


_MODEL = "kind int, shard int, id long, b long, t long, kb long, kt long, codes binary, cb binary, ct binary"


def _model(requests: DataFrame, vocab: int) -> DataFrame:
    """Kind 0: a shard's bigrams and totals.  Kind 1: totals and kinds of successors of a history; kind 2: totals of a token in the shard."""
    dtype = np.uint32 if (vocab + 1) ** 2 <= 2**32 else np.uint64

    def stats(kind, name, b, t, kb, kt):
        n = len(name)
        none = pa.nulls(n, pa.binary())
        cols = {"kind": np.full(n, kind, np.int32), "shard": np.full(n, -1, np.int32), "id": name.astype(np.int64), "b": b, "t": t, "kb": kb, "kt": kt}
        return _batch(**{k: pa.array(x) for k, x in cols.items()}, codes=none, cb=none, ct=none)

    def rows(batches):
        now, held, size = None, [], 0

        def compact():
            nonlocal held, size
            held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = len(held[0][0])

        def close():
            nonlocal held, size
            compact()
            codes, b, t = held[0]
            one = lambda x: pa.array([x], pa.int64())
            yield _batch(kind=pa.array([0], pa.int32()), shard=pa.array([now], pa.int32()), id=one(None), b=one(None), t=one(None), kb=one(None), kt=one(None), codes=pa.array([codes.tobytes()], pa.binary()), cb=pa.array([b.tobytes()], pa.binary()), ct=pa.array([t.tobytes()], pa.binary()))
            h, w = codes // dtype(vocab + 1), codes % dtype(vocab + 1)
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            add = lambda x: np.add.reduceat(x.astype(np.int64), first)
            yield stats(1, h[first], add(b), add(t), add(b > 0), add(t > 0))
            w, wb, wt = _added(w, b, t)
            yield stats(2, w, wb, wt, np.zeros_like(wb), np.zeros_like(wt))
            held, size = [], 0

        for batch in batches:
            for shard, codes, b, t in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                if shard != now and held:
                    yield from close()
                now = shard
                held.append((np.frombuffer(codes.as_py(), dtype), np.frombuffer(b.as_py(), "<u4").astype(np.int64), np.frombuffer(t.as_py(), "<u4").astype(np.int64)))
                size += len(held[-1][0])
                if size > COMPACT and len(held) > 1:
                    compact()
        if held:
            yield from close()

    asked = requests.select("shard", "codes", "b", "t").repartition("shard").sortWithinPartitions("shard")
    return asked.mapInArrow(rows, _MODEL)


def _replies(requests: DataFrame, model: DataFrame, vocab: int) -> DataFrame:
    """``block, ord, cb, ct``: the model's totals for the bigrams that each block asked each shard for."""
    dtype = np.uint32 if (vocab + 1) ** 2 <= 2**32 else np.uint64

    def rows(batches):
        known = None
        for batch in batches:
            for shard, block, codes, cb, ct in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                codes = np.frombuffer(codes.as_py(), dtype)
                if block < 0:
                    known = codes, np.frombuffer(cb.as_py(), np.int64), np.frombuffer(ct.as_py(), np.int64)
                    continue
                at = np.searchsorted(known[0], codes)
                yield _batch(block=pa.array([block], pa.int64()), ord=pa.array([shard], pa.int32()), cb=pa.array([known[1][at].tobytes()], pa.binary()), ct=pa.array([known[2][at].tobytes()], pa.binary()))

    none = F.lit(None).cast("binary")
    asked = requests.select("shard", "block", "codes", none.alias("cb"), none.alias("ct"))
    shard = model.where("kind = 0").select("shard", F.lit(-1).cast("long").alias("block"), "codes", "cb", "ct")
    return asked.unionAll(shard).repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(rows, "block long, ord int, cb binary, ct binary")


class _Losses:
    """Losses of a block's documents under one model, each without its own counts."""

    def __init__(self, own: dict[str, np.ndarray], total: int, kinds: int, vocab: int):
        self.h, self.w, self.k, self.total, self.kinds, self.vocab = own["h"], own["w"], own["k"], total, kinds, vocab

    def of(self, part: dict[str, np.ndarray], count: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Mean loss of each document; ``mine`` is 1 where the document is part of the model."""
        doc, h, w, n = part["doc"], part["h"], part["w"], part["n"]
        own = mine[doc]
        one = self.w[w] - own * part["nw"] + self.kinds / self.vocab
        one = one / (self.total - own * part["size"][doc] + self.kinds) if self.kinds else np.full(len(w), 1 / self.vocab)
        gone = np.add.reduceat(((count == n) & (own > 0)).astype(np.int64), part["run"])  # successors seen in this document alone
        kinds = self.k[h] - np.repeat(gone, part["run_size"])
        seen = self.h[h] - own * part["nh"]
        two = np.where(seen > 0, (count - own * n + kinds * one) / np.where(seen > 0, seen + kinds, 1), one)
        return np.bincount(doc, weights=-np.log(two) * n, minlength=len(mine)) / np.maximum(part["size"], 1)


def _own_counts(ids: np.ndarray, border: np.ndarray, code: np.ndarray, vocab: int) -> dict[str, np.ndarray]:
    """A row for each document and different bigram: counts of the bigram (n), its history (nh) and its token (nw) in the document."""
    size = np.diff(border)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((code, doc))
    d, c = doc[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]))))
    n = np.diff(np.append(first, len(d)))
    d, c = d[first], c[first]
    h, w = (c // c.dtype.type(vocab + 1)).astype(np.int64), (c % c.dtype.type(vocab + 1)).astype(np.int64)
    run = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))))
    run_size = np.diff(np.append(run, len(d)))
    nh = np.repeat(np.add.reduceat(n, run), run_size)
    words, count = np.unique(doc * np.int64(vocab + 1) + ids, return_counts=True)
    nw = count[np.searchsorted(words, d * np.int64(vocab + 1) + w)]
    return {"doc": d, "code": c, "h": h, "w": w, "n": n, "run": run, "run_size": run_size, "nh": nh, "nw": nw, "size": size}


def _scores(blocks: DataFrame, replies: DataFrame, totals: dict, vocab: int, shards: int, kind: str) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(totals)  # a few numbers for each token of the vocabulary

    def scored(names, ids, border, chosen, told):
        ids, border, chosen = _read(ids, border, chosen, vocab)
        size, name = np.diff(border), names.values
        loss_t, loss_b = np.zeros(len(size)), np.zeros(len(size))
        if len(ids):
            code = _bigrams(ids, border, vocab)
            codes = np.unique(code)
            cb, ct = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
            for shard, at in _shards(codes, vocab, shards):
                cb[at], ct[at] = told[shard]
            x = shared.value
            run = (border[1:] - size) // SCORE_TOKENS
            cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(size)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if border[i] == border[j]:
                    continue
                here = slice(border[i], border[j])
                part = _own_counts(ids[here], border[i : j + 1] - border[i], code[here], vocab)
                at = np.searchsorted(codes, part["code"])
                loss_b[i:j] = _Losses(x["b"], x["total_b"], x["kinds_b"], vocab).of(part, cb[at], np.ones(j - i, np.int64))
                loss_t[i:j] = _Losses(x["t"], x["total_t"], x["kinds_t"], vocab).of(part, ct[at], chosen[i:j].astype(np.int64))
        none = size == 0
        return pa.RecordBatch.from_arrays([name, pa.array(size, pa.int64()), pa.array(loss_t, pa.float64(), mask=none), pa.array(loss_b, pa.float64(), mask=none)], names=["doc_id", "n_tokens", "loss_target", "loss_background"])

    def rows(batches):
        held, told = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                block, order = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if order < 0:
                    if held is not None:
                        yield scored(*held, told)
                    held, told = [batch.column(i)[k] for i in (2, 5, 4, 3)], {}
                else:
                    told[order] = np.frombuffer(batch.column(6)[k].as_py(), np.int64), np.frombuffer(batch.column(7)[k].as_py(), np.int64)
        if held is not None:
            yield scored(*held, told)

    none = F.lit(None).cast("binary")
    texts = blocks.select("block", F.lit(-1).alias("ord"), "names", "chosen", "border", "ids", none.alias("cb"), none.alias("ct"))
    told = replies.select("block", "ord", F.lit(None).cast(f"array<{kind}>").alias("names"), none.alias("chosen"), none.alias("border"), none.alias("ids"), "cb", "ct")
    both = texts.unionAll(told).repartition("block").sortWithinPartitions("block", "ord")
    return both.mapInArrow(rows, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double")


def score(docs: DataFrame, is_target: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` of every row.

    Null and empty texts have no tokens and null losses; a null ``is_target``
    counts as false.  Where a model holds nothing but the document itself (or
    nothing at all) it is uniform.  An empty table gives no rows.  Repeated rows
    count and are answered each.  Other columns are ignored.
    """
    kind, vocab = docs.schema[id_col].dataType.simpleString(), encoder(tokenizer).vocab_size
    with Tables(docs.sparkSession) as tables:
        blocks = tables.write(_blocks(docs, is_target, id_col, text_col, tokenizer), "lm-blocks")
        n_tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
        shards = max(16, -(-n_tokens // SHARD_TOKENS))
        requests = tables.write(_requests(blocks, vocab, shards), "lm-requests")
        model = tables.write(_model(requests, vocab), "lm-model")
        totals = _totals(model, vocab)
        replies = tables.write(_replies(requests, model, vocab), "lm-replies")
        out = tables.write(_scores(blocks, replies, totals, vocab, shards, kind), "lm-scores", keep=True)
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def _totals(model: DataFrame, vocab: int) -> dict:
    """Totals of histories and tokens; a row for each of both kinds and token of the vocabulary at most."""
    sums = model.where("kind > 0").groupBy("kind", "id").agg(*(F.sum(c).alias(c) for c in ("b", "t", "kb", "kt")))
    out = {x: {y: np.zeros(vocab + 1, dtype=np.int64) for y in "hwk"} for x in "bt"}
    got = sums.toPandas()
    for x in "bt":
        one, two = got[got["kind"] == 1], got[got["kind"] == 2]
        out[x]["h"][one["id"]], out[x]["k"][one["id"]], out[x]["w"][two["id"]] = one[x], one[f"k{x}"], two[x]
        out[f"total_{x}"], out[f"kinds_{x}"] = int(out[x]["w"].sum()), int((out[x]["w"] > 0).sum())
    return out
