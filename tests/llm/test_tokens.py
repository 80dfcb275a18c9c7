import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kotoflow.llm import packing, token_store, tokens
from kotoflow.llm.token_store import EliasFano, Shard, pack_shard
from kotoflow.llm.tokens import DEFAULT_TOKENIZER, encoder, tokenizer_path

AWKWARD = ["", " ", "  a", "a  b", "a   b ", "x \n y", "x\n\n y \n", "don't we'll  it's", "<|endoftext|> a", "日本語 text x", "\t\t a  b", "12 345,67", "é è\r\n ñ", "a" * 3000 + " " * 50]


FRESH = Tokenizer.from_file(tokenizer_path(DEFAULT_TOKENIZER))


def library(text):
    return np.asarray(FRESH.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("text", AWKWARD)
def test_encoder_equals_library(text):
    assert encoder().encode(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1.,!日 ", max_size=40))
def test_encoder_equals_library_random(text):
    assert encoder().encode(text) == library(text)


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "a<|endoftext|>b", "<|endoftext|>", "<|ENDOFTEXT|> a", "<|endoftext |> a b", "\x01 a", "a \x01b", "a\u3000 b", "a \x0b b", "x\x85  y", "a\x1c b"])
def test_encoder_equals_library_odd(text):
    assert encoder().encode(text) == library(text)


def test_columns_equal_library(monkeypatch):
    rng = random.Random(7)
    some = [rng.choice([None, "", *AWKWARD, "x <|endoftext|> y", *(" ".join(rng.choice(["the", "The", "don't", "été", "x\ny", "7,5"]) for _ in range(rng.randrange(40))) for _ in range(9))]) for _ in range(300)]
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(tokens, "SLICE_BYTES", 500)
    enc = tokens.Encoder()
    batch = pa.RecordBatch.from_arrays([pa.array(some)], names=["t"])
    got = []
    for rows in tokens.sliced(batch, 0):
        ids, border = tokens.ended(*enc.encode_many(rows.column(0)), 2)
        got += [ids[a:b].tobytes() for a, b in zip(border[:-1], border[1:])]
    assert got == [library(t or "") + b"\2\0\0\0" for t in some]
    assert enc.encode_many(pa.array([], pa.string()))[1].tolist() == [0]


def test_added_token_is_one_id():
    assert np.frombuffer(encoder().encode("x <|endoftext|> y"), dtype="<u4").tolist() == [87, 220, 50256, 331]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=300))
def test_elias_fano_round_trip(values):
    values.sort()
    x = EliasFano.from_bytes(EliasFano.of(np.array(values, dtype=np.int64)).to_bytes())
    assert [y for part in x.blocks() for y in part.tolist()] == values
    assert [x.select(i) for i in range(len(values))] == values


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 5000))
    assert len(EliasFano.of(v).to_bytes()) < len(v) * 2  # 64-bit offsets take 8 bytes each


def test_shard_with_nulls_and_repeats():
    s = Shard(pack_shard([None, 3, 3], np.array([2, 1, 3]), np.array([5, 2, 2, 70, 60000, 2]), 2))
    assert s.doc_ids() == [None, 3, 3]
    assert [s.ids(i).tolist() for i in range(3)] == [[5, 2], [2], [70, 60000, 2]]


ROWS = [(3, "b c", "x"), (1, None, "x"), (2, "", "y"), (3, "b c", "x"), (9, "word " * 3000, None), (None, "a", "z")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string")


def test_token_store(spark):
    e = encoder()
    got = sorted(token_store.token_store(frame(spark, ROWS), shard_ids=4).collect(), key=lambda r: r["start"])
    at = 0
    want = []
    for name, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = e.encode(text) + np.array([2], dtype="<u4").tobytes()
        want.append((name, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert [tuple(r) for r in got] == want
    assert token_store.token_store(frame(spark, [])).count() == 0


def test_few_sequences(spark):
    rng = random.Random(3)
    rows = [(k, "word " * int(min(5000, rng.lognormvariate(5.5, 1))), None) for k in range(1000)]
    got = packing.pack(frame(spark, rows).repartition(16)).select("sequence_id", "length").toPandas()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) * 1.005 + 1


def test_best_fit_is_any_fit():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    where = packing.best_fit(sizes, 100)
    fills = {}
    for n, b in zip(sizes, where):
        fills[b] = fills.get(b, 0) + n
    a, b = sorted(fills.values())[:2]
    assert max(fills.values()) <= 100 and a + b > 100


@pytest.mark.parametrize("group_items", [8000, 5])
def test_pack(spark, group_items):
    rng = random.Random(2)
    rows = ROWS + [(k, " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(1, 900))), "s") for k in range(20, 120)]
    got = packing.pack(frame(spark, rows).repartition(4), group_items=group_items).collect()
    e, end = encoder(), np.array([2], dtype="<u4").tobytes()
    want = []
    for name, text, _ in rows:
        ids = e.encode(text) + end
        n = len(ids) // 4
        pieces = [(0, n)] if n <= 1024 else packing.cut(n, 1024)
        assert [x for _, x in pieces][1:] == [1024] * (len(pieces) - 1)
        want += [(name, k, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)])) for k, (s, m) in enumerate(pieces)]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) * 1.2 + 2
    assert packing.pack(frame(spark, [])).count() == 0
