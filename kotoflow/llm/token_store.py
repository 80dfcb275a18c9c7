"""Token-id output: one concatenated id array with Elias-Fano document borders.

File format (one *shard*, all integers little-endian)::

    "KFT1" | u8 bytes per id | u8 flags | u64 documents | u64 ids
    u64 size, Elias-Fano borders (documents + 1 ascending offsets)
    u64 size, document ids (Elias-Fano if flags & 1, else raw i64 with a null bitmap)
    ids, 2 or 4 bytes each

``EliasFano`` keeps n ascending numbers below u in about n * (2.5 + log2(u / n))
bits: low bits packed, high bits as a unary bit vector with a sampled *select*
structure (the 32-bit place of every 64th set bit, part of the file), so border i
is read from one block, without a table of 64-bit offsets.

Shards are payloads of Parquet rows in the cluster's shared folder: the Parquet
committer makes writes atomic per task, so a lost executor leaves no half shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kotoflow.llm.common import write_table
from kotoflow.llm.tokens import DEFAULT_TOKENIZER, END_ID, encoder, ended, sliced

#: A shard is closed once it holds so many ids.
SHARD_IDS = 2_000_000
_SAMPLE = 64


class EliasFano:
    """Ascending non-negative integers with constant-time ``select``.

    >>> EliasFano.of(np.array([0, 3, 3, 90])).select(3)
    90
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        if len(v) and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must ascend from 0 or more")
        n = len(v)
        bits = max(0, int((int(v[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = np.packbits(((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() if bits else b""
        place = (v >> bits) + np.arange(n)
        marks = np.zeros(int(place[-1]) + 1 if n else 0, dtype=np.uint8)
        if len(marks) > 2**32:
            raise ValueError("too many values for 32-bit samples; use several shards")
        marks[place] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little").tobytes(), place[::_SAMPLE].astype("<u4").tobytes())

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        return cls(n, bits, data[at : at + a], data[at + a : at + a + b], data[at + a + b : at + a + b + 4 * -(-n // _SAMPLE)])

    def block(self, k: int) -> np.ndarray:
        """Values 64 k to 64 k + 63 (fewer at the end): from the k-th sample, the block's set bits and low bits."""
        first, start = k * _SAMPLE, int(self.samples[k])
        n = min(_SAMPLE, self.n - first)
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start >> 3 : (stop + 7) >> 3], bitorder="little")
        high = np.flatnonzero(bits[start & 7 :])[:n] + (start - first) - np.arange(n)
        if not self.low_bits:
            return high
        at = first * self.low_bits >> 3  # 64 values fill whole bytes
        low = np.unpackbits(self.low[at : at + (n * self.low_bits + 7 >> 3)], bitorder="little")[: n * self.low_bits].reshape(n, -1).astype(np.int64)
        return (high << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // _SAMPLE)[i % _SAMPLE])

    def blocks(self) -> Iterator[np.ndarray]:
        """All values, block by block."""
        for k in range(len(self.samples)):
            yield self.block(k)


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """Shard bytes from documents' lengths and all their ids."""
    borders = EliasFano.of(np.concatenate(([0], np.cumsum(lengths)))).to_bytes()
    known = all(x is not None for x in doc_ids)
    if known and doc_ids and doc_ids[0] >= 0 and all(a <= b for a, b in zip(doc_ids, doc_ids[1:], strict=False)):
        names, flags = EliasFano.of(np.array(doc_ids, dtype=np.int64)).to_bytes(), 1
    else:
        nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
        names, flags = np.packbits(nulls).tobytes() + np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), 0
    body = ids.astype("<u2" if width == 2 else "<u4").tobytes()
    return b"KFT1" + struct.pack("<BBQQ", width, flags, len(doc_ids), len(ids)) + struct.pack("<Q", len(borders)) + borders + struct.pack("<Q", len(names)) + names + body


class Shard:
    """Random access to one shard: ``border(i)``, ``doc_ids()`` and ``ids(i)``."""

    def __init__(self, data: bytes):
        if data[:4] != b"KFT1":
            raise ValueError("not a token shard")
        self.width, self.flags, self.n_docs, self.n_ids = struct.unpack_from("<BBQQ", data, 4)
        at = 4 + struct.calcsize("<BBQQ")
        (size,) = struct.unpack_from("<Q", data, at)
        self.borders = EliasFano.from_bytes(data[at + 8 : at + 8 + size])
        at += 8 + size
        (size,) = struct.unpack_from("<Q", data, at)
        self._names = data[at + 8 : at + 8 + size]
        self._body = np.frombuffer(data, dtype=f"<u{self.width}", count=self.n_ids, offset=at + 8 + size)

    def border(self, i: int) -> int:
        return self.borders.select(i)

    def doc_ids(self) -> list[int | None]:
        if self.flags & 1:
            return [x for part in EliasFano.from_bytes(self._names).blocks() for x in part.tolist()]
        cut = (self.n_docs + 7) // 8
        nulls = np.unpackbits(np.frombuffer(self._names[:cut], dtype=np.uint8))[: self.n_docs]
        raw = np.frombuffer(self._names[cut:], dtype="<i8").tolist()
        return [None if no else x for x, no in zip(raw, nulls, strict=True)]

    def span(self, a: int, b: int) -> np.ndarray:
        return self._body[a:b]

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.border(i), self.border(i + 1))

    def spans(self) -> Iterator[tuple[int, int]]:
        """Borders of each document, in order."""
        last = None
        for part in self.borders.blocks():
            for x in part.tolist():
                if last is not None:
                    yield last, x
                last = x


def write_shards(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> tuple[DataFrame, str]:
    """Encode whole texts and write shards in ascending id order.

    Null texts count as empty: such a document is its end id alone.  Repeated
    ids are separate documents next to each other (ties by a hash of the text);
    a null id comes first.  An empty table gives an empty shard table.  Other columns,
    whatever their names, are ignored.  Returns the reread shard table
    ``(part, seq, base, n_docs, n_ids, payload)`` - base counts the ids before
    the shard inside its part - and its path.
    """
    def shards(batches):
        enc = encoder(tokenizer)
        width = 2 if max(enc.vocab_size - 1, end_id) < 65536 else 4
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        names, lengths, ids, held = [], [], [], 0

        def close():
            nonlocal names, lengths, ids, held, seq, base
            payload = pack_shard(names, np.concatenate(lengths), np.concatenate(ids), width)
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "base": pa.array([base], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())}
            )
            seq, base = seq + 1, base + held
            names, lengths, ids, held = [], [], [], 0
            return row

        for batch in batches:
            for rows in sliced(batch, 1):
                flat, border = ended(*enc.encode_many(rows.column(1)), end_id)
                some, at = rows.column(0).to_pylist(), 0
                while at < len(some):
                    # up to the document that fills the shard
                    stop = min(len(some), int(np.searchsorted(border, border[at] + shard_ids - held)))
                    stop = max(stop, at + 1)
                    names += some[at:stop]
                    lengths.append(np.diff(border[at : stop + 1]))
                    ids.append(flat[border[at] : border[stop]].astype("<u2" if width == 2 else "<u4"))
                    held += int(border[stop] - border[at])
                    at = stop
                    if held >= shard_ids:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the hash deals rows that share an id (or have none) over many tasks
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    return write_table(ordered.mapInArrow(shards, "part int, seq int, base long, n_docs long, n_ids long, payload binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the shard files alone: ``doc_id, start, n_tokens, ids_crc32``."""

    def documents(batches):
        for batch in batches:
            for part, base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(payload.as_py())
                spans = list(shard.spans())
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * shard.n_docs, pa.int32()),
                        "doc_id": pa.array(shard.doc_ids(), pa.int64()),
                        "within": pa.array([base + a for a, _ in spans], pa.int64()),
                        "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(shard.span(a, b).astype("<u4").tobytes()) for a, b in spans], pa.int64()),
                    }
                )

    rows = shards.select("part", "base", "payload").mapInArrow(documents, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # one row per part: a prefix sum over as many rows as there were write tasks
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(bases, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, **kw) -> DataFrame:
    """Write the shards, read them back and return one row per document."""
    shards, _ = write_shards(docs, tokenizer, **kw)
    return read_documents(shards)
