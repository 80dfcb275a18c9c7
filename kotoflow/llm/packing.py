"""Best-fit packing of token sequences, by hierarchical residual packing.

1. Each scan task encodes its whole texts, cuts documents longer than a bin
   into full bins (the first piece takes the remainder) and packs the pieces it
   holds best-fit, longest first.
2. Nearly full bins are final.  Underfull bins go on as *items*: they are dealt
   into fewer groups and packed best-fit again, round after round, until a round
   no longer saves bins or one group has seen them all.  The first underfull bins
   are taken apart for that, one item per piece: small pieces fill gaps best.

A group never holds more than ``group_items`` underfull bins on average, so no
task grows with the input; contents travel as one small struct per piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotoflow.llm.common import write_table
from kotoflow.llm.tokens import DEFAULT_TOKENIZER, END_ID, encoder, ended, sliced

BIN_TOKENS = 1024
#: A bin is nearly full, and final, from this share of its room.
NEARLY_FULL = 0.998
#: Underfull bins that one group of a merge round holds, about.
GROUP_ITEMS = 8_000
#: Bin ids have room for so many rounds; each round but the last saves 0.1 % of its bins.
MAX_ROUNDS = 15

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32())])
_BINS = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("pieces", pa.list_(_PIECE))])
_DDL = "bin long, fill int, pieces array<struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long,offset:int>>"


def best_fit(sizes: Iterable[int], room: int) -> list[int]:
    """Bin number for each item, items taken longest first, each into the
    fullest open bin that still holds it.  Ties go to the item given first.

    >>> best_fit([6, 4, 5, 5], 10)
    [0, 0, 1, 1]
    """
    sizes = list(sizes)
    out = [0] * len(sizes)
    left: list[list[int]] = [[] for _ in range(room + 1)]  # open bins by what is left in them
    usable: list[int] = []  # the values of ``left`` that have bins, ascending
    bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        k = bisect.bisect_left(usable, size)
        if k == len(usable):
            b, rest, bins = bins, room - size, bins + 1
        else:
            was = usable[k]
            b = left[was].pop()
            if not left[was]:
                del usable[k]
            rest = was - size
        out[i] = b
        if rest:
            if not left[rest]:
                bisect.insort(usable, rest)
            left[rest].append(b)
    return out


def cut(length: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    if length <= room:
        return [(0, length)]
    head = length % room
    return ([(0, head)] if head else []) + [(a, room) for a in range(head, length, room)]


def _packed(items: list[tuple[int, list]], room: int, bin_base: int) -> list[tuple[int, int, list]]:
    """Items (size, pieces with offsets inside the item) into (bin, fill, pieces)."""
    where = best_fit([n for n, _ in items], room)
    bins: dict[int, list] = {}
    for (size, pieces), b in zip(items, where, strict=True):
        got = bins.setdefault(b, [bin_base + b, 0, []])
        got[2] += [p | {"offset": p["offset"] + got[1]} for p in pieces] if got[1] else pieces
        got[1] += size
    return [tuple(x) for x in bins.values()]


def _batches(bins: list[tuple[int, int, list]], step: int = 4096):
    for k in range(0, len(bins), step):
        a, b, c = zip(*bins[k : k + step], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.list_(_PIECE))], schema=_BINS)


def encode_and_pack(docs: DataFrame, tokenizer: str, room: int, id_col: str, text_col: str, end_id: int, full: int) -> DataFrame:
    """Round 0: tokens, pieces and a local best-fit in each scan task; what is not full is taken apart."""

    def local(batches):
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 36
        items = []
        for batch in batches:
            for rows in sliced(batch, 1):
                ids, border = ended(*enc.encode_many(rows.column(1)), end_id)
                data, border = memoryview(ids).cast("B"), border.tolist()
                for name, lo, hi in zip(rows.column(0).to_pylist(), border[:-1], border[1:], strict=True):
                    for k, (start, n) in enumerate(cut(hi - lo, room)):
                        at = 4 * (lo + start)
                        items.append((n, [{"doc_id": name, "piece": k, "start": start, "length": n, "ids_crc32": zlib.crc32(data[at : at + 4 * n]), "offset": 0}]))
        bins = _packed(items, room, base)
        done = [b for b in bins if b[1] >= full]
        apart = [p for _, fill, pieces in bins if fill < full for p in pieces]
        yield from _batches(done)
        yield from _batches([(base + len(bins) + j, p["length"], [p | {"offset": 0}]) for j, p in enumerate(apart)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(local, _DDL)


def merge_round(bins: DataFrame, groups: int, room: int, round_no: int) -> DataFrame:
    """Pack underfull bins as items inside each of ``groups`` groups."""

    def merged(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: r["bin"])  # the shuffle's order must not matter
        yield from _batches(_packed([(r["fill"], r["pieces"]) for r in rows], room, (round_no << 58) | (TaskContext.get().partitionId() << 36)))

    return bins.repartition(groups, "bin").mapInArrow(merged, _DDL)


def pack(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, room: int = BIN_TOKENS, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, nearly_full: float = NEARLY_FULL, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty: one piece of the end id alone.  Repeated rows are
    packed once each; a null id stays null.  An empty table gives no rows, and
    other columns are ignored whatever their names.  Texts of any length are
    encoded whole.  Ties between equally full bins or equally long pieces go to
    the one met first, so a rerun of a task gives the same bins.
    """
    full = int(room * nearly_full)
    bins, _ = write_table(encode_and_pack(docs, tokenizer, room, id_col, text_col, end_id, full), "bins-0")
    done, rest = [bins.where(F.col("fill") >= full)], bins.where(F.col("fill") < full)
    n, round_no = rest.count(), 0
    while n > 1:
        round_no, groups = round_no + 1, -(-n // group_items)
        merged, _ = write_table(merge_round(rest, groups, room, round_no), f"bins-{round_no}")
        left = merged.count()
        done.append(merged.where(F.col("fill") >= full))
        rest = merged.where(F.col("fill") < full)
        if groups == 1 or (n - left) * 1000 < n or round_no == MAX_ROUNDS:
            break
        n = rest.count()
    done.append(rest)
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out.select("bin", F.inline("pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("offset"))
