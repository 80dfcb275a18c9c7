"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words.  A text is read as a row of words; a
window of m words is searched with blocks of two words: the *shift table* says
how far the search may jump when it sees a block, a block with shift 0 is the
suffix of some patterns, whose *hash bucket* lists them, and a direct comparison
of all m words confirms an occurrence.  Most positions are never looked at.

The automaton is built from blocks of items of bounded size, so it may be
broadcast whatever the benchmark's size: more items mean more passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Words of benchmark text that one pass searches for, at most (an item longer than that is a pass).
PASS_WORDS = 2_000_000

#: ASCII letters fold, ASCII digits stay, every other ASCII character separates; other characters are word characters.
_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class WuManber:
    """Search for patterns of one length m (in words)."""

    def __init__(self, m: int, patterns: dict[tuple, list]):
        self.m, self.b = m, min(2, m)
        self.jump = m - self.b + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for pattern, items in patterns.items():
            for end in range(self.b, m + 1):
                block, far = self._block(pattern, end), m - end
                if far < self.shift.get(block, self.jump):
                    self.shift[block] = far
            # by suffix block, then by first word: patterns with a common ending are not compared one by one
            self.buckets.setdefault(self._block(pattern, m), {}).setdefault(pattern[0], []).append((pattern, items))

    def _block(self, words, end: int):
        return words[end - 1] if self.b == 1 else (words[end - 2], words[end - 1])

    def search(self, text: list[bytes]):
        """(start, items) of every occurrence."""
        m, n, jump, shift, b1 = self.m, len(text), self.jump, self.shift.get, self.b == 1
        at = m - 1
        while at < n:
            block = text[at] if b1 else (text[at - 1], text[at])
            far = shift(block, jump)
            if far:
                at += far
                continue
            start = at - m + 1
            for pattern, items in self.buckets[block].get(text[start], ()):
                if tuple(text[start : at + 1]) == pattern:
                    yield start, items
            at += 1


def automata(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One automaton for each pattern length.  Items without words have no pattern."""
    by_length: dict[int, dict[tuple, list]] = {}
    for name, text in items:
        w = words(text)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(w[k : k + m]), [])
            if not owners or owners[-1] != name:
                owners.append(name)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def passes(benchmark: DataFrame, item_col: str, text_col: str, pass_words: int = PASS_WORDS):
    """Benchmark items in blocks of bounded size, streamed to the driver one block at a time."""
    block, held = [], 0
    for name, text in benchmark.select(item_col, text_col).toLocalIterator():
        n = len(words(text))
        if block and held + n > pass_words:
            yield block
            block, held = [], 0
        block.append((name, text))
        held += n
    if block:
        yield block


def scan(docs: DataFrame, block: list, id_col: str, text_col: str, window: int) -> DataFrame:
    """One pass: ``doc_id, row, n_words, starts, ends, items`` (hit words as ascending disjoint ranges)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    built: list = []

    def find(batches):
        if not built:
            built.append(automata(shared.value, window))
        for batch in batches:
            n_words, starts, ends, found = [], [], [], []
            for text in batch.column(2):
                w = words(text.as_py())
                spans, items = [], set()
                for a in built[0]:
                    for s, owners in a.search(w):
                        spans.append((s, s + a.m))
                        items.update(owners)
                spans.sort()
                joined: list[list[int]] = []
                for s, e in spans:
                    if joined and s <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], e)
                    else:
                        joined.append([s, e])
                n_words.append(len(w))
                starts.append([s for s, _ in joined])
                ends.append([e for _, e in joined])
                found.append(sorted(str(x) for x in items if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "row", "n_words", "starts", "ends", "items"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).cast("string"))
    return rows.mapInArrow(find, f"doc_id {docs.schema[id_col].dataType.simpleString()}, row long, n_words long, starts array<long>, ends array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_words, starts, ends, items, n_hit, n_items, items_sha256, contaminated``.

    ``starts``/``ends`` are the hit word ranges, ``items`` the item ids found, as
    strings in order.  A null or wordless text has no words and no hits; a null or
    wordless item matches nothing (one without an id hits words but is not listed); an empty benchmark leaves every document
    clean.  Repeated rows give a row each.  Texts are searched whole.
    """
    scans = [scan(docs, b, id_col, text_col, window) for b in passes(benchmark, item_col, item_text_col, pass_words)] or [scan(docs, [], id_col, text_col, window)]
    if len(scans) == 1:
        hits = scans[0].withColumn("n_hit", F.coalesce(F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)))
    else:
        # rows of one document from several passes: as many as there are passes
        every = scans[0].withColumn("pass", F.lit(0))
        for k, x in enumerate(scans[1:], 1):
            every = every.unionAll(x.withColumn("pass", F.lit(k)))
        grouped = every.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("pass") == 0).alias("copies"), F.collect_set(F.struct("starts", "ends")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

        # ranges of several passes as one ascending list of disjoint ranges
        spans = F.array_sort(F.flatten(F.transform("spans", lambda x: F.arrays_zip(x["starts"], x["ends"]))))
        joined = grouped.withColumn("spans", spans).withColumn(
            "spans",
            F.expr(
                """aggregate(spans, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) ->
                   if(size(a) > 0 and element_at(a, -1).e >= x.starts,
                      concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.ends)))),
                      concat(a, array(named_struct('s', x.starts, 'e', x.ends)))))"""
            ),
        )
        n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]), F.lit(0))
        hits = joined.select("doc_id", "n_words", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"), "items", n_hit.alias("n_hit"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
    return hits.drop("row").withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark; columns as they were.

    A filter inside the scan, pass by pass: no join, so repeated and null ids are safe.
    """
    at = docs.columns.index(text_col)

    def hit(automata_of: list[WuManber], text: str | None) -> bool:
        w = words(text)
        return any(next(a.search(w), None) is not None for a in automata_of)

    for block in passes(benchmark, item_col, item_text_col, pass_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            built = automata(shared.value, window)
            for batch in batches:
                yield batch.filter(pa.array([not hit(built, t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) by trying every window at every place; for tests."""
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        m = min(window, len(v))
        for k in range(len(v) - m + 1 if v else 0):
            for s in range(len(w) - m + 1):
                if w[s : s + m] == v[k : k + m]:
                    hit.update(range(s, s + m))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


