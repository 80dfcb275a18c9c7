"""Corpus evaluation: edit operations, error rates, failing words in context."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

_OP = StructType().add("op", StringType()).add("exp_idx", IntegerType()).add("act_idx", IntegerType())
OPS = StructType().add("s", IntegerType()).add("d", IntegerType()).add("i", IntegerType()).add("ops", ArrayType(_OP))


def edit_ops(expected: Sequence, actual: Sequence) -> tuple[int, int, int, list[tuple[str, int, int]]]:
    """Levenshtein alignment; going back from the end it prefers equal, substitute, delete, insert."""
    n, m = len(expected), len(actual)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        up, row, e = cost[-1], [i], expected[i - 1]
        for j in range(1, m + 1):
            row.append(up[j - 1] if e == actual[j - 1] else 1 + min(up[j - 1], up[j], row[j - 1]))
        cost.append(row)
    ops: list[tuple[str, int, int]] = []
    count = {"substitute": 0, "delete": 0, "insert": 0, "equal": 0}
    i, j = n, m
    while i or j:
        here = cost[i][j]
        if i and j and expected[i - 1] == actual[j - 1] and here == cost[i - 1][j - 1]:
            op, i, j = "equal", i - 1, j - 1
        elif i and j and here == cost[i - 1][j - 1] + 1:
            op, i, j = "substitute", i - 1, j - 1
        elif i and here == cost[i - 1][j] + 1:
            op, i = "delete", i - 1
        else:
            op, j = "insert", j - 1
        count[op] += 1
        ops.append((op, i, j))
    return count["substitute"], count["delete"], count["insert"], ops[::-1]


@F.pandas_udf(OPS)
def edit_ops_udf(expected: pd.Series, actual: pd.Series) -> pd.DataFrame:
    rows = []
    for e, a in zip(expected, actual, strict=True):
        s, d, i, ops = edit_ops(list(e) if e is not None else [], list(a) if a is not None else [])
        rows.append((s, d, i, [{"op": o, "exp_idx": x, "act_idx": y} for o, x, y in ops]))
    return pd.DataFrame(rows, columns=["s", "d", "i", "ops"])


def normalized_phonemes(c: Column) -> Column:
    """Without pauses, lower case save N; sp and unk stay."""
    lower = lambda x: F.when(x == "N", x).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.transform(F.filter(c, lambda x: x != "pau"), lower)


def with_gold(results: DataFrame, gold: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Results joined with gold by id, and the results that have none (reported, not an exception)."""
    return results.join(gold, key), results.join(gold, key, "left_anti")


def sentence_rate(errors: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(100.0 * errors / n)


def corpus_totals(scored: DataFrame) -> DataFrame:
    """Micro-averaged totals from rows with s, d, i and n (expected length); zero sentences give rate 0."""
    err = F.col("s") + F.col("d") + F.col("i")
    t = scored.agg(
        F.count("*").alias("sentences"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("substitutions"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("deletions"),
        F.coalesce(F.sum("i"), F.lit(0)).alias("insertions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count_if(err > 0).alias("with_errors"),
    )
    return t.withColumns(
        {
            "error_rate": sentence_rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("tokens")),
            "exact_rate": sentence_rate(F.col("sentences") - F.col("with_errors"), F.col("sentences")),
        }
    )


def attribute_errors(ops: Sequence[tuple[str, int, int]], word_lengths: Sequence[int]) -> list[int]:
    """Word index of every operation that is an error; one past the end belongs to the last word."""
    owner = [w for w, n in enumerate(word_lengths) for _ in range(n)]
    last = max(len(word_lengths) - 1, 0)
    return [owner[j] if j < len(owner) else last for op, _, j in ops if op != "equal"]


@F.pandas_udf(ArrayType(IntegerType()))
def failing_words(ops: pd.Series, word_lengths: pd.Series) -> pd.Series:
    out = []
    for o, w in zip(ops, word_lengths, strict=True):
        out.append(sorted(set(attribute_errors([(x["op"], x["exp_idx"], x["act_idx"]) for x in o], list(w)))))
    return pd.Series(out)


def word_context(words: DataFrame, doc: str = "doc_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """Adds prev_word and next_word; BOS and EOS at the ends."""
    w = Window.partitionBy(doc).orderBy(pos)
    return words.withColumns({"prev_word": F.lag(word, 1, "BOS").over(w), "next_word": F.lead(word, 1, "EOS").over(w)})


def char_error_ops(expected: Column, actual: Column) -> Column:
    """Character edit operations of two strings."""
    return edit_ops_udf(F.split(expected, ""), F.split(actual, ""))


@F.pandas_udf(StringType())
def token_diff(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """Differences as ``[-x] [+y]``, equal tokens plain."""

    def one(e, a) -> Iterator[str]:
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, list(e), list(a), autojunk=False).get_opcodes():
            if op == "equal":
                yield from e[i1:i2]
            else:
                yield from (f"[-{x}]" for x in e[i1:i2])
                yield from (f"[+{x}]" for x in a[j1:j2])

    return pd.Series([" ".join(one(e, a)) for e, a in zip(expected, actual, strict=True)])


def write_report(totals: DataFrame, errors: DataFrame, path: str) -> None:
    """Summary and failing sentences as two JSON tables; a reader joins them, no task holds all."""
    totals.write.mode("overwrite").json(f"{path}/summary")
    errors.write.mode("overwrite").json(f"{path}/errors")
