"""Text and JSON renderings of results, as columns over nested results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """Array of strings, joined by spaces."""
    return F.array_join(c, " ")


def per_word(c: Column) -> Column:
    """Array of arrays: ``[a, b] [c]``."""
    return F.array_join(F.transform(c, lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))), " ")


def pairs(c: Column) -> Column:
    """One ``word<tab>phonemes`` line per entry."""
    return F.array_join(F.transform(c, lambda x: F.concat(x["word"], F.lit("\t"), F.array_join(x["phonemes"], " "))), "\n")


def _status(x: Column) -> Column:
    return F.when(x["is_unknown"], "[UNK]").when(x["is_ignored"], "[IGN]").otherwise("[OK] ")


def mapping(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(_status(x), F.lit(" "), x["word"], F.lit("\t"), F.array_join(x["phonemes"], " "))), "\n")


def mapping_detailed(c: Column) -> Column:
    def line(x: Column) -> Column:
        text = lambda k: x[k].cast("string")
        named = [("POS", "pos"), ("POS_GROUP1", "pos_group1"), ("PRON", "pron"), ("READ", "read")]
        parts = [F.concat(F.lit(f"\t{label}: "), text(k)) for label, k in named]
        parts += [F.concat(F.lit("\tACC: "), text("accent_nucleus"), F.lit("/"), text("mora_count"))]
        parts += [F.concat(F.lit("\tCHAIN_FLAG: "), text("chain_flag")), F.concat(F.lit("\tCHAIN_RULE: "), text("chain_rule"))]
        return F.concat(_status(x), F.lit(" "), x["word"], *parts)

    return F.array_join(F.transform(c, line), "\n")


def lines(c: Column) -> Column:
    return F.array_join(c, "\n")


def json_record(c: Column) -> Column:
    """One JSON value; write with the text sink for JSON Lines."""
    return F.to_json(c)
