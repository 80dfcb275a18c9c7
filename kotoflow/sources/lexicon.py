"""Lexicons: dictionary CSV rows, categories and connection costs, as tables and as a worker's search structure."""

from __future__ import annotations

import csv
import hashlib
import os
import pkgutil
import tempfile
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

COLUMNS = "surface left_id right_id cost pos g1 g2 g3 ctype cform orig read pron acc_mora chain_rule".split()
DDL = "surface string, left_id int, right_id int, cost int, pos string, g1 string, g2 string, g3 string, ctype string, cform string, orig string, read string, pron string, acc_mora string, chain_rule string"
DEFAULT_LEXICON = str(Path(__file__).with_name("small_lexicon.csv"))

# How unknown words are made where a dictionary directory has no char.def - category, invoked even next to
# known words, grouped into runs, up to so many characters -, code-point ranges (later lines win; the first category of a line makes
# words, all of them join runs), and one template for each category where there is no unk.def.
CATEGORIES: dict[str, tuple[bool, bool, int]] = {
    "DEFAULT": (False, True, 0), "SPACE": (False, True, 0), "KANJI": (False, False, 2), "SYMBOL": (True, True, 0), "NUMERIC": (True, True, 0), "ALPHA": (True, True, 0),
    "HIRAGANA": (False, True, 2), "KATAKANA": (False, True, 2), "KANJINUMERIC": (True, True, 0), "GREEK": (True, True, 0), "CYRILLIC": (True, True, 0),
}
UNKNOWN: dict[str, tuple[int, str]] = {
    "DEFAULT": (4190, "記号,一般,*,*,*,*,*"), "SPACE": (8094, "記号,空白,*,*,*,*,*"), "KANJI": (10654, "名詞,一般,*,*,*,*,*"), "SYMBOL": (15331, "名詞,サ変接続,*,*,*,*,*"), "NUMERIC": (25847, "名詞,数,*,*,*,*,*"),
    "ALPHA": (11820, "名詞,一般,*,*,*,*,*"), "HIRAGANA": (12341, "名詞,一般,*,*,*,*,*"), "KATAKANA": (8360, "名詞,一般,*,*,*,*,*"), "KANJINUMERIC": (26419, "名詞,数,*,*,*,*,*"), "GREEK": (7019, "名詞,一般,*,*,*,*,*"), "CYRILLIC": (6975, "名詞,一般,*,*,*,*,*"),
}
_RANGES: list[tuple[int, int, tuple[str, ...]]] = [
    (0x20, 0x20, ("SPACE",)), (0x09, 0x0D, ("SPACE",)),
    (0x21, 0x2F, ("SYMBOL",)), (0x30, 0x39, ("NUMERIC",)), (0x3A, 0x40, ("SYMBOL",)), (0x41, 0x5A, ("ALPHA",)), (0x5B, 0x60, ("SYMBOL",)), (0x61, 0x7A, ("ALPHA",)), (0x7B, 0x7E, ("SYMBOL",)),
    (0xA1, 0xBF, ("SYMBOL",)), (0xC0, 0x236, ("ALPHA",)), (0x1E00, 0x1EF9, ("ALPHA",)), (0x374, 0x3FB, ("GREEK",)), (0x400, 0x4F9, ("CYRILLIC",)), (0x500, 0x50F, ("CYRILLIC",)),
    (0x3041, 0x309F, ("HIRAGANA",)), (0x30A1, 0x30FF, ("KATAKANA",)), (0x31F0, 0x31FF, ("KATAKANA",)), (0xFF66, 0xFF9F, ("KATAKANA",)),
    (0x2000, 0x206F, ("SYMBOL",)), (0x2070, 0x209F, ("NUMERIC",)), (0x20A0, 0x214F, ("SYMBOL",)), (0x2150, 0x218F, ("NUMERIC",)), (0x2190, 0x23FF, ("SYMBOL",)), (0x2460, 0x24FF, ("SYMBOL",)), (0x2501, 0x2BFF, ("SYMBOL",)),
    (0x3000, 0x303F, ("SYMBOL",)), (0x3200, 0x33FF, ("SYMBOL",)), (0xFE30, 0xFE6B, ("SYMBOL",)),
    (0x2E80, 0x2FD5, ("KANJI",)), (0x3005, 0x3005, ("KANJI",)), (0x3400, 0x4DB5, ("KANJI",)), (0x4E00, 0x9FA5, ("KANJI",)), (0xF900, 0xFA6A, ("KANJI",)),
    *((ord(c), ord(c), ("KANJINUMERIC", "KANJI")) for c in "一二三四五六七八九十百千万億兆"), (0x3007, 0x3007, ("SYMBOL", "KANJINUMERIC")),
    (0xFF01, 0xFF0F, ("SYMBOL",)), (0xFF10, 0xFF19, ("NUMERIC",)), (0xFF1A, 0xFF20, ("SYMBOL",)), (0xFF21, 0xFF3A, ("ALPHA",)), (0xFF3B, 0xFF40, ("SYMBOL",)), (0xFF41, 0xFF5A, ("ALPHA",)), (0xFF5B, 0xFF65, ("SYMBOL",)), (0xFFE0, 0xFFEF, ("SYMBOL",)),
    # own additions: the blank of wide text is white space
    (0x3000, 0x3000, ("SPACE",)),
]

Entry = tuple[int, int, int, str, int]  #: left id, right id, cost, feature, part-of-speech id


class Rules:
    """Character categories, templates of unknown words and part-of-speech ids of one dictionary."""

    def __init__(self, categories=None, ranges=None, templates=None, pos_ids: list[tuple[list[str], int]] | None = None):
        self.categories, self.ranges = categories or CATEGORIES, ranges if ranges is not None else _RANGES
        self.pos_ids, self._pos, self._kinds = pos_ids or [], {}, {}
        made = templates or {k: [(0, 0, cost, feature)] for k, (cost, feature) in UNKNOWN.items()}
        missing = set(self.categories) - set(made)
        if "DEFAULT" not in self.categories or missing:
            raise ValueError(f"unknown words: no template or category for {sorted(missing) or ['DEFAULT']}")
        self.templates: dict[str, list[Entry]] = {k: [(*t, self.pos_id(t[3])) for t in rows] for k, rows in made.items()}

    def kinds(self, c: str) -> tuple[str, ...]:
        """Categories of a character, the one that makes words first."""
        found = self._kinds.get(c)
        if found is None:
            n = ord(c)
            found = next((k for lo, hi, k in reversed(self.ranges) if lo <= n <= hi), ("DEFAULT",))
            if c in "ゝゞヽヾ":  # iteration marks stand alone, so that they can be resolved
                found = ("DEFAULT",)
            self._kinds[c] = found
        return found

    def pos_id(self, feature: str) -> int:
        """Id of the first pattern whose fields (* for any) the feature has; 0 without patterns."""
        key = tuple(feature.split(",")[:4])
        if key not in self._pos:
            self._pos[key] = next((n for pattern, n in self.pos_ids if all(p in ("*", f) for p, f in zip(pattern, key, strict=False))), 0)
        return self._pos[key]


def category(c: str) -> str:
    return _DEFAULT_RULES.kinds(c)[0]


def _lines(path: str):
    with open(path, encoding="utf-8") as h:
        for line in h:
            line = line.split("#")[0].strip() if not path.endswith(".csv") else line.strip()
            if line:
                yield line


def read_char_def(path: str) -> tuple[dict[str, tuple[bool, bool, int]], list[tuple[int, int, tuple[str, ...]]]]:
    """Categories (name, invoke, group, length) and code-point ranges of a char.def text."""
    categories, ranges = {}, []
    for line in _lines(path):
        first, *rest = line.split()
        if first.startswith("0x"):
            lo, _, hi = first.partition("..")
            ranges.append((int(lo, 16), int(hi or lo, 16), tuple(rest)))
        else:
            invoke, group, length = map(int, rest[:3])
            categories[first] = bool(invoke), bool(group), length
    unknown = {k for *_, kinds in ranges for k in kinds} - set(categories)
    if unknown:
        raise ValueError(f"{path}: undefined categories {sorted(unknown)}")
    return categories, ranges


def read_unk_def(path: str) -> dict[str, list[tuple[int, int, int, str]]]:
    """Templates of unknown words (left id, right id, cost, feature) by category, in order."""
    out: dict[str, list] = {}
    for line in _lines(path):
        kind, left, right, cost, *feature = line.split(",")
        out.setdefault(kind, []).append((int(left), int(right), int(cost), ",".join(feature)))
    return out


def read_pos_ids(path: str) -> list[tuple[list[str], int]]:
    """Patterns and ids of a pos-id.def text."""
    return [(line.rsplit(None, 1)[0].split(","), int(line.rsplit(None, 1)[1])) for line in _lines(path)]


def read_context_ids(path: str) -> list[tuple[list[str], int]]:
    """Patterns and ids of a left-id.def or right-id.def text, the most exact patterns first."""
    rows = [(line.split(None, 1)[1].split(","), int(line.split(None, 1)[0])) for line in _lines(path)]
    return sorted(rows, key=lambda r: r[0].count("*"))


def _context_id(patterns: list[tuple[list[str], int]], feature: list[str]) -> int:
    return next((n for p, n in patterns if all(x in ("*", f) for x, f in zip(p, feature, strict=False))), 0)


@dataclass
class Lexicon:
    """Words by surface, with the longest surface's length; immutable once loaded."""

    words: dict[str, list[Entry]] = field(default_factory=dict)
    longest: int = 0
    #: proper beginnings of surfaces: a search stops where no word goes on
    prefixes: set[str] = field(default_factory=set)
    matrix: np.ndarray | None = None
    rules: Rules = field(default_factory=lambda: _DEFAULT_RULES)
    left_ids: list[tuple[list[str], int]] = field(default_factory=list)
    right_ids: list[tuple[list[str], int]] = field(default_factory=list)

    def add(self, row: list[str], default_cost: int = 5000) -> None:
        """A row whose context ids are empty or negative gets those of its feature, where the dictionary has id files."""
        surface, feature = row[0], row[4:]
        left, right = int(row[1] or -1), int(row[2] or -1)
        if left < 0:
            left = _context_id(self.left_ids, feature)
        if right < 0:
            right = _context_id(self.right_ids, feature)
        text = ",".join(feature)
        self.words.setdefault(surface, []).append((left, right, int(row[3] or default_cost), text, self.rules.pos_id(text)))
        self.longest = max(self.longest, len(surface))
        self.prefixes.update(surface[:k] for k in range(1, len(surface)))

    def connection(self, right: int, left: int) -> int:
        m = self.matrix
        return int(m[right, left]) if m is not None and right < m.shape[0] and left < m.shape[1] else 0


_DEFAULT_RULES = Rules()


def local_path(path: str) -> str:
    """Where this process finds a lexicon: at its path, or among the files that :func:`ship` sent; the small
    lexicon of this package is unpacked where the package came as an archive."""
    if os.path.exists(path):
        return path
    sent = SparkFiles.get(os.path.basename(path.rstrip("/")))
    if os.path.exists(sent):
        return sent
    if os.path.basename(path) == os.path.basename(DEFAULT_LEXICON):
        to = Path(tempfile.mkdtemp(prefix="kotoflow-lexicon-")) / os.path.basename(path)
        to.write_bytes(pkgutil.get_data(__package__, to.name))
        return str(to)
    raise FileNotFoundError(f"{path}: neither here nor among the files sent with lexicon.ship(spark, ...)")


def ship(spark: SparkSession, *paths: str) -> None:
    """Send lexicon files or directories to all executors, under their own names."""
    names = [os.path.basename(p.rstrip("/")) for p in paths]
    if len(set(names)) < len(names):
        raise ValueError(f"lexicons need different names: {names}")
    for p in paths:
        spark.sparkContext.addFile(p, recursive=os.path.isdir(p))


def read_rows(path: str):
    """Rows of one CSV or Parquet file, or of all .csv and .parquet files of a directory, in order."""
    files = sorted(str(p) for p in Path(path).rglob("*") if p.suffix in (".csv", ".parquet")) if os.path.isdir(path) else [path]
    for f in files:
        if f.endswith(".parquet"):
            for batch in pq.ParquetFile(f).iter_batches(columns=COLUMNS):
                for row in batch.to_pylist():
                    yield ["" if row[c] is None else str(row[c]) for c in COLUMNS]
            continue
        with open(f, encoding="utf-8", newline="") as h:
            for row in csv.reader(h):
                if row and len(row) < 15:
                    raise ValueError(f"{f}: a row has {len(row)} fields, 15 are needed: {row[:3]}")
                if row:
                    yield row[:15]


def read_matrix(path: str) -> np.ndarray:
    """Connection costs from a matrix.def text: sizes, then right id, left id, cost."""
    with open(path, encoding="utf-8") as h:
        r, c = map(int, h.readline().split())
        m = np.zeros((r, c), dtype=np.int16)
        for line in h:
            if line.strip():
                a, b, cost = map(int, line.split())
                m[a, b] = cost
    return m


@lru_cache(maxsize=4)
def load(paths: tuple[str, ...] = (DEFAULT_LEXICON,), key: str = "") -> Lexicon:
    """One search structure per worker and lexicon version; later files (user lexicons) compete by cost.

    A directory may hold the definitions of its dictionary: char.def and unk.def,
    matrix.def, pos-id.def, left-id.def and right-id.def.  With a key (see
    :func:`version`) the files found here must be those it was made from.
    """
    found = tuple(local_path(p) for p in paths)
    if key and version(found) != key:
        raise ValueError(f"lexicon files {paths} differ from those the job was planned with")
    out = Lexicon()
    for p in found:
        if os.path.isdir(p):
            _definitions(out, Path(p))
        for row in read_rows(p):
            out.add(row)
    return out


def _definitions(out: Lexicon, d: Path) -> None:
    has = {x: str(d / x) for x in ("char.def", "unk.def", "matrix.def", "pos-id.def", "left-id.def", "right-id.def") if (d / x).exists()}
    if {"char.def", "unk.def", "pos-id.def"} & set(has):
        categories, ranges = read_char_def(has["char.def"]) if "char.def" in has else (None, None)
        out.rules = Rules(categories, ranges, read_unk_def(has["unk.def"]) if "unk.def" in has else None, read_pos_ids(has["pos-id.def"]) if "pos-id.def" in has else None)
    if "matrix.def" in has:
        out.matrix = read_matrix(has["matrix.def"])
    if "left-id.def" in has:
        out.left_ids = read_context_ids(has["left-id.def"])
    if "right-id.def" in has:
        out.right_ids = read_context_ids(has["right-id.def"])


def version(paths: tuple[str, ...]) -> str:
    """Content hash of the lexicon files; a changed file is another cache key."""
    h = hashlib.sha256()
    for p in paths:
        for f in sorted(Path(p).rglob("*")) if os.path.isdir(p) else [Path(p)]:
            if f.is_file():
                h.update(f.name.encode() + f.read_bytes())
    return h.hexdigest()


def read_lexicon(spark: SparkSession, *paths: str) -> DataFrame:
    """Lexicon rows as a table (sources may be anywhere Spark reads)."""
    return spark.read.schema(DDL).csv(list(paths))


def compile_lexicon(spark: SparkSession, to: str, *paths: str) -> DataFrame:
    """Dictionary build: CSV rows to a Parquet lexicon sorted by surface."""
    read_lexicon(spark, *paths).repartitionByRange("surface").sortWithinPartitions("surface", "cost").write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def category_table(spark: SparkSession) -> DataFrame:
    """Code-point ranges with their categories; of the ranges that hold a character the one with the highest priority counts."""
    return spark.createDataFrame([(i, lo, hi, k[0], list(k)) for i, (lo, hi, k) in enumerate(_RANGES)], "priority int, lo int, hi int, category string, categories array<string>")


def unknown_table(spark: SparkSession) -> DataFrame:
    """How unknown words are made and taken, by category."""
    rows = [(k, *CATEGORIES[k], cost, feature) for k, (cost, feature) in UNKNOWN.items()]
    return spark.createDataFrame(rows, "category string, invoke boolean, grouped boolean, length int, cost int, feature string")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file under a path, computed where the files are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).selectExpr("path", "length", "sha2(content, 256) AS sha256")
