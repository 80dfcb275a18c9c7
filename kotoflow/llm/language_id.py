"""Language identification: family first, then one-versus-one linear SVMs inside it.

A text becomes hashed character 1- to 3-gram shares (square roots, so the vector
has length one).  One linear SVM per family picks the language family; inside
the family every pair of languages has its own linear SVM, and the language
with most duels won is predicted.  Models are fitted on a bounded sample of
labelled texts; every whole text is classified.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
ORDERS = 3
#: Labelled texts per language that the models are fitted on, about (drawn by a hash of the id).
SAMPLE_PER_LANGUAGE = 400
#: Languages that are learned, at most: bounds what the driver holds and the pairs of languages.
MAX_LANGUAGES = 128
UNKNOWN = "und"
#: A text is certain from this share of the margins that nearly all labelled sample texts reach (all but FLOOR_QUANTILE).
FLOOR_SHARE, FLOOR_QUANTILE = 0.3, 0.01

# Language codes by family.  A code that is not listed is a family of its own.
FAMILIES: dict[str, str] = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu se",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi ur bn pa gu mr ne si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "malayic": "id ms jv su tl",
}


def family_of(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), base)


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), dtype=np.uint32, count=0x110000)
    return _LETTERS


def features(text: str | None) -> np.ndarray | None:
    """Feature vector of a whole text, or None if it has no letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = _letters()[c]
    if not (c != 32).any():
        return None
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    total, gram = np.zeros(BUCKETS), np.zeros(len(c), dtype=np.uint32)
    for order in range(1, ORDERS + 1):
        gram = (gram[: len(c) - order + 1] * np.uint32(0x01000193)) ^ c[order - 1 :]
        hashed = ((gram + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        if len(hashed):
            total += np.bincount(hashed, minlength=BUCKETS) / (len(hashed) * ORDERS)
    return np.sqrt(total).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (squared hinge, dual coordinate descent); y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x * x).sum(axis=1) + 0.5 / c
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Model:
    """Family SVMs (one against the rest) and, by family, duel SVMs."""

    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    duels: dict[str, tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]] = field(default_factory=dict)
    #: Least winning family and duel margins of a certain text, from the sample.
    family_floor: float = 0.0
    duel_floor: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        m, names = cls(), np.array(langs)
        groups = np.array([family_of(v) for v in langs])
        m.families = sorted(set(groups.tolist()))
        if len(m.families) > 1:
            fits = [linear_svm(x, np.where(groups == f, 1.0, -1.0)) for f in m.families]
            m.family_w, m.family_b = np.stack([w for w, _ in fits]), np.array([b for _, b in fits])
        for f in m.families:
            m.languages[f] = own = sorted(set(names[groups == f].tolist()))
            pairs = list(combinations(range(len(own)), 2))
            fits = []
            for a, b in pairs:
                use = (names == own[a]) | (names == own[b])
                fits.append(linear_svm(x[use], np.where(names[use] == own[a], 1.0, -1.0)))
            if fits:
                m.duels[f] = np.stack([w for w, _ in fits]), np.array([b for _, b in fits]), pairs
        reached = [np.array(g)[np.isfinite(g)] for g in zip(*(m._decide(v)[2:] for v in x), strict=True)]
        m.family_floor, m.duel_floor = (max(0.0, FLOOR_SHARE * float(np.quantile(g, FLOOR_QUANTILE))) if len(g) else 0.0 for g in reached)
        return m

    def predict(self, v: np.ndarray | None) -> tuple[str, float]:
        """Language and a confidence from 0 to 1 (the product of both steps' logistic margins)."""
        return self._decide(v)[:2]

    def certain(self, v: np.ndarray | None, min_score: float = 0.0) -> bool:
        """Whether the text has a known language: its score and both absolute winning margins are high enough.

        The score compares languages with each other only; a text in none of
        them lies near zero for all, which the margins show.
        """
        lang, score, family, duel = self._decide(v)
        return lang != UNKNOWN and score >= min_score and family >= self.family_floor and duel >= self.duel_floor

    def _decide(self, v: np.ndarray | None) -> tuple[str, float, float, float]:
        """Language, confidence and the winner's family and least duel margin (infinite where there is no choice)."""
        if v is None or not self.families:
            return UNKNOWN, 0.0, 0.0, 0.0
        family, score, sure = self.families[0], 1.0, np.inf
        if self.family_w is not None:
            margins = self.family_w @ v + self.family_b
            k = int(np.argmax(margins))
            rest = np.delete(margins, k).max()
            family, score, sure = self.families[k], 1 / (1 + np.exp(-2 * (margins[k] - rest))), float(margins[k])
        own = self.languages[family]
        if len(own) == 1:
            return own[0], float(score), sure, np.inf
        w, b, pairs = self.duels[family]
        margins = w @ v + b
        won, least = np.zeros(len(own)), np.full(len(own), np.inf)
        for (p, q), g in zip(pairs, margins, strict=True):
            won[p] += g >= 0
            won[q] += g < 0
            least[p], least[q] = min(least[p], g), min(least[q], -g)
        k = max(range(len(own)), key=lambda i: (won[i], least[i], -i))
        return own[k], float(score / (1 + np.exp(-4 * least[k]))), sure, float(least[k])


def held_out(id_col: str) -> Column:
    """True where crc32 of the id's text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` labelled rows of each language, none held out.

    Rows without text, letters or label teach nothing; no labelled rows at all
    give a model that answers ``und``.  Of more than MAX_LANGUAGES labels the
    commonest are learned.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    # at most MAX_LANGUAGES rows come to the driver, whatever the label column holds
    common = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in common.collect()}
    if not counts:
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def vectors(batches):
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(0)]
            keep = [i for i, v in enumerate(got) if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int32())), batch.column(2).take(pa.array(keep, pa.int32())), pa.array([zlib.compress(got[i].tobytes()) for i in keep], pa.binary())], names=["lang", "id", "v"])

    # features, not texts, come to the driver: their size is bounded by construction
    sample = rows.where(drawn).select("text", "lang", "id").mapInArrow(vectors, "lang string, id string, v binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["id"] or "", r["v"]))
    if not sample:
        return Model()
    x = np.stack([np.frombuffer(zlib.decompress(r["v"]), dtype=np.float32) for r in sample])
    return Model.fit(x, [r["lang"] for r in sample])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows with ``lang_pred`` and ``score`` added (same-named columns are replaced).

    A null text, an empty one and one without letters are ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*(f"`{c}`" for c in keep)).schema.add("lang_pred", "string").add("score", "double")
    at = keep.index(text_col)

    def rows(batches):
        for batch in batches:
            got = [shared.value.predict(features(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return docs.select(*(f"`{c}`" for c in keep)).mapInArrow(rows, schema)


def keep_known(docs: DataFrame, model: Model, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with at least ``min_score`` and certain margins; columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def rows(batches):
        for batch in batches:
            yield batch.filter(pa.array([bool(shared.value.certain(features(t.as_py()), min_score)) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
