"""Secret scans with a random forest that removes false positives, in SQL functions only.

Patterns propose candidates; each gets features - length, character
transitions, dictionary coverage, its path and its neighbouring words - and a
random forest trained from labelled findings scores it.  The forest is trained
on the driver from a bounded list and becomes one SQL expression, so the main
path runs inside the JVM: no Python function, pandas, Arrow or RDD there.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES = 15
DEPTH = 5
#: Labelled findings that the forest is trained from (made by rule, see ``labelled_findings``).
FINDINGS = 4000
THRESHOLD = 0.5

# Published shapes of credentials.  All regular expressions here
# read alike in Java and Python.
_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
_ASSIGN = r"[A-Za-z0-9_\-]*?(?=[pPsStTaA])" + _NAME + r"""[ \t]*[=:][ \t]*["']?"""
# A key block reaches to its END line, or without one over the lines that look like a body.
_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^\-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:[ \t]*\r?\n[A-Za-z0-9+/=]{16,}+(?![^\r\n]))*+)"
# Published formats may begin after a '/', '-' or '+' of a longer run.
_KNOWN = r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[0-9A-Za-z_\-]{30,}+|eyJ[A-Za-z0-9_\-]{10,}+)"
# A generic run ends before a known format inside it.
_RUN = r"(?:[A-Za-z0-9_]|[+/\-](?!" + _KNOWN + r")){16,}+"
# Every alternative starts at the border of a word, so a position inside a word costs one look back.
_PATTERN = _BLOCK + r"|(?<![A-Za-z0-9_\-])" + _ASSIGN + r"""[^ \t\r\n"']{6,}+|(?<![A-Za-z0-9_])""" + _KNOWN + r"|(?<![A-Za-z0-9_+/\-])" + _RUN
_KINDS = [
    ("private_key", r"^-----BEGIN"),
    ("aws_access_key", r"^(AKIA|ASIA)[0-9A-Z]{16}$"),
    ("github_token", r"^gh[pousr]_[A-Za-z0-9]{30,}$"),
    ("slack_token", r"^xox[abprs]-[A-Za-z0-9\-]{10,}$"),
    ("stripe_key", r"^[rs]k_live_[A-Za-z0-9]{16,}$"),
    ("google_api_key", r"^AIza[0-9A-Za-z_\-]{30,}$"),
    ("jwt", r"^eyJ[A-Za-z0-9_\-]{10,}"),
]
_BIGRAMS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|ri|ro|ic|ne|ea|ra|li|ch|ll|be|ma|si|om|ur"
_WORDS = "example|sample|placeholder|changeme|change|your|test|demo|dummy|fake|password|passwd|secret|token|key|here|none|null|admin|user|name|login|release|version|notes|guide|page|section|build|image|file|path|data|config|value|string|index|default|options|number|reader|xxx+|abc|qwerty|12345+"
_BENIGN = r"(?i)(commit|sha-?[0-9]*|md5|checksum|digest|uuid|guid|revision|hash|etag|integrity|base64,|blob|tree|card|order|isbn|phone|tel|call)[^A-Za-z]{0,6}$"
_TELLING = r"(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key[_a-z]*|auth|bearer|credential)[^A-Za-z0-9]{0,6}$"
_TEST_PATH = r"(?i)(^|[/_.\-])(test|tests|spec|example|examples|docs|fixture|fixtures|mock|sample|samples)([/_.\-]|$)"

#: (name, Spark SQL over @value, @before, @after, @path and @kind)
FEATURES: list[tuple[str, str]] = [
    ("n", "cast(length(@value) as double)"),
    ("transitions", "regexp_count(@value, '[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+') / cast(length(@value) as double)"),
    ("bigrams", f"regexp_count(lower(@value), '{_BIGRAMS}') / cast(length(@value) as double)"),
    ("dictionary", f"1 - length(regexp_replace(lower(@value), '{_WORDS}', '')) / cast(length(@value) as double)"),
    ("digits", "regexp_count(@value, '[0-9]') / cast(length(@value) as double)"),
    ("upper", "regexp_count(@value, '[A-Z]') / cast(length(@value) as double)"),
    ("distinct", "size(array_distinct(split(@value, ''))) / cast(length(@value) as double)"),
    ("hex", "cast(regexp_like(@value, '^[0-9a-f]+$') as double)"),
    ("only_digits", "cast(regexp_like(@value, '^[0-9]+$') as double)"),
    ("known", "cast(@kind not in ('generic', 'assigned') as double)"),
    ("telling", f"cast(regexp_like(@before, r'{_TELLING}') as double)"),
    ("benign", f"cast(regexp_like(@before, r'{_BENIGN}') as double)"),
    ("quoted", """cast(substring(@after, 1, 1) in ("'", '"') as double)"""),
    ("test_path", f"cast(regexp_like(@path, r'{_TEST_PATH}') as double)"),
]


def _named(sql: str, of: str = "") -> str:
    """SQL with its @names read from columns, or from the fields of ``of``."""
    return re.sub("@([a-z]+)", (of + "." if of else "") + r"\1", sql)


def kind_of(value: str, assigned: bool) -> str:
    for kind, shape in _KINDS:
        if re.search(shape, value):
            return kind
    return "assigned" if assigned else "generic"


def features_of(value: str, kind: str, before: str, after: str, path: str) -> list[float]:
    """The same features in Python, for training and tests."""
    n, low = len(value), value.lower()
    count = lambda p, v: len(re.findall(p, v))
    return [
        float(n),
        count("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+", value) / n,
        count(_BIGRAMS, low) / n,
        1 - len(re.sub(_WORDS, "", low)) / n,
        count("[0-9]", value) / n,
        count("[A-Z]", value) / n,
        len(set(value)) / n,
        float(bool(re.fullmatch("[0-9a-f]+", value))),
        float(bool(re.fullmatch("[0-9]+", value))),
        float(kind not in ("generic", "assigned")),
        float(bool(re.search(_TELLING, before, re.ASCII))),
        float(bool(re.search(_BENIGN, before, re.ASCII))),
        float(after[:1] in ("'", '"') if after else False),
        float(bool(re.search(_TEST_PATH, path, re.ASCII))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, is secret): findings made by rule, half of them false positives."""
    rng = random.Random(seed)
    pick = lambda a, k: "".join(rng.choice(a) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, al = "0123456789abcdef", low + up + dig
    syll = "th he in er an re on at en nd ti es or ing tion ed ou sch ein la que de os ción".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 5)))
    prose = lambda: " ".join(word() for _ in range(4)) + rng.choice([" ", ". ", ": "])
    ask = lambda: prose() + rng.choice(["password=", "token = \"", "secret: ", "api_key=", "PASSWORD = '", "auth: ", "access_key=\"", "pwd="])
    path = lambda: rng.choice(["src0", "src14", "", "app/settings.py", "conf/prod.env", "lib/db.rb", "deploy/main.tf", "tests/fixtures/a.json", "docs/guide.md", "notes.txt"])
    out = []
    for _ in range(n // 2):
        value, before = rng.choice(
            [
                lambda: ("AKIA" + pick(up + dig, 16), prose()),
                lambda: ("AKIA" + pick(up + dig, 16), prose() + "aws_access_key_id = "),
                lambda: (pick(hexa, rng.choice([16, 18, 20, 32, 40, 64])), ask()),
                lambda: (pick(al, rng.randrange(10, 44)), ask()),
                lambda: (pick(al + "!@#$%", rng.randrange(9, 20)), ask()),
                lambda: (rng.choice(["ghp_", "gho_"]) + pick(al, 36), rng.choice([prose(), ask()])),
                lambda: ("xoxb-" + pick(dig, 11) + "-" + pick(al, 24), rng.choice([prose(), ask()])),
                lambda: ("sk_live_" + pick(al, 24), rng.choice([prose(), ask()])),
                lambda: ("AIza" + pick(al + "_-", 35), rng.choice([prose(), ask()])),
                lambda: ("eyJ" + pick(al, 40), rng.choice([prose() + "Bearer ", ask()])),
                lambda: ("-----BEGIN RSA PRIVATE KEY-----", prose()),
            ]
        )()
        out.append((value, before, rng.choice([" ", '"', "\n", ""]), path(), 1))
        value, before = rng.choice(
            [
                lambda: ("AKIA" + pick(up, 9) + "EXAMPLE", rng.choice([prose(), ask()])),
                lambda: (rng.choice(["changeme", "your_password", "your-token-here", "example", "placeholder", "test", "secret", "xxxxxxxx", "dummy_key", "none", "qwerty"]) + pick(dig, rng.choice([0, 1, 3])) + rng.choice(["", "_here", "-example"]) + "xx", ask()),
                lambda: (pick(hexa, rng.choice([32, 40, 64])), prose() + rng.choice(["commit ", "sha256:", "md5 ", "checksum: ", "digest ", "etag ", "revision "])),
                lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), prose() + rng.choice(["", "uuid ", "guid: "])),
                lambda: (pick(dig, rng.randrange(16, 22)), prose()),
                lambda: (pick(hexa, rng.choice([16, 32, 40])), prose()),
                lambda: (rng.choice("-_/").join(word() for _ in range(rng.randrange(3, 7))) + pick(dig, rng.choice([1, 2, 4])), prose()),
                lambda: (rng.choice("-_/").join([word(), "release", "version", word()]) + pick(dig, 2), prose()),
                lambda: ("".join(word().capitalize() for _ in range(5)) + pick(dig, 1), prose()),
                lambda: (pick(al + "+/", rng.randrange(40, 90)), prose() + "base64,"),
                lambda: (word() + word() + word(), ask()),
            ]
        )()
        if len(value) >= 6:
            out.append((value, before, rng.choice([" ", '"', "\n", ""]), path(), 0))
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """One CART tree: a leaf's share of secrets, or (feature, threshold, left, right)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 10 or p in (0.0, 1.0):
        return round(p, 6)
    best = None
    for j in rng.choice(x.shape[1], size=5, replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, w = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n = np.arange(1, len(v))[cut]
        a, b = w[cut] / n, (w[-1] - w[cut]) / (len(v) - n)
        gini = n * a * (1 - a) + (len(v) - n) * b * (1 - b)
        k = int(np.argmin(gini))
        if best is None or gini[k] < best[0]:
            best = float(gini[k]), int(j), round(float(v[cut[k]] + v[cut[k] + 1]) / 2, 6)
    if best is None:
        return round(p, 6)
    _, j, t = best
    left = x[:, j] <= t
    if left.all() or not left.any():
        return round(p, 6)
    return j, t, _grow(x[left], y[left], depth - 1, rng), _grow(x[~left], y[~left], depth - 1, rng)


@lru_cache(maxsize=4)
def forest(trees: int = TREES, depth: int = DEPTH, n: int = FINDINGS) -> tuple:
    """Random forest from the labelled findings; the same on every run."""
    found = labelled_findings(n)
    x = np.array([features_of(v, kind_of(v, bool(re.search(_TELLING, b, re.ASCII))), b, a, p) for v, b, a, p, _ in found])
    y = np.array([f[4] for f in found], dtype=float)
    rng = np.random.default_rng(11)
    out = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        out.append(_grow(x[own], y[own], depth, rng))
    return tuple(out)


def score_of(v: list[float], trees: tuple) -> float:
    def walk(node):
        while isinstance(node, tuple):
            node = node[2] if v[node[0]] <= node[1] else node[3]
        return node

    return sum(walk(t) for t in trees) / len(trees)


def _tree_sql(node) -> str:
    if not isinstance(node, tuple):
        return f"{node}D"
    j, t, a, b = node
    return f"if(@{FEATURES[j][0]} <= {t}D, {_tree_sql(a)}, {_tree_sql(b)})"


def _score_sql() -> str:
    trees = forest()
    return f"round(({' + '.join(map(_tree_sql, trees))}) / {len(trees)}, 6)"


_KIND_SQL = "case " + " ".join(f"when regexp_like(@value, r'{shape}') then '{name}'" for name, shape in _KINDS) + " when length(@named) > 0 then 'assigned' else 'generic' end"
_ANY_KIND = "|".join(shape for _, shape in _KINDS)
_KEPT_SQL = f"length(@named) > 0 and length(@value) >= 6 or regexp_like(@value, '[0-9]') and length(@value) >= 16 or regexp_like(@value, r'{_ANY_KIND}')"


def _with_candidates(docs: DataFrame, text: Column, path: Column) -> DataFrame:
    """Rows with ``__c``: the text's candidates as structs (start, kind, value, before, after, path)."""
    rows = docs.withColumns({"__text": text.cast("string"), "__path": F.coalesce(path.cast("string"), F.lit("")), "__assign": F.lit("^" + _ASSIGN)})
    # explode of a one-element array: what follows reads the matches, it does not search again
    rows = rows.withColumn("__m", F.explode(F.array(F.regexp_extract_all("__text", F.lit(_PATTERN), F.lit(0)))))
    some = F.size("__m") > 0
    rows = rows.withColumn("__between", F.explode(F.array(F.when(some, F.split("__text", _PATTERN, -1)))))
    # where each match begins: lengths of all that stands before it
    begun = "aggregate(sequence(0, size(__m) - 1), cast(array(length(__between[0])) as array<long>), (a, i) -> array_append(a, element_at(a, -1) + length(__m[i]) + length(__between[i + 1])))"
    rows = rows.withColumn("__at", F.explode(F.array(F.when(some, F.expr(begun)))))
    found = "transform(__m, (x, i) -> struct(x as m, regexp_extract(x, __assign, 0) as named, __at[i] as at, right(__between[i], 80) as before, left(__between[i + 1], 40) as after))"
    found = f"transform({found}, x -> struct(x.m as m, x.named as named, x.at as at, x.before as before, x.after as after, rtrim('.,;:)]}}', substring(x.m, length(x.named) + 1)) as value))"
    found = f"filter({found}, x -> {_named(_KEPT_SQL, 'x')})"
    found = f"transform({found}, x -> struct(x.at + length(x.named) as start, {_named(_KIND_SQL, 'x')} as kind, x.value as value, concat(x.before, x.named) as before, concat(substring(x.m, length(x.named) + length(x.value) + 1), x.after) as after, __path as path))"
    return rows.withColumn("__c", F.explode(F.array(F.when(some, F.expr(found))))).drop("__text", "__path", "__m", "__between", "__at", "__assign")


def findings(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: ``doc_id, start, n_chars, kind, value, before, after, path, score, is_secret``.

    ``start`` counts code points from 0.  Null and empty texts have no
    candidates; a null path counts as empty; repeated rows are scanned each; an
    empty table gives no rows.  Whole texts are scanned, and other columns are
    ignored whatever their names.
    """
    rows = _with_candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__t"), path.alias("__p")), F.col("__t"), F.col("__p"))
    rows = rows.where(F.size("__c") > 0).select("doc_id", F.explode("__c").alias("c")).select("doc_id", "c.start", F.length("c.value").cast("long").alias("n_chars"), "c.kind", "c.value", "c.before", "c.after", "c.path")
    scored = rows.withColumns({name: F.expr(_named(sql)) for name, sql in FEATURES}).withColumn("score", F.expr(_named(_score_sql())))
    return scored.withColumn("is_secret", F.col("score") >= threshold).drop(*(n for n, _ in FEATURES))


def redact(docs: DataFrame, path: Column, text_col: str = "text", mark: str = "<SECRET>", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every confirmed secret replaced by ``mark``, wherever its
    text has it; all rows and columns stay.

    Row-local: no join and no shuffle, so repeated and null ids are safe.
    """
    features = ", ".join(f"{_named(sql, 'x')} as {name}" for name, sql in FEATURES)
    values = f"transform(filter(transform(transform(__c, x -> struct(x.value as value, {features})), x -> struct(x.value as value, {_named(_score_sql(), 'x')} as score)), x -> x.score >= {threshold}D), x -> x.value)"
    longest = f"array_sort(array_distinct({values}), (a, b) -> case when length(a) > length(b) then -1 when length(a) < length(b) then 1 when a < b then -1 when a > b then 1 else 0 end)"
    # the caller's columns get names of ours meanwhile, so none can clash
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(names)), path.alias("own_path"))
    text = f"own{names.index(text_col)}"
    rows = _with_candidates(own, F.col(text), F.col("own_path"))
    clean = F.when(F.size("__c") > 0, F.aggregate(F.expr(longest), F.col(text), lambda t, v: F.replace(t, v, F.lit(mark)))).otherwise(F.col(text))
    return rows.withColumn(text, clean).select(*(F.col(f"own{i}").alias(c) for i, c in enumerate(names)))


def brute_force(text: str | None, path: str | None, threshold: float = THRESHOLD) -> list[tuple]:
    """(start, n_chars, kind, value, score, is_secret) of one text, in Python; for tests."""
    out, trees, last = [], forest(), 0
    matches = list(re.finditer(_PATTERN, text or "", re.ASCII))
    for k, m in enumerate(matches):
        until = matches[k + 1].start() if k + 1 < len(matches) else len(text)
        before, after = text[last : m.start()][-80:], text[m.end() : until][:40]
        last = m.end()
        named = (re.match(_ASSIGN, m[0], re.ASCII) or [""])[0]
        value = m[0][len(named) :].rstrip(".,;:)]}")
        if not (named and len(value) >= 6 or re.search("[0-9]", value) and len(value) >= 16 or re.search(_ANY_KIND, value)):
            continue
        kind = kind_of(value, bool(named))
        after = m[0][len(named) + len(value) :] + after
        score = round(score_of(features_of(value, kind, before + named, after, path or ""), trees), 6)
        out.append((m.start() + len(named), len(value), kind, value, score, score >= threshold))
    return out
