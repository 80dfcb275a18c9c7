"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of word shingles; two documents link when the Jaccard
similarity of their *full* sets reaches the threshold, and the result is the
connected components of those links.

1. Documents with equal sets collapse into one *representative* (the smallest
   id); copies are never paired.
2. Each representative gets ``COORDINATES`` minwise tokens ``(i, min_i)``.  An
   independent tree sends every representative down a path of tokens, each
   coordinate chosen by the node reached so far.  The first ``START`` levels are
   walked at once, one child each, so that hardly a node holds texts that only
   share a common phrase; more trees make up for what single children lose.  A
   node with more than ``LEAF`` members branches on: each member goes to its
   tokens of ``BRANCHES`` further coordinates.  Nodes whose members already form one
   component are closed.  A large node whose members can be compared for a bounded
   number of copies of each, and any large node at the last depth, is cut into
   parts that meet block by block: nothing is left uncompared.
3. Small nodes, equal ones of several trees once, are compared exhaustively on
   their tokens; similar members form a candidate cluster.  Clusters fetch the whole
   texts, and every pair of a cluster that is not connected yet is confirmed on
   the full sets (as ascending 64-bit shingle hashes).  Clusters with very many
   shingles are confirmed in blocks of members, each pair of blocks once.
4. Trees run in two batches; what the first has connected is closed in the second.
   The first batch only finds what is easy: it cuts large nodes by a hash, so that
   large groups of copies are one component before anything is compared block by
   block.  The trees of the second batch are whole: of a pair at the threshold t one
   tree loses ``tree_miss(t)`` at most at any depth (0.52 for 0.8, 0.41 for 0.85),
   and the batch tree_miss(t) ** (TREES - FIRST_TREES), which is 5e-5 and 1e-6.

No task holds more than a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kotoflow.llm.common import LOWER_AZ, Tables, fresh, write_table

COORDINATES = 128
TREES = 18
#: Trees of the first batch; the others run on what it left open.
FIRST_TREES = 3
#: Levels of a tree that are walked at once, without branching.
START = 3
#: Children that each member of a large node is sent to; more than 1 / threshold, or deep pairs are lost.
BRANCHES = 2
LEAF = 1024
#: Levels below the first START.
MAX_DEPTH = 8
#: A large node is compared block by block instead of branching if that makes at most so many rows of each member.
BLOCK_COPIES = 8
#: A similar pair agrees in as many coordinates as a pair at the threshold does, less so many deviations.
DEVIATIONS = 4.0
#: Candidate rows (three numbers each) that may be broadcast to the scan that fetches their texts.
BROADCAST_ROWS = 1_000_000
#: Shingles of one block of a cluster that is confirmed in blocks (8 bytes each, two blocks in a task).
BLOCK_SHINGLES = 2_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (U+0020, U+0009 to U+000D)."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_AZ).split() if text else []


def shingle_set(text: str | None, k: int) -> set[tuple]:
    """Distinct k-word shingles; the whole sequence if it is shorter; empty without words."""
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k)), strict=False))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, ascending."""
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    m = min(k, len(w))
    n = len(w) - m + 1
    x = np.full(n, m, dtype=np.uint64)
    for i in range(m):
        x = mix((x + h[i : i + n]) * _M1 + np.uint64(i))
    return np.unique(x)


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _M1).astype(np.uint32)
    return seeds[:COORDINATES] | np.uint32(1), seeds[COORDINATES:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens, one row of COORDINATES uint16 per (non-empty) set."""
    a, b = _coordinates()
    out = np.empty((len(sets), COORDINATES), dtype=np.uint16)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[:-1]]))).astype(np.int64)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(x * a[i] + b[i], starts).astype(np.uint16)
    return out


#: Rows that are fingerprinted at a time.
_SLICE = 128


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``doc_id, n, k1, k2, sig``: set size, 128-bit set key and signature (null without words)."""

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                sets = [shingle_hashes(t.as_py(), k) for t in part.column(1)]
                some = [s for s in sets if len(s)]
                sig = iter(signatures(some) if some else ())
                with np.errstate(over="ignore"):
                    k1 = [int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
                    k2 = [int(mix(s * _M1).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "sig"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, "doc_id long, n long, k1 long, k2 long, sig binary")


def _node(path: np.ndarray, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Id of the child that a minwise token leads to."""
    return mix(mix(path * _M1 + coordinate.astype(np.uint64)) + token.astype(np.uint64))


def _drawn(path: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First coordinate that each node draws, and the (odd) step to its children's others."""
    drawn = mix(path ^ mix(np.full(len(path), depth + 1, dtype=np.uint64) * _M1))
    return (drawn % np.uint64(COORDINATES)).astype(np.int64), 2 * ((drawn >> np.uint64(32)) % np.uint64(COORDINATES // 2)).astype(np.int64) + 1


def _tokens(sigs: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint16).reshape(n, COORDINATES)


def _roots(reps: DataFrame, trees: range) -> DataFrame:
    """Nodes of the trees at depth START: ``node, rep``."""

    def rows(batches):
        for batch in batches:
            rep, n = batch.column(0), batch.num_rows
            if not n:
                continue
            sig = _tokens(batch.column(1), n)
            for t in trees:
                path, own = mix(np.full(n, t + 1, dtype=np.uint64) * _M2), np.full(n, t)
                for level in range(START):
                    i = own if level == 0 else _drawn(path, MAX_DEPTH + level)[0]
                    path = _node(path, i, sig[np.arange(n), i])
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), rep], names=["node", "rep"])

    return reps.select("rep", "sig").mapInArrow(rows, "node long, rep long")


def tree_miss(threshold: float, depth: int = MAX_DEPTH) -> float:
    """Probability that one whole tree parts a pair at the threshold, at most, when its nodes branch down to ``depth``."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - threshold + threshold * lost) ** BRANCHES
    return 1 - threshold**START * (1 - lost)


def _branch(members: DataFrame, depth: int) -> DataFrame:
    """Children of large nodes: ``node, rep`` from ``node, rep, sig``."""

    def rows(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            path, sig = batch.column(0).to_numpy().view(np.uint64), _tokens(batch.column(2), n)
            first, step = _drawn(path, depth)
            for child in range(BRANCHES):
                # odd steps: the children of a node have different coordinates
                i = (first + child * step) % COORDINATES
                yield pa.RecordBatch.from_arrays([pa.array(_node(path, i, sig[np.arange(n), i]).view(np.int64)), batch.column(1)], names=["node", "rep"])

    return members.select("node", "rep", "sig").mapInArrow(rows, "node long, rep long")


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _open_members(tables: Tables, nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``node, rep, comp, n``: members of nodes that hold more than one component."""
    named = nodes.withColumn("comp", F.col("rep")) if comps is None else nodes.join(_small(comps), "rep", "left").select("node", "rep", F.coalesce("comp", "rep").alias("comp"))
    stats = named.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("node", "n")
    return named.join(_small(tables.write(stats, "near-open")), "node")


def _blocks(large: DataFrame) -> DataFrame:
    """Leaf-sized blocks of large nodes: ``node, rep, comp, side`` from ``node, rep, comp, main, m, n``.

    The members of component ``main`` and the rest are dealt into parts; every
    part of the rest meets itself, the other parts of the rest and all parts of
    ``main``.  Members of two parts have side 0 and 1 of the block where these meet.
    """
    ours, rest = F.ceil(F.col("m") / (LEAF // 2)).cast("int"), F.ceil((F.col("n") - F.col("m")) / (LEAF // 2)).cast("int")
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("rep", "node"), F.when(is_main, ours).otherwise(rest)).cast("int")

    def block(a, b, side, kind):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))

    with_rest = F.transform(F.sequence(F.lit(0), rest - 1), lambda j: block(own, j, F.lit(0), "main"))
    with_main = F.transform(F.sequence(F.lit(0), ours - 1), lambda i: block(i, own, F.lit(1), "main"))
    among = F.transform(F.sequence(F.lit(0), rest - 1), lambda j: block(F.least(j, own), F.greatest(j, own), F.when(j == own, F.lit(-1)).otherwise((own > j).cast("int")), "rest"))
    met = large.select("node", "rep", "comp", F.explode(F.when(is_main, with_rest).otherwise(F.concat(with_main, among))).alias("x"))
    return met.select(F.xxhash64("node", "x.kind", "x.a", "x.b").alias("node"), "rep", "comp", F.col("x.side").alias("side"))


def _leaves(tables: Tables, reps: DataFrame, comps: DataFrame | None, trees: range) -> DataFrame:
    """Small open nodes of the trees, equal ones once: ``node, rep, comp, side`` (side -1: all pairs of the node; else only 0 with 1)."""
    nodes, leaves = _roots(reps, trees), []
    whole = F.lit(-1).alias("side")
    for depth in range(MAX_DEPTH + 1):
        members = tables.write(_open_members(tables, nodes, comps), "near-members")
        leaves.append(members.where(F.col("n") <= LEAF).select("node", "rep", "comp", whole))
        large = members.where(F.col("n") > LEAF)
        if not large.head(1):
            break
        if comps is None:
            # first pass: leaf-sized parts, different ones in each tree; the whole trees compare what these leave open
            part = F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("n") / (LEAF // 2)))
            leaves.append(large.select(F.xxhash64("node", part).alias("node"), "rep", "comp", whole))
            break
        most = large.groupBy("node", "comp").count().groupBy("node").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main"), F.max("count").alias("m"))
        large = large.join(_small(tables.write(most, "near-main")), "node")
        m, r = F.col("m"), F.col("n") - F.col("m")
        ours, rest = F.ceil(m / (LEAF // 2)), F.ceil(r / (LEAF // 2))
        blocks = m * rest + r * (ours + rest) <= BLOCK_COPIES * F.col("n") if depth < MAX_DEPTH else F.lit(True)
        leaves.append(_blocks(large.where(blocks)))
        if depth < MAX_DEPTH:
            onward = large.where(~blocks).select("node", "rep").join(reps.select("rep", "sig"), "rep")
            nodes = tables.write(_branch(onward, depth), "near-nodes")
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionAll(x)
    # a group of copies makes the same small node in most trees; no node has more than a leaf's members
    sets = out.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rep", "comp", "side"))).alias("all"))
    once = sets.groupBy(F.xxhash64("all").alias("h"), F.hash("all").alias("g"), F.size("all").alias("n")).agg(F.first("all").alias("all"), F.min("node").alias("node"))
    return once.select("node", F.inline("all"))


def agreement_cut(threshold: float) -> int:
    """Coordinates in which a pair at the threshold agrees, at least."""
    p = threshold + (1 - threshold) / 65536
    return max(1, math.floor(COORDINATES * p - DEVIATIONS * math.sqrt(COORDINATES * p * (1 - p))))


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def similar_pairs(sig: np.ndarray, size: np.ndarray, comp: np.ndarray, cut: int, num: int, den: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, agreement) of members in different components (and on different sides) whose tokens and sizes allow a link."""
    for a in range(len(sig) - 1):
        ok = (comp[a + 1 :] != comp[a]) & (np.minimum(size[a + 1 :], size[a]) * den >= np.maximum(size[a + 1 :], size[a]) * num)
        if side is not None:
            ok &= side[a + 1 :] != side[a]
        b = np.flatnonzero(ok) + a + 1
        if len(b):
            same = (sig[b] == sig[a]).sum(axis=1)
            keep = same >= cut
            if keep.any():
                yield np.full(int(keep.sum()), a), b[keep], same[keep]


def _grouped(batches, key: int):
    """Runs of rows with one value in column ``key``, over batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and held[0].column(key)[0].as_py() != k[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, side) of what is confirmed together: all of a cluster (side -1), or, if it has
    more than BLOCK_SHINGLES shingles, each block of members (-1) and each two blocks (0 and 1)."""
    if size.sum() <= BLOCK_SHINGLES or len(size) < 2:
        return [(np.arange(len(size)), np.full(len(size), -1))]
    block = (np.cumsum(size) - size) // BLOCK_SHINGLES
    parts = [np.flatnonzero(block == b) for b in np.unique(block)]
    out = [(p, np.full(len(p), -1)) for p in parts if len(p) > 1]
    for i, p in enumerate(parts):
        out += [(np.concatenate((p, q)), np.repeat([0, 1], [len(p), len(q)])) for q in parts[:i]]
    return out


def _clusters(leaves: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate clusters of small nodes: ``cluster, rep, comp, side``; equal clusters of several trees once."""
    cut = agreement_cut(num / den)

    def rows(batches):
        for t in _grouped(batches, 0):
            n = t.num_rows
            if n < 2:
                continue
            rep, comp, size, side = (t.column(i).to_numpy() for i in (1, 2, 4, 5))
            sig = _tokens(t.column(3), n)
            u, seen = _Union(n), set()
            for a, b, _ in similar_pairs(sig, size, comp, cut, num, den, None if side[0] < 0 else side):
                seen.add(int(a[0]))
                for x in b.tolist():
                    seen.add(x)
                    u.join(int(a[0]), x)
            groups: dict[int, list[int]] = {}
            for x in sorted(seen):
                groups.setdefault(u.find(x), []).append(x)
            for g in groups.values():
                g = np.array(g)[np.argsort(rep[g])]
                for some, sides in block_pairs(size[g]):
                    h = g[some]
                    name = xxhash.xxh3_64_intdigest(rep[h].tobytes() + sides.tobytes()) - (1 << 63)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), name)), pa.array(rep[h]), pa.array(comp[h]), pa.array(sides, pa.int32())], names=["cluster", "rep", "comp", "side"])

    full = reps.select("rep", "sig", "n").join(_small(leaves), "rep").select("node", "rep", "comp", "sig", "n", "side")
    return full.repartition("node").sortWithinPartitions("node", "rep").mapInArrow(rows, "cluster long, rep long, comp long, side int").distinct()


def _confirm(clusters: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Edges ``a, b`` that connect what links inside clusters, from full shingle sets of whole texts."""
    cut = agreement_cut(num / den)

    def linked(rep, comp, side, hashes):
        sig, size = signatures(hashes), np.array([len(h) for h in hashes])
        pairs = list(similar_pairs(sig, size, comp, cut, num, den, None if side[0] < 0 else side))
        if not pairs:
            return
        u, first = _Union(len(rep)), {}
        for j, c in enumerate(comp.tolist()):
            u.join(first.setdefault(c, j), j)
        a, b, same = (np.concatenate(x) for x in zip(*pairs, strict=True))
        for j in np.argsort(-same, kind="stable").tolist():
            x, y = int(a[j]), int(b[j])
            if u.find(x) == u.find(y):
                continue
            both = len(np.intersect1d(hashes[x], hashes[y], assume_unique=True))
            if den * both >= num * (len(hashes[x]) + len(hashes[y]) - both):
                u.join(x, y)
                yield int(rep[x]), int(rep[y])

    def rows(batches):
        now, held = None, []

        def close():
            if len(held) > 1:
                rep, comp, side = (np.array([x[i] for x in held]) for i in range(3))
                found = list(linked(rep, comp, side, [x[3] for x in held]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*found, strict=True)], names=["a", "b"])
            held.clear()

        for batch in batches:
            cluster, rep, comp, side = (batch.column(i).to_pylist() for i in range(4))
            for j, text in enumerate(batch.column(4)):
                if cluster[j] != now:
                    yield from close()
                    now = cluster[j]
                h = shingle_hashes(text.as_py(), k)
                if len(h):
                    held.append((rep[j], comp[j], side[j], h))
        yield from close()

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(_small(clusters), "rep").select("cluster", "rep", "comp", "side", "text")
    return texts.repartition("cluster").sortWithinPartitions("cluster", "rep").mapInArrow(rows, "a long, b long")


def connected_components(tables: Tables, edges: DataFrame) -> DataFrame:
    """``rep, comp``: smallest id reachable, for every id that has an edge.

    Min-label propagation with pointer jumping; each round is a written table, so
    a lost executor costs one round.
    """
    both = tables.write(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = tables.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("v"), "l"), "labels")
    while True:
        since = len(tables)
        heard = both.join(labels, both["a"] == labels["v"]).groupBy("b").agg(F.min("l").alias("h"))
        told = tables.write(labels.join(heard, labels["v"] == heard["b"], "left").select("v", "l", F.least("l", "h").alias("m")), "labels")
        up = told.select(F.col("v").alias("p"), F.col("m").alias("pm"))
        jumped, path = write_table(told.join(up, told["m"] == up["p"]).select("v", F.least("m", "pm").alias("l"), F.col("l").alias("was")), "labels")
        tables.drop(since)
        tables.paths.append(path)
        labels = jumped.select("v", "l")
        if not jumped.where("l <> was").head(1):
            return labels.select(F.col("v").alias("rep"), F.col("l").alias("comp"))


def components(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``.

    Two documents link when ``den * |A & B| >= num * |A | B|``.  A null, empty or
    wordless text has no shingles and links with nothing; a null id takes no
    part (its component is null and it is kept).  Rows that share an id are one
    document of the link graph.  Texts are read whole, other columns are
    ignored whatever their names, and an empty table gives no rows.
    """
    with Tables(docs.sparkSession) as tables:
        prints = tables.write(_fingerprints(docs, id_col, text_col, shingle), "near-prints")
        reps = prints.where("k1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
        reps = tables.write(reps, "near-reps")
        edges, comps = None, None
        for trees in (range(FIRST_TREES), range(FIRST_TREES, TREES)):
            since = len(tables)
            leaves = tables.write(_leaves(tables, reps, comps, trees), "near-leaves")
            clusters = tables.write(_clusters(leaves, reps, num, den), "near-clusters")
            found, path = write_table(_confirm(clusters, docs, id_col, text_col, shingle, num, den), "near-edges")
            tables.drop(since)
            tables.paths.append(path)
            edges = found if edges is None else edges.unionAll(found)
            if comps is None or found.head(1):
                comps = connected_components(tables, edges)
        classes = tables.write(reps.join(_small(comps), "rep", "left").select("k1", "k2", "n", F.coalesce("comp", "rep").alias("comp")), "near-classes")
        p, c = prints.select("doc_id", "n", "k1", "k2").alias("p"), classes.alias("c")
        same = (F.col("p.k1") == F.col("c.k1")) & (F.col("p.k2") == F.col("c.k2")) & (F.col("p.n") == F.col("c.n"))
        out = p.join(c, same, "left").select(F.col("p.doc_id").alias("doc_id"), F.col("p.n").alias("n_shingles"), F.when(F.col("p.doc_id").isNotNull(), F.coalesce("c.comp", "p.doc_id")).alias("component_id"))
        return tables.write(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-classes", keep=True)


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does; columns as they were.

    Rows that share an id are one document, so one of them stays, the first by
    text; rows without an id all stay.
    """
    classes = components(docs, shingle, num, den, id_col, text_col)
    gone, twice, nth = (fresh(docs, name=x) for x in ("gone", "twice", "nth"))
    dropped = classes.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    own = F.col(f"`{id_col}`").cast("long")
    left = docs.join(_small(dropped), own == F.col(gone), "left_anti")
    repeated = classes.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice))
    if not repeated.head(1):
        return left
    again = _small(repeated)
    first = Window.partitionBy(own).orderBy(F.col(f"`{text_col}`"))
    once = left.join(again, own == F.col(twice), "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return left.join(again, own == F.col(twice), "left_anti").unionByName(once)
