"""Main text of web pages by wrapper induction.

Pages of one host are aligned as DOM trees by simple tree matching and merged
into the host's *wrapper*: for each slot it counts pages, sums text and link
lengths and keeps the commonest texts.  Slots (and blocks) whose text stays the
same on nearly all of a host's differing pages, and slots that are mostly links,
are template; of what varies, the slot that holds most of the text is content.

A page's article is what aligns with the content slot, less template.  Markup
comes second: elements that declare the article (``article``, ``main``) narrow or
widen the content slot where they overlap it, and what markup itself declares as
menu, footer, advert and so on is never content.  Pages of hosts too small to
compare are cut by markup alone.

Wrappers are merged in three steps - inside scan tasks, by (host, salt), by
host - so a host with a third of all pages is never in one task; extraction
joins the few wrappers that decide anything back to the pages.
"""

from __future__ import annotations

import bisect
import html as html_lib
import json
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotoflow.llm.common import Tables, write_table

#: A slot is template when so many pages of the host, and this share of them, have its text ...
MIN_PAGES = 5
SAME_SHARE = 0.8
#: ... while at least this share of the host's pages differ (copies of one page prove nothing).
DISTINCT_SHARE = 0.5
#: Texts a slot remembers for each block of a page (Misra-Gries: counts are short by 1 / KEEP of the pages at most) and hashes of its distinct-count sketch.
KEEP = 32
#: Slots on a smaller share of a wrapper's pages decide nothing and go (from WEED pages on).
RARE = 0.05
WEED = 100
#: A slot is the content slot if it holds this share of its parent's varying text.
CONTENT_SHARE = 0.75
#: Sibling lists with a larger table of pairs are aligned greedily.
TABLE = 2500
#: Deeper elements count as siblings (as in browsers, which bound the depth too).
MAX_DEPTH = 150
SKETCH = 64
#: Wrapper bytes that may be broadcast to the extraction scan; above, a salted join takes over.
BROADCAST_BYTES = 32 << 20
SALTS = 16

# Element names by role in HTML, and words in class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FLOW = frozenset("p li ul ol dl dt dd h2 h3 h4 h5 h6 blockquote pre figure figcaption table thead tbody tr td th hr".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu title".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login search widget widgets toolbar pagination pager skip copyright complementary contentinfo form dialog".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_ITSELF = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Dom:
    tag: str
    marks: tuple[str, ...] = ()
    kids: list = field(default_factory=list)


def parse(source: str | None) -> Dom:
    """Forgiving DOM of a page; never fails."""
    root = Dom("#root")
    stack, at, source = [root], 0, source or ""
    beyond: list[str] = []  # open elements deeper than MAX_DEPTH: each is a sibling of the one before
    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in beyond:
                del beyond[len(beyond) - 1 - beyond[::-1].index(name) :]
                if name not in INLINE:
                    stack[-1] = Dom("div")
                    stack[-2].kids.append(stack[-1])
                continue
            beyond.clear()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P:
            _close(stack, ("p",), CLOSES_P - {"p"} | {"td", "th", "li"})
        if name in ENDS_ITSELF:
            own, scope = ENDS_ITSELF[name]
            _close(stack, own.split(), set(scope.split()))
        attrs = m[3] if m[2] else m[6]
        marks = tuple(f"{a.lower()}:{b or c or d}" for a, b, c, d in _ATTR.findall(attrs)) if attrs and "=" in attrs else ()
        node = Dom(name, marks)
        deep = len(stack) > MAX_DEPTH and name not in VOID and name not in RAW
        stack[-2 if deep else -1].kids.append(node)
        if deep:
            stack[-1] = node
            if len(beyond) < MAX_DEPTH:
                beyond.append(name)
        elif name in RAW:
            end = re.compile(f"</{name}[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID and not (attrs or "").endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Dom], tags, scope) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in scope:
            return


def _words(node: Dom) -> set[str]:
    return {w for mark in node.marks for w in re.split(r"[^a-z]+", mark.split(":", 1)[1].lower())} if node.marks else set()


def _has(node: Dom, tags) -> bool:
    return any(isinstance(k, Dom) and (k.tag in tags or _has(k, tags)) for k in node.kids)


def boilerplate(node: Dom, inside: bool) -> bool:
    """Does markup declare this element to be something else than the article?"""
    if node.tag in DROPPED:
        return node.tag != "form" or not _has(node, ("article", "main"))
    if node.tag == "header" or MARKED & _words(node):
        if node.tag in ("html", "body", "main") or _has(node, ("article", "main")):
            return False
        # the article's own heading is no page header
        return not (inside and _has(node, ("h1", "h2")) and (node.tag == "header" or "header" in _words(node)))
    return False


def _is_main(node: Dom) -> bool:
    return node.tag == "main" or any(m in ("role:main", "itemprop:articleBody") for m in node.marks)


def _find(node: Dom, want, inside: bool = False) -> list[Dom]:
    out = []
    for k in node.kids:
        if isinstance(k, Dom) and not boilerplate(k, inside):
            out += [k] if want(k) else _find(k, want, inside)
    return out


def declared_roots(page: Dom) -> list[Dom]:
    """Elements that hold the article by their own markup; none if markup does not say."""
    articles = _find(page, lambda n: n.tag == "article")
    mains = _find(page, _is_main)
    if len(articles) == 1 and len(mains) == 1 and not _has(articles[0], ("h1",)) and _has(mains[0], ("h1",)):
        return mains
    return articles or mains


def squeeze(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def blocks(node: Dom, skip=frozenset(), inside: bool = True, whole: bool = False) -> list[str]:
    """Text blocks in page order, without boilerplate (unless ``whole``) and without the nodes (by identity) in ``skip``."""
    out, run = [], []

    def flush():
        text = squeeze("".join(run))
        run.clear()
        if text:
            out.append(text)

    def walk(n: Dom):
        for k in n.kids:
            if isinstance(k, str):
                run.append(k)
            elif k.tag == "br":
                run.append(" ")
            elif not whole and boilerplate(k, inside) or id(k) in skip:
                if k.tag not in INLINE:
                    flush()
            elif k.tag in INLINE:
                walk(k)
            else:
                flush()
                walk(k)
                flush()

    walk(node)
    flush()
    return out


# --- wrappers ---------------------------------------------------------------


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _label(node: Dom) -> str:
    if node.tag in FLOW:
        return "#flow"
    marks = sorted({re.sub(r"[0-9]+", "", w) for m in node.marks if m.startswith(("class:", "role:")) for w in m.split(":", 1)[1].split()})
    return ".".join([node.tag, *(w for w in marks if w)])


@dataclass
class Slot:
    """A wrapper node.  ``texts`` counts pages by text hash (heavy hitters only); ``n_texts`` counts texts of all pages."""

    label: str
    pages: int = 0
    chars: int = 0
    links: int = 0
    n_texts: int = 0
    texts: dict[int, int] = field(default_factory=dict)
    sketch: list[int] = field(default_factory=list)
    kids: list[Slot] = field(default_factory=list)

    def pack(self):
        return [self.label, self.pages, self.chars, self.links, self.n_texts, list(self.texts.items()), self.sketch, [k.pack() for k in self.kids]]

    @classmethod
    def unpack(cls, x):
        return cls(*x[:5], {int(a): b for a, b in x[5]}, x[6], [cls.unpack(k) for k in x[7]])

    def distinct(self) -> float:
        if len(self.sketch) < SKETCH:
            return float(len(self.sketch))
        return (SKETCH - 1) / (self.sketch[-1] / 2**64)


def _link_chars(node: Dom) -> int:
    n = 0
    for k in node.kids:
        if isinstance(k, Dom):
            n += len(squeeze("".join(_raw(k)))) if k.tag == "a" else _link_chars(k)
    return n


def _raw(node: Dom):
    for k in node.kids:
        if isinstance(k, str):
            yield k
        else:
            yield from _raw(k)


def slots(node: Dom) -> tuple[Slot, list[tuple[Slot, Dom]]]:
    """A page's own wrapper - block elements only, runs of flow blocks as one slot - and which element made each slot."""
    owners: list[tuple[Slot, Dom]] = []

    def build(n: Dom) -> tuple[Slot, list[str]]:
        s = Slot(_label(n), 1, links=_link_chars(n))
        owners.append((s, n))
        flow, out, run = None, [], []

        def flush():
            text = squeeze("".join(run))
            run.clear()
            if text:
                out.append(text)

        for k in n.kids:
            if isinstance(k, str):
                run.append(k)
            elif k.tag in INLINE:
                run.append(" " if k.tag == "br" else "".join(_raw(k)))
            elif k.tag in FLOW:
                flush()
                if flow is None:
                    flow = Slot("#flow", 1)
                    s.kids.append(flow)
                owners.append((flow, k))
                got = blocks(k, whole=True)
                for text in set(got):
                    flow.texts[_hash(text)] = 1
                flow.n_texts = len(flow.texts)
                flow.chars += sum(map(len, got))
                flow.links += _link_chars(k)
                out += got
            elif k.tag not in RAW and k.tag != "head":
                flush()
                flow = None
                kid, got = build(k)
                s.kids.append(kid)
                out += got
        flush()
        text = "\n".join(out)
        s.chars, s.n_texts = len(text), 1
        s.texts, s.sketch = {_hash(text): 1}, [_hash(text)]
        return s, out

    return build(node)[0], owners


def matching(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the order-preserving pairs with most matched nodes.

    Equal heads and tails of labels pair off; what is left of long lists is
    aligned greedily by label, in order.
    """
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE:
        return _greedy(a, b)
    w = [[_size(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[i - 1][j - 1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _greedy(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    head = 0
    while head < min(len(a), len(b)) and a[head].label == b[head].label:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail].label == b[-1 - tail].label:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(head, len(b) - tail):
        where.setdefault(b[j].label, []).append(j)
    out, last = [(k, k) for k in range(head)], head - 1
    for i in range(head, len(a) - tail):
        own = where.get(a[i].label, [])
        k = bisect.bisect_right(own, last)
        if k < len(own):
            last = own[k]
            out.append((i, last))
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _size(a: Slot, b: Slot) -> int:
    """Nodes that match in the best alignment of two subtrees; 0 if the roots differ."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    if len(a.kids) * len(b.kids) > TABLE:
        return 1 + len(_greedy(a.kids, b.kids))
    row = [0] * (len(b.kids) + 1)
    for x in a.kids:
        new = [0]
        for j, y in enumerate(b.kids, 1):
            new.append(max(row[j], new[-1], row[j - 1] + _size(x, y)))
        row = new
    return 1 + row[-1]


def merge(a: Slot, b: Slot) -> Slot:
    """One wrapper for the pages of both; unmatched slots are kept in order as optional."""
    out = _merged(a, b)
    if out.pages >= WEED and out.pages // WEED > max(a.pages, b.pages) // WEED:
        _weed(out, RARE * out.pages)
    return out


def _weed(s: Slot, least: float) -> None:
    s.kids = [k for k in s.kids if k.pages >= least]
    for k in s.kids:
        _weed(k, least)


def _merged(a: Slot, b: Slot) -> Slot:
    texts = dict(a.texts)
    for h, n in b.texts.items():
        texts[h] = texts.get(h, 0) + n
    pages, n_texts = a.pages + b.pages, a.n_texts + b.n_texts
    room = KEEP * -(-n_texts // pages)
    if len(texts) > room:
        # Misra-Gries: take off what the first one beyond the room has
        off = sorted(texts.values(), reverse=True)[room]
        texts = {h: n - off for h, n in texts.items() if n > off}
    out = Slot(a.label, pages, a.chars + b.chars, a.links + b.links, n_texts, texts, sorted(set(a.sketch) | set(b.sketch))[:SKETCH])
    i = j = 0
    for x, y in [*matching(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        out.kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            out.kids.append(_merged(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    return out


#: What a slot is.
OPEN, TEMPLATE, CONTENT = 0, 1, 2


def decide(wrapper: Slot) -> dict | None:
    """What the wrapper settles: ``tree`` of (label, what it is, kids) and ``same`` block hashes; None if nothing."""
    n = wrapper.pages
    if n < MIN_PAGES or wrapper.distinct() < DISTINCT_SHARE * n:
        return None
    same: list[int] = []
    often = max(MIN_PAGES, RARE * n)

    def fixed(s: Slot) -> bool:
        common = max(s.texts.values(), default=0) >= (SAME_SHARE - 1 / KEEP) * s.pages
        menu = s.chars > 0 and s.links >= 0.6 * s.chars and s.pages >= often
        return s.label != "#flow" and (s.pages >= max(often, SAME_SHARE * n) and common or menu)

    def varying(s: Slot) -> int:
        return s.chars - sum(k.chars if fixed(k) else k.chars - varying(k) for k in s.kids)

    content, at = None, wrapper
    while True:
        most = max((k for k in at.kids if k.label != "#flow" and not fixed(k)), key=varying, default=None)
        if most is None or most.pages < SAME_SHARE * n or varying(most) < CONTENT_SHARE * varying(at):
            break
        content = at = most

    def rule(s: Slot, top: bool = False):
        if s.label == "#flow":
            same.extend(h for h, c in s.texts.items() if s.pages >= MIN_PAGES and c >= (SAME_SHARE - 1 / KEEP) * n)
        what = CONTENT if s is content else TEMPLATE if not top and fixed(s) else OPEN
        return [s.label, what, [rule(k) for k in s.kids]]

    tree = rule(wrapper, True)

    def any_settled(t):
        return t[1] != OPEN or any(map(any_settled, t[2]))

    return {"tree": tree, "same": same} if same or any_settled(tree) else None


class Decision:
    """A decision made ready to be applied to many pages."""

    def __init__(self, decision: dict):
        self.same, self.what = frozenset(decision["same"]), {}

        def shape(t) -> Slot:
            s = Slot(t[0], kids=[shape(k) for k in t[2]])
            self.what[id(s)] = t[1]
            return s

        self.shape = shape(decision["tree"])

    def apply(self, body: Dom) -> tuple[frozenset, list[Dom]]:
        """Elements (by identity) of the page that align with template slots, and those that align with the content slot."""
        page, owners = slots(body)
        who: dict[int, list[Dom]] = {}
        for s, n in owners:
            who.setdefault(id(s), []).append(n)
        skip, content = set(), []

        def walk(p: Slot, s: Slot):
            for i, j in matching(p.kids, s.kids):
                what = self.what[id(s.kids[j])]
                if what == TEMPLATE:
                    skip.update(id(n) for n in who[id(p.kids[i])])
                    continue
                if what == CONTENT:
                    content.extend(who[id(p.kids[i])])
                walk(p.kids[i], s.kids[j])

        walk(page, self.shape)
        return frozenset(skip), content


def _body(page: Dom) -> Dom:
    found = _find(page, lambda n: n.tag == "body")
    return found[0] if found else page


def _inside(node: Dom, others: list[Dom]) -> bool:
    """Is any of ``others`` the node or below it?"""
    want, todo = {id(x) for x in others}, [node]
    while todo:
        n = todo.pop()
        if id(n) in want:
            return True
        todo += [k for k in n.kids if isinstance(k, Dom)]
    return False


def extract(source: str | None, decision: Decision | None = None) -> str:
    """Main text of one page, given what its host's wrapper settles."""
    page = parse(source)
    body, declared = _body(page), declared_roots(page)
    skip, content = decision.apply(body) if decision else (frozenset(), [])
    # markup that overlaps the content slot says more exactly what the article is
    agreed = [d for d in declared if not content or any(_inside(c, [d]) or _inside(d, [c]) for c in content)]
    roots = agreed or content or declared or [body]
    found = [b for r in roots if id(r) not in skip for b in blocks(r, skip)]
    same = decision.same if decision else ()
    return "\n".join(b for b in found if not same or _hash(b) not in same)


def _host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def _shut(w: Slot) -> bytes:
    return zlib.compress(json.dumps(w.pack(), separators=(",", ":")).encode())


def _open(x: bytes) -> Slot:
    return Slot.unpack(json.loads(zlib.decompress(x)))


def wrappers(pages: DataFrame, tables: Tables) -> DataFrame:
    """``host, decision`` (JSON) of every host whose wrapper settles something, from ``host, html``."""

    def local(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w, _ = slots(_body(parse(source.as_py())))
                held[host] = merge(held[host], w) if host in held else w
        part = TaskContext.get().partitionId()
        names = sorted(held)
        for lo in range(0, len(names), 500):
            some = names[lo : lo + 500]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([part % SALTS] * len(some), pa.int32()), pa.array([held[h].pages for h in some], pa.int64()), pa.array([_shut(held[h]) for h in some], pa.binary())], names=["host", "salt", "pages", "wrapper"])

    def gathered(batches, final: bool):
        held: dict[str, list] = {}
        for batch in batches:
            for host, salt, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                held.setdefault((host, salt), []).append(w.as_py())
        for (host, salt), parts in sorted(held.items()):
            parts.sort()  # the shuffle's order must not matter
            w = _open(parts[0])
            for x in parts[1:]:
                w = merge(w, _open(x))
            if final:
                d = decide(w)
                if d:
                    yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(d, separators=(",", ":"))], pa.string())], names=["host", "decision"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([0], pa.int32()), pa.array([w.pages], pa.int64()), pa.array([_shut(w)], pa.binary())], names=["host", "salt", "pages", "wrapper"])

    kind = "host string, salt int, pages long, wrapper binary"
    own = pages.where("host <> ''").select("host", "html").mapInArrow(local, kind)
    own = tables.write(own, "wrappers")
    # hosts with too few pages settle nothing and need not be merged
    enough = own.groupBy("host").agg(F.sum("pages").alias("n")).where(F.col("n") >= MIN_PAGES).select("host")
    own = own.join(enough, "host", "left_semi").select("host", "salt", "pages", "wrapper")
    some = own.repartition("host", "salt").mapInArrow(lambda b: gathered(b, False), kind)
    return some.repartition("host").mapInArrow(lambda b: gathered(b, True), "host string, decision string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty html has the empty text; a null url or one without a host is
    cut by its markup alone.  Whole pages are read, repeated rows are answered
    each (and count once each for the wrapper, where copies of a page prove
    nothing), an empty table gives no rows, and other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", F.coalesce(F.expr(_host("url")), F.lit("")))
    with Tables(pages.sparkSession) as tables:
        found, _ = write_table(wrappers(rows, tables), "wrapper-decisions")
    size = found.agg(F.coalesce(F.sum(F.length("host") + F.length("decision")), F.lit(0))).head()[0]
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.select("host", "decision", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def texts(batches):
        known: dict[str, Decision] = {}
        for batch in batches:
            out = []
            for source, decision in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if decision is not None and decision not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[decision] = Decision(json.loads(decision))
                out.append(extract(source.as_py(), known.get(decision)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long"
    return joined.select("page_id", F.col("url").cast("string").alias("url"), "html", "decision").mapInArrow(texts, schema)
