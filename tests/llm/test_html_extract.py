import random

from kotoflow.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; &#233;</h1></header><p><b>First  line<br>goes
 on<p>Second &lt;b&gt; &nbsp; x<ul><li>one<li>two</ul><div class="share">Share</div><form>f</form><footer>by</footer></article>
<aside>side</aside><section class="comments"><article class="comment">reader</article></section><footer>&copy; x</footer></body></html>"""


def test_declared_markup():
    assert hx.extract(PAGE) == "Head & é\nFirst line goes on\nSecond <b> x\none\ntwo"


def test_odd_pages():
    assert hx.extract(None) == hx.extract("") == hx.extract("<!-- never closed <p>x") == ""
    assert hx.extract("plain &amp text") == "plain & text"
    assert hx.extract("<article><p>a<p>b</article><footer>c") == "a\nb"
    assert hx.extract("<article><p>cut off <a hre") == "cut off"
    assert hx.extract('<p title="a > b">x</p><p>1 < 2</p>') == "x\n1 < 2"
    assert hx.extract("<main><h1>T</h1><article><p>x</article></main>") == "T\nx"
    assert hx.extract("<article><p>" + "w " * 200000 + "</article>") == " ".join(["w"] * 200000)


def host_page(rng, i):
    text = "".join(f"<p>{' '.join(rng.choice('abcdefgh') * 4 for _ in range(12))} {i} {k}</p>" for k in range(rng.randrange(1, 5)))
    return f"<html><body><div>The Daily Host</div><div><h1>Story {i}</h1>{text}<p>Support our work today!</p></div><div>Contact us by post</div></body></html>", i


def test_induction(spark):
    rng = random.Random(4)
    rows = []
    for i in range(30):
        h, _ = host_page(rng, i)
        rows.append((i, f"http://user@News.example.com:80/{i}", h))
    copy = "<html><body><div>Top</div><div><p>same story everywhere</p></div></body></html>"
    rows += [(100 + i, "https://copies.example.com/a", copy) for i in range(12)]
    rows += [(200, None, copy), (201, "no host", PAGE), (202, "http://x.example.com", None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([r + ("k",) for r in rows], "page_id long, url string, html string, text string")
    got = hx.main_text(df.repartition(5)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {r["page_id"]: r["text"] for r in got}
    for i in range(30):
        lines = by[i].split("\n")
        assert lines[0] == f"Story {i}" and all(x.split()[-2] == str(i) for x in lines[1:]), lines
    assert by[100] == by[200] == "Top\nsame story everywhere"  # copies of one page prove nothing
    assert by[201].startswith("Head & é") and by[202] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert hx.main_text(df.limit(0)).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "http://a.example.com/", host_page(rng, i)[0]) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, hx.main_text(df).collect()))
    monkeypatch.setattr(hx, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, hx.main_text(df).collect())) == want


def test_simple_tree_matching():
    s = lambda label, *kids: hx.Slot(label, 1, kids=list(kids))
    a = [s("div", s("p")), s("ul"), s("div", s("p"), s("h1"))]
    b = [s("ul"), s("div", s("p"), s("h1"))]
    assert hx.matching(a, b) == [(1, 0), (2, 1)]
    assert hx._size(s("x", *a), s("x", *b)) == 5


def test_deep_nesting():
    n = 100_000
    assert hx.extract("<div>" * n + "<p>deep" + "</div>" * n + "<p>after").split("\n") == ["deep", "after"]
    assert hx.extract("<article><p>a " + "<span>x " * 2000 + "</article><p>out").startswith("a x x")
    w, _ = hx.slots(hx._body(hx.parse("<div>" * n + "x")))
    assert hx.merge(w, w).pages == 2


def story(rng, i, marks):
    """A page with menu, advert and footer that differ from page to page, with or without marks that say so."""
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    menu = "".join(f'<li><a href="/{k}">{words(1)}</a></li>' for k in range(6))
    head, text = words(5), [words(rng.randrange(3, 60)) for _ in range(rng.randrange(1, 9))]
    a, n, f, c = ("article", "nav", "footer", ' class="ad"') if marks else ("div", "div", "div", "")
    page = f"<html><body><{n}><ul>{menu}</ul></{n}><div{c}>{words(6)}</div><{a}><h1>{head}</h1>{''.join(f'<p>{t}</p>' for t in text)}</{a}><{f}>{words(7)}</{f}></body></html>"
    return page, "\n".join([head, *text])


def test_wrapper_finds_the_article_without_marks(spark):
    for marks in (True, False):
        rng = random.Random(8)
        made = [story(rng, i, marks) for i in range(40)]
        df = spark.createDataFrame([(i, "http://a.example.com/", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in hx.main_text(df.repartition(4)).collect()}
        assert got == {i: t for i, (_, t) in enumerate(made)}


def test_constant_paragraph_among_many_is_template():
    rng, w = random.Random(5), None
    for i in range(60):
        text = "".join(f"<p>{rng.random()} {k}</p>" for k in range(30))
        x, _ = hx.slots(hx._body(hx.parse(f"<body><div><h1>t {i}</h1>{text}<p>Support us</p></div><div>x</div></body>")))
        w = hx.merge(w, x) if w else x
    assert hx._hash("Support us") in hx.Decision(hx.decide(w)).same


def test_matching_against_all_alignments():
    def best(a, b):
        if not a or not b:
            return 0
        both = 1 + best(a[0].kids, b[0].kids) + best(a[1:], b[1:]) if a[0].label == b[0].label else 0
        return max(both, best(a[1:], b), best(a, b[1:]))

    rng = random.Random(2)
    tree = lambda depth: hx.Slot(rng.choice("xyz"), 1, kids=[tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])
    for _ in range(200):
        a, b = [tree(2) for _ in range(rng.randrange(5))], [tree(2) for _ in range(rng.randrange(5))]
        assert sum(hx._size(a[i], b[j]) for i, j in hx.matching(a, b)) == best(a, b)


def test_long_lists_align_in_order(monkeypatch):
    rng = random.Random(6)
    a = [hx.Slot(rng.choice("pq") + str(rng.randrange(3)), 1) for _ in range(900)]
    b = a[:400] + [hx.Slot("new", 1)] + a[450:]
    got = hx.matching(a, b)
    assert all(a[i].label == b[j].label for i, j in got) and len(got) >= 840
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
