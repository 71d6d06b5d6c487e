"""Page extraction, exact search and the pipeline."""

import html
import json
import math
import random
import re

import pytest
from helpers import ODD, docs, words
from pyspark.sql import functions as F
from test_text_operators import plain_hits, plain_near, plain_pii, table

from lodestone.llm import queries as Q
from lodestone.llm import topk, wrappers

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="home">
<header><a href="/">Site</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article id="post-{n}"><h1>Title &amp; {n}</h1><p>First <b>bold</b>   text&nbsp;{n}<p>Second <em>one<br>two</em>
<div class="ad">Buy</div><ul><li>item {n}<li>item b</ul><form><input><button>Go</button></form><aside>side</aside>
<!-- note --><blockquote>Quote &#x41;&#66; &copy; &unknown; &am</blockquote></article>
<section class="comments"><article class="comment"><p>Reader says {n}</p></article></section></main>
<div id="sidebar">Side {n}</div><footer>&copy; Site</footer></body></html>"""


def test_article_of_a_page():
    want = "Title & 7\nFirst bold text 7\nSecond one two\nitem 7\nitem b\nQuote AB © &unknown; &am"
    assert wrappers.article(PAGE.format(n=7), {}) == want
    assert wrappers.article(None, {}) == wrappers.article("", {}) == ""
    assert wrappers.article("<article>cut <p>off <scr", {}).startswith("cut\noff")
    assert wrappers.article("plain words", {}) == "plain words"
    assert wrappers.article("<body><header>H</header><p>a</p><div>b<nav>n</nav>c</div>", {}) == "a\nb\nc"


def test_alignment_makes_optional_and_repeated_groups():
    def page(*parts):
        return "<body><article><h1>x</h1>" + "".join(parts) + "</article></body>"

    one = wrappers.tree(page("<p>a</p>", "<p>b</p>", "<table><tr><td>1</td></tr></table>"))
    wrappers.merge(one, wrappers.tree(page("<p>c</p>")))
    assert wrappers.pattern(one) == "<body><article><h1>text</>(<p>#</>)+(<table><tr><td>text</></></>)?</></>"
    groups = wrappers.tree(page("<h2>a</h2><p>b</p>" * 3))
    wrappers.merge(groups, wrappers.tree(page("<h2>q</h2><p>r</p>")))
    assert wrappers.pattern(groups) == "<body><article><h1>text</>(<h2>#</><p>#</>)+</></>"
    again = wrappers.Node.of(json.loads(json.dumps(groups.to())))
    assert wrappers.pattern(again) == wrappers.pattern(groups)


def test_wrapper_does_not_depend_on_order():
    rng = random.Random(3)
    pages = [PAGE.format(n=i) if i % 3 else PAGE.format(n=i).replace("<aside>side</aside>", "") for i in range(9)]
    seen = set()
    for _ in range(6):
        rng.shuffle(pages)
        cut = rng.randrange(1, 8)
        parts = []
        for some in (pages[:cut], pages[cut:]):
            one = wrappers.tree(some[0])
            for p in some[1:]:
                wrappers.merge(one, wrappers.tree(p))
            parts.append(one)
        wrappers.merge(*parts)
        seen.add(wrappers.pattern(parts[0]))
    assert len(seen) == 1 and wrappers.roles(parts[0])["main"] == "article"


def test_many_different_siblings_stay_bounded():
    rng = random.Random(1)
    tags = ["p", "h2", "h3", "ul", "ol", "table", "pre", "section", "dl", "figure"]
    one = None
    for _ in range(60):
        t = wrappers.tree("<body>" + "".join(f"<{g}>x</{g}>" for g in rng.choices(tags, k=40)) + "</body>")
        one = t if one is None else (wrappers.merge(one, t), one)[1]
    assert len(one.children[0].children) <= wrappers.WIDEST


def wrapper_of(pages):
    one = wrappers.tree(pages[0])
    for p in pages[1:]:
        wrappers.merge(one, wrappers.tree(p))
    return json.loads(json.dumps(wrappers.roles(wrappers.Node.of(json.loads(json.dumps(one.to()))))))


def test_template_text_is_dropped_at_its_place_only():
    page = "<body><div>Daily news</div><h2>Topic</h2><div>Text of article {0}</div><p>more {0}</p><h2>Title {0}</h2></body>"
    pages = [page.format(i) for i in range(7)]
    for i, p in enumerate(pages):
        assert wrappers.article(p, wrapper_of(pages)) == f"Text of article {i}\nmore {i}\nTitle {i}"
    # the same words elsewhere are no template; neither is another text at its place
    odd = "<body><div>Other head</div><h2>Topic</h2><div>Daily news</div><p>more</p></body>"
    assert wrappers.article(odd, wrapper_of(pages)) == "Other head\nDaily news\nmore"
    # an optional sibling before doesn't move the place
    some = [p.replace("<body>", "<body><section>Only here</section>") if i % 2 else p for i, p in enumerate(pages)]
    assert wrappers.article(some[0], wrapper_of(some)) == "Text of article 0\nmore 0\nTitle 0"


def test_wrapper_decides_where_the_article_is():
    promo = "<article><h1>Join us</h1><p>Become a member</p><p>today</p></article>"
    page = "<body>" + promo + "<div>Text {0}</div><p>more {0}</p></body>"
    pages = [page.format(i) for i in range(6)]
    known = wrapper_of(pages)
    assert known["main"] == "body" and wrappers.article(pages[2], known) == "Text 2\nmore 2"
    inner = ["<body><main>" + promo + f"<div>Text {i}</div><p>more</p></main></body>" for i in range(6)]
    known = wrapper_of(inner)
    assert known["main"] == "main" and wrappers.article(inner[2], known) == "Text 2\nmore"
    # constants of the template are dropped inside an article; varying, optional and repeated text stays
    own = [f"<body><article><h1>T</h1><p>a {i}</p><p>b</p><div>Share this</div>" + f"<h2>opt {i}</h2>" * (i % 2) + "</article></body>" for i in range(6)]
    assert [wrappers.article(p, wrapper_of(own)) for p in own[:2]] == ["T\na 0\nb", "T\na 1\nb\nopt 1"]
    # too few different pages: names and classes decide
    few = wrapper_of(pages[:4] + pages[:4])
    assert wrappers.article(pages[2], few) == "Join us\nBecome a member\ntoday"


def test_slots_of_random_templates_are_the_text():
    rng = random.Random(17)
    tags = ["div", "h2", "section", "blockquote", "h3", "pre", "h4", "center", "address"]
    for _ in range(40):
        # constants, slots and optional slots in an order of the host; some hosts nest them in an article
        parts = [(t, rng.choice(["constant", "slot", "slot", "optional"])) for t in rng.sample(tags, rng.randrange(3, 8))] + [("p", "slot")]
        rng.shuffle(parts)
        around = rng.choice(["<body>{}</body>", "<body><article>{}</article></body>", "<body><h1>Site</h1><div id=content>{}</div></body>"])
        pages, wants = [], []
        for i in range(9):
            held, want = "", []
            for k, (tag, kind) in enumerate(parts):
                text = f"fixed {k}" if kind == "constant" else f"{rng.random()} {k} of {i}"
                if kind == "optional" and rng.random() < 0.4:
                    continue
                held += f"<{tag}>{text}</{tag}>"
                want += [text] * (kind != "constant")
            pages.append(around.format(held))
            wants.append("\n".join(want))
        known = wrapper_of(pages)
        assert [wrappers.article(p, known).removeprefix("Site\n") for p in pages] == wants, parts


def test_places_of_links_are_menus():
    rng = random.Random(8)
    link = lambda: f"<li><a href=/x>{rng.choice('abcdefgh')} {rng.randrange(999)}</a></li>"
    page = "<body><div class=x1><ul>{m}</ul></div><div class=x2><h1><a href=/t>Title {i}</a></h1><p>Text {i} with <a href=/l>a link</a> and more words</p><ul><li>point {i}</li></ul></div><div class=x3>{n}</div></body>"
    pages = [page.format(i=i, m=link() + link() * (i % 3), n=f"<p><a href=/r>See {i * 7}</a></p>") for i in range(9)]
    known = wrapper_of(pages)
    for i, p in enumerate(pages):
        assert wrappers.article(p, known) == f"Title {i}\nText {i} with a link and more words\npoint {i}"
    # without the wrapper, without names, a page alone can't tell
    assert "See 14" in wrappers.article(pages[2], {})
    # a host of nothing but links is read whole, and so is one of few pages
    only = [f"<body><ul><li><a href=/>one {i}</a></ul></body>" for i in range(9)]
    assert wrappers.article(only[3], wrapper_of(only)) == "one 3"
    assert "See 14" in wrappers.article(pages[2], wrapper_of(pages[:4]))
    # a linked title is no menu, whatever it stands in
    boxed = [p.replace("<h1>", "<div><h1>").replace("</h1>", "</h1></div>") for p in pages]
    assert [wrappers.article(p, wrapper_of(boxed)) for p in boxed] == [wrappers.article(p, known) for p in pages]
    # a link that is never closed ends with its element
    torn = [p.replace("</a></h1>", "</h1>") for p in pages]
    assert wrappers.article(torn[2], wrapper_of(torn)) == wrappers.article(pages[2], known)


def test_short_linked_articles_beside_longer_ones_are_teasers():
    page = "<body><main><article><h1>Title {0}</h1><p>" + "long text {0} " * 40 + "</p></article></main><section><article><h2><a href=/n>News {1}</a></h2><p>short {1}</p></article></section></body>"
    pages = [page.format(i, i * 3 + 1) for i in range(8)]
    want = "Title 2\n" + " ".join(["long text 2"] * 40)
    assert wrappers.article(pages[2], wrapper_of(pages)) == want
    assert wrappers.article(pages[2], {}) == want + "\nNews 7\nshort 7"
    # articles of one length are all the page's
    even = [p.replace("short", "long text " * 40) for p in pages]
    assert wrappers.article(even[2], wrapper_of(even)).endswith("7")


def test_copies_of_a_page_are_no_template():
    page = "<body><script>{}</script><div>Head</div><p>text</p><blockquote>quote</blockquote><table><tr><td>cell</td></tr></table></body>"
    copies = [page.format(i) for i in range(9)]
    assert wrappers.article(copies[0], wrapper_of(copies)) == "Head\ntext\nquote\ncell"


def test_pages_match_a_plain_reading(spark, sf_dir):
    got = {r.page_id: r for r in Q.op3_wrappers(spark, sf_dir).collect()}
    rows = table(sf_dir, "pages")
    assert len(got) == len(rows)
    for page, url, source in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
        lines = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
        want = "\n".join(x for x in lines if x)
        assert (got[page].text, got[page].n_chars, got[page].url) == (want, len(want), url)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<p>x"), (4, "http://h.example/a", "<" * 2000), (5, "http://h.example/b", "<div>" * 3000 + "deep"), (5, "http://h.example/b", "<p>twice"), (None, "http://H.example:8080/c", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "host": F.lit(2), "n_chars": F.lit(3)})
    out = wrappers.extract(df).collect()
    assert len(out) == len(rows)
    by = sorted((str(r.page_id), r.text[:5], r.n_chars) for r in out)
    assert ("1", "", 0) in by and ("2", "", 0) in by and ("3", "x", 1) in by and ("5", "deep", 4) in by and ("5", "twice", 5) in by
    assert ("None", "long ", 249_999) in by
    assert wrappers.extract(df.where("false")).count() == 0


# ---- exact search


def plain_top(rows, queries, k):
    cells = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in cells:
            best = sorted((-sum(a * b for a, b in zip(cells[q], v, strict=True)), i) for i, v in cells.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_k_is_exact(spark):
    rng = random.Random(9)
    same = [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, list(same) if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (450, [-0.001] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit(2)})
    for slack, block in ((64, 4096), (0, 50)):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, slack=slack, block_rows=block)
        assert {tuple(r) for r in got.collect()} == plain_top(rows, range(0, 451, 50), 5)
    small = df.where("vec_id in (0, 1, 2, 400)")
    assert {tuple(r) for r in topk.top_k(small, small, 5).collect()} == plain_top([r for r in rows if r[0] in (0, 1, 2)], [0, 1, 2], 5)
    assert topk.top_k(df.where("false"), df.where("false"), 5).count() == 0
    assert topk.top_k(df, df.where("vec_id = 400"), 5).count() == 0


def test_top_k_of_large_numbers(spark):
    rows = [(0, [3e12, -2e11]), (1, [5e5, 7e12]), (2, [-4e11, 1e12]), (3, [1e13, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in plain_top(rows, [0], 3)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 3).collect()} == want


# ---- pipeline


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    import corpus_pipeline as cp

    docs_, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in cp.STAGES:
        result = cp.stored(stage(spark, docs_, sf_dir), f"test-{name}")
        out.append((name, docs_, result))
        docs_ = result
    return out


def test_stages_keep_columns_and_whole_input(staged):
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
    names = [n for n, _, _ in staged]
    assert names == ["language", "near_duplicates", "decontamination", "sanitisation", "tokenisation"]


def test_stages_against_brute_force(staged, sf_dir):
    rows = {n: ({r.doc_id: r.text for r in a.collect()}, b.collect()) for n, a, b in staged}
    before, after = rows["language"]
    letters = {k for k, t in before.items() if re.search(r"[^\W\d_]", t or "")}
    kept = {r.doc_id for r in after}
    assert kept <= letters and len(kept) >= 0.97 * len(letters)
    before, after = rows["near_duplicates"]
    classes = plain_near(list(before.items()))
    assert sorted(r.doc_id for r in after) == sorted({c for c, _ in classes.values()})
    before, after = rows["decontamination"]
    items = table(sf_dir, "benchmark")
    clean = set()
    for k, t in before.items():
        n, hit, _, _ = plain_hits(t, items)
        if not (hit and 20 * hit >= n):
            clean.add(k)
    assert {r.doc_id for r in after} == clean
    before, after = rows["sanitisation"]
    assert sorted(r.doc_id for r in after) == sorted(before)
    for r in after:
        assert plain_pii(r.text) == [] and r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (plain_pii(before[r.doc_id]) == [])
    before, after = rows["tokenisation"]
    assert sorted(r.doc_id for r in after) == sorted(before)
    assert all(r.text == before[r.doc_id] and r.n_tokens == len(r.ids) and r.parity for r in after)


def test_run_is_the_stages(spark, sf_dir, staged):
    import corpus_pipeline as cp

    assert sorted(r.doc_id for r in cp.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in staged[-1][2].collect())


def test_stages_of_odd_documents(spark, sf_dir):
    import corpus_pipeline as cp

    df = docs(spark, ODD, extra=True).withColumn("n_chars", F.length("text").cast("long"))
    rows = df.unionByName(df.limit(8)).unionByName(df.limit(4).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in cp.STAGES:
        for some in (rows, rows.where("false")):
            out = stage(spark, some, sf_dir)
            n = out.count()
            if name in ("sanitisation", "tokenisation"):
                assert n == some.count()
            if name != "tokenisation":
                assert out.columns == some.columns
    kept = cp.near_duplicates(spark, rows, sf_dir).collect()
    # rows without words are each their own group; of every other set one row stays
    sets = {tuple(words(r.text)) for r in kept if words(r.text)}
    assert sum(bool(words(r.text)) for r in kept) == len(sets)
