import random

from pyspark.sql import functions as F

from fleetlens.llm import page_diff as module
from fleetlens.llm.page_diff import common_lines, main_text, page_diff, pair_by_url
from fleetlens.llm.page_text import ARTICLE, FRAME, page_lines

PAGES = "page_id long, url string, html string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(0)
    for bits in (1 << 27, 4):
        monkeypatch.setattr(module, "_MOST_BITS", bits)
        for _ in range(400):
            a, b = ([rng.randrange(5) for _ in range(rng.randrange(13))] for _ in "ab")
            got = common_lines(a, b)
            assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def text(html):
    return main_text(html, [])


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id=sidebar><p>Links</p></div><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>\n\t word&nbsp;x<br>next
    <p>Caf&eacute; &#8212; &lt;tag&gt;</p><div class="ad">Buy</div><aside>Side</aside><form><input>Mail</form><ul><li>a<li>b</ul>
    <table><tr><td>c1<td>c2</table><section class="comments"><article class="comment"><p>First!</p></article></section>
    <p style="display: none">hidden</p><noscript>no</noscript></article><footer>&copy; foot</footer></body></html>"""
    assert text(page) == "Head & line\nOne bold word x next\nCafé — <tag>\na\nb\nc1\nc2"


def test_broken_markup():
    assert text("<article><p><b>bold<br><p>two") == "bold\ntwo"
    assert text("<nav><ul><li>menu<article><p>text</article>") == "text"
    assert text("<article></article>") == "" and text("") == "" and text("plain  text\n here") == "plain text here"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text('<div class="post-content"><p>c</p></div><div>x</div>') == "c"
    assert text("<p>" * 5000 + "deep" + "<div>" * 3000 + "er") == "deep\ner"
    assert text("a < b <p>c") == "a < b\nc"
    assert text('<div class="siteSidebarLeft">s</div><p class="commentary">kept</p><div id="userComments"><p>c</p></div>') == "kept"
    assert text('<article class="post has-comments"><p>kept</p><article class="comment">x</article></article>') == "kept"


def test_names_inside_an_article_are_whole():
    page = """<article><h1>T</h1><section id="discussion"><p>We discuss.</p></section><h2 id="related-work">Related work</h2>
    <p id="search-for-gold">The search</p><p class="share-price">The price</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>
    <div class="share-buttons">Tweet</div><p class="ad">Buy</p><section class="comments">First!</section></article>"""
    assert text(page) == "T\nWe discuss.\nRelated work\nThe search\nThe price\nSo x=1 holds"


def test_differencing_sees_menus_and_footers():
    lines, _ = page_lines("<nav><ul><li>Home</ul></nav><article><p>a <span class=ad>Buy</span> b</p></article><footer>Foot</footer><script>x</script>")
    assert lines == [("Home", FRAME), ("a b", ARTICLE), ("Buy", FRAME), ("Foot", FRAME)]


STORY = "a story of many words that nobody would want to lose"


def test_articles_in_wrappers_named_for_one_of_their_parts():
    article = f"<article><p>{STORY}</p></article>"
    for wrapper in ('class="layout has-sidebar"', 'id="search-results"', 'class="page-with-sidebar"', 'class="widget-area"'):
        assert text(f"<div {wrapper}>{article}</div>") == STORY
        assert text(f"<p>Our site</p><div {wrapper}><div>{article}</div><p>more</p></div>") == STORY
        assert text(f'<div class="post-meta">By me</div><div {wrapper}><main><p>{STORY}</p></main></div>') == STORY
    assert text(f'<div class="layout has-sidebar"><p>{STORY}</p><div class="sidebar">x</div></div>') == STORY
    # teasers and comments do not come back beside the article
    teaser = "<article><p>teaser</p></article>"
    assert text(f'<div class="sidebar">{teaser}</div>{article}<div class="related-posts">{teaser * 9}</div>') == STORY
    assert text(f'<p>{STORY}</p><section class="comments">{teaser}</section>') == STORY
    assert text(f'<article><p>{STORY}</p><section class="comments">{teaser}</section></article>') == STORY
    assert text(f'<div class="sidebar"><aside>{article}</aside></div><p>x</p>') == "x"
    assert text(f'<div class="sidebar"><div hidden>{article}</div></div><p>x</p>') == "x"


def test_a_small_part_whose_class_says_text_is_not_the_article():
    for name in ("text-muted", "post-meta"):
        small = f'<div class="{name}">By me</div>'
        assert text(f"<div>{small}<div><p>{STORY}</p><p>{STORY}</p></div></div>") == f"By me\n{STORY}\n{STORY}"
        assert main_text(f"{small}<div><p>Call us</p><p>{STORY}</p></div>", [0, 1]) == STORY


def test_a_teaser_is_not_the_article_beside_it():
    teaser = "<article><p>teaser</p></article>"
    assert text(f"<main><p>{STORY}</p></main>{teaser}<p>out</p>") == f"{STORY}\nteaser"
    assert text(f"<main><p>{STORY}</p>{teaser}</main><p>out</p>") == f"{STORY}\nteaser"
    assert text(f"<div><p>{STORY}</p></div>{teaser}") == f"{STORY}\nteaser"
    assert text(f"<main><p>lead</p><article><p>{STORY}</p></article></main><p>out</p>") == STORY


def test_shared_lines_go_where_no_markup_names_the_article(spark):
    frame = "<p>Our site</p><p>Call us</p>{}<p>All prices in gold</p>"
    body = lambda i: "".join(f"<p>story {i} part {k} with some words of its own</p>" for k in range(6))
    rows = [(i, f"http://h/news/{i}", frame.format(body(i))) for i in range(5)]
    rows += [(10, "http://h/copy/1", frame.format(body(77))), (11, "http://h/copy/2", frame.format(body(77)))]
    rows += [(20, "http://alone/x", frame.format(body(3)))]
    out = {r.page_id: r.text for r in page_diff(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(5):
        assert out[i] == "\n".join(f"story {i} part {k} with some words of its own" for k in range(6))
    assert out[11] == "\n".join(t for t, _ in page_lines(rows[6][2])[0])  # copies of one page keep their lines
    assert out[20].startswith("Our site\nCall us\nstory 3") and out[20].endswith("gold")


def test_shared_lines_go_inside_main_and_marked_elements(spark):
    body = lambda i: "".join(f"<p>story {i} part {k} with some words of its own</p>" for k in range(6))
    shapes = {
        "m": "<main><p>Call us</p>{}<p>All prices in gold</p></main>", "d": '<div class="content"><p>Call us</p>{}<p>All prices in gold</p></div>',
        "a": "<article><p>Call us</p>{}<p>All prices in gold</p></article>",
    }
    rows = [(f"{k}{i}", f"http://{k}/news/{i}", shape.format(body(i))) for k, shape in shapes.items() for i in range(3)]
    frames = ["".join(f"<p>frame {i} line {k} unlike any other page</p>" for k in range(9)) for i in range(2)]
    rows += [(f"c{i}", f"http://c/{i}", f"<main>{body(7)}</main>{frames[i]}") for i in range(2)]
    out = {r.page_id: r.text for r in page_diff(spark.createDataFrame(rows, PAGES.replace("long", "string"))).collect()}
    for i in range(3):
        own = "\n".join(f"story {i} part {k} with some words of its own" for k in range(6))
        assert out[f"m{i}"] == out[f"d{i}"] == own and out[f"a{i}"] == f"Call us\n{own}\nAll prices in gold"
    assert out["c0"] == out["c1"] == "\n".join(f"story 7 part {k} with some words of its own" for k in range(6))


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    keys = [(f"r{i:03}", rng.choice("ab"), "/" + "/".join(rng.choice(["x", "yy", "z"]) for _ in range(rng.randrange(1, 4)))) for i in range(150)]
    keys += [("s1", "lonely", "/"), ("s2", "", "")]
    table = spark.createDataFrame(keys, "row string, host string, path string").repartition(7)
    got = {r.me: r.other for r in pair_by_url(table).collect()}

    def near(a, b):
        n = 0
        for x, y in zip(a.split("/"), b.split("/")):
            if x != y:
                break
            n += len(x) + 1
        return n

    order = sorted(keys, key=lambda k: (k[1], k[2], k[0]))
    want = {}
    for i, (row, host, path) in enumerate(order):
        around = [(near(path, order[j][2]), j < i, order[j][0]) for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][1] == host]
        if around:
            want[row] = max(around)[2]
    assert got == want
    for size in (1, 2, 7, 151):  # pages at the ends of ranges find their neighbours in others
        rows = pair_by_url(table.unionByName(table.limit(40)), size).collect()
        assert {r.me: r.other for r in rows} == want and len(rows) == len(want)


def test_cut_points_are_bounded_by_number_and_bytes(spark, monkeypatch):
    keys = spark.createDataFrame([(f"r{i:03}", "h", "/" + "x" * i) for i in range(100)], "row string, host string, path string")
    assert len(module.url_ranges(keys, 10)) == 10 and module.url_ranges(keys.limit(0), 10) == []
    monkeypatch.setattr(module, "MOST_RANGES", 4)
    cuts = module.url_ranges(keys, 10)
    assert [(first[2], last[2]) for first, last in cuts] == [("r000", "r024"), ("r025", "r049"), ("r050", "r074"), ("r075", "r099")]
    monkeypatch.setattr(module, "MOST_CUT_BYTES", 500)
    assert len(module.url_ranges(keys, 10)) == 2


def test_ranges_and_batches_do_not_change_texts(spark):
    page = "<p>Our site</p><p>Call us</p>{}<p>All prices in gold</p>"
    body = lambda i: "".join(f"<p>story {i} part {k} with some words of its own</p>" for k in range(4))
    rows = [(i, f"http://h{i % 3}/a/{i % 7}/{i}", page.format(body(i))) for i in range(40)] + [(7, "http://h1/a/0/7", page.format(body(7)))] * 30
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    own = {i: "\n".join(f"story {i} part {k} with some words of its own" for k in range(4)) for i in range(40)}
    for size in (1, 3, 1024):
        out = page_diff(df, rows_per_range=size).collect()
        assert len(out) == len(rows) and all(r.text == own[r.page_id] for r in out)


def test_awkward_pages(spark):
    long = "<article>" + "<p>line of text</p>" * 20_000 + "</article>"
    rows = [
        (1, None, None), (2, "", ""), (3, "not a url", "<p>x"), (3, "not a url", "<p>x"), (3, "http://h/", "<p>other"), (None, "http://h/a", "<p>y"),
        (4, "http://h/long", long), (5, "http://h/nul", "<article>a\x00b &#0; &bogus;</article>"), (6, "http://h/é ?q#f", "<article>ü</article>"),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("host", "path", "row", "me", "gone", "lines", "text")})
    out = page_diff(df).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    texts = {r.page_id: r.text for r in out}
    assert texts[1] == "" and texts[4] == "\n".join(["line of text"] * 20_000) and texts[6] == "ü"
    assert sorted(r.text for r in out if r.page_id == 3) == ["other", "x", "x"]
    assert page_diff(spark.createDataFrame([], PAGES)).collect() == []
