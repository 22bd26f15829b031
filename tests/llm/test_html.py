import random
from collections import defaultdict

import pytest

from veilspan.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div>
<header>site</header><article><h1>Head &amp;amp; line</h1><p><b>One<br>two<p>three  <i>four</i></p><div class="comments"><p>me too</p></div><form><p>name</p></form></article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_article():
    assert hx.main_text(PAGE, frozenset(), "") == "Head &amp; line\nOne two\nthree four"


def test_without_article_the_container_decides():
    page = "<body><div class=menu>x</div><div class=content><p>Hi &amp; <b>there</b>\n you<p>two</div><div id='userComments'>no</div><div>other</div></body>"
    assert hx.main_text(page, frozenset(), "/body/div.content") == "Hi & there you\ntwo"


def test_broken_markup():
    assert hx.main_text("", frozenset(), "") == ""
    assert hx.main_text("a < b and <p>c <!-- open", frozenset(), "") == "a < b and\nc"
    assert hx.main_text("<p title='x>y'>in</p></div></p>out<script>never", frozenset(), "") == "in\nout"
    assert hx.main_text("<p>" * 3000 + "deep", frozenset(), "") == "deep"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_constant_text_is_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>t{i}</h1><p>Share this now</p><p>text {i}</p></article></body>") for i in range(6)]
    rows += [(100 + i, f"http://b.example/{i}", "<body><article><p>Share this now</p></article></body>") for i in range(2)]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert got == {**{i: f"t{i}\ntext {i}" for i in range(6)}, 100: "Share this now", 101: "Share this now"}


def test_sometimes_repeated_text_is_kept(spark):
    rows = [(i, "http://a.example", f"<body><article><p>{'often' if i else 'once'}</p><p>text {i}</p></article></body>") for i in range(6)]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert got[1] == "often\ntext 1" and got[0] == "once\ntext 0"


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (2, "no url", None), (None, "http://x", ""), (1, None, "<p>a</p>")]
    got = sorted((r.page_id or 0, r.text) for r in hx.extract(pages(spark, rows)).collect())
    assert got == [(0, ""), (1, "a"), (1, "a"), (2, "")]


def test_marks_do_not_drop_the_article():
    inner = "<p>Long text</p><div class='ad'>buy</div>"
    for page in (
        f"<html class='no-cookie'><body class='has-sidebar'><article>{inner}</article></body></html>",
        f"<body><main class='with-sidebar'>{inner}</main></body>",
        f"<body><article class='ad-free'>{inner}</article></body>",
        f"<body><div class='with-sidebar'><div><article>{inner}</article></div><p>beside</p></div></body>",
        f"<body><article>{inner}</article><div class='related'><article><p>other</p></article></div></body>",
        f"<body><div class='layout-sidebar'><div role='main' class='main'>{inner}</div></div></body>",
    ):
        assert hx.main_text(page, frozenset(), "") == "Long text"
    page = "<body class='has-sidebar'><div class=content><p>text</p></div><div class='sidebar'><p>no</p></div></body>"
    assert hx.main_text(page, frozenset(), "/body.has.sidebar/div.content") == "text"


def test_names_that_only_hold_a_marker_word():
    page = "<body><article><h1>H</h1><div class='share-price-report'><p>Prices rose</p></div><div class='share-bar box'>share</div></article></body>"
    assert hx.main_text(page, frozenset(), "") == "H\nPrices rose"
    assert hx.main_text("<body><div class='widget'><p>all there is</p></div></body>", frozenset(), "") == "all there is"


def test_mirrors_keep_their_article(spark):
    same = "<body><div class=top>site</div><article><p>One article</p><p>on every page</p></article></body>"
    rows = [(i, f"http://m.example/{i}", same) for i in range(6)]
    rows += [(10 + i, f"http://n.example/{i}", same.replace("site", f"site {i}")) for i in range(6)]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert set(got.values()) == {"One article\non every page"}


def test_each_layout_has_its_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class=content><p>news {i}</p><ul class=more><li>Read more below</li></ul></div></body>") for i in range(6)]
    rows += [(10 + i, f"http://a.example/s{i}", f"<body><div class=content><p>story {i}</p><table><tr><td>Score board</td></tr></table><p>Score board is mine</p></div></body>") for i in range(6)]
    rows += [(20, "http://a.example/e", ""), (21, "http://a.example/n", None), (22, "http://a.example/x", "<p>gone</p>")]
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert got == {**{i: f"news {i}" for i in range(6)}, **{10 + i: f"story {i}" for i in range(6)}, 20: "", 21: "", 22: "gone"}


def plain(rows):
    """The text of each page, by sets of pages."""
    hosts, out = defaultdict(dict), {}
    host = lambda url: (url or "").split("//")[-1].split("/")[0].lower() if "//" in (url or "") else ""
    for _, url, html in rows:
        hosts[host(url)][html or ""] = hx.blocks(html or "")
    constant, container = {}, {}
    for h, found in hosts.items():
        at, chars = defaultdict(set), defaultdict(int)
        for html, (blocks, opened) in found.items():
            for path in opened:
                at["element", path].add(html)
            for b in blocks:
                at["text", b.path, b.text].add(html)
                if not b.dropped:
                    chars[b.path.rpartition("/")[0]] += len(b.text)
        classes = defaultdict(list)
        for token, where in at.items():
            classes[frozenset(where)].append(token)
        frames = {where: min((t[1].count("/"), t[1]) for t in tokens if t[0] == "element") for where, tokens in classes.items() if len(where) >= hx.SUPPORT and any(t[0] == "element" for t in tokens)}
        held = {t[1] for where in frames for t in classes[where] if t[0] == "element"}
        constant[h] = set()
        for where, (depth, path) in frames.items():
            parts = path.split("/")
            if len(where) == len(found) or depth == 1 or any("/".join(parts[:k]) in held for k in range(2, len(parts))):
                constant[h] |= {t[1:] for t in classes[where] if t[0] == "text"}
        container[h] = max(((n, p) for p, n in chars.items() if n), default=(0, ""))[1]
    for page_id, url, html in rows:
        left = [b for b in hosts[host(url)][html or ""][0] if not b.dropped]
        if any(b.article for b in left):
            left = [b for b in left if b.article]
        elif container[host(url)]:
            c = container[host(url)]
            left = [b for b in left if b.path == c or b.path.startswith(c + "/")] or left
        own = [b for b in left if (b.path, b.text) not in constant[host(url)]]
        out[page_id] = "\n".join(b.text for b in own or left)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_extract_equals_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = []
    for h in range(6):
        frame = [f"<div class='c{h}'>line {h}</div>", "<section><h2>Also here</h2></section>", "<p>Again and again</p>", "<nav>menu</nav>", "<div class='share-bar'>share</div>"]
        for _ in range(rng.randint(1, 25)):
            layout = rng.randrange(3)
            body = [f"<p>text {rng.randrange(30)}</p>" for _ in range(rng.randint(0, 4))] + [x for i, x in enumerate(frame) if rng.random() < 0.2 or i % 3 != layout]
            rng.shuffle(body)
            tag = ("article", "main", "div")[layout]
            html = f"<html><body><{tag}>{''.join(body)}</{tag}><footer>end</footer></body></html>"
            rows.append((len(rows), rng.choice([f"http://h{h}.example/{len(rows)}", f"https://H{h}.example"]), rng.choice([html, html, html, html, rows[-1][2] if rows else None, None, ""])))
    got = {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}
    assert got == plain(rows)
