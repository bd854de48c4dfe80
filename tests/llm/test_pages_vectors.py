"""Operators on pages and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import decision_tree, embedding_dedup, html_text, url_filter
from factloom.llm.queries import RULES

URLS = [
    "https://Blog.Example.org/es/1?x=1", "http://example.org/en/12#top", "https://example.org", "http://notexample.org/es/", "https://a.com/fr/x", "https://a.com/de", "ftp://a.com/de/1",
    "no scheme", None, "", "https://example.org:80/es/", "http://org/", "x://a.b://c.com/de/", "https://EXAMPLE.ORG/en/1",
]


def truth(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_url_rules(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        pages = spark.createDataFrame([(i % 20, u, "h", "r", "v") for i, u in enumerate(URLS * 4)], "page_id long, url string, host string, rule string, verdict string")
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
        got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, rules).collect())))
        assert got == sorted(str((i % 20, *truth(u))) for i, u in enumerate(URLS * 4))
        assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {"block"}
        assert url_filter.judge(pages.limit(0), rules).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_url_rule_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.Shop.example/x"), (None, "http://shop.example/y"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("SHOP.example", "/", "block"), (None, "/", "allow"), ("a.shop.example", None, "allow"), ("a.shop.example", "/x", None)], "host string, path string, verdict string")
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect())
    assert got == [(0, "shop.example/", "block"), (1, "shop.example/", "block"), (2, None, "allow")]


def test_places_among_bounds(spark):
    bounds = sorted(f"k{i:03d}" for i in range(0, 100, 3))
    keys = ["", "k", "z", *[f"k{i:03d}" for i in range(100)]]
    for n in (0, 1, 2, len(bounds)):
        place = url_filter._place(bounds[:n])
        got = {r.key: r.at for r in spark.createDataFrame([(k,) for k in keys], "key string").select("key", place(F.col("key")).alias("at")).collect()}
        assert got == {k: sum(b <= k for b in bounds[:n]) for k in keys}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href=1>Home</a></nav><div class="cookie-banner">We use cookies.</div>
<article><h1>Head &amp; tail</h1><p>First   line<br>goes on.<p>Second &lt;b&gt; <b>bold<p>Third</p><div class="ad">Buy!</div><form>Name</form></article>
<aside>Other news of the day for you.</aside><section id="comments"><p>Nice text, thank you for it all.</p></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<article><p>" + "word " * 50_000, "x"), (5, "u", "<p>unclosed <!-- comment", "x"), (1, "u", PAGE, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == "Head & tail\n\nFirst line goes on.\n\nSecond <b> bold\n\nThird" and by[1].n_chars == len(by[1].text)
    assert by[2].text == by[3].text == "" and by[4].n_chars == 5 * 50_000 - 1
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


OPEN = ["<html><head><title>x</title><meta charset=utf-8><body>@", "<head><title>x</title>@", "<head><style>b</style></head>@", "<body><svg width='1'/>@", "<body><svg/>@<svg><path/></svg>", "<body><math/>@",
        "<body><button>@", "<body><button>@<button>Go</button>", "<body><object data=a>@", "<body><noscript>@", "<body><select></select>@", "<body><iframe src=a>@", "<body><svg><title/><g><svg>in</svg>out</g></svg>@",
        "<body><!-- <svg> -->@</svg>", "<body><template><p>no</template>@", "<body><svg><style>a</style><text>no</text></svg>@", "<body><svg xmlns=http://a/>no</svg>@"]


@pytest.mark.parametrize("page", OPEN)
def test_text_after_open_elements(page):
    text = "<article><p>The wind rose at noon and by three the boats had all come home.</p></article>"
    assert [b.text for b in html_text.text_blocks(page.replace("@", text))][:1] == ["The wind rose at noon and by three the boats had all come home."]
    assert html_text.main_text(page.replace("@", text), html_text.train()).startswith("The wind rose at noon")


KEPT = ["<p>Let <math><mi>x</mi></math> be small.", "<div class='side-note'>The bridge was built in the year of the flood, when the old one had gone, as the town still tells.</div>",
        "<div class='legal'>The court said in its letter that the land is the town's, and that no house may stand on it.</div>", "<object>An old map of the town</object>", "<p>Short."]


@pytest.mark.parametrize("part", KEPT)
def test_article_parts_stay(part):
    """Formulas, notes with telling class words and fallback text are part of an article."""
    long = "<p>The wind rose at noon and by three the boats had all come home, and nobody was hurt.</p>"
    for page in (f"<body class='has-sidebar'><article>{long}{part}{long}</article></body>", f"<nav><a href=1>x</a></nav><div class='sidebar'><main>{long}{part}{long}</main></div>"):
        words = html_text.text_blocks(part)[0].text
        assert words in html_text.main_text(page, html_text.train())


def test_neighbours_decide():
    """The same heading and the same line are text beside paragraphs and none beside links."""
    tree, read = html_text.train(), lambda page: html_text.main_text(page, html_text.train()).split("\n\n")
    long = "<p>The wind rose at noon and by three the boats had all come home, and nobody was hurt by the storm.</p>"
    links = "<ul>" + "<li><a href=x>another story of the day</a></li>" * 4 + "</ul>"
    assert "More of it" in read(f"<article>{long}<h3>More of it</h3>{long}</article>") and "More of it" not in read(f"<article>{long}<h3>More of it</h3>{links}</article>")
    assert "By the sea" in read(f"<body><div>{long}<p>By the sea</p>{long}</div>") and "By the sea" not in read(f"<body><div>{long}</div><div><p>By the sea</p></div>{links}")
    used, todo = set(), [tree]
    while todo:
        node = todo.pop()
        if node.low is not None:
            used.add(html_text.FEATURES[node.feature])
            todo += [node.low, node.high]
    assert used & {"words before", "words after"} and used & {"density before", "density after"}


def test_features_and_held_out_pages():
    tree, wrong, every = html_text.train(), 0, 0
    for page in html_text.labelled_pages(80, seed=77):
        blocks = html_text.text_blocks(page)
        for at, row in enumerate(html_text.features(blocks)):
            near = [blocks[i] if 0 <= i < len(blocks) else None for i in (at, at - 1, at + 1)]
            assert row[:6] == [x for b in near for x in ((len(b.text.split()), b.linked / len(b.text.split())) if b else (0, 0.0))]
            every += 1
            wrong += decision_tree.positive(tree, row) != (blocks[at].label == 1)
    assert wrong <= 0.03 * every


def test_select_without_end_and_raw_to_the_end():
    read = lambda page: [b.text for b in html_text.text_blocks(page)]
    assert read("<body><select><option>A<article><p>Text") == ["A", "Text"]
    assert [read(f"<p>a<{name}>b<p>c") for name in html_text.RAW] == [["a"]] * 4 and read("<p>a<!-- b <p>c") == ["a"]


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [[float(x) for x in centre + 0.06 * rng.standard_normal(16)] for _ in range(8)] + [[float(x) for x in centre]] * 3
    table = [(i, v, i % 3) for i, v in enumerate(rows)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0], None), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [], 1), (n + 8, [1e300] * 16, 1), (n + 9, [1e-300] * 16, 1)]
    return table


@pytest.mark.parametrize("block", [1000, 3])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    table = vectors()
    good = {i: np.array(v, float) / np.abs(v).max() for i, v, label in table if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: lab for i, _, lab in table}
    links, parent = dict.fromkeys(label, 0), {i: i for i in label}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in good:
        for b in good:
            if a < b and label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.98 * np.linalg.norm(good[a]) * np.linalg.norm(good[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([(*row, 1, 2) for row in table], "vec_id long, embedding array<double>, label int, rep int, times int")
    rows = embedding_dedup.near_vectors(frame, 0.98).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {i: (links[i], find(i), find(i) == i) for i in label}
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_vectors_of_repeated_ids(spark):
    near = lambda x, y: [float(x), float(y), 0.0]
    rows = [(1, 5, near(1, 0)), (1, 5, near(0, 1)), (2, 5, near(1, 0.01)), (3, 5, near(0.01, 1)), (1, 6, near(1, 0)), (4, 6, near(1, 0.01)), (3, 5, near(0.01, 1)), (None, 5, near(1, 0))]
    for kind in ("float", "double"):
        docs = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
        got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(docs, 0.98).collect())
        assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (1, 2, 1, True), (3, 2, 1, False), (3, 2, 1, False), (1, 1, 1, True), (4, 1, 1, False), (0, 0, None, True)])


LONG = "<p>The wind rose at noon and by three the boats had all come home, and nobody was hurt by the storm that day.</p>"
SAID = "<p>Reader Max writes that he liked this very much and will come back to read it again tomorrow.</p>"


@pytest.mark.parametrize("page, lost", [
    (f"<article>{LONG}<article class='comment'>{SAID}</article></article>", "Reader"),
    (f"<article>{LONG}</article><article class='advert sponsored'>{SAID}</article>", "Reader"),
    (f"<article>{LONG}</article><aside class='related'><article>{SAID}</article></aside>", "Reader"),
    (f"<article>{LONG}</article><div class='comments'><article>{SAID}</article></div>", "Reader"),
    (f"<article>{LONG}</article><section class='teaser-list'><article>{SAID}</article></section>", "Reader"),
    (f"<article>{LONG}<noscript>{SAID}</noscript>{LONG}</article>", "Reader"),
    (f"<body><div><h1>A day at sea</h1>{LONG}{LONG}</div><div>Copyright 2024 The Daily Example, all rights reserved</div></body>", "Copyright"),
])
def test_boxes_named_by_their_own_class(page, lost):
    text = html_text.main_text(page, html_text.train())
    assert "boats had all come home" in text and lost not in text


def test_linked_sources_between_paragraphs_stay():
    links = "<ul><li><a href=x>The harbour's log of that year</a></li><li><a href=y>A letter of the keeper</a></li></ul>"
    read = lambda page: html_text.main_text(page, html_text.train())
    assert "harbour's log" in read(f"<article><h1>A day at sea</h1>{LONG}{links}{LONG}</article>")
    assert "harbour's log" not in read(f"<article><h1>A day at sea</h1>{LONG}<h3>Read more</h3>{links}{LONG}</article>")
    layout = f"<body><div class='layout no-sidebar'><article class='post comment-status-open'>{LONG}</article></div></body>"
    assert "boats" in read(layout)
