"""URL filters, HTML extraction and the two vector searches against plain versions, and on odd input."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from byteloom.llm import ann, html, pivots, queries, urlfilter

PAGES = "page_id long, url string, html string, text string, rule string, host string"

# URL filters


def plain_judgement(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, path = (rest.split("/", 1)[0], "/" + rest.split("/", 1)[1]) if "/" in rest else (rest, "")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.action if best else "block" if set(re.split("[.-]", host)) & set(queries.URL_WORDS) else "allow"


def test_url_filter(spark, tmp_path):
    rng = random.Random(1)
    parts = ["http://", "https://", "www.", "example", ".com", ".net", ".org", "/en/", "/es/", "/fr/", "casino", "casino", "-", "poker", "xxxl", "?q=/en/", "#x", "/", "COM", "É", ".", "com", "://", "é/", "a" * 300]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3000)] + [None, "", "x" * 100_000, "http://com/", "http://com", "http://evil.org/x.com/", "http://www.example.com/en/1", "http://a.example.com/en/", "http://EXAMPLE.com/EN/", "http://notexample.com/en/"]
    df = spark.createDataFrame([(i, u, None, "t", "r", "h") for i, u in enumerate(urls)], PAGES)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judgement(urls[r["page_id"]]), urls[r["page_id"]][:80]


def glob_regex(glob):
    return re.compile("".join(".*" if t == "**" else "[^/]*" if t == "*" else re.escape(t) for t in re.findall(r"\*\*|\*|[^*]", glob)), re.S)


def test_automaton_matches_regular_expressions():
    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "ab"]) for _ in range(rng.randint(0, 9))) for _ in range(80)] + ["", "*", "**"]
    texts = [bytes(rng.choice(b"ab/") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = urlfilter.Automaton(globs).match(texts)
    assert urlfilter.Automaton(globs).words > 2
    for k, g in enumerate(globs):
        r = glob_regex(g.replace("***", "**"))
        for i, t in enumerate(texts):
            assert got[i, k] == bool(r.fullmatch(t.decode())), (g, t)


def test_url_filter_edges(spark):
    nothing = spark.createDataFrame([], PAGES)
    assert urlfilter.judge(nothing, queries.URL_RULES, []).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/", None, None, "old", "old")], PAGES)
    row = urlfilter.judge(some, [], []).first()
    assert (row["rule"], row["verdict"], row["host"], row["path"], row["page_id"]) == (None, "allow", "a.com", "/", 1)


# HTML

ARTICLE = "The first sentence is here, and it is long enough. A second one follows it!"
BOILER = {
    "menu": '<nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us, and more.</a></li></ul></nav>',
    "header": "<header><div>Site name, since 1999.</div></header>",
    "sidebar": f'<aside><p>{"Sidebar text, quite long. " * 8}</p></aside>',
    "sidebar2": f'<div id="sidebar"><p>{"Sidebar text, quite long. " * 8}</p></div>',
    "cookie": '<div class="cookie-notice"><p>We use cookies, as all do. Please agree.</p></div>',
    "ad": '<div class="ad">Buy this now, it is cheap. Really.</div>',
    "form": '<form action="/s"><label>Search, please.</label><input name="q"><button>Go</button></form>',
    "script": '<script>var t = "</p>, a. b.";</script><style>p{margin:0}</style><noscript>Enable it, please.</noscript>',
    "comment": f'<section id="comments"><p>{"I, for one, disagree. " * 20}</p></section>',
    "footer": "<footer>&copy; 2024, all rights reserved. Yes.</footer>",
    "hidden": "<!-- <p>Not, this. One.</p> -->",
}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class='content'>{}</div></main>", "<div class='post-body'>{}</div>"])
def test_main_text_without_boilerplate(wrap):
    body = f"<h1>A &amp; title</h1><p>{ARTICLE}</p><p>Short.</p><ul><li>One,  item&nbsp;here.</li><li>Two.</li></ul><p><b>{ARTICLE}<br><p>Last &eacute; one.</p>"
    want = f"A & title\n{ARTICLE}\nShort.\nOne, item here.\nTwo.\n{ARTICLE}\nLast é one."
    before = "".join(BOILER[k] for k in ("menu", "header", "cookie", "ad", "form", "script", "hidden"))
    after = "".join(BOILER[k] for k in ("sidebar", "sidebar2", "comment", "footer"))
    page = f"<!DOCTYPE html><html><head><title>T, t. t</title></head><body>{before}{wrap.format(body)}{after}</body></html>"
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='content-sidebar-wrap'><main>{}</main>SIDE</div>",
        "<div class='with-sidebar'><div>{}</div>SIDE</div>",
        "<div id='search-and-content'>{}SIDE</div>",
        "<form id='aspnetForm'><div class='menu-left'><div>{}</div>SIDE</div></form>",
        "<div class='comments-open'><article>{}</article>SIDE</div>",
    ],
)
def test_main_text_in_named_wrappers(wrap):
    body = f"<h1>A title</h1>{f'<p>{ARTICLE}</p>' * 9}"
    page = f"<body>{BOILER['menu']}{BOILER['header']}{wrap.format(body).replace('SIDE', BOILER['sidebar2'] + BOILER['ad'])}{BOILER['footer']}</body>"
    assert html.main_text(page) == "\n".join(["A title"] + [ARTICLE] * 9)


def test_long_comments_are_no_wrapper():
    talk = "".join(f"<p>{'I, for one, disagree. ' * 20}</p>" for _ in range(20))
    page = f"<body><div class='story'><p>{ARTICLE}</p></div><section id='comments'>{talk}</section><div class='with-sidebar' hidden>{talk}</div></body>"
    assert html.main_text(page) == ARTICLE


@pytest.mark.parametrize("name", ["", " class='comment-body'", " class='teaser'"])
def test_short_articles_leave_the_region(name):
    story = "".join(f"<p>{ARTICLE}</p>" for _ in range(20))
    card = f"<article{name}><p>A card, with marks. And more, as one does!</p></article>"
    page = f"<body>{BOILER['menu']}<div id='story'>{story}</div>{card}{BOILER['footer']}</body>"
    assert html.main_text(page) == "\n".join([ARTICLE] * 20)


def test_comments_in_an_article_tag():
    comments = "".join(f"<article class='comment-body'><p>{'I, for one, disagree. ' * 5}</p></article>" for _ in range(3))
    assert html.main_text(f"<body><article class='post category-popular'><p>{ARTICLE}</p>{comments}</article>{comments}</body>") == ARTICLE


@pytest.mark.parametrize("wrap", ["<body>{}</body>", "<body><article>{}</article></body>", "<body><div id='story'>{}</div></body>"])
def test_low_ratios_are_dropped_inside_the_region(wrap):
    p = f"<p>{ARTICLE}</p>"
    page = f"<div>Buy our new shoes</div>{p}{p}<h2>Head</h2><ul><li>One</li><li>Two.</li></ul><p>Short</p><pre>code()</pre>{p}<figure><figcaption>Photo by a friend</figcaption></figure>{p}<div><span>All rights reserved 2024.</span></div>"
    assert html.main_text(wrap.format(page)) == "\n".join([ARTICLE, ARTICLE, "Head", "One", "Two.", "Short", "code()", ARTICLE, ARTICLE])


LONG = f"<p>{ARTICLE * 3}</p>"


@pytest.mark.parametrize(
    ("page", "n"),
    [
        (f'<article>{LONG * 3}<div class="popular-science">{LONG * 2}</div><div id="reader-tips">{LONG}</div></article>', 6),
        (f'<article>{LONG * 3}<div class="social-science">{LONG * 2}</div></article>', 5),
        (f'<div class="reader-content">{LONG * 4}</div>', 4),
        (f'<div class="content-sidebar-wrap"><main>{LONG * 3}</main><div class="sidebar"><p>Side, text.</p></div></div><div>All rights reserved, 2024.</div>', 3),
        (f'<article>{LONG * 3}<section class="comments">{LONG}</section></article>', 3),
    ],
)
def test_names_lower_paths_and_dont_erase_them(page, n):
    assert html.main_text(f"<body>{BOILER['menu']}{page}{BOILER['footer']}</body>") == "\n".join([ARTICLE * 3] * n)


def test_ratios_are_those_of_paths():
    """The ratios of all paths, and what they choose, against a plain version that writes paths out."""
    rng, checked = random.Random(12), 0
    for _ in range(200):
        parts = []
        for _ in range(rng.randint(1, 12)):
            tag, name = rng.choice(["p", "div", "section", "h2"]), rng.choice(["", "", " class='a'", " class='nav'", " id='popular-x'"])
            text = "word, and more. " * rng.choice([0, 1, 1, 2, 8]) + rng.choice(["", "<a href='x'>a link</a>"])
            parts.append(f"<{tag}{name}>{text}</{tag}>")
        page = "<div class='x'>" + "".join(parts[::2]) + "</div>" + "".join(parts[1::2])
        nodes, blocks = html.parse(page)
        html.rate(blocks)

        def path(n):
            return path(n.parent) + (n.path,) if n.parent else ()

        plain = {}
        for b in blocks:
            plain.setdefault(path(b.node), []).append(b)
        mean = lambda p, f: sum(map(f, plain[p])) / len(plain[p])
        size, marks = (lambda b: len(b.text) - b.linked), (lambda b: sum(c in ".,;:!?" for c in b.text))
        around = []
        for k in range(len(blocks)):
            near = [(np.exp(-((k - j) ** 2) / 2), path(b.node)) for j, b in enumerate(blocks) if abs(k - j) <= 2]
            around.append([sum(w * mean(p, f) for w, p in near) / sum(w for w, _ in near) for f in (size, marks)])
        for k, b in enumerate(blocks):
            own = [around[j] for j, o in enumerate(blocks) if path(o.node) == path(b.node)]
            text, dots = (sum(x) / len(own) for x in zip(*own))
            assert b.fused == pytest.approx(b.node.weight * text * np.log1p(dots))
            assert b.own == pytest.approx(b.node.weight * mean(path(b.node), size) * np.log1p(mean(path(b.node), marks)))
            checked += 1
    assert checked > 500


def test_deep_and_wide_pages_take_linear_time():
    began = time.process_time()
    for page in ("<div>a, b." * 20_000, "<div>" * 20_000 + "<li>a, b." * 20_000, "<div class=sidebar>" * 20_000 + "<td>a, b." * 20_000, "<main>" * 20_000 + "a, b."):
        assert html.main_text(page)
    assert time.process_time() - began < 30


def test_long_footers_are_no_wrapper():
    footer = f"<footer>{'All rights are reserved, as ever. ' * 20}</footer>"
    assert html.main_text(f"<body><article><h1>A title.</h1><p>Short.</article>{footer}</body>") == "A title.\nShort."


def test_html_edges(spark, tmp_path):
    odd = [None, "", "   ", "plain text, no tags.", "<p>open, never closed", "<", "<p", "<!-- open", "<script>x", "<p>a</div></p></span>b</p>", "<p>" * 5000 + "deep, text." + "</p>" * 5000, "<div>" * 3000 + "deep, text.", "&lt;b&gt; &#233; &nope; &amp;amp;", f"<p>{'long, text. ' * 50_000}</p>", '<p a="x>y">q, r.</p>']
    df = spark.createDataFrame([(i, "u", h, "clash", "r", "h") for i, h in enumerate([*odd, odd[3]])], PAGES)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r["page_id"]: r for r in queries.op7_html_extraction(spark, str(tmp_path)).collect()}
    text = {i: r["text"] for i, r in rows.items()}
    assert [text[k] for k in (0, 1, 2, 7, 8)] == [""] * 5 and text[5] == "<"
    assert text[3] == text[15] == "plain text, no tags." and text[4] == "open, never closed"
    assert text[10] == text[11] == "deep, text." and text[12] == "<b> é &nope; &amp;" and text[14] == "q, r."
    assert text[13] == ("long, text. " * 50_000).strip() and all(len(r["text"]) == r["n_chars"] for r in rows.values())
    assert html.extract(spark.createDataFrame([], PAGES)).collect() == []


# Vectors

VECTORS = "vec_id long, embedding array<double>, label int, score double, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 2) for i, v in rows], VECTORS)


def plain_search(rows, score, k=20, every=20):
    """Every row but the query's own is a candidate; ``zip`` stops at the shorter vector, as zeros after it would."""
    out = {}
    for at, (i, q) in enumerate(rows):
        if i % every == 0:
            ranked = sorted((-score(q, v), j) for k, (j, v) in enumerate(rows) if k != at)[:k]
            out.setdefault(i, []).extend((j, -s) for s, j in ranked)
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def sample_vectors(n, dim, seed, copies=True):
    """Random vectors, of which a sixth are copies of the first and some more are close to it."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    if copies:
        first, last = n // 2 + n // 6, n // 2 + n // 5
        x[n // 2 : first] = x[0]
        x[first:last] = x[0] + 1e-3 * rng.standard_normal((last - first, dim))
    return x


ODD_VECTORS = [(10_000, None), (10_020, []), (10_040, [1.0, None] + [0.0] * 6), (10_060, [float("nan")] + [0.0] * 7), (10_080, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
SHORT = (10_100, [1.0] * 3)


@pytest.mark.parametrize("n", [1, 15, 700])
def test_exact_search_is_exact(spark, n):
    x = sample_vectors(n, 8, n)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + ([(10_120, [0.0] * 8), SHORT] if n > 1 else [])
    whole = lambda v: [int(np.floor(64 * c)) for c in v]
    want = plain_search([(i, whole(v)) for i, v in rows], lambda a, b: sum(p * q for p, q in zip(a, b)))
    got = found(pivots.search(table(spark, rows + ODD_VECTORS), pivots=16))
    assert got == {q: hits for q, hits in want.items() if hits}


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_reach_their_recall(spark, scale):
    x = sample_vectors(900, 16, 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= np.random.default_rng(5).uniform(0.5, 2, (900, 1))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    odd = [(i, v and v * 2 if v != [] else v) for i, v in ODD_VECTORS] + [(10_120, [0.0] * 16)]
    rows += [(901, [0.1, 0.2, 0.3])]
    got = found(ann.search(table(spark, rows + odd)))
    want = plain_search(rows, lambda a, b: sum(p * q for p, q in zip(a, b)))
    assert set(got) == set(want) and all(len(h) == 20 for h in got.values())
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) / (20 * len(want))
    assert hit >= 0.9, hit
    for q, hits in got.items():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and q not in {j for j, _ in hits}
        for j, s in hits:
            assert s == pytest.approx(sum(a * b for a, b in zip(rows[q][1], rows[min(j, 900)][1])), abs=1e-12)
    assert scale or [j for j, _ in got[0]] == list(range(450, 470))


def test_searches_that_find_too_little_look_everywhere(spark):
    rows = [(i, list(map(float, v))) for i, v in enumerate(sample_vectors(200, 16, 6, copies=False))]
    got = found(ann.search(table(spark, rows), tables=1, probes=1))
    assert all(len(h) == 20 for h in got.values()) and len(got) == 10


def test_searches_of_nothing_and_of_repeated_rows(spark):
    assert ann.search(table(spark, [])).collect() == [] and pivots.search(table(spark, [])).collect() == []
    assert ann.search(table(spark, [(1, [1.0, 2.0])])).collect() == []


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_every_row_is_a_candidate(spark):
    """Vectors that share an id, rows that are given twice, and vectors of other lengths."""
    given = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (1, [0.25, 0.0]), (2, [0.5, 0.5]), (3, [0.75, 0.5, 9.0])]
    for search, of in ((ann.search, lambda c: c), (pivots.search, lambda c: int(64 * c))):
        want = []
        for at, (i, q) in enumerate(given):
            if i % 20 == 0:
                ranked = sorted((-sum(of(a) * of(b) for a, b in zip(q, v)), j) for k, (j, v) in enumerate(given) if k != at)
                want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
        assert rows_of(search(table(spark, given))) == sorted(want)


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    monkeypatch.setattr("byteloom.llm.common.SPLIT_ROWS", 5)
    for module in (ann, pivots):
        monkeypatch.setattr(module, "QUERY_ROWS", 4)
        monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    rows = [(20 * i, list(map(float, v))) for i, v in enumerate(sample_vectors(120, 8, 9))]
    assert found(pivots.search(table(spark, rows), pivots=8)) == plain_search([(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows], lambda a, b: sum(p * q for p, q in zip(a, b)))
    got = found(ann.search(table(spark, rows), probes=64))
    assert {q: [j for j, _ in h] for q, h in got.items()} == {q: [j for j, _ in h] for q, h in plain_search(rows, lambda a, b: float(np.einsum("i,i->", np.array(a), np.array(b)))).items()}


def test_exact_search_of_large_components(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, [1e6 + i / 64, 1e6, 1e6, 1e6]) for i in range(5)]
    want = plain_search([(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows], lambda a, b: sum(p * q for p, q in zip(a, b)))
    assert found(pivots.search(table(spark, rows), pivots=8)) == want
    with pytest.raises(ValueError, match="64 bits"):
        pivots.search(table(spark, [(20, [1e30]), (1, [1.0])]))


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(7).standard_normal((5, 12))
    turned = ann.rotated(x, 3)
    assert turned.shape == (5, 16) and np.allclose(turned @ turned.T, x @ x.T)
    near = ann.axes(x, 3, 4)
    both = np.concatenate([turned, -turned], axis=1)
    assert np.array_equal(near[:, 0], both.argmax(axis=1))
