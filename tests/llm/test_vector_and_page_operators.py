"""Top-k, graphs, archives and pages against brute force or SQL, and on odd input."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from compare import differences, oracle_connection
from conftest import SMALL

from contractflow.llm import hnsw, html, topk, warc
from contractflow.llm.common import table
from contractflow.llm.queries import ORACLE, QUERIES


def rows_of(frame):
    return frame.toArrow().to_pylist()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert differences(spark, oracle_connection(SMALL), name, SMALL, QUERIES, ORACLE) == []


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]),
        (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (40, [1.0, 0.0, 0.0]), (7, [0.0, 0.0]),
        (8, [-0.01, 0.3]), (60, [3e30, -3e30]), (9, [2e30, 1.0]), (80, []),
    ]
    return spark.createDataFrame([r + ("x", 1) for r in rows], "vec_id long, embedding array<float>, vector string, rank int")


def test_top_k_against_brute_force(spark, monkeypatch):
    """Ties by the hundred, more blocks than one, bins that need several passes."""
    monkeypatch.setattr(topk, "BINS", 8)
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    draw = random.Random(2)
    rows = [(i, [draw.choice([0.0, 0.25, 0.25, 1.0, -1.0]) for _ in range(4)]) for i in range(600)]
    found = rows_of(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=20))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    expected = set()
    for q in range(0, 600, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        expected |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == expected


def test_top_k_odd_rows(spark, odd_vectors):
    found = rows_of(topk.top_k(odd_vectors, k=20))
    assert {r["vec_id"] for r in found}.isdisjoint({2, 3, 4, 5, None})
    zero = [(r["rank"], r["vec_id"]) for r in found if r["query_id"] == 0]
    assert zero[:1] == [(1, 9)] and sorted(v for _, v in zero) == [1, 1, 7, 8, 9, 20, 20, 60]
    assert [r["vec_id"] for r in found if r["query_id"] == 40] == [6]
    assert not [r for r in found if r["query_id"] == 80]
    assert topk.top_k(odd_vectors.where("false")).count() == 0


def test_graph_recall(spark):
    folder = "/root/testdata/sf0.1"
    found = rows_of(QUERIES["op6_hnsw"](spark, folder))
    rows = rows_of(table(spark, folder, "embeddings"))
    ids, points = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    at = {i: n for n, i in enumerate(ids.tolist())}
    hits = total = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = points @ points[at[q]]
        best = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20]
        mine = [r for r in found if r["query_id"] == q]
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(math.isclose(r["score"], scores[at[r["vec_id"]]], rel_tol=1e-12, abs_tol=1e-12) for r in mine)
        hits, total = hits + len(set(best) & {r["vec_id"] for r in mine}), total + 20
    assert hits >= 0.98 * total


def test_graph_of_many_nodes_and_copies():
    draw = np.random.default_rng(5)
    points = draw.normal(size=(4000, 24)) * draw.uniform(0.2, 2, size=(4000, 1))
    lifted = hnsw._lifted(points)
    graph = hnsw.Graph(lifted, hnsw._levels(len(points))).build()
    asked = draw.normal(size=(60, 24))
    unit = asked / np.sqrt((asked * asked).sum(axis=1))[:, None]
    found = graph.search(np.concatenate([unit, np.zeros((60, 1))], 1).astype(np.float32), hnsw.SEARCH)
    truth = np.argsort(-(asked @ points.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(truth.tolist(), found.tolist())]) >= 0.9


@pytest.mark.parametrize("long", [1e2, 1e4, 1e8, 1e160])
def test_recall_at_any_norms(spark, long):
    """Half of the norms spread over all sizes, the other half as they are but for one long vector."""
    draw = np.random.default_rng(9)
    points = draw.normal(size=(1500, 32))
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
    for norms in (10 ** draw.uniform(0, np.log10(long), 1500), np.where(np.arange(1500) == 7, long, 1.0)):
        rows = points * norms[:, None]
        frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
        found = rows_of(hnsw.nearest(frame, k=20))
        hits = 0
        for q in range(0, 1500, 20):
            scores = rows @ points[q]
            best = [i for i in np.argsort(-scores).tolist() if i != q][:20]
            hits += len(set(best) & {r["vec_id"] for r in found if r["query_id"] == q})
        assert hits >= 0.95 * 75 * 20 and len(found) == 75 * 20


def test_graph_odd_rows(spark, odd_vectors):
    found = rows_of(hnsw.nearest(odd_vectors, k=20))
    assert {r["vec_id"] for r in found}.isdisjoint({2, 3, 4, 5, 7, None})
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 0) == [1, 1, 8, 9, 20, 20, 60]
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 40] == [(1, 6, 1.0)]
    copies = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(300)], "vec_id long, embedding array<double>")
    mine = [r["vec_id"] for r in sorted(rows_of(hnsw.nearest(copies, k=20)), key=lambda r: r["rank"]) if r["query_id"] == 20]
    assert mine == [i for i in range(22) if i != 20][:20]
    assert hnsw.nearest(odd_vectors.where("false")).count() == 0


# -- archives --------------------------------------------------------------------------------

def test_archive_odd_payloads(spark, tmp_path):
    long = "é" * 200_000 + "\r\n\r\n" + "\U0001f600" * 70_000
    pages = [
        (1, "u", "a\r\n\r\n"), (2, None, None), (3, "x\r\ny", ""), (4, "u", "\r\n"), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n\r\n"),
        (6, "u", long), (6, "u", long), (None, "q", "\r\n"), (7, "u", "\r"), (8, "u", "z\r\n\r"), (9, "u", "\r\n\r\n"),
        (10, "u", "Content-Length: 5\r\n\r\n" + "\r\n" * 9), (11, "u", "a\r\n\r\n")]
    frame = spark.createDataFrame([p + ("c", 0) for p in pages], "page_id long, url string, html string, digest string, row int")
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path)
    found = rows_of(warc.read_archives(spark, path))
    expected = []
    for page, _, payload in pages:
        data = (payload or "").encode()
        last = max((p for p, _, h in pages if (h or "") == (payload or "") and p is not None), default=None)
        expected.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), last))
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in found) == sorted(
        (p or 0, n, d) for p, n, d, _ in expected)
    for r in found:
        last = {x[2]: x[3] for x in expected}[r["payload_digest"]]
        assert (r["record_type"] == "response") == (r["refers_to"] is None)
        assert r["refers_to"] == last if r["record_type"] == "revisit" else r["page_id"] == last
    assert sum(r["record_type"] == "response" for r in found) == len({x[2] for x in expected})
    assert warc.round_trip(frame.where("false")).count() == 0
    assert {r["record_type"] for r in rows_of(warc.round_trip(frame, least_bytes=10**9))} == {"response"}


def test_archives_hold_no_large_piece(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "x" * 400_000)], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "a"))
    pieces = spark.read.option("lineSep", "\r\n\r\n").text(str(tmp_path / "a"))
    assert max(len(r["value"]) for r in pieces.collect()) <= warc.CHUNK
    kinds = [r["value"].split("\r\n")[1] for r in pieces.collect() if r["value"].startswith("WARC/1.1")]
    assert kinds == ["WARC-Type: response", *["WARC-Type: continuation"] * 6]


def test_a_changed_payload_is_noticed():
    good = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:0>\r\nWARC-Payload-Digest: sha1:"
            + base64.b32encode(hashlib.sha1(b"abc").digest()).decode() + "\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n")
    reader = warc.Reader()
    assert list(reader.feed((good % (7, "\r\n\r\nabc")).encode())) == [
        (1, 3, base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "response", None)]
    with pytest.raises(ValueError):
        list(warc.Reader().feed((good % (7, "\r\n\r\nabd")).encode()))


# -- pages -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar menu-open">
<header><h1>Site</h1><a href=x>home</a></header><div id="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1><span>by me</span></header>
<p>One <em>two</em><br>three &nbsp; &lt;x&gt; a < b.<ul><li>i1<li>i2</ul><table><tr><td>c1<td>c2</table>
<aside>side</aside><form><p>mail</p></form><div class="share-buttons">Share</div><footer>tags</footer></article>
<section id="comments"><article class="comment">Nice!</article></section></main>
<script>if(a<b)"</p>"</script><div class="AdSlot">buy</div><!-- <p>gone</p> --><footer>(c)</footer>"""
TEXT = "Title & more\n\nOne two three <x> a < b.\n\ni1\n\ni2\n\nc1\n\nc2"


def test_page_with_all_kinds_of_boilerplate(spark):
    plain = '<div><a href=1>Home</a> <a href=2>News</a></div><div class="content"><p>Hello  world</p><p>Again</div>'
    long = "<article>" + "<p>word &eacute; word</p>" * 20_000 + "</article>"
    rows = [(1, "http://a.example/x", PAGE), (2, "http://a.example/y", None), (3, None, plain), (None, "nonsense", ""),
            (4, "http://a.example/z", long), (1, "http://a.example/x", PAGE), (5, "http://u@b.example:80/", "<p>x <b>y"),
            (6, "http://b.example/", "plain text"), (7, "http://b.example/", '<p title="a>b">x</p><p title="open>z</p>')]
    frame = spark.createDataFrame([r + ("t", "h", 0) for r in rows], "page_id long, url string, html string, text string, host string, n_chars int")
    for limit in (html.BROADCAST_BYTES, 0):  # handed to every task, and joined
        found = rows_of(html.main_texts(frame, limit))
        got = {r["page_id"]: r["text"] for r in found}
        assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
        assert got[1] == TEXT and got[2] == "" and got[None] == ""
        assert got[3] == "Hello world\n\nAgain" and got[5] == "x y" and got[6] == "plain text" and got[7] == "x\n\nz"
        assert got[4] == "\n\n".join(["word é word"] * 20_000)
    assert html.main_texts(frame.where("false")).count() == 0


def test_layout_wrappers_keep_the_main_text(spark):
    inside = ('<nav><a href=1>Home</a></nav><article><h1>Title</h1><p>Long text of the page itself</p><div class="share">Share'
              '</div></article><div class="sidebar"><p>side</p></div><section id="comments"><h2>So many</h2><p>%s</p></section>' % "words")
    plain = '<h1>Title</h1><div class="text"><p>Long text of the page itself</p></div><div class="promo"><p>buy</p></div>'
    rows = [
        (1, f'<div id=page class="has-sidebar">{inside}</div>'), (2, f'<div class="no-sidebar"><div class=with-menu>{inside}</div></div>'),
        (3, f'<form action=x>{inside}</form>'), (4, f'<form action=x>{plain}</form><p>skip</p>'), (5, f'<body>{inside}</body>'),
        (6, f'<main><h2>Top</h2><div class="with-widgets">{plain}</div></main>'),
        (7, '<p>Own text</p><section id="comments"><h2>All</h2><p>Far more text of people who comment on the page</p></section>'),
        (8, '<p>Own text</p><div class="ad">An advert with far more text than the page</div>')]
    frame = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows_of(html.main_texts(frame))}
    text = "Title\n\nLong text of the page itself"
    assert [got[i] for i in (1, 2, 3, 5)] == [text] * 4
    assert got[4] == text + "\n\nskip" and got[6] == "Top\n\n" + text and got[7] == got[8] == "Own text"


def text_of(page, *others):
    held = {}
    for p in (page, *others):
        html._merged(held, "", *html.skeleton(p), [html.digest(p)])
    return html.Roles(html._packed(*held[""])).text(page)


@pytest.mark.parametrize("page, text", [
    ("<article>" + "<b>" * 600 + "x</article>", "x"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>y", "deep\n\ny"),
    ("<div>" * 3000 + "<nav>menu</nav><p>z<div class=ad><div>buy", "z"),
    ("<p>" + "\u0130" * 12 + "</p><SCRIPT>a</Script ><p>Hello</p><p>World</p>", "\u0130" * 12 + "\n\nHello\n\nWorld"),
    ("<p>ok</p>" + "<a " * 350_000, "ok"), ("<p>ok</p>" + "<i " * 350_000 + "><p>x", "ok\n\nx"), ("<p>ok</p>" + '<b "' * 250_000 + "><p>x", "ok\n\nx"),
    ("<p>a > b" + "<!" * 350_000, "a > b"), ("<p>a<!-- x > y", "a"), ("<p>1 < 2 and 3", "1 < 2 and 3"),
    ("<article><p>Let <math><mi>x</mi></math> be <svg><text>t</text></svg></p></article>", "Let x be t"),
    ("<article><p class=alert-level>A<div class='search-results-discussion'>B</div><div class='share-buttons'>C</div></article>", "A\n\nB"),
    ("<article><p>own</article><article class='ad promo'><p>buy</article>", "own"),
], ids=range(13))
def test_odd_pages(page, text):
    assert text_of(page) == text


def test_template_text_of_a_host_is_left_out():
    """The wrapper decides: what all pages of a host say in the same place is not a page's own text."""
    pages = [f"<article><h1>All</h1><div>Please read our terms</div><p>one {i}</p><p>two {i}</p></article>" for i in range(5)]
    assert text_of(*pages) == "All\n\none 0\n\ntwo 0"
    whole = "All\n\nPlease read our terms\n\none 0\n\ntwo 0"
    assert text_of(pages[0]) == text_of(*pages[:1] * 9) == text_of(*pages[:2]) == whole  # copies and few pages tell nothing
    assert text_of(*pages, "<article><h1>All</h1><p>other</p></article>") == whole  # not on every page


def test_wide_pages_are_merged_by_label():
    draw = random.Random(1)
    pages = ["<article>" + "".join(f"<{x}>t{i}</{x}>" for i, x in enumerate(draw.choices(["p", "h2", "ul", "div", "pre"], k=3000)))
             + "</article>" for _ in range(3)]
    assert text_of(*pages) == "\n\n".join(f"t{i}" for i in range(3000))


def test_pages_query(spark):
    """The given pages keep their text in an article, whose parts are told apart by patterns here."""
    import re
    from html import unescape
    found = {r["page_id"]: r for r in rows_of(QUERIES["op10_html"](spark, SMALL))}
    for r in rows_of(table(spark, SMALL, "pages")):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [re.sub(r"</?b>", "", x).replace("<br>", " ") for x in re.split(r"</?(?:p|h1)>", inner)]
        blocks = [" ".join(unescape(p).split()) for p in parts]
        assert found[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b)
        assert found[r["page_id"]]["url"] == r["url"]


def test_wrapper_covers_what_was_aligned():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>a</ul><h2>t</h2><p>x</p><p>y</p>", "<p>x</p><dl><dt>a<dd>b<dt>c<dd>d</dl>"]
    whole, parts = [], [html.skeleton(p)[0] for p in pages]
    for part in parts:
        whole = html.align(whole, part) if whole else part
    assert html.expression(whole) == (
        "(<ul>(<li>#text</li>)+</ul>)?(<h2>#text</h2>)?(<p>#text</p>)+(<dl>(<dt>#text</dt><dd>#text</dd>)+</dl>)?")
    assert {p for part in parts for p in html.slots(part)} == set(html.slots(whole))
