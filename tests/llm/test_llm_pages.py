import hashlib
import random

import pytest
from fleetscope.llm import html_text, warc
from hypothesis import given, settings
from hypothesis import strategies as st

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu-open">
<header>Site</header><nav><ul><li>Home</ul></nav><div class="cookie-notice"><p>We use cookies</div><p class=ad>Buy</p>
<main><article><header><h1>The &amp; title</h1></header><p>First <b>bold</b>
 line<br>goes on&nbsp;here<p>Second &lt;tag&gt; &am<form><input>Name</form><section id="comments"><p>Me too</section>
<aside>See also</aside><pre>a
 b</pre></article></main><footer>&copy; x</footer><!-- <p>gone</p> --></body></html>"""


def test_markup_decides():
    got = [text for text, kind in html_text.page_lines(PAGE) if kind == html_text.KEEP]
    assert got == ["The & title", "First bold line goes on here", "Second <tag> &am", "a b"]
    assert all(kind == html_text.DROP for _, kind in html_text.page_lines(PAGE.partition("<main>")[0]))
    assert html_text.page_lines("") == [] and html_text.page_lines("plain") == [("plain", html_text.OPEN)]
    assert html_text.page_lines("<article><p>cut off &amp") == [("cut off &", html_text.KEEP)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_places(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    places = html_text.common_places(a, b)
    rest = iter(b)
    assert len(places) == best[-1][-1] and all(x in rest for x in [a[i] for i in places])


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("<>/pab\"'= &;!-"), max_size=40))
def test_any_markup_is_read(page):
    html_text.page_lines(page)


def test_pages_of_a_host_are_differenced(spark):
    page = lambda own: "<div>Site of the year</div><p>" + own + "</p><div>Write to us any time</div>"
    rows = [(i, f"http://h{i % 3}.com/a/{i}", page(f"own text of page number {i} and nothing else at all " * 3)) for i in range(30)]
    rows += [(100, "http://alone.com/", page("x y")), (101, None, page("z")), (102, "http://h0.com/a/9z", None), (103, "http://c.com/1", page("same")), (104, "http://c.com/2", page("same"))]
    rows += [rows[0]]
    pages = spark.createDataFrame([(*r, 5, "t") for r in rows], "page_id bigint, url string, html string, row int, text string")
    for parts in (1, 6):
        got = html_text.extract_text(pages.repartition(parts)).collect()
        texts = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert all(texts[i] == rows[i][2].split("<p>")[1].split("</p>")[0].strip() for i in range(1, 30))
        assert texts[100].count("\n") == 2 and texts[101].count("\n") == 2 and texts[102] == "" and texts[103].count("\n") == 2
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_short_articles_and_copies_are_differenced(spark):
    page = lambda own: "<div>" + "Menu of the site " * 10 + "</div><p>" + own + "</p><div>" + "Write to us " * 12 + "</div>"
    own = {f"http://a.com/{i}": f"short text {i}" for i in range(4)}
    own |= {f"http://b.com/{i}": "copied article" for i in range(1, 6)} | {"http://b.com/0": "before", "http://b.com/6": "after"}
    own |= {"http://c.com/1": "one", "http://c.com/2": "two"}
    pages = spark.createDataFrame([(i, url, page(text)) for i, (url, text) in enumerate(own.items())], "page_id bigint, url string, html string")
    assert {r.url: r.text for r in html_text.extract_text(pages).collect()} == own


def test_given_pages(spark):
    got = html_text.extract_text(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    for r in got.join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), "page_id").collect():
        body = r.html.partition("<article>")[2].partition("</article>")[0]
        assert r.text.replace("\n", "").replace(" ", "") == "".join(__import__("html").unescape(__import__("re").sub("<[^>]*>", "", body)).split())


@pytest.mark.parametrize("chunk", [7, 100, warc.CHUNK])
def test_warc_round_trip(spark, tmp_path, chunk):
    draw = random.Random(chunk)
    piece = ["\r\n", "\r", "\n", "WARC/1.1\r\n", "\r\n\r\n", "é", "x", "WARC-Type: response", "𝄞", "Content-Length: 4"]
    payloads = ["".join(draw.choice(piece) for _ in range(draw.randrange(90))) for _ in range(40)]
    payloads += [None, "", "short", "short", "\r\n\r\nWARC/1.1\r\n" * 12, "y" * 5000, "y" * 5000, payloads[0], "y" * 5000]
    rows = [(i, f"http://x/{i}" if i % 4 else None, p, "z") for i, p in enumerate(payloads)] + [(None, "a\r\nWARC/1.1", "y" * 5000, None), (5, "u", payloads[5], "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    got = warc.round_trip(pages, str(tmp_path / "w"), chunk=chunk)
    got = got.collect()
    first = {}
    for i, _, p, _ in rows:
        if i is not None and len((p or "").encode()) >= 100:
            first[p] = min(i, first.get(p, i))
    want = []
    for i, _, p, _ in rows:
        data = (p or "").encode()
        revisit = p in first and (i is None or i > first[p])
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)
    assert not any(r.damaged for r in got)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_repeated_responses_that_others_revisit(spark, tmp_path):
    a, b = "a" * 150, "b" * 250
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (3, b), (None, a), (4, "short")]
    pages = spark.createDataFrame([(i, "http://x/", p) for i, p in rows], "page_id bigint, url string, html string")
    got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    want = []
    for i, p in rows:
        revisit = i != 1 and len(p) >= 100
        want.append((i, len(p), hashlib.sha256(p.encode()).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)


def test_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x/", "a" * 1000)], "page_id bigint, url string, html string")
    chunks = warc.chunk_table(warc.first_of_equals(pages, "page_id", "html"), 300)
    assert chunks.count() == 4
    warc.write_warc(chunks, str(tmp_path / "w"))
    segments = warc.read_warc(spark, str(tmp_path / "w"))
    assert [r.damaged for r in warc.fold_records(segments).collect()] == [False]
    assert [r.damaged for r in warc.fold_records(segments.where("chunk <> 2")).collect()] == [True]
