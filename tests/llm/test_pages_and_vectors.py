"""Vectors against brute force, pages against their parts, archives against their rows, and odd rows for all of them."""

import base64
import hashlib
import time

import numpy as np
import pytest

from talentgrid.llm import html, neardup, warc

VECTORS = "vec_id long, embedding array<float>, label int, cosine double"


def brute(rows):
    good = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good.setdefault((label, len(v)), []).append((i, np.array(v, np.float32).astype(np.float64)))
    links, up = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for own in good.values():
        for k, (i, x) in enumerate(own):
            for j, y in own[:k]:
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
    return {i: (links[i], root(i), root(i) == i) for i, *_ in rows}


@pytest.mark.parametrize("shard", [16_384, 60])
def test_near_duplicates(spark, monkeypatch, shard):
    monkeypatch.setattr(neardup, "SHARD", shard)
    monkeypatch.setattr(neardup, "COUNT_BLOCK", 64)
    dice = np.random.default_rng(3)
    base = dice.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + dice.normal(size=16) * dice.choice([0.0, 0.05, 0.12, 0.6])).tolist(), int(i % 2)) for i in range(400)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, [1.0, None], 1), (905, [], 0), (906, rows[0][1][:8], 0), (907, rows[0][1], 0), (908, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], VECTORS)
    assert {r[0]: tuple(r[1:]) for r in neardup.classes(df).collect()} == brute(rows)
    assert neardup.classes(df.limit(0)).count() == 0


def test_keys_of_vectors(spark):
    dice = np.random.default_rng(9)
    a, b, c = (dice.normal(size=8).tolist() for _ in range(3))
    near = [x + 1e-3 for x in a]
    rows = [(5, a, 1), (3, near, 1), (None, a, 1), (None, c, 1), (7, b, 1), (7, a, 1), (7, b, 1), (2, c, 1)]
    # by row: 5, 3 and one of the 7s link; the other 7s are copies; rows without a key link with nothing
    want = sorted([(5, 2, 3, False), (3, 2, 3, True), (7, 2, 3, False), (7, 1, 7, True), (7, 1, 7, True), (2, 0, 2, True), (None, 0, None, False), (None, 0, None, False)], key=str)
    for kind in ("long", "int", "string"):
        own = [(None if i is None else str(i) if kind == "string" else i, v, g) for i, v, g in rows]
        got = neardup.classes(spark.createDataFrame(own, f"vec_id {kind}, embedding array<double>, label int"))
        assert dict(got.dtypes)["vec_id"] == "bigint" and sorted((tuple(r) for r in got.collect()), key=str) == want
    only = neardup.classes(spark.createDataFrame([(None, a, 1), (None, a, 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert {tuple(r) for r in only} == {(None, 0, None, False)}
    odd = neardup.classes(spark.createDataFrame([("x1", a, "l"), ("4", a, "l")], "vec_id string, embedding array<double>, label string")).collect()
    assert sorted((tuple(r) for r in odd), key=str) == [(4, 0, 4, True), (None, 0, None, False)]


def test_graph_recall():
    x = np.random.default_rng(0).normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    node, _ = neardup.Graph(x).search(x[:200], 64)
    best = np.argsort(-(x[:200] @ x.T), 1)[:, :10]
    assert np.mean([len(set(node[i, :10]) & set(best[i])) / 10 for i in range(200)]) >= 0.9


def test_sparse_links_across_shards(spark, monkeypatch):
    """Few links, most of them between shards: audits of such searches rest on the nearest nodes, and every link is found."""
    monkeypatch.setattr(neardup, "SHARD", 700)
    monkeypatch.setattr(neardup, "BLOCK", 300)
    dice = np.random.default_rng(11)
    x = dice.normal(size=(2600, 32))
    x[2500:] = x[dice.choice(2500, 100, replace=False)] + dice.normal(size=(100, 32)) * 0.08
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    assert 150 <= (links > 0).sum() <= 200 and [got[i][0] for i in range(len(x))] == links.tolist()


def test_audit_widens_a_beam(monkeypatch):
    x = np.random.default_rng(2).normal(size=(4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, q = neardup.Graph(x), np.random.default_rng(3).normal(size=(100, 48))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    monkeypatch.setattr(neardup, "QUERY_BEAM", 8)
    a, _, beam = neardup.links_of(graph, x, q, 0.98)
    assert beam > 8 and not len(a)  # nothing links, and still the first beam was too narrow


PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
    '<div class="ad">Buy this now, it is cheap.</div><article><h1>A long headline of the page</h1><p><b>First text &amp; more,\n with a break.<br><p>Second text that goes on for a while, and on.</p></article>'
    '<div class="comments"><p>I was the first to read this.</p></div><footer>&copy; Some house</footer></body></html>'
)


def test_short_comments(spark):
    first, second = "First text that goes on for a while, and on.", "Second text that goes on for a while, and on."
    rows = [(i, "u", f"<body><article><p>{first}</p>{mark}<p>{second}</p></article></body>") for i, mark in enumerate(("<!-->", "<!--->", "<!---->", "<!-- x --!>", "<!-- > -->", ""))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"{first}\n{second}"} and html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_main_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", "y"), (4, "u", "<nav>menu</nav>", "z"), (None, "u", PAGE * 20, "w")]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    want = "A long headline of the page\nFirst text & more, with a break.\nSecond text that goes on for a while, and on."
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0) and len(got) == 5


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<div class="a"id="b">hello</div>', ["hello"]), ('<p title="x"">tail</p>', ["tail"]), ('<p><a href=foo"bar>l</a> m</p>', ["l m"]), ("<p>a<script>var b = 1;", ["a"]), ("<p>a</p><style>p{}</p>", ["a"]),
        ("<p>a < b and 1<2</p>", ["a < b and 1<2"]), ("<p>a<!-- b <p>c", ["a"]), ("<p>x<button>go</button>y</p><button>z<p>w", ["x y", "z", "w"]), ("<form><label>Name</label><p>t</p></form>", ["t"]),
        ("<p data-x='a>b' y>q</p", ["q"]), ("<P CLASS=A/>r<BR/>s</P>", ["r s"]), ("<p>&lt;b&gt; &amp;amp;</p>", ["<b> &amp;"]), ("<p a=\"b c>d</p><p>e</p>", ["d", "e"]), ("<select><option>1</select><p>f", ["f"]), ("</p><?xml a?><!DOCTYPE html>g", ["g"]),
    ],
)
def test_markup_of_any_kind(page, texts):
    assert [n.text for n in html.parsed(page) if n.text is not None] == texts


def test_bad_pages_take_linear_time():
    for bad in ("<button>", "<svg ", "<!--", "<a b='", "<script", '<p x="', "<option><select>"):
        began = time.process_time()
        html.parsed(bad * 40_000)
        assert time.process_time() - began < 20, bad


def test_decoding_is_consistent():
    nodes = html.parsed("<div><p>a b</p><div><p>c d</p></div></div>")
    odds = np.array([-5.0 if n.text is None else 5.0 for n in nodes])
    assert html.decoded(nodes, odds) in (["a b", "c d"], [])


def test_siblings_of_long_pages():
    for n in (10, 39, 40, 400):
        nodes = html.parsed("<body><article>" + '<p>Some text.</p><p>More text.</p><div class="share">Share</div><p>The end.</p>' * n + "</article></body>")
        alike = html.features(nodes)[:, 12]
        own = [(x, a) for x, a in zip(nodes, alike) if x.parent is not None and x.parent.tag == "article"]
        assert len(own) == 4 * n and all(a == np.float32(0.25 if x.tag == "div" else 0.75) for x, a in own)
    page = "<html><body><nav><ul><li><a href='/a'>Home</a></li></ul></nav><article><h1>A long headline of the page</h1>" + "<p>A paragraph that goes on for a while, and on, and ends here.</p>" * 120 + "</article></body></html>"
    (text,) = html.main_texts([page], html.fit())
    assert text.count("\n") == 120 and "Home" not in text


def test_archives(spark, tmp_path):
    rows = [(7, "http://a/7", "same"), (3, "http://a/3", "same"), (5, None, None), (4, "http://a/4", ""), (9, "http://a b\n", "é" * 3000), (None, "http://n", "same"), (3, "http://a/3", "same"), (11, "u", "own " * 4000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    manifests = []
    for k, parts in enumerate((1, 5)):
        folder = f"file://{tmp_path}/w{k}"
        made = warc.write(pages.repartition(parts), folder, file_bytes=1500, shard_bytes=4000)
        manifests.append(sorted(tuple(r) for r in made.collect()))
        got = sorted((tuple(r) for r in warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect()), key=str)
        want, first = [], {"same": 3, "": 4}
        for i, _, text in rows:
            raw = (text or "").encode()
            lead = first.get(text or "", i)
            want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == lead else "revisit", None if i == lead else lead, True))
        assert got == sorted(want, key=str)
    assert manifests[0] == manifests[1] and len(manifests[0]) > 1
    assert warc.read(spark, folder, with_payload=True).where("page_id = 9").first().payload == ("é" * 3000).encode()
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none").count() == 0
