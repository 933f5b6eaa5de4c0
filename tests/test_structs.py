"""Structs of pages against a plain walk over a tree."""

from html.parser import HTMLParser

import pytest

from talentgrid.sources import structs as S
from talentgrid.sources.tables import table


class Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = ["", {}, [], None]  # tag, attributes, children, parent
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in reversed(attrs)}, [], self.at]
        self.at[2].append(node)
        if tag not in S.VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node[0] != tag:
            node = node[3]
        if node is not self.root:
            self.at = node[3]

    def handle_data(self, data):
        self.at[2].append(data)


def walk(node):
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from walk(child)


def text_of(node):
    return "" if node[0] in S.SILENT else "".join(c if isinstance(c, str) else text_of(c) for c in node[2])


def selected(root, selector):
    steps = [S.step_of(s) for s in selector.split()]
    for node in walk(root):
        if S.fits(steps[-1], node[0], node[1]):
            left, up = list(steps[:-1]), node[3]
            while up is not None and left:
                if up[0] and S.fits(left[-1], up[0], up[1]):
                    left.pop()
                up = up[3]
            if not left:
                yield text_of(node).strip()


def plain(html, fields):
    tree, out = Tree(), {}
    tree.feed(html or "")
    tree.close()
    for f in fields:
        found = next((x for x in (list(selected(tree.root, s)) for s in f.selectors) if x), None)
        out[f.name] = (found if f.many else found[0]) if found else (list(f.default or ()) if f.many else f.default)
    return out


PAGES = [
    None, "", "plain text", "<h1 class='x job-title y'> A &amp; <b>B</b>\n</h1><h1 class=job-title>second</h1>",
    "<div class=job-header><p>x<h1>In <i>header</h1></div><h1 class='posting-title'>first by order</h1><span data-qa='salary'>$1<script>no</script><style>no</style>0</span>",
    "<ul class='job-requirements'><li>one<li>two</ul><ul class=posting-requirements><li>three</ul>", "<div data-qa=requirements><ol><li>a</li><li> </li><li>b</li></ol></div><p class='company-name'></p><p class=company-name>late</p>",
    "</div><div id=job-description><br><img src=x>Do <!-- not -->this</div></p><div class='job-descriptions'>no</div>", "<div class='job-header'></div><h1>outside</h1><div class=JOB-HEADER><h1>case</h1></div>",
    "<div><div class=job-header><div><section><h1 class=a>deep</h1></section></div></div></div>" + "<p>" * 200 + "x", "<td class='org-size'>5<td data-qa='founded-year'>1999 <a class='org-size'>6",
]


@pytest.mark.parametrize("fields", [S.JOB, S.COMPANY])
def test_cases(spark, fields):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(PAGES)], "page_id int, html string, title string")
    for r in S.structs(df, fields).collect():
        assert {f.name: r[f.name] for f in fields} == plain(PAGES[r.page_id], fields), r.page_id
    assert S.structs(df.limit(0), fields).count() == 0
    assert S.read(PAGES[4], S.JOB)["title"] == "first by order" and S.read(PAGES[3], S.JOB)["title"] == "A & B" and S.read(None, S.JOB)["requirements"] == ["No specific requirements listed"]


def test_deep_page():
    page = "<div class=company-name>" * 40_000 + "</b>" * 40_000 + "x" * 100
    assert S.read(page, S.COMPANY)["name"] == "Unknown Company" and S.read("<p>" * 100_000 + "<h1 class=job-title>T", S.JOB)["title"] == "T"


def test_selectors():
    assert S.step_of("h1.a.b#c[d='e f'][g]") == ("h1", frozenset("ab"), "c", (("d", "e f"), ("g", None)))
    for bad in ("", ">", "a>b", "h1:first", "*", "a,b"):
        with pytest.raises(ValueError):
            S.step_of(bad)


def test_of_tables(spark):
    from talentgrid import bindings_text as B

    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in table(spark, d, "pages").collect()}
    got = B.QUERIES["page_structs"](spark, d).collect()
    assert len(got) == len(pages)
    for r in got:
        want = plain(pages[r.page_id], B.PAGE_FIELDS)
        assert {f.name: r[f.name] for f in B.PAGE_FIELDS} == want | {"requirements": "|".join(want["requirements"])}
