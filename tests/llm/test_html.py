import html
import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinleaf.llm.html_text import extract, extract_pages


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>One<p>Two", "One\n\nTwo"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
        ("<table><tr><th>k<th>v<tr><td>long<td>1</table>", "k     v\nlong  1"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab     c\n1   2  3"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
        ("<head><title>t</title></head><body>b<script>x<y</script><style>p{}</style></body>", "b"),
        ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"),
        ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</p>", "yes"),
        ("a &lt; b &amp; c&nbsp;d", "a < b & c\xa0d"),
        ("x < y <!-- no --> z", "x < y z"),
        ("<b>bo</b>ld <i>it</i>alic", "bold italic"),
        ("<p>a</div>b</p>", "ab"),
        ("<td>loose<td>cells", "loose\ncells"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("unclosed <b", "unclosed <b"),
        ("a <b x='>' y=\"<i>\">c</b> <i q=\"open>d", "a c d"),
        ("<xmp>\n a <b>\n  c</xmp>d", " a <b>\n  c\n\nd"),
        ("<table><tr><td>a<td><td>b<tr><td>1<td><td>2</table>", "a  b\n1  2"),
        ("<table><tr><td colspan=x rowspan=0>a<td colspan=-1>b</table>", "a  b"),
        ("<table><tr><td rowspan=3>a<td rowspan=2>b<td>c<tr><td>d<tr><td>e<td>f</table>", "a  b  c\n      d\n   e  f"),
    ],
)
def test_layout(page, text):
    assert extract(page) == text


def test_any_depth():
    assert extract("<div>" * 20000 + "deep") == "deep"
    assert extract("<table><tr><td>" * 60 + "x") == "x"
    assert extract("<table><tr><td>l<td>" * 60 + "x").split() == ["l"] * 60 + ["x"]
    assert extract("<ul><li>a" * 30).split("\n")[-1] == " " * 38 + "- a"


@pytest.mark.parametrize(
    "page",
    ["<b><div>" * 60000, "<a " * 150000, '<a x="' * 80000, "<a '\">" * 80000, "<table><tr><td>x" * 20000, "<ul><li>a" * 50000, "<p></div>" * 50000, "</x" * 150000, "<" * 500000, "<!--" * 120000,
     "<table>" + "<tr><td colspan=1000 rowspan=9>a" * 15000, "<table><tr>" + "<td rowspan=65534>a" * 8000 + "<tr><td>b" * 35000, "<table><tr><td>" + "y" * 250000 + "<td>z" + "<tr><td>a<td>b" * 15000],
)
def test_hostile_pages_take_time_in_proportion(page):
    start = time.perf_counter()
    text = extract(page)
    assert time.perf_counter() - start < 5 and len(text) < 6 * len(page)


# ---- a plain recursive renderer ------------------------------------------------------------------

BLOCKS, SPACED = "div section ul ol li table p h2 blockquote".split(), "ul ol table p h2 blockquote".split()


def plain(nodes, lists=0, visible=True):
    """Gaps (numbers) and lines [prefix, text, marked] of nodes: a text, or (tag, attrs, children)."""
    out, held = [], ""

    def flush():
        nonlocal held
        if text := " ".join(held.split(" ")).strip(" "):
            out.append(["", re.sub(" +", " ", text), False])
        held = ""

    def walk(nodes, visible):
        nonlocal held
        number = 0
        for node in nodes:
            if isinstance(node, str):
                held += re.sub("[ \t\n]+", " ", node) if visible else ""
                continue
            tag, attrs, children = node
            if "hidden" in attrs or "none" in attrs:
                continue
            seen = True if "visible" in attrs else False if "collapse" in attrs else visible
            if tag not in BLOCKS:
                walk(children, seen)
                continue
            flush()
            gap = 1 if tag not in SPACED or tag in ("ul", "ol") and lists else 2
            out.append(gap)
            if tag == "table":
                out.extend(["", x, False] for x in plain_table(children, seen))
            elif tag in ("ul", "ol"):
                for item in children:
                    if "hidden" in item[1] or "none" in item[1]:
                        continue
                    number += 1
                    marker = f"{number}. " if tag == "ol" else "- "
                    inner = plain(item[2], lists + 1, True if "visible" in item[1] else False if "collapse" in item[1] else seen)
                    first = next((x for x in inner if isinstance(x, list)), None)
                    for x in inner:
                        if isinstance(x, list):
                            x[0] = (marker if x is first and not x[2] else " " * len(marker)) + x[0]
                    if first:
                        first[2] = True
                    out.extend([1, *inner, 1])
                number = 0
            else:
                out.extend(plain(children, lists, seen))
            out.append(2 if tag == "table" else gap)

    walk(nodes, visible)
    flush()
    return out


def lines_of(items):
    out, gap = [], 0
    for x in items:
        if isinstance(x, int):
            gap = max(gap, x)
        else:
            out += [""] * (gap > 1 and bool(out)) + [(x[0] + x[1]).rstrip()]
            gap = 0
    return out


def plain_table(rows, visible):
    grid, taken = {}, set()
    number = 0
    for _, attrs, cells in rows:
        if "hidden" in attrs or "none" in attrs:
            continue
        vis = True if "visible" in attrs else False if "collapse" in attrs else visible
        column = 0
        for _, cell_attrs, children in cells:
            if "hidden" in cell_attrs or "none" in cell_attrs:
                continue
            while (number, column) in taken:
                column += 1
            wide, tall = (int(m[1]) if (m := re.search(k + "=([0-9]+)", cell_attrs)) else 1 for k in ("colspan", "rowspan"))
            taken |= {(number + i, column + j) for i in range(tall) for j in range(wide)}
            inner = True if "visible" in cell_attrs else False if "collapse" in cell_attrs else vis
            grid[number, column] = " ".join(x.strip() for x in lines_of(plain(children, 0, inner)) if x.strip())
            column += wide
        number += 1
    columns = sorted({c for (_, c), t in grid.items() if t})
    texts = [[grid.get((r, c), "") for c in columns] for r in range(number)]
    for row in texts:
        while row and not row[-1]:
            row.pop()
    widths = [max([len(row[k]) for row in texts if len(row) > k + 1], default=0) for k in range(len(columns))]
    return ["  ".join([t.ljust(w) for t, w in zip(row, widths)][:-1] + row[-1:]) for row in texts if row]


TEXT = st.text("ab. \n", min_size=1, max_size=6)
ATTRS = st.sampled_from(["", "", "", "", " hidden", " style='display:none'", " style='visibility:collapse'", " style='visibility:visible'"])
SPANS = st.sampled_from(["", "", "", " colspan=2", " rowspan=2", " rowspan=3 colspan=2"])


def element(tags, children):
    return st.tuples(st.sampled_from(tags), ATTRS, children)


def tables(content):
    cell = st.tuples(st.just("td"), st.tuples(ATTRS, SPANS).map("".join), st.lists(content, max_size=2))
    row = st.tuples(st.just("tr"), ATTRS, st.lists(cell, max_size=4))
    return st.tuples(st.just("table"), ATTRS, st.lists(row, max_size=4))


INLINE = st.recursive(TEXT, lambda x: element(["b", "span"], st.lists(x, max_size=3)), max_leaves=4)
TREES = st.recursive(
    st.one_of(INLINE, element(["p", "h2"], st.lists(INLINE, max_size=3))),
    lambda x: st.one_of(element(["div", "section", "blockquote"], st.lists(x, max_size=4)), element(["ul", "ol"], st.lists(st.tuples(st.just("li"), ATTRS, st.lists(x, max_size=3)), max_size=3)), tables(x)),
    max_leaves=14,
)


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(written, node[2]))}</{node[0]}>"


@given(st.lists(TREES, max_size=4))
@settings(max_examples=600, deadline=None)
def test_layout_like_a_plain_recursive_renderer(nodes):
    assert extract("".join(map(written, nodes))).split("\n") == (lines_of(plain(nodes)) or [""])


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_data(self, data):
        self.found.append(data)


@given(st.recursive(st.text(st.characters(codec="utf-8", exclude_characters="<&\x00\r", exclude_categories=["Cc"]), max_size=12), lambda x: st.tuples(st.sampled_from("div p b ul li table tr td section em".split()), st.lists(x, max_size=4)), max_leaves=20))
@settings(max_examples=150, deadline=None)
def test_no_visible_character_is_lost(tree):
    def write(node):
        return html.escape(node) if isinstance(node, str) else f"<{node[0]}>{''.join(map(write, node[1]))}</{node[0]}>"

    page = write(tree)
    parser = Plain()
    parser.feed(page)
    letters = lambda s: sorted(re.sub(r"[\s\-]|\d+\. ", "", s))
    assert letters(extract(page)) == letters("".join(parser.found))


def test_pages(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (2, None, None, "y"), (3, "u", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_pages(pages).collect())
    assert got == [(1, "a", 1), (1, "a", 1), (2, "", 0), (3, "", 0)]
    assert extract_pages(pages.where("false")).collect() == []
    named = sorted((r["page_id"], r["row"]["text"], r["text"]) for r in extract_pages(pages, keep=["text", "url"]).collect())
    assert named == [(1, "x", "a"), (1, "x", "a"), (2, "y", ""), (3, "z", "")]
