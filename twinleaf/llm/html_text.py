"""Visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a
renderer that keeps the spacing of blocks, lists, preformatted text and aligned table cells.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches

#: A comment, a declaration, an end tag, or the name of a start tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?|<(?P<start>[a-zA-Z][^\s/>]*+)", re.S)
#: The rest of a start tag: quotes protect what is in them behind an equals sign, if they are closed.
_TAG_END = re.compile(r"""(?:[^>=]++|=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|["']?+))*+>""")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes noscript canvas audio video datalist meta link".split())
#: Blocks with an empty line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp table ul ol dl figure fieldset hr".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main menu nav optgroup option search section summary tr caption thead tbody tfoot td th".split()
)
_CLOSES_P = (SPACED | BLOCK) - frozenset("html body option optgroup td th tr thead tbody tfoot caption legend".split())
#: Start tag -> open tags that it ends, and the tags beyond which it doesn't look.
_LISTS, _TABLE, _SELECT = frozenset("ul ol menu dir table td th".split()), frozenset(["table"]), frozenset("select datalist".split())
IMPLIED = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "td": (frozenset("td th caption colgroup".split()), _TABLE | {"tr"}),
    "th": (frozenset("td th caption colgroup".split()), _TABLE | {"tr"}),
    "tr": (frozenset("tr td th caption colgroup".split()), _TABLE | {"tbody", "thead", "tfoot"}),
    "option": (frozenset(["option"]), _SELECT),
    "optgroup": (frozenset("option optgroup".split()), _SELECT),
} | {t: (frozenset("tbody thead tfoot tr td th caption colgroup".split()), _TABLE) for t in ("tbody", "thead", "tfoot")}
PREFORMATTED = frozenset("pre xmp".split())
#: Columns that nested lists are indented by at most.
MAX_INDENT = 40
#: A table is aligned unless that makes its lines longer than WIDER times its text and ROOMY characters:
#: one cell of a megabyte would else fill up every row of its column.
WIDER, ROOMY = 4, 1 << 16


class Node:
    """An element. lines: a table that has been laid out."""

    __slots__ = ("tag", "attrs", "children", "lines")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.lines = tag, attrs, [], None

    def attributes(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for name, *values in _ATTR.findall(self.attrs):
            found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        return found


class Open:
    """The elements that are open, and for each tag where they are, so that none is sought in vain."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: frozenset) -> int:
        """The place of the innermost open element with one of the tags; 0: none."""
        return max((found[-1] for t in tags if (found := self.at.get(t))), default=0)

    def close(self, tags: frozenset, limit: frozenset) -> bool:
        """End the innermost element with one of the tags, and what is open inside, unless one of limit is
        open inside it."""
        i = self.last(tags)
        if not i or self.last(limit - tags) > i:
            return False
        while len(self.stack) > i:
            self.at[self.stack.pop().tag].pop()
        return True


_ROW_PARTS = frozenset("tr td th tbody thead tfoot".split())
_P, _P_LIMIT, _HEAD, _NO_TAGS = frozenset(["p"]), frozenset("table td th button caption object".split()), frozenset(["head"]), frozenset()
_END_LIMIT = frozenset("td th caption".split())


def build(page: str) -> Node:
    """The element tree of a page. Start tags imply the ends of open paragraphs, items, cells, rows
    and options; an end tag closes what is open inside its element, and counts for nothing where that
    isn't open or a table cell lies between; void elements have no content. A start tag that the page
    doesn't end is text, and so is all behind it. Time grows with the page, whatever is nested or open."""
    root = Node("#root")
    there, at, size = Open(root), 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        tag = m and m["start"]
        whole = _TAG_END.match(page, m.end()) if tag else None
        if tag and not whole:
            m = None
        text = page[at : m.start() if m else size]
        if text:
            there.stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = whole.end() if whole else m.end()
        if tag:
            tag = tag.lower()
            if tag in _CLOSES_P:
                there.close(_P, _P_LIMIT)
            if tag in IMPLIED:
                tags, limit = IMPLIED[tag]
                while there.close(tags, limit) and len(tags) > 2:
                    pass
            if tag == "body":
                there.close(_HEAD, _NO_TAGS)
            node = Node(tag, page[m.end() : at - 1])
            there.stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                raw = page[at : end.start() if end else size]
                if raw and tag in ("textarea", "xmp"):
                    node.children.append(raw if tag == "xmp" else html.unescape(raw))
                at = end.end() if end else size
            elif tag not in VOID:
                there.push(node)
        elif tag := m["end"]:
            tag = tag.lower()
            if tag == "br":
                there.stack[-1].children.append(Node("br"))
            there.close(frozenset([tag]), _NO_TAGS if tag in ("table", "html", "body") else _TABLE if tag in _ROW_PARTS else _END_LIMIT)
    return root


def width_of(text: str) -> int:
    """Columns that a text takes: none for combining marks, two for wide characters."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text with pending gaps, the indent of the lists that are open, and item markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.indent, self.marker = 0, ""

    def text(self, s: str) -> None:
        words = _SPACES.sub(" ", s)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        elif not self.line:
            self.start()
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def start(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.line.append(" " * (min(self.indent, MAX_INDENT) - len(self.marker)) + self.marker)
        self.marker = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        """A line that stays as it is."""
        self.start()
        lead = self.line.pop()
        self.lines.append((lead + line if lead else line).rstrip())

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def seen(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether a node is displayed at all, and whether its own text is visible."""
    if node.tag in UNSEEN:
        return False, False
    if not node.attrs:
        return True, visible
    if "hidden" not in (low := node.attrs.lower()) and "style" not in low:
        return True, visible
    attrs = node.attributes()
    style = attrs.get("style", "")
    if "hidden" in attrs or _NONE.search(style):
        return False, False
    if m := _VISIBILITY.search(style):
        visible = m[1].lower() == "visible"
    return True, visible


def span_of(attrs: dict[str, str], name: str, most: int) -> int:
    """A span as HTML has it: a whole number from 1 to most."""
    value = attrs.get(name, "")
    return max(1, min(int(value), most)) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def lay_out(table: Node, visible: bool) -> list[str]:
    """The lines of a table: captions and what else is no row, then the rows, cells aligned in columns.
    Tables inside have been laid out before. Columns without any text take no room."""
    captions, rows, number = [], [], 0
    carried, runs = {}, {}  # column -> the column behind a cell, or a run of cells, and the row at which it ends

    def free(column: int) -> int:
        """The first column from this one on that no cell of an earlier row reaches into."""
        start, until = column, 1 << 30
        while True:
            held = next((x for x in (runs.get(column), carried.get(column)) if x and x[1] > number), None)
            if not held:
                break
            column, until = held[0], min(until, held[1])
        if column > start:
            runs[start] = column, until
        return column

    todo = [(c, visible) for c in reversed(table.children)]
    while todo:
        node, vis = todo.pop()
        if isinstance(node, str):
            if vis and node.strip(" \t\n\r\f"):
                captions.append(_SPACES.sub(" ", node).strip(" "))
            continue
        shown, vis = seen(node, vis)
        if not shown:
            continue
        if node.tag in ("thead", "tbody", "tfoot"):
            todo.extend((c, vis) for c in reversed(node.children))
        elif node.tag != "tr":
            if node.lines is not None:
                captions.extend(node.lines)
            else:
                captions.extend(render(node, vis))
        else:
            row, column = [], 0
            for cell in node.children:
                if isinstance(cell, str):
                    if vis and (text := _SPACES.sub(" ", cell).strip(" ")):
                        row.append((column, text))
                        column += 1
                    continue
                shown, inner = seen(cell, vis)
                if not shown:
                    continue
                column = free(column)
                spans = cell.attributes() if "span" in cell.attrs.lower() else {}
                end = column + span_of(spans, "colspan", 1000)
                if (tall := span_of(spans, "rowspan", 65534)) > 1:
                    carried[column] = end, number + tall
                lines = cell.lines if cell.lines is not None else render(cell, inner)
                if text := " ".join(x.strip() for x in lines if x.strip()):
                    row.append((column, text))
                column = end
            rows.append(row)
            number += 1
    used = {c: k for k, c in enumerate(sorted({c for row in rows for c, _ in row}))}
    widths = [0] * len(used)
    for row in rows:
        for c, text in row[:-1]:
            widths[used[c]] = max(widths[used[c]], width_of(text))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    filled = sum(starts[used[row[-1][0]]] for row in rows if row)
    aligned = filled <= WIDER * sum(len(t) for row in rows for _, t in row) + ROOMY
    out = captions
    for row in rows:
        line, at = [], 0
        for c, text in row:
            gap = max(starts[used[c]] - at, 0) if aligned else 2 * bool(line)
            line += [" " * gap, text] if gap else [text]
            at += gap + width_of(text)
        if line:
            out.append("".join(line).rstrip(" "))
    return out


def lay_out_tables(root: Node) -> None:
    """Lay out all tables that are seen, inner ones first."""
    todo, tables = [(root, True)], []
    while todo:
        node, vis = todo.pop()
        shown, vis = seen(node, vis)
        if shown:
            if node.tag == "table":
                tables.append((node, vis))
            todo.extend((c, vis) for c in node.children if not isinstance(c, str))
    for table, vis in reversed(tables):
        table.lines = lay_out(table, vis)


def render(root: Node, visible: bool = True) -> list[str]:
    """The lines of all visible text below a node. Tables below it have been laid out."""
    page, lists = Page(), []
    todo: list = [(c, visible) for c in reversed(root.children)]
    pre = 0
    while todo:
        node, vis = todo.pop()
        if isinstance(node, str):
            if not vis:
                continue
            if pre:
                *whole, rest = node.replace("\r\n", "\n").split("\n")
                for line in whole:
                    page.line.append(line) if page.line else page.put(line)
                    page.end_line()
                if rest:
                    page.start() if not page.line else None
                    page.line.append(rest)
            else:
                page.text(node)
            continue
        if callable(node):
            node()
            continue
        shown, vis = seen(node, vis)
        if not shown:
            continue
        tag = node.tag
        gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1
        if tag == "br":
            page.end_line() if page.line else page.block(2)
            continue
        if tag in BLOCK:
            page.block(gap)
        if tag == "table":
            for line in node.lines or []:
                page.put(line)
            page.block(2)
            continue
        if tag in ("ul", "ol", "menu"):
            start = node.attributes().get("start", "1") if node.attrs else "1"
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            todo.append((lists.pop, vis))
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0]:
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            old, outer = page.indent, page.marker
            page.indent += len(marker)
            page.marker = marker

            def leave(old=old, outer=outer):  # an item without a line leaves the outer marker to the next
                page.indent, page.marker = old, outer if page.marker else ""

            todo.append((leave, vis))
        elif tag == "dd":
            old = page.indent
            page.indent += 2
            todo.append((lambda old=old: setattr(page, "indent", old), vis))
        elif tag in PREFORMATTED:
            pre += 1
            if node.children and isinstance(node.children[0], str):
                node.children[0] = re.sub(r"\A\r?\n", "", node.children[0])

            def leave_pre():
                nonlocal pre
                pre -= 1

            todo.append((leave_pre, vis))
        elif tag in ("td", "th"):
            page.space = True
        if tag in BLOCK:
            todo.append((lambda gap=gap: page.block(gap), vis))
        todo.extend((c, vis) for c in reversed(node.children))
    return page.result()


def extract(page: str | None) -> str:
    """The visible text of a page, laid out; null and empty pages have none."""
    if not page:
        return ""
    tree = build(page)
    lay_out_tables(tree)
    return "\n".join(render(tree))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The id, text and n_chars of every row, and with keep also row, a struct of the columns named there.

    Null, empty and text-free pages give an empty text; repeated rows are rendered each; other columns
    are ignored; an empty table gives no rows. Elements and tables may be nested to any depth: nothing
    recurses, and no depth is laid out in another way."""
    bound_batches(pages.sparkSession)
    more = [] if keep is None else [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")]
    plain = pages.select(F.col(html_col).alias("html"), F.col(id_col).alias(id_col), *more)

    def run(rows):
        for batch in rows:
            if batch.num_rows:
                texts = [extract(p) for p in batch.column(0).to_pylist()]
                columns = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "text", "n_chars"])

    schema = T.StructType([*plain.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return plain.mapInArrow(run, schema)


def op6_html(spark, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
