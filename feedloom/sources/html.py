"""HTML to a node table: the only Python stage of the feed engine."""

from __future__ import annotations

import re
from html import escape
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "page_id long, nid int, parent_nid int, end_nid int, level int, child_idx int, children int, kind string, tag string, text string, tail string, xp_text string, "
    "attrs map<string,string>, path array<int>, anc array<int>, start_pos int, end_pos int, head string, foot string"
)
#: Columns of the node table that only raw HTML needs.
RAW = ["start_pos", "end_pos", "head", "foot"]

# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link style script base".split())
#: A start tag closes these open elements, unless one of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Stands for an ampersand that begins no reference while a page is parsed: a surrogate, which no page's text can hold.
AMP = "\ud800"
NAMED = re.compile("&([A-Za-z][A-Za-z0-9]*;?)")


def marked(html: str) -> str:
    """html with AMP for the ampersands before a name that is not a known one with its semicolon; these stay as they are written."""
    return NAMED.sub(lambda m: m[0] if m[1][-1] == ";" and m[1] in html5 else AMP + m[1], html)


def plain(text: str) -> str:
    return text.replace(AMP, "&")


class _Node:
    __slots__ = ("tag", "attrs", "text", "tail", "children", "parent", "kind")

    def __init__(self, tag, attrs, parent, kind="element"):
        self.tag, self.attrs, self.parent, self.kind = tag, attrs, parent, kind
        self.text, self.tail, self.children = None, None, []


class _Builder(HTMLParser):
    """A tree of elements and comments under html, head and body, which are made where they are missing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", {}, None)
        self.open = [self.root]
        self.head = self.body = None

    def _push(self, tag, attrs):
        node = _Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        self.open.append(node)
        return node

    def _in_body(self):
        if self.body is None:
            self.open = [self.root]
            self.body = self._push("body", {})

    def handle_starttag(self, tag, attrs):
        tag = plain(tag)
        attrs = {plain(k): plain(v) if v is not None else "" for k, v in reversed(attrs)}
        if tag == "html":
            self.root.attrs = {**attrs, **self.root.attrs}
            return
        if tag == "head":
            if self.head is None and self.body is None:
                self.head = self._push("head", attrs)
            return
        if tag == "body":
            if self.body is None:
                self.open = [self.root]
                self.body = self._push("body", attrs)
            return
        if tag in HEAD and self.body is None:
            if self.head is None:
                self.head = self._push("head", {})
        else:
            self._in_body()
        if tag in ENDS_P:
            self._close({"p"}, {"body", "td", "th", "button", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self._push(tag, attrs)
        if tag in VOID:
            self.open.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        tag = plain(tag)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def _close(self, tags, until):
        """Closes the outermost open element of tags that no element of until encloses."""
        at = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                at = i
            elif self.open[i].tag in until or self.open[i].tag == "body":
                break
        if at is not None:
            del self.open[at:]

    def handle_endtag(self, tag):
        tag = plain(tag)
        if tag in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.body is None and len(self.open) == 1 or self.open[-1] is self.head:
            if not data.strip():
                return
            self._in_body()
        data = plain(data)
        node = self.open[-1]
        if node.children:
            node.children[-1].tail = (node.children[-1].tail or "") + data
        else:
            node.text = (node.text or "") + data

    def handle_comment(self, data):
        node = _Node(None, {}, self.open[-1], "comment")
        node.text = plain(data)
        self.open[-1].children.append(node)


def parse(html: str) -> _Node | None:
    """The tree of a page; None if there is nothing in it."""
    if not html or not html.strip():
        return None
    builder = _Builder()
    try:
        builder.feed(marked(html))
        builder.close()
    except (AssertionError, ValueError):  # malformed declarations: what was read counts
        pass
    return builder.root


def rows(page_id, root: _Node, out: dict[str, list], raw: bool = True) -> None:
    """Appends the node table's rows of one page to the columns of out, in document order, without recursion."""
    tag_paths = out.get("tag_path")
    put = {name: column.append for name, column in out.items()}
    base, pos, nid = len(out["nid"]), 0, 0
    ends, end_pos = out["end_nid"], out.get("end_pos")
    stack = [(root, 0, (), (), (), None)]
    while stack:
        node, index, path, anc, tags, done = stack.pop()
        if done is not None:
            ends[base + done] = nid - 1
            if raw:
                end_pos[base + done] = pos
                pos += 1
            continue
        path = (*path, index)
        if raw:
            empty = node.kind == "element" and not node.children and node.text is None
            tail = escape(node.tail, quote=False) if node.tail else ""
            if node.kind == "comment":
                head, foot = f"<!--{node.text}-->", tail
            else:
                attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
                head = f"<{node.tag}{attrs}" + ("/>" if empty else ">" + (escape(node.text, quote=False) if node.text else ""))
                foot = ("" if empty else f"</{node.tag}>") + tail
            put["start_pos"](pos)
            put["end_pos"](pos)
            put["head"](head)
            put["foot"](foot)
            pos += 1
        put["page_id"](page_id)
        put["nid"](nid)
        put["parent_nid"](anc[-1] if anc else None)
        put["end_nid"](nid)
        put["level"](len(path))
        put["child_idx"](index)
        put["children"](len(node.children))
        put["kind"](node.kind)
        put["tag"](node.tag)
        put["text"](node.text)
        put["tail"](node.tail)
        put["xp_text"](node.text or (node.children[0].tail if node.children else None) or None)
        put["attrs"](list(node.attrs.items()))
        put["path"](path)
        put["anc"](anc)
        if tag_paths is not None:
            tags = (*tags, node.tag)
            tag_paths.append(tags)
        stack.append((node, index, path, anc, tags, nid))
        inside = (*anc, nid)
        nid += 1
        for i in range(len(node.children) - 1, -1, -1):
            stack.append((node.children[i], i, path, inside, tags, None))


def nodes(pages: DataFrame, html_col: str = "html", partitions: int | None = None, raw: bool = True, tag_path: bool = False) -> DataFrame:
    """The node table of pages (page_id, html): one row per element and comment, hash-partitioned by page.

    Pages are dealt out to `partitions` before the Python stage if given (a small file arrives as few partitions), and each
    page's rows are together after it, so that windows and groups by page need no further exchange. A null or blank
    page has no rows. raw=False neither makes nor moves the serialised pieces; tag_path=True adds the tags from the root down to
    the node itself, a comment's being null.
    """
    import pyarrow as pa

    types = {"attrs": pa.map_(pa.string(), pa.string()), "path": pa.list_(pa.int32()), "anc": pa.list_(pa.int32()), "tag_path": pa.list_(pa.string()), "page_id": pa.int64()}
    fields = [f for f in NODES.split(", ") if raw or f.split()[0] not in RAW] + ["tag_path array<string>"] * tag_path
    text = {"kind", "tag", "text", "tail", "xp_text", "head", "foot"}
    schema = pa.schema([(n, types.get(n, pa.string() if n in text else pa.int32())) for n in (f.split()[0] for f in fields)])

    def work(batches):
        fresh = lambda: {n: [] for n in schema.names}
        for batch in batches:
            found = fresh()
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                root = parse(html or "")
                if root is not None:
                    rows(page_id, root, found, raw)
                if len(found["nid"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(found, schema=schema)
                    found = fresh()
            if found["nid"]:
                yield pa.RecordBatch.from_pydict(found, schema=schema)

    from ..plans.code import ship

    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    if partitions:
        pages = pages.repartition(partitions)
    return pages.mapInArrow(work, ", ".join(fields)).repartition("page_id")
