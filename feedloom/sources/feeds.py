"""RSS and ATOM documents, also those that are no well-formed XML."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "url string, title string, language string, num_entries int, entries array<string>"

_PROLOGUE = re.compile(r"^\s*(?:\ufeff)?\s*(?:<\?xml.*?\?>)?\s*(?:<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>)?", re.S)
_FEED = re.compile(r"<(?:\w+:)?(?:rss|feed|RDF)[\s>]", re.I)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)(\w{2,32};)?")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"


def _mended(xml: str) -> str:
    """Named entities of HTML as letters, other bare ampersands escaped, control letters and what follows the feed left out."""
    letter = lambda m: escape(unescape("&" + m[1])) if m[1] and unescape("&" + m[1]) != "&" + m[1] else "&amp;" + (m[1] or "")
    out = _ENTITY.sub(letter, _CONTROL.sub("", xml))
    end = max((out.rfind(f"</{t}>") + len(t) + 3 for t in ("rss", "feed", "rdf:RDF", "RDF") if f"</{t}>" in out), default=len(out))
    return out[:end]


class _Balanced(HTMLParser):
    """Writes tags again so that each is closed; prefixes become parts of names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs, empty=False):
        name = re.sub(r"[^\w.-]", "_", tag.split(":")[-1])
        keep = "".join(f" {k}={quoteattr(v or '')}" for k, v in dict(attrs).items() if re.fullmatch(r"[a-z_][\w.-]*|xml:lang", k) and k != "xmlns")
        self.out.append(f"<{name}{keep}{'/' if empty else ''}>")
        if not empty:
            self.open.append(name)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        name = re.sub(r"[^\w.-]", "_", tag.split(":")[-1])
        while name in self.open:
            top = self.open.pop()
            self.out.append(f"</{top}>")
            if top == name:
                break

    def handle_data(self, data):
        if self.open:
            self.out.append(escape(data))


def _balanced(xml: str) -> str:
    parser = _Balanced()
    parser.feed(_CDATA.sub(lambda m: escape(m[1]), _CONTROL.sub("", xml)))
    parser.close()
    return "".join(parser.out) + "".join(f"</{t}>" for t in reversed(parser.open))


def _name(e) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def read(xml: str | None) -> tuple[str, str | None, int, list[str]] | None:
    """(title, language, number of entries, their titles) of a feed; None of anything else and of a feed without a title."""
    if not xml or not _FEED.search(xml):
        return None
    body = _PROLOGUE.sub("", xml, count=1)
    root = None
    for way in (lambda x: x, _mended, _balanced):
        try:
            root = ElementTree.fromstring(way(body))
            break
        except (ElementTree.ParseError, ValueError, AssertionError, RecursionError):
            continue
    if root is None or _name(root) not in ("rss", "feed", "rdf"):
        return None
    of = lambda e, name: [c for c in e if _name(c) == name]
    text = lambda es: next((t for t in ("".join(e.itertext()).strip() for e in es) if t), None)
    atom = _name(root) == "feed"
    channels = [root] if atom else of(root, "channel")
    items = of(root, "entry") if atom else [i for c in ([root] if _name(root) == "rdf" else channels) for i in of(c, "item")]
    title = text([t for c in channels for t in of(c, "title")])
    if title is None:
        return None
    language = next((v for k, v in root.attrib.items() if k in (_LANG, "lang")), None) if atom else text([t for c in channels for t in of(c, "language")])
    return title, language or None, len(items), [t.text for i in items for t in of(i, "title") if t.text]


def parse(docs: DataFrame) -> DataFrame:
    """(url, title, language, num_entries, entries) of feed documents (url, xml) that have a title.

    A document is read as XML; if it isn't well-formed, again with its entities mended, then with its tags balanced. What is
    no feed even then, null and empty documents have no row; none of them stops the job.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(url, *found) for url, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (found := read(xml))]
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["url", "title", "language", "num_entries", "entries"])

    from ..plans.code import ship

    ship(docs.sparkSession)
    return docs.select(F.col("url").cast("string").alias("url"), F.col("xml").cast("string").alias("xml")).mapInArrow(work, FIELDS)
