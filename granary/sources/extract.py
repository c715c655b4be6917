"""Text of files by type: plain, HTML, DOCX, and PDF through a reader that may be given."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import BLANK, col

# Fixed value: the elements of HTML, obsolete ones included.
ELEMENTS = (
    "html|head|body|title|base|link|meta|style|script|noscript|template|slot|address|article|aside|footer|header|h[1-6]|hgroup|main|nav"
    "|section|search|blockquote|dd|div|dl|dt|figcaption|figure|hr|li|menu|ol|p|pre|ul|a|abbr|acronym|b|bdi|bdo|big|br|cite|code|data|dfn|em"
    "|font|i|kbd|mark|nobr|q|rp|rt|ruby|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr|area|audio|img|map|track|video|embed"
    "|iframe|frame|frameset|noframes|object|param|picture|source|svg|math|canvas|applet|del|ins|caption|col|colgroup|table|tbody|td|tfoot"
    "|th|thead|tr|button|datalist|fieldset|form|input|label|legend|meter|optgroup|option|output|progress|select|textarea|details|dialog"
    "|summary|center|dir|marquee"
)
# comments and an XML declaration may stand before the first element
_HTML = f"(?i)^[{BLANK}]*(?:<(?:!--(?s:.*?)--|\\?(?s:.*?)\\?)>[{BLANK}]*)*+<(?:!doctype[{BLANK}]+html|(?:{ELEMENTS})(?=[{BLANK}/>]))"
_SKIPPED = {"script", "style", "head", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "header", "footer", "main", "body"}
_MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_"}
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipped, self.pre, self.lists, self.links = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n\n" if len(self.lists) == 1 else "\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "    " * (len(self.lists) - 1) + (f"{kind[1]}.  " if kind[0] == "ol" else "*   "))
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in _MARKS:
            self.out.append(_MARKS[tag])
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("" if self.lists else "\n\n")
        elif tag == "a":
            href = self.links.pop() if self.links else None
            self.out.append(f"]({href})" if href else "")
        elif tag in _MARKS:
            self.out.append(_MARKS[tag])
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skipped:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(text: str | None) -> str | None:
    """Headings with #, fenced code, lists, links; scripts and styles left out."""
    if text is None:
        return None
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    parts = re.split(r"(```\n.*?\n```)", "".join(parser.out), flags=re.S)
    tidy = [p if p.startswith("```") else re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^ (?! *[*\d])|(?<! ) $", "", p)) for p in parts]
    return re.sub(r"\n{3,}", "\n\n", "".join(tidy)).strip()


def docx_text(content: bytes | None) -> str | None:
    """The paragraphs of a document, two line ends after each; anything unreadable gives None."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            root = ElementTree.fromstring(parts.read("word/document.xml"))
    except Exception:
        return None
    lines = []
    for paragraph in root.iter(f"{_WORD_NS}p"):
        runs = (
            x.text or "" if x.tag == f"{_WORD_NS}t" else "\t" if x.tag == f"{_WORD_NS}tab" else "\n" if x.tag == f"{_WORD_NS}br" else ""
            for x in paragraph.iter()
        )
        lines.append("".join(runs))
    return "".join(line + "\n\n" for line in lines) or None


def is_html(text: Column | str) -> Column:
    """Whether a text is an HTML document or a piece of one: it opens with a doctype or an element."""
    return col(text).rlike(_HTML)


def to_markdown(text: Column) -> Column:
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(html_to_markdown, na_action="ignore")

    return convert(text)


def with_text(files: DataFrame, pdf_reader: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """Adds ``text`` to (path, content) by the path's type; what cannot be read is null.

    There is no PDF reader here: give one as ``pdf_reader``, or such files have no text.
    """

    def guarded(reader: Callable[[bytes], str | None]):
        @F.pandas_udf("string")
        def read(contents: pd.Series) -> pd.Series:
            def one(content):
                try:
                    return reader(bytes(content)) or None
                except Exception:
                    return None

            return contents.map(one, na_action="ignore")

        return read

    kind = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    plain = F.decode("content", "UTF-8")
    return files.withColumn(
        "text",
        F.when(kind == ".pdf", guarded(pdf_reader)(F.col("content")) if pdf_reader else F.lit(None).cast("string"))
        .when(kind == ".docx", guarded(docx_text)(F.col("content")))
        .when(kind.isin(".html", ".htm"), to_markdown(plain))
        .otherwise(plain),
    )
