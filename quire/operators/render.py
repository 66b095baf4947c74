"""Markdown for display: math delimiters, table tags, sections; and the preview of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import geometry

# Code that is left alone, math in brackets and in dollars, what makes a text LaTeX.
CODE = r"(?dms)^```.*?^```[ \t]*$|^~~~.*?^~~~[ \t]*$|`[^`\n]+`"
MATH, BLOCK, INLINE = r"(?s)\\\[(.+?)\\\]|\\\((.+?)\\\)", r"(?s)\\\[(.+?)\\\]", r"(?s)\\\((.+?)\\\)"
DOLLARS, DOLLAR = r"(?s)\$\$(.+?)\$\$", r"\$([^$\n]+?)\$"
LATEX, DIGITS = r"[\\^_{}]", r"^[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
#: Signs that later passes would take for delimiters stand for themselves under these noncharacters.
SIGNS, HIDDEN = "$\\^_{}", "".join(chr(0xFDD0 + k) for k in range(6))
# Table tags as they look when escaped, with any attributes up to 300 characters; spans as they look there.
TABLE = r"(?d)&lt;(/?)(table|thead|tbody|tr|th|td)(?=[\s/]|&gt;)((?:(?!&[lg]t;).){0,300}?)\s*/?&gt;"
SPAN = r"\s((?:colspan|rowspan)=)&quot;(\d{1,3})&quot;"


def _hidden(c: Column) -> Column:
    return F.translate(c, SIGNS, HIDDEN)


def math_normalized(text: Column) -> Column:
    """All math in dollars, display math on lines of its own: brackets become dollars, blank math goes, dollars that hold no math are escaped; code is left alone.

    Text in single dollars is math if it holds LaTeX, or is of at most 40 characters and begins with no digit. Code inside math stays as it is written; single dollars don't reach over display math.
    """

    def display(tex: Column) -> Column:
        return F.when(tex == "", "").otherwise(F.concat(F.lit("\n\n$$\n"), tex, F.lit("\n$$\n\n")))

    def single(m: Column) -> Column:
        tex = T.strip(F.substring(m, F.lit(2), F.length(m) - 2))
        math = tex.rlike(LATEX) | ((tex != "") & ~tex.rlike(DIGITS) & (F.length(tex) <= 40))
        return F.when(math, _hidden(F.concat(F.lit("$"), tex, F.lit("$")))).otherwise(m)

    inner = lambda m: T.strip(F.substring(m, F.lit(3), F.length(m) - 4))
    same = lambda p: p
    out = _rewritten(text, CODE, same, _hidden)
    out = _rewritten(out, DOLLARS, same, lambda m: _hidden(display(inner(m))))
    out = _rewritten(out, DOLLAR, same, single)
    out = F.replace(out, F.lit("$"), F.lit("\\$"))
    out = _rewritten(out, BLOCK, same, lambda m: display(inner(m)))
    out = _rewritten(out, INLINE, same, lambda m: F.when(inner(m) == "", "").otherwise(F.concat(F.lit("$"), inner(m), F.lit("$"))))
    return F.translate(out, HIDDEN, SIGNS)


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _rewritten(text: Column, pattern: str, piece: Callable[[Column], Column], mark: Callable[[Column], Column]) -> Column:
    """text with mark of each match of the pattern between piece of what lies around."""

    def put(t: Column) -> Column:
        marks = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), mark), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), marks, lambda p, m: F.concat(piece(p), m)), "")

    return T.let(text, put)


def with_math(text: Column) -> Column:
    """Escaped text in which math is spans."""

    def span(m: Column) -> Column:
        tex = T.strip(F.substring(m, F.lit(3), F.length(m) - 4))
        kind = F.when(m.startswith("\\["), "math-display").otherwise("math-inline")
        return F.when(tex == "", "").otherwise(F.concat(F.lit('<span class="'), kind, F.lit('">'), escape(tex), F.lit("</span>")))

    return _rewritten(text, MATH, escape, span)


def table_tags(escaped: Column) -> Column:
    """Escaped text in which table tags are tags again; of their attributes numeric spans in quotes stay, behind a blank."""

    def tag(m: Column) -> Column:
        attributes = F.regexp_extract(m, TABLE, 3)
        spans = F.zip_with(F.regexp_extract_all(attributes, F.lit(SPAN), F.lit(1)), F.regexp_extract_all(attributes, F.lit(SPAN), F.lit(2)), lambda k, v: F.concat(F.lit(" "), k, F.lit('"'), v, F.lit('"')))
        close = F.regexp_extract(m, TABLE, 1)
        return F.concat(F.lit("<"), close, F.regexp_extract(m, TABLE, 2), F.when(close == "", F.array_join(spans, "")).otherwise(""), F.lit(">"))

    return _rewritten(escaped, TABLE, lambda p: p, tag)


def tables_restored(text: Column) -> Column:
    return table_tags(escape(text))


FIGURE = r'<img src="([^"]+/images/([^"/]+))" alt="([^"]*)"\s*/?>'


def with_widths(html: Column, boxes: Column) -> Column:
    """html whose figures have the share of the page's width that boxes (a map of file names to x1, x2 and image_width) gives them; narrow ones are centred."""

    def tag(m: Column) -> Column:
        src, name, alt = (F.regexp_extract(m, FIGURE, k) for k in (1, 2, 3))
        box = F.try_element_at(boxes, name)
        share, centred = geometry.figure_width(box["x1"], box["x2"], F.nullif(box["image_width"], F.lit(0)))
        style = F.concat(F.lit("width:"), F.format_number(share * 100, 1), F.lit("%;height:auto;"), F.when(centred, "display:block;margin-left:auto;margin-right:auto;").otherwise(""))
        return F.coalesce(F.concat(F.lit('<img src="'), src, F.lit('" alt="'), alt, F.lit('" style="'), style, F.lit('">')), m)

    return _rewritten(html, FIGURE, lambda p: p, tag)


def sections(md: Column, separator: str) -> Column:
    """One section for each page."""
    pages = F.split(md, "\\Q" + separator + "\\E", -1)
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit('<section data-page="'), (i + 1).cast("string"), F.lit('">'), p, F.lit("</section>"))), "\n")


# Tags of a stream, labels of page furniture, what stands for an image, and the rule between pages.
DET = r"<\|det\|>\s*([A-Za-z_][A-Za-z0-9_-]*)\s*\[\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*\]\s*<\|/det\|>"
REF = r"<\|ref\|>([^<]{1,40})<\|/ref\|><\|det\|>\[\[?[0-9,\s\[\]]*\]\]?<\|/det\|>"
FURNITURE, IMAGE, RULE = ("page_number", "header", "footer", "footnote"), "> 🖼 그림 감지됨", "---"
MARK = "<PAGE>"


def label_key(label: Column) -> Column:
    """A label as it is compared: trimmed, in lower case, runs of white space and hyphens as one underscore."""
    return F.regexp_replace(F.lower(T.strip(label)), rf"(?:{T.WHITE}|-)+", "_")


def preview(raw: Column) -> Column:
    """A tagged stream as Markdown, a block for each tag: titles as headings on one line, images as a mark, page furniture left out, one rule between pages.

    What follows a det tag is its own text; what follows an image, a ref tag or a page's beginning is plain.
    """
    tag = f"{DET}|{REF}|{MARK}"

    def parts(t: Column, p: Column) -> Column:
        is_det = t.startswith("<|det|>")
        key = F.when(is_det, label_key(F.regexp_extract(t, DET, 1))).when(t.startswith("<|ref|>"), label_key(F.regexp_extract(t, REF, 1)))
        body = T.strip(F.regexp_replace(p, T.SPECIAL, ""))
        head = F.when(t == MARK, "\x00").when(key == "image", IMAGE)
        own = F.when(is_det & key.isin(*FURNITURE), "").when(is_det & (key == "title") & (body != ""), F.concat(F.lit("## "), F.regexp_replace(body, r"\s*\n+\s*", " "))).otherwise(body)
        return F.array(head, F.when(own != "", own))

    def ruled(found: Column) -> Column:
        # a rule where something stands before it that is no rule
        kept = F.filter(found, lambda p, i: (p != "\x00") | ((i > 0) & ~F.coalesce(F.get(found, i - 1), F.lit("\x00")).isin("\x00", RULE)))
        return F.transform(kept, lambda p: F.when(p == "\x00", RULE).otherwise(p))

    def ended(all_: Column) -> Column:
        n = F.size(all_)
        return F.array_join(F.when((n > 0) & (F.get(all_, n - 1) == RULE), F.slice(all_, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(all_), "\n\n")

    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(raw, F.lit(tag), F.lit(0)))
    found = F.array_compact(F.flatten(F.zip_with(heads, F.split(raw, tag, -1), parts)))
    return T.let(T.let(found, ruled), ended)
