"""The preview of a stream page by page: a finished page is rendered once, the unfinished one as far as its tags are whole."""

from __future__ import annotations

import re
from pyspark.sql import DataFrame

from quire.functions import text as T
from quire.operators import render
from quire.streaming.ordered import by_key

# The separators of Unicode, which Python's patterns can't name.
_SEPARATORS = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WHITE = T.WHITE.replace(r"\p{Z}", _SEPARATORS)
_ENDS = re.compile(f"^{_WHITE}+|{_WHITE}+\\Z")
_TAG, _SPECIAL, _BREAKS, _JOINTS = re.compile(f"(?:{render.DET})|(?:{render.REF})|(?:{render.MARK})"), re.compile(T.SPECIAL), re.compile(r"\s*\n+\s*"), re.compile(f"(?:{_WHITE}|-)+")
# What a delta may cut, and how many characters are held back for a tag that never ends.
LITERALS, HOLD = ("<PAGE>", "<|ref|>", "<|/ref|>", "<|det|>", "<|/det|>"), 2000
_CUT = "|".join(sorted({re.escape(x[:k]) for x in LITERALS for k in range(1, len(x))}, key=len, reverse=True))
_UNFINISHED = re.compile(rf"(?s)<\|(ref|det)\|>(?!.*<\|\1\|>)(?!.*<\|/det\|>)|<\|(?!.*<\|)(?!.*\|>)|(?:{_CUT})\Z")


def unfinished(text: str, most: int = HOLD) -> int:
    """Where what may be an unfinished tag or marker at the end of text begins; its length if there is none, or one longer than most."""
    m = _UNFINISHED.search(text)
    return len(text) if m is None or len(text) - m.start() > most else m.start()


def shown(raw: str, final: bool) -> str:
    """render.preview of one page; while it isn't final, of what is whole."""
    text, parts, label, at = raw if final else raw[: unfinished(raw)], [], None, 0

    def put(body: str) -> None:
        body = _ENDS.sub("", _SPECIAL.sub("", body))
        if body and label not in render.FURNITURE:
            parts.append("## " + _BREAKS.sub(" ", body) if label == "title" else body)

    for m in _TAG.finditer(text):
        put(text[at : m.start()])
        key = _JOINTS.sub("_", _ENDS.sub("", m[1] or m[2] or "").lower())
        label, at = (key if m[1] and key != "image" else None), m.end()
        if key == "image":
            parts.append(render.IMAGE)
    put(text[at:])
    return "\n\n".join(parts)


def _pages(key: int, own: tuple, rows: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
    """Its state: of the unfinished page the text, its number, whether something was shown before, and what was last shown of it."""
    raw, page, before, last_md, last_ruled = own
    out, ended = [], any(last for _, last in rows)
    *finished, raw = (raw + "".join(delta or "" for delta, _ in rows)).split(render.MARK)
    for text in [*finished, raw] if ended else finished:
        md = shown(text, True)
        out.append((key, "page", page, md, bool(md) and before))
        page, before, last_md, last_ruled = page + 1, before or bool(md), "", False
    if ended:
        return NEW, out
    md = shown(raw, False)
    ruled = bool(md) and before
    if (md, ruled) != (last_md, last_ruled):
        out.append((key, "tail", page, md, ruled))
    return (raw, page, before, md, ruled), out


NEW = ("", 0, False, "", False)


def preview(deltas: DataFrame) -> DataFrame:
    """A streaming frame (doc_id, seq, delta, last) to doc_id, kind, page, md, ruled: each page once when it is finished, the tail whenever what it shows has changed.

    ruled says whether a rule stands before it: something was shown before, and it shows something. Behind the last delta the tail is a page.
    """
    return by_key(deltas, ("delta", "last"), "doc_id long, kind string, page int, md string, ruled boolean", "raw string, page int, before boolean, md string, ruled boolean", NEW, _pages)
