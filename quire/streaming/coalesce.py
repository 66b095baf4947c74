"""Deltas of a few characters gathered into events for readers, and the page that each event ends in."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.operators.render import MARK
from quire.streaming.ordered import by_key

# An event goes out with so many characters, or after so many milliseconds without one.
FLUSH_CHARS, FLUSH_MS = 256, 100


def marker_begun(text: str) -> int:
    """How many characters at the end of text may be the beginning of a page marker."""
    return next((k for k in range(min(len(MARK) - 1, len(text)), 0, -1) if text.endswith(MARK[:k])), 0)


def _event(key: int, text: str, page: int, number: int, why: str) -> tuple:
    return key, number, text, page + text.count(MARK), why


def _events(key: int, own: tuple, rows: list[tuple] | None, now: int) -> tuple[tuple, list[tuple]]:
    """Its state: the text that waits, the pages and events before it, and when it goes out by the clock, 0 where nothing waits for that.

    An event never ends inside a marker: what may be its beginning waits for the rest, through timers as well, until the
    text ends. A page is counted in the event that its marker goes out with.
    """
    text, page, number, due = own
    if rows is None:
        whole = len(text) - marker_begun(text)
        out = [_event(key, text[:whole], page, number, "time")] if whole else []
        return (text[whole:], out[0][3] if out else page, number + len(out), 0), out
    out, ended = [], False
    for delta, last in rows:
        text, ended = text + (delta or ""), ended or bool(last)
        whole = len(text) - (0 if ended else marker_begun(text))
        if whole and (len(text) >= FLUSH_CHARS or ended):
            out.append(_event(key, text[:whole], page, number, "end" if ended else "size"))
            text, page, number = text[whole:], out[-1][3], number + 1
    if ended:
        return NEW, out
    due = 0 if out else due
    return (text, page, number, due or (now + FLUSH_MS if text else 0)), out


NEW = ("", 0, 0, 0)


def coalesced(deltas: DataFrame) -> DataFrame:
    """A streaming frame (doc_id, seq, delta, last) to doc_id, event, text, page, why: numbered events whose texts in order are the deltas'."""
    return by_key(deltas, ("delta", "last"), "doc_id long, event int, text string, page int, why string", "text string, page int, number int, due long", NEW, _events, timed=True)
