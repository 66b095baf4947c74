"""Page progress and boxes out of a stream of deltas."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from quire.streaming.ordered import Ordered, by_key

_DET = re.compile(r"<\|det\|>\s*([A-Za-z_][\w-]*)\s*\[([^\]]+)\]\s*<\|/det\|>")
HOLD = 1200


def boxes_of(text: str) -> tuple[list[tuple[str, list[int]]], str]:
    """(label, box) of each whole tag, clamped and not degenerate, and what must wait for the next delta."""
    out, end = [], 0
    for m in _DET.finditer(text):
        end = m.end()
        numbers = [min(999, int(n)) for n in re.findall(r"\d+", m[2])]
        for i in range(0, len(numbers) - 3, 4):
            x1, y1, x2, y2 = numbers[i : i + 4]
            if x2 > x1 and y2 > y1:
                out.append((m[1].lower(), [x1, y1, x2, y2]))
    rest = text[end:]
    start = rest.rfind("<|det|>")
    if start < 0:
        keep = next((n for n in range(6, 0, -1) if rest.endswith("<|det|>"[:n])), 0)
        return out, rest[len(rest) - keep :]
    return out, rest[start:][:HOLD]


def _boxes(key: int, own: tuple, rows: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
    """Its state: the text that waits for the end of its tag, and how many boxes came before."""
    (held, n), out = own, []
    for (delta,) in rows:
        found, held = boxes_of(held + delta)
        for label, box in found:
            out.append((key, n, label, ",".join(map(str, box))))
            n += 1
    return (held, n), out


def stream_boxes(deltas: DataFrame) -> DataFrame:
    """(doc_id, seq, delta) to (doc_id, n, label, box): each box once, however tags are cut."""
    return by_key(deltas, ("delta",), "doc_id long, n int, label string, box string", "held string, n int", ("", 0), _boxes)


class Progress(Ordered):
    """State: the page, and whether its announcement still waits for its marker."""

    def __init__(self, total: int):
        self.total = total

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.at = handle.getValueState("at", "page int, fresh boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ready = self.in_order(rows)
        page, fresh = self.told(self.at, (0, False))
        for row in ready:
            if row["kind"] == "announce":
                fresh = row["page"] > page
                page = max(page, min(int(row["page"]), self.total))
            elif row["kind"] == "marker":
                page, fresh = (page if fresh else min(page + 1, self.total)), False
        self.at.update((page, fresh))
        yield pd.DataFrame({"doc_id": [key[0]], "page": [page]})


def progress(events: DataFrame, total: int) -> DataFrame:
    """(doc_id, seq, kind, page) to (doc_id, page): an announced page or a marker moves on, never back and not past total; the first marker behind an announcement is that page's own."""
    return events.groupBy("doc_id").transformWithStateInPandas(Progress(total), "doc_id long, page int", "Update", "None")


def deltas_of(docs: DataFrame, width: int = 256) -> DataFrame:
    """doc_id, seq, delta, last: texts in slices of a width, cut once each; the last slice says so."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    rows = docs.filter(F.length("text") > 0).select("doc_id", cut.alias("parts"))
    return rows.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("seq", "delta")).select("doc_id", "seq", "delta", (F.col("seq") == F.col("n") - 1).alias("last"))
