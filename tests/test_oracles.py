import re

import pytest

from quire import queries
from quire.operators import repetition, segment
from quire.plans import lift
from quire.streaming.detector import Detector
from tests.oracle import compare
from tests.test_plain import plain_suffix

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF) >= 0


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_suffixes_and_tandems_of_whole_texts(spark):
    texts = texts_of(spark)
    got = {r.doc_id: r.text for r in queries.QUERIES["repeat_suffix_cleanup"](spark, SF).collect()}
    assert got == {d: plain_suffix(t + (t[-50:] * 200 if d % 2 == 0 else "")) for d, t in texts.items()}
    tail = {0: lambda t: t[-30:] * 150, 1: lambda t: "\n" + t[:20] * 3, 2: lambda t: ""}
    got = {r.doc_id: (r.repeats, r.unit) for r in queries.QUERIES["tandem_repeat"](spark, SF).collect()}
    found = {d: plain_tandem((t + tail[d % 3](t))[-4096:]) for d, t in texts.items()}
    assert got == found and {bool(n) for n, _ in found.values()} == {True, False}


def plain_tandem(text):
    """Every unit from the end, atom by atom."""
    atoms = re.findall(r"\w+|[^\w\s]", re.sub(repetition.LAYOUT, "", text).rpartition("\n")[2])
    for size in range(1, 65):
        unit, n = atoms[-size:], 0
        while len(atoms) >= (n + 1) * size and atoms[len(atoms) - (n + 1) * size : len(atoms) - n * size] == unit:
            n += 1
        said = "".join(unit)
        word = any(c.isalnum() for c in said) and (any(c.isalpha() for c in said) or any(a != "_" and not a.isalnum() for a in unit))
        if n >= 24 and word and "|" not in unit and len(" ".join(atoms[len(atoms) - n * size :])) >= 3072:
            return n, " ".join(unit)[:160]
    return 0, None


def test_stream_detector_against_one_pass(spark):
    got = {r.doc_id: (r.n_chars, r.reason) for r in queries.QUERIES["stream_detector"](spark, SF).collect()}
    want = {}
    for d, text in texts_of(spark).items():
        text = text.replace(". ", ".<PAGE>") if d % 7 == 3 else text
        own = Detector(2 if d % 7 == 3 else 0)
        for at in range(0, len(text), 256):
            delta = text[at : at + 256]
            own.count(len(delta) * 2 if d % 5 == 1 else 0)
            own.feed(delta, end=at + 256 >= len(text))
        if text:
            want[d] = (own.chars, own.reason)
            if own.reason == "page_flood":
                assert text.count("<PAGE>") > 4
            if own.reason == "page_char_limit":
                assert max(map(len, text.split("<PAGE>"))) > 16_384
            if not own.reason:  # nothing that a plain look at the whole text would find
                assert max(map(len, text.split("<PAGE>"))) <= 16_384 and not (d % 7 == 3 and text.count("<PAGE>") > 4)
                assert d % 5 != 1 or max(map(len, text.split("<PAGE>"))) * 2 <= 6_144 + 1_024
    assert got == want and {"page_char_limit", "page_flood", "page_token_limit", ""} <= {r for _, r in want.values()}


def test_greedy_overlap_of_all_pages(spark):
    def area(b):
        return max(0, b[2] - b[0]) * max(0, b[3] - b[1])

    rows = lift.box(lift.lines(spark, SF)).collect()
    pages = {}
    for r in sorted(rows, key=lambda r: r.k):
        pages.setdefault((r.doc_id, r.page), []).append(r.bbox)
    want = {}
    for key, truth in pages.items():
        left, total = [[b[0] + i, b[1], b[2] + i, b[3] + i] for i, b in enumerate(truth)], 0.0
        for g in truth:
            best, at = 0.0, -1
            for i, f in enumerate(left):
                both = area([max(f[0], g[0]), max(f[1], g[1]), min(f[2], g[2]), min(f[3], g[3])])
                score = both / (area(f) + area(g) - both)
                if score > best:
                    best, at = score, i
            total += best
            if at >= 0:
                left.pop(at)
        want[key] = total / len(truth)
    got = {(r.doc_id, r.page): r.iou for r in queries.QUERIES["greedy_iou"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.0005 + 1e-9 for k in want)


def test_units_of_documents_put_together_again(spark):
    rows = queries.QUERIES["segment_units"](spark, SF).collect()
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"segment_units", "tandem_repeat", "greedy_iou", "stream_detector"}  # each has a test here
    assert rows and all(r.unit_id.split(":")[:2] == ["md", str(r.page)] and r.src.count("\n") == r.behind - r.first - 1 for r in rows)


def test_units_are_the_blocks_between_blank_lines(spark):
    """Of pages of plain paragraphs, by a second look: runs of lines that aren't blank."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "concat('P ', regexp_replace(text, '\\n', '\\n\\nP ')) as text")
    got = {}
    for r in segment.segment(docs).collect():
        got.setdefault(r.doc_id, []).append((r.unit_id, r.kind, r.src))
    for r in docs.collect():
        assert got[r.doc_id] == [(f"md:0:{n}", "paragraph", x) for n, x in enumerate(re.split(r"\n\n", r.text))]
