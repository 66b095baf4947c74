"""Row-local rules against plain restatements, identities and streams cut at any place."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import repetition, segment
from quire.streaming.detector import Detector, counting
from quire.streaming.pages import boxes_of
from tests.plain import LEFT, mask, unmask

TEXT = st.text(alphabet="ab $`\\()[]<>/1.#-|\n~:é=*_!", max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_mask_and_unmask_are_inverse(text):
    masked, held = mask(text)
    out, missing, twice = unmask(masked, held)
    if not LEFT.search(text) and not any(LEFT.search(v) for v in held.values()):
        assert (out, missing, twice) == (text, [], [])


@pytest.mark.parametrize("token, kind", [("$a+b$", "m"), ("$$x\ny$$", "m"), (r"\(x\)", "m"), (r"\[x\]", "m"), ("```a\nb```", "k"), ("`c`", "k"), ("![a](b.png)", "g"), ("<td>", "t"), ("https://a.b/c", "u"), ("x@y.org", "u"), ("10.1234/ab", "u"), ("[1, 2]", "c"), ("[3-5]", "c"), ("Figure 2", "f"), ("Sec. 3.1", "f")])
def test_each_kind_of_token(token, kind):
    masked, held = mask(f"see {token} here")
    assert held == {f"{kind}1": token} and masked.startswith(f'see <{kind}1 v="')


def test_unmask_reports():
    held = {"m1": "$a$", "c2": "[1]"}
    assert unmask('< m1 > and <m1 v="x"/>', held) == ("$a$ and $a$", ["c2"], ["m1"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# T", "text", "- item", "  more", "```", "| a | b |", "|---|---|", "> q", "<div>", "", "===", "---", "1. x", "## References", "* * *"]), max_size=25))
def test_segments_put_together_again(lines):
    md = "\n".join(lines)
    found = segment.units(md)
    assert segment.assemble(md, {u[0]: u[5] for u in found if segment.SEPARATOR not in u[5]}) == md
    marked = segment.assemble(md, {u[0]: "X" for u in found})
    assert marked.count("X") == len(found)
    for page in md.split(segment.SEPARATOR):
        spans = [(a, b) for _, _, a, b in segment.blocks(page)]
        assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_kinds_and_references():
    md = "Title\n=====\n\npara\nmore\n\n```\nx\n\ny\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- i\n\n  j\n- k\n\n> q\n\n<p>\nh\n\n## References\n\n[1] x\n\n### Sub\n\nz\n\n## Next\n\nend"
    found = segment.units(md)
    assert [u[1] for u in found] == ["heading", "paragraph", "fence", "table", "list", "blockquote", "html", "heading", "paragraph", "heading", "paragraph", "heading", "paragraph"]
    assert [u[6] for u in found] == [False] * 7 + [True] * 4 + [False] * 2
    pages = "# Acknowledgements\n\na\n\n---\n\nb\n\n## Bibliography ##\n\nc\n\n## Next\n\nd\n\n# End\n\ne"
    assert [(u[0], u[6]) for u in segment.units(pages)] == [("md:0:0", True), ("md:0:1", True), *((f"md:1:{n}", n < 3) for n in range(7))]


def plain_suffix(text, least=8000):
    n = len(text)
    if n < least:
        return text
    for p in range(1, 201):
        k = n
        while k > p and text[k - 1] == text[k - 1 - p]:
            k -= 1
        total = n - k + p
        if n - k and total // p >= 5 and total >= 100:
            return text[: k] + text[n - total % p :]
    return text


def test_suffix_repeats():
    rng = random.Random(2)
    for _ in range(60):
        unit = "".join(rng.choices("abc", k=rng.randint(1, 220)))
        text = "".join(rng.choices("abcd", k=rng.choice([100, 8000]))) + unit * rng.randint(1, 60) + unit[: rng.randint(0, len(unit))]
        assert repetition.without_suffix_repeats(text) == plain_suffix(text)


def test_tandem():
    assert repetition.tandem("intro\n" + "word, " * 700)[1] in ("word ,", ", word", "word,")
    assert repetition.tandem("1 2 " * 900) is None and repetition.tandem("a | " * 900) is None
    assert repetition.tandem("word, " * 700 + "\nshort") is None and repetition.tandem("abc " * 30) is None


LOOP = "item number {} of this long repeated line of text\n"


@pytest.mark.parametrize("size", [1, 7, 64, 511, 10**6])
@pytest.mark.parametrize(
    "text, reason",
    [("".join(LOOP.format(i) for i in range(80)), "line_repeat"), ("x" * 17_000, "page_char_limit"), ("a " + "".join(f"#{i}. " for i in range(30)), "rolling_repeat"), ("<PAGE>".join(["plain text\n"] * 40), ""), ("".join(f"{i} | {i * 7} | {i * 3}\n" for i in range(300)), ""), ("y" * 9000 + "<PAGE>" + "z" * 9000, "")],
)
def test_detector_on_any_delta_size(text, reason, size):
    own = Detector()
    for i in range(0, len(text), size):
        own = Detector.of(own.state())
        if own.feed(text[i : i + size]):
            break
    own.feed("", end=True) if not own.reason else None
    assert own.reason == reason


def test_flood():
    own = Detector(expected=3)
    assert own.feed("<PAGE>a" * 7) and own.reason == "page_flood"


def test_boxes_once_however_cut():
    text = "a<|det|>text [1, 2, 30, 40]<|/det|>b<|det|>image [5,6,7,2000, 9,9,9,9]<|/det|>c"
    want, _ = boxes_of(text)
    for size in (1, 3, 8, 50):
        held, got = "", []
        for i in range(0, len(text), size):
            found, held = boxes_of(held + text[i : i + size])
            got += found
        assert got == want == [("text", [1, 2, 30, 40]), ("image", [5, 6, 7, 999])]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#0123456789. \nxé<|det>/", max_size=80), st.integers(0, 40), st.sampled_from(["", " ", "abc "]))
def test_counting_against_every_run(noise, n, between):
    text = noise + "".join(f"#{i}. {between}" for i in range(3, 3 + n))
    marks = [(m.start(), m.end(), int(m[1])) for m in re.finditer(repetition.COUNTER, text)]
    want = False
    for a in range(len(marks)):
        b = a
        while b + 1 < len(marks) and marks[b + 1][2] == marks[b][2] + 1:
            b += 1
        span = text[marks[a][0] : marks[b][1]]
        if (a == 0 or marks[a - 1][2] + 1 != marks[a][2]) and b - a + 1 >= 20 and sum(c.isalpha() for c in span) <= 0.05 * len(span):
            want = True
    assert counting(text) == want


def test_end_of_a_stream_is_seen():
    own = Detector()
    own.feed("".join(LOOP.format(i) for i in range(63)) + LOOP.format(63).rstrip("\n"))
    assert not own.reason and own.feed("", end=True) and own.reason == "line_repeat"
    own = Detector()
    assert not own.count(6000) and own.count(200) and own.reason == "page_token_limit"
    own = Detector()
    own.count(6000), own.feed("a<PAGE>b")
    assert not own.count(200)
