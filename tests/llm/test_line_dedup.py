import random
import re

from quire.llm import line_dedup as ld


def words(line):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), line.encode()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(rows, min_words):
    """Texts without the lines that have an earlier duplicate; ids are distinct."""
    seen, out = [], {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[d] = None
            continue
        keep = []
        for line in text.split("\n"):
            w = words(line)
            gone = any(w == v or (max(len(w), len(v)) >= min_words and abs(len(w) - len(v)) < 2 and distance(w, v) < 2) for v in seen)
            if not w or not gone:
                keep.append(line)
            if w:
                seen.append(w)
        out[d] = "\n".join(keep)
    return out


def test_against_the_plain_rule(spark):
    rng = random.Random(6)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 5, 6, 7, 12, 40]))] for _ in range(25)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(i, rng.choice("abcdefgh"))
            elif w:
                i = min(i, len(w) - 1)
                w[i : i + 1] = [] if kind == 1 else [rng.choice("ABxyz")]
        return rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n \n"), (None, "first of all lines that there are in here now\nx"), (503, "first of all lines that there are in here\nX"), (504, "é " * 300 + "a"), (505, "é " * 300 + "b\nÉ")]
    docs = spark.createDataFrame([(d, t, "k", 7, 1, "x") for d, t in rows], "doc_id long, text string, key string, n_lines int, kept_lines int, quire_key string").repartition(4)
    out = ld.line_dedup(docs, min_words=6)
    assert out.columns == ["doc_id", "text", "key", "kept_lines", "quire_key", "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert {(r.key, r.kept_lines, r.quire_key) for r in got.values()} == {("k", 1, "x")}
    want = plain(rows, 6)
    assert {d: r.text for d, r in got.items()} == want
    for d, t in rows:
        assert got[d].n_lines == (0 if t is None else t.count("\n") + 1)
        assert got[d].n_removed == (0 if t is None else got[d].n_lines - (want[d].count("\n") + 1 if want[d] or got[d].n_lines > got[d].n_removed else 0))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (1, "a b\nc"), (2, "c\nd")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ld.line_dedup(docs).collect()) == [(1, "a b\nc"), (1, "a b\nc"), (2, "d")]
    assert ld.line_dedup(docs.limit(0)).count() == 0


def test_one_edit_is_the_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(2))
        assert ld.one_edit(a, b) == (distance(a, b) < 2)


def test_null_ids_are_documents_of_their_own(spark):
    texts = ["first line\nonly here", "another one\nfirst line", "third\nmore\nfirst line"]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(4, "only here\nlast")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in ld.line_dedup(docs).collect()]
    lines = [x for _, t in got for x in t.split("\n")]
    assert sorted(lines) == sorted({"first line", "only here", "another one", "third", "more", "last"})
    assert (4, "last") in got and len(got) == 4


def test_very_long_texts(spark):
    """A line of 40,000 words and a text of 20,000 lines, each with a near copy."""
    rng = random.Random(2)
    wide = [str(rng.randrange(10**6)) for _ in range(40_000)]
    tall = [" ".join(str(rng.randrange(10**4)) for _ in range(3)) for _ in range(20_000)]
    rows = [(1, " ".join(wide)), (2, " ".join([*wide[:777], "new", *wide[778:]]) + "\nown"), (3, "\n".join(tall)), (4, "\n".join(tall[::-1]) + "\nlast one of all")]
    got = {r.doc_id: r.text for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "own" and got[4] == "last one of all"
    assert got[3] == "\n".join(dict.fromkeys(tall))
