"""Odd rows through every stage of the pipeline: nulls in any column, empty and very long texts, ties, repeated rows, an empty table, clashing names."""

import corpus_pipeline as cp
import pytest

SF = "/root/testdata/sf0.001"
#: Names that the stages use for columns of their own.
CLASHING = ("score", "flagged", "n_lines", "n_removed", "kept_lines", "quire_key", "gone", "key", "component_id", "block", "slot", "seq", "on_target", "ids", "n_tokens", "quire_rest", "before", "its", "size", "c0")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[f"{c}-{k}" for c in CLASHING]) for k, r in enumerate(rows)], SCHEMA)


def odd_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    prose = " ".join(f"p{i}" for i in range(90))
    return [
        (1, None, "en", "src1"),
        (2, "", None, "src1"),
        (3, " \n\t", "en", None),
        (None, prose, "de", "src2"),
        (None, None, None, None),
        (4, long, "en", "src0"),
        (5, "a line that stands in two documents at once\nown words of five", "en", "src0"),
        (6, "a line that stands in two documents at once\nown words of six", "en", "src0"),
        (7, "twice", "en", "src3"),
        (7, "twice", "en", "src3"),
        (8, " ".join(f"q{i}" for i in range(90)), "xx", "src3"),
    ]


def values(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_empty_tables(spark, name, stage):
    docs = frame(spark, odd_rows()).limit(0)
    out = stage(spark, docs, SF)
    assert out.count() == 0 and (stage is cp.encode or out.columns == docs.columns)


@pytest.mark.parametrize("stage", [cp.drop_toxic, cp.drop_lines, cp.drop_near_duplicates, cp.mix_sources])
def test_other_columns_come_through_as_they_are(spark, stage):
    docs = frame(spark, odd_rows()).repartition(3)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    before = {tuple(r[c] for c in CLASHING) for r in docs.collect()}
    got = [tuple(r[c] for c in CLASHING) for r in out.collect()]
    assert set(got) <= before and len(set(got)) == len(got)
    if stage is cp.mix_sources:
        assert values(tuple(r) for r in out.collect()) == values(tuple(r) for r in docs.collect())


def test_lines(spark):
    got = {r.score: (r.text, r.n_chars) for r in cp.drop_lines(spark, frame(spark, odd_rows()), SF).collect()}
    rows = odd_rows()
    assert got["score-7"] == ("own words of six", 16)
    for k, r in enumerate(rows):
        if k != 7:
            assert got[f"score-{k}"] == (r[1], None if r[1] is None else len(r[1]))


def test_near_duplicates(spark):
    rows = odd_rows()
    rows += [(9, rows[5][1] + " tail", "en", "src0"), (None, rows[3][1], "fr", "src2"), (8, " ".join(f"q{i}" for i in range(90)), "xx", "src3"), (10, " ".join(f"q{i}" for i in range(1, 90)), "xx", "src3")]
    got = {r.score for r in cp.drop_near_duplicates(spark, frame(spark, rows), SF).collect()}
    gone = {f"score-{k}" for k in range(len(rows))} - got
    assert gone - {"score-3", "score-12"} == {"score-7", "score-11", "score-14"} and len(gone) == 4  # six and five differ in one word of fourteen


def test_encoding(spark):
    rows = odd_rows()
    out = cp.encode(spark, frame(spark, rows), SF).collect()
    assert out[0].__fields__ == ["doc_id", "n_tokens", "ids", "slot", "seq", "on_target"]
    assert sorted(r.doc_id or 0 for r in out) == sorted(r[0] or 0 for r in rows)
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id: r.n_tokens for r in out if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert len({(r.slot, r.seq, r.doc_id) for r in out}) == len(out)
