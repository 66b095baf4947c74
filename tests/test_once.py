"""What is worked out once a row, however often it is named, and gives what it gave."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evaluate, glossary, layout, masking, repetition


def said(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.debug.maxToStringFields")


def test_sizes_read_a_text_once(spark):
    df = spark.createDataFrame([([1, 2, 300, 400], "Ab <b>é</b> 가나 x" * 3), ([1, 2, 300, 400], "plain words"), ([1, 2, 300, 400], " "), ([1, 2], "x"), ([1, 2, 300, 400], None)], "bbox array<int>, content string")
    out = df.select(layout.font_size(F.col("bbox"), F.col("content"), F.lit(1.414)).alias("s"))
    assert said(out).count("<[^>]+>") == 1
    assert [r.s is None for r in out.collect()] == [False, False, True, True, True]


def test_rare_units_are_told_by_plain_signs(spark):
    """Units without a sign of Hangul, identifiers or numbered entries are not counted, stripped and cut for them; entries of one word need no pattern."""
    cases = {"Plain words": "", " \x85\n": "non-linguistic", "\x1c[1] A x.\n[2] B y.": "references", "a\n [1] pp. 3": "", "한국어 텍스트 abc": "already-korean", "한국어 text": "", "arXiv:2504.19874v1\narXiv:2504.19874 ": "identifier", "see arXiv:2504.19874v1": "", None: ""}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(masking.skip_reason(F.col("t"), masking.residual_text(F.col("t")))).collect()] == list(cases.values())
    rows, some = glossary.among(spark.createDataFrame([("The de  la",), ("\u0130n IN",), ("\u0130n",), ("_in",)], "t string"), spark.createDataFrame([("the", "x", "B"), (" in ", "IN", "A"), ("i", "y", "A"), ("de la", "z", "B")], "src string, ko string, policy string"))
    told = glossary.entries(spark.createDataFrame([("the", "x", "B"), ("C++", "y", "A"), ("\u0130n", "z", "A")], "src string, ko string, policy string"))
    assert [r.alone for r in told.orderBy("src").collect()] == [False, True, False]
    assert [r[0] for r in rows.select(glossary.occurring(F.col("t"), some)["src"]).collect()] == [["the", "de la"], [" in "], [], []]


def test_names_are_looked_for_once(spark):
    docs = spark.createDataFrame([(1, "The GPT and the GPT2, _GPT and éGPT, CNN\nTHE WHOLE LINE SHOUTS")], "doc_id long, text string")
    judged = spark.createDataFrame([(1, 1, "cnns", "CNN", "A"), (1, 2, "models", "M", "B")], "doc_id long, pos int, src string, ko string, policy string")
    out = glossary.built(docs, spark.createDataFrame([], "src string, ko string, policy string"), judged)
    assert "regexp_extract_all" not in said(out)
    assert sorted(map(tuple, out.collect())) == [(1, "cnn", "CNN", "A"), (1, "gpt", "GPT", "A"), (1, "gpt2", "GPT2", "A"), (1, "models", "M", "B")]


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_without_what_both_begin_and_end_with(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choices("abé가", k=rng.randint(0, n)))
    rows = [(a + text(4) + c, a + text(4) + c) for a, c in ((text(12), text(12)) for _ in range(150))] + [("", ""), ("aa", "aaa"), ("aba", "aa"), ("x" * 40, "x" * 40), ("", "ab")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.d for r in df.select(evaluate.edit_distance(F.col("a"), F.col("b"), 40).alias("d")).collect()] == [plain(a, b) for a, b in rows]
    assert spark.range(1).select(evaluate.edit_distance(F.lit(None).cast("string"), F.lit("a"), 40)).first()[0] is None


def test_metrics_are_of_whole_texts(spark):
    rng = random.Random(3)
    own = "".join(rng.choices("abcdé가 ", k=25_000)).strip()
    far = "".join(rng.choices("abcdé가 ", k=5_000))
    rows = [(own, own + "xyz", 3), (own[:1000] + "x" + own[1001:24_000] + "yy" + own[24_002:], own, 3), (own[:2_000], far[:900], plain(own[:2_000], far[:900])), (own * 3 + "x", "y" + own * 3, 2), ("", own, len(own))]
    df = spark.createDataFrame(rows, "a string, b string, d int").repartition(4)
    assert all(evaluate.distance(x, y, k) == plain(x, y) for k in (1, 3, 64) for x, y in ((own[n : n + 40], own[2 * n : 2 * n + 33]) for n in range(60)))
    assert all(r.d == r.e for r in df.select("d", evaluate.edit_distance(F.col("a"), F.col("b")).alias("e")).collect())
    a, b = "a b" * 10_000, "a b" * 10_000 + "cc"
    r = spark.createDataFrame([(a, b)], "a string, b string").select(*evaluate.ground_truth(F.col("a"), F.col("b")), *[c.alias(n) for n, c in evaluate.truth_metrics(F.col("a"), F.col("b")).items() if n in ("distance", "cer")]).first()
    assert tuple(r) == (2, len(b), round(2 / len(b), 4), round(2 / len(b), 4)) and r.cer > 0


def test_bans_read_a_sequence_once(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2],), ([1],), ([],), ([1, 2],), (None,)], "s array<int>")
    out = df.select(repetition.ngram_bans(F.transform("s", lambda x: x + 7), 3, 40).alias("b"))
    assert [r.b for r in out.collect()] == [[10], [], [], [], []]
    assert said(out).count("+ 7") == 1


def test_numbers_of_a_box_are_read_once(spark):
    df = spark.createDataFrame([("[[1, 2, 3, 4], [5, 6, 7, 8], 9]",), ("1 2",), (None,)], "t string")
    out = df.select(T.quads(F.col("t")).alias("q"))
    assert said(out).count("regexp_extract_all") == 1
    assert [r.q for r in out.collect()] == [[[1, 2, 3, 4], [5, 6, 7, 8]], [], []]
