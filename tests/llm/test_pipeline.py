import os

import corpus_pipeline as cp
import public_tokenizers
import sentencepiece as library
from quire.llm import queries, toxicity
from quire.llm.line_dedup import MIN_WORDS
from tests.llm import test_line_dedup, test_mixing, test_ngram_join

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_rules(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = cp.drop_toxic(spark, docs, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), eligible=queries.remainder() != 2)
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d for d, r in rows.items() if model.scores([r.text.encode()])[0] < model.thresholds.get(r.lang, model.threshold)}
    assert kept.columns == docs.columns and len(ids) > len(rows) * 2 // 3

    lined = cp.drop_lines(spark, docs, SF)
    want = test_line_dedup.plain([(d, r.text) for d, r in rows.items()], MIN_WORDS)
    got = {r.doc_id: r for r in lined.collect()}
    assert {d: r.text for d, r in got.items()} == {d: t for d, t in want.items() if t.strip() or t == rows[d].text}
    assert all(r.n_chars == len(r.text) for r in got.values()) and lined.columns == docs.columns

    single = cp.drop_near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in single.collect()} == {c for _, c in test_ngram_join.plain([(d, r.text) for d, r in rows.items()]).values()}

    mixed = cp.mix_sources(spark, docs, SF)
    path = str(tmp_path / "mixed")
    mixed.write.parquet(path)
    files = sorted(f for f in os.listdir(path) if f.startswith("part"))
    order = [r.doc_id for f in files for r in spark.read.parquet(f"{path}/{f}").collect()]
    place = {d: min((slot, seq) for _, slot, seq in v) for (d, _), v in test_mixing.plain([(r.doc_id, r.source, r.text) for r in rows.values()], queries.MIX_WEIGHTS, 65_536).items()}
    assert order == sorted(rows, key=place.get)

    lib = library.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    assert {r.doc_id: (r.n_tokens, r.ids) for r in cp.encode(spark, docs, SF).collect()} == {d: (len(x := lib.encode(r.text)), x) for d, r in rows.items()}


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < 200


def test_run_keeps_the_schedule(spark, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 3000")
    monkeypatch.setattr(cp, "STAGES", cp.STAGES[3:])
    folder = str(tmp_path)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    order = [r.doc_id for r in cp.run(spark, folder).collect()]
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    place = {d: min((slot, seq) for _, slot, seq in v) for (d, _), v in test_mixing.plain(rows, queries.MIX_WEIGHTS, 65_536).items()}
    assert order == sorted(place, key=place.get) and order != sorted(order)
    last = cp.encode(spark, docs, folder).collect()
    assert {r.doc_id: (r.slot, r.seq) for r in last} == place and {r.on_target for r in last} <= {True, False}


def test_stages_with_null_ids_among_copies(spark):
    words = [[f"{k}w{i}" for i in range(200)] for k in range(3)]
    near = lambda k, i: " ".join([*words[k][:i], "new", *words[k][i + 1 :]])
    rows = [(7, near(0, 3)), (3, near(0, 50)), (None, near(0, 90)), (9, near(1, 1)), (None, near(1, 8)), (None, near(2, 5)), (None, near(2, 5)), (None, near(2, 70)), (None, ""), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", f"src{k}", len(t)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 0, 3, 9] and sum(r.text == "" for r in out) == 2
    assert {r.text for r in out if r.doc_id is None and r.text} < {near(2, 5), near(2, 70)}
    lines = [(3, " ".join(words[0])), (None, near(0, 5)), (None, " ".join(words[0]) + "\nlead")]
    docs = spark.createDataFrame([(d, t, "en", "src1", len(t)) for d, t in lines], docs.schema)
    left = [x for r in cp.drop_lines(spark, docs, SF).collect() for x in r.text.split("\n")]
    assert sorted(x[:4] for x in left) == ["0w0 ", "lead"]
