"""A training-data pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir); run() writes what it returns as Parquet in the shared folder and gives the
next stage what it reads back. All but the last return the columns of documents, any others of the input included,
whatever their names. The last also returns the places of the mixing schedule, by which run() orders its rows.
An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier flags, by the threshold of their language. Learns from labels as op2 does.

    Every row is judged by its own text, so repeated rows go or stay together. A null text is judged as an empty one, a
    null language by the threshold for all; rows without an id are judged like others. A score at the threshold goes.
    """
    from quire.llm import queries, runtime, toxicity

    held, back = runtime.aside(docs, *COLUMNS)
    model = toxicity.train(held, runtime.table(spark, sf_dir, "labels"), eligible=queries.remainder() != 2)
    return back(toxicity.flagged(toxicity.score(held, model), model).filter(~F.col("flagged")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line duplicates; documents of which nothing but blanks is left by that go.

    n_chars of changed texts is counted anew. Null and empty texts stay as they are; of equal lines the first by (doc_id,
    line) stays; rows that repeat a doc_id, or a text without one, keep and lose equal lines together.
    """
    from quire.llm import line_dedup, runtime

    held, back = runtime.aside(docs, *COLUMNS)
    out = line_dedup.line_dedup(held)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^ \t-\r]"))
    return back(out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the join the document with the smallest doc_id; of one without doc_ids one row.

    Null texts and texts without words stay. Rows that repeat the doc_id that stays are all kept: they are one document.
    Rows without an id whose texts are equal are one document, of which the row that is least in all columns stays.
    """
    from quire.llm import ngram_join, runtime

    held, back = runtime.aside(docs, *COLUMNS)
    joined = ngram_join.ngram_join(held)
    other = F.when(F.col("component_id").isNull(), F.col("component_key") != F.col("key")).otherwise(~F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = joined.filter(other).select(F.col("key").alias("gone")).distinct()
    keyed = held.withColumn("quire_key", runtime.row_key(last=True))
    repeated = F.col("doc_id").isNull() & F.col("text").isNotNull() & F.col("text").rlike(r"[^ \t-\r]")
    once = keyed.filter(repeated).groupBy("quire_key").agg(F.min(F.struct(*keyed.columns)).alias("row")).select("row.*")
    rows = keyed.filter(F.coalesce(~repeated, F.lit(True))).unionByName(once)
    return back(rows.join(gone, F.col("quire_key") == F.col("gone"), "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule.

    A null source is a source of its own; a null text has one byte; rows without an id come first in their source, equal
    ids by size and checksum of the text; repeated rows have a place each.
    """
    from quire.llm import mixing, queries, runtime

    held, back = runtime.aside(docs, *COLUMNS)
    out = mixing.mix(held, queries.MIX_WEIGHTS)
    n = max(docs.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    return back(out.repartitionByRange(n, "slot", "seq").sortWithinPartitions("slot", "seq"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, slot, seq, on_target of every document. Files are read back in any order, so the schedule is made again from the rows.

    Null and empty texts have no ids; rows without an id and repeated rows are kept; other columns are left out.
    """
    from quire.llm import mixing, queries, runtime, sentencepiece

    held, _ = runtime.aside(docs, *COLUMNS)
    mixed = mixing.mix(held.select(*[c for c in COLUMNS if c in held.columns]), queries.MIX_WEIGHTS)
    out = sentencepiece.encode(mixed, queries.tokenizer_path(queries.PIECE_MODEL), "slot", "seq", "on_target")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "slot", "seq", "on_target")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_duplicates), ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", encode)]

#: The stages' models, components and vocabularies have no SQL; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document that is left, in the order of the mixing schedule."""
    from quire.llm import runtime

    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = runtime.written(stage(spark, before, sf_dir), "stage-" + "-".join(name.lower().split()))
        runtime.discard(before)
    return docs.orderBy("slot", "seq").select("doc_id", "n_tokens", "ids")
