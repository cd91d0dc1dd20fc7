"""A corpus pipeline of five stages. Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame that is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, jaccard_join, language, quality, sentencepieces
from tabulon.llm.queries import piece_model, table
from tabulon.llm.tables import bounded_broadcast, drop, rows_among, stored, written

#: Documents scored below this are rejected; documents with this many benchmark items in them go.
QUALITY, LEAKED_ITEMS = 0.3, 1


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its columns but the used ones under names that no operator has, and what gives them their names back."""
    names = {c: c if c in used else f"kept column {i}" for i, c in enumerate(docs.columns)}
    named = lambda df, way: df.select(*[F.col(f"`{a}`").alias(b) for a, b in way])
    return named(docs, names.items()), lambda df: named(df, [(b, a) for a, b in names.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, doesn't reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows, back = aside(docs, "doc_id", "text")
    return back(quality.score_quality(rows, quality.fit(rows, labels)).where(F.col("score") >= QUALITY))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: with letters, and near enough to a learned language."""
    rows, back = aside(docs, "doc_id", "text", "lang")
    return back(language.identify(rows, language.fit(rows)).where("not rejected"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: that of the least doc_id (rows without one come last), then of the least hash of its text.

    Rows are told apart by a key of their own, so other texts with the doc_id of a dropped row stay, and copies without a
    doc_id go. Texts without words have no duplicates.
    """
    rows, back = aside(docs, "doc_id", "text")
    keyed = written(rows.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
    found = jaccard_join.near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text"), keyed=True).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row").alias("place")
    groups = written(found.join(keyed.select("row", place), "row"), "pipeline-groups")
    keepers = groups.groupBy("component_id").agg(F.min("place").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("keeper.row").alias("keeper"))
    gone = groups.join(bounded_broadcast(keepers, 16), "component_id").where("row <> keeper").select("row")
    return back(rows_among(keyed, "row", gone, inside=False))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    rows, back = aside(docs, "text")
    return back(decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), least_items=LEAKED_ITEMS).where("not contaminated"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of the whole text, with a digest of the text that they decode to."""
    coded = sentencepieces.encode(docs.select("doc_id", "text"), piece_model(), decoded="decoded")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language identification", keep_languages),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifiers are no SQL; tests/llm/test_pipeline.py compares every stage's rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's rows are deleted when the next one's are written."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        drop(spark, *last)
        last = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
