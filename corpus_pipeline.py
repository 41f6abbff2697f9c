"""The pipeline of a training corpus: toxic documents go, widespread lines go, one document of every group of near copies stays, sources
are mixed to their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. Other tables come from sf_dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohypsa.llm import lines, mixing, neardup, pieces, toxicity
from isohypsa.llm.common import table
from isohypsa.llm.queries import tokenizer_path
from isohypsa.staging import delete, scoped, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, with a model of the labelled ones among them."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_spread_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on many sources; documents of which nothing is left go. n_chars follows the text."""
    cleaned = lines.remove_spread_lines(docs).filter(~F.coalesce("l_emptied", F.lit(False))).drop("l_lines", "l_removed", "l_emptied")
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, begin and end ids included."""
    encoded = pieces.encode(docs, pieces.PieceModel.load(tokenizer_path()))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_spread_lines),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifier nor the balanced sample nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; a written table goes when the next one stands. The last of them
    stays, as the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        with scoped(spark):  # what a stage keeps on the way goes when its result is written
            kept = apply(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
