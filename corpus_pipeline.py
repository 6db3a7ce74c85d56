"""The corpus pipeline: five stages in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import common, op05_bpe, op06_decontaminate, op07_jaccard_join, op08_quality, op09_line_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that both views together reject go."""
    model = op08_quality.train(docs, common.read(spark, sf_dir, "labels"))
    return op08_quality.classify(docs, model).where("_keep").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows. No document goes."""
    mapped = op09_line_dedup.with_bitmaps(docs)
    lost = F.col("_keep").isNotNull()
    text = F.when(lost, op09_line_dedup.kept_text(F.col("text"), F.col("_keep"))).otherwise(F.col("text"))
    done = mapped.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles the one of the smallest id stays.

    Rows without an id come last and count by their texts; of repeated rows one stays; rows without words all stay.
    """
    return op07_jaccard_join.leaders(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a piece of a benchmark item go, whatever their ids."""
    return op06_decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids (little-endian 32-bit integers) and the text decoded from them."""
    coded = op05_bpe.encode(docs, op05_bpe.vocabulary_path())
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]
#: Classifier, alignment and tokens can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the scratch folder and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(docs, "stage")
    return docs
