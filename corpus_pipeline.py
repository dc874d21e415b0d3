"""A training corpus from documents: quality rules, toxicity, near duplicates, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import mixing, neardup, packing, quality, toxicity
from fleetlens.llm.common import let_go, recorded, remove_path, table, written


NEEDED = ("doc_id", "text", "lang", "source")


#: Rows of an Arrow batch: Spark's 10,000 would hold as many texts, however long, in a Python worker and in the JVM beside it.
BATCH_ROWS = 2000


def _bounded(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(BATCH_ROWS, int(spark.conf.get(key)) if int(spark.conf.get(key)) > 0 else BATCH_ROWS)))


def _aside(docs: DataFrame) -> DataFrame:
    """docs with every column that no stage reads under a name of its own, so that no stage's columns replace it."""
    return docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns if c not in NEEDED})


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`" if c in NEEDED else f"`_doc_{c}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    _bounded(spark)
    return _columns(quality.judge(_aside(docs)).where("kept"), docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a machine trained on the labelled ones among them."""
    _bounded(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.score_toxicity(_aside(docs), model).where("predicted = 0"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    _bounded(spark)
    return _columns(neardup.near_duplicates(_aside(docs)).where("chosen"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    _bounded(spark)
    mixed = mixing.mix(_aside(docs)).where("copies > 0")
    return _columns(mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    _bounded(spark)
    cut = packing.pieces(docs, packing.public_paths())
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: The stages past the first can't be expressed in SQL; tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. A stage's own tables go once its result is written; those that the returned rows read stay."""
    docs = table(spark, sf_dir, "documents")
    before: str | None = None
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        result = made.pop()
        for path in [*made, *([before] if before else [])]:
            remove_path(spark, path)
        let_go(spark)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
