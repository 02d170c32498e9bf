"""A corpus made ready for training: rules, line dedup, near copies, secrets, packing, each stage on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import entropy, jaccard, line_templates, packing, quality
from tablescope.llm.common import batches_of, table, written
from tablescope.session import intermediate


#: Bytes of the Arrow batches that texts travel in: each task holds some in the executor and again in its Python worker.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes from here on. Results of stages are written after the stage has returned, so the setting must outlast it; :func:`run` puts it back."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go, null and empty texts among them. An empty table stays empty."""
    small_batches(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the first, lines mostly of fields only where they are equal; every document stays, also one whose text is null, empty or loses all its lines."""
    return line_templates.drop_recurring_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays; documents without words all stay."""
    return jaccard.keep_one(docs, jaccard.Join(words=5, percent=80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null texts as they are."""
    small_batches(spark)
    return entropy.redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents and their places in sequences of 2048; a null or empty text is its end mark alone."""
    small_batches(spark)
    return packing.pack_documents(docs, 2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Packing needs the ids of a tokenizer, which SQL cannot make.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next. Repeated rows and null ids pass through; an empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        # What a stage writes on its way goes when its result is written.
        with intermediate(spark), batches_of(spark, BATCH):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}", outside=True)
    return docs
