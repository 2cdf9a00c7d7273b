"""A training corpus from `documents`: reject, clean, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.llm import decontaminate, lines, minhash, mixing, quality
from heliogrid.llm.common import ensure_checkpoint, settle

#: A document with a lower score is rejected.
MIN_QUALITY = 0.3
#: Ids up to which a set of ids is broadcast rather than shuffled with the texts.
MAX_BROADCAST = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the ids (distinct); rows with a null id stay."""
    ids = settle(ids.select("doc_id").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "doc_id", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of MIN_QUALITY or more; the labels of documents whose
    crc32(doc_id as text) mod 5 is 0 are held out here too. Null and empty texts have the score
    of a size difference of 0; repeated rows are scored one by one; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    score = "__quality_score"
    scored = quality.score_quality(docs, labels, out_col=score)
    return scored.where(F.col(score) >= MIN_QUALITY).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows the text where it changed.
    A page of boilerplate alone stays whole: it is a copy of other pages, which the next stage
    decides on. Null texts stay null; repeated rows are pages; an empty table stays empty."""
    cleaned = lines.drop_boilerplate(docs.withColumn("__text", F.col("text")), keep_pages=True)
    changed = ~F.col("text").eqNullSafe(F.col("__text"))
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group at a similarity of 0.8 or more; one row
    of each id that repeats. Texts without words and rows with a null id all stay."""
    found = settle(minhash.near_duplicates(docs.select("doc_id", "text"), threshold_percent=80).where("doc_id is not null"))
    left = _without(docs, found.where(~F.col("kept")))
    repeated = settle(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    few = F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST else repeated
    return _without(left, repeated).unionByName(left.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold half of a benchmark item or more. Null and empty texts and rows
    with a null id stay; repeated rows stay or go together; an empty table stays empty."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.contaminated(docs, benchmark).where("doc_id is not null"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, (doc_id, size, source_size, target, taken). Null texts
    have the size 0, null sources are one source, repeated rows are documents of their own; an
    empty table gives no rows."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
]

#: Compression, tiling and balanced sampling have no SQL form; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of sf_dir."""
    folder = f"{ensure_checkpoint(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
