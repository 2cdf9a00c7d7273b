"""The queries opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, decontaminate, embeddings, langid, lines, minhash, mixing, periodic, pii, quality, substrings, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    pred = langid.identify(docs, docs.where(~held_out))
    return pred.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.scratch_folder(spark)
    index = warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).drop("payload")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold_percent=85)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    scored = quality.score_quality(docs, labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents with h % 10 = 0 (h: crc32 of the id) all words from a on repeat the p words there."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int")))
    found = periodic.periodic_runs(docs.withColumn("text", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))))
    best = lambda name: F.col(f"strongest.{name}").alias(name)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines_of = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    milli = F.floor(F.lit(1000) * F.col("strongest.length") / F.col("strongest.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"), milli.alias("exponent_milli"), F.sha2(lines_of, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.cluster(table(spark, sf_dir, "embeddings"))
    centroid = F.sha2(F.array_join("centroid", ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid.alias("centroid_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_line_dedup,
        op3_language_id,
        op4_warc,
        op5_pii,
        op6_minhash_near_dedup,
        op7_substring_dedup,
        op8_benchmark_decontamination,
        op9_source_mixing,
        op10_quality_classifier,
        op11_voronoi_topk,
        op12_periodic_runs,
        op13_centroid_clustering,
    )
}
ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embeddings.ORACLE,
    "op2_line_dedup": lines.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_minhash_near_dedup": minhash.ORACLE,
    "op11_voronoi_topk": topk.ORACLE,
    "op12_periodic_runs": periodic.ORACLE,
    "op13_centroid_clustering": clusters.ORACLE,
}
