"""The registered queries of the text operators; ``ORACLE`` has SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidetrace.llm import (
    backoff,
    centroids,
    decontaminate,
    discriminant,
    fair_queue,
    host_rules,
    line_dedup,
    minhash,
    periodic_runs,
    pii,
    secrets,
    unit_dedup,
    warc,
)
from tidetrace.llm.common import table, with_scan_id, written
from tidetrace.llm.oracle import ORACLE  # noqa: F401
from tidetrace.session import scratch_path

#: Of the registered query; a caller has a secret of their own.
PSEUDONYM_KEY = "example key"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_pages(spark, path)
    return found.select(
        warc.page_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id("refers_to").alias("refers_to"),
    )


@query
def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = pii.pseudonymise(table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)
    return named.select("doc_id", "n_pseudonyms", "text")


@query
def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(discriminant.with_features(table(spark, sf_dir, "documents")), "features")
    return discriminant.quality(measured, table(spark, sf_dir, "labels"))


@query
def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_scan_id(table(spark, sf_dir, "documents").select("doc_id", "text"), "row")
    return line_dedup.repeated_lines(documents, line_dedup.WHOLE).select("doc_id", "n", "kept_doc_id", "kept_n", "component")


@query
def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = unit_dedup.remove_units(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s.start, s.end, s.n_copies, s.kept_doc_id, s.kept_start))
    words = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s.words)
    return left.select(
        "doc_id",
        F.size("removed").cast("bigint").alias("n_removed"),
        words.alias("words_removed"),
        F.array_join(spans, ",").alias("spans"),
        "text",
    )


@query
def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = host_rules.with_stats(table(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    judged = host_rules.judge(written(stats, "stats"), "source")
    return judged.select("doc_id", *host_rules.STATS, "base_failed", "kept")


@query
def op7_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_queue.mix(fair_queue.sized(table(spark, sf_dir, "documents")))


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = minhash.near_duplicates(documents)
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept")
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("text", periodic_runs.looped("doc_id", "text"))
    return periodic_runs.digest(periodic_runs.find_runs(documents))


@query
def op12_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = backoff.held_out("doc_id")
    scored = backoff.score(table(spark, sf_dir, "documents"), ~held)
    return scored.withColumn("held_out", held).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(centroids.usable("embedding", 64))
    vectors = rows.select("vec_id", centroids.grid("embedding").alias("x"))
    clustered, last = centroids.cluster(vectors, centroids.drawn(vectors, k=16, seed=1), rounds=3)
    return centroids.summary(written(clustered, "clustered"), last)
