"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import encode as enc
from chainloom.llm import clusters, lookalike, mixing, neardup, oracle, overlap, similar, splits
from chainloom.session import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.most_similar(read(spark, sf_dir, "stage2_embeddings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.bound_pairs(splits.split_records(read(spark, sf_dir, "dev"), read(spark, sf_dir, "split_target")))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_records(read(spark, sf_dir, "dev"), read(spark, sf_dir, "split_target")).select("id", "component", "split")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read(spark, sf_dir, "split_target")
    return splits.split_report(splits.split_records(read(spark, sf_dir, "dev"), target), target)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_pairs(read(spark, sf_dir, "dev"), read(spark, sf_dir, "stage2_embeddings"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_summary(read(spark, sf_dir, "dev"), read(spark, sf_dir, "stage2_embeddings"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split(read(spark, sf_dir, "dev"), read(spark, sf_dir, "folds")).select("scheme", "id_a", "id_b")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = read(spark, sf_dir, "dev")
    return overlap.overlap_counts(overlap.cross_split(dev, read(spark, sf_dir, "folds")), dev)


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = read(spark, sf_dir, "dev")
    return overlap.coverage_report(overlap.span_coverage(dev, read(spark, sf_dir, "folds")), dev).withColumn("share", F.round("share", 6) + F.lit(0.0))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(read(spark, sf_dir, "dev"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(read(spark, sf_dir, "dev"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enc.encode(read(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = read(spark, sf_dir, "mix_target")
    return mixing.reached_shares(mixing.mixture(read(spark, sf_dir, "documents"), targets)[0], targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(read(spark, sf_dir, "documents"))


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.canonical_text(read(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found, "p2_splits": p2_splits, "p2_shares": p2_shares,
    "p3_found": p3_found, "p3_clusters": p3_clusters,
    "p4_found": p4_found, "p4_counts": p4_counts, "p4_coverage": p4_coverage, "p5_found": p5_found, "p5_groups": p5_groups,
    "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_canonical": p9_canonical,
}
ORACLE: dict[str, str] = {
    "p2_found": oracle.P2_FOUND, "p4_found": oracle.P4_FOUND, "p4_counts": oracle.P4_COUNTS, "p4_coverage": oracle.P4_COVERAGE, "p5_found": oracle.P5_FOUND,
    "p9_found": oracle.p9_found(), "p9_canonical": oracle.p9_canonical(),
}
