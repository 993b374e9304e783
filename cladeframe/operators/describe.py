"""Statistics of a model and of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import bucket_sizes


def describe(index: DataFrame, k: int, m: int) -> DataFrame:
    """One row: k-mers, buckets, largest, smallest and average bucket (integer part); nulls for an empty index."""
    sizes = bucket_sizes(index).agg(
        F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("kmer_count"), F.count("*").alias("minimizer_count"), F.max("n_kmers").alias("largest_minimizer"), F.min("n_kmers").alias("smallest_minimizer"),
        F.floor(F.try_divide(F.sum("n_kmers"), F.count("*"))).cast("long").alias("minimizer_avg_kmers"),
    )
    return sizes.select(F.lit(k).alias("kmer_size"), F.lit(m).alias("minimizer_size"), "*")


def durations(times: DataFrame, column: str) -> DataFrame:
    """One row: average, longest and shortest; nulls if there are none."""
    return times.agg(F.count(column).alias("n"), F.avg(column).alias("average"), F.max(column).alias("longest"), F.min(column).alias("shortest"))
