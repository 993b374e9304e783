"""Annotations of the clades on the way to a placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def annotate(placements: DataFrame, annotations: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds annotations (array of clade and meta, by clade) of all clades from the root to clade_id; null if there are none.

    annotations: (clade, meta array<struct<tag, value>>); paths: (node_id, anc_id) with self and root.
    """
    on_path = paths.join(annotations.withColumnRenamed("clade", "anc_id"), "anc_id")
    by = on_path.groupBy(F.col("node_id").alias("clade_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("anc_id").alias("clade"), "meta"))).alias("annotations"))
    return placements.join(by, "clade_id", "left")
