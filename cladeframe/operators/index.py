"""The k-mer index: which inner clades hold each k-mer of the reference sequences.

kmer_index(minimizer, kmer, clades array<struct<node_id, exclusive, first>>) has one row per k-mer (packed).
The root holds every k-mer and leaves are never placed on, so neither is listed; a k-mer whose
leaves hang from the root has an empty array. exclusive: no sibling of the clade holds the k-mer.
first: the clade is the least of its siblings that hold it. Both serve the leave-one-out counts, so
placement adds three counters per clade instead of comparing siblings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from . import tree as T

CLADES = "array<struct<node_id:bigint,exclusive:boolean,first:boolean>>"


def shifted(records: DataFrame) -> DataFrame:
    """Pairs each header with the sequence of the record before it; the first header has none and the last sequence is dropped."""
    before = records.select((F.col("rec_no") + 1).alias("rec_no"), "seq")
    return records.select("rec_no", "header").join(before, "rec_no")


def leaves_of(records: DataFrame, nodes: DataFrame, missing: str = "error") -> DataFrame:
    """Adds node_id and parent_id of the leaf named like the header (the least id of several). missing: error or drop."""
    leaves = nodes.where(F.col("kind") == T.LEAF).groupBy(F.col("name").alias("header")).agg(F.min(F.struct("node_id", "parent_id")).alias("leaf"))
    out = records.join(leaves, "header", "inner" if missing == "drop" else "left")
    if missing == "error":
        text = F.concat(F.lit("no leaf has the name "), F.coalesce("header", F.lit("null")))
        out = out.where(F.when(F.col("leaf").isNull(), F.raise_error(text).cast("boolean")).otherwise(True))
    return out.select("*", F.col("leaf.node_id").alias("leaf_id"), F.col("leaf.parent_id").alias("parent_id")).drop("leaf")


def missing_leaves(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Records whose header names no leaf."""
    return records.join(nodes.where(F.col("kind") == T.LEAF).select(F.col("name").alias("header")), "header", "left_anti")


def build(records: DataFrame, nodes: DataFrame, k: int = 35, m: int = 4, pairing: str = "aligned", missing: str = "error", inner_parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The index of records (rec_no, header, seq) over a sanitized tree. inner_parts: what tree.inner_nodes() gives, if it is known."""
    if pairing == "shifted":
        records = shifted(records)
    paired = leaves_of(records.select("header", "seq"), nodes, missing).select("parent_id", "seq")
    inner, above = inner_parts or T.inner_nodes(nodes)
    # k-mers meet by the parent of their leaf first: siblings share the rest of the path
    parents = S.explode_kmers(paired, k).distinct()
    # a parent's clades and their parents, once per inner node; the tree is small beside the k-mers
    up = above.join(inner.select(F.col("node_id").alias("anc_id"), F.col("parent_id").alias("above_id")), "anc_id")
    up = up.groupBy(F.col("node_id").alias("parent_id")).agg(F.collect_list(F.struct(F.col("above_id").alias("p"), F.col("anc_id").alias("n"))).alias("path"))
    # (k-mer, clade) pairs meet before a k-mer's clades are listed: a list has each clade once
    rows = parents.join(up, "parent_id", "left").select("kmer", F.explode_outer("path").alias("x")).repartition("kmer").distinct()
    grouped = rows.groupBy("kmer").agg(F.sort_array(F.collect_list("x")).alias("c"))

    def clade(x, i):
        # sorted by parent: siblings are neighbours
        first = F.coalesce(F.get("c", i - 1)["p"] != x["p"], F.lit(True))
        last = F.coalesce(F.get("c", i + 1)["p"] != x["p"], F.lit(True))
        return F.struct(x["n"].alias("node_id"), (first & last).alias("exclusive"), first.alias("first"))

    return grouped.select(S.bucket(F.col("kmer"), k, m).alias("minimizer"), "kmer", F.transform("c", clade).cast(CLADES).alias("clades"))


def build_root(records: DataFrame, nodes: DataFrame, k: int = 35, missing: str = "error") -> DataFrame:
    """(kmer, clades) as build() has them, but for the root alone: k-mers without the clades below, which are most of the work."""
    paired = leaves_of(records.select("header", "seq"), nodes, missing).select("seq")
    return S.explode_kmers(paired, k).distinct().select("kmer", F.array().cast(CLADES).alias("clades"))


def kmer_nodes(index: DataFrame, root_id: int = 0) -> DataFrame:
    """The long form (minimizer, kmer, node_id) with the root's rows."""
    ids = F.concat(F.array(F.lit(root_id).cast("long")), F.transform("clades", lambda x: x["node_id"]))
    return index.select("minimizer", "kmer", F.explode(ids).alias("node_id"))


def bucket_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("minimizer").agg(F.count("*").alias("n_kmers"))
