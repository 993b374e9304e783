"""Placement of query sequences on the tree, without a walk.

The k-mers that a query shares with a clade are never narrowed on the way down, so whether a clade
wins against its siblings doesn't depend on the walk, and at most one of siblings wins: one > rest
means it holds more of the query's k-mers than the union of the others. A query's place is the end
of the chain of winners from the root. Per clade, one is the number of shared k-mers; rest is
those of all siblings together (a k-mer counts once, at the first sibling that holds it) less those
that only the clade itself holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import murmur
from ..functions import seq as S
from ..functions import status as X


def query_kmers(queries: DataFrame, k: int, hashed: bool = False) -> DataFrame:
    """Distinct (query, kmer) of both strands; packed, or hashed as in an exchanged model."""
    slim = queries.select("query", "seq")
    return (murmur.explode_hashes(slim, k) if hashed else S.explode_kmers(slim, k)).distinct()


def hits(queries: DataFrame, index: DataFrame, k: int, hashed: bool = False) -> DataFrame:
    """(query, kmer, clades): the query's k-mers that the index holds. Catalyst broadcasts the smaller side if its size allows."""
    return query_kmers(queries, k, hashed).join(index, "kmer").select("query", "kmer", "clades")


def tallies(found: DataFrame) -> DataFrame:
    """(query, node_id, one, exclusive, firsts) of each clade that a query touches; a null node_id stands for
    the root, which holds all matched k-mers. The one aggregate over the hits."""
    root = F.array(F.struct(F.lit(None).cast("long").alias("node_id"), F.lit(False).alias("exclusive"), F.lit(False).alias("first")))
    each = found.select("query", F.explode(F.concat(root, "clades")).alias("c")).select("query", "c.*")
    return each.groupBy("query", "node_id").agg(F.count("*").alias("one"), F.count_if("exclusive").alias("exclusive"), F.count_if("first").alias("firsts"))


def matched(tally: DataFrame) -> DataFrame:
    """Matched k-mers per query; the root holds all of them."""
    return tally.where("node_id is null").select("query", F.col("one").alias("matched"))


def clade_counts(tally: DataFrame, inner: DataFrame) -> DataFrame:
    """(query, parent_id, node_id, one, exclusive, total): total is the union over the node's siblings and itself."""
    placed = tally.join(inner.select("node_id", "parent_id", "depth", "has_inner_child"), "node_id")
    return placed.withColumn("total", F.sum("firsts").over(Window.partitionBy("query", "parent_id"))).drop("firsts")


def adherence(tally: DataFrame, inner: DataFrame, remove_intersection: bool = False) -> DataFrame:
    """(query, parent_id, node_id, depth, has_inner_child, one, rest, win) of each clade that a query touches."""
    c = clade_counts(tally, inner)
    rest = F.col("total") - F.col("exclusive")
    win = F.col("one") > rest
    if remove_intersection:
        one, rest = F.col("exclusive"), F.col("total") - F.col("one")
    else:
        one = F.col("one")
    return c.select("query", "parent_id", "node_id", "depth", "has_inner_child", one.cast("int").alias("one"), rest.cast("int").alias("rest"), win.alias("win"))


def chain(winners: DataFrame, root_id: int) -> DataFrame:
    """The last clade of each query's chain of winners from the root: (query, clade_id, depth, one, rest, has_inner_child)."""
    listed = winners.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("depth", "parent_id", "node_id", "one", "rest", "has_inner_child"))).alias("w"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent_id"), F.lit(root_id).cast("long").alias("node_id"), F.lit(0).alias("one"), F.lit(0).alias("rest"), F.lit(True).alias("has_inner_child"))
    last = F.aggregate("w", start, lambda s, x: F.when(x["parent_id"] == s["node_id"], x).otherwise(s))
    return listed.select("query", last.alias("s")).select("query", F.col("s.node_id").alias("clade_id"), F.col("s.depth").alias("depth"), F.col("s.one").alias("one"), F.col("s.rest").alias("rest"), F.col("s.has_inner_child").alias("has_inner_child"))


def place(
    queries: DataFrame, index: DataFrame, inner: DataFrame, k: int = 35, max_iterations: int = 1000, min_coverage: float = 0.7,
    remove_intersection: bool = False, coverage_base: str = "matched", root_id: int = 0, root_has_children: bool = True, hashed: bool = False,
) -> DataFrame:
    """(query, status, message, clade_id, one, rest, iterations) of every query (query, seq).

    coverage_base: "matched" compares with the matched k-mers, which always pass; "query" compares
    with all k-mers of the query. hashed: the index knows k-mers by their hash.
    """
    tally = tallies(hits(queries, index, k, hashed))
    counts = matched(tally)
    ends = chain(adherence(tally, inner, remove_intersection).where("win"), root_id)
    rows = queries.select("query", F.length("seq").alias("size")).join(counts, "query", "left").join(ends, "query", "left")
    if coverage_base == "query":
        rows = rows.join(query_kmers(queries, k, hashed).groupBy("query").agg(F.count("*").alias("all")), "query", "left")
        expected = X.expected_coverage(F.col("all"), min_coverage)
    else:
        expected = X.expected_coverage(F.col("matched"), min_coverage)
    reached = F.coalesce("depth", F.lit(0))
    rows = rows.withColumn("iterations", F.when((reached > 0) & ~F.col("has_inner_child"), reached).otherwise(reached + 1).cast("int"))
    short = F.coalesce(F.col("size") < k, F.lit(True))
    none = F.col("matched").isNull()
    few = F.col("matched") < expected
    many = F.col("iterations") > max_iterations
    steps = [
        (short, X.ERROR, F.lit(X.TOO_SHORT)),
        (none, X.UNCLASSIFIABLE, X.unrelated(F.col("query"))),
        *([] if root_has_children else [(F.lit(True), X.ERROR, F.lit(X.NO_CHILDREN))]),
        (few, X.UNCLASSIFIABLE, F.concat(F.lit("Insufficient kmers coverage: "), F.col("matched").cast("string"))),
        (many, X.ERROR, F.lit(X.TOO_MANY)),
        (reached == 0, X.UNCLASSIFIABLE, F.lit(X.NO_OVERLAP)),
        (~F.col("has_inner_child"), X.IDENTITY, F.lit(None).cast("string")),
    ]
    status, message = F.lit(X.RESOLUTION), F.lit(X.LCA_ACCEPTED)
    for when, name, text in reversed(steps):
        status, message = F.when(when, name).otherwise(status), F.when(when, text).otherwise(message)
    rows = rows.withColumn("status", status).withColumn("message", message)
    identity = F.col("status") == X.IDENTITY
    return rows.select(
        "query", "status", "message", X.clade_of(F.col("status"), F.col("clade_id")).alias("clade_id"),
        F.when(identity, F.col("one")).alias("one"), F.when(identity, F.col("rest")).alias("rest"), F.when(~short & ~none, F.col("iterations")).alias("iterations"),
    )
