"""Queries over the test tables, one or more for each operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import murmur
from ..functions import seq as S
from ..functions import status as X
from ..functions import telemetry
from ..operators import annotate, describe, export
from ..operators import index as I
from ..operators import place as P
from ..operators import tree as T
from ..runtime import checkpoint, numbered, shared_dir
from ..sources import fasta, model_store, newick, tree_yaml
from ..sources import yaml_io as Y
from ..streaming import watcher
from . import lens as L

K, M = L.K, L.M
#: Event types that stand for markers of a job.
MARKS = {"purchase": "success", "error": "error", "click": "running"}
GEO_SUPPORT = 90.0
N_MODELS = 20


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tree(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """The collapsed tree, and its inner nodes with their closure, made for each query."""
    nodes = checkpoint(T.collapse(L.nodes(spark, d), L.MIN_SUPPORT))
    inner, above = T.inner_nodes(nodes)
    return nodes, (checkpoint(inner), checkpoint(above))


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return T.collapse(L.nodes(spark, d), L.MIN_SUPPORT)


def index(spark: SparkSession, d: str, pairing: str = "aligned", m: int = M, parts: tuple | None = None) -> DataFrame:
    nodes, inner_parts = parts or tree(spark, d)
    return I.build(L.records(spark, d), nodes, K, m, pairing, inner_parts=inner_parts)


def found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = tree(spark, d)
    return P.tallies(P.hits(L.queries(spark, d), index(spark, d, parts=parts), K)), parts[1][0]


def placed(spark: SparkSession, d: str, parts: tuple | None = None, **options) -> DataFrame:
    parts = parts or tree(spark, d)
    return P.place(L.queries(spark, d), index(spark, d, parts=parts), parts[1][0], K, **options)


def in_text(counts: DataFrame) -> DataFrame:
    return counts.withColumn("kmer", S.unpacked(F.col("kmer"), K))


def bucket_text(m: int = M):
    return S.bucket_text(F.col("minimizer"), K, m).alias("minimizer")


def seq_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return L.records(spark, d).select("header", "seq")


def seq_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return L.records(spark, d).select("header", S.reverse_complement(F.col("seq")).alias("revcomp"))


def seq_kmers_forward(spark: SparkSession, d: str) -> DataFrame:
    return in_text(S.explode_kmers(L.records(spark, d).select("seq"), K, both=False).groupBy("kmer").agg(F.count("*").alias("n")))


def seq_kmers_both(spark: SparkSession, d: str) -> DataFrame:
    return in_text(S.explode_kmers(L.records(spark, d).select("seq"), K).groupBy("kmer").agg(F.count("*").alias("n")))


def kmer_minimizer_buckets(spark: SparkSession, d: str) -> DataFrame:
    return I.bucket_sizes(index(spark, d)).select(bucket_text(), "n_kmers")


def kmer_minimizer_zero(spark: SparkSession, d: str) -> DataFrame:
    return I.bucket_sizes(index(spark, d, m=0)).select(bucket_text(0), "n_kmers")


def query_too_short(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).where(F.col("message") == X.TOO_SHORT).select("query", "status", "message")


def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return L.nodes(spark, d).select("node_id", "parent_id", "kind", "name", "support")


def tree_collapse(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(spark, d).select("node_id", "parent_id", "kind")


def tree_collapse_geography(spark: SparkSession, d: str) -> DataFrame:
    return T.collapse(L.geography(spark, d), GEO_SUPPORT).select("node_id", "parent_id", "kind")


def tree_closure(spark: SparkSession, d: str) -> DataFrame:
    return T.closure(L.geography(spark, d))


def tree_path_to_root(spark: SparkSession, d: str) -> DataFrame:
    return T.path_to_root(L.geography(spark, d).where(F.col("kind") != T.LEAF))


def tree_leaf_paths(spark: SparkSession, d: str) -> DataFrame:
    return T.leaf_paths(L.geography(spark, d)).select("node_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def tree_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.kind_counts(tree(spark, d)[0])


def tree_children_inner(spark: SparkSession, d: str) -> DataFrame:
    return T.children(tree(spark, d)[0])


def header_leaf_join(spark: SparkSession, d: str) -> DataFrame:
    return I.leaves_of(L.records(spark, d).select("header"), tree(spark, d)[0]).select("header", "leaf_id", "parent_id")


def header_leaf_missing(spark: SparkSession, d: str) -> DataFrame:
    return I.missing_leaves(L.queries(spark, d).select(F.col("query").alias("header")), L.nodes(spark, d))


def index_build(spark: SparkSession, d: str) -> DataFrame:
    return I.kmer_nodes(index(spark, d)).groupBy("node_id").agg(F.count("*").alias("n_kmers"))


def index_build_shifted(spark: SparkSession, d: str) -> DataFrame:
    return I.kmer_nodes(index(spark, d, "shifted")).groupBy("node_id").agg(F.count("*").alias("n_kmers"))


def describe_db(spark: SparkSession, d: str) -> DataFrame:
    return describe.describe(index(spark, d), K, M)


def overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.matched(found(spark, d)[0])


def root_coverage(spark: SparkSession, d: str) -> DataFrame:
    kmers = I.build_root(L.records(spark, d), L.nodes(spark, d), K)
    rows = P.matched(P.tallies(P.hits(L.queries(spark, d), kmers, K)))
    expected = X.expected_coverage(F.col("matched"), Decimal("0.7"))
    return rows.select("query", "matched", expected.alias("expected"), (F.col("matched") >= expected).alias("enough"))


def node_hits(spark: SparkSession, d: str) -> DataFrame:
    return P.adherence(*found(spark, d)).select("query", "node_id", "one")


def one_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    return P.adherence(*found(spark, d)).select("query", "parent_id", "node_id", "one", "rest")


def one_vs_rest_no_intersection(spark: SparkSession, d: str) -> DataFrame:
    return P.adherence(*found(spark, d), remove_intersection=True).select("query", "parent_id", "node_id", "one", "rest")


def level_winners(spark: SparkSession, d: str) -> DataFrame:
    won = P.adherence(*found(spark, d)).where("win")
    return won.groupBy("query", "parent_id").agg(F.max("node_id").alias("node_id"), F.count("*").alias("n_winners"))


def place_sequences(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d)


def place_remove_intersection(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d, remove_intersection=True)


def place_query_coverage(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d, coverage_base="query", min_coverage=0.5).select("query", "status", "message", "clade_id")


def place_max_iterations(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d, max_iterations=1)


def place_status_summary(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def place_unclassifiable(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).where(F.col("status") == X.UNCLASSIFIABLE).select("query", X.code(F.col("status"), F.col("message")).alias("code"))


def annotated(spark: SparkSession, d: str) -> DataFrame:
    parts = tree(spark, d)
    paths = T.path_to_root(parts[0].where(F.col("kind") != T.LEAF))
    return annotate.annotate(placed(spark, d, parts), L.annotations(spark, d), paths)


def place_annotated(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_join(F.transform("annotations", lambda a: F.concat_ws(":", a["clade"].cast("string"), a["meta"][0]["tag"], a["meta"][0]["value"])), ",")
    return annotated(spark, d).select("query", "status", "clade_id", tags.alias("tags"))


def place_json(spark: SparkSession, d: str) -> DataFrame:
    return export.json_lines(placed(spark, d))


def place_errors(spark: SparkSession, d: str) -> DataFrame:
    return export.errors(placed(spark, d, max_iterations=1))


def marker_stream(events: DataFrame) -> DataFrame:
    """Events as markers of jobs, three events to a job; other types are configurations without a marker."""
    marker = F.lit(None).cast("string")
    for kind, name in MARKS.items():
        marker = F.when(F.col("event_type") == kind, name).otherwise(marker)
    return events.select(F.floor(F.col("event_id") / 3).cast("long").alias("job"), marker.alias("marker"))


def jobs_pending(spark: SparkSession, d: str) -> DataFrame:
    seen = marker_stream(L.table(spark, d, "events"))
    return watcher.pending(seen.select("job").distinct(), seen.where(F.col("marker").isNotNull()))


def jobs_model_lookup(spark: SparkSession, d: str) -> DataFrame:
    jobs = L.table(spark, d, "events").select("event_id", (F.col("user_id") % 25).cast("string").alias("model_id"))
    models = L.table(spark, d, "nation").where(F.col("n_nationkey") < N_MODELS).select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/models/"), "n_name").alias("model_path"))
    return watcher.with_models(jobs, models).select("event_id", "model_name", "error")


def runtime_stats(spark: SparkSession, d: str) -> DataFrame:
    return describe.durations(L.table(spark, d, "events"), "value").select("n", F.round("average", 6).alias("average"), "longest", "shortest")


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "fasta")
    fasta.write(L.records(spark, d).where("seq <> ''").select("header", "seq"), at)
    return fasta.read(spark, at).select("header", "seq")


def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Job states of a stream of events, read with the file source until nothing is left."""
    out, kind = scratch(spark, "states"), L.table(spark, d, "events").schema
    events = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)

    def batch(df: DataFrame, k: int) -> None:
        df.groupBy("job", "marker").agg(F.count("*").alias("n")).write.parquet(f"{out}/batch={k}")

    marker_stream(events).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return watcher.job_states(spark.read.parquet(out).select("job", "marker"))


def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "model")
    parts = tree(spark, d)
    model_store.save(model_store.Model("lens", "lens", L.MIN_SUPPORT, K, M, parts[0], index(spark, d, parts=parts), L.annotations(spark, d)), at)
    return I.kmer_nodes(model_store.load(spark, at).index).groupBy("minimizer").agg(F.count("*").alias("n_rows"), F.countDistinct("kmer").alias("n_kmers")).withColumn("minimizer", bucket_text())


def newick_parse(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of a tree that went through Newick text, with the support and leaf count of their parents."""
    rows = [r.asDict() for r in L.geography(spark, d).collect()]
    nodes = newick.Tree("geography", newick.parse(newick.render(rows))).nodes(spark)
    up = nodes.select(F.col("node_id").alias("parent_id"), F.col("support").alias("parent_support"))
    size = nodes.groupBy("parent_id").agg(F.count("*").alias("siblings"))
    return nodes.where(F.col("kind") == T.LEAF).join(up, "parent_id").join(size, "parent_id").select("name", "parent_support", "siblings")


def fasta_text(spark: SparkSession, d: str) -> DataFrame:
    return L.records(spark, d).select(S.to_fasta(F.col("header"), F.col("seq")).alias("entry"))


def record_numbers(spark: SparkSession, d: str) -> DataFrame:
    return numbered(L.records(spark, d).select("header"), "header").select("header", F.col("rec_no").cast("long").alias("rec_no"))


def coverage_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Expected coverage of counts below, inside and above the range of the parameter."""
    size = F.col("p_size").cast("long")
    return L.table(spark, d, "part").select("p_partkey", *[X.expected_coverage(size, c).alias(n) for n, c in (("below", -0.5), ("inside", 0.7), ("above", 1.7))])


def annotation_load(spark: SparkSession, d: str) -> DataFrame:
    """Annotations written as a YAML file with tags and read again; one per inner clade, so the driver holds them."""
    with tempfile.TemporaryDirectory() as folder:
        at = Path(folder, "annotations.yaml")
        at.write_text(Y.dump([{"clade": r.clade, "meta": Y.tagged(r.meta)} for r in L.annotations(spark, d).collect()]))
        return Y.read_annotations(spark, str(at)).select("clade", F.explode("meta").alias("m")).select("clade", "m.tag", "m.value")


def tree_yaml_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The tree of places written as nested YAML and read again."""
    at = scratch(spark, "tree")
    tree_yaml.write(L.geography(spark, d), at)
    return tree_yaml.read(spark, at).select("node_id", "parent_id", "kind", "name", "support")


def place_yaml(spark: SparkSession, d: str) -> DataFrame:
    """Query and code of the documents of a YAML result file."""
    with tempfile.TemporaryDirectory() as folder:
        at = export.write_file(placed(spark, d), str(Path(folder, "out", "result")), "yaml")
        docs = [Y.load(x) for x in at.read_text().split("---\n")[1:]]
    return spark.createDataFrame([(x["query"], x["code"]) for x in docs], "query string, code string")


def kmer_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of an exchanged model for the k-mers of the queries."""
    kmers = P.query_kmers(L.queries(spark, d), K).select(S.unpacked(F.col("kmer"), K).alias("kmer")).distinct()
    return kmers.select("kmer", murmur.hash_column(F.col("kmer")).alias("hash"))


def place_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).select("query", telemetry.outcome(F.col("status")).alias("code"))


def adherence_texts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each level as texts, the one with the most k-mers first."""
    rows = P.adherence(*found(spark, d))
    order = Window.partitionBy("query", "parent_id").orderBy(F.desc("one"), "node_id")  # a query's siblings
    return rows.select("query", "parent_id", F.row_number().over(order).alias("place"), X.adherence_text(F.col("node_id"), F.col("one"), F.col("rest")).alias("text"))


def index_overlap(spark: SparkSession, d: str) -> DataFrame:
    """K-mers of the index that some query has, by bucket."""
    asked = P.query_kmers(L.queries(spark, d), K).select("kmer")
    return index(spark, d).join(asked, "kmer", "left_semi").groupBy("minimizer").agg(F.count("*").alias("n_kmers")).select(bucket_text(), "n_kmers")


def first_words(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "part").select("p_partkey", X.first_word(F.col("p_type")).alias("word"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        "seq_sanitize seq_revcomp seq_kmers_forward seq_kmers_both kmer_minimizer_buckets kmer_minimizer_zero query_too_short tree_nodes tree_collapse tree_collapse_geography tree_closure "
        "tree_path_to_root tree_leaf_paths tree_kind_counts tree_children_inner header_leaf_join header_leaf_missing index_build index_build_shifted describe_db overlap_counts root_coverage "
        "node_hits one_vs_rest one_vs_rest_no_intersection level_winners place_sequences place_remove_intersection place_query_coverage place_max_iterations place_status_summary "
        "place_unclassifiable place_annotated place_json place_errors jobs_pending jobs_model_lookup runtime_stats fasta_roundtrip stream_jobs model_roundtrip newick_parse "
        "fasta_text record_numbers coverage_clamp annotation_load tree_yaml_roundtrip place_yaml kmer_hashes "
        "place_outcomes adherence_texts index_overlap first_words"
    )
    return {n: globals()[n] for n in names.split()}
