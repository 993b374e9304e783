"""The library's entry points: build a model, place sequences, describe and convert."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions import telemetry
from .operators import describe as D
from .operators import export
from .operators import index as I
from .operators import tree as T
from .sources import fasta, model_store, newick
from .streaming import watcher


def map_kmers_to_tree(spark: SparkSession, tree_path: str, msa_path: str, k: int = 35, m: int = 4, min_support: float = 70.0, pairing: str = "aligned", require_rooted: bool = False) -> model_store.Model:
    """Builds a model: collapses branches of low support, then indexes the k-mers of the sequences."""
    for p in (tree_path, msa_path):
        if not Path(p).exists():
            raise FileNotFoundError(p)
    tree = newick.read(tree_path, require_rooted)
    nodes = T.collapse(tree.nodes(spark), min_support)
    records = fasta.read(spark, msa_path, ordered=pairing == "shifted")
    return model_store.Model(tree.id, tree.name, min_support, k, m, nodes, I.build(records, nodes, k, m, pairing))


def place_sequences(
    spark: SparkSession, query: str, model: model_store.Model, annotations: DataFrame | None = None, max_iterations: int = 1000, min_coverage: float = 0.7, remove_intersection: bool = False
) -> DataFrame:
    """Placements of the records of a FASTA file ("-" for standard input)."""
    if query != "-" and "://" not in query and not any(c in query for c in "*?[") and not Path(query).exists():
        raise FileNotFoundError(query)
    notes = annotations if annotations is not None and not annotations.isEmpty() else model.annotations
    return watcher.place_file(spark, query, model, notes, max_iterations=max_iterations, min_coverage=min_coverage, remove_intersection=remove_intersection)


def describe(model: model_store.Model) -> dict:
    """Statistics of a model, in a fixed order."""
    r = D.describe(model.index, model.k, model.m).first()
    return {
        "ID": model.id, "Name": model.name, "MinBranchSupport": f"{model.min_branch_support:g}", "InMemorySizeMb": "0.000000", "KmerSize": r.kmer_size, "kmerCount": r.kmer_count, "MinimizerSize": r.minimizer_size,
        "MinimizerCount": r.minimizer_count, "LargestMinimizer": r.largest_minimizer, "SmallestMinimizer": r.smallest_minimizer, "MinimizerAvgKmers": r.minimizer_avg_kmers,
    }


@contextmanager
def logged_run(placements: DataFrame) -> Iterator[None]:
    run = telemetry.run_id()
    telemetry.event(telemetry.STARTED, run=run)
    if "annotations" in placements.columns:
        telemetry.event(telemetry.ANNOTATED, run=run)
    yield
    telemetry.event(telemetry.ENDED, run=run)


def write(placements: DataFrame, out: str, form: str = "yaml", overwrite: bool = False, nodes: DataFrame | None = None) -> Path:
    with logged_run(placements):
        return export.write_file(placements, out, form, overwrite, nodes)


def write_parallel(placements: DataFrame, out: str, overwrite: bool = False) -> None:
    """Results of any number: the folders out/result (JSON lines) and out/error, written by the executors."""
    with logged_run(placements):
        export.write_results(placements, out, overwrite)
