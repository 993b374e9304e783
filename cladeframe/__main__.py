"""Command line: build-db, place, describe-db, convert tree|kmers|database, watch, serve."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from . import api, service
from .functions import seq as S
from .functions.telemetry import JsonLines
from .operators import tree as T
from .sources import model_store, newick
from .sources import yaml_io as Y
from .streaming import watcher


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeframe", description=__doc__)
    top.add_argument("--log-level", default="warning")
    top.add_argument("--log-file")
    top.add_argument("--log-format", choices=("ansi", "jsonl"), default="ansi")
    top.add_argument("--threads", type=int, default=1, help="threads of a local run")
    top.add_argument("--master", help="a cluster's master; spark-submit's own where this and --threads are not given")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-db")
    build.add_argument("tree")
    build.add_argument("msa")
    build.add_argument("-k", "--kmer-size", type=int, default=35)
    build.add_argument("-m", "--minimizer-size", type=int, default=4)
    build.add_argument("-o", "--output", default="database")
    build.add_argument("-s", "--min-branch-support", type=float, default=70)
    place = commands.add_parser("place")
    place.add_argument("query", nargs="?", default="-")
    place.add_argument("-d", "--database", required=True)
    place.add_argument("-o", "--output", required=True)
    place.add_argument("-a", "--annotations")
    place.add_argument("--out-format", choices=("yaml", "jsonl"), default="yaml")
    place.add_argument("-i", "--iterations", type=int, default=1000)
    place.add_argument("-m", "--match-coverage", type=float, default=0.7)
    place.add_argument("-r", "--remove-intersection", action="store_true")
    place.add_argument("-f", "--force", action="store_true")
    place.add_argument("--parallel", action="store_true", help="write folders of JSON lines and of errors, a file a task, instead of one file on the driver")
    describe = commands.add_parser("describe-db")
    describe.add_argument("database")
    describe.add_argument("-f", "--format", choices=("tsv", "json", "yaml"), default="tsv")
    convert = commands.add_parser("convert").add_subparsers(dest="what", required=True)
    tree = convert.add_parser("tree")
    tree.add_argument("tree")
    tree.add_argument("-o", "--output")
    tree.add_argument("-f", "--format", choices=("yaml", "json"), default="yaml")
    tree.add_argument("--min-branch-support", type=float, default=95)
    kmers = convert.add_parser("kmers")
    kmers.add_argument("sequence")
    kmers.add_argument("-k", "--kmer-size", type=int, default=31)
    database = convert.add_parser("database")
    database.add_argument("-d", "--database", required=True)
    database.add_argument("-t", "--only-tree", action="store_true")
    database.add_argument("-o", "--output", required=True)
    database.add_argument("-f", "--format", choices=("zstd", "yaml", "json"), default="yaml")
    watch = commands.add_parser("watch")
    watch.add_argument("--config-file", required=True)
    watch.add_argument("--once", action="store_true")
    serve = commands.add_parser("serve")
    serve.add_argument("--config-file", required=True)
    return top


def load(spark: SparkSession, path: str) -> model_store.Model:
    return model_store.load(spark, path) if Path(path).is_dir() else model_store.imported(spark, path)


def logged(args: argparse.Namespace) -> None:
    handler = logging.FileHandler(args.log_file) if args.log_file else logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines() if args.log_format == "jsonl" else logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logging.basicConfig(level=args.log_level.upper(), handlers=[handler])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logged(args)
    if args.command == "serve":
        with service.server(Y.Service.read(args.config_file)) as bound:
            bound.serve_forever()
        return 0
    spark = SparkSession.builder.master(args.master or os.environ.get("MASTER") or f"local[{args.threads}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    began = time.time()
    if args.command == "build-db":
        model_store.save(api.map_kmers_to_tree(spark, args.tree, args.msa, args.kmer_size, args.minimizer_size, args.min_branch_support), args.output)
    elif args.command == "place":
        model = load(spark, args.database)
        notes = Y.read_annotations(spark, args.annotations) if args.annotations else None
        found = api.place_sequences(spark, args.query, model, notes, args.iterations, args.match_coverage, args.remove_intersection)
        if args.parallel:
            api.write_parallel(found, args.output, args.force)
        else:
            api.write(found, args.output, args.out_format, args.force, model.nodes)
    elif args.command == "describe-db":
        found = api.describe(load(spark, args.database))
        print(json.dumps(found, indent=2) if args.format == "json" else Y.dump(found) if args.format == "yaml" else "\n".join(f"{k}\t{v}" for k, v in found.items()))
    elif args.command == "watch":
        settings = Y.Service.read(args.config_file)
        serve = settings.folders().serve_directory
        watcher.watch(spark, serve, settings, f"{serve}/.watcher", args.once).awaitTermination()
    elif args.what == "tree":
        nodes = T.collapse(newick.read(args.tree).nodes(spark), args.min_branch_support)
        text = Y.tree_text([r.asDict() for r in nodes.collect()], args.format)
        Path(args.output).write_text(text) if args.output else print(text)
    elif args.what == "kmers":
        one = spark.createDataFrame([(args.sequence,)], "seq string")
        packed = S.explode_kmers(one.withColumn("seq", S.sanitize(one.seq)), args.kmer_size)
        for r in packed.select(S.unpacked(packed.kmer, args.kmer_size).alias("kmer")).toLocalIterator():
            print(r.kmer)
    else:
        model_store.export(load(spark, args.database), args.output, args.format, args.only_tree)
    logging.info("took %.3f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
