"""Pending placement jobs as a stream.

A job is a folder with a configuration; running, success and error files mark its state. The stream
reads new configurations with Structured Streaming, whose checkpoint says which were taken, and runs
each micro-batch's pending jobs through the batch engine. The markers are kept as a side effect.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import telemetry
from ..operators import annotate, export, place
from ..operators import tree as T
from ..sources import fasta, files, model_store
from ..sources import yaml_io as Y

MARKERS = ("running", "success", "error")


def pending(jobs: DataFrame, markers: DataFrame) -> DataFrame:
    """Jobs without any marker; both have a column job."""
    return jobs.join(markers.select("job").distinct(), "job", "left_anti")


def with_models(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """Adds name and model_path of each job's model, and error where there is no such model."""
    known = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "model_path")
    out = jobs.join(known, "model_id", "left")
    return out.withColumn("error", F.when(F.col("model_path").isNull(), F.concat(F.lit("model not found: "), F.coalesce("model_id", F.lit("null")))))


def run_job(spark: SparkSession, job: Y.Job, folder: Path, service: Y.Service) -> Path:
    """Places a job's query file with its model; results always replace older ones."""
    names = service.folders()
    model = next((m for m in service.model_table() if m.id == job.model_id), None)
    if model is None:
        raise LookupError(f"model not found: {job.model_id}")
    queries = files.by_inode(str(folder / names.input_directory), job.query_file_id)
    if queries is None:
        raise FileNotFoundError(f"query file not found: {job.query_file_id}")
    found = model_store.load(spark, model.model_path)
    notes = Y.read_annotations(spark, model.annotations_path) if model.annotations_path else None
    if notes is None or notes.isEmpty():
        notes = found.annotations
    out = place_file(spark, str(queries), found, notes, remove_intersection=bool(job.remove_intersection))
    return export.write_file(out, str(folder / names.output_directory / names.results_file_name), job.output_format, overwrite=True, nodes=found.nodes)


def place_file(spark: SparkSession, path: str, model: model_store.Model, notes: DataFrame | None, **options) -> DataFrame:
    """Placements, annotated if there are annotations, of the records of a FASTA file."""
    queries = fasta.read(spark, path, ordered=False).withColumnRenamed("header", "query")
    inner, _ = T.inner_nodes(model.nodes)
    out = place.place(queries, model.index, inner, model.k, hashed=model.hashed, **options)
    return out if notes is None else annotate.annotate(out, notes, T.path_to_root(model.nodes))


def handle(spark: SparkSession, folder: Path, service: Y.Service) -> str:
    """Runs one job folder through its states; returns the last marker."""
    names = service.folders()
    marks = {m: folder / getattr(names, f"{m}_file_name") for m in MARKERS}
    if any(m.exists() for m in marks.values()):
        return "taken"
    try:
        job = Y.Job.read(str(folder / names.config_file_name))
        try:  # made by one worker only: whoever comes second finds the job taken
            with marks["running"].open("x") as claim:
                claim.write(Y.dump({"msg": f"Processing the query file {job.query_file_id} with model {job.model_id}"}))
        except FileExistsError:
            return "taken"
        with telemetry.job_log(folder / names.logging_file_name):
            telemetry.event(telemetry.STARTED, job=job.name)
            out = run_job(spark, job, folder, service)
            telemetry.event(telemetry.ENDED, job=job.name)
        marks["success"].write_text(Y.dump({"msg": f"Results are in {out.name}"}))
        return "success"
    except Exception as error:  # noqa: BLE001  whatever fails is the job's result
        marks["error"].write_text(Y.dump({"msg": str(error)}))
        return "error"


def watch(spark: SparkSession, serve: str, service: Y.Service, checkpoint: str, once: bool = False, seconds: int = 5, run: Callable[[SparkSession, Path, Y.Service], str] = handle) -> StreamingQuery:
    """Streams new job configurations below serve/public and runs them."""
    names = service.folders()
    found = spark.readStream.format("text").option("wholetext", "true").load(f"{serve}/{names.public_directory}/*/{names.config_file_name}")
    jobs = found.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"))

    def batch(df: DataFrame, _: int) -> None:
        for r in df.distinct().toLocalIterator():  # a row for each new job
            run(spark, Path(r.path).parent, service)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job of a stream or table of markers (job, marker): the strongest marker seen."""
    rank = F.when(F.col("marker") == "success", 3).when(F.col("marker") == "error", 2).when(F.col("marker") == "running", 1).otherwise(0)
    best = events.groupBy("job").agg(F.max(rank).alias("r"))
    return best.select("job", F.element_at(F.array(*[F.lit(x) for x in ("pending", "running", "error", "success")]), F.col("r") + 1).alias("state"))
