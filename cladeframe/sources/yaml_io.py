"""YAML with tagged values (annotations), trees, job and service settings; read and written by the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..operators import tree as T

#: Tags of annotations.
TAGS = ("Taxid", "SciName", "Rank", "Gene", "InferenceMethod", "Note")
ANNOTATIONS = "clade long, meta array<struct<tag:string,value:string>>"


class Tagged(str):
    """A tagged value; tag names its kind."""

    tag: str = "Note"


class Loader(yaml.SafeLoader):
    pass


class Dumper(yaml.SafeDumper):
    pass


def _load(loader: Loader, suffix: str, node: yaml.Node) -> Tagged:
    out = Tagged(loader.construct_scalar(node))
    out.tag = suffix
    return out


def _dump(dumper: Dumper, value: Tagged) -> yaml.Node:
    return dumper.represent_scalar(f"!{value.tag}", str(value))


Loader.add_multi_constructor("!", _load)
Dumper.add_representer(Tagged, _dump)


def load(text: str):
    return yaml.load(text, Loader)  # noqa: S506  a safe loader with scalar tags


def dump(value) -> str:
    return yaml.dump(value, Dumper=Dumper, sort_keys=False, allow_unicode=True)


def annotations(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Rows (clade, meta) of a list of annotations."""
    rows = [(int(a["clade"]), [(v.tag if isinstance(v, Tagged) else "Note", str(v)) for v in a.get("meta") or []]) for a in items]
    return spark.createDataFrame(rows, ANNOTATIONS)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return annotations(spark, load(Path(path).read_text()) or [])


def tagged(meta: list) -> list[Tagged]:
    """The tagged values of a row's meta."""
    out = []
    for m in meta:
        v = Tagged(m["value"])
        v.tag = m["tag"]
        out.append(v)
    return out


def read_tree(path: str) -> list[dict]:
    """Rows of nodes of a YAML or JSON tree: a model with a root, or the root itself."""
    found = load(Path(path).read_text())
    return T.flattened(found.get("root", found))


def tree_text(rows: list[dict], form: str = "yaml") -> str:
    nested = T.nested(rows)
    return json.dumps(nested, indent=2) if form == "json" else dump(nested)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


class Settings:
    """Reads dataclasses from YAML whose keys are in camel case or as the fields are called."""

    @classmethod
    def read(cls, path: str):
        return cls.of(load(Path(path).read_text()) or {})

    @classmethod
    def of(cls, found: dict):
        names = {f.name for f in fields(cls)}
        return cls(**{n: found[k] for n in names for k in (camel(n), n) if k in found})

    def shown(self) -> dict:
        return {camel(f.name): v for f in fields(self) if (v := getattr(self, f.name)) is not None}

    def text(self) -> str:
        return dump(self.shown())


@dataclass
class Job(Settings):
    """A placement job."""

    name: str
    email: str
    query_file_id: int
    model_id: str
    work_dir: str
    description: str | None = None
    overwrite: bool | None = None
    remove_intersection: bool | None = None
    output_format: str = "yaml"


@dataclass
class Folders(Settings):
    """Names of folders and files of a service directory."""

    serve_directory: str = "."
    public_directory: str = "public"
    input_directory: str = "input"
    output_directory: str = "output"
    config_file_name: str = "config.yaml"
    results_file_name: str = "result.yaml"
    running_file_name: str = "running.yaml"
    success_file_name: str = "success.yaml"
    error_file_name: str = "error.yaml"
    logging_file_name: str = "logging.jsonl"


@dataclass
class Model(Settings):
    """An entry of the table of models."""

    id: str
    name: str
    gene: str | None = None
    model_path: str | None = None
    annotations_path: str | None = None


@dataclass
class Service(Settings):
    """Settings of the watcher and of the HTTP service (server: address and port)."""

    fs: dict
    models: list
    watcher: dict | None = None
    server: dict | None = None

    def folders(self) -> Folders:
        return Folders.of(self.fs)

    def model_table(self) -> list[Model]:
        return [Model.of(m) for m in self.models]
