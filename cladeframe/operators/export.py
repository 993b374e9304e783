"""Results as JSON lines or YAML documents, errors apart."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as X
from . import tree as T


def json_lines(placements: DataFrame) -> DataFrame:
    """(query, line): a JSON object per placed query. placement is a number at MaxResolutionReached,
    an object at IdentityFound and absent otherwise; annotations are absent if there are none."""
    identity = F.to_json(F.struct(F.col("clade_id").alias("clade"), "one", "rest"))
    placement = F.when(F.col("status") == X.RESOLUTION, F.col("clade_id").cast("string")).when(F.col("status") == X.IDENTITY, identity)

    def member(name: str, text: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f',"{name}":'), text), F.lit(""))

    def quoted(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)

    notes = F.to_json("annotations") if "annotations" in placements.columns else F.lit(None).cast("string")
    line = F.concat(F.lit('{"query":'), quoted(F.col("query")), member("code", quoted(X.code(F.col("status"), F.col("message")))), member("annotations", notes), member("placement", placement), F.lit("}"))
    return placements.where(F.col("status") != X.ERROR).select("query", line.alias("line"))


def errors(placements: DataFrame) -> DataFrame:
    return placements.where(F.col("status") == X.ERROR).select("query", "message")


def write_results(placements: DataFrame, out: str, overwrite: bool = False) -> None:
    """Writes out/result (JSON lines) and out/error in parallel; fails if they exist, unless overwrite."""
    mode = "overwrite" if overwrite else "errorifexists"
    json_lines(placements).select(F.col("line").alias("value")).write.mode(mode).text(f"{out}/result")
    errors(placements).select(F.col("message").alias("value")).write.mode(mode).text(f"{out}/error")


def write_file(placements: DataFrame, path: str, form: str = "yaml", overwrite: bool = False, nodes: DataFrame | None = None) -> Path:
    """Writes one result file (.yaml or .jsonl) and its .error sibling on the driver, row by row.

    With nodes, an identity shows its clade with all that is below it.
    """
    from ..sources import yaml_io as Y

    at = Path(path).with_suffix(".yaml" if form == "yaml" else ".jsonl")
    if at.exists() and not overwrite:
        raise FileExistsError(at)
    at.parent.mkdir(exist_ok=True)
    rows = [r.asDict() for r in nodes.collect()] if nodes is not None else []
    below: dict[int, list[dict]] = {}
    for r in rows:
        below.setdefault(r["parent_id"], []).append(r)
    by_id = {r["node_id"]: r for r in rows}

    def clade(i: int):
        if i not in by_id:
            return i
        found, todo = [], [by_id[i]]
        while todo:
            found.append(x := todo.pop())
            todo += below.get(x["node_id"], [])
        return T.nested(found)

    part = at.with_suffix(".part")
    with part.open("w") as result, at.with_suffix(".error").open("a") as failed:
        for r in placements.toLocalIterator():
            if r.status == X.ERROR:
                failed.write(r.message)
                continue
            doc: dict = {"query": r.query, "code": r.status if r.message is None else f"{r.status}: {r.message}"}
            if getattr(r, "annotations", None):
                doc["annotations"] = [{"clade": a.clade, "meta": Y.tagged(a.meta) if form == "yaml" else [{m["tag"]: m["value"]} for m in a.meta]} for a in r.annotations]
            if r.status == X.RESOLUTION:
                doc["placement"] = r.clade_id
            elif r.status == X.IDENTITY:
                doc["placement"] = {"clade": clade(r.clade_id), "one": r.one, "rest": r.rest}
            result.write(f"---\n{Y.dump(doc)}" if form == "yaml" else json.dumps(doc, ensure_ascii=False) + "\n")
    if at.exists():
        os.remove(at)
    shutil.move(part, at)
    return at


def tsv(row: DataFrame) -> str:
    """A one-row DataFrame as lines of name and value."""
    return "\n".join(f"{k}\t{v}" for k, v in row.first().asDict().items())
