"""Trees as nested YAML text in part files, written and read by the executors.

Joined in the order of their names, the files of a folder are what yaml_io writes for a tree: a
mapping whose children are nested below it, a document for each root, a line for each field. The
driver holds no nodes, only the path that is open where a file or a split of one begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import tree as T

#: Fields of a node in the text, and what its first line looks like.
FIELDS = {"id": "node_id", "parent": "parent_id", "kind": "kind", "name": "name", "support": "support", "length": "length"}
FIRST = re.compile(r"(?:((?:  )*)- )?id:(?: |$)")
NODES = pa.schema([("node_id", pa.int64()), ("parent_id", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("support", pa.float64()), ("length", pa.float64()), ("child_ord", pa.int32())])
SEGMENT = "file string, start long, low int, n_low long, ids array<long>, counts array<long>, head array<string>"
SEGMENTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("low", pa.int32()), ("n_low", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("head", pa.list_(pa.string()))])
#: Nodes that are parsed at a time.
BATCH = 2000


class Dumper(getattr(yaml, "CSafeDumper", yaml.SafeDumper)):
    pass


#: Line breaks are escaped, so a field never takes two lines.
Dumper.add_representer(str, lambda d, x: d.represent_scalar("tag:yaml.org,2002:str", x, '"' if re.search("[\n\r\x85\u2028\u2029]", x) else None))
Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each node without those of the nodes below it."""
    for batch in batches:
        rows = batch.to_pylist()
        if not rows:
            continue
        fields = [{k: r[c] for k, c in FIELDS.items() if k == "id" or r[c] is not None} for r in rows]
        listed = "\n" + yaml.dump(fields, Dumper=Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=2**31 - 1).rstrip("\n")
        out = []
        for r, own in zip(rows, listed.split("\n- ")[1:], strict=True):
            lines = own.split("\n  ") + ["children:"] * r["has_children"]
            pad = "\n" + "  " * r["depth"]
            out.append((f"{pad[1:-2]}- " if r["depth"] else "---\n") + pad.join(lines))
        yield pa.RecordBatch.from_pydict({"value": out})


def write(nodes: DataFrame, out: str) -> None:
    """Writes a folder of text files."""
    rows = T.preorder(nodes).orderBy("rank").select("depth", "has_children", *FIELDS.values())
    rows.mapInArrow(_texts, "value string").write.text(out)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int | None, list[str]]]:
    """((file, start), depth, lines) of each node; without a depth, lines of a node that begins before the segment."""
    at, depth, lines = None, None, []
    for batch in batches:
        for value, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (where := tuple(where)):
                if lines:
                    yield at, depth, lines
                at, depth, lines = where, None, []
            if first := FIRST.match(value):
                if lines:
                    yield at, depth, lines
                depth, lines = 0 if first[1] is None else len(first[1]) // 2 + 1, [value]
            elif value and value != "---":
                lines.append(value)
    if lines:
        yield at, depth, lines


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each segment does to the open path: nodes of its least depth, and the path from the last of them on."""
    out = []
    for (file, start), nodes in groupby(_cut(batches), key=itemgetter(0)):
        low, n_low, path, head = None, 0, [], []
        for _, depth, lines in nodes:
            if depth is None:
                head = lines
                continue
            if low is None or depth < low:
                low, n_low, path = depth, 0, []
            del path[depth - low :]
            if depth == low:
                n_low += 1
            else:
                _add(path, depth - low, lines)
            path.append([lines[0], 0])
        ids = [yaml.load(x.partition("id:")[2], Loader) for x, _ in path]  # noqa: S506  a safe loader
        out.append({"file": file, "start": start, "low": low, "n_low": n_low, "ids": ids, "counts": [n for _, n in path], "head": head})
    if out:
        yield pa.RecordBatch.from_pylist(out, SEGMENTS)


def _add(path: list[list], depth: int, lines: list[str]) -> None:
    if len(path) != depth:
        raise ValueError(f"a node without a parent above it: {lines[0]}")
    path[-1][1] += 1


def _begins(segments: list[Row]) -> dict[tuple[str, int], tuple[list[list], list[str]]]:
    """The open path (id, children so far) before each segment, and the lines behind it that belong to its last node."""
    # numbers in names by value: there may be more files than their padding allows for
    segments = sorted(segments, key=lambda s: ([int(x) if x.isdigit() else x for x in re.split("([0-9]+)", s.file)], s.start))
    path, paths, tails, tail = [], {}, {}, []
    for s in segments:
        paths[s.file, s.start] = path
        if s.low is not None:
            path = [list(x) for x in path[: s.low]]
            if s.low:
                _add(path, s.low, [s.file])
                path[-1][1] += s.n_low - 1
            path += [list(x) for x in zip(s.ids, s.counts, strict=True)]
    for s in reversed(segments):
        tails[s.file, s.start] = tail
        tail = s.head + (tail if s.low is None else [])
    if tail:
        raise ValueError(f"text before the first node: {tail[0]}")
    return {at: (paths[at], tails[at]) for at in paths}


def _whole(nodes: Iterator[tuple], tail: list[str]) -> Iterator[tuple[int, list[str]]]:
    held = None
    for _, depth, lines in nodes:
        if depth is not None:
            if held:
                yield held
            held = depth, lines
    if held:
        yield held[0], held[1] + tail


def _parsed(nodes: tuple[tuple[int, list[str]], ...]) -> list[dict]:
    texts = []
    for depth, lines in nodes:
        pad = "  " * depth
        if not all(x.startswith(pad) for x in lines[1:]):
            raise ValueError(f"lines of another depth in a node: {lines}")
        texts.append("- " + "\n  ".join(x[len(pad) :] for x in lines))
    return yaml.load("\n".join(texts), Loader)  # noqa: S506  a safe loader


def _number(value) -> float | None:
    return None if value is None else float(value)


def _rows(begins) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, nodes in groupby(_cut(batches), key=itemgetter(0)):
            before, tail = begins.value[at]
            path = [list(x) for x in before]
            for some in batched(_whole(nodes, tail), BATCH):
                out = []
                for (depth, lines), t in zip(some, _parsed(some), strict=True):
                    del path[depth:]
                    if depth:
                        _add(path, depth, lines)
                    parent, k = (path[-1][0], path[-1][1] - 1) if depth else (t.get("parent"), 0)
                    path.append([t["id"], 0])
                    out.append({"node_id": t["id"], "parent_id": parent, "kind": t.get("kind"), "name": t.get("name"), "support": _number(t.get("support")), "length": _number(t.get("length")), "child_ord": k})
                yield pa.RecordBatch.from_pylist(out, NODES)

    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a folder that write() made. Parents are those that nodes are nested in; a root keeps the parent it names.

    Text in another style of YAML is read by yaml_io.read_tree.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    begins = spark.sparkContext.broadcast(_begins(lines.mapInArrow(_segments, SEGMENT).collect()))
    return lines.mapInArrow(_rows(begins), T.NODES)
